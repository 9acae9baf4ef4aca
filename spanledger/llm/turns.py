"""Repair of conversations by a cost-to-go over turns and states of a grammar.

The roles of a repaired conversation are empty or an optional system turn and then pairs of user and assistant, so the
grammar has four states: nothing yet, after system, after user, after assistant. Edits keep a turn, give it the
role that the state asks for, delete it or insert an empty turn of that role. From the last turn backwards each
state gets its cheapest cost to the end; the walk forward takes, among the edits that the costs allow, the one whose initial
is the least in ASCII. As an initial and a state tell the next state, this gives the least string of all cheapest ones.

Turns are sorted by conversation in the shuffle and stream through a task. A conversation costs it one byte a turn, as
cost vectors are kept for each BLOCK turns only and worked out again on the way forward. Texts pass once, next to
the edits that were decided on without them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE

#: Costs of the edits, and of a truncated turn that stays.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

BLOCK = 4096
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each state: the role and state of the turn that a rename or an insertion gives.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_BLANK, _DUPLICATE, _TRUNCATED = 4, 8, 12  # added to a turn's initial: its code of one byte
_AT_END = (0, 2 * INSERT, INSERT, 0)


def _kept(code: int, state: int) -> int | None:
    """The state after a turn that is kept as it is, if it can be."""
    role = code & 3
    if role == SYSTEM:
        return SYSTEM if state == START else None
    return role if role and _NEXT[state] == role else None


def _edits(code: int, state: int, after: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """Initial, next state and cost to the end of each edit that uses up a turn, by initial; `after` is the cost vector behind it."""
    found, fault = [("D", state, DELETE + after[state])], code & 12
    if fault in (_BLANK, _DUPLICATE):
        return found
    more = TRUNCATED if fault == _TRUNCATED else 0
    if (kept := _kept(code, state)) is not None:
        found.append(("K", kept, more + after[kept]))
    return [*found, ("R", _NEXT[state], RENAME + more + after[_NEXT[state]])]


def _before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The cost vector before a turn: edits of the turn after at most two insertions."""
    bare = [min(c for *_, c in _edits(code, s, after)) for s in range(4)]
    one = [INSERT + bare[_NEXT[s]] for s in range(4)]
    return tuple(min(bare[s], one[s], INSERT + one[_NEXT[s]]) for s in range(4))


def cheapest(codes: bytes) -> tuple[int, str]:
    """The least cost of a conversation and the initials of its edits."""
    heads, vector = [], _AT_END
    for lo in reversed(range(0, len(codes), BLOCK)):
        heads.append(vector)  # behind the block
        for code in reversed(codes[lo : lo + BLOCK]):
            vector = _before(code, vector)
    cost, state, audit = vector[START], START, []
    for lo in range(0, len(codes), BLOCK):
        block, vectors = codes[lo : lo + BLOCK], [heads.pop()]
        for code in reversed(block):
            vectors.append(_before(code, vectors[-1]))
        for code in block:
            here = vectors.pop()
            while True:
                edits = [*_edits(code, state, vectors[-1]), ("I", _NEXT[state], INSERT + here[_NEXT[state]])]
                initial, state = min((e, s) for e, s, c in edits if c == here[state])
                audit.append(initial)
                if initial != "I":
                    break
    while _AT_END[state]:
        audit.append("I")
        state = _NEXT[state]
    return cost, "".join(audit)


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """What is known of a conversation whose turns come in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.illegal, self.turns, self.least, self.last = conv_id, bytearray(), 0, 0, None, None

    def add(self, turn: int | None, code: int) -> None:
        if self.codes and (self.codes[-1] & 3, code & 3) not in _LEGAL:
            self.illegal += 1
        self.codes.append(code)
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.turns, self.last = self.turns + 1, turn

    def row(self) -> tuple:
        faults = [sum(self.codes.count(f | r) for r in range(4)) for f in (_BLANK, _DUPLICATE, _TRUNCATED)]
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, *faults, self.illegal, *cheapest(bytes(self.codes))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, {"long": pa.int64(), "string": pa.string()}[k]) for c, k in zip(columns, kinds)], names=list(names))


def _report(batches):
    now = None
    for batch in batches:
        done = []
        for conv_id, turn, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "code"))):
            if now is None or conv_id != now.conv_id:
                done += [now.row()] if now else []
                now = _Conversation(conv_id)
            now.add(turn, code)
        yield _batch(done, _REPORT)
    if now:
        yield _batch([now.row()], _REPORT)


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit("".join(map(chr, WHITE_SPACE))))


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls as one space, and what rows of one turn are sorted by."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *filled)
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def structure(conversations: DataFrame) -> DataFrame:
    """What is wrong with each conversation, and its cheapest repair.

    conversations(conv_id, turn, role, text). Returns a row per conv_id, null being one too: gaps (numbers missing among the turns),
    blank, duplicate, truncated (rows by their first fault), illegal (neighbours whose roles can't follow each
    other), cost and audit (initials of the edits Keep, Rerole, Delete, Insert). Rows go by turn, nulls first; those of
    one turn by role, then by the SHA-256 of their text, so that repeated rows are neighbours. A null role or text is one space;
    a role that begins with none of s, u, a can't be kept. Other columns are ignored; an empty table gives no rows.
    """
    last = F.substring(_trimmed(F.col("text")), -1, 1)
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    rows = _turns(conversations).select("conv_id", "turn", "role", "digest", last.alias("last")).repartition("conv_id")
    rows = rows.withColumn("nth", F.row_number().over(seen))
    fault = F.when(F.col("last") == "", _BLANK).when(F.col("nth") > 1, _DUPLICATE).when(~F.col("last").isin(".", "!", "?"), _TRUNCATED).otherwise(0)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    coded = rows.withColumn("code", (fault + role).cast("int"))
    return _in_order(coded, last=["nth"]).select("conv_id", "turn", "code").mapInArrow(_report, _REPORT)


def _in_order(rows: DataFrame, first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    return rows.sortWithinPartitions(F.asc_nulls_first("conv_id"), *first, F.asc_nulls_first("turn"), "role", "digest", *last)


_REPAIRED = "conv_id long, place long, role string, text string"


def _rebuild(batches):
    """Rows of a conversation come behind its audit, which is the text of a row of part 0."""
    conv_id = audit = None
    at = place = state = 0

    def inserted():
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            at, place, state = at + 1, place + 1, _NEXT[state]
            yield conv_id, place - 1, _ROLE[state], ""

    for batch in batches:
        out = []
        for new, part, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text"))):
            if part == 0:
                conv_id, audit, at, place, state = new, text, 0, 0, START
            else:
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = _NEXT[state] if edit == "R" else _INITIAL[role[0]]
                    out.append((conv_id, place, _ROLE[state] if edit == "R" else role, text))
                    place += 1
            out += inserted()
        yield _batch(out, _REPAIRED)


def repaired(conversations: DataFrame, report: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), role, text.

    report is what structure() gave for the same rows. A conversation whose turns are all deleted has no rows; an empty
    table gives none. Partitions hold whole conversations, each one's rows together and by place.
    """
    turns = _turns(conversations).withColumn("part", F.lit(1))
    audits = report.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(b"").alias("digest"), F.lit(0).alias("part"))
    return _in_order(turns.unionByName(audits).repartition("conv_id"), first=["part"]).select("conv_id", "part", "role", "text").mapInArrow(_rebuild, _REPAIRED)


_HASHED = "conv_id long, repaired_sha256 string"


def _hash(batches):
    now = ()
    for batch in batches:
        done = []
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if not now or conv_id != now[0]:
                done += [(now[0], now[1].hexdigest())] if now else []
                now = conv_id, hashlib.sha256()
            else:
                now[1].update(b"\n")
            now[1].update(f"{role}:{text}".encode())
        yield _batch(done, _HASHED)
    if now:
        yield _batch([(now[0], now[1].hexdigest())], _HASHED)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of the lines `role:text` of what repaired() gave, as it gave it; a turn at a time is held."""
    return turns.mapInArrow(_hash, _HASHED)
