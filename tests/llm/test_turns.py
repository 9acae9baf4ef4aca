import hashlib
import heapq
import random
import re
import zlib

from pyspark.sql import functions as F

from spanledger.llm import queries, turns

SPACES = " \t\n\v\f\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        tail = text.rstrip(SPACES)[-1:]
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "" if tail in ".!?" else "truncated")
        seen.add((role, text))
    return out


def search(rows, kinds):
    """All edit sequences by cost, then by audit: the first that ends in a legal conversation is the answer."""
    queue = [(0, "", 0, (), "")]
    while True:
        cost, audit, i, out, roles = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        for role in ("user", "assistant"):
            if len(audit) < 2 * len(rows) + 4:
                heapq.heappush(queue, (cost + 5, audit + "I", i, (*out, (role, "")), roles + role[0]))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, out, roles))
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 if kinds[i] == "truncated" else 0
                if role[:1] in tuple("sua"):
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, (*out, (role, text)), roles + role[:1]))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + more + 1, audit + "R", i + 1, (*out, (new, text)), roles + new[0]))


def brute_force(rows):
    """rows(turn, role, text) of one conversation after damage."""
    clean = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    clean.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    if not clean:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
    numbers = {t for t, _, _ in clean if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    pairs = [(r, x) for _, r, x in clean]
    kinds = faults(pairs)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    cost, audit, text = search(pairs, kinds)
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def made(rng, n):
    roles = ["user", "assistant", "system", "tool", "", None, "User", "aide"]
    texts = ["Yes.", "No!", "Why?  \n", "cut", "", " \t", None, "é.", "cut", "line\nline."]
    return [(rng.choice([None, *range(6)]), rng.choice(roles if rng.random() < 0.4 else roles[:2]), rng.choice(texts if rng.random() < 0.5 else texts[:3])) for _ in range(n)]


def table(spark, convs):
    rows = [(c, *r, "x", "y", 1) for c, rs in convs.items() for r in rs]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, code string, place long")


def test_repairs_against_a_search_of_all_edits(spark):
    rng = random.Random(3)
    convs = {None if c == 0 else c: made(rng, rng.choice([1, 2, 3, 4, 5, 6])) for c in range(120)}
    rows = table(spark, convs)
    report = turns.structure(rows)
    hashed = {r[0]: r[1] for r in turns.digests(turns.repaired(rows, report)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r[0]: (*r[1:], hashed.get(r[0], empty)) for r in report.collect()}
    assert got == {c: brute_force(rs) for c, rs in convs.items()}
    assert turns.structure(rows.limit(0)).count() == 0 == turns.repaired(rows.limit(0), report.limit(0)).count()


def test_long_conversations_go_by_blocks(monkeypatch):
    rng = random.Random(4)
    codes = [bytes(rng.choice([1, 2, 3, 2, 3, 6, 10, 14, 15, 0, 12]) for _ in range(n)) for n in (0, 1, 3, 50, 257)]
    want = [turns.cheapest(c) for c in codes]
    for block in (1, 2, 7):
        monkeypatch.setattr(turns, "BLOCK", block)
        assert [turns.cheapest(c) for c in codes] == want
    assert turns.cheapest(b"\x02\x03" * 10_000) == (0, "K" * 20_000)


def test_whole_query_with_damage(spark, tmp_path):
    rng = random.Random(5)
    convs = {c: made(rng, rng.choice([1, 2, 4, 5])) for c in range(60)}
    convs[99] = next([(t, "user", "gone.")] for t in range(1000) if zlib.crc32(f"99:{t}".encode()) % 20 == 0)
    table(spark, convs).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c, rows in convs.items():
        out = []
        for t, r, x in rows:
            kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
            r, x = " " if r is None else r, " " if x is None else x
            r, x = "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            out += [(t, r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        want[c] = brute_force(out)
    got = queries.op11_conversation_repair(spark, str(tmp_path)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    assert want[99][6] == "" and len(got.columns) == 9
    assert got.where(F.col("conv_id").isNull()).count() == 0
