"""Similarity join of shingle sets by prefix trees.

Two sets with 100 * intersection >= percent * union differ so little that among the first shingles of both, in any order that
holds for all sets, some are common. This is used twice.

First in the order of the hashes: of its first n - need + slack shingles a set must share `slack` with other sets, or
nothing links it. Hashes go to segments of the hash space packed in arrays; most documents end here.

Of the sets that are left, shingles with the same holders are one class with a weight, so that a set is a short list of
classes. Lists are in the global order of the classes, rarest first. A class that stands early enough in its holders' lists makes them
a group; a group's lists are stored in a trie, whose edges hold runs of classes. One traversal serves all queries at once:
overlaps that lists share up to a node are summed once, and a subtree is pruned for the queries whose overlap, with
what remains of the query and of the subtree, can't reach what the lengths ask for. Weights make the overlap at a leaf exact.

Large groups are cut into blocks. A first round takes three classes of each list, with one typical list in all blocks of a
group. Only the groups that still have lists of different components go through the second round, which is complete: in
a group of several blocks those that are not in its commonest component meet every block. Of small groups the lists are cut behind the classes
that stand early enough, as documents come in many of these groups; pairs that their bounds leave are confirmed on whole lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blooms import as_filter
from .common import gathered, id_text, mix64, slices, stash
from .components import components
from .near_dedup import shingle_sets

SHINGLE, PERCENT = 5, 80
BLOCK = 256  # lists of a group in a task at a time
SMALL = 64  # lists of a group that is searched by cut lists, its pairs confirmed one by one
SEGMENT_ENTRIES = 4_000_000
CELLS = 1 << 22  # of the matrix of queries and classes
#: A key with more than 1 / SHARE of all rows is joined by a broadcast, of SHARE rows at most; the others have few rows each.
SHARE = 100_000

_KEYS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def need(n, percent: int):
    """Least intersection of a set of n with one that it links to."""
    return (percent * n + 99) // 100


def slack(n):
    return np.maximum(1, n // 10)


def _keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of each set, zeros for empty ones."""
    out, full = np.zeros((len(bounds) - 1, 2), dtype=np.uint64), np.flatnonzero(np.diff(bounds))
    if len(full):
        with np.errstate(over="ignore"):
            out[full] = np.stack([np.add.reduceat(mix64(h ^ np.uint64(c)), bounds[:-1][full]) for c in _KEYS], axis=1)
    return out


def _columns(**arrays) -> pa.RecordBatch:
    return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays.values()], names=list(arrays))


def _sign(k: int):
    def run(batches):
        for part in slices(batches):
            h, bounds = shingle_sets(part.column("text"), k)
            keys = _keys(h, bounds).view(np.int64)
            yield _columns(doc_id=part.column("doc_id"), n=np.diff(bounds), key=keys[:, 0], key2=keys[:, 1])

    return run


_PACKED = "segment int, tokens binary, keys binary, often binary, met binary, times binary"


def _first_tokens(k: int, percent: int, segments: int):
    """What each set holds among its least hashes, by segment. Tokens that several sets of a chunk hold are counted at once."""

    def run(batches):
        for chunk in gathered(batches, limit=12 << 20):
            tokens, keys = [], []
            for part in slices([chunk]):
                h, bounds = shingle_sets(part.column("text"), k)
                n = np.diff(bounds)
                first = np.arange(len(h)) - np.repeat(bounds[:-1], n) < np.repeat(n - need(n, percent) + slack(n), n)
                tokens.append(h[first])
                keys.append(np.repeat(_keys(h, bounds)[:, 0], n)[first])
            mixed, keys = mix64(np.concatenate(tokens)), np.concatenate(keys)
            token, segment = mixed.astype(np.uint32), ((mixed >> np.uint64(33)) % np.uint64(segments)).astype(np.int32)
            order = np.lexsort((keys, token, segment))
            token, segment, keys = token[order], segment[order], keys[order]
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (segment[1:] != segment[:-1])
            fresh = new.copy()
            fresh[1:] |= keys[1:] != keys[:-1]
            token, segment, keys, new = token[fresh], segment[fresh], keys[fresh], new[fresh]  # pairs of token and set, once each
            size = np.diff(np.append(np.flatnonzero(new), len(new)))
            shared = np.repeat(size > 1, size)
            met, times = np.unique(keys[shared], return_counts=True)
            for s in np.unique(segment).tolist():
                at = slice(*np.searchsorted(segment, (s, s + 1)))
                lone, often = ~shared[at], shared[at] & new[at]
                cells = (token[at][lone], keys[at][lone], token[at][often], np.zeros(0), np.zeros(0))
                yield _columns(segment=pa.array([s], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("tokens", "keys", "often", "met", "times"), cells)})
            if len(met):
                home = int(met[0] % np.uint64(segments))
                yield _columns(segment=pa.array([home], pa.int32()), tokens=pa.array([b""]), keys=pa.array([b""]), often=pa.array([b""]), met=pa.array([met.tobytes()]), times=pa.array([times.astype(np.int64).tobytes()]))

    return run


_PARTIAL = "part int, keys binary, shared binary"


def _count_shared(parts: int):
    """Rows come sorted by segment: how many tokens of a segment each set shares with others, packed by the part that sums the set's counts."""

    def close(rows: list[dict]):
        token, keys, often, met, times = (np.frombuffer(b"".join(r[c] for r in rows), dtype=d) for c, d in (("tokens", np.uint32), ("keys", np.uint64), ("often", np.uint32), ("met", np.uint64), ("times", np.int64)))
        order = np.lexsort((keys, token))
        token, keys = token[order], keys[order]
        fresh = np.ones(len(token), dtype=bool)
        fresh[1:] = (token[1:] != token[:-1]) | (keys[1:] != keys[:-1])
        token, keys = token[fresh], keys[fresh]  # pairs of token and set, once each
        bounds = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(bounds, len(token)))
        found = keys[np.repeat((size > 1) | np.isin(token[bounds], often), size)]
        every, total = _summed(np.concatenate((met, found)), np.concatenate((times, np.ones(len(found), dtype=np.int64))))
        part = (every % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        numbers, starts = np.unique(part[order], return_index=True)
        packed = lambda x: pa.array([y.tobytes() for y in np.split(x[order], starts[1:])] if len(numbers) else [], pa.binary())
        return _columns(part=pa.array(numbers, pa.int32()), keys=packed(every), shared=packed(total))

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] != now and rows:
                    yield close(rows)
                    rows = []
                now = row["segment"]
                rows.append(row)
        if rows:
            yield close(rows)

    return run


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every, at = np.unique(keys, return_inverse=True)
    return every, np.bincount(at, counts, len(every)).astype(np.int64)


def _sum_parts(batches):
    """Rows come sorted by part: the sums of what the segments counted."""
    now, keys, counts = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != now and keys:
                every, total = _summed(np.concatenate(keys), np.concatenate(counts))
                yield _columns(key=every.view(np.int64), shared=total)
                keys, counts = [], []
            now = row["part"]
            keys.append(np.frombuffer(row["keys"], dtype=np.uint64))
            counts.append(np.frombuffer(row["shared"], dtype=np.int64))
    if keys:
        every, total = _summed(np.concatenate(keys), np.concatenate(counts))
        yield _columns(key=every.view(np.int64), shared=total)


def _survivors(docs: DataFrame, signed: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, key, n of one document for each distinct set that shares enough of its first hashes with other sets."""
    limit = f"n - {need_sql('n', percent)} + greatest(1, n div 10)"
    entries = signed.agg(F.sum(F.expr(limit))).first()[0] or 0
    segments = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // SEGMENT_ENTRIES))
    packed = docs.select("text").mapInArrow(_first_tokens(shingle, percent, segments), _PACKED)
    counts = packed.repartition(segments, "segment").sortWithinPartitions("segment").mapInArrow(_count_shared(segments), _PARTIAL)
    counts = counts.repartition(segments, "part").sortWithinPartitions("part").mapInArrow(_sum_parts, "key long, shared long")
    reps = signed.groupBy("key", "key2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    return reps.join(counts, "key").where(f"shared >= greatest(1, {need_sql('n', percent)} div 10)").select("doc_id", "key", "n")


def _of_survivors(docs: DataFrame, survivors: DataFrame) -> DataFrame:
    """docs without most of those that are no survivors, so that few texts move; all of docs if the survivors are too many for a filter."""
    held = as_filter(survivors.select(F.col("doc_id").alias("hash")))
    if held is None:
        return docs

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield batch.filter(pa.array(held.value.has(ids), pa.bool_()))

    return docs.mapInArrow(run, "doc_id long, text string")


def need_sql(n: str, percent: int) -> str:
    return f"(({percent} * {n} + 99) div 100)"


def _sets(k: int):
    def run(batches):
        for part in slices(batches):
            h, bounds = shingle_sets(part.column("text"), k)
            same = np.flatnonzero(_keys(h, bounds)[:, 0].view(np.int64) == part.column("key").to_numpy())
            yield _columns(key=part.column("key").take(pa.array(same)), shingles=pa.array([h[bounds[r] : bounds[r + 1]].tobytes() for r in same], pa.binary()))

    return run


def _spread(batches):
    for batch in batches:
        for key, shingles in zip(batch.column("key").to_pylist(), batch.column("shingles")):
            own = np.frombuffer(shingles.as_buffer(), dtype=np.int64)
            yield _columns(key=np.full(len(own), key), token=own)


def _keyed_join(rows: DataFrame, table: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """Inner join whose large keys don't meet in one task; `size` is the table's column of how many rows a key has.

    Keys of more than total / SHARE rows (1,000 at least) are SHARE at most, whatever the data, and are broadcast.
    """
    large = F.col(size) > max(1000, total // SHARE)
    hot = F.broadcast(table.where(large))
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(table.where(~large), on))


def _class_lists(sets: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    """doc_id, key, n, items, weights: each set as classes in the global order, without the shingles that no other set holds."""
    tokens = sets.mapInArrow(_spread, "key long, token long")
    often = stash(tokens.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("key")).alias("holders")).where("c > 1"))
    total = often.agg(F.sum("c")).first()[0] or 0
    item = F.shiftleft(F.floor(F.log2("c")).cast("long"), 57).bitwiseOR(F.shiftrightunsigned(F.xxhash64("c", "holders"), 7))
    held = _keyed_join(tokens, often, "token", "c", total).groupBy("key", item.alias("item")).agg(F.count("*").alias("w"))
    lists = held.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("item", "w"))).alias("list"))
    lists = survivors.join(lists, "key").select("doc_id", "key", "n", F.col("list.item").alias("items"), F.col("list.w").alias("weights"))
    return stash(lists.where(f"aggregate(weights, 0L, (a, w) -> a + w) >= {need_sql('n', percent)}"))


_PREFIX = "item long, doc_id long, key long, first boolean, short boolean, lone double"


def _prefix_rows(percent: int):
    """The classes that stand early enough in a list: whether they are in the first round, and whether they would be early for the smaller set
    of a pair too. The first round takes the rarest class, which ties pairs, and the commonest and the middle one, which tie larger groups."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, key, n, items, weights in zip(*(batch.column(c) for c in ("doc_id", "key", "n", "items", "weights"))):
                n, w = n.as_py(), weights.values.to_numpy()
                at = n - w.sum() + np.cumsum(w) - w  # shingles before each class, those of this set alone first
                count = int(np.searchsorted(at, n - need(n, percent), side="right"))
                place = np.arange(count)
                first = (place == 0) | (place == count // 2) | (place == count - 1)
                short = at[:count] <= n - (2 * percent * n + 99 + percent) // (100 + percent)
                out.append(_columns(item=items.values.slice(0, count), doc_id=pa.repeat(doc, count), key=pa.repeat(key, count), first=first, short=short, lone=np.full(count, (n - w.sum()) / n)))
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(map(len, out)) else out[0]

    return run


class Trie:
    """Lists of classes (ascending numbers) as a trie with runs of classes on its edges; a list may stop before its set does, `tails` is what is behind."""

    def __init__(self, lists: list[np.ndarray], weights: list[np.ndarray], n: np.ndarray, tails: np.ndarray | None = None):
        tails = np.zeros(len(lists), dtype=np.int64) if tails is None else tails
        order = sorted(range(len(lists)), key=lambda i: lists[i].astype(">i8").tobytes())
        self.order, self.lists, self.n = order, [lists[i] for i in order], n[order]
        #: of each list: weight behind each number of classes
        self.rest = [np.append(np.cumsum(weights[i][::-1])[::-1], 0) + tails[i] for i in order]
        #: classes that each list has in common with the one before
        self.common = [0] + [self._common(a, b) for a, b in zip(self.lists, self.lists[1:])]

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        return int(differ[0]) if len(differ) else m

    def search(self, overlap: np.ndarray, left: np.ndarray, sizes: np.ndarray, percent: int):
        """Pairs (query, list) that link, or may do so by what is behind the ends of lists. overlap[q, v] is the weight of class v if the query
        holds it; left[q, v] what it holds from v on."""
        stack = [(0, len(self.lists), 0, np.arange(len(sizes)), np.zeros(len(sizes), dtype=np.int64))]
        while stack:
            lo, hi, depth, who, sums = stack.pop()
            to = min(self.common[lo + 1 : hi], default=len(self.lists[lo]))
            edge = self.lists[lo][depth:to]
            if len(edge):
                sums = sums + overlap[who[:, None], edge].sum(axis=1)
            rest = max(int(self.rest[i][to]) for i in range(lo, hi))
            last = self.lists[lo][to - 1] + 1 if to else 0
            low, high = int(self.n[lo:hi].min()), int(self.n[lo:hi].max())
            most = sums + np.minimum(left[who, last], rest)
            alive = ((100 + percent) * most >= percent * (sizes[who] + low)) & (percent * sizes[who] <= 100 * high) & (percent * low <= 100 * sizes[who])
            who, sums = who[alive], sums[alive]
            if not len(who):
                continue
            at = lo
            while at < hi and len(self.lists[at]) == to:  # lists that end here are the first ones
                total = sums + np.minimum(left[who, last], self.rest[at][to])
                for q in who[(100 + percent) * total >= percent * (sizes[who] + self.n[at])].tolist():
                    yield q, self.order[at]
                at += 1
            while at < hi:
                end = at + 1
                while end < hi and self.common[end] > to:
                    end += 1
                stack.append((at, end, to, who, sums))
                at = end


def _found(stored: list[dict], asked: list[dict], percent: int):
    """Pairs (row asked, row stored) of different labels that link, or may if lists are cut."""
    if not stored or not asked:  # a block of an even split by hash may have got none
        return
    arrays = [np.asarray(r["items"], dtype=np.int64) for r in stored]
    classes = np.unique(np.concatenate(arrays))
    numbers = lambda rows, c: np.array([r[c] for r in rows], dtype=np.int64)
    trie = Trie([np.searchsorted(classes, x) for x in arrays], [np.asarray(r["weights"], dtype=np.int64) for r in stored], numbers(stored, "n"), numbers(stored, "tail"))
    step = max(1, CELLS // (len(classes) + 1))
    for at in range(0, len(asked), step):
        part = asked[at : at + step]
        overlap, left = (np.zeros((len(part), len(classes) + 1), dtype=np.int64) for _ in range(2))
        for q, row in enumerate(part):
            items, weights = np.asarray(row["items"], dtype=np.int64), np.asarray(row["weights"], dtype=np.int64)
            place = np.minimum(np.searchsorted(classes, items), len(classes) - 1)
            held = classes[place] == items
            overlap[q, place[held]] = weights[held]
            rest = np.append(np.cumsum(weights[::-1])[::-1], 0) + row["tail"]
            left[q, 1:] = rest[np.searchsorted(items, classes, side="right")]  # behind class v, at v + 1
            left[q, 0] = rest[0]
        for q, i in trie.search(overlap, left, numbers(part, "n"), percent):
            if part[q]["label"] != stored[i]["label"]:
                yield part[q], stored[i]


def group_links(rows: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between lists of different labels in a group, as few as connect the labels that they connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for x, y in _found([r for r in rows if r["stored"]], [r for r in rows if r["asked"]], percent):
        a, b = root(x["label"]), root(y["label"])
        if a != b:
            parent[a] = b
            found.append((x["doc_id"], y["doc_id"]))
    return found


def group_candidates(rows: list[dict], percent: int) -> list[tuple[int, int, int, int]]:
    """Pairs that may link by their cut lists, in the group of the first class that both hold only."""
    out = []
    for x, y in _found([r for r in rows if r["stored"]], [r for r in rows if r["asked"]], percent):
        a, b = sorted(((x["doc_id"], x["key"]), (y["doc_id"], y["key"])))
        if np.intersect1d(x["items"], y["items"], assume_unique=True)[0] == x["item"]:
            out.append((*a, *b))
    return out


def _by_group(use, schema: str, percent: int):
    """Rows come sorted by group: item, index block and query block."""
    names = [c.split()[0] for c in schema.split(", ")]
    made = lambda found: _columns(**{n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*found) if found else [()] * len(names))})

    def run(batches):
        now, rows = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                group = row["item"], row["i"], row["j"]
                if group != now and rows:
                    out += use(rows, percent)
                    rows = []
                now = group
                rows.append(row)
            yield made(out)
        yield made(use(rows, percent) if rows else [])

    return run


_CANDIDATES = "u long, key_u long, v long, key_v long"


def _grouped(members: DataFrame, lists: DataFrame, use, schema: str, percent: int) -> DataFrame:
    """use() over the groups (item, i, j) of members, with their lists(doc_id, key, n, tail, items, weights)."""
    full = members.join(lists, ["doc_id", "key"])
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # their bytes don't tell what the groups cost
    return full.repartition(partitions, "item", "i", "j").sortWithinPartitions("item", "i", "j").mapInArrow(_by_group(use, schema, percent), schema)


def _confirm(percent: int):
    """Pairs of whole lists: those whose common weight is enough."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            keep = []
            for r in rows:
                _, a, _ = np.intersect1d(np.asarray(r["items"], dtype=np.int64), np.asarray(r["other"], dtype=np.int64), assume_unique=True, return_indices=True)
                keep.append((100 + percent) * int(np.asarray(r["weights"], dtype=np.int64)[a].sum()) >= percent * (r["n"] + r["n_other"]))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    left = lists.select(F.col("doc_id").alias("u"), F.col("key").alias("key_u"), "n", "items", "weights")
    right = lists.select(F.col("doc_id").alias("v"), F.col("key").alias("key_v"), F.col("n").alias("n_other"), F.col("items").alias("other"))
    return stash(pairs.join(left, ["u", "key_u"]).join(right, ["v", "key_v"]).select("u", "v", "n", "n_other", "items", "weights", "other").mapInArrow(_confirm(percent), "u long, v long"))


def _block(count: str) -> str:
    return f"cast(pmod(xxhash64(key), ({count} + {BLOCK} - 1) div {BLOCK}) as int)"


def _first_round(prefix: DataFrame, lists: DataFrame, total: int, percent: int) -> DataFrame:
    rows = prefix.where("first").select("item", "doc_id", "key", "lone")
    groups = stash(rows.groupBy("item").agg(F.count("*").alias("m"), F.min(F.struct("lone", "doc_id", "key")).alias("typical")).where("m > 1"))
    rows = _keyed_join(rows, groups.select("item", "m"), "item", "m", total).select("item", F.expr(_block("m")).alias("i"), "doc_id", "key")
    more = groups.where(F.col("m") > BLOCK).select("item", F.explode(F.expr(f"sequence(0, cast((m - 1) div {BLOCK} as int))")).alias("i"), "typical.doc_id", "typical.key")
    members = rows.unionByName(more).distinct()
    whole = lists.select("doc_id", "key", "n", F.lit(0).alias("tail"), "items", "weights")
    return stash(_grouped(members.select("*", F.lit(0).alias("j"), F.lit(True).alias("stored"), F.lit(True).alias("asked"), F.col("doc_id").alias("label")), whole, group_links, "u long, v long", percent))


def _second_round(prefix: DataFrame, lists: DataFrame, groups: DataFrame, total: int, percent: int) -> DataFrame:
    labels = groups.select(F.col("node").alias("doc_id"), "component")
    rows = stash(prefix.join(labels, "doc_id", "left").select("item", "doc_id", "key", "short", F.coalesce("component", "doc_id").alias("label")))
    each = rows.groupBy("item", "label").agg(F.count("*").alias("n"), F.bool_or("short").alias("short"))
    kinds = each.groupBy("item").agg(F.sum("n").alias("m"), F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("main"), F.bool_or("short").alias("short"))
    kinds = stash(kinds.where("labels > 1 and short").select("item", "m", F.col("main.label").alias("main"), F.expr("m - main.n").alias("others")))
    rows = stash(_keyed_join(rows.drop("short"), kinds, "item", "m", total))
    whole = lists.select("doc_id", "key", "n", F.lit(0).alias("tail"), "items", "weights")
    one_block = lambda when: rows.where(when).select("item", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("stored"), F.lit(True).alias("asked"), "doc_id", "key", "label")
    large = rows.where(F.col("m") > BLOCK)
    every = lambda count: F.explode(F.expr(f"sequence(0, cast(({count} - 1) div {BLOCK} as int))"))
    stored = large.select("item", F.expr(_block("m")).alias("i"), every("others").alias("j"), F.lit(True).alias("stored"), F.lit(False).alias("asked"), "doc_id", "key", "label")
    asked = large.where("label <> main").select("item", every("m").alias("i"), F.expr(_block("others")).alias("j"), F.lit(False).alias("stored"), F.lit(True).alias("asked"), "doc_id", "key", "label")
    members = one_block((F.col("m") > SMALL) & (F.col("m") <= BLOCK)).unionByName(stored).unionByName(asked)
    links = stash(_grouped(members, whole, group_links, "u long, v long", percent))

    early = F.expr(f"cast(aggregate(weights, named_struct('at', n - aggregate(weights, 0L, (a, w) -> a + w), 'k', 0), (a, w) -> named_struct('at', a.at + w, 'k', a.k + if(a.at <= n - {need_sql('n', percent)}, 1, 0)), a -> a.k) as int)")
    cut = lists.withColumn("k", early).select("doc_id", "key", "n", F.expr("aggregate(slice(weights, k + 1, size(weights)), 0L, (a, w) -> a + w)").alias("tail"), F.expr("slice(items, 1, k)").alias("items"), F.expr("slice(weights, 1, k)").alias("weights"))
    pairs = stash(_grouped(one_block(F.col("m") <= SMALL), cut, group_candidates, _CANDIDATES, percent).distinct())
    return links.unionByName(_confirmed(pairs, lists, percent))


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Groups of documents whose shingle sets have 100 * intersection >= percent * union, directly or through others.

    docs(doc_id, text); A-Z are lower-cased, words end at ASCII white space. Returns a row per row of docs: doc_id, n_shingles,
    component_id (smallest doc_id of the group). A null or empty text and a null doc_id are linked with nothing
    (component_id is the doc_id); under `shingle` words the whole sequence is the one shingle. Repeated rows are
    one document for the links and stay as rows; a doc_id with several texts has the links of them all. Other columns are
    ignored; an empty table gives no rows.
    """
    docs = id_text(docs)
    signed = stash(docs.mapInArrow(_sign(shingle), "doc_id long, n long, key long, key2 long"))
    full = signed.where("n > 0 and doc_id is not null")
    rows = full.count()

    equal = stash(full.groupBy("key", "key2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"), F.count("*").alias("copies")).where("rep <> top").drop("top"))
    copies = _keyed_join(full.select("doc_id", "key", F.col("key2").alias("own2")), equal, "key", "copies", rows).where("own2 = key2 and doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))

    survivors = stash(_survivors(docs, full, shingle, percent))
    texts = _of_survivors(docs, survivors).join(survivors.select("doc_id", "key"), "doc_id").dropDuplicates(["doc_id", "key", "text"])
    sets = stash(texts.select("key", "text").mapInArrow(_sets(shingle), "key long, shingles binary"), compression="none")
    lists = _class_lists(sets, survivors, percent)
    prefix = stash(lists.mapInArrow(_prefix_rows(percent), _PREFIX))
    total = prefix.count()
    links = _first_round(prefix, lists, total, percent)
    links = links.unionAll(_second_round(prefix, lists, components(links), total, percent))
    groups = components(links.unionAll(copies)).withColumnRenamed("node", "doc_id")
    return signed.select("doc_id", F.col("n").alias("n_shingles")).join(groups, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
