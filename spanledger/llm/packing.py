"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut into full pieces, the first piece taking the remainder. Full
pieces are sequences by themselves. The others are dealt by a hash of their row into shards of about
SHARD pieces; a shard is one bin-packing problem, bounded in size whatever the input. Each shard has
ISLANDS populations in different rows (and so in different tasks). A generation crosses two solutions: the
best-filled bins of one are injected whole into the other, bins of the receiver that hold a document
twice are emptied, and the displaced pieces go back by best fit, largest first. Then the bins that
have room are filled anew, together with some full ones, each with the pieces that fill it best, and replace the old ones
where they are fewer. After each epoch every island sends its best solution to the next one. A solution with as few
bins as the sizes allow ends the search.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, stash
from .tokens import encoder, with_end

CAPACITY, END = 1024, 2
SHARD, ISLANDS, EPOCHS, POPULATION, CHILDREN = 16384, 3, 2, 4, 8
#: Bins that are filled anew at a time, about, and how often this is tried on a solution.
MIXED, TRIES = 512, 4

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_PIECES}, sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of docs(doc_id, text): doc_id, piece, start, length, ids_crc32. Every text ends with the end id."""

    def encode(batches):
        use = encoder(tokenizer)
        for part in slices(batches, limit=4 << 20):
            ids, bounds = with_end(*use(part.column("text")), end)
            little = ids.astype("<u4")
            rows = [(r, k, s, n, zlib.crc32(little[a + s : a + s + n])) for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) for k, (s, n) in enumerate(cut(b - a, capacity))]
            row, k, s, n, crc = zip(*rows)
            yield pa.record_batch([part.column("doc_id").take(pa.array(row)), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=[x.split()[0] for x in _PIECES.split(", ")])

    return id_text(docs).mapInArrow(encode, _PIECES)


class _BestFit:
    """Open bins by the room they have left."""

    def __init__(self, capacity: int):
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, bin_: int, room: int) -> None:
        self.at[room].append(bin_)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least room that is enough, and that room."""
        fits = self.mask >> size
        if not fits:
            return None
        room = size + (fits & -fits).bit_length() - 1
        bin_ = self.at[room].pop()
        if not self.at[room]:
            self.mask ^= 1 << room
        return bin_, room


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], rooms: list[int], capacity: int) -> None:
    """Add the items, in their order, to the bins."""
    open_ = _BestFit(capacity)
    for b, room in enumerate(rooms):
        open_.put(b, room)
    for i in items:
        size = sizes[i]
        got = open_.take(size)
        if got is None:
            bins.append([i])
            rooms.append(capacity - size)
            open_.put(len(bins) - 1, rooms[-1])
        else:
            b, room = got
            bins[b].append(i)
            rooms[b] = room - size
            open_.put(b, room - size)


def fitness(rooms: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean square of the fill)."""
    fills = [(1 - r / capacity) ** 2 for r in range(capacity + 1)]
    return -len(rooms), sum(map(fills.__getitem__, rooms)) / max(1, len(rooms))


def cross(sizes, giver, taker, capacity: int, rng) -> tuple[list[list[int]], list[int]]:
    """Inject some of the giver's fullest bins into the taker."""
    bins, rooms = giver
    order = sorted(range(len(bins)), key=lambda b: (rooms[b], b))
    some = max(1, len(order) // 3)
    chosen = [order[int(x)] for x in np.unique(rng.integers(0, some, max(1, some // 2)))]
    inside = {i for b in chosen for i in bins[b]}
    out, left, displaced = [list(bins[b]) for b in chosen], [rooms[b] for b in chosen], []
    for b, own in enumerate(taker[0]):
        if inside.isdisjoint(own):
            out.append(list(own))
            left.append(taker[1][b])
        else:
            displaced += [i for i in own if i not in inside]
    best_fit(sizes, sorted(displaced, key=lambda i: (-sizes[i], i)), out, left, capacity)
    return out, left


def fullest(below: list[int], capacity: int) -> list[int]:
    """Of pieces with sizes -below, largest first: the places of the first and of those that fill a bin best with it, the last one first.

    Larger ones are preferred to smaller ones.
    """
    room = capacity + below[0]
    first = max(1, bisect.bisect_left(below, -room))
    left = 1 << room  # bit r: some of the pieces so far leave a room of r
    seen = [left]
    for k in range(first, len(below)):
        if left & 1:
            break
        left |= left >> -below[k]
        seen.append(left)
    least, out, last = left & -left, [], len(seen)
    while True:  # a bit that is set stays set, so the piece that set it is found by halving
        k = bisect.bisect_left(seen, True, 0, last, key=lambda bits: bits & least != 0)
        if not k:
            return [*out, 0]
        out.append(first + k - 1)
        least <<= -below[first + k - 1]
        last = k


def relieve(sizes: list[int], solution: tuple[list[list[int]], list[int]], capacity: int, least: int, rng) -> tuple[list[list[int]], list[int]]:
    """The solution with fewer bins where the bins that have room, with some full ones, can be filled anew with one bin less."""
    for _ in range(TRIES):
        bins, rooms = solution
        if len(bins) <= least:
            break
        open_ = [b for b, room in enumerate(rooms) if room]
        if len(open_) > MIXED:
            open_ = sorted(open_, key=lambda b: (-rooms[b], b))[: MIXED // 2] + rng.choice(open_, MIXED // 2, replace=False).tolist()
        chosen = {*open_, *rng.integers(0, len(bins), MIXED).tolist()}
        items = sorted((i for b in chosen for i in bins[b]), key=lambda i: (-sizes[i], i))
        below = [-sizes[i] for i in items]
        made: list[list[int]] = []
        spare = (len(chosen) - 1) * capacity + sum(below)  # room that one bin less leaves in all of them
        while items and len(made) < len(chosen) and spare >= 0:
            places = fullest(below, capacity)
            made.append([items[k] for k in places])
            spare -= capacity + sum(below[k] for k in places)
            for k in places:
                del items[k], below[k]
        if not items and len(made) < len(chosen):
            kept = [b for b in range(len(bins)) if b not in chosen]
            solution = [bins[b] for b in kept] + made, [rooms[b] for b in kept] + [capacity - sum(sizes[i] for i in x) for x in made]
    return solution


def _solution(sizes: np.ndarray, assigned: bytes, capacity: int) -> tuple[list[list[int]], list[int]]:
    of = np.frombuffer(assigned, dtype="<i4")
    bins: list[list[int]] = [[] for _ in range(int(of.max()) + 1)]
    for i, b in enumerate(of.tolist()):
        bins[b].append(i)
    return bins, (capacity - np.bincount(of, sizes, len(bins)).astype(np.int64)).tolist()


def _assigned(bins: list[list[int]]) -> bytes:
    out = np.zeros(sum(map(len, bins)), dtype="<i4")
    for b, own in enumerate(bins):
        out[own] = b
    return out.tobytes()


def evolve(sizes: np.ndarray, population: list[bytes], seed: tuple[int, ...], capacity: int) -> list[bytes]:
    """An epoch on one island: POPULATION solutions, the best first. An optimal one ends it early."""
    rng, plain = np.random.default_rng(seed), sizes.tolist()
    least = -(-int(sizes.sum()) // capacity)
    now = [_solution(sizes, x, capacity) for x in population]
    for start in range(POPULATION - len(now)):
        key = sizes * (1 if not start and not population else rng.uniform(0.9, 1.1, len(sizes)))
        bins: list[list[int]] = []
        rooms: list[int] = []
        best_fit(plain, np.argsort(-key, kind="stable").tolist(), bins, rooms, capacity)
        now.append(relieve(plain, (bins, rooms), capacity, least, rng))
        if len(now[-1][0]) == least:
            break
    ranked = sorted(((fitness(s[1], capacity), s) for s in now), key=lambda x: x[0], reverse=True)
    ranks, now = [r for r, _ in ranked], [s for _, s in ranked]
    for _ in range(CHILDREN):
        if len(now[0][0]) == least or len(now) < 2:
            break
        a, b = rng.choice(len(now), 2, replace=False)
        child = relieve(plain, cross(plain, now[a], now[b], capacity, rng), capacity, least, rng)
        rank = fitness(child[1], capacity)
        if rank > ranks[-1]:
            at = bisect.bisect_right([(-n, -fill) for n, fill in ranks[:-1]], (-rank[0], -rank[1]))
            ranks[-1:], now[-1:] = [], []
            ranks.insert(at, rank)
            now.insert(at, child)
    return [_assigned(s[0]) for s in now[:POPULATION]]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pack docs(doc_id, text) into sequences of at most capacity ids.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the end
    id alone, null doc_ids and repeated rows are packed like others, other columns are ignored, an empty
    table gives no rows. Ties are broken by seeded draws and positions.
    """
    spark = docs.sparkSession
    made = stash(pieces(docs, tokenizer, capacity, end).withColumn("row", F.monotonically_increasing_id()))
    short = made.where(F.col("length") < capacity)
    shards = max(1, -(-short.count() // SHARD))
    fields = ["length", "row", "doc_id", "piece", "start", "ids_crc32"]
    problems = stash(
        short.groupBy(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct(*fields)), asc=False).alias("items"))
    )

    def epoch(number):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    sizes = np.array(row["sizes"], dtype=np.int64)
                    best = evolve(sizes, row["population"] or [], (row["shard"], row["island"], number), capacity)
                    score = fitness(_solution(sizes, best[0], capacity)[1], capacity)
                    yield pa.RecordBatch.from_pylist([{"shard": row["shard"], "island": row["island"], "sizes": row["sizes"], "population": best, "bins": -score[0], "fill": score[1]}], schema=made_schema)

        return run

    state = "shard long, island int, sizes array<int>, population array<binary>, bins int, fill double"
    made_schema = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int32())), ("population", pa.list_(pa.binary())), ("bins", pa.int32()), ("fill", pa.float64())])
    islands = problems.select("shard", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), F.transform("items", lambda x: x["length"].cast("int")).alias("sizes"), F.lit(None).cast("array<binary>").alias("population"))
    for number in range(EPOCHS):
        spread = islands.repartition(max(1, min(shards * ISLANDS, int(spark.conf.get("spark.sql.shuffle.partitions")))), "shard", "island")
        islands = stash(spread.mapInArrow(epoch(number), state))
        if number < EPOCHS - 1:  # the best solution of each island moves to the next one
            elite = islands.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].alias("elite"))
            islands = islands.join(elite, ["shard", "island"]).select("shard", "island", "sizes", F.array_distinct(F.array_append(F.slice("population", 1, POPULATION - 1), F.col("elite"))).alias("population"))
    best = islands.groupBy("shard").agg(F.min_by(F.col("population")[0], F.struct("bins", -F.col("fill"), "island")).alias("best"))

    def place(batches):
        for batch in batches:
            for row in batch.to_pylist():
                of = np.frombuffer(row["best"], dtype="<i4").tolist()
                used = [0] * (max(of) + 1)
                out = []
                for x, b in zip(row["items"], of):
                    out.append({**{k: x[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": row["shard"] * 2**20 + b, "offset": used[b]})
                    used[b] += x["length"]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset"))]))

    full = made.where(F.col("length") == capacity).select(*[x.split()[0] for x in _PIECES.split(", ")], (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(problems.join(best, "shard").mapInArrow(place, _PACKED))
