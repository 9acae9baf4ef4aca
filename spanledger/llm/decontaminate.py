"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Every item of the benchmark has a 128-bit SimHash of its five-word shingles. A document is read as
all windows of an item's length in words; a window whose fingerprint lies within RADIUS bits of an
item's is a candidate. Fingerprints are cut into eight 16-bit blocks: two that differ in at most
31 = 8 * 3 + 7 bits differ in at most 3 bits of some block, so the tables below, which hold each item
under all block values 1 bit away and are asked for all values 2 bits away from the window's, find
every fingerprint within the radius. The weighted Jaccard similarity of the shingle multisets (sum
of minima over sum of maxima) then decides. At similarity 0.8 the angle between the multisets is
0.475, so 19.4 differing bits are expected with a deviation of 4.1: the radius is 2.9 deviations off.

Windows in which too few shingles occur in any item to reach the similarity are passed over before
they are fingerprinted; this loses nothing, as the exact check would reject them.

The documents are never shuffled: each task holds one block of the benchmark (at most BLOCK_ITEMS items
and BLOCK_CHARS characters, sent by broadcast), and a larger benchmark takes one pass per block.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, id_text, sequence_hash, slices

RADIUS, BITS, BLOCKS = 31, 128, 8
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
SHINGLE, SIMILARITY = 5, 0.8
#: words whose bit sums are held at a time
_STEP = 1 << 14

_ONE = np.array([0] + [1 << i for i in range(16)], dtype=np.uint16)
_TWO = np.array(sorted({a ^ b for a in _ONE.tolist() for b in _ONE.tolist()}), dtype=np.uint16)


def _signs(h: np.ndarray) -> np.ndarray:
    """For each shingle hash its 128 bits as -1 or 1."""
    with np.errstate(over="ignore"):
        both = np.stack([h, (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)], axis=1)
    both[:, 1] ^= both[:, 1] >> np.uint64(32)
    return np.unpackbits(both.view(np.uint8).reshape(len(h), 16), axis=1).astype(np.int8) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint16).reshape(len(sums), BLOCKS)


class ItemIndex:
    """Fingerprints, shingle multisets and Hamming block tables of one block of items."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, similarity: float):
        words = Words(pa.array([t for _, t in items], pa.large_string()))
        self.shingle, self.similarity = shingle, similarity
        self.ids, self.n_words, self.bags, prints = [], [], [], []
        for r, (item, _) in enumerate(items):
            own = words.hash[words.bounds[r] : words.bounds[r + 1]]
            if not len(own):
                continue
            k = min(shingle, len(own))
            h = np.array([sequence_hash(own[i : i + k]) for i in range(len(own) - k + 1)], dtype=np.uint64)
            self.ids.append(item)
            self.n_words.append(len(own))
            self.bags.append(Counter(h.tolist()))
            prints.append(_fingerprints(_signs(h).sum(axis=0, dtype=np.int32)[None, :])[0])
        self.prints = np.array(prints, dtype=np.uint16).reshape(len(prints), BLOCKS)
        self.lengths = np.unique(np.array(self.n_words, dtype=np.int64))
        self.known = {}  # by shingle length, the sorted shingles of the items that are cut so
        for k in {min(shingle, int(n)) for n in self.lengths}:
            own = [x for b, n in zip(self.bags, self.n_words) if min(shingle, n) == k for x in b]
            self.known[k] = np.unique(np.array(own, dtype=np.uint64))
        self.tables = []
        for b in range(BLOCKS):
            keys = (self.prints[:, b][:, None] ^ _ONE[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            self.tables.append((np.searchsorted(keys[order], np.arange(65537)), (order // len(_ONE)).astype(np.int32)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item) with at most RADIUS differing bits."""
        found = []
        for b, (at, items) in enumerate(self.tables):
            keys = (prints[:, b][:, None] ^ _TWO[None, :]).astype(np.int64)
            n = at[keys + 1] - at[keys]
            window, probe = np.nonzero(n)
            n, first = n[window, probe], at[keys[window, probe]]
            each = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, dtype=np.int64)
            found.append(np.repeat(window, n) * len(self.ids) + items[each])
        window, item = np.divmod(np.unique(np.concatenate(found)), max(1, len(self.ids)))
        apart = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1)
        return window[apart <= RADIUS], item[apart <= RADIUS]

    def similar(self, item: int, window: np.ndarray) -> float:
        bag, own = self.bags[item], Counter(window.tolist())
        both = sum(min(n, own[x]) for x, n in bag.items() if x in own)
        return both / (sum(bag.values()) + len(window) - both)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x in sorted_values; a bit table answers for most."""
    table = np.zeros(1 << 20, dtype=bool)
    table[(sorted_values & np.uint64(0xFFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(x & np.uint64(0xFFFFF)).astype(np.int64)])
    out = np.zeros(len(x), dtype=bool)
    if len(maybe) and len(sorted_values):
        at = np.minimum(np.searchsorted(sorted_values, x[maybe]), len(sorted_values) - 1)
        out[maybe] = sorted_values[at] == x[maybe]
    return out


def _matches(texts: pa.Array, index: ItemIndex):
    """(row, item, similarity, first word, words) for the best window of each row and item that are alike enough."""
    words, best, memo = Words(texts), {}, {}
    counts = words.counts()
    for k, known in index.known.items():
        h, whole = words.shingles(k)
        hit = _member(known, h) & whole
        lengths = [int(m) for m in index.lengths if min(index.shingle, int(m)) == k]
        # J >= s needs s / (1 + s) * (window + item) shingles in common
        share = index.similarity / (1 + index.similarity)
        total = np.concatenate(([0], np.cumsum(hit)))
        per_row = total[words.bounds[1:]] - total[words.bounds[:-1]]
        for r in np.flatnonzero(per_row >= max(1, share * (min(lengths) - k + 1))):
            lo, n = int(words.bounds[r]), int(counts[r])
            own, mine = h[lo : lo + n - k + 1], total[lo : lo + n - k + 2]
            starts, sizes = [], []
            for m in lengths:
                size = min(m, n) - k + 1  # shingles of a window
                if size < index.similarity * (m - k + 1):
                    continue
                inside = mine[size:] - mine[:-size]
                at = np.flatnonzero(inside >= share * (size + m - k + 1) - 1e-9)
                starts.append(at)
                sizes.append(np.full(len(at), size))
            if not starts or not sum(map(len, starts)):
                continue
            start, size = np.concatenate(starts), np.concatenate(sizes)
            order = np.argsort(start, kind="stable")
            start, size = start[order], size[order]
            for a in range(0, len(start), 2048):
                s, z = start[a : a + 2048], size[a : a + 2048]
                for window, item in _candidates(own, s, z, index):
                    w = own[s[window] : s[window] + z[window]]
                    key = (item, w.tobytes())
                    if key not in memo:
                        if len(memo) > 50_000:
                            memo.clear()
                        memo[key] = index.similar(item, w) if min(index.shingle, index.n_words[item]) == k else 0.0
                    if memo[key] >= index.similarity:
                        value = (-memo[key], int(s[window]), int(z[window]) + k - 1)
                        if value < best.get((r, item), (1, 0, 0)):
                            best[r, item] = value
    return [(int(r), index.ids[i], -v[0], v[1], v[2]) for (r, i), v in sorted(best.items())]


def _candidates(h: np.ndarray, start: np.ndarray, size: np.ndarray, index: ItemIndex):
    """Pairs (window, item) within the radius; the windows are sorted by their starts."""
    a = 0
    while a < len(start):
        b = int(np.searchsorted(start, start[a] + _STEP, side="right"))
        base, top = int(start[a]), int((start[a:b] + size[a:b]).max())
        sums = np.zeros((top - base + 1, BITS), dtype=np.int32)
        np.cumsum(_signs(h[base:top]), axis=0, dtype=np.int32, out=sums[1:])
        window, item = index.near(_fingerprints(sums[start[a:b] - base + size[a:b]] - sums[start[a:b] - base]))
        yield from zip((window + a).tolist(), item.tolist())
        a = b


def _item_blocks(benchmark: DataFrame, shingle: int, similarity: float):
    """One broadcast index at a time; each is bounded in items and characters."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    n, chars = items.select(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        index = ItemIndex([(r[0], r[1]) for r in rows], shingle, similarity)
        if index.ids:
            yield benchmark.sparkSession.sparkContext.broadcast(index)


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Documents that hold a passage like a benchmark item.

    docs(doc_id, text), benchmark(item_id, text). Returns one row per document row and item found:
    doc_id, item_id, similarity (weighted Jaccard of the best window, A-Z lower-cased), start_word, n_words.
    Null or empty texts and items match nothing; items under five words count as one shingle; a document
    shorter than an item is one window; of equal windows the first is given; repeated rows repeat; other
    columns are ignored; an empty table on either side gives no rows.
    """
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _item_blocks(benchmark, shingle, similarity):

        def find(batches, shared=shared):
            for part in slices(batches):
                found = _matches(part.column("text"), shared.value)
                if found:
                    rows, items, value, start, n = zip(*found)
                    yield pa.record_batch([part.column("doc_id").take(pa.array(rows)), pa.array(items, pa.int64()), pa.array(value, pa.float64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

        out = out.unionAll(id_text(docs).mapInArrow(find, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows in which leaks() finds an item; all columns stay as they are.

    Null, empty and short texts hold no item and stay, null doc_ids are handled like others, repeated rows stay or go
    together; without items or rows nothing goes.
    """
    for shared in _item_blocks(benchmark, shingle, similarity):

        def keep(batches, shared=shared):
            for part in slices(batches):
                bad = {m[0] for m in _matches(part.column("text"), shared.value)}
                yield part if not bad else part.filter(pa.array([r not in bad for r in range(part.num_rows)]))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
