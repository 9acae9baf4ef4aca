"""Line dedup with two Bloom filters, for hashes seen once and seen twice.

A first pass over the texts sends only 64-bit hashes of the lines' keys to the filters (see blooms.py), which
give the suspects.
The second pass tests every line against the suspects: only suspected lines shuffle, with their whole keys,
which are counted exactly and get their first document. The third pass drops the other lines.

The suspects reach the tasks as a Bloom filter and the confirmed keys as hashes with their first doc_id
while each is under BROADCAST_BYTES, by count; beyond that the same two steps are joins. Every line with a confirmed
key's hash has been compared by its key before, so the few hashes that two keys share are known; lines with
one of these are told apart by the keys themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blooms import BROADCAST_BYTES, as_filter, repeated_hashes
from .common import _IS_SPACE, WHITE_SPACE, id_text, slices, span_hashes, stash, utf8

MIN_CHARS = 10
WHITE = "".join(map(chr, WHITE_SPACE))
#: Bits of a line's hash; fewer only make the tests meet hashes that keys share.
BITS = 64
#: Column that brings a document's hashes to drop where they are joined.
DROPPED = "_hashes_of_dropped_lines"


class Lines:
    """The lines of some texts: row, byte span, key span, key hash and whether the key is long enough."""

    def __init__(self, texts: pa.Array, min_chars: int, bits: int = 64):
        self.data, self.offsets = data, offsets = utf8(texts)
        n = len(data)
        breaks = np.flatnonzero(data == 10)
        row_of_break = np.searchsorted(offsets[1:], breaks, side="right")
        self.per_row = np.bincount(row_of_break, minlength=len(offsets) - 1) + 1
        self.bounds = np.concatenate(([0], np.cumsum(self.per_row)))
        self.rows = np.repeat(np.arange(len(offsets) - 1), self.per_row)
        first = np.zeros(len(self.rows), dtype=bool)
        first[self.bounds[:-1]] = True
        last = np.zeros(len(self.rows), dtype=bool)
        last[self.bounds[1:] - 1] = True
        self.start, self.end = np.empty(len(self.rows), dtype=np.int64), np.empty(len(self.rows), dtype=np.int64)
        self.start[first], self.start[~first] = offsets[:-1], breaks + 1
        self.end[last], self.end[~last] = offsets[1:], breaks
        solid = np.flatnonzero(~_IS_SPACE[data])
        lo, hi = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        some = lo < hi
        self.key_start, self.key_end = self.start.copy(), self.start.copy()
        self.key_start[some], self.key_end[some] = solid[lo[some]], solid[hi[some] - 1] + 1
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64))) if n else np.zeros(1, dtype=np.int64)
        self.long = points[self.key_end] - points[self.key_start] >= min_chars
        self.hash = span_hashes(data, self.key_start, self.key_end) >> np.uint64(64 - bits)

    def key(self, i: int) -> str:
        return self.data[self.key_start[i] : self.key_end[i]].tobytes().lower().decode()

    def line(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def _hashed(min_chars: int, bits: int):
    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lines = Lines(texts, min_chars, bits)
        return lines.hash[lines.long], lines.rows[lines.long]

    return run


def _keys(test, min_chars: int, bits: int):
    """doc_id, hash and key of the lines that may be repeats, each key once a row."""

    def run(batches):
        for part in slices(batches):
            lines = Lines(part.column("text"), min_chars, bits)
            maybe = np.flatnonzero(lines.long)
            if test is not None:
                maybe = maybe[test.value.has(lines.hash[maybe])]
            each = dict.fromkeys(zip(lines.rows[maybe].tolist(), lines.hash[maybe].view(np.int64).tolist(), map(lines.key, maybe)))
            if each:
                rows, h, keys = zip(*each)
                yield pa.record_batch([part.column("doc_id").take(pa.array(rows)), pa.array(h), pa.array(keys, pa.string())], names=["doc_id", "hash", "key"])

    return run


def _drops(keys: DataFrame, confirmed: DataFrame, broadcast_bytes: int) -> DataFrame:
    """keys(doc_id, hash) with `first` of the confirmed(hash, first, held) hashes, without a hash's rows in one task.

    A hash is hot if it is held so often that no more such ones than fit the broadcast can be among all rows: these are
    sent to the tasks. The others are joined by a shuffle, with at most `bound` rows of one hash.
    """
    bound = -(-16 * (confirmed.agg(F.sum("held")).first()[0] or 0) // broadcast_bytes) if broadcast_bytes else None
    if not bound:
        return keys.join(confirmed.select("hash", "first"), "hash")
    hot = confirmed.where(F.col("held") > bound).select("hash", "first")
    rows = stash(keys.join(F.broadcast(hot.withColumnRenamed("first", "_hot")), "hash", "left"))
    cold = rows.where("_hot is null").drop("_hot").join(confirmed.where(F.col("held") <= bound).select("hash", "first"), "hash")
    return rows.where("_hot is not null").withColumnRenamed("_hot", "first").unionByName(cold)


def _removal(docs: DataFrame, min_chars: int, broadcast_bytes: int, bits: int):
    """(rows to read, function from a record batch and its lines to the mask of lines that stay)."""
    spark = docs.sparkSession
    texts = id_text(docs)
    suspects = repeated_hashes(texts, _hashed(min_chars, bits))
    test = as_filter(suspects, broadcast_bytes)
    keys = texts.mapInArrow(_keys(test, min_chars, bits), "doc_id long, hash long, key string")
    if test is None:
        keys = keys.join(suspects, "hash", "left_semi")
    keys = keys.where("doc_id is not null")
    each = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("hash").alias("hash"), F.count("*").alias("held"))
    by_hash = each.groupBy("hash").agg(F.count("*").alias("n"), F.bool_or(F.col("first") < F.col("last")).alias("hit"), F.min("first").alias("first"), F.sum("held").alias("held"))
    by_hash = stash(by_hash.where("hit").select("hash", "n", "first", "held"))
    confirmed = by_hash.where("n = 1")
    # keys that share a hash: none is to be expected among 2^64
    shared = stash(each.join(by_hash.where("n > 1").select("hash"), "hash", "left_semi").where("first < last").select("hash", "key", "first")) if not by_hash.where("n > 1").isEmpty() else None
    by_key = {r["key"]: r["first"] for r in shared.toLocalIterator()} if shared else {}
    clashing = np.array(sorted({r["hash"] for r in shared.select("hash").toLocalIterator()}) if shared else [], dtype=np.int64).view(np.uint64)

    def ids(part, lines):
        """doc_id of each line, and whether there is one."""
        doc = part.column("doc_id").cast(pa.int64())
        return doc.fill_null(0).to_numpy()[lines.rows], doc.is_valid().to_numpy(zero_copy_only=False)[lines.rows]

    def told_apart(out, part, lines):
        if len(clashing):
            own, known = ids(part, lines)
            for i in np.flatnonzero(lines.long & known & np.isin(lines.hash, clashing)):
                out[i] &= by_key.get(lines.key(i), own[i]) == own[i]
        return out

    if confirmed.count() * 16 <= broadcast_bytes:
        table = confirmed.select("hash", "first").toArrow()
        h, first = table.column("hash").to_numpy().view(np.uint64), table.column("first").to_numpy()
        order = np.argsort(h)
        sent = spark.sparkContext.broadcast((h[order], first[order]))

        def stays(part, lines):
            h, first = sent.value
            out = np.ones(len(lines.rows), dtype=bool)
            if len(h):
                at = np.minimum(np.searchsorted(h, lines.hash), len(h) - 1)
                own, known = ids(part, lines)
                out = ~(lines.long & (h[at] == lines.hash) & (first[at] != own) & known)
            return told_apart(out, part, lines)

        return docs, stays
    drops = _drops(keys.select("doc_id", "hash"), confirmed, broadcast_bytes).where("doc_id <> first").groupBy("doc_id").agg(F.collect_set("hash").alias(DROPPED))
    given = [c for c in docs.columns if c.lower() != DROPPED.lower()]
    if len(given) < len(docs.columns):
        raise ValueError(f"rename the column {DROPPED}")

    def stays_joined(part, lines):
        out = np.ones(len(lines.rows), dtype=bool)
        for r, gone in enumerate(part.column(DROPPED).to_pylist()):
            if gone:
                own = slice(lines.bounds[r], lines.bounds[r + 1])
                out[own] = ~(lines.long[own] & np.isin(lines.hash[own].view(np.int64), np.array(gone, dtype=np.int64)))
        return told_apart(out, part, lines)

    return docs.join(drops, "doc_id", "left"), stays_joined


def _kept_text(lines: Lines, stays: np.ndarray, r: int) -> bytes:
    own = range(lines.bounds[r], lines.bounds[r + 1])
    return b"\n".join(lines.line(i) for i in own if stays[i])


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES, bits: int = BITS) -> DataFrame:
    """What line dedup leaves of each row of docs(doc_id, text): doc_id, n_lines, n_dropped, kept_sha256.

    Lines end at \\n; a key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at
    least min_chars code points that two doc_ids hold stay only in the smallest doc_id, there every time.
    A null or empty text is one empty line. Rows with a null doc_id keep all lines and count for none; rows with one
    doc_id are one document. Other columns are ignored; an empty table gives no rows.
    """
    rows, stays = _removal(id_text(docs), min_chars, broadcast_bytes, bits)

    def digest(batches):
        for part in slices(batches):
            lines = Lines(part.column("text"), min_chars, bits)
            mask = stays(part, lines)
            dropped = np.bincount(lines.rows[~mask], minlength=part.num_rows)
            whole = [_kept_text(lines, mask, r) if dropped[r] else lines.data[lines.offsets[r] : lines.offsets[r + 1]].tobytes() for r in range(part.num_rows)]
            yield pa.record_batch([part.column("doc_id"), pa.array(lines.per_row.astype(np.int64)), pa.array(dropped.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in whole])], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return rows.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES, bits: int = BITS, emptied: bool = True) -> DataFrame:
    """docs with the text that line dedup leaves; n_chars, where there is such a column, follows.

    Keys, nulls, ties and repeated rows as for line_digests(): a null or empty text and a row with a null doc_id stay as
    they are, repeated rows lose the same lines. A text that is left without a word is as the lines make it; the row stays
    unless `emptied` is False: then a document goes if it had words and all of them stand in others. All columns
    stay, in their order; a column named DROPPED is refused where it would clash. An empty table gives no rows.
    """
    rows, stays = _removal(docs, min_chars, broadcast_bytes, bits)
    schema = docs.schema

    def rewrite(batches):
        for part in slices(batches):
            lines = Lines(part.column("text"), min_chars, bits)
            mask = stays(part, lines)
            dropped = np.bincount(lines.rows[~mask], minlength=part.num_rows)
            columns = {f.name: part.column(f.name) for f in part.schema if f.name in schema.names}
            stay = np.ones(part.num_rows, dtype=bool)
            if dropped.any():
                texts = part.column("text").to_pylist()
                for r in np.flatnonzero(dropped):
                    texts[r] = _kept_text(lines, mask, r).decode()
                    stay[r] = emptied or bool(texts[r].strip(WHITE))
                columns["text"] = pa.array(texts, part.column("text").type)
                if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
                    columns["n_chars"] = pa.array([len(t) if d else n for t, d, n in zip(texts, dropped, columns["n_chars"].to_pylist())], columns["n_chars"].type)
            yield pa.record_batch([columns[c] for c in schema.names], names=schema.names).filter(pa.array(stay))

    return rows.mapInArrow(rewrite, schema)
