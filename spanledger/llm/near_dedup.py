"""Near-duplicate groups by min-max hashing, banding and an exact check.

A document is the set of its distinct word shingles. Each of HASHES hash functions gives two signature
values, the least and the greatest image of the set, so that 2 * HASHES values cost HASHES evaluations; the
values agree between two sets with a probability equal to their Jaccard similarity. BANDS bands of ROWS values
make two sets at similarity 0.8 meet in a band except with probability (1 - 0.8^6)^42 = 3e-6.

Equal sets are first reduced to their smallest doc_id. In a band's bucket no pairs are made: each member is
compared with the bucket's centre only, first with the centre that it shares most bands with, then with the others
if it isn't in their component yet. Buckets of three or more documents that still hold several components may hide
links between members; there each is compared with the bucket's most typical document, and what is still apart goes
through a prefix-filtered join (a pair with similarity s must share one of the first n - ceil(s * n) + 1 shingles,
rarest first, and what follows the first common one must be enough), which finds all of them. All links are
confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, id_text, mix64, sequence_hash, slices, stash
from .components import components

HASHES, BANDS, ROWS = 126, 42, 6
SHINGLE, PERCENT = 5, 80

_rng = np.random.default_rng(77)
_FACTORS = _rng.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_MIXERS = _rng.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, sorted and distinct within each row, and the rows' bounds."""
    words = Words(texts)
    h, whole = words.shingles(k)
    rows = np.repeat(np.arange(words.n_rows), words.counts())
    counts = words.counts()
    for r in np.flatnonzero((counts > 0) & (counts < k)):  # the whole sequence is the one shingle
        at = words.bounds[r]
        h[at], whole[at] = sequence_hash(words.hash[at : words.bounds[r + 1]]), True
    h, rows = h[whole], rows[whole]
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[first], np.searchsorted(rows[first], np.arange(words.n_rows + 1))


def signatures(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets: two keys equal for equal sets, and a hash for each band."""
    with np.errstate(over="ignore"):
        at = bounds[:-1]
        keys = np.stack([np.add.reduceat(mix64(h ^ np.uint64(c)), at) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1)
        values = np.empty((len(at), 2 * HASHES), dtype=np.uint64)
        for p, factor in enumerate(_FACTORS):
            image = h * factor
            values[:, 2 * p] = np.minimum.reduceat(image, at)
            values[:, 2 * p + 1] = np.maximum.reduceat(image, at)
        banded = mix64(values).reshape(len(at), BANDS, ROWS) * _MIXERS[None]
        return keys, mix64(banded.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None])


_SIGNED = "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"


def _sign(k: int):
    def run(batches):
        for part in slices(batches):
            h, bounds = shingle_sets(part.column("text"), k)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            keys, bands = np.zeros((len(n), 2), dtype=np.int64), np.zeros((len(n), BANDS), dtype=np.int64)
            if len(full):
                own, banded = signatures(h, np.append(bounds[:-1][full], bounds[-1]))
                keys[full], bands[full] = own.view(np.int64), banded.view(np.int64)
            sizes = np.where(n > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(bands[full].ravel()))
            yield pa.record_batch([part.column("doc_id"), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], names=[x.split()[0] for x in _SIGNED.split(", ")])

    return run


def _sets(k: int):
    def run(batches):
        for part in slices(batches):
            h, bounds = shingle_sets(part.column("text"), k)
            yield pa.record_batch([part.column("doc_id"), pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            left, right = ([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(c)] for c in ("left", "right"))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], dtype=np.int64)
            either = np.array([len(x) + len(y) for x, y in zip(left, right)], dtype=np.int64) - both
            yield batch.select(["u", "v"]).filter(pa.array(100 * both >= percent * either))

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (u, v) whose full sets are alike enough."""
    sized = sets.withColumn("n", F.length("shingles"))
    left = sized.select(F.col("doc_id").alias("u"), F.col("shingles").alias("left"), F.col("n").alias("n_u"))
    right = sized.select(F.col("doc_id").alias("v"), F.col("shingles").alias("right"), F.col("n").alias("n_v"))
    near = pairs.join(sized.select(F.col("doc_id").alias("u"), F.col("n").alias("n_u")), "u").join(sized.select(F.col("doc_id").alias("v"), F.col("n").alias("n_v")), "v")
    near = near.where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")).select("u", "v")  # else the sizes forbid it
    return stash(near.join(left, "u").join(right, "v").select("u", "v", "left", "right").mapInArrow(_confirm(percent), "u long, v long"))


def _labelled(rows: DataFrame, groups: DataFrame, column: str, name: str) -> DataFrame:
    found = groups.select(F.col("node").alias(column), F.col("component").alias("_found"))
    return rows.join(found, column, "left").withColumn(name, F.coalesce("_found", column)).drop("_found")


def _unsettled(members: DataFrame, groups: DataFrame) -> DataFrame:
    """bucket, doc_id and label (component) in buckets of three or more documents that hold several components."""
    marked = _labelled(members.where("n > 2").select("bucket", "doc_id"), groups, "doc_id", "label")
    several = marked.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    return stash(marked.join(several, "bucket", "left_semi"))


def _prefixes(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, shingle, size, place: each document's prefix in the order of rareness, without what no other one holds."""

    def spread(batches):
        for batch in batches:
            for doc, x in zip(batch.column("doc_id"), batch.column("shingles")):
                own = np.frombuffer(x.as_buffer(), dtype=np.int64)
                yield pa.record_batch([pa.repeat(doc, len(own)), pa.array(own), pa.repeat(pa.scalar(len(own), pa.int32()), len(own))], names=["doc_id", "shingle", "size"])

    each = docs.join(sets, "doc_id").mapInArrow(spread, "doc_id long, shingle long, size int")
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    ranked = each.join(often, "shingle").withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("often", "shingle")))
    prefix = ranked.where((F.col("place") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1) & (F.col("often") > 1))
    return stash(prefix.select("doc_id", "shingle", "size", "place"))


def _can_link(percent: int) -> str:
    """What two sets hold from their first common shingle on (place_u, place_v or later) must be enough."""
    rest = "(least(size_u - place_u, size_v - place_v) + 1)"
    return f"100 * {rest} >= {percent} * (size_u + size_v - {rest})"


def _typical_pairs(unsettled: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """Each document with its bucket's most typical one, that with the fewest shingles that no other document holds."""
    first = prefix.groupBy("doc_id").agg(F.min("place").alias("place"), F.max("size").alias("size"))
    rows = stash(unsettled.join(first, "doc_id"))
    centre = rows.groupBy("bucket").agg(F.min(F.struct((F.col("place") / F.col("size")).alias("lone"), "doc_id", "label", "place", "size")).alias("c"))
    centre = centre.select("bucket", F.col("c.doc_id").alias("u"), F.col("c.label").alias("label_u"), F.col("c.place").alias("place_u"), F.col("c.size").alias("size_u"))
    rows = rows.select("bucket", F.col("doc_id").alias("v"), "label", F.col("place").alias("place_v"), F.col("size").alias("size_v"))
    return rows.join(centre, "bucket").where(f"label <> label_u and {_can_link(percent)}").select("u", "v").distinct()


def _hidden_pairs(unsettled: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components that could be linked, by a prefix-filtered join.

    The smaller set of a pair needs its common shingle in a prefix of n - ceil(2s / (1 + s) * n) + 1 only. A shingle whose
    holders are in one component by now, like those of a text that many documents hold, is left out before the join.
    """
    labels = unsettled.select("doc_id", "label").distinct()
    short = f"place <= size - ceil(size * {2 * percent} / {100 + percent}) + 1"
    rows = prefix.join(labels, "doc_id").withColumn("short", F.expr(short))
    apart = rows.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bool_or("short").alias("any")).where("lo <> hi and any").select("shingle")
    rows = stash(rows.join(apart, "shingle", "left_semi"))
    a, b = (rows.select("shingle", *[F.col(c).alias(f"{'id' if c == 'doc_id' else c}_{x}") for c in ("doc_id", "label", "size", "place", "short")]) for x in "uv")
    order = "(size_u < size_v or size_u = size_v and id_u < id_v) and short_u and label_u <> label_v"
    pairs = a.join(b, "shingle").where(f"{order} and 100 * size_u >= {percent} * size_v and {_can_link(percent)}")
    return pairs.select(F.least("id_u", "id_v").alias("u"), F.greatest("id_u", "id_v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Groups of documents whose shingle sets have 100 * intersection >= percent * union, directly or through others.

    docs(doc_id, text); A-Z are lower-cased, words end at ASCII white space. Returns a row per row of docs: doc_id,
    n_shingles, component_id (smallest doc_id of the group), kept (doc_id = component_id). A null or
    empty text and a null doc_id are linked with nothing (component_id is the doc_id, kept is true);
    under shingle words the whole sequence is the one shingle. Repeated rows are one document for
    the links and stay as rows; other columns are ignored; an empty table gives no rows.
    """
    docs = id_text(docs)
    signed = stash(docs.mapInArrow(_sign(shingle), _SIGNED))
    full = signed.where("n_shingles > 0 and doc_id is not null")

    equal = full.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).where("rep <> top").select("key1", "key2", "rep")
    copies = stash(full.select("doc_id", "key1", "key2").join(equal, ["key1", "key2"]).where("doc_id <> rep").select("doc_id", "rep"))

    banded = full.join(copies.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.explode("bands").alias("bucket"))
    centres = banded.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("top"), F.count("*").alias("n")).where("centre <> top")
    members = stash(banded.join(centres.select("bucket", "centre", "n"), "bucket").select("bucket", "doc_id", "centre", "n"))
    sets = stash(docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, shingles binary"))

    pairs = members.where("doc_id <> centre").groupBy(F.col("centre").alias("u"), F.col("doc_id").alias("v")).agg(F.count("*").alias("shared"))
    pairs = stash(pairs)
    first = pairs.groupBy("v").agg(F.max(F.struct("shared", -F.col("u"))).alias("best")).select((-F.col("best.col2")).alias("u"), "v")
    links = _linked(first, sets, percent)
    groups = components(links)

    rest = pairs.join(first, ["u", "v"], "left_anti")
    rest = _labelled(_labelled(rest, groups, "u", "label_u"), groups, "v", "label_v").where("label_u <> label_v").select("u", "v")
    links = links.unionAll(_linked(rest, sets, percent))
    groups = components(links)

    unsettled = _unsettled(members, groups)
    prefix = _prefixes(unsettled.select("doc_id").distinct(), sets, percent)
    links = links.unionAll(_linked(_typical_pairs(unsettled, prefix, percent), sets, percent))
    groups = components(links)
    links = links.unionAll(_linked(_hidden_pairs(_unsettled(members, groups), prefix, percent), sets, percent))
    edges = links.unionAll(copies.select(F.col("rep").alias("u"), F.col("doc_id").alias("v")))
    groups = components(edges)
    out = _labelled(signed.select("doc_id", "n_shingles"), groups, "doc_id", "component_id")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without the documents that near_duplicates() doesn't keep, with all columns.

    Null and empty texts and null doc_ids are linked with nothing and stay; repeated rows stay or go together; the smallest
    doc_id of a group stays; an empty table gives no rows.
    """
    gone = near_duplicates(docs, shingle, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
