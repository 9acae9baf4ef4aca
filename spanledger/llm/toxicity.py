"""Toxicity by multiple-instance learning: sentences get scores, noisy-or combines them, document labels train them.

A document is toxic with probability 1 - prod(1 - p) over its sentences' p = sigmoid(bias + sum of word weights).
Only document labels are known; the gradient of the noisy-or shares the blame among the sentences, and an L1 penalty
leaves weights on few words. The model is fitted on at most SAMPLE labelled documents, chosen by a hash of their
doc_id; it holds weights of words found in MIN_DOCS sample documents or more, so its size is bounded too. Everything
else, scores and the sentences that give them, covers all documents in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, slices, span_hashes, utf8

SAMPLE, MIN_DOCS, ROUNDS, RATE, PENALTY = 6_000, 5, 250, 0.1, 0.3
THRESHOLD = 0.5
#: Code points of the sample's texts at most.
SAMPLE_CHARS = 64_000_000

_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _WORD[_lo:_hi] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 33, 46, 63]] = True  # line end, ! . ?


class Sentences:
    """Words (letters and digits, A-Z lower-cased, hashed) of some texts by sentence, and the sentences' byte spans and rows."""

    def __init__(self, texts: pa.Array):
        data, self.offsets = utf8(texts)
        self.data = data
        inside = _WORD[data]
        filled = self.offsets[:-1] < self.offsets[1:]
        before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[self.offsets[:-1][filled]] = False
        after[self.offsets[1:][filled] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.word = span_hashes(data, starts, ends)
        # a sentence ends behind a stop or at the end of its text
        cuts = np.unique(np.concatenate((np.flatnonzero(_STOP[data]) + 1, self.offsets[1:])))
        number = np.searchsorted(cuts, starts, side="right")
        first = np.flatnonzero(np.diff(number, prepend=-1))
        self.bounds = np.append(first, len(starts))  # words of each sentence that has any
        self.start, self.end = starts[first], cuts[number[first]]
        self.row = np.searchsorted(self.offsets[1:], self.start, side="right")
        self.row_bounds = np.searchsorted(self.row, np.arange(len(self.offsets)))

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each sentence in code points of its text."""
        at = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80, dtype=np.int64)))
        base = at[self.offsets[self.row]]
        return at[self.start] - base, at[self.end] - base


class Model:
    """Weights of some words, sorted by their hashes, and the bias."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights.astype(np.float64), bias
        self._maybe = np.zeros(1 << 16, dtype=bool)
        self._maybe[(words & np.uint64(0xFFFF)).astype(np.int64)] = True

    def logits(self, sentences: Sentences) -> np.ndarray:
        n = len(sentences.bounds) - 1
        total = np.full(n, self.bias)
        if n and len(self.words):
            at = np.flatnonzero(self._maybe[(sentences.word & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.words, sentences.word[at]), len(self.words) - 1)
            hit = self.words[place] == sentences.word[at]
            of = np.searchsorted(sentences.bounds, at[hit], side="right") - 1
            # a word counts once in a sentence
            pair = np.unique(np.stack([of, place[hit]], axis=1), axis=0)
            np.add.at(total, pair[:, 0], self.weights[pair[:, 1]])
        return total


def _log_clean(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z))"""
    return -np.logaddexp(0, z)


def train(labels: np.ndarray, docs: np.ndarray, sentences: np.ndarray, flat: np.ndarray, weights: np.ndarray | None = None, min_docs: int = MIN_DOCS, rounds: int = ROUNDS) -> Model:
    """Fit by proximal Adam; without both labels the model is silent.

    flat holds the word hashes, distinct within a sentence; sentence i has flat[sentences[i]:sentences[i + 1]], document
    d the sentences from docs[d] to docs[d + 1], at least one. Weights make up for how the documents were chosen.
    """
    labels = labels.astype(np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -30.0 if not len(labels) or not labels.max() else 30.0)
    doc = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(docs))
    sentence = np.repeat(np.arange(len(doc), dtype=np.int32), np.diff(sentences))
    order = np.lexsort((doc[sentence], flat))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(flat[order].view(np.int64)) != 0) | (np.diff(doc[sentence[order]]) != 0)
    words, often = np.unique(flat[order[new]], return_counts=True)
    words = words[often >= min_docs]
    del order, new
    place = np.minimum(np.searchsorted(words, flat), max(0, len(words) - 1)).astype(np.int32)
    known = words[place] == flat if len(words) else np.zeros(len(flat), dtype=bool)
    place, sentence = place[known], sentence[known]
    share = np.ones(len(labels)) if weights is None else weights
    share = (share / share.sum())[doc]
    w, bias = np.zeros(len(words)), -5.0
    m, v, mb, vb = np.zeros(len(words)), np.zeros(len(words)), 0.0, 0.0
    y = labels[doc]
    for t in range(1, rounds + 1):
        z = bias + np.bincount(sentence, weights=w[place], minlength=len(doc))
        clean = np.add.reduceat(_log_clean(z), docs[:-1])  # log probability that no sentence is toxic
        toxic = -np.expm1(np.minimum(clean, -1e-12))
        p = 1 / (1 + np.exp(-z))
        g = np.where(y > 0, -p * (np.exp(clean) / toxic)[doc], p) * share
        gw, gb = np.bincount(place, weights=g[sentence], minlength=len(words)), g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        scale = RATE / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        w -= scale * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(0, np.abs(w) - scale * PENALTY / len(labels))
        bias -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-6)
    used = np.abs(w) > 1e-3
    return Model(words[used], w[used], float(bias))


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0: never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _bags(batches):
    for part in slices(batches):
        s = Sentences(part.column("text"))
        out = [[np.unique(s.word[s.bounds[i] : s.bounds[i + 1]]).tobytes() for i in range(s.row_bounds[r], s.row_bounds[r + 1])] for r in range(part.num_rows)]
        made = pa.record_batch([part.column("doc_id"), part.column("toxic"), pa.array(out, pa.list_(pa.binary()))], names=["doc_id", "toxic", "sentences"])
        yield made.filter(pa.array([bool(x) for x in out], pa.bool_()))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most `sample` rows of labels(doc_id, toxic) that are not held out, and their documents' texts.

    Half of the sample is for each label, chosen by a hash of doc_id, and in that order it ends where it has half of
    SAMPLE_CHARS code points, so that long texts don't fill the driver; weights restore the labels' shares. Rows
    with nulls are left out, of repeated labels of a document the largest counts.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].unionAll(chosen[1]))
    sizes = id_text(docs).where("text is not null").join(chosen, "doc_id").select("doc_id", "toxic", F.length("text").alias("size"))
    ahead = F.sum("size").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    few = sizes.select("doc_id", "toxic", ahead.alias("ahead")).where(F.col("ahead") <= SAMPLE_CHARS // 2).select("doc_id", "toxic").distinct()
    texts = id_text(docs).where("text is not null").join(F.broadcast(few), "doc_id").select("doc_id", "toxic", "text")
    bags = texts.mapInArrow(_bags, "doc_id long, toxic int, sentences array<binary>")
    table = bags.orderBy("doc_id", F.xxhash64("sentences")).toArrow()  # the same order whatever the partitions
    if not table.num_rows:
        return train(np.zeros(0), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint64))
    lists = table.column("sentences").combine_chunks()
    values = lists.flatten()
    _, offsets, data = values.buffers()
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    at = np.frombuffer(offsets, dtype=kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(np.uint64)
    n = np.concatenate(([0], np.cumsum([len(x) if x is not None else 0 for x in lists])))
    y = table.column("toxic").to_numpy()
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    weights = np.array([total.get(int(v), 1) / max(1, int((y == v).sum())) for v in y.tolist()])
    return train(y, n, (at - at[0]) // 8, flat, weights)


def _measure(sentences: Sentences, model: Model, n_rows: int):
    """Noisy-or score of each row, and its worst sentence with that one's probability."""
    z = model.logits(sentences)
    clean = np.bincount(sentences.row, weights=_log_clean(z), minlength=n_rows)
    score = np.clip(-np.expm1(clean), 0.0, 1.0) if len(z) else np.zeros(n_rows)
    order = np.lexsort((np.arange(len(z)), -z, sentences.row))
    worst = np.full(n_rows, -1)
    first = order[np.flatnonzero(np.diff(sentences.row[order], prepend=-1))]
    worst[sentences.row[first]] = first
    return score, worst, z


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score each row of docs(doc_id, text).

    Returns doc_id, held_out, score, predicted (1 from THRESHOLD on), n_offending (sentences that alone are likelier toxic
    than not), worst_start, worst_end (code points of the worst sentence) and worst_score. A null, empty or wordless
    text has score 0 and no worst sentence; a null doc_id is not held out; repeated rows repeat; other columns
    are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, n_offending int, worst_start long, worst_end long, worst_score double"

    def run(batches):
        for part in slices(batches):
            s = Sentences(part.column("text"))
            value, worst, z = _measure(s, shared.value, part.num_rows)
            none = worst < 0
            start, end = s.points()
            pick = lambda x: pa.array(np.append(x, 0)[worst], mask=none)
            offending = np.bincount(s.row, weights=z >= 0, minlength=part.num_rows).astype(np.int32)
            yield pa.record_batch([part.column("doc_id"), pa.array(value), pa.array(offending), pick(start), pick(end), pick(1 / (1 + np.exp(-z)))], names=[x.split()[0] for x in schema.split(", ")])

    rows = id_text(docs).mapInArrow(run, schema)
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_offending", "worst_start", "worst_end", "worst_score")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that score() predicts to be toxic; all columns stay as they are.

    Null, empty and wordless texts score 0 and stay; repeated rows stay or go together, whatever their doc_id; a score of
    THRESHOLD itself is toxic; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for part in slices(batches):
            value, _, _ = _measure(Sentences(part.column("text")), shared.value, part.num_rows)
            yield part.filter(pa.array(value < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
