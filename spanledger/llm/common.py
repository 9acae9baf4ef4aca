"""Shared folder, hashing and word splitting used by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: The white space bytes that end a word.
WHITE_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Text bytes handled at a time by the numpy passes; bounds a task's memory.
SLICE_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITE_SPACE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240607)
#: Two primes below 2^31.
_PRIMES = (2147483629, 2147483587)
_BASES = tuple(int(x) for x in _rng.integers(1 << 20, min(_PRIMES), 2))
_powers: dict[int, np.ndarray] = {}
_made: list[str] = []  # folders written by this driver


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors can reach.

    Only where that setting is absent (local tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    _made.append(f"{base.rstrip('/')}/work-{uuid.uuid4().hex}")
    return _made[-1]


def stash(df: DataFrame, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The folder stays, since plans made of it may run at any later time; `clear` removes all of a session's.
    """
    path = shared_folder(df.sparkSession)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the folder that stash() wrote for df; nothing may read it any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Remove the folders that this session's stash() calls wrote; what was made of them can't be read any more."""
    gone = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id and text (and the columns asked for), so that no other column of the input can clash."""
    return docs.select(F.col("doc_id").cast(LongType()), F.col("text").cast(StringType()), *more)



def _power(base: int, prime: int, n: int) -> np.ndarray:
    """base^i modulo the prime for i < n."""
    have = _powers.get(base, np.ones(1, dtype=np.uint64))
    while len(have) < n:
        have = np.concatenate((have, have * np.uint64(pow(base, len(have), prime)) % np.uint64(prime)))
    _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of data[start:end] for each span, A-Z lower-cased if asked for.

    Two polynomials modulo primes, as those modulo a power of two are equal for long texts that are easy to name.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    if lower:
        data = _LOWER[data]
    with np.errstate(over="ignore"):
        out = (ends - starts).astype(np.uint64) * np.uint64(_BASE)
        value = data.astype(np.uint64) + np.uint64(1)
        for k, (prime, base) in enumerate(zip(_PRIMES, _BASES)):
            p = np.uint64(prime)
            terms = value * _power(base, prime, len(data))
            if len(data) >= 1 << 23:  # the sum of terms below 2^40 would not fit in 64 bits
                terms %= p
            total = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(terms, out=total[1:])
            down = _power(pow(base, -1, prime), prime, len(data) + 1)
            out ^= (total[ends] - total[starts]) % p * down[starts] % p << np.uint64(32 * k)
        return mix64(out)


class Words:
    """The words of some texts: row of each word, byte span and hash. Rows keep their order."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        self.n_rows = len(texts)
        self.data, self.offsets = utf8(texts)
        space = _IS_SPACE[self.data]
        before = np.ones(len(space), dtype=bool)
        before[1:] = space[:-1]
        first = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        before[first] = True
        after = np.ones(len(space), dtype=bool)
        after[:-1] = space[1:]
        after[self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.hash = span_hashes(self.data, self.starts, self.ends, lower)
        #: words[bounds[r]:bounds[r + 1]] are those of row r
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def left(self) -> np.ndarray:
        """For each word, how many words of its row start at it or later."""
        return np.repeat(self.bounds[1:], self.counts()) - np.arange(len(self.starts))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words that start at each word, and whether the row has that many."""
        n = len(self.hash)
        out = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(min(k, n)):
                out[: n - j] += self.hash[j:] * np.uint64(pow(_BASE, j + 1, 2**64))
        return mix64(out), self.left() >= k

    def long_windows(self, k: int) -> np.ndarray:
        """A hash of the k words that start at each word, whatever row they are in, in one pass for any k."""
        n = len(self.hash)
        out = np.zeros(n, dtype=np.uint64)
        if n < k:
            return out
        up = np.full(n + 1, _BASE, dtype=np.uint64)
        down = np.full(n + 1, pow(_BASE, -1, 2**64), dtype=np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.hash * np.multiply.accumulate(up)[:n], out=total[1:])
            out[: n - k + 1] = (total[k:] - total[: n - k + 1]) * np.multiply.accumulate(down)[: n - k + 1]
            return mix64(out ^ np.uint64(k))


def sequence_hash(word_hashes: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence, equal to Words.shingles(len) of it."""
    with np.errstate(over="ignore"):
        weight = np.array([pow(_BASE, j + 1, 2**64) for j in range(len(word_hashes))], dtype=np.uint64)
        return mix64(np.array([np.sum(word_hashes * weight, dtype=np.uint64)]))[0]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins and ends (null: empty)."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def give_back() -> None:
    """Hand freed memory back to the system; Python workers live on from task to task and would hold their peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Cut record batches into runs of rows with about so many bytes of text; one long text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def gathered(batches, column: str = "text", limit: int = 24 << 20):
    """Join small record batches until they hold about so many bytes of text."""
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept, size = [], 0
    if kept and sum(b.num_rows for b in kept):
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
    give_back()
