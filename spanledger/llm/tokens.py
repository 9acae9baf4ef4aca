"""Token ids of whole texts by the tokenizers library, and files of them.

File format: a Parquet folder of blocks. A block holds some documents in ascending doc_id order with
their token counts and the ranks of their ids (0 is the most frequent id of the corpus) in byte-aligned
variable-length coding: the control bytes have two bits per id, its number of bytes less one, and the
data bytes have each rank's low-order bytes, low byte first. A second folder maps ranks to ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, slices, stash

#: Fixed value: white space as the tokenizer's pattern sees it.
WHITE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Tokens of a block of the file, about.
BLOCK_TOKENS = 1 << 21
#: Pieces of text whose ids a worker remembers; then it starts anew.
CACHE_PIECES = 500_000


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


class _Memory:
    """The ids of pieces of text met before, all with one prefix."""

    def __init__(self, tokenizer, prefix: str, opens: np.ndarray):
        self.tokenizer, self.prefix, self.opens = tokenizer, prefix, opens
        self.clear()

    def clear(self) -> None:
        self.pieces: list[pa.Array] = []
        self.n, self.ids, self.ends = 0, [], [np.zeros(1, dtype=np.int64)]

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and each piece's number of ids. Pieces with a space in front are encoded sixteen at a time."""
        if self.prefix == " ":
            groups = pa.ListArray.from_arrays(pa.array([*range(0, len(pieces), 16), len(pieces)], pa.int32()), pieces)
            flat = self._ids([" " + x for x in pc.binary_join(groups, pa.scalar(" ", pieces.type)).to_pylist()])[0]
            first = np.flatnonzero(self.opens[flat])
            if len(first) == len(pieces) and first[0] == 0:
                return flat, np.diff(np.append(first, len(flat)))
        return self._ids([self.prefix + x for x in pieces.to_pylist()])

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and each text's number of ids; the tokenizer's own results are large, so only some live at a time."""
        ids, n = [], []
        for i in range(0, len(texts), 1024):
            each = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 1024], add_special_tokens=False)]
            ids.append(np.array([x for own in each for x in own], dtype=np.uint32))
            n += map(len, each)
        return np.concatenate(ids), np.array(n, dtype=np.int64)

    def look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids of the memory, first, count of each piece)."""
        if self.n > CACHE_PIECES:
            self.clear()
        known = pa.concat_arrays(self.pieces) if self.pieces else pa.array([], pieces.type)
        self.pieces = [known]
        at = pc.index_in(pieces, value_set=known)
        new = pieces.filter(pc.is_null(at))
        at = at.to_numpy(zero_copy_only=False).astype(np.float64)
        if len(new):
            flat, n = self._encode(new)
            at[np.isnan(at)] = self.n + np.arange(len(new))
            self.pieces.append(new)
            self.n += len(new)
            self.ids.append(flat)
            self.ends.append(self.ends[-1][-1] + np.cumsum(n))
        self.ids, self.ends = [np.concatenate(self.ids)] if self.ids else [], [np.concatenate(self.ends)]
        at = at.astype(np.int64)
        return (self.ids[0] if self.ids else np.zeros(0, dtype=np.uint32)), self.ends[0][at], np.diff(self.ends[0])[at]


class Encoder:
    """Whole texts to ids, equal to the tokenizer's own result.

    The byte-level pattern always breaks before a space that a non-space follows, so a text is cut there,
    each distinct piece is encoded once and the ids are put together. Texts with a space before other
    white space or at their end, and those that hold an added token's text, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of its own would each hold memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        opens = np.zeros(self.size, dtype=bool)
        opens[[i for token, i in vocabulary.items() if token[:1] == "Ġ"]] = True
        self.inner, self.first = _Memory(self.tokenizer, " ", opens), _Memory(self.tokenizer, "", opens)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other and the bounds of each text (null: empty)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, rf" ({WHITE}|$)").to_numpy(zero_copy_only=False)
        for token in self.added:
            odd = odd | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(odd)
        parts = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        pieces = parts.values
        start = np.zeros(len(pieces), dtype=bool)
        start[offsets[:-1]] = True
        begin, count = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        stores, shift = [], 0
        for memory, chosen in ((self.inner, ~start), (self.first, start)):
            coded = pieces.filter(pa.array(chosen)).dictionary_encode()
            codes = coded.indices.to_numpy()
            ids, at, n = memory.look_up(coded.dictionary)
            begin[chosen], count[chosen] = at[codes] + shift, n[codes]
            stores.append(ids)
            shift += len(ids)
        if len(self.first.ids) and self.first.n > CACHE_PIECES // 8:
            self.first.clear()
        per_text = np.add.reduceat(count, offsets[:-1]) if len(count) else np.zeros(0, dtype=np.int64)
        direct = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)]
        # the texts encoded whole stand in for their one empty piece
        for row, ids in zip(whole, direct):
            begin[offsets[row]], count[offsets[row]], per_text[row] = shift, len(ids), len(ids)
            shift += len(ids)
        store = np.concatenate([*stores, *direct])
        ends = np.cumsum(count)
        ids = store[np.repeat(begin - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate(([0], np.cumsum(per_text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, so that its memory serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    return np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))


def vbyte_encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] <= code[:, None]]
    padded = np.zeros(-(-len(code) // 4) * 4, dtype=np.uint8)
    padded[: len(code)] = code
    control = padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)
    return np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(), data.tobytes()


#: For each control byte, the number of bytes of its four values.
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])[None, :] & 3).astype(np.int64) + 1
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def vbyte_decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _SIZES[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    value = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        value[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return value & _MASK[size]


_RAW = "shard int, first long, n_docs int, n_tokens long, doc_ids binary, present binary, counts binary, ids binary"
_FILE = "shard int, first long, n_docs int, n_tokens long, doc_ids binary, present binary, counts binary, control binary, data binary"


def _blocks(path: str, end: int):
    def encode(batches) -> Iterator[pa.RecordBatch]:
        use, first = encoder(path), 0
        for part in slices(batches, limit=4 << 20):
            ids, bounds = with_end(*use(part.column("text")), end)
            shard, doc = part.column("shard")[0].as_py(), part.column("doc_id")
            a = 0
            while a < part.num_rows:
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + BLOCK_TOKENS, side="right")) - 1)
                own = ids[bounds[a] : bounds[b]]
                row = [shard, first, b - a, len(own), doc.slice(a, b - a).fill_null(0).to_numpy().astype("<i8").tobytes(), doc.slice(a, b - a).is_valid().to_numpy(zero_copy_only=False).tobytes(), np.diff(bounds[a : b + 1]).astype("<i8").tobytes(), own.astype("<u4" if use.size > 1 << 16 else "<u2").tobytes()]
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4))], names=["shard", "first", "n_docs", "n_tokens", "doc_ids", "present", "counts", "ids"])
                first += len(own)
                a = b

    return encode


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = 0) -> None:
    """Encode docs(doc_id, text) and write the files below path, in ascending doc_id order.

    A null text is empty, a null doc_id comes first, repeated rows stay, each with its ids; equal doc_ids are
    ordered by text. Every text is followed by the end id. Other columns are ignored; no rows give empty folders.
    The texts move once, in one range-partitioned shuffle; ids are counted and ranked over the whole corpus,
    which leaves one number for each id of the vocabulary.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = id_text(docs).repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    raw = stash(rows.withColumn("shard", F.spark_partition_id()).mapInArrow(_blocks(tokenizer, end), _RAW))
    size = len_of(tokenizer)

    def count(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype="<u4" if size > 1 << 16 else "<u2"), minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    counts = raw.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by_rank = np.array([r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))], dtype=np.uint32)
    rank = np.zeros(size, dtype=np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)  # one number for each id of the vocabulary

    def code(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), dtype="<u4" if size > 1 << 16 else "<u2")
                control, data = vbyte_encode(shared.value[ids])
                one = batch.slice(i, 1)
                yield pa.record_batch([*[one.column(c) for c in ("shard", "first", "n_docs", "n_tokens", "doc_ids", "present", "counts")], pa.array([control]), pa.array([data])], names=[x.split()[0] for x in _FILE.split(", ")])

    raw.mapInArrow(code, _FILE).write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")


def len_of(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids (array) of each document of the files, in one pass.

    A null doc_id comes back as null, a null or empty text as the end id alone, each repeated row by itself; files of an empty
    table give no rows.
    """
    return _decoded(spark, path, "doc_id long, start long, n_tokens long, ids array<int>", lambda ids: pa.array(ids.astype(np.int32)), lambda rows: pa.array(rows, pa.list_(pa.int32())))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of each document, nulls and repeats as in read_token_files()."""
    return _decoded(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), lambda rows: pa.array(rows, pa.int64()))


def _decoded(spark: SparkSession, path: str, schema: str, one, column) -> DataFrame:
    blocks = spark.read.schema(_FILE).parquet(f"{path}/blocks")
    # one row for each shard, as many as there were shuffle partitions
    totals = dict(blocks.groupBy("shard").agg(F.sum("n_tokens")).collect())
    base, at = {}, 0
    for shard in sorted(totals):
        base[shard], at = at, at + totals[shard]
    ids = spark.sparkContext.broadcast(np.array([r["id"] for r in spark.read.schema("rank int, id int").parquet(f"{path}/ranks").orderBy("rank").collect()], dtype=np.uint32))

    def decode(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], dtype="<i8")
                tokens = ids.value[vbyte_decode(row["control"], row["data"], row["n_tokens"])]
                bounds = np.concatenate(([0], np.cumsum(counts)))
                there = np.frombuffer(row["present"], dtype=bool)
                doc = pa.array(np.frombuffer(row["doc_ids"], dtype="<i8"), mask=~there)
                last = column([one(tokens[a:b]) for a, b in zip(bounds[:-1], bounds[1:])])
                start = base[row["shard"]] + row["first"] + bounds[:-1]
                yield pa.record_batch([doc, pa.array(start), pa.array(counts), last], names=[x.split()[0] for x in schema.split(", ")])

    return blocks.mapInArrow(decode, schema)
