"""The queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, infill, linededup, near_dedup, oracles, packing, pages, prefix_join, quality, substring, tokens, toxicity, turns, urlfilter
from .common import shared_folder, stash

SHINGLE_OF_CONTRACT, PERCENT, JOIN_PERCENT = 4, 80, 85


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents")).withColumn("quality", F.round("quality", 6))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    tokens.write_token_files(_table(spark, sf_dir, "documents"), path, tokens.default_tokenizer())
    return tokens.read_digests(spark, path)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=SHINGLE_OF_CONTRACT, percent=PERCENT)


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokens.default_tokenizer())


def dated_captures(pages: DataFrame) -> DataFrame:
    """pages with a fetch time in 2024 that follows from page_id; the table has none."""
    day, second = F.expr("cast(page_id * 7919 % 366 as int)"), F.expr("page_id * 131 % 86400")
    return pages.select("page_id", "url", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(day, F.lit(0), F.lit(0), second.cast("decimal(18,6)"))).alias("fetched_at"))


def dated_entries(captures: DataFrame) -> DataFrame:
    """A dated list over the hosts of the captures, whose entries and days follow from the hosts' md5."""
    hosts = captures.select(urlfilter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    code = lambda at: F.conv(F.substring(F.md5("host"), at, 4), 16, 10).cast("int")
    coded = hosts.select("host", code(1).alias("a"), code(5).alias("b"), F.regexp_extract("host", r"([^.]+[.][^.]+[.][^.]+)$", 1).alias("parent"))
    rules = [  # list, kind, pattern, action, day, when
        ("malware", "host", "host", "add", "a % 300", "a % 3 = 0"),
        ("malware", "host", "host", "remove", "a % 300 + 20 + b % 100", "a % 3 = 0 and b % 2 = 0"),
        ("malware", "host", "host", "add", "a % 300 + 170", "a % 3 = 0 and b % 4 = 0"),
        ("adult", "domain", "parent", "add", "b % 200", "b % 5 = 0 and parent <> ''"),
        ("spam", "prefix", "host || '/en'", "add", "b % 250", "a % 4 = 1"),
        ("spam", "prefix", "host || '/en'", "remove", "b % 250 + 60", "a % 4 = 1"),
        ("allow", "host", "host", "add", "100", "a % 7 = 0"),
    ]
    entry = lambda name, kind, pattern, action, day, when: f"if({when}, named_struct('list', '{name}', 'kind', '{kind}', 'pattern', {pattern}, 'action', '{action}', 'day', {day}), null)"
    each = coded.select(F.explode(F.expr(f"filter(array({', '.join(entry(*r) for r in rules)}), x -> x is not null)")).alias("e")).select("e.*").distinct()
    return each.select("list", "kind", "pattern", "action", F.expr("timestamp'2024-01-01' + make_dt_interval(day)").alias("listed_at"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = dated_captures(_table(spark, sf_dir, "pages"))
    out = urlfilter.filter_urls(captures, dated_entries(captures))
    return out.withColumns({"lists": F.array_join("lists", ","), "fetched_at": F.col("fetched_at").cast("timestamp_ntz")})


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with a fault in a quarter of the rows, which follows from conv_id and turn."""
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), (F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20).alias("kind"))
    rows = rows.where("kind <> 0").withColumns(
        {
            "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
        }
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    report = stash(turns.structure(rows))
    hashed = turns.digests(turns.repaired(rows, report))
    ids = conversations.select("conv_id").distinct()
    out = ids.join(report.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    out = out.join(hashed.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.similar_groups(_table(spark, sf_dir, "documents"), shingle=SHINGLE_OF_CONTRACT, percent=JOIN_PERCENT)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_quality, op3_line_dedup, op4_token_files, op5_toxicity, op6_near_dedup, op7_repeated_passages, op8_main_text, op9_packing, op10_url_filter, op11_conversation_repair, op12_ngram_join, op13_fill_in_middle)
}

ORACLE_SQL = {
    "op2_quality": oracles.quality_sql(),
    "op3_line_dedup": oracles.line_dedup_sql(linededup.MIN_CHARS),
    "op6_near_dedup": oracles.near_dedup_sql(SHINGLE_OF_CONTRACT, PERCENT),
    "op10_url_filter": oracles.URL_FILTER_SQL,
    "op11_conversation_repair": oracles.CONVERSATION_SQL,
    "op12_ngram_join": f"select doc_id, n_shingles, component_id from ({oracles.near_dedup_sql(SHINGLE_OF_CONTRACT, JOIN_PERCENT)})",
    "op13_fill_in_middle": oracles.INFILL_SQL,
}
