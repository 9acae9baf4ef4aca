"""Datasets, journals and labels as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanledger.functions import predicates
from spanledger.functions.values import canonical_json


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): the lines of text files with their numbers from 1 in each file.

    Files are read in splits. Lines of a split come in one partition in their order, so a line's number is its place there plus the lines of the
    file's earlier partitions; only these counts, one for each partition and file, are gathered.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"))
    split = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = split.select("file", "start", "first", before.alias("before"))
    numbered = lines.join(F.broadcast(offsets), ["file", "start"])
    return numbered.select("file", (F.col("before") + F.col("place") - F.col("first") + 1).cast("long").alias("line"), F.trim("text").alias("text"))


def jsonl_examples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines to (file, line, id, input, expected, metadata, error), the objects as JSON strings.

    Blank lines and those that begin with // are left out; ids that are missing follow from the physical line; a line that
    isn't an object or has no input gets an error.
    """
    lines = numbered_lines(spark, path).where((F.col("text") != "") & ~F.startswith("text", F.lit("//")))
    field = lambda name: F.get_json_object("text", f"$.{name}")
    rows = lines.select("file", "line", F.coalesce(field("id"), field("external_id"), F.format_string("ex-%04d", "line")).alias("id"), field("input").alias("input"), field("expected").alias("expected"), F.coalesce(field("metadata"), F.lit("{}")).alias("metadata"), F.json_object_keys("text").alias("keys"))
    error = F.when(F.col("keys").isNull(), "not an object").when(F.col("input").isNull(), "no input")
    return rows.select("file", "line", "id", "input", "expected", "metadata", error.alias("error"))


def write_jsonl(examples: DataFrame, path: str) -> None:
    """Examples(id, input, expected, metadata: JSON texts) as canonical JSON lines."""
    text = lambda c: F.coalesce(canonical_json(F.col(c)), F.lit("null"))
    named = F.expr("substring(to_json(struct(id)), 2, length(to_json(struct(id))) - 2)")
    line = F.concat(F.lit('{"expected":'), text("expected"), F.lit(","), named, F.lit(',"input":'), text("input"), F.lit(',"metadata":'), text("metadata"), F.lit("}"))
    examples.select(line.alias("value")).write.text(path)


def run_journal(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each example of an append-only JSON-lines journal (later files by name are later); a torn line is left out."""
    rows = numbered_lines(spark, path).withColumn("example_id", F.get_json_object("text", "$.example_id")).where("example_id is not null")
    last = rows.groupBy("example_id").agg(F.max_by("text", F.struct("file", "line")).alias("text"))
    return last.select("example_id", F.get_json_object("text", "$.status").alias("status"), "text")


def csv_examples(spark: SparkSession, path: str) -> DataFrame:
    """CSV with columns id, input.*, expected.*, metadata.* to (id, input, expected, metadata) maps; without prefixes all columns are the input."""
    rows = spark.read.csv(path, header=True)
    group = lambda prefix: [c for c in rows.columns if c.startswith(f"{prefix}.")]
    pairs = lambda columns, cut: F.map_filter(F.create_map(*[x for c in columns for x in (F.lit(c[cut:]), F.col(f"`{c}`"))]), lambda k, v: v.isNotNull()) if columns else F.create_map().cast("map<string,string>")
    plain = [c for c in rows.columns if "." not in c and c != "id"]
    given = pairs(group("input"), 6) if group("input") else pairs(plain, 0)
    return rows.select(F.col("id") if "id" in rows.columns else F.lit(None).cast("string").alias("id"), given.alias("input"), pairs(group("expected"), 9).alias("expected"), pairs(group("metadata"), 9).alias("metadata"))


def filtered(examples: DataFrame, predicate: str | None = None, names: dict[str, tuple[Column, str]] | None = None, ids: DataFrame | None = None, limit: int | None = None, order: str = "ordinal") -> DataFrame:
    """Examples that a predicate (see functions.predicates; names: what its words are, and of which kind) holds for, those of ids(id), the first
    `limit` of them in the dataset's order."""
    out = examples
    if predicate is not None:
        out = out.where(predicates.compile_predicate(predicate, names or {}))
    if ids is not None:
        out = out.join(ids.select("id").distinct(), "id", "left_semi")
    return out if limit is None else out.orderBy(order).limit(limit)


def left_to_run(examples: DataFrame, journal: DataFrame, again: tuple[str, ...] = ("error", "timeout")) -> DataFrame:
    """Examples(id, ...) that a run which goes on still has to do: all but those that its journal(example_id, status) has as done.
    Statuses of `again` are done anew."""
    done = journal.where(~F.col("status").isin(*again)).select(F.col("example_id").alias("id")).distinct()
    return examples.join(done, "id", "left_anti")


def in_dataset_order(results: DataFrame, examples: DataFrame, order: str = "ordinal") -> DataFrame:
    """Results(example_id, ...) sorted as their examples(id, ordinal) are, range by range; results of other examples come last, by id."""
    placed = results.join(examples.select(F.col("id").alias("example_id"), F.col(order).alias("_order")), "example_id", "left")
    return placed.orderBy(F.asc_nulls_last("_order"), "example_id").drop("_order")


def value_chunks(scores: DataFrame, examples: DataFrame, order: str = "ordinal", size: int = 1000) -> DataFrame:
    """scores(metric, example_id, value) to metric, chunk, n and values: a metric's values in the order of the dataset, those of `size` ordinals
    in one row, so that no row grows with the dataset. Several scores of an example stand by value; values that are null are left out."""
    placed = scores.where("value is not null").join(examples.select(F.col("id").alias("example_id"), F.col(order).alias("_order")), "example_id")
    listed = placed.groupBy("metric", F.floor(F.col("_order") / size).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("_order", "value"))).alias("_list"))
    return listed.select("metric", "chunk", F.size("_list").alias("n"), F.col("_list.value").alias("values"))
