"""Rollups of traces that can be merged: a batch's part is made of its own spans, and parts are added without reading spans again.

A part has a row per trace: n_spans, n_errors, n_open, tokens, cost, started_us, ended_us. Parts are sums and extents, so any split of the spans into
batches, merged in any order, ends in the same rollup; spans that come twice must be taken out before (see ingest.insert_absent).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS, LEAST, MOST = ("n_spans", "n_errors", "n_open", "tokens", "cost"), ("started_us",), ("ended_us",)


def part(spans: DataFrame) -> DataFrame:
    """spans(trace_id, status, started_us, ended_us and, if they have any, tokens, cost) to a part. A span without an end is open."""
    given = lambda c, kind: (F.col(c) if c in spans.columns else F.lit(None)).cast(kind)
    return spans.groupBy("trace_id").agg(
        F.count("*").alias("n_spans"), F.count(F.when(F.col("status") == "error", 1)).alias("n_errors"), F.count(F.when(F.col("ended_us").isNull(), 1)).alias("n_open"),
        F.coalesce(F.sum(given("tokens", "long")), F.lit(0).cast("long")).alias("tokens"), F.coalesce(F.sum(given("cost", "decimal(18,8)")), F.lit(0)).cast("decimal(28,8)").alias("cost"),
        F.min("started_us").alias("started_us"), F.max("ended_us").alias("ended_us"),
    )


def merged(*parts: DataFrame) -> DataFrame:
    """Parts, or one frame with the rows of several, as one part."""
    rows = reduce(DataFrame.unionByName, parts)
    sums = [F.sum(c).cast("decimal(28,8)" if c == "cost" else "long").alias(c) for c in SUMS]
    return rows.groupBy("trace_id").agg(*sums, *[F.min(c).alias(c) for c in LEAST], *[F.max(c).alias(c) for c in MOST])


def finished(whole: DataFrame) -> DataFrame:
    """A part as the rollup of its traces: status, duration, and an end only where no span is open."""
    ended = F.when(F.col("n_open") == 0, F.col("ended_us"))
    status = F.when(F.col("n_errors") > 0, "error").when(F.col("n_open") > 0, "unset").otherwise("ok")
    duration = F.when(ended.isNotNull(), F.greatest(F.lit(0).cast("long"), F.expr("(ended_us - started_us) div 1000")))
    return whole.select("trace_id", "n_spans", "n_errors", "n_open", "tokens", "cost", "started_us", ended.alias("ended_us"), duration.alias("duration_ms"), status.alias("status"))
