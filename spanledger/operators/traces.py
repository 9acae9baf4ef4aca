"""Relational work on stored spans: rollups, dedupe, joins by absence, pages, self time, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions.hashing import bucket


def rollup(events: DataFrame) -> DataFrame:
    """Per trace: spans, errors, first start, last end and the duration in milliseconds."""
    out = events.groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.count(F.when(F.col("failed"), 1)).alias("n_errors"), F.min("started_us").alias("started_us"), F.max("ended_us").alias("ended_us"))
    return out.withColumn("duration_ms", F.expr("greatest(0, (ended_us - started_us) div 1000)"))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; an upsert's outcome, whatever was replayed."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pending(traces: DataFrame, evaluated: DataFrame, since: int | None = None) -> DataFrame:
    """Traces without an evaluation, chosen by its absence and never by a time mark, so late ones are found."""
    rows = traces if since is None else traces.where(F.col("started_us") >= since)
    return rows.join(evaluated.select("trace_id").distinct(), "trace_id", "left_anti")


def orphans(events: DataFrame) -> DataFrame:
    """Spans whose parent isn't in their trace."""
    parents = events.select("trace_id", F.col("span_id").alias("parent_id"))
    return events.where("parent_id is not null").join(parents, ["trace_id", "parent_id"], "left_anti")


def page_after(rows: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next `size` rows in descending order behind a position, by comparison and not by offset."""
    if after is not None:
        typed = [F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, after)]
        rows = rows.where((F.col(order[0]) <= typed[0]) & (F.struct(*order) < F.struct(*typed)))  # the first one reaches the scan
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(size)


def self_time(events: DataFrame) -> DataFrame:
    """Each span's time (microseconds) that no child of it covers; children are clipped to the span and may overlap."""
    kids = events.where("parent_id is not null").select("trace_id", F.col("parent_id").alias("span_id"), F.col("started_us").alias("s"), F.col("ended_us").alias("e"), F.col("span_id").alias("kid"))
    own = events.select("trace_id", "span_id", "started_us", "ended_us")
    cut = kids.join(own, ["trace_id", "span_id"]).select("trace_id", "span_id", F.greatest("s", "started_us").alias("s"), F.least("e", "ended_us").alias("e"), "kid").where("s < e")
    w = Window.partitionBy("trace_id", "span_id").orderBy("s", "kid").rowsBetween(Window.unboundedPreceding, -1)
    new = cut.withColumn("reached", F.coalesce(F.max("e").over(w), F.col("s")))
    covered = new.groupBy("trace_id", "span_id").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reached"))).alias("covered"))
    out = own.join(covered, ["trace_id", "span_id"], "left")
    return out.select("trace_id", "span_id", (F.col("ended_us") - F.col("started_us") - F.coalesce("covered", F.lit(0))).alias("self_us"))


def sampling_decisions(rows: DataFrame, id_: str, rate: float, salt: str, failed: Column, budget_by: list[str], budget: int, order: list[str]) -> DataFrame:
    """`decision` of each row: sampled by hash, else escalated if failed and among the budget's first in its group, else capped or not sampled."""
    sampled = bucket(salt, F.col(id_)) < rate
    rows = rows.withColumn("_sampled", sampled).withColumn("_candidate", ~F.col("_sampled") & failed)
    place = F.row_number().over(Window.partitionBy(*budget_by, "_candidate").orderBy(*order))
    decision = F.when(F.col("_sampled"), "sampled").when(F.col("_candidate") & (place <= budget), "escalated").when(F.col("_candidate"), "capped").otherwise("not_sampled")
    return rows.withColumn("decision", decision).drop("_sampled", "_candidate")


def rate_limited(requests: DataFrame, at: str, keys: list[str], limit: int, window: str = "60 seconds") -> DataFrame:
    """Requests per fixed window and key, and how many are over the limit. Works on streams too (give a watermark)."""
    out = requests.groupBy(F.window(at, window).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", F.greatest(F.lit(0).cast("long"), F.col("n") - limit).alias("n_rejected"))


def budget_status(costs: DataFrame, at: str, keys: list[str], cost: str, limit: float, warn_at: float = 0.8) -> DataFrame:
    """Spend by month and key against a limit."""
    out = costs.groupBy(F.date_trunc("month", at).alias("month"), *keys).agg(F.sum(cost).alias("spent"))
    ratio = F.col("spent") / limit
    return out.select("month", *keys, "spent", ratio.alias("ratio"), F.when(ratio >= 1, "exhausted").when(ratio >= warn_at, "warning").otherwise("ok").alias("state"))
