"""Spans of any producer to the ordered events that the rules look at.

spans: trace_id, span_id, parent_id, name, span_type, tool_name, status, started_us, ended_us (null: open), sequence_index,
attributes (map of texts), tool_args (JSON text), arrival (order in the input).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions.scalars import matches_glob
from spanledger.functions.values import args_hash

#: The known kinds of spans and statuses; others become the last one.
SPAN_TYPES = ("agent", "llm", "tool", "retrieval", "guardrail", "workflow", "custom")
STATUSES = ("ok", "error", "timeout", "cancelled", "unset")
ACTION_ATTRIBUTE, STATE_PREFIX = "agent.action", "agent.state."


def known(value: Column, words: tuple[str, ...]) -> Column:
    return F.when(value.isin(list(words)), value).otherwise(words[-1])


def in_vocabulary(rows: DataFrame) -> DataFrame:
    """Rows whose span_type and status, where they have such columns, are known words: others, and null, become custom and unset."""
    return rows.withColumns({c: known(F.col(c), words) for c, words in (("span_type", SPAN_TYPES), ("status", STATUSES)) if c in rows.columns})


def action_of(aliases: dict[str, list[str]] | None = None, attribute: str = ACTION_ATTRIBUTE) -> Column:
    """An attribute's action, else the tool's name, else the span's, in the name that an alias stands for."""
    raw = F.coalesce(F.nullif(F.try_element_at("attributes", F.lit(attribute)), F.lit("")), F.nullif("tool_name", F.lit("")), F.col("name"))
    pairs = [(alias, name) for name, others in (aliases or {}).items() for alias in others]
    if not pairs:
        return raw
    return F.coalesce(F.create_map(*[F.lit(x) for pair in pairs for x in pair])[raw], raw)


def selected(spans: DataFrame, aliases: dict[str, list[str]] | None = None, span_types: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """Spans of the wanted kinds whose action (added) no shell pattern of `exclude` matches. Kinds that nobody knows are custom ones."""
    rows = in_vocabulary(spans).withColumn("action", action_of(aliases))
    if span_types is not None:
        rows = rows.where(F.col("span_type").isin(span_types))
    return rows.where(~matches_glob(F.col("action"), list(exclude))) if exclude else rows


def unmatched_traces(spans: DataFrame, chosen: DataFrame) -> DataFrame:
    """Traces that have spans of which none was selected, with the kinds that they have."""
    kinds = in_vocabulary(spans).groupBy("trace_id").agg(F.array_sort(F.collect_set("span_type")).alias("span_types"))
    return kinds.join(chosen.select("trace_id").distinct(), "trace_id", "left_anti")


def deduped(spans: DataFrame) -> DataFrame:
    """The first of the spans with one id in a trace, by arrival, and how many others there were."""
    w = Window.partitionBy("trace_id", "span_id").orderBy("arrival")
    others = F.count("*").over(Window.partitionBy("trace_id", "span_id")) - 1
    return spans.withColumn("duplicates", others).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def clamped(chosen: DataFrame, spans: DataFrame) -> DataFrame:
    """No span starts before its parent did by the parent's own clock; parents are looked up among all spans, one level up. Adds skew_us."""
    parents = spans.groupBy("trace_id", F.col("span_id").alias("parent_id")).agg(F.min("started_us").alias("_parent"))
    rows = chosen.join(parents, ["trace_id", "parent_id"], "left")
    start = F.greatest("started_us", F.coalesce("_parent", F.col("started_us")))
    return rows.withColumn("skew_us", start - F.col("started_us")).withColumn("started_us", start).drop("_parent").select(*chosen.columns, "skew_us")


def events(spans: DataFrame, aliases: dict[str, list[str]] | None = None, span_types: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """The trace's events: selected, first of each id, start clamped; an open span has status timeout; `failed` are error and timeout.

    Columns: trace_id, span_id, parent_id, action, status, failed, args (16 hex digits of the arguments), tool_args, started_us, ended_us, sequence_index, index.
    """
    rows = clamped(deduped(selected(spans, aliases, span_types, exclude)), spans)
    status = F.when(F.col("ended_us").isNull(), "timeout").otherwise(F.col("status"))
    rows = rows.withColumn("status", status).withColumn("args", args_hash(F.col("tool_args")))
    index = F.row_number().over(Window.partitionBy("trace_id").orderBy("started_us", "sequence_index", "span_id")) - 1
    return rows.select("trace_id", "span_id", "parent_id", "action", "status", F.col("status").isin("error", "timeout").alias("failed"), "args", "tool_args", "started_us", "ended_us", "sequence_index", index.alias("index"))


def incomplete(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """trace_id of the traces(trace_id, dropped) that lost spans or have an open one, selected or not."""
    open_ = spans.groupBy("trace_id").agg(F.bool_or(F.col("ended_us").isNull()).alias("open"))
    rows = traces.join(open_, "trace_id", "left")
    return rows.where("coalesce(dropped, 0) > 0 or coalesce(open, false)").select("trace_id")


def merged_state(traces: DataFrame, spans: DataFrame, updates: DataFrame | None = None, prefix: str = STATE_PREFIX) -> DataFrame:
    """trace_id and state (map): metadata of traces(trace_id, metadata, state), then attributes with the prefix in the spans' order, each
    span's updates(trace_id, span_id, at_us, attributes) in time after its own, then the trace's declared state; later ones win.
    """
    order = lambda rank, *parts: F.named_struct(*[x for i, p in enumerate((F.lit(rank), *parts)) for x in (F.lit(f"o{i}"), p)])
    zero, none = F.lit(0).cast("long"), F.lit("")
    of_span = lambda last: order(1, F.col("started_us"), F.col("sequence_index").cast("long"), F.col("span_id").cast("string"), last)
    entry = lambda df, values, at: df.select("trace_id", at.alias("at"), F.explode(values).alias("key", "value"))
    own = F.transform_keys(F.map_filter("attributes", lambda k, v: F.startswith(k, F.lit(prefix))), lambda k, v: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))
    rows = entry(traces, F.col("metadata"), order(0, zero, zero, none, zero)).unionByName(entry(spans, own, of_span(zero))).unionByName(entry(traces, F.col("state"), order(2, zero, zero, none, zero)))
    if updates is not None:
        told = updates.withColumnRenamed("attributes", "given").join(spans.select("trace_id", "span_id", "started_us", "sequence_index"), ["trace_id", "span_id"])
        rows = rows.unionByName(entry(told, F.col("given"), of_span(F.col("at_us") + 1)))
    last = rows.groupBy("trace_id", "key").agg(F.max_by("value", "at").alias("value"))
    return last.groupBy("trace_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("state"))
