"""What arrives to what is stored: batches checked, spans and traces upserted, payloads kept by content.

Stored tables are DataFrames; an upsert gives the table's new content. All are keyed aggregates or joins by key, so
they may run in foreachBatch, and the same batch twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions.scalars import from_nanos

#: Columns of a stored span that an upsert doesn't change.
FIXED_SPAN_COLUMNS = ("started_us", "parent_id", "span_type", "tool_name", "model")
#: What a batch may hold, and payload sizes in bytes.
MAX_SPANS, MAX_TRACES, MAX_EVENTS = 10_000, 1_000, 500
INLINE_BYTES, OFFLOAD_BYTES = 32 * 1024, 1024 * 1024
#: Attributes in which producers tell the same thing, the first filled one counts.
FIELDS = {
    "model": ["gen_ai.response.model", "gen_ai.request.model", "llm.model_name"], "provider": ["gen_ai.system", "gen_ai.provider.name", "llm.provider"],
    "prompt_tokens": ["gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.token_count.prompt"],
    "completion_tokens": ["gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.token_count.completion"],
    "tool_name": ["gen_ai.tool.name", "tool.name"], "session_id": ["session.id", "gen_ai.conversation.id"], "user_ref": ["user.id", "enduser.id"],
}


def upsert_spans(stored: DataFrame, arrived: DataFrame, keys: tuple[str, ...] = ("trace_id", "span_id"), order: str = "arrival", fixed: tuple[str, ...] = FIXED_SPAN_COLUMNS) -> DataFrame:
    """stored with the last arrived row of each key; the columns of `fixed` stay as they were first stored."""
    last = latest(arrived, list(keys), [order]).drop(order)
    old = stored.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in fixed if c in stored.columns], F.lit(True).alias("_stored"))
    kept = last.join(old, list(keys), "left")
    columns = [F.when(F.col("_stored"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in fixed and c in stored.columns else F.col(c) for c in stored.columns]
    return stored.join(last.select(*keys), list(keys), "left_anti").unionByName(kept.select(*columns))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicate_count(stored: DataFrame, arrived: DataFrame, keys: list[str] = ("trace_id", "span_id")) -> DataFrame:
    """n_rows, n_new and n_duplicates: rows of the batch less the keys that it adds."""
    new = arrived.select(*keys).distinct().join(stored.select(*keys), list(keys), "left_anti").agg(F.count("*").alias("n_new"))
    return arrived.agg(F.count("*").alias("n_rows")).join(F.broadcast(new), F.lit(True)).withColumn("n_duplicates", F.col("n_rows") - F.col("n_new"))


def upsert_declared(stored: DataFrame, declared: DataFrame, order: str = "arrival") -> DataFrame:
    """Traces as they are declared last take the place of what was stored, counters too."""
    last = latest(declared, ["trace_id"], [order])
    return stored.join(last.select("trace_id"), "trace_id", "left_anti").unionByName(last.select(*stored.columns))


def stub_traces(spans: DataFrame, declared: DataFrame) -> DataFrame:
    """Traces that spans touch and nobody declared: trace_id, status, started_us, ended_us, duration_ms, dropped."""
    rows = spans.join(declared.select("trace_id").distinct(), "trace_id", "left_anti")
    out = rows.groupBy("trace_id").agg(F.when(F.bool_or(F.col("status") == "error"), "error").otherwise("unset").alias("status"), F.min("started_us").alias("started_us"), F.max("ended_us").alias("ended_us"))
    return out.withColumn("duration_ms", F.expr("greatest(0, (ended_us - started_us) div 1000)")).withColumn("dropped", F.lit(0).cast("long"))


def upsert_stubs(stored: DataFrame, stubs: DataFrame) -> DataFrame:
    """Stubs into stored traces: the later end, the longer time, the more dropped spans; an error stays or comes, else the old status stays."""
    rows = stored.select("*", F.lit(0).alias("_new")).unionByName(stubs.select(*stored.columns, F.lit(1).alias("_new")))
    old = lambda c: F.min_by(c, "_new")
    status = F.when(F.bool_or((F.col("_new") == 1) & (F.col("status") == "error")), "error").otherwise(old("status"))
    most = [F.max(c).alias(c) for c in ("ended_us", "duration_ms", "dropped")]
    rest = [old(c).alias(c) for c in stored.columns if c not in ("trace_id", "status", "ended_us", "duration_ms", "dropped")]
    return rows.groupBy("trace_id").agg(status.alias("status"), *most, *rest).select(*stored.columns)


def replace_children(stored: DataFrame, arrived: DataFrame, keys: list[str] = ("trace_id", "span_id")) -> DataFrame:
    """The children (events) of every key in the batch are those of the batch."""
    return stored.join(arrived.select(*keys).distinct(), list(keys), "left_anti").unionByName(arrived)


def insert_absent(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that are to be written: keys not stored yet, one row of each."""
    return rows.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def append_results(stored: DataFrame, rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Results to write: of runs(run_id, status) that are still running, examples that the run doesn't have yet.

    Runs are few and their results many, so these are parted by example first: what is parted by run stays so for the other steps, in a task a run.
    """
    going = runs.where("status = 'running'").select("run_id")
    return insert_absent(stored, rows, ["run_id", "example_id"]).join(going, "run_id", "left_semi")


def touched(spans: DataFrame, declared: DataFrame) -> DataFrame:
    return spans.select("trace_id").union(declared.select("trace_id")).distinct()


def routed(rows: DataFrame, column: str = "payload") -> DataFrame:
    """`route` of a payload by its bytes: inline, offload or dropped; n_bytes; null stays null."""
    n = F.octet_length(column)
    return rows.withColumn("n_bytes", n).withColumn("route", F.when(n <= INLINE_BYTES, "inline").when(n <= OFFLOAD_BYTES, "offload").when(n.isNotNull(), "dropped"))


def content_objects(rows: DataFrame, keys: list[str], column: str = "payload") -> DataFrame:
    """One row for each different payload of a key: its sha256, object key and size."""
    out = rows.where(F.col(column).isNotNull()).withColumn("sha256", F.sha2(column, 256)).dropDuplicates([*keys, "sha256"])
    return out.select(*keys, "sha256", F.concat_ws("/", *keys, F.substring("sha256", 1, 2), "sha256").alias("object_key"), F.octet_length(column).alias("n_bytes"))


def unreferenced(objects: DataFrame, spans: DataFrame, key: str = "object_key", reference: str = "input_ref") -> DataFrame:
    """Objects that no span names."""
    return objects.join(spans.select(F.col(reference).alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def rejected(spans: DataFrame) -> DataFrame:
    """`reason` why a received span can't be stored, null for a good one: its ids must be hex of 32 and 16 digits and not all zero."""
    bad = lambda c, n: ~F.coalesce(F.col(c).rlike(f"^[0-9a-fA-F]{{{n}}}$"), F.lit(False)) | F.coalesce(F.col(c).rlike("^0+$"), F.lit(False))
    reason = F.when(bad("trace_id", 32), "bad_trace_id").when(bad("span_id", 16), "bad_span_id").when(F.col("parent_id").isNotNull() & bad("parent_id", 16), "bad_parent_id")
    return spans.withColumn("reason", reason)


def over_batch_limits(spans: DataFrame, batch: str = "batch") -> DataFrame:
    """Per batch what it has too much of: spans, traces or events of one span; no row for a batch within the limits."""
    counts = spans.groupBy(batch).agg(F.count("*").alias("spans"), F.count_distinct("trace_id").alias("traces"), F.max("n_events").alias("events"))
    reasons = F.array_compact(F.array(F.when(F.col("spans") > MAX_SPANS, "spans"), F.when(F.col("traces") > MAX_TRACES, "traces"), F.when(F.col("events") > MAX_EVENTS, "events")))
    return counts.withColumn("over", reasons).where(F.size("over") > 0)


def mapped_fields(attributes: Column, fields: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """For each field the first filled attribute, and `attributes` without those that were used up."""
    fields = fields or FIELDS
    used = [k for ks in fields.values() for k in ks]
    found = {name: F.coalesce(*[F.nullif(F.try_element_at(attributes, F.lit(k)), F.lit("")) for k in ks]) for name, ks in fields.items()}
    return {**found, "attributes": F.map_filter(attributes, lambda k, v: ~k.isin(used))}


_ANY = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,bytesValue:string,arrayValue:string,kvlistValue:string>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string,message:string>,attributes:array<struct<key:string,value:{_ANY}>>,events:array<struct<name:string,timeUnixNano:string>>>"
OTLP_SCHEMA = f"struct<resourceSpans:array<struct<resource:struct<attributes:array<struct<key:string,value:{_ANY}>>>,scopeSpans:array<struct<scope:struct<name:string>,spans:array<{_SPAN}>>>>>>"


def _any(value: Column) -> Column:
    """One of the typed fields as text; lists, maps and bytes (base64) as they are written."""
    return F.coalesce(value["stringValue"], value["boolValue"].cast("string"), value["intValue"], value["doubleValue"].cast("string"), value["arrayValue"], value["kvlistValue"], value["bytesValue"])


def _pairs(listed: Column) -> Column:
    last = F.aggregate(listed, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], _any(e["value"]))))
    return F.coalesce(last, F.create_map().cast("map<string,string>"))


def decode_otlp(requests: DataFrame, column: str = "body") -> DataFrame:
    """Trace export requests in OTLP's JSON form to a row per span: ids, name, times, status, attributes, resource, scope, n_events.

    A time that isn't a number is 1970; an end of 0 or none is an open span; what isn't JSON has no spans.
    """
    parsed = requests.select(F.from_json(column, OTLP_SCHEMA).alias("r")).select(F.explode("r.resourceSpans").alias("rs"))
    scopes = parsed.select(_pairs(F.col("rs.resource.attributes")).alias("resource"), F.explode("rs.scopeSpans").alias("ss"))
    spans = scopes.select("resource", F.col("ss.scope.name").alias("scope"), F.explode("ss.spans").alias("s"))
    end = F.col("s.endTimeUnixNano")
    code = F.col("s.status.code")
    return spans.select(
        F.lower("s.traceId").alias("trace_id"), F.lower("s.spanId").alias("span_id"), F.nullif(F.lower("s.parentSpanId"), F.lit("")).alias("parent_id"), F.col("s.name").alias("name"),
        from_nanos(F.col("s.startTimeUnixNano")).alias("started_at"), F.when(F.coalesce(end, F.lit("0")) != "0", from_nanos(end)).alias("ended_at"),
        F.when(code.isin("2", "STATUS_CODE_ERROR"), "error").when(code.isin("1", "STATUS_CODE_OK"), "ok").otherwise("unset").alias("status"),
        _pairs(F.col("s.attributes")).alias("attributes"), "resource", "scope", F.coalesce(F.size("s.events"), F.lit(0)).alias("n_events"),
    )


def traces_of(spans: DataFrame) -> DataFrame:
    """Decoded spans to traces: extent, the root's name (the earliest root's), the first session and user that a span names, and errors."""
    fields = mapped_fields(F.col("attributes"))
    at = F.struct("started_at", "span_id")
    root = F.col("parent_id").isNull()
    rows = spans.withColumn("_session", fields["session_id"]).withColumn("_user", fields["user_ref"])
    first = lambda c, when: F.min_by(F.when(when, F.col(c)), F.when(when, at))
    return rows.groupBy("trace_id").agg(
        first("name", root).alias("name"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.count("*").alias("n_spans"),
        F.count(F.when(F.col("status") == "error", 1)).alias("n_errors"), first("_session", F.col("_session").isNotNull()).alias("session_id"), first("_user", F.col("_user").isNotNull()).alias("user_ref"),
    )


def span_details(spans: DataFrame, events: DataFrame, objects: DataFrame) -> DataFrame:
    """Spans with their events in time and their payload's object; `truncated` where the object named isn't there."""
    listed = events.groupBy("trace_id", "span_id").agg(F.sort_array(F.collect_list(F.struct("at_us", "name"))).alias("events"))
    held = objects.select(F.col("object_key").alias("input_ref"), F.col("n_bytes").alias("input_bytes"))
    out = spans.join(listed, ["trace_id", "span_id"], "left").join(held, "input_ref", "left")
    return out.withColumn("truncated", F.col("input_ref").isNotNull() & F.col("input_bytes").isNull())
