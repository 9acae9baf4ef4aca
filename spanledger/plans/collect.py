"""Queries on what is taken in: protobuf requests, rollups merged from batches, payloads stored by content."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from spanledger.operators import rollups
from spanledger.sources import objects, otlp

from .catalogue import SPANS, _read, query, spans


def _requests(spark, sf):
    """A request in wire format for each event; of each tenth the end is torn off."""

    @F.pandas_udf("binary")
    def body(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: otlp.encoded(json.loads(t)))

    e = _read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    attribute = lambda key, kind, v: F.struct(F.lit(key).alias("key"), F.struct(v.alias(kind)).alias("value"))
    nanos = lambda more: ((F.unix_micros(F.col("ts").cast("timestamp")) + more) * 1000).cast("string")
    kinds = "struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double>>"
    span = F.struct(
        F.md5(F.col("user_id").cast("string")).alias("traceId"), F.lpad(F.lower(F.hex("event_id")), 16, "0").alias("spanId"), F.col("event_type").alias("name"), nanos(F.lit(0)).alias("startTimeUnixNano"),
        F.when(F.col("event_id") % 3 > 0, nanos(F.lit(5000))).alias("endTimeUnixNano"), F.struct(F.when(F.col("event_type") == "error", 2).otherwise(1).alias("code")).alias("status"),
        F.array(
            F.from_json(F.to_json(attribute("k", "intValue", F.col("k"))), kinds), F.from_json(F.to_json(attribute("half", "doubleValue", F.col("k").cast("double") / 2)), kinds),
        ).alias("attributes"),
    )
    text = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.struct(F.lit("shop").alias("name")).alias("scope"), F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    whole = e.select("event_id", body(text).alias("body"))
    return whole.select("event_id", F.when(F.col("event_id") % 10 == 0, F.expr("substring(body, 1, length(body) - 3)")).otherwise(F.col("body")).alias("body"))


@query("""select md5(user_id::varchar) as trace_id, printf('%016x', event_id) as span_id, event_type as name, case when event_type = 'error' then 'error' else 'ok' end as status, (props->>'$.k') as k, (props->>'$.k')::int / 2 as half,
    epoch_us(ts::timestamp)::bigint as started_us, case when event_id % 3 > 0 then epoch_us(ts::timestamp) + 5000 end::bigint as ended_us, 'shop' as scope from events where event_id % 10 <> 0""")
def protobuf_spans(spark, sf):
    found, _ = otlp.decode_protobuf(_requests(spark, sf))
    return found.select("trace_id", "span_id", "name", "status", F.col("attributes")["k"].alias("k"), F.col("attributes")["half"].cast("double").alias("half"), F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "scope")


@query("select event_id, 'a field is longer than what is left' as error from events where event_id % 10 = 0")
def protobuf_torn(spark, sf):
    _, torn = otlp.decode_protobuf(_requests(spark, sf))
    return torn.select("event_id", "error")


@query(f"""with {SPANS}, r as (select trace_id, count(*)::bigint as n_spans, count(*) filter (where failed)::bigint as n_errors, count(*) filter (where span_id % 97 = 0)::bigint as n_open, sum(args)::bigint as tokens,
        round(sum((args / 1000)::decimal(18, 8))::double, 6) as cost, min(started_us)::bigint as started_us, max(case when span_id % 97 > 0 then ended_us end)::bigint as e from spans group by trace_id)
    select trace_id, n_spans, n_errors, n_open, tokens, cost, started_us, case when n_open = 0 then e end as ended_us, case when n_open = 0 then greatest(0, (e - started_us) // 1000) end::bigint as duration_ms,
    case when n_errors > 0 then 'error' when n_open > 0 then 'unset' else 'ok' end as status from r""")
def rollup_by_batches(spark, sf):
    """Spans in seven batches, whose parts are merged one after the other."""
    s = spans(spark, sf).select(
        "trace_id", "span_id", F.when(F.col("failed"), "error").otherwise("ok").alias("status"), "started_us", F.when(F.col("span_id") % 97 > 0, F.col("ended_us")).alias("ended_us"), F.col("args").alias("tokens"),
        (F.col("args") / 1000).alias("cost"),
    )
    whole = rollups.part(s.where("span_id % 7 = 0"))
    for batch in range(1, 7):
        whole = rollups.merged(whole, rollups.part(s.where(f"span_id % 7 = {batch}")))
    return rollups.finished(whole).withColumn("cost", F.round(F.col("cost").cast("double"), 6))


@query("""select sha256(text) as sha256, text, 1::bigint as n from (select distinct '{"a":' || (props->>'$.k') || ',"b":{"c":"' || event_type || '","d":[1,null]}}' as text from events)""")
def stored_payloads(spark, sf):
    """Payloads in two spellings, put in two overlapping batches; each is stored once."""
    e = _read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    spelled = F.when(F.col("event_id") % 2 == 0, F.format_string('{"b": {"d": [1, null], "c": "%s"}, "a": %s}', "event_type", "k")).otherwise(F.format_string('{"a":%s,"b":{"c":"%s","d":[1,null]}}', "k", "event_type"))
    rows, path = e.select("event_id", spelled.alias("payload")), objects.scratch(spark)
    objects.put(rows.where("event_id % 3 > 0"), path)
    objects.put(rows, path)
    stored = spark.read.schema(objects.SCHEMA).json(path).groupBy("sha256").agg(F.count("*").alias("n"))
    return objects.get(spark, path, objects.addressed(rows).select("sha256")).join(stored, "sha256")
