"""Queries on datasets and on what is looked up for them: filters, resumed runs, order, rules of evaluations, sources of claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.operators import runs
from spanledger.sources import datasets

from .catalogue import _read, query


def _examples(spark, sf):
    d = _read(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ordinal"), "lang", "source", "n_chars")


@query("""select doc_id::varchar as id, lang, n_chars from documents d where n_chars >= 500 and lang in ('en', 'de') and not (source = 'src1') and exists (select 1 from labels l where l.doc_id = d.doc_id) order by doc_id limit 100""")
def dataset_filter(spark, sf):
    """The first 100 examples that a predicate holds for and that a list names; the limit is the filter's."""
    names = {"chars": (F.col("n_chars").cast("double"), "number"), "lang": (F.col("lang"), "string"), "source": (F.col("source"), "string")}
    ids = _read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return datasets.filtered(_examples(spark, sf), "chars >= 500 and lang in ['en', 'de'] and not source == 'src1'", names, ids, 100).select("id", "lang", "n_chars")


@query("""select o_orderkey::varchar as id, o_totalprice from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag <> 'R' )""")
def examples_left(spark, sf):
    """Orders as examples and their items as a journal, whose returned ones are done anew."""
    o, journal = _read(spark, sf, "orders"), _read(spark, sf, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "error").otherwise("ok")
    return datasets.left_to_run(o.select(F.col("o_orderkey").cast("string").alias("id"), "o_totalprice"), journal.select(F.col("l_orderkey").cast("string").alias("example_id"), status.alias("status")))


@query("""with s as (select d.doc_id, unnest(['quality', 'length']) as metric, unnest([quality::double, n_chars::double]) as value from documents d join labels l on l.doc_id = d.doc_id)
    select metric, doc_id // 1000 as chunk, count(*)::int as n, sum(value)::double as total, md5(string_agg(value::bigint::varchar, ',' order by doc_id, value)) as digest from s where value is not null group by all""")
def values_in_order(spark, sf):
    """Values of two metrics in the dataset's order, in chunks of a thousand ordinals."""
    d = _examples(spark, sf)
    s = _read(spark, sf, "labels").join(_read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    long = s.select(F.col("doc_id").cast("string").alias("example_id"), F.expr("stack(2, 'quality', cast(quality as double), 'length', cast(n_chars as double)) as (metric, value)"))
    out = datasets.value_chunks(long, d)
    text = F.array_join(F.transform("values", lambda v: v.cast("bigint").cast("string")), ",")
    return out.select("metric", "chunk", "n", F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("total"), F.md5(text).alias("digest"))


@query("""with r as (select event_type as name, dense_rank() over (order by event_type) as rule_id from (select distinct event_type from events where event_type <> 'view')),
    e as (select event_id, user_id, ts, event_type, length(event_type) as l from events)
    select event_id, user_id as trace_id, coalesce(r.name, 'gone:' || event_type) as rule, row_number() over (partition by user_id order by ts desc, event_id)::int as place from e left join r on r.name = event_type""")
def evaluations_with_rules(spark, sf):
    """Events as evaluations by rules named after their type; the rule of `view` is gone. An event's id orders those of one time."""
    e = _read(spark, sf, "events").select("event_id", F.col("user_id").alias("trace_id"), F.when(F.col("event_type") == "view", "gone:view").otherwise(F.col("event_type")).alias("type"), "ts")
    rules = e.where("type <> 'gone:view'").select(F.col("type").alias("rule_id"), F.col("type").alias("name"), F.lit(True).alias("enabled")).distinct()
    given = e.select("event_id", "trace_id", F.col("type").alias("rule_id"), F.struct("ts", -F.col("event_id")).alias("created_at"))
    return runs.evaluations_of(given, rules).select("event_id", "trace_id", "rule", "place")


@query("""select l.doc_id as claim_id, l.doc_id * 2 as source_id, d.source as title, d.doc_id is not null as grounded from labels l left join documents d on d.doc_id = l.doc_id * 2""")
def claims_with_sources(spark, sf):
    """Labels as claims that cite the document of twice their id, which may not be there."""
    claims = _read(spark, sf, "labels").select(F.col("doc_id").alias("claim_id"), (F.col("doc_id") * 2).alias("source_id"))
    documents = _read(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    return runs.sourced_claims(claims, documents).select("claim_id", "source_id", "title", "grounded")


@query("""with u as (select distinct source, lang from documents where lang is not null and source is not null)
    select source, coalesce(array_to_string(list_sort(list(lang) filter (where lang not in ('en', 'de'))), ','), '') as others, count(*) filter (where lang not in ('en', 'de')) = 0 as approved from u group by source""")
def outside_vocabulary(spark, sf):
    d = _read(spark, sf, "documents").where("source is not null")
    return runs.outside_vocabulary(d, ["source"], "lang", ["en", "de"]).select("source", F.array_join("others", ",").alias("others"), "approved")
