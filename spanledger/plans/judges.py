"""Queries on judges and on whole suites, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.operators import judging, significance

from .catalogue import _read, _rounded, query

TURNS = judging.Judge("reply", rubric="Grade the turn from 1 to 5.", model="scripted", inputs=("output",), votes=3)
KINDS = judging.Judge("kind", rubric="Name the turn.", model="scripted", inputs=("output",), mode="classify", labels=("short", "long"), passing=("short",))


def graded_by_length(content: str, seed: int | None) -> dict | str:
    """A model's part, played by arithmetic on the length: now and then it forgets the canary, leaves the scale or sends no JSON."""
    n = len(content)
    if n % 11 == 0:
        return {"score": 3, "canary": "none"}
    if n % 11 == 1:
        return {"score": 9}
    if n % 11 == 2:
        return "I would give this a 4."
    return {"score": 1 + (n * (seed - 41)) % 5}


def named_by_length(content: str, seed: int | None) -> dict:
    return {"label": "odd" if len(content) % 13 == 0 else "short" if len(content) < 200 else "long"}


def _turns(spark, sf):
    c = _read(spark, sf, "conversations")
    return c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("example_id"), F.col("text").alias("output"), F.col("role").alias("expected"))


_ROWS = "rows as (select conv_id || ':' || turn as example_id, text, length(text) as n from conversations)"


@query(f"""with {_ROWS}, v as (select example_id, n, unnest([0, 1, 2]) as vote from rows where text is not null),
    s as (select example_id, n, ((n * (vote + 1)) % 5) / 4.0 as x from v),
    g as (select example_id, n, median(x)::double as value, 1 - (max(x) - min(x))::double as confidence from s group by all)
    select rows.example_id, case when rows.n % 11 > 2 then round(value, 6) end as value, case when rows.n % 11 > 2 then round(confidence, 6) end as confidence,
    case when text is null then 'input not found: output' when rows.n % 11 = 0 then 'canary not repeated: the content may have steered the judge'
        when rows.n % 11 = 1 then 'grade off the scale' when rows.n % 11 = 2 then 'answer is no JSON object' end as error,
    case when text is not null then 0.006::double end as cost from rows left join g on g.example_id = rows.example_id""")
def judge_scores(spark, sf):
    """Every turn graded three times by a scripted client; the median counts."""
    out = judging.judged(_turns(spark, sf), TURNS, lambda: judging.Scripted(graded_by_length, cost=0.002), salt="query")
    return _rounded(out.select("example_id", "value", "confidence", "error", F.col("cost").cast("double").alias("cost")))


@query(f"""with {_ROWS} select label, value, error, count(*)::bigint as n from (
    select case when n % 13 = 0 then null when n < 200 then 'short' else 'long' end as label, case when n % 13 = 0 then null when n < 200 then 1.0 else 0.0 end::double as value,
    case when text is null then 'input not found: output' when n % 13 = 0 then 'unknown label' end as error from rows) group by all""")
def judge_labels(spark, sf):
    """Turns classified by a scripted client, counted by label."""
    out = judging.judged(_turns(spark, sf), KINDS, lambda: judging.Scripted(named_by_length), salt="query")
    return out.groupBy("label", "value", "error").agg(F.count("*").alias("n"))


_RULES = {"length": ("quality", 700, 400), "brevity": ("toxic", 900, 300)}


def _length_scores(spark, sf, run: int):
    """Two metrics of 0 and 1: whether a label is what a document's length says, by a bound of each run's."""
    d = _read(spark, sf, "labels").join(_read(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    hit = lambda name: F.struct(F.lit(name).alias("metric"), (F.when(F.col("n_chars") >= _RULES[name][1 + run], 1).otherwise(0) == F.col(_RULES[name][0])).cast("double").alias("value"))
    return d.select(F.col("doc_id").alias("example_id"), "lang", F.lit(None).cast("string").alias("error"), F.explode(F.array(*map(hit, _RULES))).alias("s")).select("example_id", "lang", "error", "s.*")


def _long(run: int) -> str:
    parts = [f"select l.doc_id, lang, '{name}' as metric, (case when n_chars >= {r[1 + run]} then 1 else 0 end = {r[0]})::int::double as value from labels l join documents d on d.doc_id = l.doc_id" for name, r in _RULES.items()]
    return " union all ".join(parts)


_MEANS = "select metric, slice, avg(value) as mean from (select metric, '' as slice, value from {0} union all select metric, 'lang=' || lang, value from {0} where lang is not null) where value is not null group by all"


@query(f"""with c as ({_long(0)}), b as ({_long(1)}), cm as ({_MEANS.format("c")}), bm as ({_MEANS.format("b")}),
    pairs as (select c.metric, c.value as v, b.value as b from c join b on b.doc_id = c.doc_id and b.metric = c.metric where c.value is not null and b.value is not null),
    t as (select metric, count(*) as n, count(*) filter (where b = 1 and v = 0) as lost, count(*) filter (where b = 0 and v = 1) as won, stddev_samp(v - b) as sd from pairs group by metric),
    p as (select *, least(1.0, (select sum(exp(lgamma(lost + won + 1) - lgamma(k + 1) - lgamma(lost + won - k + 1) - (lost + won) * ln(2))) from range(lost, lost + won + 1) as r(k))) as p from t),
    h as (select *, max(least(1.0, (2 - place + 1) * p)) over (order by place) as p_adjusted from (select *, row_number() over (order by p, metric) as place from p))
    select coalesce(cm.metric, bm.metric) as metric, coalesce(cm.slice, bm.slice) as slice, round(cm.mean, 6) as candidate, round(bm.mean, 6) as baseline, round(cm.mean - bm.mean, 6) as delta,
        round(h.p, 6) as p, round(h.p_adjusted, 6) as p_adjusted, round((1.6448536269514722 + 0.8416212335729143) * h.sd / sqrt(h.n), 6) as mde, h.p_adjusted <= 0.05 as significant
    from cm full join bm on bm.metric = cm.metric and bm.slice = cm.slice left join h on h.metric = cm.metric and cm.slice = ''""")
def run_comparison(spark, sf):
    """Means of two runs by language, with the exact test of each metric beside its whole."""
    out = significance.compared_runs(_length_scores(spark, sf, 0), _length_scores(spark, sf, 1), ["lang"])
    return _rounded(out.select("metric", "slice", "candidate", "baseline", "delta", "p", "p_adjusted", "mde", "significant"))


@query()
def sliced_intervals(spark, sf):
    """Means by language with bootstrap intervals."""
    return significance.metrics_with_intervals(_length_scores(spark, sf, 0), ["lang"], resamples=2000)
