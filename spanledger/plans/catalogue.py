"""Queries of the evaluation operators on the driver's tables, each with DuckDB SQL for the same rows.

A trace is a user's week of `events`, a span an event: its action is the event type, an `error` failed, its arguments
are the number in props, and it lasts `value` seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions import hashing, predicates, redaction, text
from spanledger.operators import comparison, scores, traces, trajectory

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, *names: str):
    found = [spark.read.parquet(f"{sf}/{n}.parquet") for n in names]
    return found[0] if len(found) == 1 else found


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def spans(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    start = F.unix_micros("ts")
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format(F.date_trunc("week", "ts"), "yyyyMMdd")).alias("trace_id"), F.col("event_id").alias("span_id"),
        F.when(k % 4 != 0, F.col("event_id") - k % 50).alias("parent_id"), F.col("event_type").alias("action"), (F.col("event_type") == "error").alias("failed"), k.alias("args"),
        start.alias("started_us"), (start + F.floor(F.col("value") * 1000000)).alias("ended_us"),
    )


SPANS = """spans as (select user_id || '-' || strftime(date_trunc('week', ts), '%Y%m%d') as trace_id, event_id as span_id,
    case when (props->>'$.k')::int % 4 <> 0 then event_id - (props->>'$.k')::int % 50 end as parent_id, event_type as action, event_type = 'error' as failed,
    (props->>'$.k')::int as args, epoch_us(ts::timestamp) as started_us, epoch_us(ts::timestamp) + floor(value * 1000000)::bigint as ended_us from events)"""
INDEXED = f"{SPANS}, indexed as (select *, row_number() over (partition by trace_id order by started_us, span_id) - 1 as index from spans)"
RETRIES = f"""{SPANS}, lagged as (select *, coalesce(lag(failed) over (partition by trace_id, action, args order by started_us, span_id), false) as after from spans),
    islands as (select *, sum(case when after then 0 else 1 end) over (partition by trace_id, action, args order by started_us, span_id rows unbounded preceding) as island from lagged),
    retried as (select *, row_number() over (partition by trace_id, action, args, island order by started_us, span_id) as attempt from islands)"""
GROUPED = f"""{SPANS}, reach as (select *, max(ended_us) over (partition by trace_id, parent_id order by started_us, span_id rows between unbounded preceding and 1 preceding) as reached from spans),
    runs as (select *, sum(case when coalesce(started_us >= reached, true) then 1 else 0 end) over (partition by trace_id, parent_id order by started_us, span_id rows unbounded preceding) as run from reach),
    grouped as (select *, case when count(*) over (partition by trace_id, parent_id, run) > 1 then first_value(span_id) over (partition by trace_id, parent_id, run order by started_us, span_id) end as parallel_group from runs)"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _read(spark, sf, "documents", "labels")
    return labels.join(docs.select("doc_id", "lang", "source", "n_chars"), "doc_id")


LABELLED = "labelled as (select l.*, lang, source, n_chars from labels l join documents d on l.doc_id = d.doc_id)"


@query(f"""with {LABELLED}, rows as (select (case when n_chars >= 500 then 1 else 0 end = quality)::int::double as value, lang, source, n_chars % 11 = 0 as bad from labelled),
    keyed as (select '' as slice, * from rows union all select 'lang=' || lang, * from rows where lang is not null union all select 'source=' || source, * from rows where source is not null)
    select 'length_rule' as metric, slice, round(coalesce(avg(value) filter (where not bad), 0), 6) as mean, count(*) filter (where not bad)::bigint as n, count(*) filter (where bad)::bigint as n_errors,
    round(coalesce(stddev_samp(value) filter (where not bad), 0), 6) as stddev from keyed group by slice""")
def score_aggregate_sliced(spark, sf):
    hit = (F.when(F.col("n_chars") >= 500, 1).otherwise(0) == F.col("quality")).cast("double")
    rows = _labelled(spark, sf).select(F.lit("length_rule").alias("metric"), hit.alias("value"), F.when(F.col("n_chars") % 11 == 0, "bad").alias("error"), "lang", "source")
    return _rounded(scores.aggregate_scores(rows, ["lang", "source"]))


@query("""select o_orderpriority, round(quantile_cont(o_totalprice, 0.5) filter (where o_orderstatus <> 'P'), 4) as p50, round(quantile_cont(o_totalprice, 0.95) filter (where o_orderstatus <> 'P'), 4) as p95,
    round(quantile_cont(o_totalprice, 0.99) filter (where o_orderstatus <> 'P'), 4) as p99, round(avg(o_totalprice) filter (where o_orderstatus <> 'P'), 4) as mean,
    round(avg(case when o_orderstatus <> 'P' then 0.0::double else 1.0 end), 4) as error_rate, count(*)::bigint as n from orders group by 1""")
def operational_family(spark, sf):
    return _rounded(scores.operational(_read(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", F.col("o_orderstatus") != "P"), 4)


@query(f"""with {LABELLED}, c as (select lang, sum(quality)::double as s, count(*)::double as n from labelled group by lang), z as (select 1.959963984540054::double as z)
    select lang, round(greatest(0, (s/n + z*z/(2*n) - z*sqrt(s/n*(1-s/n)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) as low, round(least(1, (s/n + z*z/(2*n) + z*sqrt(s/n*(1-s/n)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) as high from c, z""")
def wilson_interval(spark, sf):
    rows = _labelled(spark, sf).groupBy("lang").agg(F.sum("quality").cast("double").alias("s"), F.count("*").cast("double").alias("n"))
    low, high = scores.wilson(F.col("s"), F.col("n"))
    return _rounded(rows.select("lang", low.alias("low"), high.alias("high")))


def _judged(spark, sf) -> DataFrame:
    """Order priority as the human's label, a band of the price as the judge's."""
    band = F.concat(F.least(F.lit(5), (F.col("o_totalprice") / 60000).cast("int") + 1).cast("string"))
    return _read(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).alias("human"), band.alias("judge"))


JUDGED = "judged as (select substr(o_orderpriority, 1, 1) as human, least(5, trunc(o_totalprice / 60000)::int + 1)::varchar as judge from orders)"


@query(f"with {JUDGED} select human as actual, judge as predicted, count(*)::bigint as n from judged group by all")
def confusion_matrix(spark, sf):
    return scores.confusion(_judged(spark, sf).toDF("actual", "predicted"))


_CLASSES = f"""with {JUDGED}, labels_ as (select human as label from judged union select judge from judged),
    rated as (select label, count(*) filter (where human = label) as support, count(*) filter (where judge = label) as called, count(*) filter (where human = label and judge = label) as hits from labels_, judged group by label),
    pr as (select label, support::bigint as support, coalesce(hits / nullif(called, 0), 0)::double as precision, coalesce(hits / nullif(support, 0), 0)::double as recall from rated),
    f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from pr)"""


@query(f"{_CLASSES} select label, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from f")
def classification_report(spark, sf):
    return _rounded(scores.classification(_judged(spark, sf).toDF("actual", "predicted")))


@query(f"""{_CLASSES} select round(sum(recall * support) / sum(support), 6) as accuracy, round(avg(f1), 6) as macro_f1, round(avg(recall), 6) as macro_recall,
    round(sum(f1 * support) / sum(support), 6) as weighted_f1, sum(support)::bigint as n from f""")
def macro_weighted_f1(spark, sf):
    return _rounded(scores.macro_weighted(_judged(spark, sf).toDF("actual", "predicted")))


@query("""with ranked as (select o_custkey as query, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank, o_orderpriority = '1-URGENT' as relevant from orders),
    hit as (select *, sum(relevant::int) over (partition by query order by rank) as hits from ranked),
    q as (select query, sum(relevant::int) filter (where rank <= 5) as found, count(*) filter (where rank <= 5) as shown, sum(relevant::int) as rel,
        coalesce(sum(1 / log2(rank + 1)) filter (where rank <= 5 and relevant), 0) as dcg, coalesce(max(1 / rank) filter (where relevant), 0) as rr, coalesce(sum(hits / rank) filter (where rank <= 5 and relevant), 0) as ap from hit group by query)
    select query, round(found / shown, 6) as precision, round(case when rel = 0 then 0 else found / rel end, 6) as recall,
        round(case when rel = 0 then 0 else dcg / list_sum(list_transform(range(1, least(rel, 5)::bigint + 1), lambda i: 1 / log2(i + 1))) end, 6) as ndcg, round(rr, 6) as rr, round(case when rel = 0 then 0 else ap / least(rel, 5) end, 6) as ap from q""")
def ranking_metrics_at_k(spark, sf):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    ranked = _read(spark, sf, "orders").select(F.col("o_custkey").alias("query"), rank.alias("rank"), (F.col("o_orderpriority") == "1-URGENT").alias("relevant"))
    return _rounded(scores.ranking_at_k(ranked, 5))


@query(f"""with {LABELLED}, r as (select least(1.0::double, n_chars / 5000) as c, quality as y from labelled), b as (select least(greatest(trunc(c * 10)::int, 0), 9) as bin, count(*) as n, avg(c) as conf, avg(y) as acc, sum((c - y) ** 2) as sq from r group by 1)
    select round(sum(n * abs(acc - conf)) / sum(n), 6) as ece, round(sum(sq) / sum(n), 6) as brier, sum(n)::bigint as n from b""")
def ece_brier(spark, sf):
    return _rounded(scores.ece_brier(_labelled(spark, sf).select(F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("confidence"), F.col("quality").alias("correct"))))


@query(f"""with {LABELLED}, r as (select quality = 1 as pos, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2 as mid from labelled), s as (select sum(mid) filter (where pos) as ranks, count(*) filter (where pos) as p, count(*) filter (where not pos) as q from r)
    select round((ranks - p * (p + 1) / 2) / (p * q), 6) as auc, p::bigint as n_positive, q::bigint as n_negative from s""")
def roc_auc_midrank(spark, sf):
    return _rounded(scores.roc_auc(_labelled(spark, sf).select(F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("positive"))))


def _kappa_sql(distance: str) -> str:
    return f"""with {JUDGED}, x as (select human::int as i, judge::int as j from judged), seen as (select avg({distance}) as d, avg((i = j)::int) as agreement, count(*) as n from x),
        a as (select i, count(*) as c from x group by i), b as (select j, count(*) as c from x group by j), chance as (select sum(a.c * b.c * ({distance})) / any_value(n * n) as e from a, b, seen)
        select round(agreement, 6) as agreement, round(1 - d / e, 6) as kappa, n::bigint as n from seen, chance"""


for _name, _weights, _distance in (("cohen_kappa", "none", "(i <> j)::int::double"), ("cohen_kappa_linear", "linear", "abs(i - j)::double"), ("cohen_kappa_quadratic", "quadratic", "((i - j) * (i - j))::double")):
    QUERIES[_name] = lambda spark, sf, w=_weights: _rounded(scores.kappa(_judged(spark, sf), list("12345"), w))
    ORACLE_SQL[_name] = _kappa_sql(_distance)


@query(f"""with {JUDGED} select round(avg((judge in ('1', '2'))::int) filter (where human not in ('1', '2')), 6) as false_pass, round(avg((judge not in ('1', '2'))::int) filter (where human in ('1', '2')), 6) as false_fail, count(*)::bigint as n from judged""")
def directional_error_rates(spark, sf):
    return _rounded(scores.directional_rates(_judged(spark, sf), ["1", "2"]))


@query(f"""with {JUDGED}, c as (select human, judge, count(*) as n from judged group by all), t as (select human, judge from c where human <> judge qualify row_number() over (partition by human order by n desc, judge) = 1)
    select c.human, sum(n)::bigint as support, round(coalesce(sum(n) filter (where c.human = c.judge), 0) / sum(n), 6) as recall, any_value(t.judge) as confused_with from c left join t on c.human = t.human group by c.human""")
def per_class_top_confusion(spark, sf):
    return _rounded(scores.top_confusion(_judged(spark, sf)))


def _run(spark, sf, line: int) -> DataFrame:
    """A run of scores by order: whether its line of this number was taken back, and its discount."""
    l = _read(spark, sf, "lineitem").where(F.col("l_linenumber") == line)
    return l.select(F.col("l_orderkey").alias("example_id"), F.explode(F.create_map(F.lit("kept"), (F.col("l_returnflag") != "R").cast("double"), F.lit("discount"), F.col("l_discount"))).alias("metric", "value"))


_RUNS = """runs as (select l_orderkey as example_id, l_linenumber as run, 'kept' as metric, (l_returnflag <> 'R')::int::double as value from lineitem where l_linenumber <= 2 union all select l_orderkey, l_linenumber, 'discount', l_discount from lineitem where l_linenumber <= 2),
    pairs as (select c.metric, c.value as v, b.value as b from runs c join runs b on c.run = 2 and b.run = 1 and c.example_id = b.example_id and c.metric = b.metric)"""


@query(f"""with {_RUNS} select metric, count(*)::bigint as n, round(avg(v - b), 6) as mean, round(coalesce(stddev_samp(v - b), 0), 6) as stddev, bool_and(v in (0, 1) and b in (0, 1)) as "binary",
    count(*) filter (where b = 1 and v = 0)::bigint as lost, count(*) filter (where b = 0 and v = 1)::bigint as won, round(2.4864748605243863::double * coalesce(stddev_samp(v - b), 0) / sqrt(count(*)), 6) as mde from pairs group by metric""")
def paired_diff(spark, sf):
    return _rounded(comparison.paired(_run(spark, sf, 2), _run(spark, sf, 1)))


@query(f"with {_RUNS} select metric, count(*) filter (where v < b)::bigint as regressed, count(*) filter (where v > b)::bigint as improved, count(*) filter (where v = b)::bigint as unchanged from pairs group by metric")
def example_regressions(spark, sf):
    return comparison.changed_examples(_run(spark, sf, 2), _run(spark, sf, 1))


@query(f"""with {_RUNS}, c as (select count(*) filter (where b = 1 and v = 0) as lost, count(*) filter (where b = 0 and v = 1) as won from pairs where metric = 'kept'),
    t as (select lost, won, k, lgamma(lost + won + 1) - lgamma(k + 1) - lgamma(lost + won - k + 1) - (lost + won) * ln(2) as lp from c, lateral (select unnest(range(lost, lost + won + 1)) as k))
    select any_value(lost)::bigint as lost, any_value(won)::bigint as won, round(least(1, sum(exp(lp))), 6) as p from t""")
def mcnemar_counts(spark, sf):
    row = comparison.paired(_run(spark, sf, 2), _run(spark, sf, 1)).where("metric = 'kept'").select("lost", "won")
    return _rounded(row.select("lost", "won", comparison.mcnemar_p(F.col("lost"), F.col("won")).alias("p")))


@query("""with t as (select source as metric, abs(avg(n_chars) - 1500) / 10000 as p from documents group by source), s as (select metric, p, least(1, (count(*) over () - row_number() over (order by p, metric) + 1) * p) as scaled from t)
    select metric, round(p, 6) as p, round(max(scaled) over (order by p, metric rows unbounded preceding), 6) as p_adjusted from s""")
def holm_adjust(spark, sf):
    tests = _read(spark, sf, "documents").groupBy(F.col("source").alias("metric")).agg((F.abs(F.avg("n_chars") - 1500) / 10000).alias("p"))
    return _rounded(comparison.holm(tests))


def _yearly(spark, sf, year: int) -> DataFrame:
    return _read(spark, sf, "lineitem").where(f"l_shipdate >= timestamp '{year}-01-01' and l_shipdate < timestamp '{year + 1}-01-01'").groupBy(F.lit("quantity").alias("metric"), F.concat("l_returnflag", "l_linestatus").alias("slice")).agg(F.avg("l_quantity").alias("value"))


@query("""with y as (select year(l_shipdate) as y, l_returnflag || l_linestatus as slice, avg(l_quantity) as value from lineitem group by all), c as (select * from y where y = 1996), b as (select * from y where y = 1994)
    select 'quantity' as metric, coalesce(c.slice, b.slice) as slice, round(c.value, 6) as candidate, round(b.value, 6) as baseline, round(c.value - b.value, 6) as delta, round((c.value - b.value) / abs(b.value), 6) as relative,
    case when b.value is null then 'candidate' when c.value is null then 'baseline' end as only_in from c full join b on c.slice = b.slice""")
def metric_full_outer_compare(spark, sf):
    return _rounded(comparison.compare_metrics(_yearly(spark, sf, 1996), _yearly(spark, sf, 1994)))


def _gate_rows(spark, sf) -> DataFrame:
    rules = spark.createDataFrame(
        [("floor", "discount", "", 0.9, None, None, None, False, 0.5, True), ("kept_floor", "kept", "", 0.5, None, None, None, False, 0.5, True), ("soft", "discount", "", None, 0.01, None, None, False, None, False), ("drift", "kept", "", None, None, 0.5, 0.5, True, None, True), ("absent", "nothing", "", 0.1, None, None, None, False, None, True)],
        "rule string, metric string, slice string, minimum double, maximum double, max_regression double, max_relative double, require_baseline boolean, max_error_rate double, blocking boolean",
    )
    now, before = (_run(spark, sf, n).groupBy("metric").agg(F.avg("value").alias("value"), F.count("*").alias("n")) for n in (2, 1))
    metrics = now.join(before.select("metric", F.col("value").alias("baseline")), "metric", "left").select("metric", F.lit("").alias("slice"), "value", "n", F.lit(0).cast("long").alias("n_errors"), "baseline")
    return comparison.evaluate_gates(rules, metrics)


_GATES = f"""with {_RUNS}, m as (select metric, avg(value) filter (where run = 2) as value, avg(value) filter (where run = 1) as baseline from runs group by metric),
    g as (select 'floor' as rule, 'discount' as metric, value, case when value < 0.9 then 'minimum' else 'ok' end as clause, case when value < 0.9 then 'fail' else 'pass' end as verdict from m where metric = 'discount'
        union all select 'kept_floor', 'kept', value, case when value < 0.5 then 'minimum' else 'ok' end, case when value < 0.5 then 'fail' else 'pass' end from m where metric = 'kept'
        union all select 'soft', 'discount', value, case when value > 0.01 then 'maximum' else 'ok' end, case when value > 0.01 then 'warn' else 'pass' end from m where metric = 'discount'
        union all select 'drift', 'kept', value, case when baseline - value > 0.5 then 'regression' when (baseline - value) / abs(baseline) > 0.5 then 'relative_regression' else 'ok' end, case when baseline - value > 0.5 or (baseline - value) / abs(baseline) > 0.5 then 'fail' else 'pass' end from m where metric = 'kept'
        union all select 'absent', 'nothing', null, 'metric_missing', 'error')"""


@query(f"{_GATES} select rule, metric, '' as slice, round(value, 6) as value, clause, verdict from g")
def gate_verdicts(spark, sf):
    return _rounded(_gate_rows(spark, sf))


@query(f"{_GATES} select case max(case verdict when 'pass' then 0 when 'warn' then 1 when 'fail' then 2 else 3 end) when 0 then 'pass' when 1 then 'warn' when 2 then 'fail' else 'error' end as verdict, case max(case verdict when 'pass' then 0 when 'warn' then 0 when 'fail' then 1 else 2 end) when 0 then 0 when 1 then 1 else 2 end as exit_code, count(*)::bigint as n_rules from g")
def verdict_combine(spark, sf):
    return comparison.combined_verdict(_gate_rows(spark, sf))


@query(f"with {INDEXED} select trace_id, span_id, index::int as index from indexed")
def traj_index(spark, sf):
    return trajectory.indexed(spans(spark, sf)).select("trace_id", "span_id", "index")


@query(f"with {RETRIES} select trace_id, span_id, attempt::int as attempt from retried")
def traj_retries(spark, sf):
    return trajectory.with_retries(spans(spark, sf)).select("trace_id", "span_id", "attempt")


@query(f"with {GROUPED} select trace_id, span_id, parallel_group from grouped")
def traj_parallel_groups(spark, sf):
    return trajectory.with_parallel_groups(spans(spark, sf)).select("trace_id", "span_id", "parallel_group")


@query(f"with {SPANS} select trace_id, action, arg_max(args, started_us * 10000000 + span_id) as value from (select * replace (started_us::hugeint as started_us) from spans) group by all")
def traj_state_merge(spark, sf):
    return trajectory.final_state(spans(spark, sf))


_STEPS = ["view", "click", "purchase"]


@query(f"""with {INDEXED}, a as (select trace_id, min(index) filter (where action = 'view') as i from indexed group by trace_id),
    b as (select a.trace_id, any_value(i) as i, min(index) filter (where action = 'click' and index > i) as j from a join indexed on a.trace_id = indexed.trace_id group by a.trace_id),
    c as (select b.trace_id, any_value(i) as i, any_value(j) as j, min(index) filter (where action = 'purchase' and index > j) as k from b join indexed on b.trace_id = indexed.trace_id group by b.trace_id)
    select trace_id, ((i is not null)::int + (j is not null)::int + (k is not null)::int)::int as matched, k is not null as passed from c""")
def rule_required_order(spark, sf):
    return trajectory.required_order(spans(spark, sf), _STEPS)


@query(f"with {INDEXED}, n as (select trace_id, action = 'view' and coalesce(lead(action, 1) over w = 'click', false) and coalesce(lead(action, 2) over w = 'purchase', false) as run from indexed window w as (partition by trace_id order by index)) select trace_id, bool_or(run) as passed from n group by trace_id")
def rule_required_contiguous(spark, sf):
    return trajectory.required_contiguous(spans(spark, sf), _STEPS)


@query(f"with {SPANS} select trace_id, count(*) filter (where action = 'signup')::bigint as calls, count(*) filter (where action = 'signup') >= 2 as passed from spans group by trace_id")
def rule_required_action(spark, sf):
    s = spans(spark, sf)
    return trajectory.counted(s.select("trace_id").distinct(), s, "signup", least=2)


@query(f"with {RETRIES} select trace_id, count(*) filter (where action = 'error' and attempt = 1)::bigint as calls, count(*) filter (where action = 'error' and attempt = 1) <= 3 as passed from retried group by trace_id")
def rule_limit(spark, sf):
    s = spans(spark, sf)
    return trajectory.counted(s.select("trace_id").distinct(), s, "error", most=3, retries=False)


@query(f"with {INDEXED} select trace_id, action, count(*)::bigint as n, min(index)::int as first_index from indexed where action in ('error', 'signup') group by all")
def rule_forbidden_action(spark, sf):
    return trajectory.forbidden(spans(spark, sf), ["error", "signup"])


@query(f"""with {GROUPED}, gate as (select trace_id, started_us as g, parallel_group as pg from grouped where action = 'view' qualify row_number() over (partition by trace_id order by started_us, span_id) = 1)
    select x.trace_id, span_id from grouped x left join gate on x.trace_id = gate.trace_id where action = 'purchase' and (g is null or started_us < g and not coalesce(parallel_group = pg, false))""")
def rule_forbidden_before(spark, sf):
    return trajectory.forbidden_before(spans(spark, sf), "purchase", "view")


@query(f"with {SPANS}, g as (select trace_id, min(started_us) as g from spans where action = 'purchase' group by trace_id) select s.trace_id, span_id from spans s join g on s.trace_id = g.trace_id where action = 'signup' and started_us > g")
def rule_forbidden_after(spark, sf):
    return trajectory.forbidden_after(spans(spark, sf), "signup", "purchase")


@query(f"with {SPANS}, n as (select trace_id, span_id, row_number() over w as n, first_value(span_id) over w as first_span_id from spans window w as (partition by trace_id, action, args order by started_us, span_id)) select trace_id, span_id, first_span_id from n where n > 1")
def rule_unique_action(spark, sf):
    return trajectory.duplicates(spans(spark, sf), ["action", "args"])


@query(f"with {INDEXED}, n as (select *, count(*) over (partition by trace_id, action order by index range between current row and 4 following) as n from indexed) select trace_id, min(index)::int as first_index, arg_min(action, index) as action from n where n >= 3 group by trace_id")
def rule_no_loop(spark, sf):
    return trajectory.loops(spans(spark, sf), ["action"], 5, 3)


@query(f"with {RETRIES} select trace_id, action, (max(attempt) - 1)::int as retries from retried group by all having max(attempt) > 1")
def rule_max_retries(spark, sf):
    return trajectory.retries(spans(spark, sf), 0)


@query(f"with {SPANS} select trace_id, span_id from spans where action = 'purchase' and not coalesce(args >= 10 and args < 90, false)")
def rule_argument_condition(spark, sf):
    holds = predicates.compile_predicate("10 <= args.k < 90", {"args.k": (F.col("args"), "number")})
    return trajectory.condition(spans(spark, sf), "purchase", holds)


@query(f"""with {SPANS}, s as (select trace_id, bool_or(action = 'purchase') as p, bool_or(action = 'view') as v, bool_or(action = 'click') as c, bool_or(action = 'error') as e from spans group by trace_id)
    select trace_id, case when p then (not v)::int + (not c)::int else 0 end::int as missing, case when p then e::int else 0 end::int as forbidden, not p or v and c and not e as passed from s""")
def rule_conditional(spark, sf):
    s = spans(spark, sf)
    return trajectory.conditional(s.select("trace_id").distinct(), s, "purchase", ["view", "click"], ["error"])


@query(f"""with {RETRIES}, t as (select distinct trace_id from spans), g as (select trace_id, min(started_us) as g from spans where action = 'purchase' group by trace_id),
    f as (select s.trace_id, 'after' as rule, true as blocking from spans s join g on s.trace_id = g.trace_id where action = 'signup' and started_us > g
        union all select trace_id, 'retries', false from retried group by trace_id, action having max(attempt) > 1),
    o as (select trace_id from t where trace_id like '1%')
    select t.trace_id, count(*) filter (where blocking)::bigint as n_blocking, count(*) filter (where not blocking)::bigint as n_warnings, count(distinct rule)::bigint as n_rules,
        case when count(*) filter (where blocking) > 0 then 'fail' when any_value(o.trace_id) is not null then 'inconclusive' else 'pass' end as verdict
    from t left join f on f.trace_id = t.trace_id left join o on o.trace_id = t.trace_id group by t.trace_id""")
def policy_result(spark, sf):
    s = spans(spark, sf)
    ids = s.select("trace_id").distinct()
    rules = {"after": (trajectory.forbidden_after(s, "signup", "purchase"), True), "retries": (trajectory.retries(s, 0), False)}
    return trajectory.policy_result(ids, rules, ids.where("trace_id like '1%'"))


@query(f"with {SPANS} select trace_id, count(*)::bigint as n_spans, count(*) filter (where failed)::bigint as n_errors, min(started_us) as started_us, max(ended_us) as ended_us, greatest(0, (max(ended_us) - min(started_us)) // 1000)::bigint as duration_ms from spans group by trace_id")
def trace_rollup(spark, sf):
    return traces.rollup(spans(spark, sf))


@query(f"with {SPANS} select trace_id, args, span_id from spans qualify row_number() over (partition by trace_id, args order by started_us desc, span_id desc) = 1")
def dedupe_last_wins(spark, sf):
    return traces.last_wins(spans(spark, sf).select("trace_id", "args", "span_id", "started_us"), ["trace_id", "args"], ["started_us", "span_id"]).drop("started_us")


@query(f"with {SPANS}, e as (select distinct trace_id from spans where action = 'purchase' and args % 3 = 0) select trace_id, count(*)::bigint as n_spans from spans where trace_id not in (select trace_id from e) group by trace_id")
def pending_anti_join(spark, sf):
    s = spans(spark, sf)
    return traces.pending(traces.rollup(s), s.where("action = 'purchase' and args % 3 = 0")).select("trace_id", "n_spans")


@query(f"with {SPANS} select trace_id, span_id, parent_id from spans s where parent_id is not null and not exists (select 1 from spans p where p.trace_id = s.trace_id and p.span_id = s.parent_id)")
def orphan_spans(spark, sf):
    return traces.orphans(spans(spark, sf)).select("trace_id", "span_id", "parent_id")


@query("select o_orderdate::timestamp as o_orderdate, o_orderkey from orders where (o_orderdate, o_orderkey) < (timestamp '1996-01-01', 5000) order by o_orderdate desc, o_orderkey desc limit 50")
def keyset_page(spark, sf):
    rows = _read(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderkey")
    return traces.page_after(rows, ["o_orderdate", "o_orderkey"], ("1996-01-01 00:00:00", 5000), 50)


@query(f"""with {SPANS}, cut as (select p.trace_id, p.span_id, greatest(k.started_us, p.started_us) as s, least(k.ended_us, p.ended_us) as e, k.span_id as kid from spans k join spans p on k.trace_id = p.trace_id and k.parent_id = p.span_id where greatest(k.started_us, p.started_us) < least(k.ended_us, p.ended_us)),
    r as (select *, coalesce(max(e) over (partition by trace_id, span_id order by s, kid rows between unbounded preceding and 1 preceding), s) as reached from cut), c as (select trace_id, span_id, sum(greatest(0, e - greatest(s, reached))) as covered from r group by all)
    select p.trace_id, p.span_id, (ended_us - started_us - coalesce(covered, 0))::bigint as self_us from spans p left join c on p.trace_id = c.trace_id and p.span_id = c.span_id""")
def self_time(spark, sf):
    return traces.self_time(spans(spark, sf))


_BUCKET = "('0x' || substr(sha256('online' || chr(0) || {id}::varchar), 1, 8))::bigint / 4294967296"


@query(f"select doc_id, round({_BUCKET.format(id='doc_id')}, 6) as bucket from documents")
def hash_sample(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.round(hashing.bucket("online", F.col("doc_id")), 6).alias("bucket"))


@query(f"""with s as (select event_id, user_id, ts, event_type = 'error' as failed, {_BUCKET.format(id='event_id')} < 0.2 as sampled from events), p as (select *, row_number() over (partition by user_id, not sampled and failed order by ts, event_id) as n from s)
    select event_id, case when sampled then 'sampled' when failed and n <= 3 then 'escalated' when failed then 'capped' else 'not_sampled' end as decision from p""")
def sampling_decision(spark, sf):
    out = traces.sampling_decisions(_read(spark, sf, "events"), "event_id", 0.2, "online", F.col("event_type") == "error", ["user_id"], 3, ["ts", "event_id"])
    return out.select("event_id", "decision")


@query(f"""with s as (select event_type = 'error' as failed, {_BUCKET.format(id='event_id')} < 0.2 as sampled, row_number() over (partition by user_id, not ({_BUCKET.format(id='event_id')} < 0.2) and event_type = 'error' order by ts, event_id) as n from events)
    select case when sampled then 'sampled' when failed and n <= 3 then 'escalated' when failed then 'capped' else 'not_sampled' end as decision, count(*)::bigint as n from s group by 1""")
def coverage_by_reason(spark, sf):
    return sampling_decision(spark, sf).groupBy("decision").agg(F.count("*").alias("n"))


@query("select time_bucket(interval '60 seconds', ts::timestamp) as window_start, event_type, count(*)::bigint as n, greatest(0, count(*) - 1)::bigint as n_rejected from events group by all")
def rate_limit_windows(spark, sf):
    out = traces.rate_limited(_read(spark, sf, "events"), "ts", ["event_type"], 1)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("select date_trunc('month', ts)::timestamp as month, user_id, round(sum(value), 4) as spent, round(sum(value) / 3000, 6) as ratio, case when sum(value) / 3000 >= 1 then 'exhausted' when sum(value) / 3000 >= 0.8 then 'warning' else 'ok' end as state from events group by 1, 2")
def month_budget(spark, sf):
    out = traces.budget_status(_read(spark, sf, "events"), "ts", ["user_id"], "value", 3000.0)
    return out.select(F.col("month").cast("timestamp_ntz").alias("month"), "user_id", F.round("spent", 4).alias("spent"), F.round("ratio", 6).alias("ratio"), "state")


@query(r"select doc_id, sha256(regexp_replace(coalesce(text, ''), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[REDACTED:email]', 'g')) as digest from documents")
def redact_email(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.sha2(redaction.without_personal_data(F.coalesce("text", F.lit("")), ("email",)), 256).alias("digest"))


@query("select item_id, trim(regexp_replace(lower(regexp_replace(text, '\\p{P}', '', 'g')), '\\s+', ' ', 'g')) as normalized from benchmark")
def normalize_text(spark, sf):
    return _read(spark, sf, "benchmark").select("item_id", text.normalized(F.col("text")).alias("normalized"))


@query("select conv_id, turn, contains(lower(text), 'the') and contains(lower(text), 'an') as has_all, contains(lower(text), 'zz') or contains(lower(text), 'tion') as has_any, coalesce(regexp_matches(text, '[a-z]{3}') and not regexp_matches(text, '[0-9]{4}'), false) as allowed from conversations")
def contains_and_regex(spark, sf):
    c = F.col("text")
    return _read(spark, sf, "conversations").select("conv_id", "turn", text.contains(c, ["the", "an"]).alias("has_all"), text.contains(c, ["zz", "tion"], every=False).alias("has_any"), text.regex_rules(c, ["[a-z]{3}"], ["[0-9]{4}"]).alias("allowed"))


@query("select conv_id, turn, case when trim(text) = '' then 0 else len(string_split_regex(trim(text), '\\s+')) end::int as words, case when trim(text) = '' then 0 else len(string_split_regex(trim(text), '\\s+')) end between 5 and 60 as fits from conversations")
def length_words(spark, sf):
    n = text.n_words(F.col("text"))
    return _read(spark, sf, "conversations").select("conv_id", "turn", n.alias("words"), text.length_within(n, 5, 60).alias("fits"))


@query("""with t as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from benchmark), c as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from conversations where turn = 1)
    select c.conv_id, round(len(list_intersect(c.w, n.w)) / len(list_distinct(list_concat(c.w, n.w))), 6) as similarity from c join (select conv_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from conversations where turn = 0) n on c.conv_id = n.conv_id""")
def turn_jaccard(spark, sf):
    rows = _read(spark, sf, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("w"))
    a, b = rows.where("turn = 1").withColumnRenamed("w", "v"), rows.where("turn = 0").drop("turn")
    return a.join(b, "conv_id").select("conv_id", F.round(text.jaccard(F.col("v"), F.col("w")), 6).alias("similarity"))
