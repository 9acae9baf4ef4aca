"""Metrics of a whole run, as rows (metric, slice, mean, n, n_errors, stddev) like those of scores.aggregate_scores.

results: example_id, output and expected (JSON), status, and for `operational` latency_ms, cost, judge_cost, tokens, retry_count, trace_id, n_tools,
n_models, n_spans as far as there are any. None of these is a mean of scores of examples, except the ranking metrics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import values

from . import scores

METRICS = "metric string, slice string, mean double, n long, n_errors long, stddev double"
#: Averages of the classes' F1 that a suite may ask for.
AVERAGING = {"macro": ("macro_f1", "macro_recall"), "weighted": ("weighted_f1",), "micro": ("micro_f1",)}


def as_metrics(row: DataFrame, n: str, **named: str) -> DataFrame:
    """Columns of a frame as metrics: a row for each name=column."""
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("mean")) for name, c in named.items()])
    rows = row.select(F.explode(pairs).alias("m"), F.coalesce(F.col(n).cast("long"), F.lit(0).cast("long")).alias("n"))
    return _shaped(rows.select("m.metric", F.lit("").alias("slice"), F.coalesce("m.mean", F.lit(0.0)).alias("mean"), F.when(F.col("m.mean").isNull(), 0).otherwise(F.col("n")).alias("n")))


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select("metric", "slice", F.col("mean").cast("double").alias("mean"), F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("n_errors"), F.lit(0.0).alias("stddev"))


def _good(results: DataFrame) -> DataFrame:
    rows = results.where("status = 'ok'") if "status" in results.columns else results
    return rows.where("expected is not null").withColumns({"_output": F.try_parse_json(F.col("output").cast("string")), "_expected": F.try_parse_json(F.col("expected").cast("string"))})


def _text(root: str, path: str) -> Column:
    """A field as text; JSON that is no text is its JSON."""
    found = values.resolve(F.col(root), path)
    return F.coalesce(F.when(values.kind(found) == "STRING", F.try_variant_get(found, "$", "string")), F.when(values.kind(found) != "VOID", F.to_json(found)))


def _number(root: str, path: str) -> Column:
    """A field as a number; a boolean is none."""
    found = values.resolve(F.col(root), path)
    return F.when(values.kind(found).isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), F.try_variant_get(found, "$", "double"))


def _truth(root: str, path: str) -> Column:
    found = values.resolve(F.col(root), path)
    kind = values.kind(found)
    return F.when(kind == "BOOLEAN", F.try_variant_get(found, "$", "boolean")).when(kind.isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), F.try_variant_get(found, "$", "double") != 0).when(kind == "STRING", F.try_variant_get(found, "$", "string") != "")


def classification(results: DataFrame, name: str, prediction: str = "intent", label: str | None = None, averaging: str = "macro") -> DataFrame:
    """Accuracy, the classes' precision, recall and F1 as slices class=..., and the average asked for; count 0 without a pair."""
    pairs = _good(results).select(_text("_expected", label or prediction).alias("actual"), _text("_output", prediction).alias("predicted")).dropna()
    classes = scores.classification(pairs)
    fields = F.array(*[F.struct(F.lit(f"{name}_{c}").alias("metric"), F.col(c).alias("mean")) for c in ("precision", "recall", "f1")])
    sliced = classes.select(F.concat(F.lit("class="), "label").alias("slice"), F.col("support").alias("n"), F.explode(fields).alias("m")).select("m.metric", "slice", "m.mean", "n")
    whole = scores.macro_weighted(pairs).withColumn("micro_f1", F.col("accuracy"))
    return as_metrics(whole, "n", **{f"{name}_accuracy": "accuracy"}, **{f"{name}_{c}": c for c in AVERAGING[averaging]}).unionByName(_shaped(sliced))


def ranked(found: Column, relevant: Column, k: int) -> dict[str, Column]:
    """Precision, recall, NDCG and average precision at k and the reciprocal rank of a list of ids against the ids that are relevant."""
    hit = F.transform(found, lambda x: F.array_contains(relevant, x))
    at = lambda xs: F.transform(xs, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("r")))
    hits = F.filter(at(F.slice(hit, 1, k)), lambda x: x["h"])
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    size, most = F.size(relevant), F.least(F.size(relevant), F.lit(k))
    ideal = total(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), most)), lambda i: 1 / F.log2(i + 1)))
    share = lambda a, b: F.when(size > 0, a / b).otherwise(0.0)
    first = F.get(F.filter(at(hit), lambda x: x["h"]), F.lit(0))["r"]
    return {
        f"precision_at_{k}": F.size(hits) / F.least(F.size(found), F.lit(k)),
        f"recall_at_{k}": share(F.size(hits), size),
        f"ndcg_at_{k}": share(total(F.transform(hits, lambda x: 1 / F.log2(x["r"] + 1))), ideal),
        "mrr": F.coalesce(1 / first, F.lit(0.0)),
        "map": share(total(F.transform(hits, lambda x, i: (i + 1) / x["r"])), most),
    }


def ranking(results: DataFrame, name: str, k: int = 10, found: str = "results", relevant: str = "relevant") -> DataFrame:
    """Means over the examples that ranked something; an example's lists are bounded by its output."""
    rows = _good(results).select(values.ids(values.resolve(F.col("_output"), found)).alias("found"), F.coalesce(F.array_distinct(values.ids(values.resolve(F.col("_expected"), relevant))), F.array().cast("array<string>")).alias("relevant"))
    each = rows.where("size(found) > 0").select(*[c.alias(n) for n, c in ranked(F.col("found"), F.col("relevant"), k).items()])
    means = each.agg(*[F.avg(c).alias(c) for c in each.columns], F.count("*").alias("n"))
    return as_metrics(means, "n", **{f"{name}_{c}": c for c in each.columns})


def calibration(results: DataFrame, name: str, confidence: str = "confidence", correct: str | None = None, prediction: str = "intent", label: str = "intent") -> DataFrame:
    """Expected calibration error and Brier score of the outputs that name a confidence."""
    right = F.coalesce(_truth("_output", correct), F.lit(False)) if correct else F.coalesce(_text("_output", prediction).eqNullSafe(_text("_expected", label)), F.lit(False))
    rows = _good(results).select(_number("_output", confidence).alias("confidence"), right.cast("double").alias("correct")).dropna()
    return as_metrics(scores.ece_brier(rows), "n", **{f"{name}_ece": "ece", f"{name}_brier": "brier"})


def discrimination(results: DataFrame, name: str, score: str = "predicted", outcome: str = "correct") -> DataFrame:
    """Area under the curve; count 0 where one of the two outcomes is missing."""
    rows = _good(results).select(_number("_output", score).alias("score"), _truth("_expected", outcome).alias("positive")).dropna()
    return as_metrics(scores.roc_auc(rows).withColumn("n", F.col("n_positive") + F.col("n_negative")), "n", **{f"{name}_auc": "auc"})


def operational(results: DataFrame, percentiles: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Latencies of ok rows; costs, tokens, rates and retries of all rows; tools, models and spans of those with a trace."""
    types = {"status": "string", "latency_ms": "double", "cost": "double", "judge_cost": "double", "tokens": "long", "retry_count": "long", "trace_id": "string", "n_tools": "long", "n_models": "long", "n_spans": "long"}
    rows = results.select(F.lit("run").alias("_run"), *[(F.col(c) if c in results.columns else F.lit("ok" if c == "status" else None)).cast(t).alias(c) for c, t in types.items()])
    good = rows.where("status = 'ok'")
    late = scores.percentiles(good, ["_run"], "latency_ms", list(percentiles)).join(good.groupBy("_run").agg(F.avg("latency_ms").alias("mean_latency"), F.count("latency_ms").alias("n")), "_run")
    sums = scores.run_operations(rows, ["_run"]).join(rows.groupBy("_run").agg(F.count("*").alias("n"), F.count("trace_id").alias("n_traced")), "_run")
    given = ["total_cost", "cost_per_example", "error_rate", "timeout_rate", "judge_cost", "total_tokens", "trace_coverage"]
    out = as_metrics(late, "n", **{f"p{q}_latency_ms": f"p{q}" for q in percentiles}, mean_latency_ms="mean_latency")
    out = out.unionByName(as_metrics(sums, "n", **{c: c for c in given}, retry_count="retries"))
    traced = {"tool_calls_per_example": "tools_per_example", "model_calls_per_example": "models_per_example", "spans_per_example": "spans_per_example"}
    return out.unionByName(as_metrics(sums, "n_traced", **traced))


def built(name: str, spec: dict) -> Callable[[DataFrame], DataFrame] | None:
    """The metric of a suite file's entry, None for a type that scores single examples."""
    kind, get = spec["type"], spec.get
    if kind == "classification":
        return lambda r: classification(r, name, get("prediction_field") or "intent", get("label_field"), get("averaging") or "macro")
    if kind == "ranking":
        return lambda r: ranking(r, name, int(get("k") or 10), get("ranking_field") or "results", get("relevant_field") or "relevant")
    if kind == "calibration":
        return lambda r: calibration(r, name, get("confidence_field") or "confidence", get("correct_field"), get("prediction_field") or "intent", get("label_field") or "intent")
    if kind == "discrimination":
        return lambda r: discrimination(r, name, get("prediction_field") or "predicted", get("label_field") or "correct")
    if kind == "operational":
        return lambda r: operational(r, tuple(get("percentiles") or (50, 95, 99)))
    return None
