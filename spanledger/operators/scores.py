"""Scores to sliced metrics, and statistics of one table of rows."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions.scalars import slice_key
from spanledger.functions.values import merged

#: Two-sided normal quantiles by confidence.
Z = {0.80: 1.2815515655446004, 0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.98: 2.3263478740408408, 0.99: 2.5758293035489004}


def sliced_scores(scores: DataFrame, slice_by: list[str] = (), *more: str) -> DataFrame:
    """metric, slice, value, error (and `more`) of scores(metric, value, error, the columns of slice_by and, if they have some of their own, own_slice: a map).

    A score counts in its own slice (the whole without one) and once in that slice with each single column whose value isn't null
    (`column=value`, which replaces a label of that name).
    """
    if "own_slice" in scores.columns:
        own = F.coalesce("own_slice", F.create_map().cast("map<string,string>"))
        parts = [F.when(F.col(c).isNotNull(), slice_key(merged(own, F.create_map(F.lit(c), F.col(c).cast("string"))))) for c in slice_by]
        keys = F.array_distinct(F.array_compact(F.array(slice_key(own), *parts)))
    else:
        parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in slice_by]
        keys = F.array_compact(F.array(F.lit(""), *parts))
    return scores.select("metric", "value", "error", *more, F.explode(keys).alias("slice"))


def aggregate_scores(scores: DataFrame, slice_by: list[str] = ()) -> DataFrame:
    """Scores to a row per metric and slice, see sliced_scores().

    Errored or null values count as errors, not as zeros; a slice with nothing but errors has value 0 and count 0.
    """
    good = F.when(F.col("error").isNull(), F.col("value"))
    return sliced_scores(scores, slice_by).groupBy("metric", "slice").agg(
        F.coalesce(F.avg(good), F.lit(0.0)).alias("mean"),
        F.count(good).alias("n"),
        F.count(F.when(F.col("error").isNotNull(), 1)).alias("n_errors"),
        F.coalesce(F.stddev_samp(good), F.lit(0.0)).alias("stddev"),
    )


def wilson(successes: Column, total: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 1) without trials."""
    z = Z.get(confidence) or NormalDist().inv_cdf((1 + confidence) / 2)
    p = successes / F.nullif(total, F.lit(0))
    middle, width = p + z * z / (2 * total), z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))
    below = 1 + z * z / total
    return F.coalesce(F.greatest(F.lit(0.0), (middle - width) / below), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), (middle + width) / below), F.lit(1.0))


#: Ranges of a key's values that are ranked by themselves, and how fine the sketch that finds their bounds is.
RANGES, FINENESS = 64, 1280


def _counted_before(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """counts(keys, value, n) with `before` (rows of the key with lesser values) and `total`, without bringing a key's values to one task.

    Each key's values fall into RANGES ranges of its own, by a quantile sketch that is merged like any aggregate; a range's rows are summed in order, and
    what lies in earlier ranges, one number for each key and range, is added. Keys must not be null. It is one lazy plan: which side of a join is
    small enough to be sent to the tasks is left to the engine, which knows its size.
    """
    rows = counts if keys else counts.withColumn("_whole", F.lit(0))
    by = keys or ["_whole"]
    bounds = rows.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), [i / RANGES for i in range(1, RANGES)], FINENESS).alias("_bounds"))
    rows = rows.join(bounds, by).withColumn("_range", F.size(F.filter("_bounds", lambda x: x < F.col(value).cast("double")))).drop("_bounds")
    each = rows.groupBy(*by, "_range").agg(F.sum(n).alias("_sum"))
    whole = Window.partitionBy(*by)
    earlier = F.coalesce(F.sum("_sum").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = each.select(*by, "_range", earlier.alias("_earlier"), F.sum("_sum").over(whole).alias("total"))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inside", inside).join(ranges, [*by, "_range"]).withColumn("before", F.col("_inside") + F.col("_earlier")).drop("_inside", "_earlier", "_range", "_whole")


def percentiles(rows: DataFrame, keys: list[str], value: str, at: list[int]) -> DataFrame:
    """Exact percentiles (linear interpolation) of each key as p<q>, from counted values; nulls don't count. Keys must not be null."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = _counted_before(counts, keys, value, "_n")
    out = []
    for q in at:
        h = (F.col("total") - 1) * (q / 100)
        held = lambda r: F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("_n")), F.col(value)))
        low, high = held(F.floor(h)), held(F.ceil(h))
        out.append((low + (high - low) * (F.max(h) - F.floor(F.max(h)))).alias(f"p{q}"))
    return ranked.groupBy(*keys).agg(*out)


def operational(rows: DataFrame, keys: list[str], value: str, ok: Column) -> DataFrame:
    """Percentiles (linear interpolation) and mean of `value` over ok rows, error rate over all rows."""
    good = F.when(ok, F.col(value))
    sums = rows.groupBy(*keys).agg(F.avg(good).alias("mean"), F.avg(F.when(ok, 0.0).otherwise(1.0)).alias("error_rate"), F.count("*").alias("n"))
    found = percentiles(rows.where(ok), keys, value, [50, 95, 99])
    return sums.join(found, keys, "left").select(*keys, "p50", "p95", "p99", "mean", "error_rate", "n")


def run_operations(results: DataFrame, keys: list[str]) -> DataFrame:
    """results(status, cost, judge_cost, tokens, retry_count, trace_id, n_tools, n_models, n_spans) of runs: costs, tokens, rates and retries over all rows,
    tools, models and spans for each example that has a trace, and the share of those.
    """
    traced = F.col("trace_id").isNotNull()
    share = lambda c: F.avg(c.cast("double"))
    cost = F.coalesce("cost", F.lit(0.0)) + F.coalesce("judge_cost", F.lit(0.0))
    return results.groupBy(*keys).agg(
        F.sum(cost).alias("total_cost"), F.avg(cost).alias("cost_per_example"), F.sum("judge_cost").alias("judge_cost"), F.sum("tokens").alias("total_tokens"), share(F.col("status") != "ok").alias("error_rate"),
        share(F.col("status") == "timeout").alias("timeout_rate"), F.sum("retry_count").alias("retries"), *[F.avg(F.when(traced, F.col(f"n_{x}"))).alias(f"{x}_per_example") for x in ("tools", "models", "spans")], share(traced).alias("trace_coverage"),
    )


def mean_ranking(per_query: DataFrame) -> DataFrame:
    """The means of ranking_at_k's metrics over the queries that have a ranking."""
    return per_query.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "ndcg", "rr", "ap")], F.count("*").alias("n"))


def confusion(pairs: DataFrame) -> DataFrame:
    """pairs(actual, predicted) counted; rows with a null are left out."""
    return pairs.dropna(subset=["actual", "predicted"]).groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def classification(pairs: DataFrame) -> DataFrame:
    """A row per class: support, precision, recall, f1 (0 where undefined). Works on the counted pairs only."""
    cells = confusion(pairs)
    classes = cells.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")))).alias("x"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")).select("x.*", "hit")
    found = classes.groupBy("label").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), (F.sum("hit") / 2).alias("hits"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rated = found.select("label", "support", share(F.col("hits"), F.col("called")).alias("precision"), share(F.col("hits"), F.col("support")).alias("recall"))
    return rated.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_weighted(pairs: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1, macro recall, over all classes."""
    rows = classification(pairs)
    total = F.sum("support")
    return rows.agg((F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.avg("recall").alias("macro_recall"), (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"), total.alias("n"))


def ranking_at_k(ranked: DataFrame, k: int) -> DataFrame:
    """ranked(query, rank from 1, relevant boolean) to precision, recall, NDCG at k, reciprocal rank and average precision per query."""
    w = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("relevant").cast("int")
    rows = ranked.withColumn("hits", F.sum(hit).over(w)).withColumn("top", F.col("rank") <= k)
    gain = F.when(F.col("top") & F.col("relevant"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    out = rows.groupBy("query").agg(
        F.sum(F.when(F.col("top"), hit)).alias("found"), F.count(F.when(F.col("top"), 1)).alias("shown"), F.sum(hit).alias("relevant"), F.sum(gain).alias("dcg"),
        F.coalesce(F.max(F.when(F.col("relevant"), 1 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(F.when(F.col("top") & F.col("relevant"), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
    )
    most = F.least("relevant", F.lit(k))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), most).cast("int")), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda a, x: a + x)
    none = F.col("relevant") == 0
    return out.select("query", (F.col("found") / F.col("shown")).alias("precision"), F.when(none, 0.0).otherwise(F.try_divide("found", "relevant")).alias("recall"), F.when(none, 0.0).otherwise(F.col("dcg") / ideal).alias("ndcg"), "rr", F.when(none, 0.0).otherwise(F.try_divide(F.col("ap_sum"), most)).alias("ap"))


def ece_brier(rows: DataFrame, bins: int = 10) -> DataFrame:
    """rows(confidence, correct 0/1): expected calibration error over equal bins, and the Brier score."""
    place = F.least(F.greatest((F.col("confidence") * bins).cast("int"), F.lit(0)), F.lit(bins - 1))
    binned = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("conf"), F.avg("correct").alias("acc"), F.sum(F.pow(F.col("confidence") - F.col("correct"), 2)).alias("square"))
    n = F.sum("n")
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / n).alias("ece"), (F.sum("square") / n).alias("brier"), n.alias("n"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """rows(score, positive boolean): area by midranks, null where one class is missing. Scores are counted first and ranked range by range."""
    values = rows.dropna().groupBy("score").agg(F.count("*").alias("n"), F.sum(F.col("positive").cast("int")).alias("pos"))
    ranked = _counted_before(values, [], "score", "n")
    sums = ranked.withColumn("mid", F.col("before") + (F.col("n") + 1) / 2).agg(F.sum(F.col("mid") * F.col("pos")).alias("ranks"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    q = F.col("n") - F.col("p")
    return sums.select(F.try_divide(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * q).alias("auc"), F.col("p").alias("n_positive"), q.alias("n_negative"))


def kappa(pairs: DataFrame, scale: list[str], weights: str = "none") -> DataFrame:
    """pairs(human, judge): agreement and Cohen's kappa, unweighted, `linear` or `quadratic` over the scale; null if chance agrees wholly."""
    place = F.create_map(*[F.lit(x) for i, v in enumerate(scale) for x in (v, i)])
    cells = pairs.dropna().groupBy("human", "judge").agg(F.count("*").alias("n")).select("n", place[F.col("human")].alias("i"), place[F.col("judge")].alias("j"))
    total = F.sum("n")
    distance = {"none": lambda i, j: (i != j).cast("double"), "linear": lambda i, j: F.abs(i - j).cast("double"), "quadratic": lambda i, j: F.pow(i - j, F.lit(2))}[weights]
    sums = cells.agg(F.sum(F.col("n") * distance(F.col("i"), F.col("j"))).alias("seen"), F.sum(F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0)).alias("same"), total.alias("n"), *[F.coalesce(F.sum(F.when(F.col(side) == k, F.col("n"))), F.lit(0)).alias(f"{side}{k}") for side in "ij" for k in range(len(scale))])
    chance = sum((F.col(f"i{a}") * F.col(f"j{b}") * distance(F.lit(a), F.lit(b)) for a in range(len(scale)) for b in range(len(scale))), F.lit(0.0)) / F.col("n")
    return sums.select((F.col("same") / F.col("n")).alias("agreement"), (1 - F.try_divide(F.col("seen"), chance)).alias("kappa"), "n")


def directional_rates(pairs: DataFrame, passing: list[str]) -> DataFrame:
    """pairs(human, judge): share passed by the judge of what humans fail, and failed of what they pass; null without any."""
    human, judge = F.col("human").isin(passing), F.col("judge").isin(passing)
    return pairs.agg(F.avg(F.when(~human, judge.cast("double"))).alias("false_pass"), F.avg(F.when(human, (~judge).cast("double"))).alias("false_fail"), F.count("*").alias("n"))


def top_confusion(pairs: DataFrame) -> DataFrame:
    """Each human label's support, recall and commonest wrong label (then the lesser)."""
    cells = pairs.groupBy("human", "judge").agg(F.count("*").alias("n"))
    wrong = F.when(F.col("human") != F.col("judge"), F.struct(-F.col("n"), F.col("judge").alias("label")))
    return cells.groupBy("human").agg(F.sum("n").alias("support"), (F.sum(F.when(F.col("human") == F.col("judge"), F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"), F.min(wrong)["label"].alias("confused_with"))
