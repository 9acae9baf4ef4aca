"""A candidate run against a baseline run: metrics, paired tests, gates and verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdicts by rank.
VERDICTS = ["pass", "warn", "fail", "error"]
#: Normal quantiles for alpha 0.05 (one-sided) and power 0.8.
Z_ALPHA, Z_POWER = 1.6448536269514722, 0.8416212335729143


def compare_metrics(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Full outer join on (metric, slice) of tables with value: candidate, baseline, delta, relative delta and which side is missing."""
    c, b = (x.select("metric", "slice", F.col("value").alias(n)) for x, n in ((candidate, "candidate"), (baseline, "baseline")))
    out = c.join(b, ["metric", "slice"], "full_outer")
    delta = F.col("candidate") - F.col("baseline")
    only = F.when(F.col("baseline").isNull(), "candidate").when(F.col("candidate").isNull(), "baseline")
    return out.select("metric", "slice", "candidate", "baseline", delta.alias("delta"), F.try_divide(delta, F.abs("baseline")).alias("relative"), only.alias("only_in"))


def changed_examples(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Examples scored (example_id, metric, value) in both runs: counts of regressions, gains and ties by metric."""
    pairs = candidate.join(baseline.withColumnRenamed("value", "before"), ["example_id", "metric"]).dropna(subset=["value", "before"])
    count = lambda when: F.count(F.when(when, 1))
    v, b = F.col("value"), F.col("before")
    return pairs.groupBy("metric").agg(count(v < b).alias("regressed"), count(v > b).alias("improved"), count(v == b).alias("unchanged"))


def paired(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per metric the paired differences: n, mean, stddev, whether all are 0/1, discordant counts, least detectable effect."""
    pairs = candidate.join(baseline.withColumnRenamed("value", "before"), ["example_id", "metric"]).dropna(subset=["value", "before"])
    v, b = F.col("value"), F.col("before")
    out = pairs.groupBy("metric").agg(F.count("*").alias("n"), F.avg(v - b).alias("mean"), F.coalesce(F.stddev_samp(v - b), F.lit(0.0)).alias("stddev"), F.every(v.isin(0, 1) & b.isin(0, 1)).alias("binary"), F.count(F.when((b == 1) & (v == 0), 1)).alias("lost"), F.count(F.when((b == 0) & (v == 1), 1)).alias("won"))
    return out.withColumn("mde", F.when(F.col("n") >= 5, (Z_ALPHA + Z_POWER) * F.col("stddev") / F.sqrt("n")))


def _log_factorial(m: Column) -> Column:
    """ln m! by Stirling's series from 16 on (an error below 1e-15), below that from the product."""
    x = F.greatest(m, F.lit(16)).cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    return F.when(m < 16, F.get(table, m.cast("int"))).otherwise(series)


def _upper_tail(n: Column, k: Column) -> Column:
    """P(X >= k) of n fair draws for k above the middle. Terms beyond 12 roots of n are below e^-200 of the first and are left out."""
    last = F.least(n, k + (12 * F.sqrt(n)).cast("long") + 100)
    start = F.struct(F.lit(0.0).alias("p"), (_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n * math.log(2)).alias("term"))
    step = lambda a, i: F.struct((a["p"] + F.exp(a["term"])).alias("p"), (a["term"] + F.log(F.greatest(n - i, F.lit(1)).cast("double")) - F.log((i + 1).cast("double"))).alias("term"))
    return F.aggregate(F.sequence(k, F.greatest(k, last)), start, step, lambda a: a["p"])


def mcnemar_p(lost: Column, won: Column) -> Column:
    """Exact one-sided binomial tail P(X >= lost) for lost + won fair draws; 1 without any. The terms of the shorter side of the middle are summed,
    a number of them that grows with the root of the draws."""
    lost, n = lost.cast("long"), (lost + won).cast("long")
    upper = lost * 2 > n
    k = F.when(upper, lost).otherwise(n - lost + 1)
    tail = F.when(k > n, 0.0).otherwise(_upper_tail(n, F.least(k, n)))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), F.when(upper, tail).otherwise(1 - tail)))


def holm(tests: DataFrame) -> DataFrame:
    """tests(metric, p): adjusted by Holm's step-down. Metrics are few; equal p go by name."""
    order = Window.orderBy("p", "metric")
    m = F.count("*").over(Window.partitionBy())
    scaled = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col("p"))
    return tests.select("metric", "p", scaled.alias("scaled")).select("metric", "p", F.max("scaled").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("p_adjusted"))


#: Columns that rules and metrics may leave out, with their types.
_OPTIONAL = {"require_power": "boolean", "significance": "double", "mde": "double", "p": "double"}


def evaluate_gates(rules: DataFrame, metrics: DataFrame) -> DataFrame:
    """rules(rule, metric, slice, minimum, maximum, max_regression, max_relative, require_baseline, max_error_rate, blocking and, if wanted,
    require_power, significance) against metrics(metric, slice, value, n, n_errors, baseline and, if tested, mde, p): the first clause that
    applies decides.

    A drop beyond max_regression that isn't significant passes, whatever max_relative says; one without a test is an error.
    """
    found = rules.join(metrics, ["metric", "slice"], "left")
    found = found.withColumns({c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in found.columns})
    c = F.col
    drop = c("baseline") - c("value")
    compared = c("max_regression").isNotNull() | c("max_relative").isNotNull()
    powered, beyond = c("require_power") & c("max_regression").isNotNull(), c("significance").isNotNull() & (drop > c("max_regression"))
    clauses = [
        (c("value").isNull(), "metric_missing", "error"),
        (c("n") == 0, "no_data", "error"),
        (F.try_divide(c("n_errors"), c("n") + c("n_errors")) > c("max_error_rate"), "error_rate", "error"),
        (c("value") < c("minimum"), "minimum", "fail"),
        (c("value") > c("maximum"), "maximum", "fail"),
        (compared & c("baseline").isNull() & c("require_baseline"), "baseline_missing", "error"),
        (compared & c("baseline").isNull(), "no_baseline", "pass"),
        (powered & c("mde").isNull(), "power_unknown", "error"),
        (powered & (c("mde") > c("max_regression")), "underpowered", "error"),
        (beyond & c("p").isNull(), "significance_unavailable", "error"),
        (beyond & (c("p") > c("significance")), "not_significant", "pass"),
        (drop > c("max_regression"), "regression", "fail"),
        (F.try_divide(drop, F.abs(c("baseline"))) > c("max_relative"), "relative_regression", "fail"),
    ]
    clause, verdict = F.lit("ok"), F.lit("pass")
    for when, name, outcome in reversed(clauses):
        clause, verdict = F.when(F.coalesce(when, F.lit(False)), name).otherwise(clause), F.when(F.coalesce(when, F.lit(False)), outcome).otherwise(verdict)
    softened = F.when(~c("blocking") & verdict.isin("fail", "error"), "warn").otherwise(verdict)
    return found.select("rule", "metric", "slice", "value", clause.alias("clause"), softened.alias("verdict"))


def invalid_rules(rules: DataFrame) -> DataFrame:
    """Rules that can't be meant: none of the conditions is set, or the minimum is above the maximum."""
    limits = ("minimum", "maximum", "max_regression", "max_relative", "max_error_rate")
    unset = F.coalesce(*limits).isNull() & ~F.coalesce("require_baseline", F.lit(False))
    reason = F.when(unset, "no condition").when(F.col("minimum") > F.col("maximum"), "minimum above maximum")
    return rules.select("rule", reason.alias("reason")).where("reason is not null")


def dataset_gate(runs: DataFrame) -> DataFrame:
    """runs(rule, candidate_hash, baseline_hash): an error where both are known and differ."""
    differ = F.coalesce(F.col("candidate_hash") != F.col("baseline_hash"), F.lit(False))
    return runs.select("rule", F.when(differ, "dataset_mismatch").otherwise("ok").alias("clause"), F.when(differ, "error").otherwise("pass").alias("verdict"))


def calibration_gates(rules: DataFrame, judges: DataFrame, calibrations: DataFrame, required: bool) -> DataFrame:
    """A row for each metric of rules(metric) that a judge of judges(metric, version) gives.

    calibrations(metric, version, calibrated_at, satisfied): that of the judge's own version counts, else the newest other one, which is
    stale. What isn't right is an error if calibration is required, else a warning.
    """
    gated = rules.select("metric").distinct().join(judges, "metric")
    mine = calibrations.withColumnRenamed("version", "calibrated_version")
    rows = gated.join(mine, "metric", "left").withColumn("own", F.coalesce(F.col("version") == F.col("calibrated_version"), F.lit(False)))
    best = rows.groupBy("metric", "version").agg(F.max_by(F.struct("calibrated_version", "satisfied", "own"), F.struct("own", "calibrated_at")).alias("c"))
    clause = F.when(F.col("c.calibrated_version").isNull(), "uncalibrated_judge").when(~F.col("c.own"), "stale_calibration").when(~F.col("c.satisfied"), "calibration_requirement").otherwise("calibrated")
    return best.select("metric", "version", clause.alias("clause"), F.when(clause == "calibrated", "pass").otherwise("error" if required else "warn").alias("verdict"))


def exit_code(verdict: str, cancelled: bool = False, aborted: bool = False) -> int:
    """0 for pass and warn, 1 for fail, 2 for error and for a run that was given up, 130 for one that was stopped."""
    return 130 if cancelled else 2 if aborted else (0, 0, 1, 2)[VERDICTS.index(verdict)]


def top_changes(candidate: DataFrame, baseline: DataFrame, size: int = 50) -> DataFrame:
    """Examples whose score fell or rose, at most `size` of each kind and metric, the largest changes first.

    Of several scores of an example the least counts on both sides.
    """
    one = lambda rows, name: rows.where("value is not null").groupBy("example_id", "metric").agg(F.min("value").alias(name))
    pairs = one(candidate, "value").join(one(baseline, "before"), ["example_id", "metric"]).withColumn("delta", F.col("value") - F.col("before")).where("delta <> 0")
    pairs = pairs.withColumn("kind", F.when(F.col("delta") < 0, "regression").otherwise("improvement"))
    place = F.row_number().over(Window.partitionBy("metric", "kind").orderBy(F.abs("delta").desc(), "example_id"))
    return pairs.withColumn("place", place).where(F.col("place") <= size).select("metric", "kind", "place", "example_id", "before", "value", "delta")


def one_sided(candidate: DataFrame, baseline: DataFrame, shown: int = 5) -> DataFrame:
    """Which metrics only one run has: side, their number and the first names."""
    names = lambda rows: rows.select("metric").distinct()
    c, b = names(candidate), names(baseline)
    both = c.subtract(b).select(F.lit("candidate").alias("side"), "metric").unionByName(b.subtract(c).select(F.lit("baseline").alias("side"), "metric"))
    return both.groupBy("side").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("metric")), 1, shown), ", ").alias("first"))


def combined_verdict(verdicts: DataFrame) -> DataFrame:
    """The worst verdict of all, and the exit code that goes with it."""
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict")) - 1
    worst = verdicts.agg(F.coalesce(F.max(rank), F.lit(0)).cast("int").alias("rank"), F.count("*").alias("n_rules"))
    return worst.select(F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("rank") + 1).alias("verdict"), F.element_at(F.array(*map(F.lit, (0, 0, 1, 2))), F.col("rank") + 1).alias("exit_code"), "n_rules")
