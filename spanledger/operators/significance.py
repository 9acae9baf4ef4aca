"""Bootstrap intervals and paired tests, metric by metric.

Metrics of up to EXACT_ROWS values are resampled by a seeded Mersenne twister in the order of their examples, so that the same seed gives the
same interval everywhere. Beyond that no task may hold a metric's values: a hash of the key deals the examples to GROUPS groups, whose
sums and counts are resampled instead. As groups are random parts of the rows, the ratio of the drawn sums has the variance of a resampled mean,
to one part in the root of 2 * GROUPS, whatever the values are and however the rows are partitioned.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .comparison import Z_ALPHA, Z_POWER, compare_metrics, holm, mcnemar_p
from .scores import aggregate_scores, sliced_scores

SEED, MEAN_RESAMPLES, PAIR_RESAMPLES, DELTA_RESAMPLES = 42, 10_000, 10_000, 5_000
EXACT_ROWS = GROUPS = 20_000
#: Ranges of a metric's values that are resampled by their sums where it has more than EXACT_ROWS different ones.
BINS = 128
LEAST_PAIRS = 5
#: Resamples that are drawn at a time; bounds a task's memory.
AT_ONCE = 64


class Twister:
    """The draws of random.Random(seed).randrange(n), many at a time."""

    def __init__(self, seed: int, n: int):
        state = random.Random(seed).getstate()[1]
        self.bits = np.random.MT19937()
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], dtype=np.uint32), "pos": state[-1]}}
        self.n, self.shift, self.left = n, np.uint64(32 - n.bit_length()), np.zeros(0, dtype=np.int64)

    def take(self, count: int) -> np.ndarray:
        parts, have = [self.left], len(self.left)
        while have < count:
            raw = self.bits.random_raw(min(1 << 20, 2 * (count - have) + 64)) >> self.shift
            parts.append(raw[raw < self.n].astype(np.int64))
            have += len(parts[-1])
        out = np.concatenate(parts)
        self.left = out[count:]
        return out[:count]


def _blocks(resamples: int):
    return [min(AT_ONCE, resamples - at) for at in range(0, resamples, AT_ONCE)]


def resampled_means(values: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    n, draws = len(values), Twister(seed, len(values))
    return np.sort(np.concatenate([values[draws.take(k * n)].reshape(k, n).mean(axis=1) for k in _blocks(resamples)]))


def resampled_ratios(sums: np.ndarray, counts: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Means of resamples of groups, from the groups' sums and counts."""
    rng, out = np.random.default_rng(seed), []
    for k in _blocks(resamples):
        drawn = rng.integers(0, len(sums), (k, len(sums)))
        out.append(sums[drawn].sum(axis=1) / counts[drawn].sum(axis=1))
    return np.sort(np.concatenate(out))


def _mean_interval(means: np.ndarray, confidence: float) -> tuple[float, float]:
    r, tail = len(means), (1 - confidence) / 2
    return float(means[max(0, int(tail * r) - 1)]), float(means[min(r - 1, int((1 - tail) * r))])


def _paired_interval(means: np.ndarray, confidence: float, alternative: str) -> tuple[float, float, float]:
    r, tail = len(means), (1 - confidence) / 2
    low, high = means[max(0, math.floor(tail * r) - 1)], means[min(r - 1, math.ceil((1 - tail) * r) - 1)]
    up, down = int((means >= 0).sum()), int((means <= 0).sum())
    extreme = {"less": up, "greater": down, "two-sided": 2 * min(up, down)}[alternative]
    return float(low), float(high), min(1.0, (extreme + 1) / (r + 1))


def _means(rows: DataFrame, keys: list[str], order: list[str], resamples: int, seed: int, exact_rows: int, use, schema: str) -> DataFrame:
    """use(sorted means of the resamples, values or None) for each key of rows(keys, value, order)."""
    rows = rows.where("value is not null")
    sized = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    small, large = (rows.join(sized.where(c), keys) for c in (f"_n <= {exact_rows}", f"_n > {exact_rows}"))
    types = ", ".join(f"{k} string" for k in keys)
    names = [c.split()[0] for c in f"{types}, {schema}".split(", ")]

    def exact(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values(order)["value"].to_numpy(dtype=float)
        return pd.DataFrame([[*frame[keys].iloc[0], *use(resampled_means(values, resamples, seed), values)]], columns=names)

    def grouped(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_group")
        means = resampled_ratios(frame["_sum"].to_numpy(dtype=float), frame["_count"].to_numpy(dtype=float), resamples, seed)
        return pd.DataFrame([[*frame[keys].iloc[0], *use(means, None)]], columns=names)

    out = small.select(*keys, "value", *order).groupBy(*keys).applyInPandas(exact, f"{types}, {schema}")
    group = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in order]), F.lit(GROUPS))
    sums = large.groupBy(*keys, group.alias("_group")).agg(F.sum("value").alias("_sum"), F.count("*").alias("_count"))
    return out.unionByName(sums.groupBy(*keys).applyInPandas(grouped, f"{types}, {schema}"))


def mean_intervals(scores: DataFrame, keys: list[str] = ("metric", "slice"), order: list[str] = ("example_id",), resamples: int = MEAN_RESAMPLES, confidence: float = 0.95, seed: int = SEED, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Percentile bootstrap of the mean: keys, ci_low, ci_high. Of one value it is that value twice; keys are texts."""

    def use(means, values):
        return (float(values[0]),) * 2 if values is not None and len(values) == 1 else _mean_interval(means, confidence)

    return _means(scores, list(keys), list(order), resamples, seed, exact_rows, use, "ci_low double, ci_high double")


def paired_bootstrap(pairs: DataFrame, resamples: int = PAIR_RESAMPLES, confidence: float = 0.95, alternative: str = "less", seed: int = SEED, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """pairs(metric, example_id, value: the difference) to metric, ci_low, ci_high, p. The p-value is never 0: one resample is counted more."""
    return _means(pairs, ["metric"], ["example_id"], resamples, seed, exact_rows, lambda means, values: _paired_interval(means, confidence, alternative), "ci_low double, ci_high double, p double")


def _binned(counts: DataFrame) -> DataFrame:
    """counts(metric, side, value, n) to metric, side, n, mean and spread (variance times n) of each different value, or of
    BINS even ranges of a metric that has more than EXACT_ROWS different ones."""
    many = counts.groupBy("metric").agg(F.count("*").alias("_values"), F.min("value").alias("_low"), F.max("value").alias("_high"))
    rows = counts.join(many, "metric")
    exact = rows.where(f"_values <= {EXACT_ROWS}").select("metric", "side", "n", F.col("value").alias("mean"), F.lit(0.0).alias("spread"))
    place = F.least(F.lit(BINS - 1), F.floor(F.try_divide(F.col("value") - F.col("_low"), F.col("_high") - F.col("_low")) * BINS))
    ranges = rows.where(f"_values > {EXACT_ROWS}").withColumn("_bin", place).groupBy("metric", "side", "_bin")
    total = F.sum("n")
    ranges = ranges.agg(total.alias("n"), (F.sum(F.col("n") * F.col("value")) / total).alias("mean"), F.sum(F.col("n") * F.col("value") * F.col("value")).alias("_square"))
    return exact.unionByName(ranges.select("metric", "side", "n", "mean", F.greatest(F.lit(0.0), F.col("_square") - F.col("n") * F.col("mean") * F.col("mean")).alias("spread")))


def delta_intervals(candidate: DataFrame, baseline: DataFrame, resamples: int = DELTA_RESAMPLES, confidence: float = 0.95, seed: int = SEED) -> DataFrame:
    """Unpaired bootstrap of the difference of means of two tables(metric, value), null below LEAST_PAIRS values on a side.

    Only the counts of different values move: a resample of n values is a multinomial draw over them. Where they are more than EXACT_ROWS it is one
    over ranges of them, with a normal term for what varies within the ranges; a task holds EXACT_ROWS numbers of a metric at most.
    """
    counts = lambda rows, side: rows.where("value is not null").groupBy("metric", "value").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
    both = _binned(counts(candidate, 1).unionByName(counts(baseline, 0)))

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        rng, means, sides = np.random.default_rng(seed), {}, {}
        for side in (1, 0):
            own = frame[frame["side"] == side].sort_values("mean")
            n, mean = own["n"].to_numpy(dtype=np.int64), own["mean"].to_numpy()
            sides[side] = total = int(n.sum())
            if total:
                within = own["spread"].to_numpy() / n
                parts = []
                for k in _blocks(resamples):
                    drawn = rng.multinomial(total, n / total, k)
                    parts.append(drawn @ mean / total)
                    if within.any():
                        parts[-1] = parts[-1] + rng.standard_normal(k) * np.sqrt(drawn @ within) / total
                means[side] = np.concatenate(parts)
        low, high = (None, None) if min(sides.values()) < LEAST_PAIRS else _mean_interval(np.sort(means[1] - means[0]), confidence)
        return pd.DataFrame([[frame["metric"].iloc[0], low, high]], columns=["metric", "ci_low", "ci_high"])

    return both.groupBy("metric").applyInPandas(draw, "metric string, ci_low double, ci_high double")


def paired_values(candidate: DataFrame, baseline: DataFrame, order: str | None = None) -> DataFrame:
    """scores(example_id, metric, value, passed) of two runs as metric, example_id, value (candidate less baseline), v, b.

    A missing value is 1 or 0 by `passed`; of several scores of an example the last by `order` counts.
    """

    def one(rows: DataFrame, name: str) -> DataFrame:
        given = F.coalesce("value", F.col("passed").cast("double")) if "passed" in rows.columns else F.col("value")
        rows = rows.withColumn("_given", given).where("_given is not null")
        last = F.max_by("_given", order) if order else F.max("_given")
        return rows.groupBy("example_id", "metric").agg(last.alias(name))

    both = one(candidate, "v").join(one(baseline, "b"), ["example_id", "metric"])
    return both.select("metric", "example_id", (F.col("v") - F.col("b")).alias("value"), "v", "b")


def unpaired_counts(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per metric the examples with a value in both runs, in one only, and those that errored."""
    side = lambda rows, s: rows.select("metric", "example_id", F.lit(s).alias("side"), F.col("value").isNotNull().alias("ok"))
    has = lambda s: F.bool_or((F.col("side") == s) & F.col("ok"))
    each = side(candidate, 1).unionByName(side(baseline, 2)).groupBy("metric", "example_id").agg(has(1).alias("c"), has(2).alias("b"), F.bool_or(~F.col("ok")).alias("errored"))
    count = lambda c: F.count(F.when(c, 1))
    c, b = F.col("c"), F.col("b")
    return each.groupBy("metric").agg(count(c & b).alias("paired"), count(c & ~b).alias("candidate_only"), count(b & ~c).alias("baseline_only"), count(F.col("errored")).alias("errored"))


def analyse(candidate: DataFrame, baseline: DataFrame, alpha: float = 0.05, order: str | None = None) -> DataFrame:
    """A test for each metric of two runs: exact McNemar where all values are 0 or 1, else the paired bootstrap, from LEAST_PAIRS pairs on.

    Returns metric, n, mean, test, p, p_adjusted (Holm), mde and significant; p is null for `insufficient_data`.
    """
    pairs = paired_values(candidate, baseline, order)
    v, b = F.col("v"), F.col("b")
    found = pairs.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stddev"), F.every(v.isin(0, 1) & b.isin(0, 1)).alias("binary"),
        F.count(F.when((b == 1) & (v == 0), 1)).alias("lost"), F.count(F.when((b == 0) & (v == 1), 1)).alias("won"),
    )
    few = F.col("n") < LEAST_PAIRS
    found = found.withColumn("test", F.when(few, "insufficient_data").when(F.col("binary"), "mcnemar").otherwise("paired_bootstrap"))
    drawn = paired_bootstrap(pairs.join(found.where("test = 'paired_bootstrap'").select("metric"), "metric", "left_semi"))
    p = F.when(F.col("test") == "mcnemar", mcnemar_p(F.col("lost"), F.col("won"))).otherwise(F.col("p"))
    tests = found.join(drawn.select("metric", "p"), "metric", "left").withColumn("p", p)
    mde = F.when(few, None).otherwise((Z_ALPHA + Z_POWER) * F.col("stddev") / F.sqrt("n"))
    adjusted = holm(tests.where("p is not null").select("metric", "p")).select("metric", "p_adjusted")
    out = tests.join(adjusted, "metric", "left")
    return out.select("metric", "n", "mean", "test", "p", "p_adjusted", mde.alias("mde"), F.coalesce(F.col("p_adjusted") <= alpha, F.lit(False)).alias("significant"))


def metrics_with_intervals(rows: DataFrame, slice_by: list[str] = (), **options) -> DataFrame:
    """aggregate_scores() with the bootstrap interval of each mean, null below LEAST_PAIRS values. rows need an example_id too."""
    sliced = sliced_scores(rows, list(slice_by), "example_id").where("error is null and value is not null")
    metrics = aggregate_scores(rows, list(slice_by))
    enough = sliced.join(metrics.where(F.col("n") >= LEAST_PAIRS).select("metric", "slice"), ["metric", "slice"], "left_semi")
    return metrics.join(mean_intervals(enough, **options), ["metric", "slice"], "left")


def compared_runs(candidate: DataFrame, baseline: DataFrame, slice_by: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """Two runs' scores to compare_metrics() of their means, with the paired test of each metric beside its row for the whole."""
    means = lambda rows: aggregate_scores(rows, list(slice_by)).select("metric", "slice", F.col("mean").alias("value"))
    good = lambda rows: rows.where("error is null")
    tests = analyse(good(candidate), good(baseline), alpha).select("metric", F.lit("").alias("slice"), "test", "p", "p_adjusted", "mde", "significant")
    return compare_metrics(means(candidate), means(baseline)).join(tests, ["metric", "slice"], "left")
