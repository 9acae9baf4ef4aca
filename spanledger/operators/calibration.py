"""A judge against human labels: agreement, biases, a report in one row, and what it must meet.

Everything but the bootstrap of kappa is an aggregate over counted (human, judge) cells, so it costs one shuffle of
as many rows as there are pairs of labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scores import directional_rates, kappa, wilson

KAPPA_RESAMPLES, SEED = 2_000, 42
#: How far a judge may be from the humans' own agreement, and what counts as a bias.
CEILING, BIASED, COMPRESSED, VERBOSE = 0.05, 0.2, 0.5, 0.3


def matched(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """labels(example_id, human, ...) with verdicts(example_id, judge, errored, ...), an adjudicated label first where there is one."""
    human = F.coalesce("adjudicated", "human") if "adjudicated" in labels.columns else F.col("human")
    return labels.withColumn("human", human).join(verdicts, "example_id").where("not coalesce(errored, false) and judge is not null and human is not null")


def match_counts(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """How many examples have both, a verdict without a label, a label without a verdict, and errors."""
    side = lambda rows, s, bad: rows.select("example_id", F.lit(s).alias("side"), bad.alias("bad"))
    rows = side(labels, 1, F.lit(False)).unionByName(side(verdicts, 2, F.coalesce("errored", F.lit(False)) | F.col("judge").isNull()))
    each = rows.groupBy("example_id").agg(F.bool_or(F.col("side") == 1).alias("l"), F.bool_or(F.col("side") == 2).alias("v"), F.bool_or("bad").alias("bad"))
    count = lambda c: F.count(F.when(c, 1))
    l, v = F.col("l"), F.col("v")
    return each.agg(count(l & v & ~F.col("bad")).alias("usable"), count(v & ~l).alias("unknown"), count(l & ~v).alias("unjudged"), count(l & v & F.col("bad")).alias("errored"))


def kappa_interval(pairs: DataFrame, scale: list[str], weights: str = "none", resamples: int = KAPPA_RESAMPLES, confidence: float = 0.95, seed: int = SEED) -> DataFrame:
    """kappa_low, kappa_high by resampling the counted cells (a multinomial draw is a resample of the pairs); undefined resamples are left out."""
    cells = pairs.where(F.col("human").isin(scale) & F.col("judge").isin(scale)).groupBy("human", "judge").agg(F.count("*").alias("n"))
    k = len(scale)
    i, j = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
    distance = {"none": (i != j).astype(float), "linear": np.abs(i - j).astype(float), "quadratic": (i - j) ** 2.0}[weights]

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values(["human", "judge"])
        n = int(own["n"].sum())
        at = own["human"].map(scale.index).to_numpy() * k + own["judge"].map(scale.index).to_numpy()
        table = np.zeros((resamples, k * k))
        table[:, at] = np.random.default_rng(seed).multinomial(n, own["n"].to_numpy() / n, resamples)
        table = table.reshape(resamples, k, k) / n
        chance = np.einsum("ri,rj,ij->r", table.sum(axis=2), table.sum(axis=1), distance)
        seen = (table * distance).sum(axis=(1, 2))
        values = np.sort(1 - seen[chance > 1e-12] / chance[chance > 1e-12])
        tail = (1 - confidence) / 2
        low, high = (None, None) if not len(values) else (values[max(0, int(tail * len(values)) - 1)], values[min(len(values) - 1, int((1 - tail) * len(values)))])
        return pd.DataFrame({"kappa_low": [low], "kappa_high": [high]})

    return cells.groupBy(F.lit(1).alias("_all")).applyInPandas(draw, "kappa_low double, kappa_high double")


def per_class(pairs: DataFrame) -> DataFrame:
    """label, support, recall, precision and the commonest wrong label of each human label."""
    cells = pairs.groupBy("human", "judge").agg(F.count("*").alias("n"))
    called = cells.groupBy(F.col("judge").alias("label")).agg(F.sum("n").alias("called"))
    same = F.col("human") == F.col("judge")
    wrong = F.when(~same, F.struct(-F.col("n"), F.col("judge").alias("label")))
    own = cells.groupBy(F.col("human").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(same, F.col("n")).otherwise(0)).alias("hits"), F.min(wrong)["label"].alias("confused_with"))
    return own.join(called, "label", "left").select("label", "support", (F.col("hits") / F.col("support")).alias("recall"), F.try_divide("hits", "called").alias("precision"), "confused_with")


def _place(label: Column, scale: list[str]) -> Column:
    at = F.array_position(F.array(*map(F.lit, scale)), label)
    return F.when(at > 0, (at - 1).cast("double"))


def scale_effects(pairs: DataFrame, scale: list[str]) -> DataFrame:
    """leniency (mean of judge less human, in steps of the scale) and compression (ratio of spreads); null if a label is off the scale or nothing is spread."""
    h, j = _place(F.col("human"), scale), _place(F.col("judge"), scale)
    rows = pairs.select(h.alias("h"), j.alias("j"))
    whole = F.every(F.col("h").isNotNull() & F.col("j").isNotNull())
    return rows.agg(F.when(whole, F.avg("j") - F.avg("h")).alias("leniency"), F.when(whole, F.try_divide(F.stddev_samp("j"), F.nullif(F.stddev_samp("h"), F.lit(0.0)))).alias("compression"))


def verbosity_bias(pairs: DataFrame, scale: list[str]) -> DataFrame:
    """Pearson's correlation of output_length and the judge's signed error; null below three pairs or if one is constant."""
    error = _place(F.col("judge"), scale) - _place(F.col("human"), scale)
    rows = pairs.select(F.col("output_length").cast("double").alias("x"), error.alias("y")).dropna()
    spread = (F.stddev_samp("x") > 0) & (F.stddev_samp("y") > 0)
    return rows.agg(F.when((F.count("*") >= 3) & spread, F.corr("x", "y")).alias("verbosity_bias"), F.count("*").alias("n"))


def position_bias(probes: DataFrame) -> DataFrame:
    """probes(first, swapped): the place, 1 or 2, of the winner before and after the two outputs were swapped; null if unresolved.

    Inconsistent is a pair whose winner changed, that is, whose winning place stayed; of these the share won by the first place.
    """
    ok = F.col("first").isNotNull() & F.col("swapped").isNotNull()
    stays = (F.col("first") == F.col("swapped")).cast("double")
    first = ((F.col("first") == 1) & (F.col("swapped") == 1)).cast("double")
    out = probes.agg(F.count(F.when(ok, 1)).alias("n_pairs"), F.avg(F.when(ok, stays)).alias("inconsistency"), F.avg(F.when(ok, first)).alias("first_position"), F.count(F.when(~ok, 1)).alias("unresolved"))
    return out.withColumn("biased", F.coalesce((F.col("inconsistency") > BIASED) | (F.col("first_position") > BIASED), F.lit(False)))


def human_ceiling(pairs: DataFrame, scale: list[str], weights: str = "none") -> DataFrame:
    """On examples with a second human label: kappa of the two humans, of the judge, their number, and whether the judge is at the ceiling."""
    twice = pairs.where("second is not null")
    humans = kappa(twice.select("human", F.col("second").alias("judge")), scale, weights).select(F.col("kappa").alias("human_kappa"), F.col("n").alias("n_twice"))
    judge = kappa(twice.select("human", "judge"), scale, weights).select(F.col("kappa").alias("judge_kappa_twice"))
    both = humans.join(F.broadcast(judge), F.lit(True))  # one row each
    return both.withColumn("at_ceiling", F.coalesce(F.col("judge_kappa_twice") >= F.col("human_kappa") - CEILING, F.lit(False)))


def histogram(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def combine_votes(votes: DataFrame) -> DataFrame:
    """votes(example_id, value, label) of a judge asked several times: the median with 1 - spread as confidence, or the commonest label with its share; ties go to the lesser label."""
    numbers = votes.where("value is not null").groupBy("example_id").agg(F.percentile("value", F.lit(0.5)).alias("value"), (1 - (F.max("value") - F.min("value"))).alias("confidence"), F.count("*").alias("n"))
    named = votes.where("value is null and label is not null").groupBy("example_id", "label").agg(F.count("*").alias("k"))
    most = named.groupBy("example_id").agg(F.min_by("label", F.struct(-F.col("k"), "label")).alias("label"), (F.max("k") / F.sum("k")).alias("confidence"), F.sum("k").alias("n"))
    return numbers.select("example_id", "value", F.lit(None).cast("string").alias("label"), "confidence", "n").unionByName(most.select("example_id", F.lit(None).cast("double").alias("value"), "label", "confidence", "n"))


def to_label(label: Column, passed: Column, value: Column, raw: Column, scale: list[str] | None) -> Column:
    """A score in the humans' labels: its label, else pass or fail, else the nearest point of the scale (halves to the even one); null without a scale."""
    out = F.coalesce(label, F.when(passed, "pass").when(~passed, "fail"))
    if not scale:
        return out
    points = F.array(*map(F.lit, scale))
    at = F.least(F.greatest(F.bround(value * (len(scale) - 1)).cast("int"), F.lit(0)), F.lit(len(scale) - 1))
    return F.coalesce(out, F.when(F.array_contains(points, raw), raw), F.when(value.isNotNull(), F.get(points, at)))


def report(labels: DataFrame, verdicts: DataFrame, scale: list[str], passing: list[str], weights: str = "none") -> DataFrame:
    """One row: counts, agreement with its Wilson interval, kappa with its interval, directional errors, ceiling, scale effects, verbosity, cost and latency.

    labels(example_id, human, second, adjudicated, output_length), verdicts(example_id, judge, errored, cost, latency_ms).
    """
    pairs = matched(labels, verdicts)
    agreed = pairs.agg(F.sum((F.col("human") == F.col("judge")).cast("double")).alias("s"), F.count("*").cast("double").alias("m"))
    low, high = wilson(F.col("s"), F.col("m"))
    money = verdicts.agg(F.sum("cost").alias("total_cost"), F.avg("cost").alias("mean_cost"), F.percentile("latency_ms", F.lit(0.5)).alias("p50_latency_ms"), F.percentile("latency_ms", F.lit(0.95)).alias("p95_latency_ms"))
    parts = [
        match_counts(labels, verdicts), agreed.select(low.alias("agreement_low"), high.alias("agreement_high")), kappa(pairs.select("human", "judge"), scale, weights),
        kappa_interval(pairs, scale, weights), directional_rates(pairs, passing).drop("n"), human_ceiling(pairs, scale, weights), scale_effects(pairs, scale), verbosity_bias(pairs, scale).drop("n"),
        pairs.groupBy("human").count().agg(F.min("count").alias("least_support")), money,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part), F.lit(True), "left")  # one row each
    return out


def check_requirement(reports: DataFrame, min_examples: int = 100, min_per_class: int = 10, max_error_rate: float = 0.05, min_agreement: float = 0.8, min_kappa: float | None = None, max_false_pass: float | None = None, max_false_fail: float | None = None, position_biased: bool = False) -> DataFrame:
    """satisfied, failures and warnings (codes) of a report's row. A low kappa is a warning only for a judge at the humans' ceiling."""
    c = F.col
    error_rate = F.try_divide(c("errored"), c("usable") + c("errored"))
    failures = [("too_few_examples", c("usable") < min_examples), ("thin_class", c("least_support") < min_per_class), ("error_rate", error_rate > max_error_rate), ("agreement", c("agreement") < min_agreement), ("position_bias", F.lit(position_biased))]
    warnings = [("agreement_straddles", (c("agreement") >= min_agreement) & (c("agreement_low") < min_agreement)), ("compressed_scale", c("compression") < COMPRESSED), ("verbosity", F.abs("verbosity_bias") > VERBOSE)]
    if min_kappa is not None:
        failures += [("kappa_undefined", c("kappa").isNull()), ("kappa", (c("kappa") < min_kappa) & ~c("at_ceiling"))]
        warnings += [("kappa_at_ceiling", (c("kappa") < min_kappa) & c("at_ceiling"))]
    failures += [("false_pass", c("false_pass") > max_false_pass)] if max_false_pass is not None else []
    failures += [("false_fail", c("false_fail") > max_false_fail)] if max_false_fail is not None else []
    named = lambda xs: F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), name) for name, when in xs]))
    return reports.withColumn("failures", named(failures)).withColumn("warnings", named(warnings)).withColumn("satisfied", F.size("failures") == 0)


def newest_calibration(records: DataFrame) -> DataFrame:
    """records(evaluator, version, calibrated_at): the newest of each evaluator and version."""
    w = Window.partitionBy("evaluator", "version").orderBy(F.col("calibrated_at").desc())
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
