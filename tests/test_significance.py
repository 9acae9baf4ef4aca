import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.operators import comparison, significance

N = 60_000


@pytest.fixture(scope="module")
def values(spark):
    """A binary, a continuous and a heavily tied metric, 60,000 values each."""
    i = F.col("id")
    rows = spark.range(N).select(F.concat(F.lit("e"), i).alias("example_id"), (i % 2).cast("double").alias("binary"), F.randn(7).alias("normal"), F.when(i % 10 == 0, 1.0).otherwise(0.0).alias("tied"))
    return rows.select("example_id", F.expr("stack(3, 'binary', binary, 'normal', normal, 'tied', tied) as (metric, value)")).cache()


def test_width_is_that_of_theory_however_the_rows_lie(spark, values):
    theory = {m: 2 * 1.959964 * s / math.sqrt(N) for m, s in values.groupBy("metric").agg(F.stddev("value")).collect()}
    found = []
    for partitions in (1, 16, 200):
        dealt = values.repartitionByRange(partitions, "metric", "value")
        rows = significance.mean_intervals(dealt.withColumn("slice", F.lit("")), resamples=2000).collect()
        found.append({r["metric"]: (round(r["ci_low"], 9), round(r["ci_high"], 9)) for r in rows})
    assert found[0] == found[1] == found[2]
    for metric, (low, high) in found[0].items():
        assert abs((high - low) / theory[metric] - 1) < 0.05


def test_groups_agree_with_the_exact_resamples(spark, values):
    few = values.where("metric <> 'normal'").where(F.expr("cast(substring(example_id, 2) as int) < 15000")).withColumn("slice", F.lit(""))
    exact = {r[0]: r for r in significance.mean_intervals(few, resamples=5000).collect()}
    for row in significance.mean_intervals(few, resamples=5000, exact_rows=10).collect():
        a, b = exact[row["metric"]], row
        assert abs((b["ci_high"] - b["ci_low"]) / (a["ci_high"] - a["ci_low"]) - 1) < 0.1
        assert abs(b["ci_low"] - a["ci_low"]) < 0.1 * (a["ci_high"] - a["ci_low"])


def test_paired_bootstrap_finds_a_drop_and_leaves_noise(spark):
    i = F.col("id")
    pairs = spark.range(N).select(F.concat(F.lit("e"), i).alias("example_id"), F.expr("stack(2, 'drop', case when id % 50 = 0 then -1.0D else 0.0D end, 'noise', case when id % 50 = 0 then -1.0D when id % 50 = 1 then 1.0D else 0.0D end) as (metric, value)"))
    p = {r["metric"]: r["p"] for r in significance.paired_bootstrap(pairs, resamples=1000).collect()}
    assert p["drop"] < 0.002 and p["noise"] > 0.2


def test_difference_of_means_of_many_different_values(spark):
    side = lambda seed, shift: spark.range(N).select(F.lit("m").alias("metric"), (F.randn(seed) + shift).alias("value"))
    row = significance.delta_intervals(side(1, 0.1), side(2, 0.0), resamples=2000).first()
    assert abs((row["ci_high"] - row["ci_low"]) / (2 * 1.959964 * math.sqrt(2 / N)) - 1) < 0.08
    assert row["ci_low"] < 0.1 < row["ci_high"] + 0.02
    few = significance.delta_intervals(side(1, 0).limit(4), side(2, 0)).first()
    assert few["ci_low"] is None
    twice = [significance.delta_intervals(side(1, 0.1).repartition(k), side(2, 0.0), resamples=200).first() for k in (1, 9)]
    assert np.allclose(twice[0][1:], twice[1][1:])


def test_mcnemar_against_sums_of_binomials(spark):
    cases = [(0, 0), (1, 0), (0, 7), (5, 5), (10, 3), (3, 10), (60, 40), (40, 60), (300, 250), (1000, 1000)]
    rows = spark.createDataFrame(cases, "lost long, won long").select("lost", "won", comparison.mcnemar_p(F.col("lost"), F.col("won")).alias("p")).collect()
    for lost, won, p in rows:
        n = lost + won
        want = 1.0 if n == 0 else sum(math.comb(n, k) for k in range(lost, n + 1)) / 2**n
        assert math.isclose(p, want, rel_tol=1e-9, abs_tol=1e-300), (lost, won, p, want)
    huge = spark.createDataFrame([(5_000_100_000, 5_000_000_000)], "lost long, won long").select(comparison.mcnemar_p(F.col("lost"), F.col("won")).alias("p")).first()["p"]
    assert math.isclose(huge, 0.5 * math.erfc(1.0 / math.sqrt(2)), rel_tol=1e-3)
