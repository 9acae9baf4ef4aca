from pyspark.sql import functions as F

from spanledger.operators import runs
from spanledger.sources import datasets


def examples(spark, n=2500):
    return spark.range(n).select(F.concat(F.lit("e"), "id").alias("id"), F.col("id").alias("ordinal"), (F.col("id") % 7).cast("double").alias("k"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"))


def test_filters_by_predicate_ids_and_limit(spark):
    rows = examples(spark, 50)
    names = {"k": (F.col("k"), "number"), "kind": (F.col("kind"), "string")}
    found = lambda **more: [r["ordinal"] for r in datasets.filtered(rows, **more).orderBy("ordinal").collect()]
    assert found(predicate="k > 4 and kind == 'odd'", names=names) == [i for i in range(50) if i % 7 > 4 and i % 2]
    assert found(limit=3) == [0, 1, 2] and found() == list(range(50)) and found(limit=0) == []
    ids = spark.createDataFrame([("e9",), ("e3",), ("e9",), ("none",), (None,)], "id string")
    assert found(ids=ids) == [3, 9] and found(ids=ids, limit=1) == [3]


def test_a_run_that_goes_on_skips_what_is_done(spark):
    journal = spark.createDataFrame([("e0", "ok"), ("e1", "error"), ("e2", "timeout"), ("e2", "ok"), ("e9", "skipped"), (None, "ok")], "example_id string, status string")
    left = datasets.left_to_run(examples(spark, 4), journal)
    assert sorted(r["id"] for r in left.collect()) == ["e1", "e3"]
    assert datasets.left_to_run(examples(spark, 4), journal.limit(0)).count() == 4


def test_results_and_values_in_the_order_of_the_dataset(spark):
    rows = examples(spark)
    results = rows.select(F.col("id").alias("example_id"), "k").repartition(7).unionByName(spark.createDataFrame([("other", 1.0)], "example_id string, k double"))
    got = [r["example_id"] for r in datasets.in_dataset_order(results, rows).collect()]
    assert got == [f"e{i}" for i in range(2500)] + ["other"]
    scores = rows.select(F.lit("m").alias("metric"), F.col("id").alias("example_id"), F.when(F.col("ordinal") != 5, F.col("ordinal").cast("double")).alias("value")).repartition(5)
    chunks = {r["chunk"]: r["values"] for r in datasets.value_chunks(scores, rows).collect()}
    assert sorted(chunks) == [0, 1, 2] and sum((chunks[c] for c in sorted(chunks)), []) == [float(i) for i in range(2500) if i != 5]
    assert max(map(len, chunks.values())) <= 1000


def test_rules_sources_and_vocabulary(spark):
    given = spark.createDataFrame([("t", 1, 10), ("t", 2, 20), ("t", 9, 20)], "trace_id string, rule_id int, created_at int")
    rules = spark.createDataFrame([(1, "one", True), (2, "two", False)], "rule_id int, name string, enabled boolean")
    assert [(r["rule"], r["place"]) for r in runs.evaluations_of(given, rules).orderBy("place").collect()] == [("two", 1), ("9", 2), ("one", 3)]
    claims = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "claim_id int, source_id int")
    documents = spark.createDataFrame([(5, None), (5, None)], "doc_id int, title string")
    assert sorted((r["claim_id"], r["grounded"]) for r in runs.sourced_claims(claims, documents).collect()) == [(1, True), (2, False), (3, False)]
    words = spark.createDataFrame([("a", "x"), ("a", "z"), ("a", "y"), ("b", "x"), ("b", None)], "k string, w string")
    assert sorted((r["k"], r["others"], r["approved"]) for r in runs.outside_vocabulary(words, ["k"], "w", ["x"]).collect()) == [("a", ["y", "z"], False), ("b", [], True)]
