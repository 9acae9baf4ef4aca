import json
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spanledger.functions import predicates, text
from spanledger.operators import comparison, scores, traces, trajectory
from spanledger.sources import datasets
from spanledger.streaming import online

EVENTS = "trace_id string, span_id long, parent_id long, action string, failed boolean, args int, started_us long, ended_us long"


def events(spark, *rows):
    return spark.createDataFrame([("t", i, None, a, f, k, s, e) for i, (a, f, k, s, e) in enumerate(rows)], EVENTS)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_slices_are_single_and_errors_are_no_zeros(spark):
    rows = spark.createDataFrame([("m", 1.0, None, "a", "x"), ("m", 0.0, None, "b", None), ("m", 0.0, "bad", "a", "x"), ("n", None, "bad", "a", "x")], "metric string, value double, error string, p string, q string")
    found = {(r["metric"], r["slice"]): (r["mean"], r["n"], r["n_errors"]) for r in scores.aggregate_scores(rows, ["p", "q"]).collect()}
    assert found == {("m", ""): (0.5, 2, 1), ("m", "p=a"): (1.0, 1, 1), ("m", "p=b"): (0.0, 1, 0), ("m", "q=x"): (1.0, 1, 1), ("n", ""): (0.0, 0, 1), ("n", "p=a"): (0.0, 0, 1), ("n", "q=x"): (0.0, 0, 1)}


def test_kappa_of_a_known_matrix(spark):
    cells = {("1", "2"): 24, ("2", "2"): 24, ("3", "2"): 23, ("3", "4"): 1, ("4", "4"): 24, ("5", "4"): 24}
    pairs = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "human string, judge string")
    row = scores.kappa(pairs, list("12345"), "quadratic").first()
    assert round(row["agreement"], 3) == 0.4 and round(row["kappa"], 3) == 0.8


@pytest.mark.parametrize("lost,won", [(0, 0), (3, 1), (10, 10), (0, 5), (40, 20)])
def test_mcnemar_tail(spark, lost, won):
    n = lost + won
    want = 1.0 if not n else sum(math.comb(n, k) for k in range(lost, n + 1)) / 2**n
    got = spark.createDataFrame([(lost, won)], "lost long, won long").select(comparison.mcnemar_p(F.col("lost"), F.col("won")).alias("p")).first()["p"]
    assert abs(got - want) < 1e-9


def test_gates_take_the_first_clause(spark):
    rules = spark.createDataFrame([("a", "m", "", 0.9, None, 0.1, None, True, None, True), ("b", "x", "", 0.9, None, None, None, False, None, False)], "rule string, metric string, slice string, minimum double, maximum double, max_regression double, max_relative double, require_baseline boolean, max_error_rate double, blocking boolean")
    metrics = spark.createDataFrame([("m", "", 0.5, 10, 0, None)], "metric string, slice string, value double, n long, n_errors long, baseline double")
    out = {r["rule"]: (r["clause"], r["verdict"]) for r in comparison.evaluate_gates(rules, metrics).collect()}
    assert out == {"a": ("minimum", "fail"), "b": ("metric_missing", "warn")}
    assert comparison.combined_verdict(comparison.evaluate_gates(rules, metrics)).first()["exit_code"] == 1


def test_retries_go_on_after_failures_and_end_with_success(spark):
    rows = events(spark, ("a", True, 1, 0, 1), ("b", False, 1, 2, 3), ("a", True, 1, 4, 5), ("a", False, 1, 6, 7), ("a", False, 1, 8, 9))
    assert [r["attempt"] for r in trajectory.with_retries(rows).orderBy("span_id").collect()] == [1, 1, 2, 3, 1]


def test_parallel_siblings_share_a_group_and_open_spans_start_none(spark):
    rows = events(spark, ("a", False, 1, 0, 10), ("b", False, 1, 5, 7), ("c", False, 1, 20, None), ("d", False, 1, 25, 30))
    assert [r["parallel_group"] for r in trajectory.with_parallel_groups(rows).orderBy("span_id").collect()] == [0, 0, None, None]


def test_absent_actions_count_as_zero(spark):
    rows = events(spark, ("a", False, 1, 0, 1))
    out = trajectory.counted(rows.select("trace_id").distinct(), rows, "z", least=1).first()
    assert (out["calls"], out["passed"]) == (0, False)


def test_forbidden_before_without_a_gate_fails(spark):
    assert trajectory.forbidden_before(events(spark, ("a", False, 1, 0, 1)), "a", "g").count() == 1
    assert trajectory.forbidden_before(events(spark, ("g", False, 1, 0, 1), ("a", False, 1, 2, 3)), "a", "g").count() == 0


def test_self_time_unites_overlapping_children(spark):
    rows = spark.createDataFrame([("t", 0, None, "r", False, 1, 0, 100), ("t", 1, 0, "c", False, 1, 10, 40), ("t", 2, 0, "c", False, 1, 30, 50), ("t", 3, 0, "c", False, 1, 90, 200)], EVENTS)
    assert traces.self_time(rows).where("span_id = 0").first()["self_us"] == 50


@pytest.mark.parametrize("expression,want", [("n > 3", True), ("missing > 3", False), ("missing == None", True), ("s in ['a', 'b']", True), ("s not in missing", True), ("not n", False), ("1 < n <= 5 and len(s) == 1", True), ("startswith(s, 'b') or exists(s)", True), ("n == s", False)])
def test_predicates(spark, expression, want):
    made = predicates.compile_predicate(expression, {"n": (F.lit(5), "number"), "s": (F.lit("a"), "string")})
    assert spark.range(1).select(made.alias("x")).first()["x"] is want


NAMES = {"n": (F.lit, 5, "number"), "s": (F.lit, "a", "string"), "code": (F.lit, "x1", "string"), "xs": (lambda v: F.array(*map(F.lit, v)), [1, 2], "array")}


@pytest.mark.parametrize(
    "expression,holds,fails",
    [
        ("int(code) > 3", False, True), ("int('7') > 3", True, False), ("int('7.5') > 3", False, True), ("float('7.5') > 7", True, False), ("int(missing) > 3", False, True), ("len(missing) > 0", False, True), ("len(n) > 0", False, True), ("len(xs) == 2", True, False),
        ("n < s", False, True), ("missing < s", False, False), ("n == s", False, False), ("n == 5 or int(code) > 3", True, False), ("n == 4 or int(code) > 3", False, True), ("n == 4 and int(code) > 3", False, False),
        ("exists(missing) and len(missing) > 1", False, False), ("not int(code)", False, True), ("abs(-n) == 5", True, False), ("-s == 1", False, True), ("max(n, missing) > 1", False, True), ("1 > n > int(code)", False, False), ("1 < n < int(code)", False, True),
        ("odd > 1", False, True), ("odd == 1", False, False), ("odd != 1", True, False), ("exists(odd)", True, False), ("odd", True, False), ("float(odd) > 1", False, True),
    ],
)
def test_predicates_tell_where_they_fail(spark, expression, holds, fails):
    names = {k: (make(v), kind) for k, (make, v, kind) in NAMES.items()} | {"odd": (F.lit(None).cast("double"), "number", F.lit(True))}
    made = predicates.checked_predicate(expression, names)
    assert tuple(spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(made)]).first()) == (holds, fails)


@pytest.mark.parametrize("expression", ["__import__('os')", "n.x()", "lambda: 1", "n +", "n < s"])
def test_predicates_refuse(expression, spark):
    with pytest.raises(predicates.PredicateError):
        predicates.compile_predicate(expression, {"n": (F.lit(5), "number"), "s": (F.lit("a"), "string")})


def test_redaction(spark):
    row = spark.createDataFrame([("mail a.b@c.org key AKIA" + "A" * 16,)], "t string").select(text.redacted(F.col("t")).alias("t")).first()
    assert row["t"] == "mail [REDACTED:email] key [REDACTED:aws_access_key]"


def test_jsonl_and_journal(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('// note\n\n{"input": {"a": 1}}\n{"id": "x", "expected": 2}\nnot json\n')
    rows = {r["line"]: (r["id"], r["input"], r["error"]) for r in datasets.jsonl_examples(spark, str(tmp_path / "a.jsonl")).collect()}
    assert rows == {3: ("ex-0003", '{"a":1}', None), 4: ("x", None, "no input"), 5: ("ex-0005", None, "not an object")}
    (tmp_path / "j.jsonl").write_text('{"example_id": "1", "status": "error"}\n{"example_id": "1", "status": "ok"}\n{"example_id": "2", "sta')
    assert [(r["example_id"], r["status"]) for r in datasets.run_journal(spark, str(tmp_path / "j.jsonl")).collect()] == [("1", "ok")]


def test_stream_decides_once(spark, tmp_path):
    day = 86_400
    put = lambda rows: spark.createDataFrame(rows, "trace_id string, n int").withColumn("started_at", F.timestamp_seconds(F.col("n"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def go():
        stream = spark.readStream.schema("trace_id string, n int, started_at timestamp").parquet(str(tmp_path / "in"))
        online.decide_once(stream, lambda b: b.where("trace_id <> 'c'").select("trace_id"), str(tmp_path / "out"), str(tmp_path / "ck"), delay="1 hour", lookback="10 days").awaitTermination()
        return sorted(r["trace_id"] for r in spark.read.parquet(str(tmp_path / "out/decisions")).collect())

    put([("a", 30 * day), ("a", 30 * day), ("b", 30 * day), ("c", 30 * day), ("old", 1)])
    assert go() == ["a", "b"]
    put([("a", 35 * day), ("c", 35 * day), ("d", 35 * day)])  # long after the state has forgotten them
    assert go() == ["a", "b", "d"]


def test_stream_keeps_spans(spark, tmp_path):
    schema = "trace_id string, span_id int, started_us int, status string, arrival int"

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        online.keep_spans(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out"))
        return sorted(tuple(r) for r in rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch").collect())

    assert go([("t", 1, 5, "unset", 1), ("t", 1, 6, "ok", 2)]) == [("t", 1, 6, "ok")]
    assert go([("t", 1, 9, "error", 3), ("t", 2, 7, "ok", 4)]) == [("t", 1, 6, "error"), ("t", 2, 7, "ok")]


def test_report_is_json(spark):
    assert json.loads(scores.confusion(spark.createDataFrame([("a", "b")], "actual string, predicted string")).toJSON().first())["n"] == 1
