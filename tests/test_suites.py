import json

import pytest

from spanledger.operators import corpus, judging
from spanledger.sources import suites
from spanledger.suite import EvalSuite

SUITE = """
kind: EvalSuite
name: everything
execution: {slice_by: []}
evaluators:
  - {name: intent, type: classification, prediction_field: intent, averaging: macro}
  - {name: leads, type: ranking, k: 2}
  - {name: sure, type: calibration}
  - {name: order, type: discrimination, prediction_field: p, label_field: won}
  - {name: ops, type: operational, percentiles: [50, 90]}
  - {name: rules, type: trajectory, policy: policy.yaml}
  - {name: tone, type: llm_judge, model: m, rubric_path: tone.md, inputs: [output.intent], scale: {min: 1, max: 5}}
  - {name: same, type: exact_match, field: output.intent, expected: expected.intent}
  - {name: shape, type: json_schema, schema: {type: object, required: [intent]}}
  - {name: words, type: regex, field: output.intent, allow: ["^[a-z]+$"]}
  - {name: has, type: contains, field: output.intent, needles: [u]}
  - {name: size, type: length, field: output.intent, max: 10}
  - {name: range, type: numeric_range, field: output.p, min: 0, max: 1}
  - {name: sets, type: set_comparison, field: output.results, expected: expected.relevant, mode: subset}
gates:
  intent_macro_f1: {minimum: 0.5}
  leads_mrr: {minimum: 0.5}
  p90_latency_ms: {maximum: 1000}
  rules: {minimum: 0.5}
  tone: {minimum: 0.5}
  same: {minimum: 0.1, max_regression: 0.05, significance: 0.05}
"""
POLICY = """
kind: TrajectoryPolicy
name: calls
rules:
  - id: search-first
    kind: forbidden_before
    action: buy
    before: search
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "suite.yaml").write_text(SUITE)
    (tmp_path / "policy.yaml").write_text(POLICY)
    (tmp_path / "tone.md").write_text("Is it kind? 1 to 5.")
    return tmp_path


def results(spark, n=60, wrong=0):
    rows = []
    for i in range(n):
        kind = ["buy", "run", "sue"][i % 3]
        out = {"intent": kind if i % 10 >= wrong else "run" if kind != "run" else "buy", "confidence": 0.9, "p": (i % 7) / 7, "results": [f"a{i % 5}", "a1", "a2"]}
        rows.append((f"e{i}", json.dumps(out), json.dumps({"intent": kind, "relevant": ["a1", "a9"], "won": i % 7 > 3}), None, "ok" if i % 20 else "error", float(i), 0.01, f"t{i}"))
    return spark.createDataFrame(rows, "example_id string, output string, expected string, metadata string, status string, latency_ms double, cost double, trace_id string")


def traces(spark, n=60):
    rows = []
    for i in range(n):
        for k, action in enumerate(["search", "buy"] if i % 4 else ["buy"]):
            rows.append((f"t{i}", f"s{k}", None, action, "tool", action, "ok", k * 10, k * 10 + 5, k, {}, "{}", k))
    return spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, name string, span_type string, tool_name string, status string, started_us long, ended_us long, sequence_index int, attributes map<string,string>, tool_args string, arrival long")


def client():
    return judging.Scripted(lambda content, seed: {"score": 5 if content != "sue" else 2})




def suite_of(folder, **more):
    return EvalSuite.from_file(str(folder / "suite.yaml"), client=client, salt="s", answers=str(folder / "answers"), **more)


def test_a_suite_with_all_types_runs_to_a_pass_and_to_a_fail(spark, folder):
    suite = suite_of(folder)
    good, bad = results(spark), results(spark, wrong=4)
    spans = traces(spark)
    report = suite.evaluate(good, baseline=good, spans=spans)
    metrics = {(m["metric"], m["slice"]): m for m in report["metrics"]}
    assert metrics["intent_macro_f1", ""]["mean"] == 1.0 and metrics["intent_recall", "class=sue"]["n"] > 0
    assert {"leads_mrr", "leads_map", "leads_precision_at_2", "sure_ece", "sure_brier", "order_auc", "p50_latency_ms", "total_cost", "tone", "rules", "same", "sets"} <= {m for m, _ in metrics}
    by = {g["rule"]: g for g in report["gates"]}
    assert by["same"]["clause"] == "ok" and by["tone"]["verdict"] == "pass" and by["intent_macro_f1"]["verdict"] == "pass"
    suite.evaluators, suite.corpus, suite.gates = {"same": suite.evaluators["same"]}, {}, {"same": suite.gates["same"]}
    worse = suite.evaluate(bad, baseline=good)
    by = {g["rule"]: g for g in worse["gates"]}
    assert by["same"]["clause"] == "regression" and by["same"]["verdict"] == "fail" and worse["exit_code"] == 1


def test_power_and_significance_are_known_when_scores_are_paired(spark):
    def verdict(candidate, baseline, **gate):
        suite = EvalSuite("paired")
        suite.evaluator("same")(lambda output, expected: output["intent"] == expected["intent"])
        suite.gate("same", **gate)
        return suite.evaluate(candidate, baseline=baseline)["gates"][0]["clause"]

    good, slightly, bad = results(spark, 200), results(spark, 200, wrong=1), results(spark, 200, wrong=5)
    assert verdict(good, good, max_regression=0.05, require_power=True) == "ok"
    assert verdict(slightly, good, max_regression=0.01, require_power=True) == "underpowered"
    assert verdict(bad, good, max_regression=0.05, significance=0.05) == "regression"
    few = good.limit(12)
    assert verdict(results(spark, 12, wrong=1), few, max_regression=0.05, significance=0.05) == "not_significant"


def test_judges_without_client_or_calibration(spark, folder):
    with pytest.raises(suites.SuiteError, match="no client"):
        EvalSuite.from_file(str(folder / "suite.yaml"))
    suite = suite_of(folder)
    suite.calibrated = True
    suite.gates = {"tone": {"minimum": 0.1}}
    suite.evaluators = {"tone": suite.evaluators["tone"]}
    suite.corpus = {}
    rows = results(spark, 10)
    assert {g["rule"]: g["clause"] for g in suite.evaluate(rows)["gates"]} == {"tone": "ok", "tone#calibration": "uncalibrated_judge"}
    known = spark.createDataFrame([("tone", suite.judges[0][1], "2024-01-01", True)], "metric string, version string, calibrated_at string, satisfied boolean")
    assert suite.evaluate(rows, calibrations=known)["verdict"] == "pass"


def test_metrics_of_a_run_without_usable_rows(spark):
    none = results(spark, 3).where("example_id = 'nothing'")
    for make in (lambda r: corpus.classification(r, "c"), lambda r: corpus.ranking(r, "r"), lambda r: corpus.calibration(r, "k"), lambda r: corpus.discrimination(r, "d")):
        assert all((m["mean"], m["n"]) == (0.0, 0) for m in make(none).collect())
    one_class = results(spark, 3)
    assert corpus.discrimination(one_class, "d", "p", "won").first()["n"] == 0


def test_ranking_metrics_by_hand(spark):
    rows = spark.createDataFrame([("1", '{"results": [{"id": "b"}, "a", "c"]}', '{"relevant": ["a", "c", "z"]}', "ok"), ("2", '{"results": []}', '{"relevant": ["a"]}', "ok"), ("3", '{"results": ["q"]}', '{"relevant": []}', "ok")], "example_id string, output string, expected string, status string")
    got = {m["metric"]: m["mean"] for m in corpus.ranking(rows, "r", 2).collect()}
    gain = 1 / 1.5849625007211562
    assert got == pytest.approx({"r_precision_at_2": 0.25, "r_recall_at_2": 1 / 6, "r_ndcg_at_2": gain / (1 + gain) / 2, "r_mrr": 0.25, "r_map": 0.125})
