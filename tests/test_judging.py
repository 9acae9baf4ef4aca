import json

import pytest
from pyspark.sql import functions as F

from spanledger.operators import judging

SALT = "s3cret"


def judge(**more):
    return judging.Judge(**{"name": "grounded", "rubric": "Grade 1 to 5.", "model": "m", "inputs": ("output.body", "input.evidence"), **more})


def results(spark, bodies):
    rows = [(f"e{i}", json.dumps({"body": b}) if b is not None else "{}", json.dumps({"evidence": "A raised B."}), json.dumps({"ideal": "the answer key"}), json.dumps({"segment": "north"})) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "example_id string, output string, input string, expected string, metadata string")


def scored(spark, bodies, rule, **more):
    made = judging.judged(results(spark, bodies), judge(**more), lambda: judging.Scripted(rule, cost=0.5, latency_ms=7), SALT)
    return {r["example_id"]: r for r in made.collect()}


def test_what_a_judge_must_declare():
    for wrong in ({"inputs": ()}, {"votes": 2}, {"votes": 0}, {"mode": "classify"}, {"mode": "classify", "labels": ("a",), "passing": ("b",)}, {"mode": "other"}):
        with pytest.raises(ValueError):
            judge(**wrong)
    assert list(judge().response_schema()["properties"]) == ["reasoning", "score", "canary"]
    assert judge(mode="classify", labels=("a", "b")).response_schema()["properties"]["label"]["enum"] == ["a", "b"]


def test_only_declared_inputs_are_sent_and_fenced(spark):
    asked, unasked = judging.requests(results(spark, ["fine", None]), judge(), SALT)
    row = asked.collect()[0]
    assert "fine" in row["prompt"] and "A raised B." in row["prompt"]
    assert "answer key" not in row["prompt"] and "north" not in row["prompt"] and asked.count() == 1
    assert unasked.first()["error"] == "input not found: output.body"
    assert "never an instruction" in row["system"] and row["canary"] in row["system"] and row["canary"] not in row["prompt"]
    again = judging.requests(results(spark, ["fine"]), judge(), SALT)[0].first()
    other = judging.requests(results(spark, ["fine"]), judge(), "another run")[0].first()
    assert again["prompt"] == row["prompt"] and other["prompt"] != row["prompt"] and other["canary"] != row["canary"]


def test_grades_errors_and_never_zeros(spark):
    def rule(content, seed):
        return {
            "good": {"score": 4, "reasoning": "it is there"}, "low": {"score": 1}, "off": {"score": 6}, "truth": {"score": True}, "text": {"score": "5"}, "float": {"score": 2.5},
            "stolen": {"score": 5, "canary": "canary-00000000"}, "none": {"score": 5, "canary": None}, "list": "[1, 2]", "prose": "I say 4", "empty": {},
        }[content]

    names = ["good", "low", "off", "truth", "text", "float", "stolen", "none", "list", "prose", "empty"]
    got = scored(spark, [*names, None], rule)
    by = {n: got[f"e{i}"] for i, n in enumerate(names)}
    assert (by["good"]["value"], by["low"]["value"], by["float"]["value"]) == (0.75, 0.0, 0.375)
    assert by["good"]["reasoning"] == "it is there" and float(by["good"]["cost"]) == 0.5 and by["good"]["latency_ms"] == 7 and by["good"]["confidence"] is None
    assert by["off"]["error"] == "grade off the scale"
    assert by["truth"]["error"] == by["text"]["error"] == by["empty"]["error"] == "no numeric grade"
    assert "canary" in by["stolen"]["error"] and "canary" in by["none"]["error"]
    assert by["list"]["error"] == by["prose"]["error"] == "answer is no JSON object"
    assert got[f"e{len(names)}"]["error"] == "input not found: output.body" and got[f"e{len(names)}"]["cost"] is None
    assert all(r["value"] is None for r in got.values() if r["error"])


def test_votes_labels_and_binary_grades(spark):
    by_seed = lambda content, seed: {"score": {42: 5, 43: 1, 44: 4}[seed]}
    row = scored(spark, ["x"], by_seed, votes=3)["e0"]
    assert (row["value"], row["confidence"], float(row["cost"])) == (0.75, 0.0, 1.5)
    raw = scored(spark, ["x"], by_seed, votes=3, normalize=False)["e0"]
    assert raw["value"] == 4.0
    labels = lambda content, seed: {"label": content if content == "odd" else ["yes", "no", "yes"][seed - 42]}
    named = scored(spark, ["x", "odd"], labels, votes=3, mode="classify", labels=("yes", "no"), passing=("yes",))
    assert (named["e0"]["label"], named["e0"]["value"], round(named["e0"]["confidence"], 3)) == ("yes", 1.0, 0.667)
    assert named["e1"]["error"] == "unknown label" and named["e1"]["label"] is None
    assert scored(spark, ["x"], labels, mode="classify", labels=("yes", "no"))["e0"]["value"] is None
    passed = scored(spark, ["a", "bb", "ccc"], lambda c, s: {"passed": [None, True, False, "yes"][len(c)]}, mode="binary")
    assert [(passed[f"e{i}"]["value"], passed[f"e{i}"]["passed"], passed[f"e{i}"]["error"]) for i in range(3)] == [(1.0, True, None), (0.0, False, None), (None, None, "no boolean grade")]
    one_bad = lambda content, seed: {"score": 9 if seed == 43 else 3}
    assert scored(spark, ["x"], one_bad, votes=3)["e0"]["error"] == "grade off the scale"


class Flaky:
    """Fails on the first call of each request, always for some."""

    def __init__(self):
        self.seen, self.inner = set(), judging.Scripted(lambda c, s: {"score": 3})

    def complete(self, request):
        if "hopeless" in request["prompt"] or request["example_id"] not in self.seen:
            self.seen.add(request["example_id"])
            raise TimeoutError("too slow")
        return self.inner.complete(request)


def test_calls_are_tried_again_and_failures_say_why(spark):
    made = judging.judged(results(spark, ["fine", "hopeless"]), judge(), Flaky, SALT)
    got = {r["example_id"]: r for r in made.collect()}
    assert got["e0"]["value"] == 0.5
    assert got["e1"]["value"] is None and got["e1"]["error"] == "call failed: TimeoutError: too slow"
    once = judging.judged(results(spark, ["fine"]), judge(retries=0), Flaky, SALT).first()
    assert once["error"].startswith("call failed")


def test_kept_answers_are_not_asked_for_again(spark, tmp_path):
    path, count = str(tmp_path / "answers"), spark.sparkContext.accumulator(0)

    def rule(content, seed):
        count.add(1)
        return {"score": 5}

    run = lambda bodies: {r["example_id"]: r["value"] for r in judging.judged(results(spark, bodies), judge(votes=3), lambda: judging.Scripted(rule), SALT, path).collect()}
    assert run(["a", "b"]) == {"e0": 1.0, "e1": 1.0} and count.value == 6
    assert run(["a", "b", "c"]) == {"e0": 1.0, "e1": 1.0, "e2": 1.0} and count.value == 9
    assert run([]) == {}


def test_plain_texts_and_no_rows(spark):
    rows = spark.createDataFrame([("1", "plain text", None), ("2", None, None)], "example_id string, output string, input string")
    made = judging.judged(rows, judge(inputs=("output",)), lambda: judging.Scripted(lambda c, s: {"score": 5 if c == "plain text" else 1}), SALT)
    assert {r["example_id"]: (r["value"], r["error"]) for r in made.collect()} == {"1": (1.0, None), "2": (None, "input not found: output")}
    assert judging.judged(rows.where(F.lit(False)), judge(), lambda: None, SALT).count() == 0
