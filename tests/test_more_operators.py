"""What the queries' SQL doesn't reach: seeded draws, files, odd values, user functions."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.functions import redaction, scalars, text, values
from spanledger.operators import ancestry, calibration, comparison, ingest, normalize, policy, runs, scores, significance
from spanledger.plans import more
from spanledger.sources import datasets, objects, suites
from spanledger.suite import EvalSuite, coerced


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_draws_are_those_of_the_seeded_generator(n):
    rng = random.Random(42)
    draws = significance.Twister(42, n)
    assert [*draws.take(123), *draws.take(377)] == [rng.randrange(n) for _ in range(500)]


def test_bootstrap_of_a_mean_by_hand(spark):
    data = [0.0, 1.0, 1.0, 0.5, 0.25, 1.0, 0.0]
    rng = random.Random(42)
    means = sorted(sum(data[rng.randrange(7)] for _ in range(7)) / 7 for _ in range(1000))
    rows = spark.createDataFrame([("m", "", i, v) for i, v in enumerate(data)] + [("one", "", 0, 0.5)], "metric string, slice string, example_id int, value double")
    out = {r["metric"]: r for r in significance.mean_intervals(rows, resamples=1000).collect()}
    assert (out["one"]["ci_low"], out["one"]["ci_high"]) == (0.5, 0.5)
    assert out["m"]["ci_low"] == pytest.approx(means[24]) and out["m"]["ci_high"] == pytest.approx(means[975])


def test_large_metrics_are_resampled_in_parts(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0.02, 1, 3000)
    rows = spark.createDataFrame([("m", i, float(x)) for i, x in enumerate(v)], "metric string, example_id int, value double")
    whole, parts = (significance.paired_bootstrap(rows, resamples=2000, exact_rows=n).first() for n in (10_000, 10))
    assert parts["ci_low"] == pytest.approx(whole["ci_low"], abs=0.01) and parts["ci_high"] == pytest.approx(whole["ci_high"], abs=0.01)
    assert parts["p"] == pytest.approx(whole["p"], abs=0.05)


def test_tests_are_chosen_by_the_values(spark):
    rows = lambda f: spark.createDataFrame([(i, m, f(m, i), None) for m in ("bits", "reals") for i in range(40)] + [(0, "few", 1.0, None), (1, "few", None, True)], "example_id int, metric string, value double, passed boolean")
    before = rows(lambda m, i: 1.0 if m == "bits" else i / 40)
    after = rows(lambda m, i: float(i % 4 > 0) if m == "bits" else i / 40 + 0.1)
    out = {r["metric"]: r for r in significance.analyse(after, before).collect()}
    assert out["bits"]["test"] == "mcnemar" and out["bits"]["p"] == pytest.approx(0.5**10) and out["bits"]["significant"]
    assert out["reals"]["test"] == "paired_bootstrap" and out["reals"]["p"] == 1.0
    assert out["few"]["test"] == "insufficient_data" and out["few"]["n"] == 2 and out["few"]["p"] is None and not out["few"]["significant"]


def test_kappa_of_a_known_matrix_lies_in_its_interval(spark):
    cells = {("1", "2"): 24, ("2", "2"): 24, ("3", "2"): 23, ("3", "4"): 1, ("4", "4"): 24, ("5", "4"): 24}
    pairs = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "human string, judge string")
    row = calibration.kappa_interval(pairs, list("12345"), "quadratic").first()
    assert 0.7 < row["kappa_low"] < 0.8 < row["kappa_high"] < 0.9
    effects = calibration.scale_effects(pairs, list("12345")).first()
    assert round(effects["leniency"], 4) == -0.1833 and round(effects["compression"], 4) == 0.6951
    assert calibration.scale_effects(pairs, list("123")).first()["leniency"] is None
    same = spark.createDataFrame([("1", "1")] * 5, "human string, judge string")
    assert calibration.kappa_interval(same, ["1", "2"]).first()["kappa_low"] is None


def test_requirement_names_what_is_lacking(spark):
    labels = spark.createDataFrame([(i, "pass" if i % 2 else "fail", None, i) for i in range(40)], "example_id int, human string, second string, output_length int")
    verdicts = spark.createDataFrame([(i, "pass" if i % 2 or i < 8 else "fail", False, 0.1, 5) for i in range(40)], "example_id int, judge string, errored boolean, cost double, latency_ms int")
    row = calibration.check_requirement(calibration.report(labels, verdicts, ["fail", "pass"], ["pass"]), min_agreement=0.85, max_false_pass=0.1).first()
    assert row["failures"] == ["too_few_examples", "false_pass"] and row["warnings"] == ["agreement_straddles", "verbosity"] and not row["satisfied"]
    assert row["agreement"] == 0.9 and row["false_pass"] == 0.2


@pytest.mark.parametrize("schema,value,n", [
    ({"type": "integer"}, "true", 1), ({"type": "number"}, "1.5", 0), ({"type": "array", "items": {"type": "string", "minLength": 2}, "maxItems": 2}, '["a","bc",3]', 3),
    ({"type": "object", "properties": {"a": {"enum": ["x", 1]}}}, '{"a": 1}', 0), ({"type": "object", "properties": {"a": {"enum": ["x", 1]}}}, '{"a": "y"}', 1), ({"pattern": "^a"}, '"ba"', 1),
    ({"type": "null"}, "null", 0), ({"type": "object", "required": ["a"]}, '{"a": null}', 0), ({"type": "object", "required": ["a"]}, "[]", 1), ({"minItems": 1}, "[]", 1),
])
def test_schema_errors(spark, schema, value, n):
    assert len(one(spark, values.schema_errors(F.try_parse_json(F.lit(value)), schema))) == n


def test_paths_and_payloads(spark):
    v = F.try_parse_json(F.lit('{"a": {"b": [1, {"c": "x"}]}, "it\'s": 2, "0": "zero"}'))
    get = lambda p: one(spark, F.to_json(values.resolve(v, p)))
    assert get("a.b.-1.c") == '"x"' and get("a.b.0") == "1" and get("a.b.7") is None and get("it's") == "2" and get("0") == '"zero"' and get("a.z.q") is None
    with pytest.raises(values.PathError):
        values.resolve(v, "a..b")
    assert one(spark, F.to_json(values.payload(F.lit("[1, 2]")))) == "[1,2]" and one(spark, F.to_json(values.payload(F.lit("[broken")))) == '"[broken"' and one(spark, F.to_json(values.payload(F.lit("3")))) == '"3"'
    assert one(spark, values.canonical_json(F.lit('{"b": 1, "a": [2, {"d": "é", "c": null}]}'))) == '{"a":[2,{"c":null,"d":"é"}],"b":1}'
    assert one(spark, values.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))) == {"a": "1", "b": "3"}
    assert one(spark, values.ids(F.try_parse_json(F.lit('[{"id": "p"}, "q", 3]')))) == ["p", "q", "3"]


def test_secrets_in_texts_and_values(spark):
    key, blob = "ghp_" + "a1B2" * 5, "Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZmdoaWprbG1ub3A"
    clean = lambda t: one(spark, redaction.without_secrets(F.lit(t)))
    assert clean(f"see {key} now") == "see [REDACTED:github_token] now" and clean(f"key {blob} end") == "key [REDACTED:high_entropy] end"
    assert clean("sk-ant-" + "x" * 20) == "[REDACTED:openai_key]" and clean("plain words") == "plain words"
    body = {"Author": "x", "list": [{"note": f"use {key}"}], "n": 5, "deep": {"ssn": "1"}}
    row = one(spark, redaction.redacted_json(F.lit(json.dumps(body))))
    assert json.loads(row["text"]) == {"Author": "[REDACTED:secret_key]", "list": [{"note": "use [REDACTED:github_token]"}], "n": 5, "deep": {"ssn": "1"}} and row["changed"] == 2
    assert json.loads(one(spark, redaction.redacted_json(F.lit(json.dumps(body)), personal=True))["text"])["deep"]["ssn"] == "[REDACTED:pii_key]"
    assert one(spark, redaction.redacted_json(F.lit("{}"), mode="disabled"))["text"] is None
    deep = "1"
    for _ in range(20):
        deep = f'{{"a": {deep}}}'
    assert "[TRUNCATED:depth]" in one(spark, redaction.redacted_json(F.lit(deep)))["text"]
    many = json.loads(one(spark, redaction.redacted_json(F.lit(json.dumps(list(range(1005))))))["text"])
    assert len(many) == 1001 and many[-1] == "[TRUNCATED:5 more items]"
    long = one(spark, redaction.redacted_json(F.lit(json.dumps({"t": "ab " * 100_000}))))
    assert long["shortened"] == 1 and json.loads(long["text"])["t"]["_original_bytes"] == 300_000


def test_globs_and_names(spark):
    import fnmatch

    for pattern in ("log_*", "a?c", "[!a]b", "x[0-9]", "metrics.*", "[", "a[b"):
        for name in ("log_x", "abc", "cb", "ab", "x5", "metrics.cpu", "metricsXcpu", "[", "a[b"):
            assert one(spark, scalars.matches_glob(F.lit(name), [pattern])) == fnmatch.fnmatchcase(name, pattern), (name, pattern)
    assert scalars.nearest("requird_order", list(policy.KINDS)) == "required_order" and scalars.inverse_erf(0.5) == pytest.approx(0.4769362762)
    assert one(spark, text.normalized(F.lit("a - b,  c"), "punctuation")) == "a b c"


def test_percentiles_and_area_range_by_range(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k in "ab" for v in rng.normal(size=3000).round(2)]
    frame = spark.createDataFrame(rows, "k string, v double")
    for r in scores.percentiles(frame, ["k"], "v", [0, 50, 95, 99, 100]).collect():
        own = [v for k, v in rows if k == r["k"]]
        assert [r[f"p{q}"] for q in (0, 50, 95, 99, 100)] == pytest.approx([np.percentile(own, q) for q in (0, 50, 95, 99, 100)])
    assert scores.roc_auc(spark.createDataFrame([(1.0, True)], "score double, positive boolean")).first()["auc"] is None


def test_policies_say_what_is_wrong():
    for bad, why in ((more.POLICY.replace("kind: limit", "kind: limt"), "did you mean limit"), (more.POLICY.replace("id: state", "id: order"), "taken"), (more.POLICY.replace("max_calls: 6", "most: 6"), "doesn't know most"), (more.POLICY.replace("'purchase' in actions", "actions.purchase > 1"), "is a list"), ("kind: Other", "not a")):
        with pytest.raises(policy.PolicyError, match=why):
            policy.load_policy(bad)
    rules = policy.load_policy(more.POLICY)
    assert rules.lines["state"] > rules.lines["order"] > 0 and "click" in rules.actions() and len(rules.digest) == 64


def test_each_kind_of_rule(spark):
    schema = "trace_id string, span_id long, parent_id long, name string, span_type string, tool_name string, status string, started_us long, ended_us long, sequence_index int, attributes map<string,string>, tool_args string, arrival long"
    names = ["search", "mail", "mail", "approve", "search"]
    spans = spark.createDataFrame([("t", i, None, n, "tool", None, "ok", i * 10, i * 10 + 5, 0, {}, '{"to": "x"}', i) for i, n in enumerate(names)], schema)
    events = normalize.events(spans)
    ids = spark.createDataFrame([("t", {"plan": "pro"})], "trace_id string, metadata map<string,string>")
    facts = policy.trace_facts(ids, events)
    cases = [
        ({"kind": "required_order", "steps": ["search", "approve", "mail"]}, 1), ({"kind": "required_order", "steps": ["mail", "approve"], "mode": "contiguous"}, 0), ({"kind": "required_action", "action": "mail", "min_count": 3}, 1),
        ({"kind": "forbidden_action", "actions": ["mail", "x"]}, 1), ({"kind": "forbidden_before", "action": "mail", "before": "approve"}, 2), ({"kind": "forbidden_after", "action": "search", "after": "approve"}, 1),
        ({"kind": "limit", "action": "mail", "max_calls": 1}, 1), ({"kind": "limit", "action": "mail", "min_calls": 3}, 1), ({"kind": "unique_action", "action": "mail", "key": ["args.to"]}, 1),
        ({"kind": "no_loop", "window": 2, "min_repeats": 2}, 1), ({"kind": "max_retries", "action": "*", "max": 0}, 0), ({"kind": "argument_condition", "action": "mail", "require": "args.to == 'y'"}, 2),
        ({"kind": "conditional", "when": "metadata.plan == 'pro'", "forbid_actions": ["mail"]}, 1), ({"kind": "conditional", "when": "metadata.plan == 'free'", "forbid_actions": ["mail"]}, 0), ({"kind": "final_state", "require": "counts.mail == 2"}, 0),
    ]
    for rule, n in cases:
        assert policy.failures({"id": "r", **rule}, events, facts).count() == n, rule


def test_spans_and_events_of_traces(spark):
    schema = "trace_id string, span_id long, parent_id long, started_us long, ended_us long, sequence_index int"
    rows = [("t", 1, None, 0, 100, 0), ("t", 2, 1, 10, 50, 1), ("t", 3, 1, 10, None, 0), ("t", 4, 3, 20, 30, 0), ("t", 5, 9, 60, 70, 0), ("t", 6, 7, 80, 90, 0), ("t", 7, 6, 85, 90, 0)]
    out = {r["span_id"]: r for r in ancestry.waterfall(spark.createDataFrame(rows, schema)).collect()}
    assert [i for i, _ in sorted(out.items(), key=lambda x: x[1]["row"])] == [1, 3, 4, 2, 5, 6, 7]
    assert [out[i]["depth"] for i in range(1, 8)] == [0, 1, 1, 2, 0, 0, 1] and out[1]["n_below"] == 3 and out[5]["is_orphan"] and out[3]["has_children"]
    assert out[3]["width"] == pytest.approx(0.9) and out[4]["offset"] == pytest.approx(0.2)


def test_percentiles_of_keys_that_lie_apart(spark):
    """Each key has ranges of its own, so that one whose values lie close together isn't one range."""
    rows = [("near", 1000 + i / 1000) for i in range(900)] + [("far", 7.0 * i) for i in range(900)] + [("tied", 3.0)] * 50 + [("one", -1.0)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    counts = frame.groupBy("k", "v").agg(F.count("*").alias("n"))
    for r in scores.percentiles(frame, ["k"], "v", [0, 5, 50, 99, 100]).collect():
        own = [v for k, v in rows if k == r["k"]]
        assert [r[f"p{q}"] for q in (0, 5, 50, 99, 100)] == pytest.approx([np.percentile(own, q) for q in (0, 5, 50, 99, 100)])
    placed = {(r["k"], r["v"]): (r["before"], r["total"]) for r in scores._counted_before(counts, ["k"], "v", "n").collect()}
    assert len(placed) == 1802 and all(placed["near", 1000 + i / 1000] == (i, 900) for i in range(900)) and placed["tied", 3.0] == (0, 50)
    alone = spark.createDataFrame([(5.0, 2), (1.0, 3)], "v double, n int")
    assert {(r["v"], r["before"], r["total"]) for r in scores._counted_before(alone, [], "v", "n").collect()} == {(1.0, 0, 5), (5.0, 3, 5)}
    assert scores.percentiles(frame.limit(0), ["k"], "v", [50]).count() == 0


@pytest.mark.parametrize("least", [0.2, 0.55, 0.8, 1.0])
def test_similar_pairs_against_all_pairs(spark, least):
    rng = random.Random(7)
    rows = [(rng.choice("kl"), i, [rng.choice("abcdefghijkl") for _ in range(rng.randrange(9))]) for i in range(90)]
    rows += [("k", 90 + i, ["a", "b", "c"]) for i in range(25)] + [("k", 200, list("abcdefghijk")), ("k", 201, list("abcdefghij")), ("l", 202, None)]
    own = [(k, i, frozenset(t or ())) for k, i, t in rows]
    want = {(k, min(i, j), max(i, j)) for n, (k, i, x) in enumerate(own) for m, j, y in own[n + 1 :] if k == m and x | y and len(x & y) / len(x | y) >= least}
    got = [tuple(r) for r in text.similar_pairs(spark.createDataFrame(rows, "k string, i int, t array<string>"), ["k"], "i", "t", least).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_scores_come_back_in_dataset_order(spark):
    results = spark.createDataFrame([("r", f"e{i}", (i * 7) % 20) for i in range(20)], "run_id string, example_id string, ordinal int").repartition(4)
    out = runs.nested_scores(results, spark.createDataFrame([("r", "e1", "m", 0.5)], "run_id string, example_id string, metric string, value double")).collect()
    assert [r["ordinal"] for r in out] == list(range(20)) and [len(r["scores"]) for r in out].count(1) == 1


def test_rules_with_and_without_a_name_take_their_traces(spark):
    traces_ = spark.createDataFrame([("a", "chat", 10), ("b", "mail", 20), ("c", None, 30)], "trace_id string, name string, started_us long")
    rules = spark.createDataFrame([("all", None), ("chats", "chat"), ("none", "x")], "rule string, name string")
    done = spark.createDataFrame([("b", "all")], "trace_id string, rule string")
    got = runs.pending_batch(traces_, rules, done, 30)
    assert {(r["rule"], r["trace_id"], r["place"]) for r in got.collect()} == {("all", "a", 1), ("all", "c", 2), ("chats", "a", 1)}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["rule"] for r in runs.pending_batch(traces_, rules.where("name is not null"), done, 30).collect()} == {"chats"}
    assert runs.pending_batch(traces_, rules.limit(0), done, 30).count() == 0


def test_words_that_nobody_knows(spark):
    rows = spark.createDataFrame([("t", 1, "odd", "OK", 0), ("t", 2, None, None, 1), ("t", 3, "tool", "error", 2)], "trace_id string, span_id long, span_type string, status string, started_us long")
    assert [(r["span_type"], r["status"]) for r in normalize.in_vocabulary(rows).orderBy("span_id").collect()] == [("custom", "unset"), ("custom", "unset"), ("tool", "error")]
    assert normalize.in_vocabulary(rows.select("trace_id")).columns == ["trace_id"]
    assert normalize.unmatched_traces(rows, rows.limit(0)).first()["span_types"] == ["custom", "tool"]


def test_citations_of_pages(spark):
    schema = "pages array<struct<number:int,text:string,anchors:array<struct<id:string,offset:int>>>>"
    rows = spark.createDataFrame([([(2, "Whole. ", [("x", 5), ("y", 9)]), (3, "broken off\n", None), (4, None, []), (5, "", None)],), ([],), (None,)], schema)
    out = rows.select(scalars.anchors(F.col("pages"), 3).alias("c"), scalars.split_pages(F.col("pages")).alias("whole")).collect()
    assert [tuple(c) for c in out[0]["c"]] == [("x", 2, 8), ("y", 2, 12)] and out[0]["whole"] == 0.75
    assert (out[1]["c"], out[1]["whole"], out[2]["c"], out[2]["whole"]) == ([], 1.0, None, 1.0)


def test_suite_errors_name_the_line(spark, tmp_path):
    path = tmp_path / "s.yaml"
    cases = [
        ("name: a\n\ngatez: {}\n", ":3: unknown key 'gatez', did you mean gates"), ("name: a\nevaluators:\n  - name: x\n    type: regex\n  - name: y\n    type: regexp\n", ":6: evaluator 'y'"),
        ("evaluators:\n  - {name: x, type: regex}\n  - name: x\n    type: length\n", ":3: two evaluators"), ("name: a\ndataset:\n  path: [p, '${NO_SUCH_NAME}']\n", ":3: .*NO_SUCH_NAME"), ("name: a\n bad: [\n", ":2"), ("- a\n", ":1: not a mapping"),
    ]
    for text_, why in cases:
        path.write_text(text_)
        with pytest.raises(suites.SuiteError, match=f"s.yaml{why}"):
            suites.load_suite(str(path))
    (tmp_path / "base.yaml").write_text("name: a\ngatez: {}\n")
    path.write_text("extends: base.yaml\n")
    with pytest.raises(suites.SuiteError, match="s.yaml: unknown key"):
        suites.load_suite(str(path))


def test_ingest_keeps_what_was_first_stored(spark):
    stored = spark.createDataFrame([("t", 1, 5, "ok")], "trace_id string, span_id int, started_us int, status string")
    arrived = spark.createDataFrame([("t", 1, 9, "error", 2), ("t", 1, 8, "late", 1), ("t", 2, 7, "ok", 3)], "trace_id string, span_id int, started_us int, status string, arrival int")
    again = ingest.upsert_spans(ingest.upsert_spans(stored, arrived), arrived)
    assert sorted(map(tuple, again.collect())) == [("t", 1, 5, "error"), ("t", 2, 7, "ok")]
    over = spark.createDataFrame([("b", "t", 501), ("c", "t", 1)], "batch string, trace_id string, n_events int")
    assert [tuple(r)[0] for r in ingest.over_batch_limits(over).collect()] == ["b"]
    assert ingest.decode_otlp(spark.createDataFrame([("no json",), ('{"resourceSpans": []}',)], "body string")).count() == 0
    events = spark.createDataFrame([("t", 1, 5, "a"), ("t", 1, 2, "b")], "trace_id string, span_id int, at_us int, name string")
    refs = stored.withColumn("input_ref", F.lit("k"))
    row = ingest.span_details(refs, events, spark.createDataFrame([("z", 1)], "object_key string, n_bytes int")).first()
    assert [e["name"] for e in row["events"]] == ["b", "a"] and row["truncated"]


def test_tenants_and_versions(spark):
    rows = spark.createDataFrame([("p", 1), ("q", 2)], "project_id string, n int")
    assert runs.scoped(rows, "p").count() == 1
    with pytest.raises(PermissionError):
        runs.scoped(rows, None)
    lines = spark.createDataFrame([("d", 1, 0, "a"), ("d", 1, 1, "b")], "dataset string, version int, ordinal int, line string")
    now = runs.locked_version(lines, ["dataset", "version"], "ordinal", "line")
    assert runs.locked_version(lines, ["dataset", "version"], "ordinal", "line", now.drop("n")).first()["unchanged"]
    assert runs.cloned(lines, "d", 1, 2).first()["cloned_from"] == 1
    calls = runs.judge_calls(spark.createDataFrame([("j", "llm_judge", 3), ("e", "exact_match", None)], "name string, type string, votes int"), 40).collect()
    assert [tuple(r) for r in calls] == [("j", 120)]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = datasets.numbered_lines(spark, str(tmp_path / "a.txt"))
        assert rows.rdd.getNumPartitions() > 3 and rows.where("text <> concat('line ', line)").count() == 0 and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sources_of_calibration(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": "1", "output": "abc", "human_label": "pass"}\n{"id": "2", "metadata": {"human_label": "fail"}}\n{"id": "1", "human_label": "x"}\n{"id": "3"}\n// note\n')
    rows = {r["line"]: (r["example_id"], r["human"], r["output_length"], r["error"]) for r in suites.labelled_set(spark, str(tmp_path / "l.jsonl")).collect()}
    assert rows == {1: ("1", "pass", 3, None), 2: ("2", "fail", None, None), 3: ("1", "x", None, "id seen before"), 4: ("3", None, None, "no label")}
    (tmp_path / "v.jsonl").write_text('{"id": "1", "label": "pass", "cost": "0.01", "latency_ms": 3}\n{"id": "2", "label": "pass", "error": "boom"}\n')
    assert {r["example_id"]: (r["judge"], r["errored"]) for r in suites.recorded_verdicts(spark, str(tmp_path / "v.jsonl")).collect()} == {"1": ("pass", False), "2": (None, True)}
    for version, at in (("aa", "2024-01-01T00:00:00"), ("bb", "2024-02-01T00:00:00")):
        assert suites.write_record(str(tmp_path), "tone check", version, {"calibrated_at": at, "satisfied": True, "report": {"kappa": 0.9}}).name == f"tone-check.{version}.calibration.json"
    assert [(r["version"], r["kappa"]) for r in suites.calibration_records(spark, str(tmp_path)).collect()] == [("bb", 0.9), ("aa", 0.9)]
    examples = spark.createDataFrame([('a "b"', '{"z": 1, "a": 2}', None, "{}")], "id string, input string, expected string, metadata string")
    datasets.write_jsonl(examples, str(tmp_path / "out"))
    line = next(x for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines())
    assert line == '{"expected":null,"id":"a \\"b\\"","input":{"a":2,"z":1},"metadata":{}}'
    assert datasets.jsonl_examples(spark, str(tmp_path / "out")).first()["id"] == 'a "b"'
    (tmp_path / "e.csv").write_text("id,input.q,expected.a,note\n1,x,,n\n2,y,z,n\n")
    got = {r["id"]: (r["input"], r["expected"], r["metadata"]) for r in datasets.csv_examples(spark, str(tmp_path / "e.csv")).collect()}
    assert got == {"1": ({"q": "x"}, {}, {}), "2": ({"q": "y"}, {"a": "z"}, {})}


SUITE = """
name: replies
extends: base.yaml
execution: {slice_by: [lang]}
evaluators:
  - {name: same, type: exact_match, normalize: all}
  - {name: short, type: length, max: "${MOST:-5}"}
gates:
  same: {minimum: 0.5}
  short: {minimum: 0.9, blocking: false}
"""


def test_suites_from_files(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("kind: EvalSuite\nexecution: {seed: 1}\ngates: {same: {minimum: 0.1}}\n")
    path = tmp_path / "s.yaml"
    path.write_text(SUITE.replace('"${MOST:-5}"', "5"))
    raw = suites.load_suite(str(path), {"execution.seed": "7", "gates.short.blocking": "true"})
    assert raw["execution"] == {"seed": 7, "slice_by": ["lang"]} and raw["gates"]["short"]["blocking"] is True and raw["gates"]["same"] == {"minimum": 0.5}
    results = spark.createDataFrame([(1, "Yes!", "yes", "en"), (2, "a long one", "no", "de"), (3, "x", None, "de")], "example_id int, output string, expected string, lang string").withColumn("input", F.lit(None).cast("string"))
    suite = EvalSuite.from_file(str(path))
    report = suite.evaluate(results)
    assert (report["verdict"], report["exit_code"]) == ("warn", 0) and {m["slice"] for m in report["metrics"]} == {"", "lang=en", "lang=de"}
    same = next(m for m in report["metrics"] if m["metric"] == "same" and not m["slice"])
    assert (same["mean"], same["n"], same["n_errors"]) == (0.5, 2, 1)
    suites.write_report(report, str(tmp_path / "r.json"))
    assert "| same | 0.5 |" in suites.markdown(report)
    with pytest.raises(ValueError):
        suites.validate_report({**report, "exit_code": 1})
    path.write_text(SUITE + "gatez: {}\n")
    with pytest.raises(suites.SuiteError, match="did you mean gates"):
        suites.load_suite(str(path))
    path.write_text(SUITE.replace("${MOST:-5}", "${UNSET_NAME}"))
    with pytest.raises(suites.SuiteError, match="UNSET_NAME"):
        suites.load_suite(str(path))
    assert suites.version_hash({"name": "a", "type": "x", "model": "m"}) == suites.version_hash({"name": "b", "model": "m", "type": "x"}) != suites.version_hash({"type": "x", "model": "n"})


def test_functions_of_users(spark):
    suite = EvalSuite("mine")

    @suite.task
    def shout(given):
        return given["q"].upper()

    @suite.evaluator(requires_expected=True)
    def equal(output, expected):
        return output == expected

    @suite.evaluator(slice_when=lambda input: input["q"] == "a", slice_label={"kind": "first"})
    def many(output, input):
        return {"length": len(output), "flag": True}

    with pytest.raises(suites.SuiteError):
        suite.evaluator("other")(lambda nothing: 1)
    suite.gate("equal", minimum=0.5)
    examples = spark.createDataFrame([("1", '{"q": "a"}', "A"), ("2", '{"q": "b"}', "x"), ("3", '{"p": 1}', "y"), ("4", '{"q": "d"}', None)], "example_id string, input string, expected string")
    results = suite.run(examples)
    assert {r["example_id"]: (r["output"], r["status"]) for r in results.collect()} == {"1": ("A", "ok"), "2": ("B", "ok"), "3": (None, "error"), "4": ("D", "ok")}
    made = {(r["metric"], r["slice"]): (r["mean"], r["n"], r["n_errors"]) for r in suite.metrics(results).collect()}
    assert made[("equal", "")] == (pytest.approx(1 / 3), 3, 1) and made[("many.length", "kind=first")] == (1.0, 1, 0) and made[("many", "")][2] == 1
    assert suite.evaluate(results)["verdict"] == "fail"
    assert coerced("m", [True, "x", None]) == [{"metric": "m", "value": 1.0, "passed": True}, {"metric": "m", "label": "x"}, {"metric": "m", "error": "returned NoneType"}]
    assert comparison.exit_code("pass", cancelled=True) == 130


def test_users_whose_padded_ids_are_equal_have_their_own_traces(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(4, at, 0, "view"), (8, at, 160, "click"), (4096, at, 7, "late"), (4092, at, 7, "early")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["session_id"], r["trace_id"], r["name"], r["n_spans"]) for r in more.otlp_traces(spark, str(tmp_path)).collect()}
    assert got == {("0", "a" * 31 + "0", "view", 1), ("160", "a" * 31 + "0", "click", 1), ("7", "a" * 31 + "7", "early", 2)}


def test_results_of_few_runs_are_parted_by_example(spark):
    rows = spark.range(12).select((F.col("id") % 2).alias("run_id"), (F.col("id") % 4).alias("example_id"))
    runs_ = spark.createDataFrame([(0, "failed"), (1, "running")], "run_id long, status string")
    out = ingest.append_results(rows.where("example_id = 3"), rows, runs_)
    assert [tuple(r) for r in out.collect()] == [(1, 1)]
    assert re.search(r"hashpartitioning\(run_id#\w+, example_id#", out._jdf.queryExecution().executedPlan().toString())


def test_a_policy_files_rules_read_stored_spans(spark):
    """Else each rule works the spans out anew; the plans of the verdicts and of the failures read nothing but what was written before the rules."""
    for frame in more._policy(spark, "/root/testdata/sf0.001"):
        assert frame.inputFiles() and not any("events.parquet" in f for f in frame.inputFiles())


def test_parts_grow_with_the_rows(spark):
    frame = objects.stored(spark.range(1000).select((F.col("id") % 50).alias("k"), "id"))
    assert objects.parted(frame, "k").rdd.getNumPartitions() == 4
    parts = objects.parted(frame, "k", rows=100)
    assert parts.rdd.getNumPartitions() == 10 and parts.count() == 1000
    assert parts.groupBy("k").count().join(parts, "k").rdd.getNumPartitions() == 10
