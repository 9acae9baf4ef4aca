"""Evaluators and whole evaluations: functions of a user's that score examples, and what becomes of the scores.

    suite = EvalSuite("replies")

    @suite.evaluator()
    def short(output, expected):
        return len(output) < 200

    suite.gate("short", minimum=0.9)
    report = suite.evaluate(results)

results: example_id, output, expected, metadata, input (JSON texts or texts), status. Row-wise Python functions run on Arrow batches; built-in
evaluators are columns and stay in the JVM.
"""

from __future__ import annotations

import inspect
import json
import secrets
from collections.abc import Callable, Iterator
from importlib import import_module
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import text, values
from spanledger.operators import comparison, corpus, judging, normalize, policy, scores, significance
from spanledger.sources import suites

SCORES = "example_id string, metric string, value double, passed boolean, label string, error string, own_slice map<string,string>"
#: What a function's parameters may be called.
PARAMETERS = ("output", "expected", "input", "metadata", "example_id")


def entrypoint(name: str) -> Callable:
    """The function that module:function names."""
    module, _, function = name.partition(":")
    if not function:
        raise suites.SuiteError(f"{name!r} is not module:function")
    return getattr(import_module(module), function)


def coerced(metric: str, given) -> list[dict]:
    """What a function returned as scores: bool, number, text (a label), dict (fields of a score, or metrics by name), list of these; nothing is an error."""
    if isinstance(given, list | tuple):
        return [row for one in given for row in coerced(metric, one)]
    if isinstance(given, bool):
        return [{"metric": metric, "value": float(given), "passed": given}]
    if isinstance(given, int | float):
        return [{"metric": metric, "value": float(given)}]
    if isinstance(given, str):
        return [{"metric": metric, "label": given}]
    if isinstance(given, dict) and {"value", "passed", "label", "error"} & set(given):
        value = given.get("value", float(given["passed"]) if given.get("passed") is not None else None)
        return [{"metric": given.get("metric", metric), "value": None if given.get("error") else value, "passed": given.get("passed"), "label": given.get("label"), "error": given.get("error"), "own_slice": given.get("slice")}]
    if isinstance(given, dict):
        return [row for key, one in given.items() for row in coerced(f"{metric}.{key}", one)]
    return [{"metric": metric, "error": f"returned {type(given).__name__}"}]


def _parsed(value):
    try:
        return json.loads(value) if isinstance(value, str) else value
    except ValueError:
        return value


def function_evaluator(name: str, function: Callable, requires_expected: bool = False, slice_when: Callable | None = None, slice_label: dict[str, str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A user's function over results to scores. Its parameters are taken by name; what it raises, or a missing `expected` that it needs, is an error and
    never a zero. `slice_when(output, expected, ...)` puts a score in the slice `slice_label`.
    """
    wanted = [p for p in inspect.signature(function).parameters]
    if unknown := set(wanted) - set(PARAMETERS):
        raise suites.SuiteError(f"{name}: unknown parameters {sorted(unknown)}")
    sliced = list(inspect.signature(slice_when).parameters) if slice_when else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for record in frame.to_dict("records"):
                facts = {p: record[p] if p == "example_id" else _parsed(record.get(p)) for p in PARAMETERS}
                if requires_expected and facts["expected"] is None:
                    made = [{"metric": name, "error": "no expected value"}]
                else:
                    try:
                        made = coerced(name, function(**{p: facts[p] for p in wanted}))
                        if slice_when and slice_when(**{p: facts[p] for p in sliced}):
                            made = [{**m, "own_slice": slice_label} for m in made]
                    except Exception as error:  # a user's function may raise anything; the score says what
                        made = [{"metric": name, "error": f"{type(error).__name__}: {error}"}]
                rows += [{"example_id": record["example_id"], **m} for m in made]
            yield pd.DataFrame({c.split()[0]: pd.Series([r.get(c.split()[0]) for r in rows], dtype=object) for c in SCORES.split(", ")})

    return lambda results: results.select(*[F.col(p).cast("string").alias(p) if p in results.columns else F.lit(None).cast("string").alias(p) for p in PARAMETERS]).mapInPandas(run, SCORES)


def column_evaluator(name: str, passed: Column, error: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """A boolean column over results as scores 1 and 0."""
    bad = error if error is not None else F.lit(None).cast("string")
    ok = F.when(bad.isNull(), passed)
    return lambda results: results.select(F.col("example_id").cast("string").alias("example_id"), F.lit(name).alias("metric"), ok.cast("double").alias("value"), ok.alias("passed"), F.lit(None).cast("string").alias("label"), bad.alias("error"), F.lit(None).cast("map<string,string>").alias("own_slice"))


def _field(spec: dict, key: str = "field", default: str = "output") -> Column:
    """A field of a result as text, by a rooted path."""
    path = spec.get(key, default)
    if path in ("output", "expected", "input"):
        return F.col(path)
    parse = lambda c: F.try_parse_json(F.col(c))
    return F.try_variant_get(values.rooted(path, {"output": parse("output"), "expected": parse("expected"), "input": parse("input")}), "$", "string")


def _built(name: str, spec: dict) -> Callable[[DataFrame], DataFrame]:
    kind, got = spec["type"], _field(spec)
    if kind == "exact_match":
        return column_evaluator(name, text.exact_match(got, _field(spec, "expected", "expected"), spec.get("normalize", "none")), F.when(F.col("expected").isNull(), "no expected value"))
    if kind == "contains":
        return column_evaluator(name, text.contains(got, spec["needles"], spec.get("mode", "all") == "all", not spec.get("case_sensitive")))
    if kind == "regex":
        return column_evaluator(name, text.regex_rules(got, spec.get("allow", ()), spec.get("deny", ())))
    if kind == "length":
        return column_evaluator(name, text.length_within(F.length(got) if spec.get("unit", "chars") == "chars" else text.n_words(got), spec.get("min"), spec.get("max")))
    if kind == "numeric_range":
        ok, error = values.in_range(F.try_parse_json(got), spec.get("min"), spec.get("max"), spec.get("exclusive", False))
        return column_evaluator(name, ok, error)
    if kind == "json_schema":
        return column_evaluator(name, F.size(values.schema_errors(F.try_parse_json(got), spec["schema"])) == 0, F.when(F.try_parse_json(got).isNull(), "no JSON"))
    if kind == "set_comparison":
        listed = lambda c: values.ids(F.try_parse_json(c))
        score, _, _ = values.set_comparison(listed(got), listed(_field(spec, "expected", "expected")), spec.get("mode", "equals"))
        return column_evaluator(name, score == 1)
    raise suites.SuiteError(f"{name}: {kind} can't score single examples")


def judge_of(name: str, spec: dict, folder: Path) -> judging.Judge:
    """A judge from its entry; the rubric may stand in a file beside the suite."""
    rubric = spec.get("rubric") or ((folder / spec["rubric_path"]).read_text() if spec.get("rubric_path") else "")
    if not rubric:
        raise suites.SuiteError(f"{name}: no rubric")
    scale = spec.get("scale") or {}
    labels = tuple(spec.get("labels") or ())
    try:
        return judging.Judge(
            name, rubric, spec.get("model") or "", tuple(spec.get("inputs") or ()), "classify" if labels else "rubric", (scale.get("min", 1), scale.get("max", 5)), scale.get("normalize", True),
            labels, tuple(spec.get("passing_labels") or ()), spec.get("votes", 1), spec.get("seed", 42), spec.get("temperature", 0.0), spec.get("max_retries", 2),
        )
    except ValueError as error:
        raise suites.SuiteError(str(error)) from error


def judge_evaluator(judge: judging.Judge, client: Callable[[], judging.Client], salt: str, path: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A judge's scores. Its answers are kept below `path`, as metrics, slices and tests read the scores several times."""

    def run(results: DataFrame) -> DataFrame:
        rows = judging.judged(results, judge, client, salt, f"{path}/{judge.name}" if path else None)
        return rows.select("example_id", "metric", "value", "passed", "label", "error", F.lit(None).cast("map<string,string>").alias("own_slice"))

    return run


def trajectory_evaluator(name: str, rules: policy.Policy, spans: Callable[[], DataFrame | None], kinds: dict[str, str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A policy over the traces that results name by trace_id; an example without a trace, and one whose trace is incomplete, is an error."""

    def run(results: DataFrame) -> DataFrame:
        given = spans()
        if given is None:
            raise suites.SuiteError(f"{name} needs the spans of the run")
        examples = results.select(F.col("example_id").cast("string").alias("example_id"), F.col("trace_id").cast("string").alias("trace_id"))
        given = given.join(examples.select("trace_id").distinct(), "trace_id", "left_semi")
        dropped = F.col("dropped_span_count") if "dropped_span_count" in results.columns else F.lit(0)
        traces = results.where("trace_id is not null").groupBy(F.col("trace_id").cast("string").alias("trace_id")).agg(F.max(dropped).alias("dropped")).withColumn("metadata", F.create_map().cast("map<string,string>"))
        events = normalize.events(given, rules.aliases, rules.span_types, rules.exclude)
        state = normalize.merged_state(traces.withColumn("state", F.col("metadata")), normalize.deduped(given))
        _, found = policy.evaluate(rules, events, policy.trace_facts(traces, events, state), normalize.incomplete(traces, given), kinds)
        rows = examples.join(policy.as_scores(found, name).select(F.col("example_id").alias("trace_id"), "value", "error"), "trace_id", "left")
        error = F.when(F.col("trace_id").isNull() | (F.col("value").isNull() & F.col("error").isNull()), "no trace").otherwise(F.col("error"))
        return rows.select("example_id", F.lit(name).alias("metric"), "value", (F.col("value") == 1).alias("passed"), F.lit(None).cast("string").alias("label"), error.alias("error"), F.lit(None).cast("map<string,string>").alias("own_slice"))

    return run


class EvalSuite:
    """Evaluators, gates and what to slice by, put together in code or from a suite file."""

    def __init__(self, name: str, slice_by: list[str] = ()):
        self.name, self.slice_by = name, list(slice_by)
        self.spans: DataFrame | None = None
        #: (metric, version) of the judges, and whether a gate on one of them needs a calibration
        self.judges: list[tuple[str, str]] = []
        self.calibrated = False
        self.evaluators: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.corpus: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.gates: dict[str, dict] = {}
        self.task_: Callable | None = None

    @classmethod
    def from_file(cls, path: str, client: Callable[[], judging.Client] | None = None, salt: str | None = None, answers: str | None = None, **options) -> EvalSuite:
        """A suite file with evaluators of any type. Judges ask `client()`; their answers are kept below `answers`."""
        raw, folder = suites.load_suite(path, **options), Path(path).parent
        out = cls(raw["name"], (raw.get("execution") or {}).get("slice_by", []))
        for spec in raw.get("evaluators", []):
            name, kind = spec["name"], spec["type"]
            if over_run := corpus.built(name, spec):
                out.over_run(name, over_run)
            elif kind == "llm_judge":
                if client is None:
                    raise suites.SuiteError(f"{name} is a judge and there is no client")
                out.add(name, judge_evaluator(judge_of(name, spec, folder), client, salt or secrets.token_hex(16), answers))
                out.judges.append((name, suites.version_hash(spec)))
            elif kind == "trajectory":
                out.add(name, trajectory_evaluator(name, policy.load_policy((folder / spec["policy"]).read_text()), lambda: out.spans, spec.get("kinds")))
            else:
                out.add(name, _built(name, spec))
        out.gates = raw.get("gates") or {}
        out.calibrated = bool((raw.get("calibration") or {}).get("require"))
        return out

    def task(self, function: Callable) -> Callable:
        """What makes an output (text or JSON value) of an input."""
        self.task_ = function
        return function

    def evaluator(self, name: str | None = None, **options):
        def add(function):
            self.add(name or function.__name__, function_evaluator(name or function.__name__, function, **options))
            return function

        return add

    def add(self, name: str, evaluator: Callable[[DataFrame], DataFrame]) -> None:
        if name in self.evaluators:
            raise suites.SuiteError(f"{name} is taken")
        self.evaluators[name] = evaluator

    def over_run(self, name: str, evaluator: Callable[[DataFrame], DataFrame]) -> None:
        """An evaluator of the whole results that gives metrics (metric, slice, mean, n, n_errors, stddev)."""
        self.corpus[name] = evaluator

    def gate(self, metric: str, **conditions) -> None:
        self.gates[metric] = conditions

    def validate(self) -> None:
        """Each gate has a condition, and there is something to gate."""
        if not self.evaluators and not self.corpus:
            raise suites.SuiteError("no evaluators")
        for metric, g in self.gates.items():
            if not {"minimum", "maximum", "max_regression", "max_relative_regression", "max_error_rate", "require_baseline"} & set(g):
                raise suites.SuiteError(f"the gate of {metric} has no condition")

    def run(self, examples: DataFrame) -> DataFrame:
        """examples(example_id, input, ...) with the task's output and status; a task that raises gives status error and no output."""
        function = self.task_

        def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                outputs, statuses = [], []
                for given in frame["input"]:
                    try:
                        made = function(_parsed(given))
                        outputs.append(made if isinstance(made, str) else json.dumps(made))
                        statuses.append("ok")
                    except Exception:  # a user's task may raise anything
                        outputs.append(None)
                        statuses.append("error")
                yield frame.assign(output=outputs, status=statuses)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema)
        return examples.mapInPandas(apply, f"{fields}, output string, status string")

    def scores(self, results: DataFrame) -> DataFrame:
        parts = [make(results) for make in self.evaluators.values()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.join(results.select(F.col("example_id").cast("string").alias("example_id"), *self.slice_by), "example_id") if self.slice_by else out

    def metrics(self, results: DataFrame, scored: DataFrame | None = None) -> DataFrame:
        """Metrics by slice; `scored` are the scores of the results, if they are at hand."""
        out = scores.aggregate_scores(scored if scored is not None else self.scores(results), self.slice_by) if self.evaluators else None
        for make in self.corpus.values():
            out = make(results) if out is None else out.unionByName(make(results))
        return out

    def verdicts(self, metrics: DataFrame, baseline: DataFrame | None = None, tests: DataFrame | None = None, calibrations: DataFrame | None = None) -> DataFrame:
        """A row per gate, and one per gated judge where calibrations(metric, version, calibrated_at, satisfied) are given or required.

        baseline: the metrics of the other run. tests: what significance.analyse() gave for the scores of both; it belongs to the unsliced metrics.
        """
        spark = metrics.sparkSession
        rules = spark.createDataFrame(suites.gate_rules({"gates": self.gates}), suites.RULES)
        known = metrics.select("metric", "slice", F.col("mean").alias("value"), "n", "n_errors")
        before = baseline.select("metric", "slice", F.col("mean").alias("baseline")) if baseline is not None else known.limit(0).select("metric", "slice", F.lit(None).cast("double").alias("baseline"))
        known = known.join(before, ["metric", "slice"], "left")
        if tests is not None:
            known = known.join(tests.select("metric", F.lit("").alias("slice"), "mde", F.coalesce("p_adjusted", "p").alias("p")), ["metric", "slice"], "left")
        out = comparison.evaluate_gates(rules, known)
        if self.judges and (self.calibrated or calibrations is not None):
            have = calibrations if calibrations is not None else spark.createDataFrame([], "metric string, version string, calibrated_at timestamp, satisfied boolean")
            held = comparison.calibration_gates(rules, spark.createDataFrame(self.judges, "metric string, version string"), have, self.calibrated)
            out = out.unionByName(held.select(F.concat("metric", F.lit("#calibration")).alias("rule"), "metric", F.lit("").alias("slice"), F.lit(None).cast("double").alias("value"), "clause", "verdict"))
        return out

    def evaluate(self, results: DataFrame, baseline: DataFrame | None = None, spans: DataFrame | None = None, calibrations: DataFrame | None = None) -> dict:
        """The run's report, with verdict and exit code. baseline: the results of another run, whose scores are paired with this one's and
        tested, or only its metrics, for which gates that need a test are errors."""
        self.validate()
        self.spans = spans if spans is not None else self.spans
        # scores are read by metrics and tests, metrics by gates and the report
        kept = [df.persist() for df in ([self.scores(results)] if self.evaluators else [])]
        metrics, tests = self.metrics(results, *kept).persist(), None
        kept.append(metrics)
        if baseline is not None and "example_id" in baseline.columns:
            before = self.scores(baseline).persist() if self.evaluators else None
            if before is not None:
                kept.append(before)
                tests = significance.analyse(kept[0], before)
            baseline = self.metrics(baseline, before)
        report = suites.build_report(self.name, self.verdicts(metrics, baseline, tests, calibrations), metrics)
        for df in kept:
            df.unpersist()
        suites.validate_report(report)
        return report
