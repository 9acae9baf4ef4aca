"""Suite files, labelled sets, verdicts and calibration records; reports and records to write.

Suites, reports and records are small files of one run and are read and written on the driver; rows go through Spark.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions.scalars import nearest
from spanledger.operators.comparison import VERDICTS, exit_code

from .datasets import numbered_lines

#: The keys of a suite and the types of evaluators.
SUITE_KEYS = ("apiVersion", "kind", "name", "description", "extends", "dataset", "task", "execution", "evaluators", "gates", "baseline", "calibration", "report")
EVALUATOR_TYPES = ("exact_match", "json_schema", "regex", "contains", "length", "numeric_range", "set_comparison", "classification", "ranking", "calibration", "discrimination", "operational", "trajectory", "llm_judge")
#: What a report for a pull request shows at most, and its bytes.
SHOWN = {"metrics": 40, "regressions": 15, "failures": 10}
MARKDOWN_BYTES = 65_536


class SuiteError(ValueError):
    pass


def _parsed(path: str) -> tuple[dict, Callable[..., str]]:
    """A YAML file's mapping, and a function from keys and places in it to `path:line`, of the last one of them that is in the file."""
    import yaml

    text = Path(path).read_text()
    try:
        raw, root = yaml.safe_load(text) or {}, yaml.compose(text)
    except yaml.YAMLError as error:
        mark = getattr(error, "problem_mark", None)
        raise SuiteError(f"{path}:{mark.line + 1 if mark else '?'}: {getattr(error, 'problem', error)}") from error
    if not isinstance(raw, dict):
        raise SuiteError(f"{path}:1: not a mapping")

    def where(*steps) -> str:
        node, line = root, None
        for step in steps:
            if isinstance(node, yaml.MappingNode):
                found = next(((k, v) for k, v in node.value if k.value == str(step)), None)
            else:
                found = (node.value[step],) * 2 if isinstance(node, yaml.SequenceNode) and step < len(node.value) else None
            if found is None:
                break
            line, node = found[0].start_mark.line + 1, found[1]
        return f"{path}:{line}" if line else path

    return raw, where


def _filled(value, variables: dict[str, str], where: Callable[..., str], steps: tuple = ()):
    """${NAME} and ${NAME:-default} in all texts of a value."""
    if isinstance(value, dict):
        return {k: _filled(v, variables, where, (*steps, k)) for k, v in value.items()}
    if isinstance(value, list):
        return [_filled(v, variables, where, (*steps, i)) for i, v in enumerate(value)]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if m.group(1) in variables:
            return variables[m.group(1)]
        if m.group(2) is None:
            raise SuiteError(f"{where(*steps)}: ${{{m.group(1)}}} is not set and has no default")
        return m.group(2)

    return re.sub(r"\$\{([A-Za-z_]\w*)(?::-([^}]*))?\}", one, value)


def _typed(old, text: str):
    """An override's text as the type of what it replaces."""
    if isinstance(old, bool):
        return text.lower() in ("1", "true", "yes", "on")
    for kind in (int, float):
        if isinstance(old, kind) or old is None:
            try:
                return kind(text)
            except ValueError:
                continue
    return text


def load_suite(path: str, overrides: dict[str, str] | None = None, variables: dict[str, str] | None = None) -> dict:
    """A suite from YAML. `extends` names another file whose keys count where the suite has none (one level, mappings key by key);
    then variables are filled in and overrides (a.b=c) set. Unknown keys and types, and names taken twice, are errors that name the file's line.
    """
    raw, where = _parsed(path)
    if "extends" in raw:
        base, _ = _parsed(str(Path(path).parent / raw["extends"]))
        if "extends" in base:
            raise SuiteError(f"{where('extends')}: a suite that is extended can't extend another one")
        raw = {**base, **{k: {**base[k], **v} if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in raw.items()}}
    raw = _filled(raw, {**os.environ, **(variables or {})}, where)
    for dotted, text in (overrides or {}).items():
        at, *rest = raw, *dotted.split(".")
        for key in rest[:-1]:
            at = at.setdefault(key, {})
        at[rest[-1]] = _typed(at.get(rest[-1]), text)
    for key in raw:
        if key not in SUITE_KEYS:
            hint = nearest(key, list(SUITE_KEYS))
            raise SuiteError(f"{where(key)}: unknown key {key!r}" + (f", did you mean {hint}?" if hint else ""))
    taken: set = set()
    for i, e in enumerate(raw.get("evaluators") or []):
        if e.get("name") in taken:
            raise SuiteError(f"{where('evaluators', i, 'name')}: two evaluators have the name {e.get('name')!r}")
        taken.add(e.get("name"))
        if e.get("type") not in EVALUATOR_TYPES:
            raise SuiteError(f"{where('evaluators', i, 'type')}: evaluator {e.get('name')!r} has the unknown type {e.get('type')!r}")
    return raw


def gate_rules(suite: dict) -> list[tuple]:
    """The suite's gates as rows of the rules of comparison.evaluate_gates, with require_power and significance."""
    out = []
    for metric, g in (suite.get("gates") or {}).items():
        key = ",".join(f"{k}={v}" for k, v in sorted((g.get("slice") or {}).items()))
        floats = [float(g[k]) if g.get(k) is not None else None for k in ("minimum", "maximum", "max_regression", "max_relative_regression")]
        out.append((f"{metric}[{key}]" if key else metric, metric, key, *floats, bool(g.get("require_baseline")), g.get("max_error_rate"), g.get("blocking", True), bool(g.get("require_power")), g.get("significance")))
    return out


RULES = "rule string, metric string, slice string, minimum double, maximum double, max_regression double, max_relative double, require_baseline boolean, max_error_rate double, blocking boolean, require_power boolean, significance double"


def version_hash(evaluator: dict) -> str:
    """16 hex digits for what makes an evaluator give other scores: all but its name and description."""
    used = {k: v for k, v in evaluator.items() if k not in ("name", "description")}
    return hashlib.sha256(json.dumps(used, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]


def labelled_set(spark: SparkSession, path: str) -> DataFrame:
    """Labelled JSON lines to (line, example_id, human, second, adjudicated, output, output_length, error).

    A label may stand in metadata. A line without a label, and a later one with an id seen before, gets an error.
    """
    from pyspark.sql import Window

    lines = numbered_lines(spark, path).where("text <> '' and not startswith(text, '//')")
    get = lambda name: F.coalesce(F.get_json_object("text", f"$.{name}"), F.get_json_object("text", f"$.metadata.{name}"))
    output = F.get_json_object("text", "$.output")
    rows = lines.select("file", "line", get("id").alias("example_id"), get("human_label").alias("human"), get("second_human_label").alias("second"), get("adjudicated_label").alias("adjudicated"), output.alias("output"), F.length(output).alias("output_length"))
    again = F.row_number().over(Window.partitionBy("example_id").orderBy("file", "line")) > 1
    error = F.when(F.col("example_id").isNull(), "no id").when(again, "id seen before").when(F.col("human").isNull(), "no label")
    return rows.withColumn("error", error)


def recorded_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines to (example_id, judge, cost, latency_ms, errored); an error takes the label away."""
    rows = spark.read.schema("id string, label string, cost string, latency_ms long, error string").json(path)
    bad = F.col("error").isNotNull()
    return rows.where("id is not null").select(F.col("id").alias("example_id"), F.when(~bad, F.col("label")).alias("judge"), F.col("cost").try_cast("decimal(18,8)").alias("cost"), "latency_ms", bad.alias("errored"))


def calibration_records(spark: SparkSession, folder: str) -> DataFrame:
    """Record files of a folder, the newest first: evaluator, version, calibrated_at, satisfied, kappa."""
    rows = spark.read.schema("evaluator string, evaluator_version_hash string, calibrated_at string, satisfied boolean, report struct<kappa:double>").json(f"{folder}/*.calibration.json", multiLine=True)
    out = rows.select("evaluator", F.col("evaluator_version_hash").alias("version"), F.to_timestamp("calibrated_at").alias("calibrated_at"), "satisfied", F.col("report.kappa").alias("kappa"))
    return out.orderBy(F.col("calibrated_at").desc(), "evaluator")


def write_record(folder: str, evaluator: str, version: str, record: dict) -> Path:
    """A calibration record in the file that is named by its evaluator and version."""
    path = Path(folder) / f"{re.sub('[^A-Za-z0-9._-]+', '-', evaluator)}.{version}.calibration.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"evaluator": evaluator, "evaluator_version_hash": version, **record}, indent=2, sort_keys=True, default=str) + "\n")
    return path


def build_report(suite: str, verdicts: DataFrame, metrics: DataFrame, changes: DataFrame | None = None, aborted: bool = False, most: int = 100) -> dict:
    """A run's report. Gates and metrics are as many as the suite says; of changed examples the first `most` come to the driver."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.coalesce(1).toLocalIterator()]
    gates = sorted(rows(verdicts), key=lambda g: g["rule"])
    verdict = max((g["verdict"] for g in gates), key=VERDICTS.index, default="pass")
    named = sorted(rows(metrics), key=lambda m: (m["metric"], m.get("slice") or ""))
    shown = rows(changes.orderBy("kind", F.abs("delta").desc(), "example_id").limit(most)) if changes is not None else []
    return {"suite": suite, "verdict": verdict, "exit_code": exit_code(verdict, aborted=aborted), "aborted": aborted, "gates": gates, "metrics": named, "changes": shown}


def validate_report(report: dict) -> None:
    """A report says one thing: its exit code is that of its verdict, its verdict that of its worst gate."""
    missing = {"suite", "verdict", "exit_code", "gates", "metrics"} - set(report)
    if missing:
        raise ValueError(f"the report lacks {', '.join(sorted(missing))}")
    if report["verdict"] not in VERDICTS or report["exit_code"] != exit_code(report["verdict"], aborted=report.get("aborted", False)):
        raise ValueError("the exit code isn't the verdict's")
    if report["verdict"] != max((g["verdict"] for g in report["gates"]), key=VERDICTS.index, default="pass"):
        raise ValueError("the verdict isn't that of the gates")


def write_report(report: dict, path: str) -> None:
    validate_report(report)
    Path(path).write_text(json.dumps(report, indent=2, sort_keys=True, default=str) + "\n")


def markdown(report: dict) -> str:
    """The report as a comment of bounded size: gates that fail, metrics without a slice or with a gate, the first changes."""
    gated = {(g["metric"], g.get("slice") or "") for g in report["gates"]}
    metrics = [m for m in report["metrics"] if not m.get("slice") or (m["metric"], m["slice"]) in gated]
    bad = [g for g in report["gates"] if g["verdict"] != "pass"]
    lines = [f"## {report['suite']}: {report['verdict'].upper()}", ""]
    lines += [f"- **{g['verdict']}** {g['rule']}: {g['clause']}" for g in bad[: SHOWN["failures"]]]
    lines += [f"- … {len(bad) - SHOWN['failures']} more"] if len(bad) > SHOWN["failures"] else []
    lines += ["", "| metric | value |", "|---|---|", *[f"| {m['metric']}{'[' + m['slice'] + ']' if m.get('slice') else ''} | {m.get('mean', m.get('value'))} |" for m in metrics[: SHOWN["metrics"]]]]
    lines += ["", *[f"- {c['example_id']} {c['metric']}: {c['before']} → {c['value']}" for c in report.get("changes", []) if c["kind"] == "regression"][: SHOWN["regressions"]]]
    while len("\n".join(lines).encode()) > MARKDOWN_BYTES:
        lines.pop()
    return "\n".join(lines)


def gauges(rows: DataFrame, name: str, value: str, labels: list[str] = ()) -> DataFrame:
    """Rows as lines of the text exposition of gauges; a null value has no line."""
    escape = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    shown = F.concat(F.lit("{"), F.array_join(F.array(*[F.concat(F.lit(f'{c}="'), escape(c), F.lit('"')) for c in labels]), ","), F.lit("}")) if labels else F.lit("")
    return rows.where(F.col(value).isNotNull()).select(F.concat(F.lit(name), shown, F.lit(" "), F.col(value).cast("string")).alias("value"))
