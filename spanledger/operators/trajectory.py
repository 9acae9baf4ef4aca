"""Ordered events of traces, and the policy rules over them.

events: trace_id, span_id, parent_id, action, failed, args, started_us, ended_us (null: open). Everything is a window or
an aggregate by trace, so one exchange on trace_id serves all rules of a policy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY_START = ("started_us", "span_id")


def by_start(events: DataFrame) -> tuple[str, ...]:
    """Events with one start go by their sequence_index, where there is one, then by their ids."""
    return ("started_us", "sequence_index", "span_id") if "sequence_index" in events.columns else BY_START


def _trace(*keys: str):
    return Window.partitionBy("trace_id", *keys)


def indexed(events: DataFrame) -> DataFrame:
    """With `index`, dense from 0, in each trace's order of start and span_id."""
    return events.withColumn("index", F.row_number().over(_trace().orderBy(*by_start(events))) - 1)


def with_retries(events: DataFrame) -> DataFrame:
    """With `attempt`: an event with the same action and arguments after a failed one goes on counting, a success starts anew."""
    same = _trace("action", "args").orderBy(*by_start(events))
    fresh = F.when(F.coalesce(F.lag("failed").over(same), F.lit(False)), 0).otherwise(1)
    island = events.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    return island.withColumn("attempt", F.row_number().over(_trace("action", "args", "_island").orderBy(*by_start(events)))).drop("_fresh", "_island")


def with_parallel_groups(events: DataFrame, tolerance_us: int = 0) -> DataFrame:
    """With `parallel_group`: the first span_id of a run of siblings that overlap in time, or follow within a tolerance; null for an event by itself."""
    siblings = _trace("parent_id").orderBy(*by_start(events))
    reached = F.max("ended_us").over(siblings.rowsBetween(Window.unboundedPreceding, -1)) + tolerance_us
    new = F.when(F.coalesce(F.col("started_us") >= reached, F.lit(True)), 1).otherwise(0)
    rows = events.withColumn("_new", new).withColumn("_group", F.sum("_new").over(siblings.rowsBetween(Window.unboundedPreceding, 0)))
    group = _trace("parent_id", "_group")
    first = F.min_by("span_id", F.struct(*by_start(events))).over(group)
    return rows.withColumn("parallel_group", F.when(F.count("*").over(group) > 1, first)).drop("_new", "_group")


def required_order(events: DataFrame, steps: list[str]) -> DataFrame:
    """Per trace how many of the steps are met in order (greedy, gaps allowed), and whether all are."""
    listed = events.groupBy("trace_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(*by_start(events), "action"))), lambda e: e["action"]).alias("actions"))
    want = F.array(*map(F.lit, steps))
    met = F.aggregate("actions", F.lit(0), lambda n, a: F.when(a == F.get(want, n), n + 1).otherwise(n))
    return listed.select("trace_id", met.alias("matched"), (met == len(steps)).alias("passed"))


def required_contiguous(events: DataFrame, steps: list[str]) -> DataFrame:
    """Whether the steps follow each other without anything between."""
    w = _trace().orderBy(*by_start(events))
    run = F.lit(True)
    for k, step in enumerate(steps):
        run &= F.coalesce(F.lead("action", k).over(w) == step, F.lit(False)) if k else F.col("action") == step
    return events.select("trace_id", run.alias("run")).groupBy("trace_id").agg(F.bool_or("run").alias("passed"))


def counted(traces: DataFrame, events: DataFrame, action: str, least: int | None = None, most: int | None = None, retries: bool = True) -> DataFrame:
    """Calls of an action per trace of traces(trace_id), 0 where there is none, against bounds; `retries` False leaves repeats after failures out."""
    rows = events if retries else with_retries(events).where("attempt = 1")
    n = rows.where(F.col("action") == action).groupBy("trace_id").agg(F.count("*").alias("calls"))
    calls = F.coalesce("calls", F.lit(0).cast("long"))
    ok = F.lit(True)
    if least is not None:
        ok &= calls >= least
    if most is not None:
        ok &= calls <= most
    return traces.join(n, "trace_id", "left").select("trace_id", calls.alias("calls"), ok.alias("passed"))


def over_limit(traces: DataFrame, events: DataFrame, action: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """Traces in which an action is called, retries aside, too seldom (span_id null) or too often (the first call that is too many)."""
    calls = with_retries(events).where((F.col("action") == action) & (F.col("attempt") == 1))
    calls = calls.withColumn("_n", F.row_number().over(_trace().orderBy(*by_start(events))))
    out = traces.limit(0).select("trace_id", F.lit(None).cast("long").alias("span_id"))
    if most is not None:
        out = out.unionByName(calls.where(F.col("_n") == most + 1).select("trace_id", "span_id"))
    if least is not None:
        enough = calls.where(F.col("_n") >= least).select("trace_id").distinct()
        few = traces.select("trace_id").join(enough, "trace_id", "left_anti") if least > 0 else traces.limit(0)
        out = out.unionByName(few.select("trace_id", F.lit(None).cast("long").alias("span_id")))
    return out


def action_index(events: DataFrame) -> DataFrame:
    """Per trace and action: how often, retries aside, and the first and last event."""
    rows = with_retries(events)
    at = F.struct(*by_start(events))
    return rows.groupBy("trace_id", "action").agg(F.count(F.when(F.col("attempt") == 1, 1)).alias("n"), F.min_by("span_id", at).alias("first_span_id"), F.max_by("span_id", at).alias("last_span_id"))


def forbidden(events: DataFrame, actions: list[str]) -> DataFrame:
    """A row per trace and forbidden action that occurs: how often, and where first."""
    rows = indexed(events).where(F.col("action").isin(actions))
    return rows.groupBy("trace_id", "action").agg(F.count("*").alias("n"), F.min("index").alias("first_index"))


def forbidden_before(events: DataFrame, action: str, gate: str) -> DataFrame:
    """Events of `action` that start before the trace's first `gate`, or in a trace without one; events of the gate's parallel group are unordered."""
    rows = with_parallel_groups(events)
    is_gate = F.col("action") == gate
    first = F.min(F.when(is_gate, F.struct(*by_start(events), "parallel_group"))).over(_trace())
    rows = rows.withColumn("_gate", first).where(F.col("action") == action)
    beside = F.coalesce(F.col("parallel_group") == F.col("_gate.parallel_group"), F.lit(False))
    return rows.where(F.col("_gate").isNull() | ((F.col("started_us") < F.col("_gate.started_us")) & ~beside)).select("trace_id", "span_id")


def forbidden_after(events: DataFrame, action: str, gate: str) -> DataFrame:
    """Events of `action` that start after the trace's first `gate`."""
    first = F.min(F.when(F.col("action") == gate, F.col("started_us"))).over(_trace())
    return events.withColumn("_gate", first).where((F.col("action") == action) & (F.col("started_us") > F.col("_gate"))).select("trace_id", "span_id")


def duplicates(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events that repeat an earlier one of their trace in all keys, with the first one's span_id."""
    w = _trace(*keys).orderBy(*by_start(events))
    return events.select("trace_id", "span_id", F.row_number().over(w).alias("n"), F.first("span_id").over(w).alias("first_span_id")).where("n > 1").drop("n")


def loops(events: DataFrame, keys: list[str], window: int, repeats: int) -> DataFrame:
    """Per trace the first place at which a key occurs `repeats` times within `window` consecutive events."""
    ahead = _trace(*keys).orderBy("index").rangeBetween(0, window - 1)
    hits = indexed(events).withColumn("n", F.count("*").over(ahead)).where(F.col("n") >= repeats)
    return hits.groupBy("trace_id").agg(F.min("index").alias("first_index"), F.min_by("action", "index").alias("action"))


def retries(events: DataFrame, most: int) -> DataFrame:
    """Traces and actions with more than `most` retries, and their number."""
    worst = with_retries(events).groupBy("trace_id", "action").agg((F.max("attempt") - 1).alias("retries"))
    return worst.where(F.col("retries") > most)


def condition(events: DataFrame, action: str, holds: Column) -> DataFrame:
    """Occurrences of an action for which a predicate doesn't hold, or can't be told."""
    return events.where((F.col("action") == action) & ~F.coalesce(holds, F.lit(False))).select("trace_id", "span_id")


def conditional(traces: DataFrame, events: DataFrame, when: str, require: list[str], forbid: list[str]) -> DataFrame:
    """In traces that have the action `when`: how many of `require` are missing and of `forbid` are there. Others pass."""
    seen = events.groupBy("trace_id").agg(F.collect_set("action").alias("seen"))
    lists = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    rows = traces.join(seen, "trace_id", "left").withColumn("seen", F.coalesce("seen", lists([])))
    on = F.array_contains("seen", when)
    missing = F.when(on, F.size(F.array_except(lists(require), F.col("seen")))).otherwise(0)
    there = F.when(on, F.size(F.array_intersect(lists(forbid), F.col("seen")))).otherwise(0)
    return rows.select("trace_id", missing.alias("missing"), there.alias("forbidden"), ((missing == 0) & (there == 0)).alias("passed"))


def final_state(events: DataFrame) -> DataFrame:
    """The last value of each (trace, action) key: later events win."""
    return events.groupBy("trace_id", "action").agg(F.max_by("args", F.struct(*by_start(events))).alias("value"))


def policy_result(traces: DataFrame, failures: dict[str, tuple[DataFrame, bool]], incomplete: DataFrame | None = None) -> DataFrame:
    """One row per trace from rules' failures (rule to (rows with trace_id, blocking)). Traces listed as incomplete are inconclusive."""
    each = [rows.select("trace_id", F.lit(rule).alias("rule"), F.lit(blocking).alias("blocking")) for rule, (rows, blocking) in failures.items()]
    union = each[0]
    for x in each[1:]:
        union = union.unionAll(x)
    found = union.groupBy("trace_id").agg(F.count(F.when(F.col("blocking"), 1)).alias("n_blocking"), F.count(F.when(~F.col("blocking"), 1)).alias("n_warnings"), F.count_distinct("rule").alias("n_rules"))
    out = traces.join(found, "trace_id", "left").fillna(0, ["n_blocking", "n_warnings", "n_rules"])
    open_ = F.lit(False)
    if incomplete is not None:
        out = out.join(incomplete.select("trace_id", F.lit(True).alias("_open")), "trace_id", "left")
        open_ = F.coalesce("_open", F.lit(False))
    verdict = F.when(F.col("n_blocking") > 0, "fail").when(open_, "inconclusive").otherwise("pass")
    return out.select("trace_id", "n_blocking", "n_warnings", "n_rules", verdict.alias("verdict"))
