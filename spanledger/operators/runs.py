"""Runs, datasets, rules and queues: who is compared with whom, what is decided, what waits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions.hashing import bucket


def scoped(rows: DataFrame, tenant: str | None, column: str = "project_id") -> DataFrame:
    """The rows of one tenant; without one nothing may be read."""
    if not tenant:
        raise PermissionError("no tenant")
    return rows.where(F.col(column) == tenant)


def alive(rows: DataFrame) -> DataFrame:
    return rows.where("deleted_at is null")


def trace_filter(traces: DataFrame, name: str | None = None, status: str | None = None, git_commit: str | None = None, since: int | None = None, until: int | None = None, min_ms: int | None = None, max_ms: int | None = None, has_errors: bool | None = None) -> DataFrame:
    """Traces by what is given; since <= started_us < until; has_errors may be left open. Plain comparisons, so that they reach the scan."""
    c = F.col
    tests = [(name, c("name") == name), (status, c("status") == status), (git_commit, c("git_commit") == git_commit), (since, c("started_us") >= since), (until, c("started_us") < until), (min_ms, c("duration_ms") >= min_ms), (max_ms, c("duration_ms") <= max_ms)]
    for given, test in tests:
        if given is not None:
            traces = traces.where(test)
    if has_errors is not None:
        traces = traces.where(c("n_errors") > 0 if has_errors else c("n_errors") == 0)
    return traces


def page(rows: DataFrame, order: list[str], after: tuple | None, size: int, most: int = 200) -> DataFrame:
    """The next `size` rows (200 at most) in descending order behind a position, each with has_more: whether another one follows the page.

    The first column is also compared by itself, which reaches the scan.
    """
    size = min(size, most)
    typed = [F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, after or ())]
    if after is not None:
        rows = rows.where((F.col(order[0]) <= typed[0]) & (F.struct(*order) < F.struct(*typed)))
    ahead = rows.orderBy(*[F.col(c).desc() for c in order]).limit(size + 1)
    w = Window.orderBy(*[F.col(c).desc() for c in order])  # one page
    numbered = ahead.withColumn("_n", F.row_number().over(w)).withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(1))) > size)
    return numbered.where(F.col("_n") <= size).drop("_n")


def baseline_run(runs: DataFrame, suite: str, branch: str, exclude: str) -> DataFrame:
    """The run to compare with: a promoted one first, else the one of the branch that ended last; it succeeded at least in part and isn't the candidate."""
    rows = runs.where((F.col("suite") == suite) & F.col("status").isin("succeeded", "partial") & (F.col("run_id") != exclude) & (F.col("promoted") | (F.col("branch") == branch)))
    return rows.orderBy(F.col("promoted").desc(), F.col("ended_at").desc(), "run_id").limit(1)


def latest_locked(versions: DataFrame) -> DataFrame:
    """Each dataset's version that was locked last."""
    rows = versions.where("locked_at is not null")
    return rows.groupBy("dataset").agg(F.max_by("version", F.struct("locked_at", "version")).alias("version"), F.max("locked_at").alias("locked_at"))


def top_k(rows: DataFrame, keys: list[str], score: str, id_: str, k: int) -> DataFrame:
    """The k best rows of each key, `rank` from 1; ties go to the lesser id."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(id_))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pending_batch(traces: DataFrame, rules: DataFrame, evaluated: DataFrame, now_us: int, size: int = 200, lookback_us: int = 24 * 3600 * 1_000_000) -> DataFrame:
    """For each rule of rules(rule, name) its oldest `size` traces within the lookback that it hasn't decided, whatever order they came in.

    A rule with a name only takes traces of that name and is joined by it. Rules are what users wrote, a few hundred at most: those without a name
    go to the tasks as one list.
    """
    rows = traces.where(F.col("started_us") >= now_us - lookback_us)
    named = rows.join(rules.where("name is not null"), "name").select(*rows.columns, *[c for c in rules.columns if c != "name"])
    others = [c for c in rules.columns if c != "name"]
    of_all = rules.where("name is null").agg(F.collect_list(F.struct(*others)).alias("_rules")).scalar()  # each takes every trace, so that no join can save work
    every = rows.withColumn("_rules", of_all).withColumn("_rule", F.explode("_rules")).select(*rows.columns, *[F.col("_rule")[c].alias(c) for c in others])
    wanted = named.unionByName(every)
    left = wanted.join(evaluated.select("trace_id", "rule"), ["trace_id", "rule"], "left_anti")
    place = F.row_number().over(Window.partitionBy("rule").orderBy("started_us", "trace_id"))
    return left.withColumn("place", place).where(F.col("place") <= size)


def decisions(rows: DataFrame, id_: str, rate: float, salt: str, failed: Column, budget_by: list[str], budget: int, order: list[str], enabled: bool = True, forced: Column | None = None, deterministic: bool = False, paid: bool = False, spent: bool = False) -> DataFrame:
    """`decision` of each row, the first that applies: disabled, forced, deterministic (rules that cost nothing take all), sampled by hash,
    escalated if failed and among the budget's first of its group, capped, not_sampled. A paid rule without money left says budget in place of taking a row.
    """
    sampled = bucket(salt, F.col(id_)) < rate
    must = F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False)
    rows = rows.withColumn("_taken", must | F.lit(deterministic) | sampled).withColumn("_candidate", ~F.col("_taken") & failed)
    place = F.row_number().over(Window.partitionBy(*budget_by, "_candidate").orderBy(*order))
    decision = F.when(F.lit(not enabled), "disabled").when(must, "forced").when(F.lit(deterministic), "deterministic").when(sampled, "sampled")
    decision = decision.when(F.col("_candidate") & (place <= budget), "escalated").when(F.col("_candidate"), "capped").otherwise("not_sampled")
    rows = rows.withColumn("decision", decision)
    if paid and spent:
        rows = rows.withColumn("decision", F.when(F.col("decision").isin("forced", "deterministic", "sampled", "escalated"), "budget").otherwise(F.col("decision")))
    return rows.drop("_taken", "_candidate")


def kept_whole(spans: DataFrame, sampled: Column, keep_errors: bool = True) -> DataFrame:
    """Spans of the traces that are kept: sampled by their id, or with an error in any span; never a part of a trace."""
    rows = spans.withColumn("_bad", F.bool_or(F.col("failed")).over(Window.partitionBy("trace_id")))
    return rows.where(sampled | (F.col("_bad") if keep_errors else F.lit(False))).drop("_bad")


def online_rollup(evaluations: DataFrame) -> DataFrame:
    """evaluations(rule, verdict, cost) per rule: counts by verdict, cost, pass rate of those judged, coverage of all; null where there is nothing to divide by."""
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    out = evaluations.groupBy("rule").agg(*[count(v).alias(v) for v in ("pass", "fail", "inconclusive", "error", "skipped")], F.sum("cost").alias("cost"))
    done = F.col("pass") + F.col("fail") + F.col("inconclusive") + F.col("error")
    return out.select("*", F.try_divide(F.col("pass"), F.col("pass") + F.col("fail")).alias("pass_rate"), F.try_divide(done, done + F.col("skipped")).alias("coverage"))


def rolling_rollup(evaluations: DataFrame, at: str, window: str = "24 hours", step: str = "15 minutes") -> DataFrame:
    """The rollup's counts for each rule in sliding windows; works on streams with a watermark too."""
    out = evaluations.groupBy(F.window(at, window, step).alias("w"), "rule").agg(F.count(F.when(F.col("verdict") == "pass", 1)).alias("passed"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "rule", "passed", "n")


def run_totals(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id").agg(F.count("*").alias("completed"), F.count(F.when(F.col("status") != "ok", 1)).alias("failed"), F.sum("cost").alias("cost"))


def queue_health(items: DataFrame, queue: str = "queue") -> DataFrame:
    """Per queue and status the items, and the oldest one's time; pending ones tell how long the queue is."""
    return items.groupBy(queue, "status").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))


def queue_head(items: DataFrame, queue: str = "queue") -> DataFrame:
    """The item that each queue hands out next: the highest priority, then the oldest, then the least id."""
    rows = items.where("status = 'pending'")
    return rows.groupBy(queue).agg(F.min_by("item_id", F.struct(-F.col("priority"), "created_at", "item_id")).alias("item_id"))


def assigned(queue: DataFrame, assignments: DataFrame) -> DataFrame:
    """Items of a queue with who has them."""
    return queue.join(assignments, "item_id")


def dead_letters(letters: DataFrame, since) -> DataFrame:
    """Per job the failures since a moment and the last, and its oldest one that isn't settled, with their number."""
    recent = F.col("failed_at") >= F.lit(since).cast("timestamp")
    unsettled = F.col("resolved_at").isNull()
    return letters.groupBy("job").agg(F.count(F.when(recent, 1)).alias("n"), F.max(F.when(recent, F.col("failed_at"))).alias("last"), F.min(F.when(unsettled, F.col("failed_at"))).alias("oldest_unsettled"), F.count(F.when(unsettled, 1)).alias("n_unsettled"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that should be there once and aren't, and how often they are."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def next_number(rows: DataFrame, keys: list[str], column: str, first: int = 0) -> DataFrame:
    """The number after the largest one of each key."""
    return rows.groupBy(*keys).agg((F.coalesce(F.max(column), F.lit(first - 1)) + 1).alias("next"))


def content_hash(rows: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """sha256 over the lines of each key in their order, one \\n after each.

    The hash of a version needs its lines in one place: keys are versions of datasets for people to read, thousands of lines, not corpora.
    """
    listed = rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: F.concat(x[line], F.lit("\n"))).alias("lines"), F.count("*").alias("n"))
    return listed.select(*keys, F.sha2(F.array_join("lines", ""), 256).alias("content_hash"), "n")


def locked_version(rows: DataFrame, keys: list[str], order: str, line: str, recorded: DataFrame | None = None) -> DataFrame:
    """content_hash of each version; with the recorded hashes also whether each is still the same. A version without lines has no row and isn't locked."""
    now = content_hash(rows, keys, order, line)
    if recorded is None:
        return now
    return now.join(recorded.withColumnRenamed("content_hash", "recorded_hash"), keys).withColumn("unchanged", F.col("content_hash") == F.col("recorded_hash"))


def cloned(rows: DataFrame, dataset: str, version: int, to: int) -> DataFrame:
    """The examples of a version as those of a new one, with where they come from."""
    return rows.where((F.col("dataset") == dataset) & (F.col("version") == version)).withColumn("version", F.lit(to)).withColumn("cloned_from", F.lit(version))


def promoted(traces: DataFrame, spans: DataFrame, reviews: DataFrame, span_name: str | None = None) -> DataFrame:
    """Traces to dataset examples: id, input (of the named span, else the root's, else the trace's metadata, else {}), expected (from a person's review only), source_trace_id."""
    named = F.when(F.col("name") == span_name, 0) if span_name else F.lit(None).cast("int")
    rank = F.coalesce(named, F.when(F.col("parent_id").isNull(), 1))
    best = spans.where(F.col("input").isNotNull()).withColumn("_rank", rank).where("_rank is not null").groupBy("trace_id").agg(F.min_by("input", F.struct("_rank", "started_us", "span_id")).alias("_input"))
    out = traces.join(reviews.select("trace_id", "expected"), "trace_id").join(best, "trace_id", "left")
    return out.select(F.concat(F.lit("trace-"), F.substring("trace_id", 1, 12)).alias("id"), F.coalesce("_input", "metadata", F.lit("{}")).alias("input"), "expected", F.col("trace_id").alias("source_trace_id"))


def nested_scores(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Results with their scores as a list, by metric; none is an empty list. Back in dataset order by `ordinal` where there is one."""
    listed = scores.groupBy("run_id", "example_id").agg(F.sort_array(F.collect_list(F.struct("metric", "value"))).alias("scores"))
    out = results.join(listed, ["run_id", "example_id"], "left")
    out = out.withColumn("scores", F.coalesce("scores", F.array().cast("array<struct<metric:string,value:double>>")))
    return out.orderBy("run_id", "ordinal", "example_id") if "ordinal" in out.columns else out


def judge_calls(evaluators: DataFrame, n_examples: int) -> DataFrame:
    """What a run would ask of judges: evaluators(name, type, votes) by name."""
    return evaluators.where("type = 'llm_judge'").select("name", (F.lit(n_examples) * F.coalesce("votes", F.lit(1))).alias("calls"))


def first_of_entity(rows: DataFrame, key: str, id_: str, order: str) -> DataFrame:
    """Each row with `canonical`: the id of the first row with its normalised key, and whether it is another's duplicate."""
    plain = F.regexp_replace(F.lower(key), "[^a-z0-9]+", "")
    first = F.first(id_).over(Window.partitionBy(plain).orderBy(order))
    return rows.withColumn("canonical", first).withColumn("is_duplicate", F.col("canonical") != F.col(id_))


def expired_partitions(names: DataFrame, cutoff: str) -> DataFrame:
    """names(partition) ending in _yyyy_mm: drop (the whole month is before the cutoff) or keep."""
    from spanledger.functions.scalars import month_of_partition

    month = month_of_partition(F.col("partition"))
    return names.select("partition", F.when(F.add_months(month, 1) <= F.lit(cutoff).cast("date"), "drop").otherwise("keep").alias("action"))


def located(citations: DataFrame, references: DataFrame, slack: int = 8) -> DataFrame:
    """citations(doc, anchor, page, offset) with `found`: a reference with that anchor on the same page, at most `slack` characters off."""
    right = references.select("doc", "anchor", F.col("page").alias("_page"), F.col("offset").alias("_offset"))
    near = citations.join(right, ["doc", "anchor"]).where((F.col("page") == F.col("_page")) & (F.abs(F.col("offset") - F.col("_offset")) <= slack))
    hits = near.select("doc", "anchor", "page", "offset").distinct().withColumn("found", F.lit(True))
    return citations.join(hits, ["doc", "anchor", "page", "offset"], "left").fillna(False, ["found"])


def evaluations_of(evaluations: DataFrame, rules: DataFrame) -> DataFrame:
    """A trace's online evaluations(trace_id, rule_id, verdict, created_at) with what their rules are called; a rule that is gone leaves its id.
    `place` counts those of a trace from the newest."""
    named = evaluations.join(rules.select("rule_id", F.col("name").alias("_name"), "enabled"), "rule_id", "left")
    newest = Window.partitionBy("trace_id").orderBy(F.desc("created_at"), "rule_id")
    return named.withColumn("rule", F.coalesce("_name", F.col("rule_id").cast("string"))).withColumn("place", F.row_number().over(newest)).drop("_name")


def sourced_claims(claims: DataFrame, documents: DataFrame, source: str = "source_id") -> DataFrame:
    """claims(claim_id, source_id, ...) with `title` of the document that they cite, and `grounded`: whether it is there."""
    held = documents.select(F.col("doc_id").alias(source), "title", F.lit(True).alias("_there")).dropDuplicates([source])
    return claims.join(held, source, "left").withColumn("grounded", F.coalesce("_there", F.lit(False))).drop("_there")


def outside_vocabulary(rows: DataFrame, keys: list[str], word: str, approved: list[str]) -> DataFrame:
    """Per key whether all its words are approved ones, and the others in order."""
    used = rows.where(F.col(word).isNotNull()).select(*keys, word).distinct()
    others = F.array_sort(F.collect_list(F.when(~F.col(word).isin(approved), F.col(word))))
    return used.groupBy(*keys).agg(others.alias("others")).withColumn("approved", F.size("others") == 0)
