"""Parents, depths and the order of trees, by pointer doubling: each round every span looks twice as far up, so that the rounds grow with the
logarithm of the depth.

Traces of up to WHOLE spans take all rounds on arrays inside their tasks. Those of longer ones are joins, so that no such trace is walked in one
process; their rounds are written below spark.checkpoint.dir, as a plan that joins itself would double each time, and the last one stays there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.sources.objects import parts, stored

LEAST_WIDTH = 0.002
#: Spans of a trace up to which its rounds are taken inside a task: what a trace may have where it is taken in.
WHOLE = 10_000


def _placed(spans: DataFrame) -> DataFrame:
    """The first span of each id with `place` (from 1 in its trace's order of start, sequence_index and id) and `up`, its parent's place; null without one there."""
    order = ["started_us", *(["sequence_index"] if "sequence_index" in spans.columns else []), "span_id"]
    first = F.row_number().over(Window.partitionBy("trace_id", "span_id").orderBy(*order))
    one = spans.withColumn("_n", first).where("_n = 1").drop("_n")
    rows = one.withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy(*order)))
    parents = rows.select("trace_id", F.col("span_id").alias("parent_id"), F.col("place").alias("up"))
    return rows.join(parents, ["trace_id", "parent_id"], "left")


def _rows(spans: DataFrame) -> tuple[DataFrame, int, int]:
    """Placed spans, stored and parted by trace, how many the largest trace has, and the number of parts.

    All that is joined to them is parted in the same way, so that no join shuffles them again.
    """
    kept = stored(spans)
    n_parts = parts(kept)
    rows = stored(_placed(kept.repartition(n_parts, "trace_id")))
    return rows.repartition(n_parts, "trace_id"), _largest(rows), n_parts


def _dropped(frame: DataFrame) -> None:
    """Delete the files of a round that a later one has replaced."""
    spark = frame.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _rounds(frame: DataFrame, step, n: int) -> DataFrame:
    """Repeat a step until no row has a `jump`, or until chains without a cycle, of n rows at most, must have ended."""
    frame, reach = stored(frame), 1
    while reach <= n and not frame.where("jump is not null").isEmpty():
        longer = stored(step(frame))
        _dropped(frame)
        frame, reach = longer, 2 * reach
    return frame


def _climbed(nodes: DataFrame, n: int, n_parts: int) -> DataFrame:
    """nodes(trace_id, place, up) with `dist` (ancestors), `top` (the last of them, or the node itself), `least` (the least place among them), `size`
    (itself and all below it) and `jump`: null, but for nodes whose ancestors go round a cycle, whose other columns mean nothing but `least`. n: rows of a trace at most.
    """
    short, long = _by_length(nodes, n)
    whole = short.groupBy("trace_id").agg(_listed("place", "up")).mapInArrow(_in_task(_climb, "place", "up"), f"trace_id {_kind(nodes)}, {_CLIMBED}")
    return stored(whole if long is None else whole.unionByName(_climbed_by_joins(long, n))).repartition(n_parts, "trace_id")


def _climbed_by_joins(nodes: DataFrame, n: int) -> DataFrame:
    one = F.lit(1).cast("long")
    start = nodes.select("trace_id", "place", F.col("up").alias("jump"), F.when(F.col("up").isNotNull(), one).otherwise(0).alias("dist"), F.coalesce("up", "place").alias("top"), F.col("up").alias("least"), one.alias("size"))

    def step(s: DataFrame) -> DataFrame:
        above = s.select("trace_id", F.col("place").alias("jump"), *[F.col(c).alias(f"_{c}") for c in ("jump", "dist", "top", "least")])
        below = s.where("jump is not null").groupBy("trace_id", F.col("jump").alias("place")).agg(F.sum("size").alias("_size"))
        both = s.join(above, ["trace_id", "jump"], "left").join(below, ["trace_id", "place"], "left")
        return both.select(
            "trace_id", "place", F.col("_jump").alias("jump"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"), F.coalesce("_top", "top").alias("top"),
            F.least("least", "_least").alias("least"), (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"),
        )

    return _rounds(start, step, n)


def _by_length(nodes: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of traces of up to WHOLE spans, and of the longer ones if there are any."""
    if n <= WHOLE:
        return nodes, None
    sized = nodes.withColumn("_most", F.max("place").over(Window.partitionBy("trace_id")))
    return sized.where(F.col("_most") <= WHOLE).drop("_most"), sized.where(F.col("_most") > WHOLE).drop("_most")


def _kind(frame: DataFrame) -> str:
    return frame.schema["trace_id"].dataType.simpleString()


def _listed(*columns: str):
    """A trace's rows as arrays of one length; `place` is among the columns."""
    return F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in columns])).alias("rows")


def _in_task(work, *columns: str):
    """Batches of traces with such arrays to the rows that work(trace of each row, column, ...) gives; it works on all traces of a batch at once."""

    def run(batches):
        for batch in batches:
            lists = batch.column("rows")
            flat, size = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            if len(flat):
                trace = np.repeat(np.arange(len(lists)), size)
                given = [flat.field(flat.type.get_field_index(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
                made = work(trace, *given)
                yield pa.record_batch([batch.column("trace_id").take(pa.array(trace)), *made.values()], names=["trace_id", *made])

    return run


def _heads(trace: np.ndarray, place: np.ndarray, up: np.ndarray) -> np.ndarray:
    """For each row the one that its `up` stands for, or -1."""
    key = trace << 32 | place
    order = np.argsort(key)
    want = trace << 32 | up
    at = order[np.minimum(np.searchsorted(key[order], want), len(order) - 1)]
    return np.where((up > 0) & (key[at] == want), at, -1)


_CLIMBED = "place int, jump int, dist long, top int, least int, size long"


def _climb(trace: np.ndarray, place: np.ndarray, up: np.ndarray) -> dict[str, pa.Array]:
    """_climbed() of whole traces: heads are rows, -1 is none."""
    jump = _heads(trace, place, up)
    dist, top = (jump >= 0).astype(np.int64), np.where(jump >= 0, jump, np.arange(len(jump)))
    least, size = np.where(jump >= 0, up, np.iinfo(np.int64).max), np.ones(len(jump), dtype=np.int64)
    most, reach = int(np.bincount(trace).max()), 1
    while reach <= most and (jump >= 0).any():
        on = np.flatnonzero(jump >= 0)
        to = jump[on]
        below = np.zeros_like(size)
        np.add.at(below, to, size[on])
        new, further, reached, lower = jump.copy(), dist.copy(), top.copy(), least.copy()
        new[on], further[on], reached[on], lower[on] = jump[to], dist[on] + dist[to], top[to], np.minimum(least[on], least[to])
        jump, dist, top, least, size, reach = new, further, reached, lower, size + below, 2 * reach
    null = lambda x, where: pa.array(x.astype(np.int32), mask=where)
    none = least == np.iinfo(np.int64).max
    return {"place": null(place, None), "jump": null(place[jump], jump < 0), "dist": pa.array(dist), "top": null(place[top], None), "least": null(np.where(none, 0, least), none), "size": pa.array(size)}


def _add(trace: np.ndarray, place: np.ndarray, up: np.ndarray, row: np.ndarray) -> dict[str, pa.Array]:
    """Sums of `row` over each row and its ancestors in whole traces without cycles."""
    jump, row = _heads(trace, place, up), row.copy()
    while (on := np.flatnonzero(jump >= 0)).size:
        to = jump[on]
        row[on], jump[on] = row[on] + row[to], jump[to]
    return {"place": pa.array(place.astype(np.int32)), "row": pa.array(row)}


def _summed(nodes: DataFrame, n: int, n_parts: int) -> DataFrame:
    """trace_id, place and the sum of `row` over each of the nodes(trace_id, place, up, row) and its ancestors, without cycles."""
    short, long = _by_length(nodes, n)
    whole = short.groupBy("trace_id").agg(_listed("place", "up", "row")).mapInArrow(_in_task(_add, "place", "up", "row"), f"trace_id {_kind(nodes)}, place int, row long")
    return (whole if long is None else whole.unionByName(_summed_by_joins(long, n))).repartition(n_parts, "trace_id")


def _summed_by_joins(nodes: DataFrame, n: int) -> DataFrame:
    def step(s: DataFrame) -> DataFrame:
        above = s.select("trace_id", F.col("place").alias("jump"), F.col("jump").alias("_jump"), F.col("row").alias("_row"))
        both = s.join(above, ["trace_id", "jump"], "left")
        return both.select("trace_id", "place", F.col("_jump").alias("jump"), (F.col("row") + F.coalesce("_row", F.lit(0))).alias("row"))

    return _rounds(nodes.withColumnRenamed("up", "jump"), step, n).drop("jump")


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("place")).first()[0] or 0


def with_depth(events: DataFrame) -> DataFrame:
    """events with `depth`: how many different events stand above each, through events of its trace only, so that an event whose parent wasn't selected has none.

    On a cycle of parents, or below one, each event of the cycle counts once and the event itself never. Ids must not be null; of events with one id
    the first stays.
    """
    rows, n, n_parts = _rows(events)
    climbed = _climbed(rows, n, n_parts)
    turning = climbed.where("jump is not null")
    plain = climbed.where("jump is null").select("trace_id", "place", "dist")
    if turning.isEmpty():
        depth = plain
    else:  # jumps have gone at least n steps, so each ends on a cycle, and each place of a cycle is one's end
        on = turning.select("trace_id", F.col("jump").alias("place")).distinct().join(turning.select("trace_id", "place", "least"), ["trace_id", "place"])
        on = on.withColumn("_round", F.count("*").over(Window.partitionBy("trace_id", "least"))).drop("least")
        live = rows.select("trace_id", "place", "up").join(turning.select("trace_id", "place"), ["trace_id", "place"]).join(on, ["trace_id", "place"], "left")
        live = live.withColumn("up", F.when(F.col("_round").isNull(), F.col("up")))
        tails = _climbed(live, n, n_parts).join(on.withColumnRenamed("place", "top"), ["trace_id", "top"])
        depth = plain.unionByName(tails.select("trace_id", "place", (F.col("dist") + F.col("_round") - 1).alias("dist")))
    return rows.join(depth, ["trace_id", "place"]).select(*events.columns, F.col("dist").cast("int").alias("depth"))


def waterfall(spans: DataFrame) -> DataFrame:
    """Each span's place in its trace's tree: depth, row in depth-first order, offset and width as shares of the trace's time, rows that hang below it.

    Spans whose parent isn't there are roots. What hangs on cycles of parents comes last: there the first span in order that has none of its
    ancestors before it is a root. Of spans with one id the first stays; ids must not be null; no spans give no rows. An open span lasts as long as its trace.
    """
    rows, n, n_parts = _rows(spans)
    nodes = rows.select("trace_id", "place", "up", F.lit(False).alias("cut"))
    climbed = _climbed(nodes, n, n_parts)
    turning = climbed.where("jump is not null").select("trace_id", "place", "least")
    if not turning.isEmpty():
        nodes = nodes.join(turning, ["trace_id", "place"], "left").withColumn("cut", F.coalesce(F.col("place") <= F.col("least"), F.lit(False)))
        nodes = stored(nodes.withColumn("up", F.when(~F.col("cut"), F.col("up"))).drop("least")).repartition(n_parts, "trace_id")
        again = _climbed(nodes.join(turning.select("trace_id", "place"), ["trace_id", "place"]), n, n_parts)
        climbed = climbed.where("jump is null").unionByName(again)
    sized = nodes.join(climbed.select("trace_id", "place", "dist", "size"), ["trace_id", "place"])
    siblings = Window.partitionBy("trace_id", "up").orderBy("cut", "place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(siblings), F.lit(0)) + F.col("up").isNotNull().cast("int")
    sized = stored(sized.withColumn("row", before)).repartition(n_parts, "trace_id")
    tree = sized.select("trace_id", "place", "dist", "size").join(_summed(sized.select("trace_id", "place", "up", "row"), n, n_parts), ["trace_id", "place"])
    kids = rows.where("up is not null").select("trace_id", F.col("up").alias("place"), F.lit(True).alias("_kids")).distinct()
    whole = Window.partitionBy("trace_id")
    first, last = F.min("started_us").over(whole), F.max(F.coalesce("ended_us", "started_us")).over(whole)
    timed = rows.withColumn("_first", first).withColumn("_last", F.greatest(last, first))
    out = timed.join(tree, ["trace_id", "place"]).join(kids, ["trace_id", "place"], "left")
    length = F.when(F.col("_last") > F.col("_first"), F.col("_last") - F.col("_first")).otherwise(1000)
    share = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / length))
    return out.select(
        "trace_id", "span_id", F.col("dist").cast("int").alias("depth"), F.col("row").cast("int").alias("row"), share(F.col("started_us") - F.col("_first")).alias("offset"),
        F.greatest(F.lit(LEAST_WIDTH), share(F.coalesce("ended_us", "_last") - F.col("started_us"))).alias("width"), F.coalesce("_kids", F.lit(False)).alias("has_children"),
        (F.col("parent_id").isNotNull() & F.col("up").isNull()).alias("is_orphan"), (F.col("size") - 1).cast("int").alias("n_below"),
    )
