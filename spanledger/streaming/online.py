"""Continuous evaluation: each trace is decided once per rule, whatever is replayed and however late it comes."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from spanledger.operators import ingest, rollups


def _written(spark, path: str, before: int) -> DataFrame | None:
    """What earlier batches wrote below `path`; the folders of this one and later ones, left by an attempt that failed, don't count."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    rows = spark.read.parquet(path)
    return rows.where(F.col("batch") < before)


def decide_once(stream: DataFrame, decide: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, delay: str = "24 hours", lookback: str | None = None, **trigger) -> StreamingQuery:
    """Apply `decide` to a stream with trace_id and started_at and append its decisions below `path`/decisions.

    Repeats of a trace within `delay` are dropped by state; later ones by `path`/seen, where every trace that was ever looked at is
    noted, whether `decide` kept it or not. With a lookback, traces that started longer ago than that before the batch's newest one are never
    decided. A batch writes to folders of its own number and overwrites them, so a batch that is run again after a failure leaves the same files.
    """
    fresh = stream.withWatermark("started_at", delay).dropDuplicatesWithinWatermark(["trace_id"])

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if lookback:
            newest = batch.agg(F.max("started_at").alias("t"))
            batch = batch.join(F.broadcast(newest), F.col("started_at") >= F.col("t") - F.expr(f"interval {lookback}")).drop("t")
        batch = batch.dropDuplicates(["trace_id"])
        seen = _written(spark, f"{path}/seen", number)
        if seen is not None:
            batch = batch.join(seen.select("trace_id"), "trace_id", "left_anti")
        decide(batch).write.mode("overwrite").parquet(f"{path}/decisions/batch={number}")
        batch.select("trace_id").write.mode("overwrite").parquet(f"{path}/seen/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keep_spans(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("trace_id", "span_id"), order: str = "arrival", **trigger) -> StreamingQuery:
    """Keep a table of spans up to date from a stream of them, one version of the table for each batch below `path`.

    Every batch upserts the last version before it (see ingest.upsert_spans), so children may come before their parents, and a batch that comes
    or runs twice changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        versions = _written(batch.sparkSession, path, number)
        last = None if versions is None else versions.agg(F.max("batch")).first()[0]
        stored = versions.where(F.col("batch") == last).drop("batch") if last is not None else batch.drop(order).limit(0)
        ingest.upsert_spans(stored, batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


_PART = "trace_id string, n_spans long, n_errors long, n_open long, tokens long, cost decimal(28,8), started_us long, ended_us long"


def keep_rollups(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Add each batch's part of the traces' rollups (see rollups.part) below `path`, in a folder of the batch's number.

    A batch writes only the traces that it touches and reads nothing of what is stored; one that runs again overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        rollups.part(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def kept_rollups(spark: SparkSession, path: str) -> DataFrame:
    """The rollups of all batches so far."""
    return rollups.finished(rollups.merged(spark.read.schema(_PART).parquet(path)))


class _Spans(StatefulProcessor):
    """A trace's spans as they are stored: by span_id the JSON of the row. What a batch changes comes out."""

    def __init__(self, columns: list[str], key: str, fixed: tuple[str, ...], order: str, keep_ms: int | None):
        self.columns, self.key, self.fixed, self.order, self.keep_ms = columns, key, [c for c in fixed if c in columns], order, keep_ms

    def init(self, handle) -> None:
        self.rows = handle.getMapState("spans", f"{self.key} string", "row string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  the interface's names
        changed = {}
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        for text in frame["row_json"]:
            new = json.loads(text)
            place = (str(new.get(self.key)),)
            stored = self.rows.getValue(place)[0] if self.rows.containsKey(place) else None
            if stored is not None:
                new |= {c: v for c, v in json.loads(stored).items() if c in self.fixed}
            kept = json.dumps(new, sort_keys=True)
            if kept != stored:
                self.rows.updateValue(place, (kept,))
                changed[place] = kept
        yield pd.DataFrame({"trace_id": [key[0]] * len(changed), "row_json": list(changed.values())}, dtype=object)

    def close(self) -> None:
        pass


def span_changes(stream: DataFrame, key: str = "span_id", order: str = "arrival", fixed: tuple[str, ...] = ingest.FIXED_SPAN_COLUMNS, keep: str | None = None) -> DataFrame:
    """A stream of spans to the stream of what it changes in the stored ones: a row for each span that is new or differs from what was stored.

    One state per trace holds its spans; columns of `fixed` stay as first stored, of the others the last arrived counts. A batch that comes twice
    changes nothing. keep ("48 hours") forgets spans that nothing has changed for so long, with processing time. Needs the RocksDB
    state store (spark.sql.streaming.stateStore.providerClass).
    """
    columns = [c for c in stream.columns if c != order]
    rows = stream.select(F.col("trace_id").cast("string").alias("trace_id"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row_json"), F.col(order).alias(order))
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None
    out = rows.groupBy("trace_id").transformWithStateInPandas(_Spans(columns, key, fixed, order, keep_ms), "trace_id string, row_json string", "Update", "ProcessingTime" if keep else "None")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema if f.name != order)
    return out.select(F.from_json("row_json", schema).alias("r")).select("r.*")


def keep_changes(stream: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Write the changes of each batch, and nothing else, to a folder of its number below `path`; stored_spans() reads the table."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return span_changes(stream, **options).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_spans(spark: SparkSession, path: str, keys: tuple[str, ...] = ("trace_id", "span_id")) -> DataFrame:
    """The table of spans after all batches: the last change of each."""
    return ingest.latest(spark.read.parquet(path), list(keys), ["batch"]).drop("batch")
