import json
import random

import pytest
from pyspark.sql import functions as F

from spanledger.operators import ingest, rollups
from spanledger.sources import objects, otlp
from spanledger.streaming import online


def request(i):
    value = {"arrayValue": {"values": [{"doubleValue": 1.5}, {"boolValue": True}, {"kvlistValue": {"values": [{"key": "z", "value": {"intValue": "-7"}}]}}]}}
    span = {"traceId": f"{i + 1:032x}", "spanId": f"{i + 1:016x}", "parentSpanId": f"{i + 2:016x}", "name": "é b", "startTimeUnixNano": "1700000000123456789", "endTimeUnixNano": "1700000001000000000", "attributes": [{"key": "list", "value": value}, {"key": "raw", "value": {"bytesValue": "AAEC"}}, {"key": "n", "value": {"intValue": str(2**62)}}], "events": [{"timeUnixNano": "5", "name": "e"}] * 3, "status": {"message": "m", "code": 2}}
    return {"resourceSpans": [{"resource": {"attributes": [{"key": "service", "value": {"stringValue": "shop"}}]}, "scopeSpans": [{"scope": {"name": "s"}, "spans": [span, {"traceId": "ab" * 16, "spanId": "cd" * 8, "name": "open", "startTimeUnixNano": "1"}]}]}]}


def test_both_encodings_of_a_request_give_the_same_spans(spark):
    made = [request(i) for i in range(20)] + [{}]
    assert all(otlp.message(otlp.encoded(r)) == r for r in made)
    key = lambda r: json.dumps(r.asDict(recursive=True), sort_keys=True, default=str)
    by_json = ingest.decode_otlp(spark.createDataFrame([(json.dumps(r),) for r in made], "body string")).collect()
    spans, torn = otlp.decode_protobuf(spark.createDataFrame([(otlp.encoded(r),) for r in made] + [(None,)], "body binary"))
    assert sorted(map(key, spans.collect())) == sorted(map(key, by_json)) and len(by_json) == 40 and torn.count() == 0


def test_torn_and_hostile_bodies_are_errors_and_unknown_fields_are_not(spark):
    whole = otlp.encoded(request(0))
    rng, bad = random.Random(1), 0
    for cut in range(1, len(whole)):
        with pytest.raises(ValueError):
            otlp.message(whole[:cut])
    for _ in range(300):  # nothing but a ValueError comes out of noise
        noise = bytearray(whole)
        noise[rng.randrange(len(noise))] = rng.randrange(256)
        try:
            otlp.message(bytes(noise))
        except ValueError:
            bad += 1
    assert bad
    assert otlp.message(b"\x98\x06\x05" + whole + b"\xa5\x06abcd") == request(0)  # fields 99 and 100
    deep = b""
    for _ in range(60):
        inner = b"\x0a" + bytes([len(deep)]) + deep if len(deep) < 128 else deep
        deep = b"\x2a" + bytes([len(inner)]) + inner if len(inner) < 128 else inner
    rows = spark.createDataFrame([(1, whole[:-2]), (2, b"\xff" * 12), (3, whole)], "id int, body binary")
    spans, torn = otlp.decode_protobuf(rows)
    assert sorted(r["id"] for r in torn.collect()) == [1, 2] and spans.count() == 2 and torn.columns == ["id", "body", "error"]


def some_spans(spark, n=200):
    rng = random.Random(2)
    rows = [(f"t{rng.randrange(9)}", f"s{i}", rng.choice(["ok", "error", "unset"]), i * 10, None if i % 50 == 7 else i * 10 + rng.randrange(99), rng.choice([None, 3]), rng.choice([None, 0.25])) for i in range(n)]
    return spark.createDataFrame(rows, "trace_id string, span_id string, status string, started_us long, ended_us long, tokens long, cost double")


def test_any_split_into_batches_gives_the_whole_rollup(spark):
    s = some_spans(spark)
    whole = sorted(map(tuple, rollups.finished(rollups.part(s)).collect()))
    for n in (2, 5):
        parts = [rollups.part(s.where(F.pmod(F.xxhash64("span_id"), F.lit(n)) == i)) for i in range(n)]
        assert sorted(map(tuple, rollups.finished(rollups.merged(*reversed(parts))).collect())) == whole
    assert rollups.merged(rollups.part(s.limit(0))).count() == 0
    row = rollups.finished(rollups.part(spark.createDataFrame([("t", "ok", 5, None)], "trace_id string, status string, started_us long, ended_us long"))).first()
    assert (row["status"], row["ended_us"], row["tokens"], row["n_open"]) == ("unset", None, 0, 1)


def test_rollups_of_a_stream(spark, tmp_path):
    s = some_spans(spark, 60)
    source = tmp_path / "in"
    for i in range(3):
        s.where(F.pmod(F.xxhash64("span_id"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    online.keep_rollups(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    assert sorted(map(tuple, online.kept_rollups(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, rollups.finished(rollups.part(s)).collect()))


def test_objects_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([('{"b": 1, "a": [1, 2]}',), ('{"a":[1,2],"b":1}',), ("no json",), (None,), ("{}",)], "payload string")
    objects.put(rows, path)
    objects.put(rows.limit(3), path)
    stored = spark.read.schema(objects.SCHEMA).json(path)
    assert stored.count() == 3 and all(name.name.endswith(".gz") for name in (tmp_path / "store").glob("prefix=*/part-*"))
    assert sorted(r["text"] for r in objects.get(spark, path).collect()) == ["no json", '{"a":[1,2],"b":1}', "{}"]
    wanted = objects.addressed(spark.createDataFrame([('{"b":1,"a":[1,2]}',), ("not there",)], "payload string"))
    assert [r["text"] for r in objects.get(spark, path, wanted).collect()] == ['{"a":[1,2],"b":1}']


SPANS = "trace_id string, span_id string, name string, model string, status string, started_us long, arrival long"


def test_state_keeps_spans_and_a_replay_changes_nothing(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches = [
        [("t1", "a", "first", "m1", "unset", 5, 1), ("t1", "b", "child", None, "ok", 6, 2), ("t2", "a", "other", "m", "ok", 1, 3)],
        [("t1", "a", "renamed", "m2", "ok", 9, 4), ("t1", "a", "again", "m3", "error", 9, 5)],
        [("t1", "b", "child", None, "ok", 6, 2), ("t2", "a", "other", "m", "ok", 1, 3)],
    ]
    source, out = tmp_path / "in", str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, SPANS).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SPANS).parquet(str(source))
        online.keep_changes(stream, out, str(tmp_path / "mark")).awaitTermination(120)
    got = {(r["trace_id"], r["span_id"]): (r["name"], r["model"], r["status"], r["started_us"]) for r in online.stored_spans(spark, out).collect()}
    assert got == {("t1", "a"): ("again", "m1", "error", 5), ("t1", "b"): ("child", None, "ok", 6), ("t2", "a"): ("other", "m", "ok", 1)}
    assert {r["batch"]: r["count"] for r in spark.read.parquet(out).groupBy("batch").count().collect()} == {0: 3, 1: 1}


def test_requests_are_read_by_one_worker_of_a_task(spark):
    rows = spark.createDataFrame([(1, otlp.encoded({})), (2, b"\x0a\x05")], "id int, body binary")
    for frame in otlp.decode_protobuf(rows):
        assert frame._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
