import json

import pytest
from pyspark.sql import functions as F

from kubestrata.operators import change, dash, shape, timetravel
from kubestrata.sources import records as rec
from kubestrata.streaming import jobs


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture
def landing(tmp_path):
    rows = []

    def line(i, path, minute, body, event=""):
        rows.append(json.dumps({"id": f"r{i:04d}", "captured_at": f"2026-04-10T10:{minute:02d}:00Z", "api_path": path, "event_type": event,
                                "http_method": "GET", "response_code": 200, "response_body": body}))

    pods = "/api/v1/namespaces/a/pods"
    for i, (kind, v) in enumerate([("ADDED", 1), ("MODIFIED", 2), ("DELETED", 2), ("ADDED", 3), ("MODIFIED", 4)]):
        line(i, pods, i, {"metadata": {"name": "p", "namespace": "a"}, "v": v}, kind)
    for i, v in enumerate("AABBA"):
        line(10 + i, "/api/v1/nodes", i, {"items": [], "v": v})
    for i, spaces in enumerate([["x", "y"], ["x"], [], ["y"]]):
        line(20 + i, "/api/v1/services", i, {"items": [{"metadata": {"name": "s", "namespace": n}} for n in spaces]})
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.ndjson").write_text("\n".join(rows[:7]) + "\n")
    (d / "b.ndjson").write_text("\n".join(rows[7:]) + "\n")
    return str(d)


def stream(spark, landing):
    return rec.read_records_stream(spark, landing)


def test_dedup_stream_matches_batch(spark, landing):
    got = run(jobs.dedup_stream(stream(spark, landing).filter("path = '/api/v1/nodes'")), "dedup")
    batch, _ = rec.read_records(spark, landing)
    want = shape.dedup_consecutive(batch.filter("path = '/api/v1/nodes'"))
    assert sorted(r[0] for r in got.select("record_id").collect()) == sorted(r[0] for r in want.select("record_id").collect())
    assert got.count() == 3


def test_transitions_stream_matches_batch(spark, landing):
    got = run(jobs.transitions_stream(stream(spark, landing)), "trans")
    batch, _ = rec.read_records(spark, landing)
    ev = timetravel.event_objects(batch)
    want = change.transitions_watch(ev)
    cols = ["record_id", "event_type", "before", "after"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(map(tuple, want.select(*cols).collect()), key=repr)


def test_emptied_stream(spark, landing):
    got = run(jobs.emptied_stream(stream(spark, landing).filter("path = '/api/v1/services'")), "gone")
    rows = sorted((r["captured_at"].minute, r["namespace"]) for r in got.collect())
    assert rows == [(1, "y"), (2, "x"), (2, "y"), (3, "x")]


def test_activity_stream_matches_batch(spark, landing):
    got = run(jobs.activity_stream(stream(spark, landing).filter("event_type IS NOT NULL"), "1 minute"), "act", "complete")
    assert got.agg(F.sum("total"), F.sum("warn"), F.sum("bad")).first()[:] == (5, 2, 1)
    batch, _ = rec.read_records(spark, landing)
    caps = batch.groupBy("capture_id").agg(F.min("captured_at").alias("captured_at"), F.max("captured_at").alias("captured_until"))
    b = dash.activity(timetravel.event_objects(batch), caps, buckets=4)
    assert b.agg(F.sum("total"), F.sum("warn"), F.sum("bad")).first()[:] == (5, 2, 1)


def test_landing_sink_continues_seq(spark, landing, tmp_path):
    target = str(tmp_path / "out")
    q = (
        rec.read_records_stream(spark, landing, maxFilesPerTrigger=1).writeStream.foreachBatch(jobs.land_batch(target))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    out = spark.read.parquet(target)
    for path, n in (("/api/v1/namespaces/a/pods", 5), ("/api/v1/nodes", 5), ("/api/v1/services", 4)):
        assert sorted(r[0] for r in out.filter(F.col("path") == path).select("seq").collect()) == list(range(n))


def test_list_then_tail_stream(spark, landing):
    batch, _ = rec.read_records(spark, landing)
    at = "2026-04-10T10:01:30Z"
    now, later = jobs.list_then_tail_stream(timetravel.reconstruct_at(batch, at), stream(spark, landing), at, "/api/v1/namespaces/a/pods")
    assert [r["object_key"] for r in now.collect()] == ["a/p"]
    assert [r["event_type"] for r in run(later, "tail").orderBy("captured_at").collect()] == ["DELETED", "ADDED", "MODIFIED"]


def test_split_late(spark, landing):
    batch, _ = rec.read_records(spark, landing)
    good, late = jobs.split_late(batch, "2026-04-10T10:12:30Z")
    assert good.count() + late.count() == batch.count()
    assert {r["captured_at"].minute for r in late.collect()} == {0, 1, 2}
