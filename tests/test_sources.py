import json

from conftest import lst, obj, write_archive
from pyspark.sql import functions as F

from kubestrata import Capture
from kubestrata.sources import archives
from kubestrata.sources import records as rec

PODS = "/api/v1/namespaces/ns/pods"


def line(i, path, minute, body, event=None):
    d = {"id": f"r{i}", "captured_at": f"2026-04-10T10:{minute:02d}:00.5Z", "api_path": path, "http_method": "GET", "response_code": 200, "response_body": body}
    return d | ({"event_type": event} if event else {})


def test_ndjson_round_trip(spark, tmp_path):
    src = tmp_path / "in.ndjson"
    rows = [line(1, PODS, 0, lst(obj("a", "ns"))), line(2, "/api/v1/nodes", 0, "plain \"text\""), line(3, PODS, 1, obj("a", "ns"), "MODIFIED")]
    src.write_text("\n".join(json.dumps(r) for r in rows) + "\nnot json\n{\"id\":\"x\"}\n")
    good, bad = rec.read_records(spark, str(src))
    assert [r["value"] for r in bad.orderBy("value").collect()] == ["not json", '{"id":"x"}']
    got = {(r["path"], r["seq"]): r for r in good.collect()}
    assert set(got) == {(PODS, 0), (PODS, 1), ("/api/v1/nodes", 0)}
    assert json.loads(got["/api/v1/nodes", 0]["body"]) == 'plain "text"' and got[PODS, 1]["event_type"] == "MODIFIED" and got[PODS, 0]["event_type"] is None
    out = str(tmp_path / "out")
    rec.write_ndjson(good, out)
    again, bad2 = rec.read_records(spark, out)
    cols = ["path", "seq", "captured_at", "event_type", "response_code", "body"]
    key = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert key(again) == key(good) and bad2.count() == 0


def test_tables_round_trip_and_pruning(spark, tmp_path, log):
    log.add(PODS, 0, lst(obj("a", "ns"))).add("/api/v1/nodes", 0, lst(obj("n"))).add("/api/v1", 0, {"kind": "APIResourceList"})
    out = str(tmp_path / "t")
    rec.write_tables(log.df(spark), out)
    back = rec.read_tables(spark, out)
    assert back.count() == 3 and sorted(r[0] for r in back.select("resource").distinct().collect()) == ["", "nodes", "pods"]
    cap = Capture(back)
    assert sorted(r["name"] for r in cap.state().collect()) == ["a", "n"]
    assert [r["name"] for r in cap.state(resources=["pods"]).collect()] == ["a"]
    plan = cap.state(resources=["pods"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [resource") + plan.count("PartitionFilters: [isnotnull(resource") + plan.count("resource#") > 0
    m = rec.manifest(back).first()
    assert (m["record_count"], m["watch_enabled"]) == (3, False) and m["uncompressed_bytes"] > 0


def build_archive(path):
    records = [line(1, PODS, 0, lst(obj("a", "ns"))), line(2, PODS, 1, obj("b", "ns"), "ADDED"), line(3, "/api/v1/nodes", 0, lst(obj("n")))]
    t = lambda m: f"2026-04-10T10:{m:02d}:00.5Z"
    index = {"entries": {PODS: {"api_path": PODS, "seqs": [0], "times": [t(0)], "counts": [1]}, "/api/v1/nodes": {"api_path": "/api/v1/nodes", "seqs": [0, 5], "times": [t(0), t(2)], "counts": [1]}}}
    watch = {"entries": {PODS: {"api_path": PODS, "seqs": [1], "times": [t(1)], "event_types": ["ADDED"]}}}
    meta = {"capture_id": "cap1", "captured_at": t(0), "captured_until": t(5), "kubernetes_version": "v1.30.0", "record_count": 3}
    write_archive(path, meta, records, index, watch)


def test_archive_landing(spark, tmp_path):
    build_archive(str(tmp_path / "one.zip"))
    t = archives.land_archives(spark, str(tmp_path / "one.zip"), str(tmp_path / "stage"), slices=3)
    assert sorted((r["path"], r["seq"], r["event_type"]) for r in t["records"].collect()) == [(PODS, 0, None), (PODS, 1, "ADDED"), ("/api/v1/nodes", 0, None)]
    c = t["captures"].first()
    assert (c["capture_id"], c["format_version"], c["captured_at"].microsecond) == ("cap1", 1, 500000)
    assert sorted(r["name"] for r in Capture(t["records"], t["captures"]).state().filter("resource = 'pods'").collect()) == ["a", "b"]
    idx = {(r["path"], r["seq"]): r["item_count"] for r in t["index"].collect()}
    assert idx == {(PODS, 0): 1, ("/api/v1/nodes", 0): 1, ("/api/v1/nodes", 5): None}
    issues = rec.check_capture(t["records"], t["index"], t["captures"]).collect()
    assert [(r["issue"], r["path"], r["seq"]) for r in issues] == [("indexed record is missing", "/api/v1/nodes", 5)]
    assert archives.unsupported(t["captures"]).count() == 0


def test_index_json_checks(spark):
    e = lambda **k: {"seqs": [0], "times": ["t"], "event_types": ["ADDED"]} | k
    cases = {
        "ok": {"entries": {"/a": e()}}, "bare": {"/a": e()}, "mixed": {"entries": {}, "/a": e()}, "nullentry": {"entries": {"/a": None}},
        "uneven": {"entries": {"/a": e(times=[])}}, "types": {"/a": e(event_types=[])}, "null": None,
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()] + [("broken", "{")], "k string, j string")
    got = sorted((r["k"], r["issue"]) for r in rec.check_index_json(df, "j", watch=True).collect())
    assert got == [("broken", "unparsable index"), ("mixed", "mixed wrapped and bare keys"), ("null", "index is null"), ("nullentry", "null index entry"),
                   ("types", "parallel arrays of unequal length"), ("uneven", "parallel arrays of unequal length")]


def test_index_is_cut_into_parts(spark, log):
    for i in range(7):
        log.add(PODS, i, lst(*[obj("a")] * i)).add(PODS, i, obj("a"), "MODIFIED")
    idx = rec.build_index(rec.enrich(log.df(spark)), rows=4)
    rows = idx.filter("NOT is_watch").orderBy("part").collect()
    assert [r["seqs"] for r in rows] == [[0, 2], [4, 6], [8, 10], [12]] and [c for r in rows for c in r["counts"]] == list(range(7))
    assert all(r["counts"] is None and len(r["event_types"]) == len(r["seqs"]) for r in idx.filter("is_watch").collect())


def test_future_format_is_flagged(spark):
    df = spark.createDataFrame([("a", 9), ("b", -1), ("c", 0), ("d", 2)], "capture_id string, format_version int")
    empty = spark.createDataFrame([], "capture_id string, path string, seq bigint")
    assert sorted(r["capture_id"] for r in rec.check_capture(empty, empty, df).collect()) == ["a", "b"]


def test_enrich_columns(spark, log):
    log.add(PODS + "?as=Table", 0, {"rows": [1, 2]})
    r = rec.enrich(log.df(spark)).first()
    assert (r["resource"], r["namespace"], r["view_kind"], r["item_count"]) == ("pods", "ns", "table", 2)
    assert rec.enrich(log.df(spark)).select(F.length("body_hash")).first()[0] == 64
