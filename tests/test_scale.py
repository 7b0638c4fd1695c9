"""What the plans of queries on large tables may hold, and that it changes no row."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kubestrata import schema
from kubestrata.llm import near_copies, quality
from kubestrata.operators import dash, graph, health, search, shape, textindex
from kubestrata.operators.textindex import TextIndex
from kubestrata.plans import all_queries

AT = "2024-02-01 00:00:00"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture
def sf(spark, tmp_path):
    """A lineitem of twelve rows."""
    rows = [(k, k % 5, k % 3, 1 + k % 4, float(k * 3), 0.08, 0.02 * (k % 4), "NRA"[k % 3], "OF"[k % 2], "2024-01-0%d" % (1 + k % 9)) for k in range(12)]
    names = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
    df = spark.createDataFrame(rows, names).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    df.withColumn("l_linenumber", F.col("l_linenumber").cast("int")).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.fixture
def pods(spark):
    def pod(name, phase, **state):
        return json.dumps({"metadata": {"name": name, "labels": {"a": "b"}, "creationTimestamp": "2024-01-01T00:00:00Z"}, "status": {
            "phase": phase, "containerStatuses": [{"name": "c", "ready": not state, "restartCount": 2, "state": state or {"running": {}}}]}})

    rows = [("c0", "p", "ns", n, o) for n, o in (("a", pod("a", "Running")), ("b", pod("b", "Failed")), (
        "c", pod("c", "Running", waiting={"reason": "CrashLoopBackOff"})), ("d", "junk"))]
    return spark.createDataFrame(rows, "capture_id string, path string, namespace string, name string, obj string")


def test_index_keeps_one_posting_per_leaf_with_all_places(spark, tmp_path):
    texts = ["abcabc", "é😀xé😀x", "ab", "", "aaaa"]
    index = TextIndex(spark, str(tmp_path / "index")).add(spark.createDataFrame([(json.dumps({"t": t}),) for t in texts], "obj string"))
    kept = [tuple(r) for r in index._postings().select("gram", "digest", "leaf").collect()]
    assert len(kept) == len({(g, bytes(d), x) for g, d, x in kept})
    want = sorted((t[i : i + 3], i) for t in texts for i in range(len(t) - 2))
    assert sorted((r["gram"], r["place"]) for r in index.grams().select("gram", "place").collect()) == want


def test_segments_hold_every_place_once(monkeypatch):
    rng = np.random.default_rng(3)
    wide = "".join(map(chr, rng.integers(0x4E00, 0x4E00 + 5000, 100_000).tolist()))  # so many trigrams that places wrap at 2^32
    texts = ["abcabc", "ab", "", "é😀xé😀x", wide, "abc", "def" * 50, "xyz"]
    monkeypatch.setattr(textindex, "SLICE_CHARS", 100)
    batch = pa.RecordBatch.from_pydict({"digest": pa.array([b"%d" % n for n in range(len(texts))]), "leaf": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    got, pieces = [], list(textindex.segments(iter([batch, batch.slice(0, 0)])))
    for piece in pieces:
        lists, *rows = piece.to_pylist()
        place = lambda r: [(v - r["base"]) % 2**32 for v in r["places"]]
        *first, end = place(lists)
        assert lists["gram"] == "" and [r["gram"] for r in rows] == sorted({r["gram"] for r in rows}) and end == sum(len(texts[n]) for n in lists["leaves"])
        assert [b"%d" % n for n in lists["leaves"]] == lists["digests"] and {r["segment"] for r in rows} == {lists["segment"]}
        for r in rows:
            for at in place(r):
                n = int(np.searchsorted(first, at, "right")) - 1
                got.append((lists["leaves"][n], at - first[n], r["gram"]))
    assert len(pieces) == 3 and sorted(got) == sorted((n, i, t[i : i + 3]) for n, t in enumerate(texts) for i in range(len(t) - 2))


@pytest.fixture
def prose(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(300)]
    rows = [("c", "p", "", "v1", "pods", "ns", f"p{n}", True, "ns", json.dumps({"t": " ".join(rng.choice(words, 1500)) + (" needle" if n % 10 == 0 else "")})) for n in range(30)]
    names = "capture_id string, path string, group string, version string, resource string, namespace string, name string, decodable boolean, obj_namespace string, obj string"
    return spark.createDataFrame(rows, names)


def test_index_and_search_leave_little_on_disk(spark, prose, tmp_path):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}

    size, before = sum(len(r["obj"]) for r in prose.collect()), shuffled()
    moved = lambda: sum(n for name, n in shuffled().items() if name not in before)
    index = TextIndex(spark, str(tmp_path / "index")).add(prose)
    assert moved() < size / 8  # no body is shuffled
    assert sorted(r["name"] for r in search.search_text(prose, "needle", index=index).collect()) == ["p0", "p10", "p20"]
    assert moved() < size / 8
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 2.3 * size


def test_marks_miss_no_digest_and_few_others(spark):
    given = spark.range(4000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("digest"), "id").union(spark.sql("SELECT CAST(NULL AS BINARY), -1L"))
    marked = given.filter(textindex.may_be_among(given.filter("id % 4 = 0").select("digest")))
    assert marked.filter("id % 4 = 0").count() == 1000 and marked.filter("id % 4 <> 0").count() < 30
    assert given.filter(textindex.may_be_among(given.filter("id > 9999").select("digest"))).count() == 0


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_bodies_that_come_again_are_indexed_once(spark, tmp_path, broadcast):
    bodies = lambda *texts: spark.createDataFrame([(None if t is None else json.dumps({"t": t, "u": "def"}),) for t in texts], "obj string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        index = TextIndex(spark, str(tmp_path / "index")).add(bodies("abc", "abc", "needle", "xabc", None, None)).add(bodies("needle", "abc", "new", "new", "other"))
        assert sorted(r["text"] for r in index.leaves().collect()) == sorted(["abc", "needle", "xabc", "new", "other"] + ["def"] * 5)
        assert index.bodies().filter("digest IS NOT NULL").count() == 5
        places = sorted((r["gram"], r["place"]) for r in index.grams().collect())
        assert places == sorted((t[i : i + 3], i) for t in ["abc", "needle", "xabc", "new", "other"] + ["def"] * 5 for i in range(len(t) - 2))
        assert index.candidates("abcdef").count() == index.candidates("cde").count() == 0  # two texts side by side are not one
        assert index.candidates("abc").count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_pod_rows_are_decoded_once_before_their_sort(pods):
    rows = dash.pod_rows(pods, AT)
    assert "from_json" not in plan(rows)
    assert [(r["name"], r["status"], r["severity"], r["restarts"]) for r in rows.collect()] == [
        ("b", "Failed", "bad", 2), ("c", "CrashLoopBackOff", "bad", 2), ("a", "Running", "good", 2), ("d", "", "good", 0)]


def test_headline_reads_no_more_of_a_status_than_it_shows(pods):
    line = dash.pod_headline(pods, AT)
    assert "lastState" not in plan(line)
    assert [r["subtitle"] for r in line.orderBy("name").collect()][:3] == [
        "1/1 containers ready · 2 restarts", "Failed · 2 restarts", "CrashLoopBackOff · 2 restarts"]


def test_missing_resources_decode_no_status(pods):
    parsed = health.parse_pods(pods, schema.POD_RESOURCES_DDL)
    assert "health" not in parsed.columns and "containerStatuses" not in plan(health.find_missing_resources(parsed))


def test_equal_findings_meet_by_hash_and_the_first_speaks(spark):
    bad = json.dumps({"metadata": {"name": "x"}, "spec": {"containers": [{"name": "c"}]}})
    rows = [("c0", "/b", "ns", 1, bad), ("c0", "/a", "ns", 7, bad), ("c0", "/a", "ns", 3, bad), ("c0", "/a", None, None, bad), ("c0", "/a", None, 0, bad)]
    pods = spark.createDataFrame(rows, "capture_id string, path string, namespace string, position long, obj string")
    found = health.find_missing_resources(health.parse_pods(pods, schema.POD_RESOURCES_DDL))
    assert "hashaggregate" in plan(found).lower()
    got = {(r["rule_id"], r["namespace"]): (r["path"], r["count"]) for r in found.collect()}
    assert got == {(f"workload.no-{w}", ns): ("/a", n) for w in ("requests", "limits") for ns, n in (("ns", 3), (None, 2))}


def test_log_counts_need_no_join(spark):
    keys = "capture_id string, namespace string, pod string, container string, previous boolean"
    targets = [("c0", "n", "p", c, v) for c in "abc" for v in (False, True)] + [("c0", "n", "p", "a", False), ("c0", None, "p", "a", False)]
    results = [("c0", "n", "p", "a", False, True, None), ("c0", "n", "p", "a", False, False, "twice"), ("c0", "n", "p", "b", True, True, None),
               ("c0", "n", "p", "b", False, None, None), ("c0", None, "p", "a", False, True, None), ("c1", "n", "p", "a", False, True, None)]
    t = spark.createDataFrame(targets, keys)
    r = spark.createDataFrame(results, f"{keys}, captured boolean, reason string")
    summary = shape.log_coverage(t, r)[0]
    assert "Join" not in plan(summary)
    met = [(x, y) for x in targets for y in ([z for z in results if z[:5] == x and None not in x] or [(*x, False, None)])]
    now = [bool(y[5]) for x, y in met if not x[4]]
    assert [tuple(x) for x in summary.collect()] == [("c0", len(now), sum(now), len(now) - sum(now), sum(bool(y[5]) for x, y in met if x[4]))]


@pytest.mark.parametrize("name", ["deployment_pods", "log_coverage", "log_failures"])
def test_pods_that_are_read_twice_are_decoded_once(spark, sf, name):
    assert "from_json" not in plan(dict(all_queries()[0])[name](spark, sf))


def test_mounts_decode_the_spec_alone(pods):
    assert "metadata" not in plan(graph.mount_edges(pods))


def test_cards_decode_in_a_projection(spark, sf):
    text = plan(dict(all_queries()[0])["container_cards"](spark, sf)).split("== Physical Plan ==")[1]
    assert "explode(array(from_json" not in text


def test_slices_of_text_are_small_and_change_no_signature():
    assert max(near_copies.SLICE_BYTES, quality.SLICE_BYTES) <= 1 << 20
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefgh"), 40)) for _ in range(50)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "_k": list(range(50)), "_t": list(range(50)), "text": texts})
    whole, was = near_copies._signatures(5, 4, 2), near_copies.SLICE_BYTES
    one = pa.Table.from_batches(whole(iter([batch])))
    try:
        near_copies.SLICE_BYTES = 200
        cut = [*whole(iter([batch]))]
    finally:
        near_copies.SLICE_BYTES = was
    assert len(cut) > 10 and pa.Table.from_batches(cut).combine_chunks().equals(one.combine_chunks())
