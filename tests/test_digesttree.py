import json
import re

import pytest
from pyspark.sql import functions as F

from kubestrata.operators import change, digesttree

DDL = "capture_id string, path string, seq bigint, captured_at timestamp_ntz, event_type string, response_code int, body string"


def records(spark, n, change_at=(), capture="c", gone=(), extra=(), spaced=False):
    """One path per number in a few namespaces, a third of all in one of them."""
    k = F.col("id")
    ns = F.when(k % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("ns"), k % 40))
    value = k + F.when(k.isin(list(change_at)), 1_000_000).otherwise(0)
    body = F.concat(F.lit('{"v": '), value, F.lit('.0, "a": 1}')) if spaced else F.concat(F.lit('{"a":1,"v":'), value, F.lit("}"))
    rows = spark.range(n).filter(~k.isin(list(gone))).union(spark.createDataFrame([(e,) for e in extra], "id bigint"))
    return rows.select(F.lit(capture).alias("capture_id"), F.concat(F.lit("/api/v1/namespaces/"), ns, F.lit("/pods/p"), k).alias("path"),
                       F.lit(0).cast("bigint").alias("seq"), F.lit("2026-04-10").cast("timestamp_ntz").alias("captured_at"),
                       F.lit(None).cast("string").alias("event_type"), F.lit(200).alias("response_code"), body.alias("body"))


def kept(spark, tmp_path, name, rows, **more):
    folder = str(tmp_path / name)
    digesttree.keep_snapshot(rows, folder, **more)
    return folder


def same(got, want, keys=("path",)):
    cols = [*keys, "before", "after"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(map(tuple, want.select(*cols).collect()), key=repr)


def test_equal_to_the_whole_diff(spark, tmp_path):
    b, a = records(spark, 500), records(spark, 500, [0, 7, 33], "d", gone=[5, 6], extra=[900], spaced=True)
    got = digesttree.diff_kept(spark, kept(spark, tmp_path, "b", b), kept(spark, tmp_path, "a", a))
    assert got.count() == 6
    same(got, change.diff_captures(b, a))
    same(digesttree.diff_kept(spark, str(tmp_path / "b"), str(tmp_path / "a"), "pods", "hot"), change.diff_captures(b, a, "pods", "hot"))


def test_one_change_in_many_opens_one_branch(spark, tmp_path):
    b = kept(spark, tmp_path, "b", records(spark, 100_000))
    a = kept(spark, tmp_path, "a", records(spark, 100_000, [3 * 4711]))
    branches = digesttree.open_branches(spark, b, a).collect()
    assert [(r["resource"], r["namespace"]) for r in branches] == [("pods", "hot")]
    d = digesttree.diff_kept(spark, b, a)
    assert [json.loads(r["after"])["v"] - json.loads(r["before"])["v"] for r in d.collect()] == [1_000_000]
    plan = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 4 and sum("body" in s.split("ReadSchema")[1] for s in scans) == 2
    read = [re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", s).group(1) for s in scans]
    assert all(re.search(rf"part#\d+ (= |IN \(){branches[0]['part']}\)", f) for f in read), read


def test_nothing_changed_reads_nothing(spark, tmp_path):
    b, a = kept(spark, tmp_path, "b", records(spark, 200)), kept(spark, tmp_path, "a", records(spark, 200, spaced=True))
    assert digesttree.open_branches(spark, b, a).count() == 0 and digesttree.diff_kept(spark, b, a).count() == 0


def test_empty_sides_empty_bodies_and_other_records(spark, tmp_path):
    none = spark.createDataFrame([], DDL)
    full = records(spark, 20)
    e, f = kept(spark, tmp_path, "e", none), kept(spark, tmp_path, "f", full)
    same(digesttree.diff_kept(spark, e, f), change.diff_captures(none, full))
    same(digesttree.diff_kept(spark, f, e), change.diff_captures(full, none))
    assert digesttree.diff_kept(spark, e, e).count() == 0
    odd = [("c", "/api/v1/x/a", 0, None, None, 200, None), ("c", "/api/v1/x/b", 0, None, None, 200, ""), ("c", "/api/v1/x/c", 0, None, None, 200, "no json"),
           ("c", "/healthz", 0, None, None, 200, "{}"), ("c", "/api/v1/pods?as=Table", 0, None, None, 200, "{}"), ("c", "/api/v1/y", 0, None, None, 404, "{}")]
    rows = spark.createDataFrame(odd, DDL)
    o = kept(spark, tmp_path, "o", rows)
    same(digesttree.diff_kept(spark, e, o), change.diff_captures(none, rows))
    filled = rows.withColumn("body", F.lit('{"z":1}'))
    same(digesttree.diff_kept(spark, o, kept(spark, tmp_path, "z", filled)), change.diff_captures(rows, filled))


def test_captures_apart_and_parts_must_agree(spark, tmp_path):
    b = records(spark, 60).union(records(spark, 60, capture="d"))
    a = records(spark, 60, [4]).union(records(spark, 60, [9], "d"))
    fb, fa = kept(spark, tmp_path, "b", b), kept(spark, tmp_path, "a", a)
    got = digesttree.diff_kept(spark, fb, fa, by_capture=True)
    same(got, change.diff_tables(b, a, ["capture_id", "path"]), ("capture_id", "path"))
    assert sorted(r["capture_id"] for r in got.collect()) == ["c", "d"]
    with pytest.raises(ValueError, match="one capture"):
        digesttree.diff_kept(spark, fb, fa)
    with pytest.raises(ValueError, match="parts"):
        digesttree.diff_kept(spark, fb, kept(spark, tmp_path, "p", a, parts=8), by_capture=True)
