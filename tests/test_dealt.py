"""Inputs of one file and one row group become many tasks before rows grow into objects."""

import pytest
from pyspark.sql import functions as F

from kubestrata.operators import change
from kubestrata.plans import adapters as ad
from kubestrata.plans.object_queries import _part_tables


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("one_file"))
    k = F.col("id")
    part = spark.range(0, 40, 1, 1).select(k.alias("p_partkey"), F.lit("STANDARD").alias("p_type"), F.lit("Brand#1").alias("p_brand"),
                                           (k % 9).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    orders = spark.range(0, 40, 1, 1).select(k.alias("o_orderkey"), F.lit(1.5).alias("o_totalprice"), F.lit("5-LOW").alias("o_orderpriority"))
    customer = spark.range(0, 40, 1, 1).select(k.alias("c_custkey"), (k % 5).cast("int").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    for name, df in (("part", part), ("orders", orders), ("customer", customer)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("build", [ad.workloads, _part_tables, ad.order_records, ad.claims])
def test_rows_of_one_file_are_dealt_out(spark, one_file, build):
    sizes = build(spark, one_file).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in sizes) == 40


def test_cluster_timeline_spreads_its_one_target(spark):
    ev = spark.range(200).select(
        F.lit("c0").alias("capture_id"), F.concat(F.lit("/api/v1/namespaces/ns"), F.col("id") % 3, F.lit("/widgets")).alias("path"),
        F.col("id").alias("seq"), F.lit("2024-01-01").cast("timestamp_ntz").alias("captured_at"), F.lit("MODIFIED").alias("event_type"),
        F.lit("u").alias("name"), F.lit("u").alias("object_key"))
    own = ev.limit(1).withColumn("path", F.lit("/api/v1/gadgets"))
    out = change.timeline(ev.unionByName(own), cluster=True)
    rows = out.filter("target = '/api/v1/widgets'").orderBy("rv").collect()
    assert [r["rv"] for r in rows] == list(range(2, 202)) and [(r["path"], r["seq"]) for r in rows] == sorted((r["path"], r["seq"]) for r in rows)
    assert [r["rv"] for r in out.filter("target = '/api/v1/gadgets'").collect()] == [2]


def test_join_with_exact_paths_is_salted(spark, monkeypatch):
    seen = []
    salted = change.salted_join
    monkeypatch.setattr(change, "salted_join", lambda *a, **k: seen.append(a[2]) or salted(*a, **k))
    test_cluster_timeline_spreads_its_one_target(spark)
    assert seen == [["capture_id", "target"]]
