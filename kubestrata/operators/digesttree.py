"""Snapshots kept with a tree of digests, and a diff that opens only what differs.

Of an instant the last 200 body of each path is kept once, with the 128-bit digest of its canonical text (member order and
number form do not count). Order-free sums of (path, digest) stand for all paths of a resource, of a namespace in it,
and of a bucket of a namespace. Two snapshots are compared from the top: only branches whose sums differ are
descended into, then the digests of their paths are compared, and bodies are read for paths that differ.

Files are laid out by ``part``, a hash of the branch, so the open branches decide which files are read at all; digests are a
column of their own and are compared without the bodies. The driver sees the numbers of open parts (at most
``parts``), nothing else. A hot namespace is as many branches as it has buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kubestrata.functions.paths import with_path_cols
from kubestrata.functions.scalars import canon_json
from kubestrata.operators.change import path_filter, snapshot

BRANCH = ["resource", "namespace", "bucket"]
BUCKETS = 64
PARTS = 64
PATH_DDL = ("capture_id string, path string, resource string, namespace string, bucket int, digest string, body string, part int")
NODE_DDL = "capture_id string, resource string, namespace string, bucket int, part int, parts int, n bigint, high decimal(38,0), low decimal(38,0)"


def keep_snapshot(records: DataFrame, folder: str, at=None, parts: int = PARTS) -> None:
    """Keep the snapshot at ``at`` (unset: the last one) in ``folder``.

    ``parts``: about as many as there will be files. A null or empty body counts as no content: it is kept, and equals an absent path.
    """
    spark = records.sparkSession
    canon = canon_json("body")
    rows = with_path_cols(snapshot(records, at)).select(
        "capture_id", "path", *[F.coalesce(c, F.lit("")).alias(c) for c in ("resource", "namespace")],
        F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.when(F.coalesce(canon, F.lit("")) != "", F.md5(canon)).alias("digest"), "body")
    placed = rows.withColumn("part", F.pmod(F.xxhash64(*BRANCH), F.lit(parts)).cast("int"))
    placed.repartitionByRange("part", "path").sortWithinPartitions("part", "path").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/paths")
    term = lambda seed: F.sum(F.xxhash64(F.lit(seed), "path", "digest").cast("decimal(20,0)")).cast("decimal(38,0)")
    nodes = _paths(spark, folder).filter("digest IS NOT NULL").groupBy("capture_id", *BRANCH, "part").agg(
        F.lit(parts).alias("parts"), F.count("*").alias("n"), term(1).alias("high"), term(2).alias("low"))
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PATH_DDL).parquet(f"{folder}/paths")


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(NODE_DDL).parquet(f"{folder}/nodes")


def _one_capture(nodes: DataFrame) -> int | None:
    facts = nodes.agg(F.min("capture_id"), F.max("capture_id"), F.max("parts")).first()
    if facts[0] != facts[1]:
        raise ValueError("a diff of two captures takes one capture on either side")
    return facts[2]


def _full(b: DataFrame, a: DataFrame, keys: list[str], unequal: Column) -> DataFrame:
    return b.join(a, keys, "full_outer").filter(unequal)


def _unequal(columns: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")) for c in columns])


def open_branches(spark: SparkSession, before: str, after: str, by_capture: bool = False) -> DataFrame:
    """Lowest branches whose sums differ: (capture_id if ``by_capture``, resource, namespace, bucket, part)."""
    head = ["capture_id"] if by_capture else []
    sides = {"b": _nodes(spark, before), "a": _nodes(spark, after)}
    sums, above, found = ["n", "high", "low"], None, None
    for depth in range(1, len(BRANCH) + 1):
        keys = [*head, *BRANCH[:depth]]
        level = {}
        for side, nodes in sides.items():
            inside = nodes if found is None else nodes.join(found, above, "left_semi")
            part = [F.max("part").alias(f"{side}_part")] if depth == len(BRANCH) else []
            level[side] = inside.groupBy(*keys).agg(*[F.sum(c).alias(f"{side}_{c}") for c in sums], *part)
        found, above = _full(level["b"], level["a"], keys, _unequal(sums)), keys
    return found.select(*above, F.coalesce("b_part", "a_part").alias("part"))


def diff_kept(spark: SparkSession, before: str, after: str, resource: str | None = None, namespace: str | None = None,
              by_capture: bool = False) -> DataFrame:
    """As ``change.diff_captures`` (with ``by_capture``: ``diff_times``) between two kept snapshots.

    Runs one small job at once, which finds the parts that have open branches.
    """
    nb, na = _nodes(spark, before), _nodes(spark, after)
    if by_capture:
        kinds = [d.agg(F.max("parts")).first()[0] for d in (nb, na)]
    else:
        kinds = [_one_capture(nb), _one_capture(na)]
    if None not in kinds and kinds[0] != kinds[1]:
        raise ValueError(f"snapshots kept in {kinds[0]} and {kinds[1]} parts do not compare")
    branches = open_branches(spark, before, after, by_capture)
    parts = [r["part"] for r in branches.select("part").distinct().collect()]
    keys = ["capture_id", "path"] if by_capture else ["path"]
    near = {s: _paths(spark, f).filter(F.col("part").isin(parts)) for s, f in (("b", before), ("a", after))}
    digests = {s: d.filter("digest IS NOT NULL").select(*keys, F.col("digest").alias(f"{s}_digest")) for s, d in near.items()}
    changed = _full(digests["b"], digests["a"], keys, _unequal(["digest"])).select(*keys)
    bodies = [near[s].select(*keys, F.col("body").alias(n)) for s, n in (("b", "before"), ("a", "after"))]
    rows = changed.join(bodies[0], keys, "left").join(bodies[1], keys, "left")
    return path_filter(rows.select(*keys, "before", "after"), resource, namespace)
