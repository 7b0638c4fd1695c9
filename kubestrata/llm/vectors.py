"""Vectors fit for search, and blocks of queries against blocks of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kubestrata.llm.store import staged


def usable(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """Distinct (vec_id long, v array<double>) that can take part: an id, no null or non-finite component, and the most
    common number of dimensions (of equally common ones the smallest)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    rows = staged(rows.distinct(), "vectors")
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def blocks(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def spread(rows: DataFrame, own: Column, other: Column, role: int, a: str, b: str) -> DataFrame:
    """Rows in their own block ``a``, once for each block ``b`` of the other side."""
    return rows.withColumn(a, own.cast("long")).withColumn(b, F.explode(F.sequence(F.lit(0).cast("long"), other.cast("long") - 1))).withColumn("role", F.lit(role))


def best(found: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The k first of each query, with ``rank`` from 1."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
