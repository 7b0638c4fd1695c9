"""Intermediate tables: written once into the shared folder and read back, so that a lost executor costs no rework."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kubestrata.session import shared_folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder (``spark.checkpoint.dir``)."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends here and later reads do no work twice."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(names: list[str]) -> list[Column]:
    """Columns of a caller under names of our own, so that no name of theirs meets one of ours."""
    return [F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(names)]


def plain(names: list[str]) -> list[str]:
    """The names that ``carried`` gave."""
    return [f"carried_{i}" for i in range(len(names))]


def restored(names: list[str]) -> list[Column]:
    """The caller's names again."""
    return [F.col(f"carried_{i}").alias(c) for i, c in enumerate(names)]


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """(_k, _t): a key that rows share only if doc_id and text are the same; null and empty texts are the same."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(F.col(doc_id), whole).alias("_k"), F.xxhash64(whole, F.lit("text")).alias("_t")]
