"""Landing sink with sequence numbers continued from kept counters, and the change feed that follows what has landed.

A landed table is a folder: ``batch=N`` holds the records of one micro-batch, ``_late/batch=N`` those that came too late,
``_next/batch=N`` the counters after it. A counter is the next number of a path and its newest time. Every
``FULL_EVERY``-th batch keeps the counters of all paths, the others those of the paths they touched, so a batch reads one
full table and at most ``FULL_EVERY - 1`` small ones, and never the records landed before.

The counters are written last. A batch counts as landed once they are complete, and a retried batch that already has them
is left as it is; one that was cut off before is written again with the same numbers. Readers of the feed
therefore see every batch once.

The version of a list is ``RV_BASE`` plus the number of its records so far; a record's ``rv`` is the version it leads to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from kubestrata.functions.scalars import at_literal
from kubestrata.operators.change import RV_BASE
from kubestrata.operators.timetravel import reconstruct_at, with_identity
from kubestrata.sources.records import KEYS, with_seq

FULL_EVERY = 16
COUNTER_DDL = "capture_id string, path string, next bigint, newest timestamp_ntz"
FEED_DDL = ("capture_id string, path string, seq bigint, captured_at timestamp_ntz, event_type string, response_code int, body string")


def _files(target: str):
    """(file system, path) of a folder, for local paths and for the URIs that Arrow opens."""
    from pyarrow import fs

    if target.startswith("file:"):
        target = "/" + target[5:].lstrip("/")
    return fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), target)


def _exists(target: str, below: str) -> bool:
    from pyarrow import fs

    system, root = _files(target)
    return system.get_file_info(f"{root}/{below}").type == fs.FileType.File


def _landed(target: str, batch: int) -> bool:
    return _exists(target, f"_next/batch={batch}/_SUCCESS")


def landed_batches(target: str) -> list[int]:
    """Numbers of the batches that have landed whole and are still kept, ascending."""
    from pyarrow import fs

    system, root = _files(target)
    found = system.get_file_info(fs.FileSelector(f"{root}/_next", allow_not_found=True))
    numbers = sorted(int(f.base_name[6:]) for f in found if f.base_name.startswith("batch="))
    return [n for n in numbers if _landed(target, n)]


def counters(spark: SparkSession, target: str, before: int) -> DataFrame:
    """(capture_id, path, next, newest) of every path before batch ``before``."""
    full = (before - 1) // FULL_EVERY * FULL_EVERY
    folders = [f"{target}/_next/batch={n}" for n in range(full, before)]
    rows = spark.read.schema(COUNTER_DDL).parquet(*folders) if before > 0 else spark.createDataFrame([], COUNTER_DDL)
    return rows.groupBy(*KEYS).agg(F.max("next").alias("next"), F.max("newest").alias("newest"))


def land_batch(target: str, delay: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: appends a micro-batch with seq continued per path; exactly once, retries included.

    With ``delay`` (an interval such as "10 minutes"), records that much older than the newest record of their path in
    earlier batches go to ``_late`` and take no number. Column ``event_time`` is dropped, all others are kept.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if _landed(target, batch_id):
            return
        spark = batch.sparkSession
        known = counters(spark, target, batch_id).withColumnsRenamed({"next": "_next", "newest": "_newest"})
        rows = batch.drop("event_time").join(known, KEYS, "left")
        if delay is not None:
            late = F.coalesce(F.col("captured_at") < F.col("_newest") - F.expr(f"INTERVAL {delay}"), F.lit(False))
            rows.filter(late).drop("_next", "_newest").write.mode("overwrite").parquet(f"{target}/_late/batch={batch_id}")
            rows = rows.filter(~late)
        numbered = with_seq(rows).withColumn("seq", F.col("seq") + F.coalesce("_next", F.lit(0))).drop("_next", "_newest")
        numbered.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        now = spark.read.schema("capture_id string, path string, seq bigint, captured_at timestamp_ntz").parquet(f"{target}/batch={batch_id}")
        after = now.groupBy(*KEYS).agg((F.max("seq") + 1).alias("next"), F.max("captured_at").alias("newest"))
        if batch_id % FULL_EVERY == 0:
            after = counters(spark, target, batch_id).unionByName(after).groupBy(*KEYS).agg(
                F.max("next").alias("next"), F.max("newest").alias("newest"))
        after.write.mode("overwrite").parquet(f"{target}/_next/batch={batch_id}")

    return write


def read_landed(spark: SparkSession, target: str, columns: str = FEED_DDL) -> DataFrame:
    """Records of the batches that have landed whole."""
    folders = [f"{target}/batch={n}" for n in landed_batches(target)]
    return spark.read.schema(columns).parquet(*folders) if folders else spark.createDataFrame([], columns)


# -------------------------------------------------------------- change feed

class _BatchFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _FeedReader(DataSourceStreamReader):
    """Offsets are numbers of landed batches; a partition is one of their Parquet files."""

    def __init__(self, target: str, schema, first: int | None):
        self.target, self.names, self.schema, self.first, self.end = target, schema.names, schema, first, None

    def initialOffset(self) -> dict:
        if self.first is not None:
            return {"batch": self.first}
        return {"batch": min(landed_batches(self.target), default=0)}

    def latestOffset(self) -> dict:
        if self.end is None:
            self.end = max(landed_batches(self.target), default=self.initialOffset()["batch"] - 1) + 1
        while _landed(self.target, self.end):
            self.end += 1
        return {"batch": self.end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _files(self.target)
        parts: list[InputPartition] = []
        for n in range(start["batch"], end["batch"]):
            if not _landed(self.target, n):
                raise ValueError(f"expired: batch {n} is no longer kept, list again")
            found = system.get_file_info(fs.FileSelector(f"{root}/batch={n}"))
            parts += [_BatchFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".parquet")]
        return parts

    def read(self, partition: _BatchFile) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = _files(self.target)
        arrow = to_arrow_schema(self.schema)
        with system.open_input_file(partition.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(1024, columns=self.names):
                yield pa.RecordBatch.from_arrays([batch.column(n).cast(arrow.field(n).type) for n in self.names], schema=arrow)


class ChangeFeed(DataSource):
    """Streaming source ``change_feed`` over a landed table. Options: ``path``, and ``first``, the batch to begin with."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return FEED_DDL

    def streamReader(self, schema) -> _FeedReader:
        first = self.options.get("first")
        return _FeedReader(self.options["path"], schema, None if first is None else int(first))


def feed(spark: SparkSession, target: str, first: int | None = None) -> DataFrame:
    """Stream of all landed records with ``rv``; a query that stops and restarts neither loses nor repeats one.

    A restart from batches that are no longer kept fails with "expired". Needs a path that Arrow can open.
    """
    spark.dataSource.register(ChangeFeed)
    reader = spark.readStream.format("change_feed").option("path", target)
    rows = (reader if first is None else reader.option("first", str(first))).load()
    return rows.withColumn("rv", F.col("seq") + RV_BASE + 1)


def versions(spark: SparkSession, target: str) -> DataFrame:
    """(capture_id, path, rv): the version every landed list has now, from the counters alone."""
    return counters(spark, target, max(landed_batches(target), default=-1) + 1).select(*KEYS, (F.col("next") + RV_BASE).alias("rv"))


def follow(spark: SparkSession, target: str, since: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stream of the events after the versions in ``since``, expired lists): a watch that goes on from a version.

    ``since`` (capture_id, path, rv) is one row a list. A version that its list does not hold is expired: below
    ``RV_BASE``, or beyond the newest. Such a list gives no stream rows but one row (capture_id, path, rv, newest).
    """
    asked = since.select(*KEYS, F.col("rv").alias("since"))
    newest = versions(spark, target).withColumnRenamed("rv", "newest")
    checked = asked.join(newest, KEYS, "left").withColumn("newest", F.coalesce("newest", F.lit(RV_BASE)))
    good = F.col("since").between(RV_BASE, F.col("newest"))
    held = checked.filter(good).select(*KEYS, "since")
    rows = feed(spark, target).filter("event_type IS NOT NULL").join(held, KEYS).filter(F.col("rv") > F.col("since")).drop("since")
    return rows, checked.filter(~F.coalesce(good, F.lit(False))).select(*KEYS, F.col("since").alias("rv"), "newest")


def list_then_follow(spark: SparkSession, target: str, at, path: str) -> tuple[DataFrame, DataFrame]:
    """(the list at T as ADDED rows with its version, stream of every event the list does not hold).

    The list holds the records landed so far of times up to T. The stream is the rest: later times, and whatever lands
    after the list was taken, of T itself or before it too.
    """
    done = landed_batches(target)
    here = read_landed(spark, target).filter(F.col("path") == path)
    seen = counters(spark, target, max(done, default=-1) + 1).filter(F.col("path") == path).select(*KEYS, "next")
    state = reconstruct_at(here, at).select(*KEYS, "object_key", "obj")
    now = state.join(seen, KEYS).select(*KEYS, F.lit("ADDED").alias("event_type"), (F.col("next") + RV_BASE).alias("rv"), "object_key", "obj")
    rows = feed(spark, target).filter((F.col("path") == path) & F.col("event_type").isNotNull()).join(seen, KEYS, "left")
    told = (F.col("seq") < F.coalesce("next", F.lit(0))) & (F.col("captured_at") <= at_literal(at))
    later = with_identity(rows.filter(~F.coalesce(told, F.lit(False))).withColumnRenamed("body", "obj"))
    return now, later.select(*KEYS, "event_type", "rv", "object_key", "obj", "captured_at", "seq")
