"""States kept at chosen instants, and a state at any instant from the nearest kept one before it.

A reconstruction replays all records up to T. Here the replay is bounded: what is kept of an instant are the items of each
path's last list and, for each object, what its events since then come to; a read takes the latest kept instant up to
T and only the records after it. A list among those replaces all that was kept of its path. Deleted objects are kept
too, as an object that comes back has its old place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kubestrata.functions.ordered import salted_join
from kubestrata.functions.paths import with_path_cols
from kubestrata.functions.scalars import at_literal
from kubestrata.operators.timetravel import event_objects, explode_items, in_scope, latest_at, with_identity

KEYS = ["capture_id", "path"]
#: An entry: a list item (rank: its place) or the outcome of an object's events (rank: the last one's, first: the first that was no deletion).
ENTRY_DDL = "capture_id string, path string, object_key string, listed boolean, rank long, first long, event_type string, obj string"
_EVENT_OFFSET = 1 << 40  # events rank after every place of a list


def _micros(spark: SparkSession, at) -> int:
    return spark.range(1).select(F.unix_micros(at_literal(at).cast("timestamp"))).first()[0]


def _time(micros: int) -> Column:
    return F.timestamp_micros(F.lit(micros)).cast("timestamp_ntz")


def _between(records: DataFrame, since: int | None, until: int | None) -> DataFrame:
    """Records after ``since`` and up to ``until``; plain bounds on the time, which reach the scan."""
    rows = records if since is None else records.filter(F.col("captured_at") > _time(since))
    return rows if until is None else rows.filter(F.col("captured_at") <= _time(until))


def kept_instants(spark: SparkSession, folder: str) -> list[int]:
    """The kept instants in microseconds, ascending: one folder each."""
    return sorted(r["at"] for r in spark.read.schema(f"{ENTRY_DDL}, at long").parquet(f"{folder}/states").select("at").distinct().collect())


def _entries(rows: DataFrame, kept: DataFrame | None, since: int | None, until: int | None) -> DataFrame:
    """Entries at ``until`` from what was kept at ``since`` and the records between."""
    new = _between(rows, since, until)
    base = latest_at(new.select(*KEYS, "seq", "captured_at", "event_type", "response_code")).select(*KEYS, "response_code", F.col("captured_at").alias("_snap"))
    bodies = latest_at(new.select(*KEYS, "seq", "captured_at", "event_type", "response_code", "body")).filter("response_code = 200")
    rank = F.col("pos").cast("bigint")
    listed = explode_items(bodies.select(*KEYS, "body")).select(
        *KEYS, "object_key", F.lit(True).alias("listed"), rank.alias("rank"), rank.alias("first"), F.lit("ADDED").alias("event_type"), "obj")
    events = event_objects(new.select(*KEYS, "seq", "captured_at", "event_type", "body")).filter("object_key <> '' AND captured_at IS NOT NULL")
    after = salted_join(events, base.select(*KEYS, "_snap"), KEYS, ["object_key"], "left").filter("_snap IS NULL OR captured_at > _snap")
    at = F.col("seq") + _EVENT_OFFSET
    told = after.select(*KEYS, "object_key", at.alias("rank"), F.when(F.col("event_type") != "DELETED", at).alias("first"), "event_type", "obj")
    if kept is not None:
        still = salted_join(kept, base.select(*KEYS, F.lit(True).alias("_new")), KEYS, ["object_key"], "left").filter("_new IS NULL")
        listed = listed.unionByName(still.filter("listed").select(*listed.columns))
        told = told.unionByName(still.filter("NOT listed").select(*told.columns))
    last = told.groupBy(*KEYS, "object_key").agg(F.max_by(F.struct("rank", "event_type", "obj"), "rank").alias("_l"), F.min("first").alias("first"))
    outcome = last.select(*KEYS, "object_key", F.lit(False).alias("listed"), F.col("_l.rank").alias("rank"), "first",
                          F.col("_l.event_type").alias("event_type"), F.col("_l.obj").alias("obj"))
    return listed.unionByName(outcome)


def _kept(spark: SparkSession, folder: str, micros: int) -> DataFrame:
    return spark.read.schema(ENTRY_DDL).parquet(f"{folder}/states/at={micros}")


def keep_states(records: DataFrame, folder: str, instants: list) -> None:
    """Keep the states at ``instants``, each made from the one before it; later ones may be added to a folder that has some.

    The caller chooses instants so that the records between two of them are as many as a read may replay.
    """
    spark, rows = records.sparkSession, in_scope(records)
    try:
        done = kept_instants(spark, folder)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = []
    wanted = sorted({_micros(spark, at) for at in instants} - set(done))
    for at in wanted:
        before = max((d for d in done if d < at), default=None)
        entries = _entries(rows, None if before is None else _kept(spark, folder, before), before, at)
        entries.repartitionByRange(*KEYS, "object_key").sortWithinPartitions(*KEYS, "object_key").write.mode("overwrite").parquet(f"{folder}/states/at={at}")
        done.append(at)
    if wanted:  # which paths have events at all decides how their lists count
        rows.filter("event_type IS NOT NULL").select(*KEYS).distinct().write.mode("overwrite").parquet(f"{folder}/watched/to={max(done)}")


def state_from_kept(records: DataFrame, folder: str, at=None) -> DataFrame:
    """As ``timetravel.reconstruct_at``, replaying only the records after the latest kept instant up to ``at``."""
    spark, rows = records.sparkSession, in_scope(records)
    until = None if at is None else _micros(spark, at)
    done = kept_instants(spark, folder)
    before = max((d for d in done if until is None or d <= until), default=None)
    entries = _entries(rows, None if before is None else _kept(spark, folder, before), before, until)
    late = _between(rows, max(done, default=None), None).filter("event_type IS NOT NULL").select(*KEYS)
    watched = spark.read.schema("capture_id string, path string").parquet(f"{folder}/watched/to={max(done)}").unionByName(late).distinct()
    marked = salted_join(entries, watched.withColumn("_w", F.lit(True)), KEYS, ["object_key"], "left")
    # without events a list stays as it is, repeated or nameless items included
    key = F.when(F.col("_w").isNotNull(), F.col("object_key")).otherwise(F.concat("object_key", F.lit("\u0000"), F.col("rank")))
    folded = marked.filter("_w IS NULL OR object_key <> ''").groupBy(*KEYS, key.alias("_key")).agg(
        F.max_by(F.struct("event_type", "obj"), "rank").alias("_l"), F.min("first").alias("position"))
    alive = folded.filter("_l.event_type <> 'DELETED'").select(*KEYS, "position", F.col("_l.obj").alias("obj"))
    return with_path_cols(with_identity(alive))


def replayed(records: DataFrame, folder: str, at) -> DataFrame:
    """The records that ``state_from_kept`` replays for ``at``."""
    spark = records.sparkSession
    until = _micros(spark, at)
    return _between(in_scope(records), max((d for d in kept_instants(spark, folder) if d <= until), default=None), until)
