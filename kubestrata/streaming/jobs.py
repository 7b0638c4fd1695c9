"""Structured Streaming forms: landing with sequence numbers, duplicate suppression, transitions, emptied
namespaces, activity counts, list then tail.

Event time is ``event_time`` (captured_at as TIMESTAMP) and carries the watermark. State of the processors stays until
a time to live is given. Late rows: see ``split_late``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kubestrata.functions.scalars import at_literal
from kubestrata.operators.timetravel import with_identity
from kubestrata.streaming.landing import land_batch  # noqa: F401 - the sink belongs to these jobs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> SparkSession:
    """The state store that the stateful operators here need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


# ---------------------------------------------------------------- late rows

def split_late(batch: DataFrame, newest_seen, delay: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a micro-batch against the newest event time of earlier batches."""
    limit = at_literal(newest_seen) - F.expr(f"INTERVAL {delay}")
    late = F.col("captured_at") < limit
    return batch.filter(~late), batch.filter(late)


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """One key's rows of one micro-batch in event order.

    Arrow chunks of a key come in no particular order, so they are sorted together. What is held is one key's
    share of one micro-batch, which the source's rate limit (maxFilesPerTrigger and the like) bounds.
    """
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


# ----------------------------------------------------------- duplicate runs

class _DropRepeats(StatefulProcessor):
    """Keeps a record whose body hash differs from the one before it on its path."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        prev = self.last.get()[0] if self.last.exists() else None
        pdf = _in_order(rows, ["captured_at", "record_id"])
        keep = pdf["body_hash"].ne(pdf["body_hash"].shift(fill_value=prev if prev is not None else ""))
        if prev is None:
            keep.iloc[0] = True
        self.last.update((pdf["body_hash"].iloc[-1],))
        yield pdf[keep]

    def close(self) -> None:
        pass


def dedup_stream(records: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming duplicate suppression; only the hash of the last record per path is state."""
    cols = ["capture_id", "path", "record_id", "captured_at", "event_type", "response_code", "body", "body_hash"]
    rows = records.withColumn("body_hash", F.sha2("body", 256)).select(*cols)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("capture_id", "path").transformWithStateInPandas(
        _DropRepeats(ttl_ms), outputStructType=schema, outputMode="append", timeMode="processingTime" if ttl_ms else "none")


# -------------------------------------------------------------- transitions

class _Transitions(StatefulProcessor):
    """Remembers the last body of one object; forgets it after DELETED."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "obj string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        prev = self.last.get()[0] if self.last.exists() else None
        pdf = _in_order(rows, ["captured_at", "record_id"])
        before, after = [], []
        for kind, obj in zip(pdf["event_type"], pdf["obj"]):
            before.append(None if kind == "ADDED" else prev)
            after.append(None if kind == "DELETED" else obj)
            prev = after[-1] if key[-1] != "" else None
        yield pdf.drop(columns="obj").assign(before=before, after=after)
        if prev is None:
            self.last.clear()
        else:
            self.last.update((prev,))

    def close(self) -> None:
        pass


def transitions_stream(records: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Transitions as change events arrive. State is one body per live object and is keyed by object, so a
    busy path spreads over tasks."""
    ev = with_identity(records.filter("event_type IS NOT NULL").withColumnRenamed("body", "obj"))
    rows = ev.select("capture_id", "path", "object_key", "name", "record_id", "captured_at", "event_type", "obj")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "obj"]
    return rows.groupBy("capture_id", "path", "object_key").transformWithStateInPandas(
        _Transitions(ttl_ms), outputStructType=", ".join([*fields, "before string", "after string"]), outputMode="append",
        timeMode="processingTime" if ttl_ms else "none")


# -------------------------------------------------------- emptied namespaces

class _Emptied(StatefulProcessor):
    """Namespaces seen so far on one cluster-wide path; emits those missing from a poll."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "namespace string", "first timestamp_ntz")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0] for k in self.seen.keys()}
        for poll in _in_order(rows, ["captured_at"]).itertuples():
            now = set(poll.namespaces) if poll.namespaces is not None else set()
            gone = sorted(known - now)
            if gone:
                yield pd.DataFrame({"capture_id": key[0], "path": key[1], "captured_at": poll.captured_at, "namespace": gone})
            for ns in now - known:
                self.seen.updateValue((ns,), (poll.captured_at.to_pydatetime(),))
            known |= now

    def close(self) -> None:
        pass


def emptied_stream(records: DataFrame) -> DataFrame:
    """(path, poll time, namespace) for namespaces that vanished; one list body is one input row."""
    spaces = F.array_distinct(F.filter(F.transform(
        F.from_json(F.get_json_object("body", "$.items"), "array<struct<metadata: struct<namespace: string>>>"),
        lambda i: i["metadata"]["namespace"]), lambda n: n.isNotNull() & (n != "")))
    polls = records.filter("event_type IS NULL").select("capture_id", "path", "captured_at", spaces.alias("namespaces"))
    return polls.groupBy("capture_id", "path").transformWithStateInPandas(
        _Emptied(), outputStructType="capture_id string, path string, captured_at timestamp_ntz, namespace string",
        outputMode="append", timeMode="none")


# ----------------------------------------------------------------- activity

def activity_stream(events: DataFrame, step: str = "1 hour") -> DataFrame:
    """Tumbling-window counts: total, warn (MODIFIED pods), bad (DELETED pods). Update or append output."""
    pod = F.col("path").contains("/pods")
    return events.groupBy("capture_id", F.window("event_time", step)).agg(
        F.count("*").alias("total"), F.count_if(pod & (F.col("event_type") == "MODIFIED")).alias("warn"),
        F.count_if(pod & (F.col("event_type") == "DELETED")).alias("bad"),
    ).select("capture_id", F.col("window.start").alias("bucket_start"), "total", "warn", "bad")


def list_then_tail_stream(state: DataFrame, records: DataFrame, at, path: str) -> tuple[DataFrame, DataFrame]:
    """(batch of the list at T as ADDED rows, stream of every later change of that list)."""
    now = state.filter(F.col("path") == path).select("path", F.lit("ADDED").alias("event_type"), "object_key", "obj")
    tail = records.filter((F.col("path") == path) & F.col("event_type").isNotNull() & (F.col("captured_at") > at_literal(at)))
    later = with_identity(tail.withColumnRenamed("body", "obj")).select("path", "event_type", "object_key", "obj", "captured_at")
    return now, later
