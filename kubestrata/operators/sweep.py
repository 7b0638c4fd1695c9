"""Object counts at every instant of a time axis in one pass, by sweep line.

An object's life becomes +1 where it begins and -1 where it ends. A snapshot of a path ends all lives on it and begins those
of its items, so lives are worked out within one epoch, the time from a snapshot to the next one of its path, and epochs
need nothing of each other. In an epoch only the events that turn an object's state count. The deltas of all paths of a namespace and
resource are added up per axis instant, and running sums over the instants are the counts: equal to reconstructing the
state at each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kubestrata.functions.ordered import filled, running_sums, salted_join, shifted
from kubestrata.functions.paths import with_path_cols
from kubestrata.operators.timetravel import event_objects, explode_items, in_scope

KEYS = ["capture_id", "path"]


def epochs(records: DataFrame) -> DataFrame:
    """Snapshots as epochs: capture_id, path, epoch (the snapshot's seq), begins, ends (null: never), response_code."""
    snaps = records.filter("event_type IS NULL").select(*KEYS, "seq", "captured_at", "response_code")
    nxt = shifted(snaps, KEYS, "seq", {"ends": F.col("captured_at")}, forward=True)
    return nxt.select(*KEYS, F.col("seq").alias("epoch"), F.col("captured_at").alias("begins"), "ends", "response_code")


def deltas(records: DataFrame, resources: list[str] | None = None) -> DataFrame:
    """capture_id, path, captured_at, delta: by how much the number of objects on a path changes at a time.

    Paths with events count different, named objects; others count list items as they are, as a reconstruction does.
    """
    rows = in_scope(records, resources)
    narrow = rows.select(*KEYS, "seq", "captured_at", "event_type", "response_code")
    spans = epochs(narrow)
    watched = narrow.filter("event_type IS NOT NULL").select(*KEYS).distinct().withColumn("_w", F.lit(True))
    listed = explode_items(rows.filter("event_type IS NULL AND response_code = 200").select(*KEYS, F.col("seq").alias("epoch"), "body"))
    items = salted_join(listed.select(*KEYS, "epoch", "pos", "object_key"), watched, KEYS, ["object_key", "pos"], "left")
    plain = items.filter("_w IS NULL").groupBy(*KEYS, "epoch").agg(F.count("*").alias("n"))
    named = items.filter("_w AND object_key <> ''").select(*KEYS, "epoch", "object_key").distinct()

    # the epoch of an event is that of the last snapshot before it on its path
    marks = narrow.withColumn("epoch", F.when(F.col("event_type").isNull(), F.struct(F.col("seq").alias("epoch"), F.col("captured_at").alias("begins"))))
    of_event = filled(marks.select(*KEYS, "seq", "event_type", "epoch"), KEYS, ["seq"], "epoch").filter("event_type IS NOT NULL").select(*KEYS, "seq", "epoch.*")
    seen = event_objects(rows.select(*KEYS, "seq", "captured_at", "event_type", "body")).filter("object_key <> '' AND captured_at IS NOT NULL")
    events = seen.select(*KEYS, "seq", "captured_at", "object_key", (F.col("event_type") != "DELETED").cast("int").alias("alive")).join(
        of_event, [*KEYS, "seq"]).filter("begins IS NULL OR captured_at > begins")  # a snapshot outweighs what has its own time

    # states of an object in an epoch: its place in the list first, then its events
    first = named.join(spans.select(*KEYS, "epoch", "begins"), [*KEYS, "epoch"]).select(
        *KEYS, "epoch", "object_key", F.lit(-1).cast("bigint").alias("seq"), F.col("begins").alias("captured_at"), F.lit(1).alias("alive"))
    states = first.unionByName(events.select(*KEYS, F.coalesce("epoch", F.lit(-1)).alias("epoch"), "object_key", "seq", "captured_at", "alive"))
    turns = shifted(states, [*KEYS, "epoch", "object_key"], "seq", {"was": F.col("alive")})
    turned = turns.select(*KEYS, "epoch", "captured_at", (F.col("alive") - F.coalesce("was", F.lit(0))).alias("delta")).filter("delta <> 0")
    counted = plain.join(spans.select(*KEYS, "epoch", "begins"), [*KEYS, "epoch"]).select(*KEYS, "epoch", F.col("begins").alias("captured_at"), F.col("n").alias("delta"))
    all_turns = turned.unionByName(counted).groupBy(*KEYS, "epoch", "captured_at").agg(F.sum("delta").alias("delta"))

    # where an epoch ends, all that it still holds ends
    before_first = spans.groupBy(*KEYS).agg(F.min_by("begins", "epoch").alias("ends")).withColumn("epoch", F.lit(-1).cast("bigint"))
    ends = spans.select(*KEYS, "epoch", "ends").unionByName(before_first.select(*KEYS, "epoch", "ends")).filter("ends IS NOT NULL")
    left = all_turns.groupBy(*KEYS, "epoch").agg(F.sum("delta").alias("left")).join(ends, [*KEYS, "epoch"])
    gone = left.select(*KEYS, F.col("ends").alias("captured_at"), (-F.col("left")).alias("delta"))
    return all_turns.select(*KEYS, "captured_at", "delta").unionByName(gone).groupBy(*KEYS, "captured_at").agg(F.sum("delta").alias("delta")).filter("delta <> 0")


def counts_over_axis(records: DataFrame, axis: DataFrame, resources: list[str] | None = None) -> DataFrame:
    """capture_id, captured_at, namespace, resource, objects at every instant of ``axis`` (capture_id, captured_at), zeros left out.

    Cluster-scoped paths have the namespace ''. A capture's axis is one array, so it should be a thinned one (``time_axis``).
    """
    series = ["capture_id", "namespace", "resource"]
    changes = with_path_cols(deltas(records, resources).filter(~F.col("path").contains("?"))).filter("resource <> ''")
    summed = changes.groupBy(*series, "captured_at").agg(F.sum("delta").alias("delta"))
    stops = axis.filter("captured_at IS NOT NULL").groupBy("capture_id").agg(F.array_sort(F.collect_set("captured_at")).alias("_axis"))
    at_stop = salted_join(summed, stops, ["capture_id"], ["namespace", "resource", "captured_at"]).select(
        *series, "_axis", F.size(F.filter("_axis", lambda t: t < F.col("captured_at"))).cast("bigint").alias("n"), "delta").filter(F.col("n") < F.size("_axis"))
    per_stop = at_stop.groupBy(*series, "n").agg(F.sum("delta").alias("delta"))
    totals = running_sums(per_stop, series, "n", "delta", "objects")
    until = shifted(totals, series, "n", {"until": F.col("n")}, forward=True)
    runs = salted_join(until.filter("objects > 0"), stops, ["capture_id"], ["namespace", "resource", "n"])
    last = F.coalesce(F.col("until"), F.size("_axis").cast("bigint")) - 1
    each = F.explode(F.slice("_axis", (F.col("n") + 1).cast("int"), (last - F.col("n") + 1).cast("int")))
    return runs.select("capture_id", each.alias("captured_at"), "namespace", "resource", "objects")
