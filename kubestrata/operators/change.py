"""Change over time: diffs, transitions, timelines with versions."""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kubestrata.functions.ordered import ranked, salted_join, shifted
from kubestrata.functions.paths import list_path, with_path_cols
from kubestrata.functions.scalars import at_literal, canon_json, in_window
from kubestrata.operators.health import classify
from kubestrata.operators.select import put_fields
from kubestrata.operators.timetravel import explode_items, latest_at

KEYS = ["capture_id", "path"]
OBJECT = [*KEYS, "object_key"]


# --------------------------------------------------------------------- diff

def diff_tables(before: DataFrame, after: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Full outer comparison on ``keys``: rows whose JSON differs semantically, null where absent.

    The canonical text is built on both sides before the join, so the join filter is a plain comparison.
    """
    b = before.select(*keys, F.col(body).alias("before"), canon_json(body).alias("_b"))
    a = after.select(*keys, F.col(body).alias("after"), canon_json(body).alias("_a"))
    differs = ~F.coalesce("_b", F.lit("")).eqNullSafe(F.coalesce("_a", F.lit("")))
    return b.join(a, keys, "full_outer").filter(differs).drop("_a", "_b")


def snapshot(records: DataFrame, at=None) -> DataFrame:
    usable = records.filter(~F.col("path").contains("?as=Table"))
    return latest_at(usable.select(*KEYS, "seq", "captured_at", "event_type", "response_code", "body"), at).filter(
        "response_code = 200")


def path_filter(df: DataFrame, resource: str | None, namespace: str | None) -> DataFrame:
    out = with_path_cols(df)
    if resource:
        out = out.filter(F.col("resource") == resource)
    if namespace:
        out = out.filter(F.col("namespace") == namespace)
    return out.filter("resource <> ''") if resource or namespace else out


def diff_captures(before: DataFrame, after: DataFrame, resource: str | None = None, namespace: str | None = None,
                  before_at=None, after_at=None) -> DataFrame:
    """Paths whose latest 200 body differs between two captures (compared path by path), one in each record table.

    A table with several captures has no single latest body for a path: that is an error, found from capture_id alone.
    """
    for df in (before, after):
        least, most = df.filter(~F.col("path").contains("?as=Table")).agg(F.min("capture_id"), F.max("capture_id")).first()
        if least != most:
            raise ValueError("diff_captures takes one capture on either side")
    changed = diff_tables(snapshot(before, before_at), snapshot(after, after_at), ["path"])
    return path_filter(changed, resource, namespace)


def diff_times(records: DataFrame, t1, t2, resource: str | None = None, namespace: str | None = None) -> DataFrame:
    """The same capture at two instants; snapshots are compared, not reconstructed state."""
    if t1 is None or t2 is None:
        raise ValueError("both times are required")
    changed = diff_tables(snapshot(records, t1), snapshot(records, t2), KEYS)
    return path_filter(changed, resource, namespace)


def pretty(text: str | None) -> str:
    if not text:
        return "null\n"
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n"
    except ValueError:
        return text + "\n"


def as_yaml(text: str | None) -> str:
    import yaml

    try:
        return yaml.safe_dump(json.loads(text), sort_keys=True, allow_unicode=True, width=1 << 30)
    except (ValueError, TypeError):
        return text or ""


def line_diff(before: str, after: str, names=("before", "after"), dates=("", "")) -> list[str]:
    return list(difflib.unified_diff(before.splitlines(True), after.splitlines(True), *names, *dates, n=3))


_RED, _GREEN, _CYAN, _RESET = "\x1b[31m", "\x1b[32m", "\x1b[36m", "\x1b[0m"


def colorize(lines: list[str]) -> list[str]:
    tint = {"+": _GREEN, "-": _RED, "@": _CYAN}
    out = []
    for line in lines:
        color = _CYAN if line.startswith(("+++", "---", "@@")) else tint.get(line[:1] if line[:1] != "@" else "")
        out.append(f"{color}{line}{_RESET}" if color else line)
    return out


def diff_text(changes: DataFrame, color: bool = False) -> DataFrame:
    """Unified line diff (3 lines of context) of pretty JSON per changed row; runs on changed rows only."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema) + ", diff string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = []
            for r in pdf.itertuples():
                lines = line_diff(pretty(r.before), pretty(r.after), (f"before{r.path}", f"after{r.path}"))
                text.append("".join(colorize(lines) if color else lines))
            yield pdf.assign(diff=text)

    return changes.mapInPandas(run, schema)


def object_diff(before: DataFrame, after: DataFrame, name: str | None = None, dates=("", "")) -> DataFrame:
    """Objects at two times as YAML line diffs: (path, key, line_no, type add|del|ctx|hunk, text, flags)."""
    pick = lambda df: df if name is None else df.filter(F.col("name") == name)
    b = pick(before).select(*OBJECT, F.col("obj").alias("before"))
    a = pick(after).select(*OBJECT, F.col("obj").alias("after"))
    changed = b.join(a, OBJECT, "full_outer").filter(
        ~canon_json("before").eqNullSafe(canon_json("after")) | F.col("before").isNull() | F.col("after").isNull())
    kind = {"+": "add", "-": "del"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                for i, line in enumerate(line_diff(as_yaml(r.before), as_yaml(r.after), dates=dates)):
                    typ = "hunk" if line.startswith(("+++", "---", "@@")) else kind.get(line[:1], "ctx")
                    rows.append((r.capture_id, r.path, r.object_key, i, typ, line.rstrip("\n"),
                                 not r.before, not r.after))
            yield pd.DataFrame(rows, columns=["capture_id", "path", "object_key", "line_no", "type", "text",
                                              "before_missing", "after_missing"])

    return changed.mapInPandas(
        run, "capture_id string, path string, object_key string, line_no int, type string, text string, "
             "before_missing boolean, after_missing boolean")


# -------------------------------------------------------------- transitions

def transitions_watch(events: DataFrame, since=None, until=None, name: str | None = None,
                      chunk: Column | None = None) -> DataFrame:
    """Change events with the body before and after.

    ``before`` is the previous body of the same object in the event stream (not in a snapshot), forgotten
    after DELETED and never set for nameless events. State runs over all rows; filters apply afterwards.
    """
    seen = events if until is None else events.filter(F.col("captured_at") <= at_literal(until))
    prev = shifted(seen, OBJECT, "seq", {"_type": F.col("event_type"), "_obj": F.col("obj")}, chunk)
    known = (F.col("_type") != "DELETED") & (F.col("object_key") != "") & (F.col("event_type") != "ADDED")
    out = (
        prev.withColumn("before", F.when(known, F.col("_obj")))
        .withColumn("after", F.when(F.col("event_type") != "DELETED", F.col("obj")))
        .drop("_type", "_obj", "obj")
        .filter(in_window("captured_at", since, until))
    )
    return out if name is None else out.filter(F.col("name") == name)


def transitions_poll(snapshots: DataFrame, items: DataFrame, since=None, until=None, name: str | None = None,
                     chunk: Column | None = None) -> DataFrame:
    """Changes between consecutive list snapshots of a path.

    snapshots  capture_id, path, seq, captured_at, is_list: one narrow row per snapshot
    items      capture_id, path, seq, pos, object_key, name, obj

    A non-list body interrupts the comparison: neither it nor the list after it emits anything. The join key
    (path, step, object) has one row per side, so no key is hot.
    """
    index = snapshots.select(*KEYS, "seq", "captured_at", F.col("is_list"))
    pairs = shifted(index, KEYS, "seq", {"_prev": F.col("seq"), "_prev_list": F.col("is_list")}, chunk).filter(
        "is_list AND _prev_list").filter(in_window("captured_at", since, until))
    named = items.filter("object_key <> ''").select(*KEYS, "seq", "object_key", "name", "pos", "obj")
    if name is not None:
        named = named.filter(F.col("name") == name)
    step = [*KEYS, "_step", "captured_at", "object_key"]
    curr = named.join(pairs.select(*KEYS, "seq", "captured_at"), [*KEYS, "seq"]).withColumnRenamed("seq", "_step").select(
        *step, F.col("name").alias("_cn"), F.col("pos").alias("_cp"), F.col("obj").alias("after"))
    prev = named.join(
        pairs.select(*KEYS, F.col("_prev").alias("seq"), F.col("seq").alias("_step"), "captured_at"), [*KEYS, "seq"]
    ).select(*step, F.col("name").alias("_pn"), F.col("pos").alias("_pp"), F.col("obj").alias("before"))
    both = curr.join(prev, step, "full_outer")
    kind = (
        F.when(F.col("before").isNull(), "ADDED").when(F.col("after").isNull(), "DELETED")
        .when((F.col("before") != F.col("after")) & (canon_json("before") != canon_json("after")), "MODIFIED")
    )
    return both.withColumn("event_type", kind).filter("event_type IS NOT NULL").select(
        *KEYS, F.col("_step").alias("seq"), "captured_at", "event_type", "object_key",
        F.coalesce("_cn", "_pn").alias("name"), F.coalesce("_cp", "_pp").alias("pos"), "before", "after")


def list_snapshots(records: DataFrame) -> DataFrame:
    """Narrow index of the snapshot records with ``is_list``."""
    snaps = records.filter("event_type IS NULL")
    is_list = F.get_json_object("body", "$.items").startswith("[")
    return snaps.select(*KEYS, "seq", "captured_at", F.coalesce(is_list, F.lit(False)).alias("is_list"))


def transition_report(records: DataFrame, events: DataFrame, resource: str | None = None, namespace: str | None = None,
                      name: str | None = None, since=None, until=None) -> DataFrame:
    """Per path its event transitions, or snapshot transitions where it has no events, ordered by time.

    The resource filter is a substring, namespace and name are exact; the namespace is the path's.
    Watch-only paths are not part of the report: like all report paths they must have a snapshot.
    """
    def scoped(df: DataFrame) -> DataFrame:
        rows = with_path_cols(df.filter(~F.col("path").contains("?"))).filter("resource <> ''")
        if resource:
            rows = rows.filter(F.col("resource").contains(resource))
        if namespace:
            rows = rows.filter(F.col("namespace") == namespace)
        return rows

    path_cols = ["group", "version", "resource", "namespace"]
    recs = scoped(records)
    polled = recs.filter("event_type IS NULL")
    watched = recs.filter("event_type IS NOT NULL").select(*KEYS).distinct()
    with_snapshot = polled.select(*KEYS).distinct()
    by_event = transitions_watch(scoped(events).join(with_snapshot, KEYS, "left_semi"), since, until, name)
    alone = polled.join(watched, KEYS, "left_anti").drop(*path_cols)
    by_poll = transitions_poll(list_snapshots(alone), explode_items(alone.select(*KEYS, "seq", "body")), since, until, name)
    cols = [*KEYS, "seq", "captured_at", "event_type", "object_key", "name", "before", "after"]
    merged = by_event.select(*cols, F.lit(0).alias("pos")).unionByName(by_poll.select(*cols, "pos"))
    return with_path_cols(merged).orderBy("captured_at", *KEYS, "seq", "pos", "object_key")


def recent(events: DataFrame, at=None, n: int | None = None) -> DataFrame:
    """The n newest events of each capture over all its paths; all of them without ``n``."""
    rows = events if at is None else events.filter(F.col("captured_at") <= at_literal(at))
    if n is None:
        return rows
    newest = F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("captured_at"), F.desc("path"), F.desc("seq")))
    return rows.withColumn("_newest", newest).filter(F.col("_newest") <= n).drop("_newest")


def object_history(events: DataFrame, path: str, name: str | None = None, at=None, n: int | None = None) -> DataFrame:
    """Events of one path, newest first; with a name also its first issue (else phase) as ``detail``."""
    rows = events.filter(F.col("path") == path)
    rows = rows if at is None else rows.filter(F.col("captured_at") <= at_literal(at))
    if name is None:
        out = rows.select(*KEYS, "seq", "captured_at", "event_type", F.lit(None).cast("string").alias("detail"))
    else:
        health = classify("obj")
        detail = F.coalesce(F.get(health["issues"], F.lit(0)), health["phase"])
        out = rows.filter(F.col("name") == name).select(*KEYS, "seq", "captured_at", "event_type", detail.alias("detail"))
    ordered = out.orderBy(F.desc("captured_at"), F.desc("seq"))
    return ordered if n is None else ordered.limit(n)


# ----------------------------------------------------------------- timeline

RV_BASE = 1


def timeline(events: DataFrame, polled: DataFrame | None = None, cluster: bool = False) -> DataFrame:
    """Versioned event timeline per target list: rv = 2, 3, … in (time, path, seq) order.

    Targets are the event paths themselves, or with ``cluster`` the cluster-wide list above the namespaced
    ones (an exact event path always wins over its children). ``polled`` adds snapshot transitions of paths
    without events. Numbering is a distributed sort, so one busy target is not one task.
    """
    cols = ["captured_at", "event_type", "seq", "pos", "name", "object_key"]
    ev = events.withColumn("pos", F.lit(0)).select(*KEYS, *cols)
    if polled is not None:
        watched = events.select(*KEYS).distinct()
        ev = ev.unionByName(polled.join(watched, KEYS, "left_anti").select(*KEYS, *cols))
    if cluster:
        gvr = ["_group", "_version", "_resource"]
        ev = with_path_cols(ev, strict=True, prefix="_")
        parent = F.when(F.col("_namespace") != "", list_path(*gvr)).otherwise(F.col("path"))
        ev = ev.withColumn("target", parent).drop(*gvr, "_namespace")
        exact = ev.filter("target = path").select("capture_id", "target").distinct().withColumn("_own", F.lit(True))
        # salted: the list above all namespaces may be the target of every row
        ev = salted_join(ev, exact, ["capture_id", "target"], ["path", "seq"], "left").filter(
            F.col("_own").isNull() | (F.col("target") == F.col("path"))).drop("_own")
    else:
        ev = ev.withColumn("target", F.col("path"))
    out = ranked(ev, ["capture_id", "target"], ["captured_at", "path", "seq", "pos", "object_key"], "rv")
    return out.withColumn("rv", F.col("rv") + RV_BASE)


def rv_as_of(events: DataFrame, instants: dict[str, object] | list, target: str = "path") -> DataFrame:
    """Version of each target at given instants: 1 + events up to then. One pass for all instants."""
    pairs = instants.items() if isinstance(instants, dict) else [(str(t), t) for t in instants]
    aggs = [(F.count_if(F.col("captured_at") <= at_literal(t)) + RV_BASE).alias(k) for k, t in pairs]
    return events.groupBy("capture_id", F.col(target).alias("target")).agg(*aggs)


def expired(rows: DataFrame, rv: int, floor: int = RV_BASE) -> DataFrame:
    """Targets whose timeline does not hold version ``rv``: capture_id, target, newest."""
    newest = rows.groupBy("capture_id", "target").agg(F.max("rv").alias("newest"))
    return newest.filter((F.lit(rv) < floor) | (F.lit(rv) > F.col("newest")))


def read_since(rows: DataFrame, rv: int, floor: int = RV_BASE, check: bool = True) -> DataFrame:
    """Timeline rows after version ``rv`` of each target.

    With ``check``, targets that do not hold the version give one row instead, of type EXPIRED, whose ``rv`` is the
    newest they hold: a reader of that target has to list again. The bound is each target's own.
    """
    later = rows.filter(F.col("rv") > rv)
    if not check:
        return later
    old = expired(rows, rv, floor).select("capture_id", "target", F.lit("EXPIRED").alias("event_type"), F.col("newest").alias("rv"))
    kept = later if floor <= rv else later.limit(0)
    return kept.unionByName(old, allowMissingColumns=True)


def stamp_version(obj, rv) -> Column:
    """The object with metadata.resourceVersion set."""
    obj = F.col(obj) if isinstance(obj, str) else obj
    rv = F.col(rv) if isinstance(rv, str) else rv
    text = F.parse_json(F.concat(F.lit('"'), rv.cast("string"), F.lit('"')))
    meta = put_fields(F.coalesce(F.get_json_object(obj, "$.metadata"), F.lit("{}")), {"resourceVersion": text})
    return F.coalesce(put_fields(obj, {"metadata": F.try_parse_json(meta)}), obj)


def list_then_tail(state: DataFrame, events: DataFrame, at, target_path: str) -> DataFrame:
    """State of one list at T as ADDED rows stamped with the list's version, then every later event."""
    ev = events.filter(F.col("path") == target_path)
    start = ev.filter(F.col("captured_at") <= at_literal(at)).groupBy("capture_id").agg(F.count("*").alias("_n"))
    now = state.filter(F.col("path") == target_path).join(start, "capture_id", "left").withColumn(
        "rv", F.coalesce("_n", F.lit(0)) + RV_BASE).select(*KEYS, F.lit("ADDED").alias("event_type"), "rv", "object_key", "obj")
    bodies = ev.select(*KEYS, "seq", "obj")
    later = timeline(ev).filter(F.col("captured_at") > at_literal(at)).join(bodies, [*KEYS, "seq"]).select(
        *KEYS, "event_type", "rv", "object_key", "obj")
    return now.unionByName(later).withColumn("obj", stamp_version("obj", "rv"))
