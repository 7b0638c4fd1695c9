"""Keyed overlay of changes over a captured base, and its change log."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GVR = ["group", "version", "resource"]
KEY = ["capture_id", *GVR, "obj_namespace", "name"]
#: Versions of one run of a log.
RUN = 4096


def merge_overlay(base: DataFrame, changes: DataFrame, key: list[str] = KEY, namespace: str = "") -> DataFrame:
    """Overlay objects replace, tombstones remove, new keys append. ``position`` keeps base order first."""
    scoped = changes if not namespace else changes.filter(F.col("obj_namespace") == namespace)
    over = scoped.select(*key, F.col("obj").alias("_new"), F.col("deleted").alias("_gone"), F.lit(True).alias("_owned"))
    merged = base.join(over, key, "full_outer").filter(~F.coalesce("_gone", F.lit(False)))
    return merged.withColumn("obj", F.when(F.col("_owned"), F.col("_new")).otherwise(F.col("obj"))).withColumn(
        "from_overlay", F.coalesce("_owned", F.lit(False))).drop("_new", "_gone", "_owned")


def compact(log: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Write log -> latest entry per key: rv, created_rv (0 for tombstones), deleted, obj.

    created_rv is the first write after the last delete. A key's log is cut into runs of neighbouring versions; a run
    knows its last delete, its first write and its first write after its last delete, and the key's birth follows
    from one row per run: no join with the log, and a busy object is as many tasks as it has runs. Bodies are picked
    afterwards, by key and version.
    """
    run = F.floor(F.col("rv") / RUN).alias("_run")
    deleted = F.max(F.when(F.col("deleted"), F.col("rv"))).alias("_gone")
    write = F.when(~F.col("deleted"), F.col("rv"))
    facts = log.select(*key, "rv", "deleted", run)
    last = facts.groupBy(*key, "_run").agg(deleted, F.max("rv").alias("rv"), F.min(write).alias("_first"), F.collect_list(write).alias("_writes"))
    after = F.array_min(F.filter("_writes", lambda w: w > F.coalesce("_gone", F.lit(-1))))
    later = Window.partitionBy(*key).orderBy(F.desc("_run")).rowsBetween(Window.unboundedPreceding, -1)  # one row per run
    runs = last.select(*key, "rv", F.when(F.max("_gone").over(later).isNull(), F.when(F.col("_gone").isNull(), F.col("_first")).otherwise(after)).alias("_birth"))
    heads = runs.groupBy(*key).agg(F.max("rv").alias("rv"), F.min("_birth").alias("created_rv"))
    return log.join(heads, [*key, "rv"]).select(
        *key, "rv", F.when(F.col("deleted"), F.lit(0)).otherwise(F.coalesce("created_rv", F.lit(0))).cast("bigint").alias("created_rv"),
        "deleted", "obj")


def changes_since(entries: DataFrame, rv: int, namespace: str = "") -> DataFrame:
    """Entries newer than ``rv`` classified DELETED / ADDED (created since) / MODIFIED."""
    rows = entries.filter(F.col("rv") > rv)
    if namespace:
        rows = rows.filter(F.col("obj_namespace") == namespace)
    kind = F.when(F.col("deleted"), "DELETED").when(F.col("created_rv") > rv, "ADDED").otherwise("MODIFIED")
    return rows.withColumn("event_type", kind)


def scope_rv(entries: DataFrame) -> DataFrame:
    """Newest version per capture and (group, version, resource, namespace)."""
    return entries.groupBy("capture_id", *GVR, "obj_namespace").agg(F.max("rv").alias("rv"))


def overlay_scopes(entries: DataFrame) -> DataFrame:
    """Live entries per scope: count and one sample object (of the smallest name)."""
    return entries.filter("NOT deleted").groupBy("capture_id", *GVR, "obj_namespace").agg(
        F.count("*").alias("objects"), F.min_by("obj", "name").alias("sample"))


def _deleted_namespaces(entries: DataFrame) -> DataFrame:
    return entries.filter("deleted AND `group` = '' AND version = 'v1' AND resource = 'namespaces'").select(
        F.col("capture_id").alias("_of"), F.col("name").alias("_gone")).distinct()


def drop_deleted_namespaces(objects: DataFrame, entries: DataFrame, namespace: str = "obj_namespace") -> DataFrame:
    """Objects (captured or overlay) without the contents of namespaces that were deleted in the same capture."""
    gone = _deleted_namespaces(entries)
    return objects.join(gone, (objects["capture_id"] == gone["_of"]) & (objects[namespace] == gone["_gone"]), "left_anti")


def cascade_tombstones(entries: DataFrame, next_rv: int) -> DataFrame:
    """Tombstones for live overlay entries of deleted namespaces, versions handed out from ``next_rv``."""
    from kubestrata.functions.ordered import ranked

    gone = _deleted_namespaces(entries)
    live = entries.filter("NOT deleted").join(gone, (F.col("capture_id") == F.col("_of")) & (F.col("obj_namespace") == F.col("_gone")), "left_semi")
    return ranked(live.drop("rv"), [], KEY, "rv").withColumn("rv", F.col("rv") + next_rv - 1).withColumn(
        "deleted", F.lit(True)).withColumn("created_rv", F.lit(0).cast("bigint"))


def suppress_owned(timeline: DataFrame, entries: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Timeline events whose identity is in the overlay, live or tombstone, are dropped; nameless ones stay."""
    named = entries.filter(F.col("name") != "").select(*key).distinct()
    return timeline.join(named, key, "left_anti")


def delete_collection(objects: DataFrame, rv: int) -> DataFrame:
    """One tombstone per named object of an already strictly filtered list (see select.filter_strict)."""
    return objects.filter("name <> ''").select(
        *KEY, F.lit(rv).cast("bigint").alias("rv"), F.lit(0).cast("bigint").alias("created_rv"),
        F.lit(True).alias("deleted"), "obj")


def fold_counts(counts: DataFrame, scopes: DataFrame, key: list[str]) -> DataFrame:
    """Index counts with zeros (or gaps) filled from overlay scopes; non-zero counts are left alone."""
    extra = scopes.groupBy(*key).agg(F.sum("objects").alias("_over")).filter("_over > 0")
    both = counts.join(extra, key, "full_outer")
    n = F.coalesce("objects", F.lit(0))
    return both.withColumn("objects", F.when(n == 0, F.coalesce("_over", F.lit(0))).otherwise(n)).drop("_over")


# -------------------------------------------------------------- merge patch

_SET = "\u0000set"  # marks a value that replaces whatever was there


def _compose(first, second):
    """One patch equal to applying ``first`` and then ``second`` (RFC 7396), nulls kept as deletions."""
    if not isinstance(second, dict):
        return {_SET: second}
    if isinstance(first, dict) and _SET in first:
        return {_SET: _apply(first[_SET], second)}
    if _SET in second:
        return second
    out = dict(first) if isinstance(first, dict) else {}
    for k, v in second.items():
        if v is None:
            out[k] = None
        elif not isinstance(v, dict):
            out[k] = v
        elif k not in out:
            out[k] = v
        else:
            prev = out[k]
            out[k] = _compose(prev if isinstance(prev, dict) else {_SET: prev}, v)
    return out


def _apply(target, patch):
    if not isinstance(patch, dict):
        return patch
    if _SET in patch:
        return patch[_SET]
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _apply(out.get(k), v)
    return out


def fold_patches(base: DataFrame, patches: DataFrame, key: list[str] = KEY, fan_in: int = 4096) -> DataFrame:
    """Ordered JSON merge patches per object applied on its base; status patches keep the base's spec.

    base     key, obj
    patches  key, rv, patch, optional subresource

    Patches compose, so they are folded in levels of at most ``fan_in`` neighbours in rv order; no level
    holds all patches of a busy object in one group.
    """
    own = F.col("patch")
    if "subresource" in patches.columns:
        own = F.when(F.col("subresource") == "status", put_without_spec("patch")).otherwise(own)
    level = patches.select(*key, F.col("rv").cast("bigint").alias("_n"), own.alias("patch"))
    top = level.agg(F.max("_n")).first()[0] or 0
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in level.schema)
    run = [*key, "_n"]

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows arrive sorted; one pending patch per run, also across batches."""
        now, folded = None, None
        for pdf in batches:
            done = []
            for ident, text in zip(pdf[run].itertuples(index=False, name=None), pdf["patch"]):
                patch = json.loads(text)
                if ident == now:
                    folded = _compose(folded, patch)
                    continue
                if now is not None:
                    done.append((*now, json.dumps(folded, ensure_ascii=False)))
                now, folded = ident, patch if isinstance(patch, dict) else {_SET: patch}
            yield pd.DataFrame(done, columns=[*run, "patch"])
        if now is not None:
            yield pd.DataFrame([(*now, json.dumps(folded, ensure_ascii=False))], columns=[*run, "patch"])

    while True:
        level = level.withColumn("_order", F.col("_n")).withColumn("_n", F.floor(F.col("_n") / fan_in))
        level = level.repartition(*run).sortWithinPartitions(*run, "_order").drop("_order").mapInPandas(squeeze, schema)
        top //= fan_in
        if top == 0:
            break
    joined = base.join(level.drop("_n"), key, "left")
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [o if p is None or p != p else json.dumps(_apply(json.loads(o), json.loads(p)), ensure_ascii=False)
                    for o, p in zip(pdf["obj"], pdf["patch"])]
            yield pdf.assign(obj=done).drop(columns="patch")

    return joined.select(*base.columns, "patch").mapInPandas(finish, out_schema)


def put_without_spec(col: str):
    """A patch without its spec, as a status write is applied."""
    kept = F.map_filter(F.from_json(F.col(col), "map<string,variant>"), lambda k, _v: k != "spec")
    return F.coalesce(F.to_json(kept), F.col(col))
