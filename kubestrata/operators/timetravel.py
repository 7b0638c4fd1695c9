"""State at an instant: latest snapshot, reconstruction from snapshot plus events, counts, merged lists.

Order inside a path is ``seq`` (arrival order; times never run backwards along it). All aggregates combine
on the map side, so a path or object holding most of the rows does not collect in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kubestrata.functions.ordered import filled, ranked, salted_join
from kubestrata.functions.paths import child_match, is_log_path, kind_of, list_path, with_path_cols
from kubestrata.functions.scalars import at_literal, blank, first_non_empty, meta_of
from kubestrata.schema import LIST_DDL, SHORT_NAMES, TABLE_DDL

KEYS = ["capture_id", "path"]
_EVENT_OFFSET = 1 << 40  # events rank after every position of a base list


def _until(df: DataFrame, at) -> DataFrame:
    return df if at is None else df.filter(F.col("captured_at") <= at_literal(at))


def latest_at(records: DataFrame, at=None, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """Last snapshot record per path at or before ``at`` (unset: the last one); any response code counts."""
    snaps = records.filter(F.col("event_type").isNull()) if "event_type" in records.columns else records
    rest = [c for c in snaps.columns if c not in keys]
    seen = _until(snaps, at)
    # narrow, fixed-width columns find the newest row; only then are bodies read
    newest = seen.groupBy(*keys).agg(F.max(order).alias(order))
    return seen.join(newest, [*keys, order], "left_semi").select(*keys, *rest)


snapshot_at = latest_at  # the snapshot's own time stays in captured_at


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
               right_order: str, values: list[str]) -> DataFrame:
    """Per left row: ``values`` of the last right row of the same key at or before its time (null if none).

    Both sides are laid out together in (key, time) order and filled forward over range-partitioned blocks,
    so neither a hot key nor a burst in time ends up in one task.
    """
    payload = F.struct(*[F.col(v) for v in values])
    r = right.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"),
                     F.col(right_order).cast("bigint").alias("_o"), payload.alias("_v"))
    l_ = left.select("*", F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"),
                     F.lit(0).cast("bigint").alias("_o"))
    rows = filled(l_.unionByName(r, allowMissingColumns=True), ["_k"], ["_t", "_side", "_o"], "_v").filter("_side = 1")
    return rows.select(*left.columns, *[F.col("_v")[v].alias(v) for v in values])


# --------------------------------------------------------------- objects

def explode_items(records: DataFrame) -> DataFrame:
    """List bodies -> one row per item; bodies without an items array give nothing."""
    keep = [c for c in records.columns if c != "body"]
    lst = records.select(*keep, F.from_json("body", LIST_DDL).alias("_l"))
    rows = lst.select(
        *keep, F.col("_l.apiVersion").alias("list_api_version"), F.col("_l.kind").alias("list_kind"),
        F.posexplode("_l.items").alias("pos", "obj"),
    )
    return with_identity(rows)


def with_identity(rows: DataFrame) -> DataFrame:
    """name, obj_namespace, uid, labels, object_key and decodable of the ``obj`` column, extracted once."""
    m = F.col("_m.metadata")
    ns, name = blank(m["namespace"]), blank(m["name"])
    return rows.withColumn("_m", meta_of("obj")).select(
        *rows.columns, name.alias("name"), ns.alias("obj_namespace"), blank(m["uid"]).alias("uid"),
        m["labels"].alias("labels"),
        F.when(ns != "", F.concat(ns, F.lit("/"), name)).otherwise(name).alias("object_key"),
        F.col("_m").isNotNull().alias("decodable"),
    )


def event_objects(records: DataFrame) -> DataFrame:
    """Watch event records as object rows."""
    ev = records.filter(F.col("event_type").isNotNull()).withColumnRenamed("body", "obj")
    return with_identity(ev)


def reconstruct(base: DataFrame, items: DataFrame, events: DataFrame, at=None,
                watched: DataFrame | None = None) -> DataFrame:
    """Objects alive at ``at``.

    base    latest snapshot per path: capture_id, path, captured_at, response_code (narrow, no bodies)
    items   its list items: capture_id, path, pos, object_key, obj
    events  change events: capture_id, path, seq, captured_at, event_type, object_key, obj
    watched paths that have events at any time; default: derived from ``events``

    Paths with events: 200 snapshots give the base, others an empty one, and their time still bounds which
    events apply. Paths without events: the snapshot's items as they are. ``position`` is the place of first
    appearance, which a deleted and re-added object keeps. The joins are salted and the aggregate shuffles on
    (path, object), so neither a busy path nor its joins are one task.
    """
    watched = (events if watched is None else watched).select(*KEYS).distinct()
    paths = base.select(*KEYS, "response_code", F.col("captured_at").alias("_snap")).join(
        watched.withColumn("_w", F.lit(True)), KEYS, "left")
    from_list = (
        salted_join(items, paths.filter("response_code = 200"), KEYS, ["object_key"])
        .filter(F.col("_w").isNull() | (F.col("object_key") != ""))
        .select(
            *KEYS,
            # without events the list stays as it is, repeated or nameless items included
            F.when(F.col("_w").isNotNull(), F.col("object_key")).otherwise(
                F.concat(F.col("object_key"), F.lit("\u0000"), F.col("pos"))).alias("_key"),
            F.col("pos").cast("bigint").alias("_rank"), F.lit("ADDED").alias("event_type"), "obj",
        )
    )
    in_range = _until(events, at).filter("object_key <> '' AND captured_at IS NOT NULL")
    from_events = (
        salted_join(in_range, paths.select(*KEYS, "_snap"), KEYS, ["object_key"], "left")
        .filter(F.col("_snap").isNull() | (F.col("captured_at") > F.col("_snap")))
        .select(*KEYS, F.col("object_key").alias("_key"), (F.col("seq") + _EVENT_OFFSET).alias("_rank"),
                "event_type", "obj")
    )
    alive = F.col("event_type") != "DELETED"
    folded = from_list.unionByName(from_events).groupBy(*KEYS, "_key").agg(
        F.max_by(F.struct("event_type", "obj"), "_rank").alias("_last"),
        F.min(F.when(alive, F.col("_rank"))).alias("position"),
    )
    return folded.filter("_last.event_type <> 'DELETED'").select(
        *KEYS, F.split_part("_key", F.lit("\u0000"), F.lit(1)).alias("object_key"), "position",
        F.col("_last.obj").alias("obj"),
    )


def in_scope(records: DataFrame, resources: list[str] | None = None) -> DataFrame:
    """Records that can hold objects, of the given resources.

    The stored ``resource`` column of the tables prunes partitions; without it the path is parsed.
    """
    rows = records.filter(~F.col("path").contains("?as=Table") & ~is_log_path("path"))
    if resources is None:
        return rows
    if "resource" not in rows.columns:
        rows = with_path_cols(rows, columns=["resource"])
    return rows.filter(F.col("resource").isin(list(resources)))


def single_objects(records: DataFrame, at=None, resources: list[str] | None = None) -> DataFrame:
    """Latest 200 bodies that are one object instead of a list, on paths without events; searched, not diagnosed."""
    rows = in_scope(records, resources).select(*KEYS, "seq", "captured_at", "event_type", "response_code", "body")
    watched = rows.filter("event_type IS NOT NULL").select(*KEYS).distinct()
    plain = F.get_json_object("body", "$.items").isNull() & F.try_parse_json("body").isNotNull()
    latest = latest_at(rows, at).filter("response_code = 200").filter(plain).join(watched, KEYS, "left_anti")
    one = latest.select(*KEYS, F.lit(0).cast("bigint").alias("position"), F.col("body").alias("obj"))
    return with_path_cols(with_identity(one)).filter("resource <> ''")


def reconstruct_at(records: DataFrame, at=None, resources: list[str] | None = None) -> DataFrame:
    """As ``reconstruct``, from a record table; rows carry the identity and path columns.

    ``resources`` narrows the scan itself; filtering the result would come after the whole reconstruction.
    """
    records = in_scope(records, resources)
    # bodies are read by one scan only; what bounds the events comes from narrow columns
    base = latest_at(records.select(*KEYS, "seq", "captured_at", "event_type", "response_code"), at)
    bodies = latest_at(records.select(*KEYS, "seq", "captured_at", "event_type", "body"), at)
    items = explode_items(bodies.select(*KEYS, "body"))
    events = event_objects(records.select(*KEYS, "seq", "captured_at", "event_type", "body"))
    watched = records.filter("event_type IS NOT NULL").select(*KEYS)
    state = reconstruct(base, items, events, at, watched)
    return with_path_cols(with_identity(state.drop("object_key")))


# ---------------------------------------------------------------- counts

def _counted(index: DataFrame, at) -> DataFrame:
    """item_count of the last snapshot per path, from index columns only (fixed-width hash aggregate)."""
    snaps = index.filter(F.col("event_type").isNull()) if "event_type" in index.columns else index
    return _until(snaps, at).filter(~F.col("path").contains("?")).groupBy(*KEYS).agg(
        F.max_by("item_count", "seq").alias("n")
    ).filter("n > 0")


def namespace_counts(index: DataFrame, at=None) -> DataFrame:
    """Objects per (namespace, resource) on strict namespaced list paths; bodies stay unread."""
    rows = with_path_cols(_counted(index, at), strict=True)
    return rows.filter("resource <> '' AND namespace <> ''").groupBy("capture_id", "namespace", "resource").agg(
        F.sum("n").alias("objects"))


def cluster_counts(index: DataFrame, at=None) -> DataFrame:
    """Objects per resource on paths without a namespace (loose parse)."""
    rows = with_path_cols(_counted(index, at))
    return rows.filter("resource <> '' AND namespace = ''").groupBy("capture_id", "resource").agg(F.sum("n").alias("objects"))


# ---------------------------------------------------------- merged lists

def first_per_key(rows: DataFrame, key: Column, order: list[str], scope: list[str] = ["capture_id"]) -> DataFrame:  # noqa: B006
    """First row per key in ``order``; an aggregate with a map-side combine, so many copies stay cheap."""
    cols = rows.columns
    picked = rows.withColumn("_key", key).groupBy(*scope, "_key").agg(
        F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return picked.select("_r.*")


def aggregate_namespaces(state: DataFrame, group: str, version: str, resource: str, cap: int | None = None) -> DataFrame:
    """All per-namespace lists of one resource as one list, first path wins per uid (else bare name).

    ``cap`` keeps the first rows in (path, position) order, as a report would; off by default.
    """
    rows = state.filter(child_match("path", group, version, resource))
    merged = first_per_key(rows, first_non_empty("uid", "name"), ["path", "position"])
    return merged if cap is None else merged.orderBy("path", "position").limit(cap)


def aggregate_tables(records: DataFrame, group: str, version: str, resource: str, at=None) -> DataFrame:
    """Per-namespace Table rows of one resource as one table; columns come from the first path."""
    base = F.substring_index("path", "?as=Table", 1)
    tables = records.filter(F.col("path").endswith("?as=Table") & child_match(base, group, version, resource))
    latest = latest_at(tables, at).filter("response_code = 200").select(
        *KEYS, F.from_json("body", TABLE_DDL).alias("t"))
    rows = latest.select(*KEYS, F.posexplode("t.rows").alias("position", "row"))
    obj = F.get_json_object("row", "$.object")
    ids = with_identity(rows.withColumn("obj", obj))
    merged = first_per_key(ids, first_non_empty("uid", "name"), ["path", "position"])
    heads = latest.groupBy("capture_id").agg(F.min_by(F.col("t.columnDefinitions"), "path").alias("column_definitions"))
    return salted_join(merged, heads, ["capture_id"], ["path", "name"])


def list_objects(state: DataFrame, group: str, version: str, resource: str, namespace: str = "",
                 name: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """List with the read fallback chain: the exact path; for a cluster path, its namespaces merged; for a
    namespace path that was not captured, the cluster list narrowed to it. ``source`` says which one answered.
    """
    rows = state.filter((F.col("group") == group) & (F.col("version") == version) & (F.col("resource") == resource))
    exact = rows.filter(F.col("namespace") == namespace).withColumn("source", F.lit("exact"))
    if namespace == "":
        other = aggregate_namespaces(rows, group, version, resource).withColumn("source", F.lit("merged namespaces"))
    else:
        other = rows.filter((F.col("namespace") == "") & (F.col("obj_namespace") == namespace)).withColumn(
            "source", F.lit("narrowed cluster list"))
    captured = (rows.filter(F.col("namespace") == namespace) if known is None else known.filter(
        F.col("path") == list_path(F.lit(group), F.lit(version), F.lit(resource), F.lit(namespace)))
    ).select("capture_id").distinct()
    out = exact.unionByName(other.join(captured, "capture_id", "left_anti"))
    return out if name is None else out.filter(F.col("name") == name)


# --------------------------------------------------------------- catalog

def resource_info(index: DataFrame, catalog: DataFrame) -> DataFrame:
    """Known resources: from paths and from discovery; discovery wins on kind, scope and short names."""
    seen = (
        with_path_cols(index.filter(~F.col("path").contains("?")).select("capture_id", "path").distinct(), strict=True)
        .filter("resource <> ''").groupBy("capture_id", "group", "version", "resource")
        .agg(F.bool_or(F.col("namespace") != "").alias("_ns"))
    )
    keys = ["capture_id", "group", "version", "resource"]
    short = F.create_map(*[F.lit(x) for kv in SHORT_NAMES.items() for x in kv])
    both = seen.join(catalog, keys, "full_outer")
    return both.select(
        *keys, first_non_empty("kind", kind_of("resource")).alias("kind"),
        F.coalesce("namespaced", "_ns").alias("namespaced"), blank("singular").alias("singular"),
        F.coalesce(F.when(F.size("short_names") > 0, F.col("short_names")),
                   F.array_compact(F.array(F.try_element_at(short, F.col("resource"))))).alias("short_names"),
        F.col("_ns").isNotNull().alias("captured"),
    )


def version_rank(version) -> Column:
    """Sort key of an API version: GA over beta over alpha, then numbers, newest first; others last by name."""
    v = F.col(version) if isinstance(version, str) else version
    pat = "^v([0-9]+)(?:(alpha|beta)([0-9]+)?)?$"
    stage = F.regexp_extract(v, pat, 2)
    num = lambda i: F.coalesce(F.regexp_extract(v, pat, i).try_cast("bigint"), F.lit(0))
    known = v.rlike(pat)
    return F.struct(
        F.when(known, F.when(stage == "", 0).when(stage == "beta", 1).otherwise(2)).otherwise(3).alias("a"),
        F.when(known, -num(1)).otherwise(0).alias("b"), F.when(known, -num(3)).otherwise(0).alias("c"),
        F.when(~known, v).otherwise("").alias("d"),
    )


def api_groups(catalog: DataFrame) -> DataFrame:
    """Per group: its versions best first, and the preferred one."""
    one = catalog.filter(F.col("group") != "").select("capture_id", "group", "version").distinct()
    ranked_versions = F.array_sort(F.collect_list(F.struct(version_rank("version").alias("k"), F.col("version").alias("version"))))
    return one.groupBy("capture_id", "group").agg(ranked_versions.alias("v")).select(
        "capture_id", "group", F.transform("v", lambda x: x["version"]).alias("versions"),
        F.get(F.col("v"), F.lit(0))["version"].alias("preferred"),
    )


def time_axis(records: DataFrame, stops: int = 180) -> DataFrame:
    """Distinct record times of each capture; more than ``stops`` are thinned to evenly spaced ones, first and last kept."""
    times = records.filter("captured_at IS NOT NULL").select("capture_id", "captured_at").distinct()
    numbered = ranked(times, ["capture_id"], ["captured_at"], "n").withColumn("n", F.col("n") - 1)
    totals = numbered.groupBy("capture_id").agg(F.count("*").alias("total"))
    step = (F.col("total") - 1) / F.lit(float(stops - 1))
    ids = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(stops - 1).cast("bigint")))
    picks = totals.filter(F.col("total") > stops).select("capture_id", "total", ids.alias("id")).select(
        "capture_id", F.least(F.floor(F.col("id") * step), F.col("total") - 1).alias("n")).distinct()
    short = totals.filter(F.col("total") <= stops).select("capture_id")
    columns = ["capture_id", "captured_at"]
    return numbered.join(picks, ["capture_id", "n"], "left_semi").select(*columns).unionByName(
        salted_join(numbered, short, ["capture_id"], ["n"]).select(*columns))
