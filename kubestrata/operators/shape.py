"""Shaping captured records: duplicates, per-namespace lists, discovery, targets, log coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kubestrata.functions.ordered import shifted
from kubestrata.functions.paths import api_path_cols, list_path, with_path_cols
from kubestrata.functions.scalars import blank, first_non_empty, item_count
from kubestrata.operators.timetravel import latest_at
from kubestrata.schema import CLUSTER_SCOPED, EXCLUDED_GROUPS, LIST_DDL, NATIVE_GROUPS, POD_NAMES_DDL, TABLE_DDL

KEYS = ["capture_id", "path"]
GVR = ["group", "version", "resource"]


def dedup_consecutive(records: DataFrame, body_hash: str | Column = "body", keys: list[str] = KEYS, order: str = "seq",
                      opt_out: Column | None = None, chunk: Column | None = None) -> DataFrame:
    """Drops a record whose body equals the record before it on its path; A, B, A keeps all three.

    Comparing with the previous record is the same as with the previous stored one: skipped records are equal
    to it. ``opt_out`` marks rows that are always kept. Only hashes travel across chunk borders.
    """
    digest = F.sha2(body_hash, 256) if isinstance(body_hash, str) else body_hash
    marked = shifted(records.withColumn("_hash", digest), keys, order, {"_prev": F.col("_hash")}, chunk)
    same = F.col("_hash").eqNullSafe(F.col("_prev")) & F.col("_prev").isNotNull()
    keep = ~same if opt_out is None else (opt_out | ~same)
    return marked.filter(keep).drop("_hash", "_prev")


def dedup_skipped(records: DataFrame, kept: DataFrame) -> DataFrame:
    """Number of suppressed duplicates per capture."""
    n = records.groupBy("capture_id").agg(F.count("*").alias("n"))
    k = kept.groupBy("capture_id").agg(F.count("*").alias("k"))
    return n.join(k, "capture_id", "left").select("capture_id", (F.col("n") - F.coalesce("k", F.lit(0))).alias("deduplicated_count"))


# ------------------------------------------------------------------- demux

def _demux(records: DataFrame, ddl: str, field: str, table: bool) -> DataFrame:
    keep = [c for c in records.columns if c not in ("body", "path")]
    parsed = with_path_cols(records, prefix="_").filter("_namespace = '' AND _resource <> ''").select(
        *keep, "path", F.from_json("body", ddl).alias("l"))
    rows = parsed.select(*keep, "path", F.struct(*[f"l.{c}" for c in ("apiVersion", "kind", "metadata")],
                                                 *(["l.columnDefinitions"] if table else [])).alias("head"),
                         F.posexplode(f"l.{field}").alias("pos", "item"))
    ns = F.get_json_object("item", "$.object.metadata.namespace" if table else "$.metadata.namespace")
    # a group is at most one list body, which already was one row
    groups = rows.withColumn("namespace", ns).filter("namespace <> ''").groupBy("capture_id", "path", "seq", "namespace").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items"),
        F.first("head").alias("head"), *[F.first(c).alias(c) for c in keep if c not in ("capture_id", "seq", "namespace")])
    return groups.withColumn("cluster_path", F.col("path")).withColumn(
        "path", F.concat(_child_path(F.col("path"), F.col("namespace")), F.lit("?as=Table") if table else F.lit("")))


def _child_path(path: Column, namespace) -> Column:
    c = api_path_cols(path)
    return list_path(c["group"], c["version"], c["resource"], namespace)


def _body(field: str, items: Column, head: str = "head", table: bool = False) -> Column:
    """One list body: envelope members that are set, then the items as raw JSON."""
    member = lambda name, raw: F.when(blank(F.col(f"{head}.{name}")) != "", F.concat(
        F.lit(f'"{name}":'), F.col(f"{head}.{name}") if raw else F.concat(F.lit('"'), F.col(f"{head}.{name}"), F.lit('"'))))
    parts = [member("apiVersion", False), *([member("columnDefinitions", True)] if table else []),
             F.concat(F.lit(f'"{field}":['), F.array_join(items, ","), F.lit("]")), member("kind", False), member("metadata", True)]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def demux_lists(records: DataFrame) -> DataFrame:
    """Cluster-wide list records -> one list record per namespace; items without a namespace are dropped."""
    g = _demux(records, LIST_DDL, "items", False)
    return g.withColumn("body", _body("items", F.col("items"))).drop("items", "head")


def demux_tables(records: DataFrame) -> DataFrame:
    """Cluster-wide Table records -> one Table record per namespace, column definitions kept."""
    g = _demux(records, TABLE_DDL, "rows", True)
    return g.withColumn("body", _body("rows", F.col("items"), table=True)).drop("items", "head")


def emptied(present: DataFrame, polls: DataFrame, keys: list[str], poll: str = "n", chunk: Column | None = None) -> DataFrame:
    """(keys, poll) pairs where a key seen in an earlier poll of its path is missing.

    present  capture_id, path, keys…, n: polls in which the key occurs (n = dense poll number of the path)
    polls    capture_id, path, last_n: number of the last poll per path

    Gaps come from the next occurrence of the same key, so the work is proportional to the output; polls and
    keys are never paired up.
    """
    own = [*KEYS, *keys]
    rows = present.select(*own, poll).distinct()
    nxt = shifted(rows, own, poll, {"_next": F.col(poll)}, chunk, forward=True).join(polls, KEYS)
    end = F.coalesce(F.col("_next") - 1, F.col("last_n"))
    gaps = nxt.withColumn("_end", end).filter(F.col("_end") > F.col(poll))
    return gaps.select(*own, F.explode(F.sequence(F.col(poll) + 1, F.col("_end"))).alias(poll))


def with_emptied(demuxed: DataFrame, polled: DataFrame, table: bool = False) -> DataFrame:
    """Demuxed records plus an empty list for each namespace that vanished from a later poll of its path.

    polled: the cluster-wide records (capture_id, path, seq, captured_at, response_code, body).
    """
    from kubestrata.functions.ordered import ranked

    numbered = ranked(polled.select(*KEYS, "seq", "captured_at"), KEYS, ["seq"], "n")
    present = demuxed.select("capture_id", F.col("cluster_path").alias("path"), "namespace", "seq").join(
        numbered, [*KEYS, "seq"]).select(*KEYS, "namespace", "n")
    last = numbered.groupBy(*KEYS).agg(F.max("n").alias("last_n"))
    gone = emptied(present, last, ["namespace"]).join(numbered, [*KEYS, "n"])
    field = "rows" if table else "items"
    heads = polled.select(*KEYS, "seq", "response_code", F.from_json("body", TABLE_DDL if table else LIST_DDL).alias("head"))
    made = gone.join(heads, [*KEYS, "seq"]).withColumn("cluster_path", F.col("path")).withColumn(
        "path", F.concat(_child_path(F.col("path"), F.col("namespace")), F.lit("?as=Table" if table else "")))
    empty = F.array().cast("array<string>")
    return demuxed.unionByName(made.withColumn("body", _body(field, empty, table=table)).drop("head", "n"), allowMissingColumns=True)


def demux_watch(events: DataFrame) -> DataFrame:
    """Cluster-wide change events re-keyed to their object's namespace; other event types are dropped."""
    ns = blank(F.get_json_object("body", "$.metadata.namespace"))
    rows = with_path_cols(events.filter(F.col("event_type").isin("ADDED", "MODIFIED", "DELETED")), prefix="_").withColumn("_ns", ns)
    cluster = (F.col("_namespace") == "") & (F.col("_resource") != "")
    child = list_path("_group", "_version", "_resource", "_ns")
    return rows.filter(~cluster | (F.col("_ns") != "")).withColumn(
        "path", F.when(cluster, child).otherwise(F.col("path"))).select(*events.columns)


def infer_scope(records: DataFrame, poll: list[str]) -> DataFrame:
    """Per resource and poll: cluster scoped when every namespaced path answered 404 (0 is not a 404)."""
    rows = with_path_cols(records).filter("namespace <> ''")
    return rows.groupBy("capture_id", *GVR, *poll).agg(F.every(F.col("response_code") == 404).alias("cluster_scoped"))


# --------------------------------------------------------------- discovery

_RESOURCES = ("kind string, groupVersion string, resources array<struct<name: string, singularName: string, kind: string, "
              "namespaced: boolean, shortNames: array<string>, verbs: array<string>>>")


def api_catalog(records: DataFrame) -> DataFrame:
    """Discovery responses -> (group, version, resource, namespaced, kind, singular, short_names, verbs)."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    core = F.col("path").rlike("^/api/[^/?]+$")
    found = records.filter("event_type IS NULL AND response_code = 200").filter(core | F.col("path").rlike("^/apis/[^/?]+/[^/?]+$"))
    latest = latest_at(found).select(
        "capture_id", F.when(core, "").otherwise(F.get(parts, F.lit(1))).alias("group"),
        F.when(core, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2))).alias("version"),
        F.from_json("body", _RESOURCES).alias("l"))
    rows = latest.filter(blank("l.kind").isin("", "APIResourceList")).select("capture_id", "group", "version", F.explode("l.resources").alias("r"))
    return rows.filter(~F.col("r.name").contains("/")).select(
        "capture_id", "group", "version", F.col("r.name").alias("resource"), F.coalesce("r.namespaced", F.lit(False)).alias("namespaced"),
        blank("r.kind").alias("kind"), blank("r.singularName").alias("singular"), F.col("r.shortNames").alias("short_names"),
        F.col("r.verbs").alias("verbs"))


def expand_targets(catalog: DataFrame, configured: DataFrame, directives: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Discovered resources that no explicit target covers, under the first directive whose scope fits.

    directives  position INT, scope ('' | cluster | namespaced), interval STRING, namespaces ARRAY<STRING>
    """
    groups = [*EXCLUDED_GROUPS, *(exclude or [])]
    open_ = catalog.filter(~F.col("group").isin(groups)).join(configured.select(*GVR).distinct(), GVR, "left_anti")
    # directives are a handful of configuration rows: one array per scope, folded into the rows
    fits = lambda flag: directives.filter(F.col("scope").isin("", flag)).agg(
        F.min_by(F.struct("interval", "namespaces"), "position")).scalar()
    chosen = open_.withColumn("_d", F.when(F.col("namespaced"), fits("namespaced")).otherwise(fits("cluster"))).filter("_d IS NOT NULL")
    given = F.when(F.size("_d.namespaces") > 0, F.col("_d.namespaces")).otherwise(F.array(F.lit("*")))
    return chosen.select(*[c for c in catalog.columns if c in ("capture_id", *GVR, "namespaced")],
                         first_non_empty("_d.interval", F.lit("30s")).alias("interval"),
                         F.when(F.col("namespaced"), given).alias("namespaces"))


def expand_namespaces(targets: DataFrame, namespaces: DataFrame) -> DataFrame:
    """'*' -> explicit names first, then all captured namespaces, without repeats; one row per (target, namespace).

    Cluster-scoped kinds lose their namespaces and give one row with none.
    """
    keys = ["capture_id", *GVR]
    wild = F.array_contains("namespaces", "*")
    scoped = ~F.col("resource").isin(CLUSTER_SCOPED) & (F.size("namespaces") > 0)
    t = targets.withColumn("_wild", F.coalesce(wild & scoped, F.lit(False)))
    explicit = t.filter(F.coalesce(scoped, F.lit(False))).select(*keys, F.posexplode("namespaces").alias("ord", "namespace")).filter("namespace <> '*'")
    cols = [*keys, F.col("ord").cast("bigint").alias("ord"), "namespace"]
    every = t.filter("_wild").select(*keys).join(namespaces.select("capture_id", F.col("name").alias("namespace")), "capture_id").withColumn(
        "ord", F.lit(1 << 32))
    none = t.filter(~F.coalesce(scoped, F.lit(False))).select(*keys, F.lit(0).alias("ord"), F.lit(None).cast("string").alias("namespace"))
    both = explicit.select(*cols).unionByName(every.select(*cols)).groupBy(*keys, "namespace").agg(F.min("ord").alias("ord"))
    return both.unionByName(none.select(*cols))


def native_listable(catalog: DataFrame, captured: DataFrame) -> DataFrame:
    """Listable kinds of built-in groups without a cluster-wide target, with the namespaces they are targeted in.

    captured  group, version, resource, namespaces ARRAY<STRING> of the configured targets
    """
    whole = captured.filter(F.coalesce(F.size("namespaces"), F.lit(0)) <= 0).select(*GVR).distinct()
    rows = catalog.filter(F.array_contains("verbs", "list") & F.col("group").isin(NATIVE_GROUPS)).join(whole, GVR, "left_anti")
    named = captured.select(*GVR, F.explode("namespaces").alias("ns")).filter("ns NOT IN ('', '*')").groupBy(*GVR).agg(
        F.array_sort(F.collect_set("ns")).alias("in_namespaces"))
    return rows.join(named, GVR, "left")


# -------------------------------------------------------------------- logs

def log_targets(pods: DataFrame, previous: bool = True) -> DataFrame:
    """pod x (init containers, then containers) x {current, previous}; exploded inside the pod row."""
    p = pods.select("capture_id", first_non_empty("obj_namespace", "namespace").alias("namespace"), F.col("name").alias("pod"),
                    F.from_json("obj", POD_NAMES_DDL)["spec"].alias("s"))
    names = lambda f: F.coalesce(F.transform(f"s.{f}", lambda c: blank(c["name"])), F.array().cast("array<string>"))
    rows = p.select("capture_id", "namespace", "pod", F.posexplode(F.concat(names("initContainers"), names("containers"))).alias("pos", "container"))
    variants = F.array(F.lit(False), F.lit(True)) if previous else F.array(F.lit(False))
    return rows.withColumn("previous", F.explode(variants))


def log_coverage(targets: DataFrame, results: DataFrame, sample: int = 20) -> tuple[DataFrame, DataFrame]:
    """(summary per capture, first failures with reason).

    results  capture_id, namespace, pod, container, previous, captured BOOLEAN, reason STRING
    """
    keys = ["capture_id", "namespace", "pod", "container", "previous"]
    rows = targets.join(results, keys, "left").withColumn("captured", F.coalesce("captured", F.lit(False)))
    now = ~F.col("previous")
    # the counts need no sorted join: how often each log is a target, has a result and was captured, then their products
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    marks = targets.select(*keys, one.alias("t"), none.alias("r"), none.alias("c")).unionByName(
        results.select(*keys, none.alias("t"), one.alias("r"), F.when(F.col("captured"), one).otherwise(none).alias("c")))
    each = marks.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in "trc"]).filter("t > 0")
    # a null is equal to nothing: such a target has no result
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    met, hit = F.col("t") * F.when(known, F.greatest("r", one)).otherwise(one), F.col("t") * F.when(known, F.col("c")).otherwise(none)
    total = lambda n, when: F.coalesce(F.sum(F.when(when, n)), none)
    summary = each.groupBy("capture_id").agg(
        total(met, now).alias("attempted"), total(hit, now).alias("captured"), total(met - hit, now).alias("skipped"),
        total(hit, F.col("previous")).alias("captured_previous"))
    w = Window.partitionBy("capture_id").orderBy("namespace", "pod", "container")
    failures = rows.filter(now & ~F.col("captured")).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= sample)
    return summary, failures.select("capture_id", "namespace", "pod", "container", "reason")


def with_item_counts(records: DataFrame) -> DataFrame:
    return records.withColumn("item_count", F.when(F.col("event_type").isNull(), item_count("body")))
