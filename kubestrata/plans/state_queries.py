"""Time travel, change and overlay queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kubestrata.functions.ordered import ranked
from kubestrata.functions.paths import api_path_cols, path_dir
from kubestrata.functions.scalars import at_literal
from kubestrata.operators import change, dash, overlay, shape, timetravel
from kubestrata.plans import adapters as ad
from kubestrata.plans.registry import AT, DAILY, EV, query, with_
from kubestrata.sources import records as rec


def value():
    return F.get_json_object("obj", "$.value").cast("double").alias("value")


def kcol():
    return F.get_json_object("obj", "$.spec.k").cast("bigint").alias("k")


@query(with_(EV) + f"""
SELECT path, name, value, k, first_seen FROM (
  SELECT path, name, typ, value, k, row_number() OVER (PARTITION BY path, name ORDER BY seq DESC) AS rn,
         min(seq) FILTER (typ <> 'DELETED') OVER (PARTITION BY path, name) AS first_seen
  FROM ev WHERE ts <= TIMESTAMP '{AT}') WHERE rn = 1 AND typ <> 'DELETED'""")
def state_at(spark, sf):
    """Objects alive at an instant, from change events alone."""
    state = timetravel.reconstruct_at(ad.event_records(spark, sf), AT)
    return state.select("path", "name", value(), kcol(), (F.col("position") - (1 << 40)).alias("first_seen"))


@query(with_(EV, DAILY) + """
, base AS (SELECT d.*, CAST(DATE '2024-01-01' AS TIMESTAMP) + to_days(CAST(d.seq + 1 AS INT)) AS snap FROM daily d
           JOIN (SELECT path, max(seq) AS seq FROM daily WHERE seq <= 13 GROUP BY path) USING (path, seq)),
bounds AS (SELECT DISTINCT replace(path, 'sessions', 'widgets') AS path, snap FROM base),
rows AS (
  SELECT replace(path, 'sessions', 'widgets') AS path, 'u' || user_id AS name, 'ADDED' AS typ, value,
         CAST(user_id AS BIGINT) AS rank FROM base
  UNION ALL
  SELECT e.path, e.name, e.typ, e.value, e.seq + 1099511627776 FROM ev e LEFT JOIN bounds b USING (path)
  WHERE e.ts <= TIMESTAMP '2024-01-15 12:00:00' AND (b.snap IS NULL OR e.ts > b.snap))
SELECT path, name, value, position FROM (
  SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY rank DESC) AS rn,
         min(rank) FILTER (typ <> 'DELETED') OVER (PARTITION BY path, name) AS position FROM rows)
WHERE rn = 1 AND typ <> 'DELETED'""")
def state_from_snapshot(spark, sf):
    """Objects alive at an instant: latest daily list plus the events after it."""
    at = "2024-01-15 12:00:00"
    items = ad.daily_items(spark, sf).withColumn("path", F.replace("path", F.lit("sessions"), F.lit("widgets")))
    base = timetravel.latest_at(ad.daily_snapshots(items), at)
    own = items.join(base.select("capture_id", "path", "seq"), ["capture_id", "path", "seq"], "left_semi")
    state = timetravel.reconstruct(base, own, ad.event_log(spark, sf), at)
    return state.select("path", F.get_json_object("obj", "$.metadata.name").alias("name"), value(), "position")


@query(f"""
SELECT user_id, event_id, event_type, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events
  WHERE ts <= TIMESTAMP '{AT}') WHERE rn = 1""")
def latest_at(spark, sf):
    """Last record per key at or before an instant."""
    e = ad.table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("what"), F.col("ts").alias("captured_at"))
    last = timetravel.latest_at(e, AT, ["user_id"], "event_id")
    return last.select("user_id", "event_id", F.col("what").alias("event_type"), F.col("captured_at").alias("ts"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 30 AS INT))
                  + to_hours(CAST(o_orderkey % 24 AS INT)) AS instant FROM orders)
SELECT o_orderkey, instant, e.event_id, e.event_type FROM o ASOF LEFT JOIN events e ON o.o_custkey = e.user_id AND o.instant >= e.ts""")
def as_of_join(spark, sf):
    """Per order the last event of its customer before the order's instant."""
    day = F.make_dt_interval((F.col("o_orderkey") % 30).cast("int"), (F.col("o_orderkey") % 24).cast("int"))
    o = ad.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + day).alias("instant"))
    out = timetravel.as_of_join(o, ad.table(spark, sf, "events"), "user_id", "instant", "ts", "event_id", ["event_id", "event_type"])
    return out.select("o_orderkey", "instant", "event_id", "event_type")


@query("""
SELECT event_id, user_id, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)
WHERE event_type IS DISTINCT FROM prev""")
def dedup_consecutive(spark, sf):
    """Events whose type differs from the one before it of the same user."""
    e = ad.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return shape.dedup_consecutive(e, "event_type", ["user_id"], "event_id").select("event_id", "user_id", "event_type")


@query(with_(EV) + "SELECT path, seq AS event_id, row_number() OVER (PARTITION BY path ORDER BY ts, seq) - 1 AS path_seq FROM ev")
def path_seq(spark, sf):
    """Dense arrival number per path."""
    ev = ad.event_log(spark, sf).select("capture_id", "path", "captured_at", F.col("seq").alias("record_id"))
    return rec.with_seq(ev).select("path", F.col("record_id").alias("event_id"), F.col("seq").alias("path_seq"))


@query(with_(EV) + """
SELECT path, CAST(floor(seq / 500) AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS entries, min(seq) AS first_seq, max(seq) AS last_seq,
       min(ts) AS first_time, max(ts) AS last_time, CAST(sum(seq) AS BIGINT) AS seq_sum FROM ev GROUP BY ALL""")
def index_build(spark, sf):
    """Index arrays per path in bounded parts, summarised."""
    ev = ad.event_log(spark, sf).withColumn("item_count", F.lit(0))
    idx = rec.build_index(ev, rows=500)
    return idx.select(
        "path", F.col("part").cast("bigint").alias("part"), F.size("seqs").cast("bigint").alias("entries"), F.get("seqs", F.lit(0)).alias("first_seq"),
        F.element_at("seqs", -1).alias("last_seq"), F.get("times", F.lit(0)).alias("first_time"), F.element_at("times", -1).alias("last_time"),
        F.aggregate("seqs", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("seq_sum"))


@query(with_(EV) + "SELECT path, seq, ts AS captured_at, typ AS event_type FROM ev")
def index_explode(spark, sf):
    """Index JSON (wrapped form, built per bounded part) back to one row per record."""
    idx = rec.build_index(ad.event_log(spark, sf).withColumn("item_count", F.lit(0)), rows=500)
    stamp = F.transform("times", lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    entry = F.struct(F.col("path").alias("api_path"), "seqs", stamp.alias("times"), "event_types")
    wrapped = F.to_json(F.struct(F.create_map("path", entry).alias("entries")))
    return rec.explode_index(idx.select(wrapped.alias("j")), "j", watch=True).select("path", "seq", "captured_at", "event_type")


@query("""
SELECT 'c0' AS capture_id, min(ts) AS captured_at, max(ts) AS captured_until, CAST(count(*) AS BIGINT) AS record_count,
       CAST(count(*) AS BIGINT) AS watch_events, true AS watch_enabled FROM events""")
def manifest(spark, sf):
    """Capture window and counters in one pass."""
    m = rec.manifest(ad.event_records(spark, sf))
    return m.select("capture_id", "captured_at", "captured_until", "record_count", "watch_events", "watch_enabled")


@query(with_(EV) + "SELECT path, substr(sha256(path), 1, 16) AS folder, CAST(count(*) AS BIGINT) AS records FROM ev GROUP BY ALL")
def path_hash(spark, sf):
    """Storage folder per path."""
    return ad.event_log(spark, sf).groupBy("path", path_dir("path").alias("folder")).agg(F.count("*").alias("records"))


@query(with_(EV) + """
SELECT '' AS "group", split_part(path, '/', 3) AS version, split_part(path, '/', 6) AS resource,
       split_part(path, '/', 5) AS namespace, CAST(count(*) AS BIGINT) AS records FROM ev GROUP BY ALL""")
def path_columns(spark, sf):
    """Path parsed to group, version, resource and namespace."""
    c = api_path_cols("path")
    return ad.event_log(spark, sf).groupBy(*[c[f].alias(f) for f in ("group", "version", "resource", "namespace")]).agg(F.count("*").alias("records"))


@query(with_(DAILY) + """
SELECT split_part(path, '/', 5) AS namespace, 'sessions' AS resource, CAST(count(*) AS BIGINT) AS objects FROM daily
JOIN (SELECT path, max(seq) AS seq FROM daily WHERE seq <= 13 GROUP BY path) USING (path, seq) GROUP BY ALL""")
def namespace_counts(spark, sf):
    """Objects per namespace and resource in the last list at or before T, from the index."""
    idx = ad.daily_snapshots(ad.daily_items(spark, sf))
    return timetravel.namespace_counts(idx, AT).select("namespace", "resource", "objects")


@query("""
SELECT 'nodes' AS resource, CAST(count(*) AS BIGINT) AS objects FROM supplier
UNION ALL SELECT 'persistentvolumes', CAST(count(*) AS BIGINT) FROM customer""")
def cluster_counts(spark, sf):
    """Objects per cluster-scoped resource."""
    objs = ad.nodes(spark, sf).select("capture_id", "path").unionByName(ad.volumes(spark, sf).select("capture_id", "path")).unionByName(
        ad.claims(spark, sf).select("capture_id", "path"))
    idx = objs.groupBy("capture_id", "path").agg(F.count("*").cast("int").alias("item_count")).withColumns(
        {"seq": F.lit(0), "captured_at": F.lit("2024-01-01").cast("timestamp_ntz")})
    return timetravel.cluster_counts(idx, AT).select("resource", "objects")


@query("""
SELECT source, doc_id, text_hash FROM (
  SELECT source, doc_id, sha256(text) AS text_hash, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS rn FROM documents)
WHERE rn = 1""")
def aggregate_dedup(spark, sf):
    """Per-source document lists merged, first copy of each text wins."""
    d = ad.table(spark, sf, "documents").select(F.lit("c0").alias("capture_id"), "source", "doc_id", F.sha2("text", 256).alias("text_hash"))
    return timetravel.first_per_key(d, F.col("text_hash"), ["source", "doc_id"]).select("source", "doc_id", "text_hash")


@query("""
SELECT name, namespace FROM (
  SELECT 'u' || (user_id % 40) AS name, 'ns' || (user_id % 10) AS namespace,
         row_number() OVER (PARTITION BY user_id % 40 ORDER BY 'ns' || (user_id % 10), user_id) AS rn FROM (SELECT DISTINCT user_id FROM events)) WHERE rn = 1
ORDER BY namespace, name""")
def aggregate_namespaces(spark, sf):
    """All namespaces' lists of one resource as one list, repeated names dropped."""
    u = ad.table(spark, sf, "events").select("user_id").distinct()
    ns = ad.txt("ns", F.col("user_id") % 10)
    state = u.select(F.lit("c0").alias("capture_id"), ad.txt("/api/v1/namespaces/", ns, "/widgets").alias("path"), F.lit("").alias("uid"),
                     ad.txt("u", F.col("user_id") % 40).alias("name"), F.col("user_id").alias("position"), ns.alias("namespace"))
    return timetravel.aggregate_namespaces(state, "", "v1", "widgets").select("name", "namespace")


@query("""
WITH t AS (SELECT DISTINCT ts AS captured_at FROM events), n AS (SELECT captured_at, row_number() OVER (ORDER BY captured_at) - 1 AS n, count(*) OVER () AS c FROM t)
SELECT captured_at FROM n WHERE c <= 180 OR n IN (SELECT least(CAST(floor(i * ((c2 - 1) / 179.0::DOUBLE)) AS BIGINT), c2 - 1)
  FROM (SELECT unnest(range(180)) AS i, (SELECT count(*) FROM t) AS c2))""")
def time_axis(spark, sf):
    """180 evenly spaced instants of all record times."""
    return timetravel.time_axis(ad.event_log(spark, sf), 180).select("captured_at")


@query("""
WITH b AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders),
a AS (SELECT k, CASE WHEN k % 7 = 0 THEN p + 100 ELSE p END AS p FROM b WHERE k % 11 <> 0
      UNION ALL SELECT k + 10000000, p FROM b WHERE k % 13 = 0)
SELECT '/api/v1/namespaces/ns' || (COALESCE(b.k, a.k) % 25) || '/orders/o' || COALESCE(b.k, a.k) AS path, b.p AS price_before, a.p AS price_after
FROM b FULL OUTER JOIN a ON a.k = b.k WHERE b.p IS DISTINCT FROM a.p""")
def diff_captures(spark, sf):
    """Paths whose content differs between two captures; member order does not matter."""
    d = change.diff_captures(ad.order_records(spark, sf), ad.order_records(spark, sf, True))
    price = lambda c: F.get_json_object(c, "$.price").cast("double")
    return d.select("path", price("before").alias("price_before"), price("after").alias("price_after"))


@query(with_(DAILY) + """
, s AS (SELECT path, seq, count(*) AS n, round(sum(value), 2) AS total FROM daily GROUP BY ALL),
x AS (SELECT path, max(seq) FILTER (seq <= 6) AS s1, max(seq) FILTER (seq <= 20) AS s2 FROM s GROUP BY path)
SELECT x.path, CAST(b.n AS BIGINT) AS items_before, CAST(a.n AS BIGINT) AS items_after FROM x LEFT JOIN s b ON b.path = x.path AND b.seq = s1
LEFT JOIN s a ON a.path = x.path AND a.seq = s2 WHERE (b.n, b.total) IS DISTINCT FROM (a.n, a.total)""")
def diff_times(spark, sf):
    """One capture at two instants: daily lists reduced to count and sum."""
    items = ad.daily_items(spark, sf).withColumn("v", value())
    recs = items.groupBy("capture_id", "path", "seq", "captured_at").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("t")).select(
        "capture_id", "path", "seq", "captured_at", F.lit(None).cast("string").alias("event_type"), F.lit(200).alias("response_code"),
        F.to_json(F.struct("n", "t")).alias("body"))
    d = change.diff_times(recs, "2024-01-08 00:00:00", "2024-01-22 00:00:00")
    n = lambda c: F.get_json_object(c, "$.n").cast("bigint")
    return d.select("path", n("before").alias("items_before"), n("after").alias("items_after"))


@query(with_(EV) + """
SELECT path, name, seq, typ AS event_type, CASE WHEN typ = 'ADDED' OR pt = 'DELETED' THEN NULL ELSE pv END AS value_before,
       CASE WHEN typ <> 'DELETED' THEN value END AS value_after FROM (
  SELECT *, lag(typ) OVER w AS pt, lag(value) OVER w AS pv FROM ev WINDOW w AS (PARTITION BY path, name ORDER BY seq))""")
def transitions_watch(spark, sf):
    """Change events with the value before and after."""
    t = change.transitions_watch(ad.event_log(spark, sf))
    v = lambda c: F.get_json_object(c, "$.value").cast("double")
    return t.select("path", "name", "seq", "event_type", v("before").alias("value_before"), v("after").alias("value_after"))


@query(with_(DAILY) + """
, s AS (SELECT path, seq, lag(seq) OVER (PARTITION BY path ORDER BY seq) AS prev FROM (SELECT DISTINCT path, seq FROM daily)),
c AS (SELECT d.path, s.seq AS step, d.user_id, d.value FROM daily d JOIN s ON s.path = d.path AND s.seq = d.seq AND s.prev IS NOT NULL),
p AS (SELECT d.path, s.seq AS step, d.user_id, d.value FROM daily d JOIN s ON s.path = d.path AND s.prev = d.seq)
SELECT COALESCE(c.path, p.path) AS path, COALESCE(c.step, p.step) AS seq, 'u' || COALESCE(c.user_id, p.user_id) AS name,
  CASE WHEN p.value IS NULL THEN 'ADDED' WHEN c.value IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS event_type,
  p.value AS value_before, c.value AS value_after
FROM c FULL OUTER JOIN p ON c.path = p.path AND c.step = p.step AND c.user_id = p.user_id WHERE c.value IS DISTINCT FROM p.value""")
def transitions_poll(spark, sf):
    """Changes between consecutive daily lists."""
    items = ad.daily_items(spark, sf)
    t = change.transitions_poll(ad.daily_snapshots(items), items)
    v = lambda c: F.get_json_object(c, "$.value").cast("double")
    return t.select("path", "seq", "name", "event_type", v("before").alias("value_before"), v("after").alias("value_after"))


@query(with_(EV) + """
SELECT ns AS namespace, typ AS event_type, CAST(count(*) AS BIGINT) AS transitions,
  CAST(count(*) FILTER (typ <> 'ADDED' AND pt <> 'DELETED') AS BIGINT) AS with_before FROM (
  SELECT *, lag(typ) OVER (PARTITION BY path, name ORDER BY seq) AS pt FROM ev)
WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' GROUP BY ALL""")
def transition_report(spark, sf):
    """Transitions in a time window, per namespace and type."""
    t = change.transitions_watch(ad.event_log(spark, sf), since="2024-01-10 00:00:00", until="2024-01-20 00:00:00")
    return t.groupBy(F.col("obj_namespace").alias("namespace"), "event_type").agg(
        F.count("*").alias("transitions"), F.count("before").alias("with_before"))


@query(with_(EV) + f"SELECT seq, ts AS captured_at, typ AS event_type, name FROM ev WHERE ts <= TIMESTAMP '{AT}' ORDER BY ts DESC, path DESC, seq DESC LIMIT 8")
def recent_top_n(spark, sf):
    """The 8 newest changes at T."""
    return change.recent(ad.event_log(spark, sf), AT, 8).select("seq", "captured_at", "event_type", "name")


@query(with_(EV) + """
SELECT seq, ts AS captured_at, typ AS event_type FROM ev WHERE path = '/api/v1/namespaces/ns3/widgets' ORDER BY ts DESC""")
def object_history(spark, sf):
    """All changes of one path, newest first."""
    return change.object_history(ad.event_log(spark, sf), "/api/v1/namespaces/ns3/widgets").select("seq", "captured_at", "event_type")


@query(with_(EV) + "SELECT path AS target, seq, 1 + row_number() OVER (PARTITION BY path ORDER BY ts, path, seq) AS rv FROM ev")
def timeline_rv(spark, sf):
    """Version of every change on its own list."""
    return change.timeline(ad.event_log(spark, sf)).select("target", "seq", "rv")


@query(with_(EV) + "SELECT '/api/v1/widgets' AS target, path, seq, 1 + row_number() OVER (ORDER BY ts, path, seq) AS rv FROM ev")
def timeline_cluster(spark, sf):
    """Version of every change on the cluster-wide list: one target holding all rows."""
    return change.timeline(ad.event_log(spark, sf), cluster=True).select("target", "path", "seq", "rv")


@query(with_(EV) + """
SELECT path AS target, """ + ", ".join(
    f"CAST(count(*) FILTER (ts <= TIMESTAMP '2024-01-{d} 00:00:00') AS BIGINT) + 1 AS rv_{d}" for d in ("05", "10", "20", "30")) + " FROM ev GROUP BY path")
def rv_as_of(spark, sf):
    """Version of every list at four instants."""
    return change.rv_as_of(ad.event_log(spark, sf), {f"rv_{d}": f"2024-01-{d} 00:00:00" for d in ("05", "10", "20", "30")}).drop("capture_id")


@query(with_(EV) + """
SELECT path AS target, seq, rv FROM (SELECT *, 1 + row_number() OVER (PARTITION BY path ORDER BY ts, path, seq) AS rv FROM ev) WHERE rv > 20""")
def read_since(spark, sf):
    """Changes after a version."""
    return change.read_since(change.timeline(ad.event_log(spark, sf)), 20).select("target", "seq", "rv")


@query(with_(EV) + f"""
, e AS (SELECT *, 1 + row_number() OVER (ORDER BY ts, seq) AS rv FROM ev WHERE path = '/api/v1/namespaces/ns3/widgets'),
s AS (SELECT name, typ, value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS rn FROM e WHERE ts <= TIMESTAMP '{AT}') WHERE rn = 1 AND typ <> 'DELETED')
SELECT 'ADDED' AS event_type, CAST((SELECT count(*) + 1 FROM e WHERE ts <= TIMESTAMP '{AT}') AS BIGINT) AS rv, name, value FROM s
UNION ALL SELECT typ, CAST(rv AS BIGINT), name, value FROM e WHERE ts > TIMESTAMP '{AT}'""")
def list_then_tail(spark, sf):
    """State of one list at T, then every later change, versions stamped into the objects."""
    ev = ad.event_log(spark, sf)
    state = timetravel.reconstruct_at(ad.event_records(spark, sf), AT)
    rows = change.list_then_tail(state, ev, AT, "/api/v1/namespaces/ns3/widgets")
    version = F.get_json_object("obj", "$.metadata.resourceVersion").cast("bigint")
    return rows.select("event_type", version.alias("rv"), F.get_json_object("obj", "$.metadata.name").alias("name"), value())


# ------------------------------------------------------------------ overlay

_LAST = """last AS (
  SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS typ FROM events GROUP BY user_id)"""


@query(with_(_LAST) + """
SELECT COALESCE(c_custkey, user_id) AS custkey, CASE WHEN user_id IS NULL THEN c_acctbal ELSE value END AS balance, user_id IS NOT NULL AS from_overlay
FROM customer FULL OUTER JOIN last ON c_custkey = user_id WHERE COALESCE(typ, '') <> 'error'""")
def overlay_merge(spark, sf):
    """Customers overlaid with users' last events: replace, remove, append."""
    base = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").cast("string").alias("obj"))
    last = ad.table(spark, sf, "events").groupBy(F.col("user_id").alias("custkey")).agg(
        F.max_by("value", "event_id").cast("string").alias("obj"), (F.max_by("event_type", "event_id") == "error").alias("deleted"))
    return overlay.merge_overlay(base, last, ["custkey"]).select("custkey", F.col("obj").cast("double").alias("balance"), "from_overlay")


_COMPACT = EV + """, c AS (
  SELECT ns, name, max(seq) + 1 AS rv, arg_max(typ, seq) = 'DELETED' AS deleted, max(seq) FILTER (typ = 'DELETED') AS last_delete, arg_max(value, seq) AS value
  FROM ev GROUP BY ns, name), entries AS (
  SELECT c.ns, c.name, c.rv, c.deleted, c.value, COALESCE(min(e.seq) + 1, 0) AS created_rv FROM c LEFT JOIN ev e
    ON e.ns = c.ns AND e.name = c.name AND e.typ <> 'DELETED' AND (last_delete IS NULL OR e.seq > last_delete) GROUP BY ALL)"""


@query(with_(_COMPACT) + "SELECT ns AS namespace, name, rv, created_rv, deleted, value FROM entries")
def change_compaction(spark, sf):
    """Write log to one entry per object with its creation version."""
    return overlay.compact(ad.change_log(spark, sf)).select(F.col("obj_namespace").alias("namespace"), "name", "rv", "created_rv", "deleted", value())


@query(with_(_COMPACT) + """
SELECT ns AS namespace, name, rv, CASE WHEN deleted THEN 'DELETED' WHEN created_rv > 300 THEN 'ADDED' ELSE 'MODIFIED' END AS event_type
FROM entries WHERE rv > 300""")
def changes_since(spark, sf):
    """Entries newer than a version, classified."""
    return overlay.changes_since(overlay.compact(ad.change_log(spark, sf)), 300).select(F.col("obj_namespace").alias("namespace"), "name", "rv", "event_type")


@query(with_(_COMPACT) + "SELECT ns AS namespace, CAST(count(*) AS BIGINT) AS objects, min(name) AS sample FROM entries WHERE NOT deleted GROUP BY ns")
def overlay_scopes(spark, sf):
    """Live overlay entries per namespace with a sample."""
    s = overlay.overlay_scopes(overlay.compact(ad.change_log(spark, sf)))
    return s.select(F.col("obj_namespace").alias("namespace"), "objects", F.get_json_object("sample", "$.metadata.name").alias("sample"))


@query("SELECT 'ns' || c_nationkey AS namespace, 'claim-' || c_custkey AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 2")
def namespace_cascade(spark, sf):
    """Claims without those of deleted namespaces."""
    gone = ad.namespaces(spark, sf).select("capture_id", "group", "version", "resource", "obj_namespace", "name", (F.element_at("labels", "region") == "2").alias("deleted"))
    return overlay.drop_deleted_namespaces(ad.claims(spark, sf), gone).select("namespace", "name")


@query(with_(EV) + "SELECT seq, name FROM ev WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def owned_suppression(spark, sf):
    """Timeline events of objects the overlay does not own."""
    c = ad.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    owned = c.select(ad.txt("ns", F.col("c_custkey") % 10).alias("obj_namespace"), ad.txt("u", F.col("c_custkey")).alias("name"))
    return overlay.suppress_owned(ad.event_log(spark, sf), owned, ["obj_namespace", "name"]).select("seq", "name")


@query("""SELECT 'part-' || p_partkey AS name, CAST(7000 AS BIGINT) AS rv FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_type <> 'PROMO'""")
def delete_collection(spark, sf):
    """Tombstones for a strict selection."""
    from kubestrata.operators.select import filter_strict

    objs = ad.part_objects(spark, sf)
    safe = objs.withColumn("labels", F.transform_values("labels", lambda _k, v: F.replace(v, F.lit("#"), F.lit("-"))))
    rows = filter_strict(safe, "shop.example.com", "parts", "brand in (Brand-1,Brand-2),type!=PROMO")
    return overlay.delete_collection(rows, 7000).select("name", "rv")


@query("""
WITH c AS (SELECT 'ns' || (p_partkey % 25) AS namespace, CAST(sum(CASE WHEN p_size > 40 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM part GROUP BY 1),
o AS (SELECT 'ns' || (s_suppkey % 30) AS namespace, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY 1)
SELECT COALESCE(c.namespace, o.namespace) AS namespace, CASE WHEN COALESCE(c.n, 0) = 0 THEN COALESCE(o.n, 0) ELSE c.n END AS objects
FROM c FULL OUTER JOIN o ON c.namespace = o.namespace""")
def fold_counts(spark, sf):
    """Zero and missing index counts filled from overlay scopes."""
    counts = ad.table(spark, sf, "part").groupBy(ad.txt("ns", F.col("p_partkey") % 25).alias("namespace")).agg(F.count_if(F.col("p_size") > 40).alias("objects"))
    over = ad.table(spark, sf, "supplier").groupBy(ad.txt("ns", F.col("s_suppkey") % 30).alias("namespace")).agg(F.count("*").alias("objects"))
    return overlay.fold_counts(counts, over, ["namespace"]).select("namespace", "objects")


@query(with_(EV) + """
SELECT name, CAST(count(*) AS BIGINT) AS patches, arg_max(value, seq) AS value, arg_max(k, seq) FILTER (k % 2 = 0) AS even_k FROM ev GROUP BY name""")
def merge_patch_fold(spark, sf):
    """Every change as a merge patch on an empty object, folded in order."""
    ev = ad.event_log(spark, sf)
    base = ev.select("name").distinct().withColumn("obj", F.lit('{"value":-1,"n":0}'))
    patch = F.when(kcol() % 2 == 0, ad.txt('{"value":', F.get_json_object("obj", "$.value"), ',"even":{"k":', kcol(), "}}")).otherwise(
        ad.txt('{"value":', F.get_json_object("obj", "$.value"), ',"odd":{"k":', kcol(), "}}"))
    done = overlay.fold_patches(base, ev.select("name", F.col("seq").alias("rv"), patch.alias("patch")), ["name"], fan_in=1024)
    n = ev.groupBy("name").agg(F.count("*").alias("patches"))
    return done.join(n, "name").select("name", "patches", value(), F.get_json_object("obj", "$.even.k").cast("bigint").alias("even_k"))


# ------------------------------------------------------------------ shaping

@query(with_(DAILY) + """
, polls AS (SELECT DISTINCT seq FROM daily),
seen AS (SELECT user_id AS ns, seq, count(*) AS n FROM daily GROUP BY ALL),
first AS (SELECT ns, min(seq) AS first FROM seen GROUP BY ns)
SELECT 'ns' || ns AS namespace, polls.seq AS poll FROM first JOIN polls ON polls.seq > first
WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.ns = first.ns AND s.seq = polls.seq)""")
def emptied_namespaces(spark, sf):
    """Namespaces, one for each user, seen in an earlier poll of a cluster-wide list and missing now."""
    items = ad.daily_items(spark, sf)
    polls = items.select("capture_id", F.lit("/api/v1/sessions").alias("path"), F.col("seq")).distinct()
    numbered = ranked(polls, ["capture_id", "path"], ["seq"], "n")
    seen = items.select("capture_id", F.lit("/api/v1/sessions").alias("path"), "seq", F.concat(F.lit("ns"), F.substring("name", 2, 20)).alias("namespace"))
    present = seen.join(numbered, ["capture_id", "path", "seq"]).select("capture_id", "path", "namespace", "n")
    last = numbered.groupBy("capture_id", "path").agg(F.max("n").alias("last_n"))
    gone = shape.emptied(present, last, ["namespace"])
    return gone.join(numbered, ["capture_id", "path", "n"]).select("namespace", F.col("seq").alias("poll"))


@query(with_(EV) + "SELECT '/api/v1/namespaces/' || ns || '/widgets' AS path, seq FROM ev WHERE typ IN ('ADDED', 'DELETED') OR k > 50")
def watch_demux(spark, sf):
    """Cluster-wide change events re-keyed to their namespace; bookmark events dropped."""
    ev = ad.event_records(spark, sf).withColumn("path", F.lit("/api/v1/widgets"))
    k = F.get_json_object("body", "$.spec.k").cast("int")
    ev = ev.withColumn("event_type", F.when((F.col("event_type") == "MODIFIED") & (k <= 50), "BOOKMARK").otherwise(F.col("event_type")))
    return shape.demux_watch(ev).select("path", "seq")


@query("""
SELECT 'parts' || (p_partkey % 40) AS resource, bool_and(p_size > 3) AS cluster_scoped FROM part GROUP BY 1""")
def scope_inference(spark, sf):
    """Resources whose namespaced paths all answered 404."""
    p = ad.table(spark, sf, "part")
    recs = p.select(F.lit("c0").alias("capture_id"), ad.txt("/apis/shop/v1/namespaces/ns", F.col("p_partkey") % 25, "/parts", F.col("p_partkey") % 40).alias("path"),
                    F.when(F.col("p_size") > 3, 404).otherwise(0).alias("response_code"), F.lit(0).alias("poll"))
    return shape.infer_scope(recs, ["poll"]).select("resource", "cluster_scoped")


@query(with_(EV) + """
SELECT 'c0' AS capture_id, CAST(count(DISTINCT path) AS BIGINT) AS resource_types_paths, CAST(count(*) AS BIGINT) AS watch_events,
       min(ts) AS captured_at, max(ts) AS captured_until, CAST(round(date_diff('microsecond', min(ts), max(ts)) / 1e6) AS BIGINT) AS duration_seconds FROM ev""")
def capture_info(spark, sf):
    """Window, paths and events of a capture."""
    idx = ad.event_log(spark, sf).select("capture_id", "path", "seq", "captured_at", "event_type", F.lit(0).alias("item_count"), F.lit("widgets").alias("resource"))
    info = dash.capture_info(idx)
    paths = idx.select("path").distinct().agg(F.count("*")).scalar()
    return info.select("capture_id", paths.alias("resource_types_paths"), "watch_events", "captured_at", "captured_until", "duration_seconds")


@query(with_(EV) + f"""
SELECT seq, typ AS event_type FROM ev WHERE ts > TIMESTAMP '{AT}'""")
def window_filter(spark, sf):
    """Changes after an instant: a pure pushed-down scan."""
    ev = ad.event_log(spark, sf)
    return ev.filter(F.col("captured_at") > at_literal(AT)).select("seq", "event_type")
