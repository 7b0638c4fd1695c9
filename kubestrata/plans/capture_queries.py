"""Queries on two captures in one table, and on operators' whole forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from kubestrata.operators import change, dash, digesttree, graph, keptstate, overlay, search, select, sweep, timetravel, views
from kubestrata.operators.textindex import TextIndex
from kubestrata.plans import adapters as ad
from kubestrata.plans.registry import EV, POD, WORK, query, with_
from kubestrata.session import new_folder

AT = "2024-01-15 00:00:00"

# Every second event belongs to a capture of its own; times and versions are each capture's.
TWO = EV + ", two AS (SELECT *, 'c' || (seq % 2) AS capture_id FROM ev)"


def _two(df, seq="seq"):
    return df.withColumn("capture_id", F.concat(F.lit("c"), (F.col(seq) % 2).cast("string")))


def _value():
    return F.get_json_object("obj", "$.value").cast("double").alias("value")


@query(with_(TWO) + f"""
, e AS (SELECT *, 1 + row_number() OVER (PARTITION BY capture_id ORDER BY ts, seq) AS rv FROM two WHERE path = '/api/v1/namespaces/ns3/widgets'),
s AS (SELECT capture_id, name, typ, value FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, name ORDER BY seq DESC) AS rn FROM e WHERE ts <= TIMESTAMP '{AT}')
      WHERE rn = 1 AND typ <> 'DELETED')
SELECT capture_id, 'ADDED' AS event_type, CAST((SELECT count(*) + 1 FROM e WHERE e.capture_id = s.capture_id AND ts <= TIMESTAMP '{AT}') AS BIGINT) AS rv, name, value FROM s
UNION ALL SELECT capture_id, typ, CAST(rv AS BIGINT), name, value FROM e WHERE ts > TIMESTAMP '{AT}'""")
def list_then_tail_captures(spark, sf):
    """One list of each capture at T, then its later changes, each capture with its own versions."""
    ev = _two(ad.event_log(spark, sf))
    state = timetravel.reconstruct_at(_two(ad.event_records(spark, sf)), AT)
    rows = change.list_then_tail(state, ev, AT, "/api/v1/namespaces/ns3/widgets")
    version = F.get_json_object("obj", "$.metadata.resourceVersion").cast("bigint")
    return rows.select("capture_id", "event_type", version.alias("rv"), F.get_json_object("obj", "$.metadata.name").alias("name"), _value())


@query(with_(TWO) + """
, t AS (SELECT *, 1 + row_number() OVER (PARTITION BY capture_id, path ORDER BY ts, path, seq) AS rv FROM two),
m AS (SELECT capture_id, path, max(rv) AS newest FROM t GROUP BY ALL)
SELECT capture_id, path AS target, typ AS event_type, seq, CAST(rv AS BIGINT) AS rv FROM t WHERE rv > 55
UNION ALL SELECT capture_id, path, 'EXPIRED', NULL, CAST(newest AS BIGINT) FROM m WHERE newest < 55""")
def read_since_captures(spark, sf):
    """Changes after a version in each capture; lists that never reached it are expired."""
    return change.read_since(change.timeline(_two(ad.event_log(spark, sf))), 55).select("capture_id", "target", "event_type", "seq", "rv")


@query("""
SELECT 'c' || (c_custkey % 2) AS capture_id, 'ns' || c_nationkey AS namespace, 'claim-' || c_custkey AS name FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE NOT (n_regionkey = 2 AND c_custkey % 2 = 0)""")
def namespace_cascade_captures(spark, sf):
    """Namespaces deleted in one capture take objects of that capture alone."""
    gone = ad.namespaces(spark, sf).select(F.lit("c0").alias("capture_id"), "group", "version", "resource", "obj_namespace", "name", (F.element_at("labels", "region") == "2").alias("deleted"))
    claims = _two(ad.claims(spark, sf), "position")
    return overlay.drop_deleted_namespaces(claims, gone).select("capture_id", "namespace", "name")


@query(with_(TWO) + """
, t AS (SELECT DISTINCT capture_id, ts AS captured_at FROM two),
n AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY captured_at) - 1 AS n, count(*) OVER (PARTITION BY capture_id) AS c FROM t)
SELECT capture_id, captured_at FROM n WHERE c <= 40 OR n IN (SELECT least(CAST(floor(i * ((n.c - 1) / 39.0::DOUBLE)) AS BIGINT), n.c - 1) FROM (SELECT unnest(range(40)) AS i))""")
def time_axis_captures(spark, sf):
    """40 evenly spaced instants of each capture."""
    return timetravel.time_axis(_two(ad.event_log(spark, sf)), 40).select("capture_id", "captured_at")


@query(with_(TWO) + f"""
SELECT capture_id, seq, name FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts DESC, path DESC, seq DESC) AS rn FROM two WHERE ts <= TIMESTAMP '{AT}') WHERE rn <= 8""")
def recent_captures(spark, sf):
    """The 8 newest changes of each capture."""
    return change.recent(_two(ad.event_log(spark, sf)), AT, 8).select("capture_id", "seq", "name")


@query(with_(TWO) + """
, c AS (SELECT capture_id, ns, name, max(seq) + 1 AS rv, arg_max(typ, seq) = 'DELETED' AS deleted, max(seq) FILTER (typ = 'DELETED') AS gone FROM two GROUP BY ALL)
SELECT c.capture_id, c.ns AS namespace, c.name, c.rv, CASE WHEN c.deleted THEN 0 ELSE COALESCE(min(e.seq) + 1, 0) END AS created_rv, c.deleted FROM c LEFT JOIN two e
  ON e.capture_id = c.capture_id AND e.ns = c.ns AND e.name = c.name AND e.typ <> 'DELETED' AND (gone IS NULL OR e.seq > gone) GROUP BY c.capture_id, c.ns, c.name, c.rv, c.deleted""")
def change_compaction_captures(spark, sf):
    """Write logs of two captures to one entry per object of each."""
    log = _two(ad.change_log(spark, sf).withColumn("seq", F.col("rv") - 1)).drop("seq")
    return overlay.compact(log).select("capture_id", F.col("obj_namespace").alias("namespace"), "name", "rv", "created_rv", "deleted")


@query(with_(TWO) + f"""
SELECT capture_id, path, name, value FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, path, name ORDER BY seq DESC) AS rn FROM two WHERE ts <= TIMESTAMP '{AT}')
WHERE rn = 1 AND typ <> 'DELETED'""")
def state_at_captures(spark, sf):
    """Objects alive at an instant in each capture."""
    return timetravel.reconstruct_at(_two(ad.event_records(spark, sf)), AT).select("capture_id", "path", "name", _value())


# ------------------------------------------------------- operators as a whole

@query(with_(EV) + """
, p AS (SELECT *, lag(typ) OVER (PARTITION BY path, name ORDER BY seq) AS pt, lag(value) OVER (PARTITION BY path, name ORDER BY seq) AS pv FROM ev)
SELECT path, seq, typ AS event_type, name, CASE WHEN typ = 'ADDED' OR pt = 'DELETED' THEN NULL ELSE pv END AS value_before, CASE WHEN typ <> 'DELETED' THEN value END AS value_after
FROM p WHERE ns IN (SELECT 'ns' || n_nationkey FROM nation) AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""")
def transition_report_whole(spark, sf):
    """Transitions of every path that has a snapshot, in a time window."""
    n = ad.table(spark, sf, "nation")
    snaps = n.select(F.lit(ad.CAPTURE).alias("capture_id"), ad.txt("/api/v1/namespaces/ns", F.col("n_nationkey"), "/widgets").alias("path"), F.lit(-1).cast("bigint").alias("seq"),
                     F.lit("2023-12-31").cast("timestamp_ntz").alias("captured_at"), F.lit(None).cast("string").alias("event_type"), F.lit("GET").alias("http_method"),
                     F.lit(200).alias("response_code"), F.lit('{"items":[]}').alias("body"))
    t = change.transition_report(snaps.unionByName(ad.event_records(spark, sf)), ad.event_log(spark, sf), since="2024-01-10 00:00:00", until="2024-01-20 00:00:00")
    v = lambda c: F.get_json_object(c, "$.value").cast("double")
    return t.select("path", "seq", "event_type", "name", v("before").alias("value_before"), v("after").alias("value_after"))


@query("""SELECT 'part-' || p_partkey AS name, 'metadata.labels.brand' AS field, CAST(0 AS BIGINT) AS byte_start, p_brand AS snippet FROM part WHERE regexp_matches(p_brand, '^Brand#1[0-9]$')""")
def regex_leaf_search(spark, sf):
    """Regular expression over every string leaf, with the snippet around the match."""
    return search.search_text(ad.part_objects(spark, sf), "^Brand#1[0-9]$", regex=True).select("name", "field", "byte_start", "snippet")


@query("""SELECT 'doc-' || doc_id AS name, 'spec.text' AS field, CAST(octet_length(encode(substr(text, 1, strpos(text, 'token') - 1))) AS BIGINT) AS byte_start
FROM documents WHERE contains(text, 'token')""")
def indexed_text_search(spark, sf):
    """Substring search over every string leaf by the trigram index: only texts that hold the word are read."""
    docs = ad.documents_as_objects(spark, sf)
    index = TextIndex(spark, new_folder(spark, "text-index")).add(docs)
    return search.search_text(docs, "token", index=index).select("name", "field", "byte_start")


@query(r"""SELECT 'part-' || p_partkey AS name, field, CAST(octet_length(encode(substr(t, 1, strpos(t, regexp_extract(t, p, 0)) - 1))) AS BIGINT) AS byte_start, t AS snippet
FROM (SELECT p_partkey, 'metadata.labels.type' AS field, p_type AS t FROM part UNION ALL SELECT p_partkey, 'metadata.labels.brand', p_brand FROM part
      UNION ALL SELECT p_partkey, 'spec.type', lower(p_type) FROM part), (SELECT '(MEDIUM|PROMO)|B[a-z]+#[12]5|^standard$' AS p) WHERE regexp_matches(t, p)""")
def indexed_regex_search(spark, sf):
    """Regular expression over every string leaf by the trigrams that it requires."""
    parts = ad.part_objects(spark, sf)
    index = TextIndex(spark, new_folder(spark, "text-index")).add(parts)
    return search.search_text(parts, "(MEDIUM|PROMO)|B[a-z]+#[12]5|^standard$", regex=True, index=index).select("name", "field", "byte_start", "snippet")


@query("""SELECT conv_id, turn, line_no, byte_start FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line_no,
  FROM conversations), LATERAL (SELECT CAST(octet_length(encode(substr(line, 1, strpos(line, 'en') - 1))) AS BIGINT) AS byte_start) WHERE role = 'user' AND contains(line, 'en')""")
def log_search_whole(spark, sf):
    """Log records, one row per line, searched in one namespace."""
    c = ad.table(spark, sf, "conversations")
    # a log of its own for every turn: the record's body is the text as JSON
    path = ad.txt("/api/v1/namespaces/", F.col("role"), "/pods/c", F.col("conv_id"), "-", F.col("turn"), "/log?container=main")
    quoted = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("t"))), r'^\{"t":|\}$', "")
    recs = c.select(F.lit(ad.CAPTURE).alias("capture_id"), path.alias("path"), F.lit(0).alias("seq"), F.lit("2024-01-01").cast("timestamp_ntz").alias("captured_at"),
                    F.lit(None).cast("string").alias("event_type"), F.lit(200).alias("response_code"), quoted.alias("body"))
    hits = search.search_logs(search.log_lines(recs), "en", resource="pods", namespace="user")
    key = lambda i: F.regexp_extract("pod", "^c([0-9]+)-([0-9]+)$", i).cast("bigint")
    return hits.select(key(1).alias("conv_id"), key(2).alias("turn"), F.col("line_no").cast("int").alias("line_no"), "byte_start")


@query("""
WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, chr(10) || '+$', '') AS text FROM conversations WHERE text <> '')
SELECT conv_id, turn, role, array_to_string(list_slice(string_split(text, chr(10)), -3, -1), '|') AS tail FROM t""")
def log_tail_whole(spark, sf):
    """The last three lines of every log record."""
    c = ad.table(spark, sf, "conversations")
    path = ad.txt("/api/v1/namespaces/", F.col("role"), "/pods/c", F.col("conv_id"), "-", F.col("turn"), "/log?container=main")
    quoted = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("t"))), r'^\{"t":|\}$', "")
    recs = c.select(F.lit(ad.CAPTURE).alias("capture_id"), path.alias("path"), F.lit(0).alias("seq"), F.lit("2024-01-01").cast("timestamp_ntz").alias("captured_at"),
                    F.lit(None).cast("string").alias("event_type"), F.lit(200).alias("response_code"), quoted.alias("body"))
    key = lambda i: F.regexp_extract("pod", "^c([0-9]+)-([0-9]+)$", i).cast("bigint")
    return dash.log_tail(recs, 3).select(key(1).alias("conv_id"), key(2).alias("turn"), F.col("namespace").alias("role"), F.array_join("tail", "|").alias("tail"))


@query(with_(POD) + """
, one AS (SELECT name FROM pod WHERE ns = 'ns7' ORDER BY name LIMIT 1)
SELECT title, kind, n AS name FROM (
  SELECT 'Owned by' AS title, 'ReplicaSet' AS kind, owner AS n FROM pod WHERE ns = 'ns7' AND name = (SELECT name FROM one)
  UNION ALL SELECT 'Mounts ConfigMaps', 'ConfigMap', 'part-' || l_partkey FROM pod WHERE ns = 'ns7' AND name = (SELECT name FROM one)
  UNION ALL SELECT 'Mounts Secrets', 'Secret', 'supp-' || l_suppkey FROM pod WHERE ns = 'ns7' AND name = (SELECT name FROM one) AND q % 2 = 0
  UNION ALL SELECT 'Mounts PVCs', 'PersistentVolumeClaim', 'claim-' || (l_suppkey % 50) FROM pod WHERE ns = 'ns7' AND name = (SELECT name FROM one) AND q % 3 = 0)""")
def relationship_set(spark, sf):
    """All relations of one pod: the first of its namespace by name."""
    pods = ad.pods(spark, sf)
    name = pods.filter("namespace = 'ns7'").agg(F.min("name")).first()[0]
    return graph.relationships(pods, "/api/v1/namespaces/ns7/pods", name or "").select("title", "kind", "name")


@query(with_(WORK) + """
SELECT 'exact' AS source, name FROM work WHERE resource = 'deployments' AND ns = 'ns3' UNION ALL SELECT 'narrowed cluster list', 'claim-' || c_custkey FROM customer WHERE c_nationkey = 4""")
def read_fallback(spark, sf):
    """A captured namespace answers itself; one that was not captured is cut out of the cluster list."""
    exact = timetravel.list_objects(ad.workloads(spark, sf), "apps", "v1", "deployments", "ns3")
    cluster = ad.claims(spark, sf).withColumn("namespace", F.lit("")).withColumn("path", F.lit("/api/v1/persistentvolumeclaims"))
    narrowed = timetravel.list_objects(cluster, "", "v1", "persistentvolumeclaims", "ns4")
    return exact.select("source", "name").unionByName(narrowed.select("source", "name"))


@query("SELECT 'part-17' AS name, 'Name' AS first_column FROM part WHERE p_partkey = 17")
def table_row_single(spark, sf):
    """One row of the captured Tables by name."""
    from kubestrata.plans.object_queries import _part_tables

    rows = select.table_rows(_part_tables(spark, sf))
    return select.get_table_row(rows, "part-17").select("name", F.lit("Name").alias("first_column"))


@query("SELECT 'pv-' || c_custkey AS name FROM customer")
def view_choice(spark, sf):
    """A kind with a built-in view gets it when nothing else was captured for it."""
    return views.view(ad.volumes(spark, sf), "", "v1", "persistentvolumes", AT).select(F.col("Name").alias("name"))


@query(with_(EV + """, t AS (SELECT DISTINCT ts AS stop FROM ev), n AS (SELECT stop, row_number() OVER (ORDER BY stop) - 1 AS n FROM t),
axis AS (SELECT stop FROM n WHERE (SELECT count(*) FROM t) <= 24 OR n IN (SELECT least(CAST(floor(i * ((c - 1) / 23.0::DOUBLE)) AS BIGINT), c - 1)
  FROM (SELECT unnest(range(24)) AS i, (SELECT count(*) FROM t) AS c)))""") + """
SELECT stop AS captured_at, ns AS namespace, 'widgets' AS resource, CAST(count(*) AS BIGINT) AS objects FROM (
  SELECT stop, ns, user_id, arg_max(typ, seq) AS last FROM axis JOIN ev ON ev.ts <= axis.stop GROUP BY ALL) WHERE last <> 'DELETED' GROUP BY ALL""")
def counts_over_axis(spark, sf):
    """Objects per namespace and resource at 24 instants of the time axis, by one sweep over their lives."""
    ev = ad.event_records(spark, sf)
    return sweep.counts_over_axis(ev, timetravel.time_axis(ev, 24)).select("captured_at", "namespace", "resource", "objects")


@query(with_(EV) + f"""
SELECT path, ns || '/' || name AS object_key, value FROM (SELECT path, ns, name, arg_max(typ, seq) AS last, arg_max(value, seq) AS value FROM ev WHERE ts <= TIMESTAMP '{AT}' GROUP BY ALL)
WHERE last <> 'DELETED'""")
def state_from_kept(spark, sf):
    """State at an instant from a kept state of five days before and the events since."""
    ev, folder = ad.event_records(spark, sf), new_folder(spark, "kept-states")
    keptstate.keep_states(ev, folder, ["2024-01-05 00:00:00", "2024-01-10 00:00:00"])
    return keptstate.state_from_kept(ev, folder, AT).select("path", F.concat_ws("/", "obj_namespace", "name").alias("object_key"), _value().alias("value"))


@query("""
WITH b AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders),
a AS (SELECT k, CASE WHEN k % 7 = 0 THEN p + 100 ELSE p END AS p FROM b WHERE k % 11 <> 0
      UNION ALL SELECT k + 10000000, p FROM b WHERE k % 13 = 0)
SELECT '/api/v1/namespaces/ns' || (COALESCE(b.k, a.k) % 25) || '/orders/o' || COALESCE(b.k, a.k) AS path, b.p AS price_before, a.p AS price_after
FROM b FULL OUTER JOIN a ON a.k = b.k WHERE b.p IS DISTINCT FROM a.p""")
def diff_digest_tree(spark, sf):
    """Two captures kept with digest trees; only branches that differ are opened."""
    before, after = new_folder(spark, "digests-before"), new_folder(spark, "digests-after")
    digesttree.keep_snapshot(ad.order_records(spark, sf), before)
    digesttree.keep_snapshot(ad.order_records(spark, sf, True), after)
    price = lambda c: F.get_json_object(c, "$.price").cast("double")
    return digesttree.diff_kept(spark, before, after).select("path", price("before").alias("price_before"), price("after").alias("price_after"))
