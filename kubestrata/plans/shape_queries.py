"""Capture shaping, discovery, path and detail queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kubestrata.functions import paths as pf
from kubestrata.functions.scalars import http_reason, item_count, line_count, minor_version, reason_slug
from kubestrata.operators import change, dash, graph, overlay, select, shape, timetravel
from kubestrata.plans import adapters as ad
from kubestrata.plans.registry import DAILY, EV, POD, WORK, query, with_
from kubestrata.sources import records as rec

NOW = "2024-02-01 00:00:00"


def _records(df, path, seq, body, code=None):
    return df.select(
        ad.capture_of(seq).alias("capture_id"), path.alias("path"), seq.cast("bigint").alias("seq"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("captured_at"), F.lit(None).cast("string").alias("event_type"),
        (F.lit(200) if code is None else code).alias("response_code"), body.alias("body"))


def _cluster_lists(spark, sf, table=False):
    """One cluster-wide list per part and poll: three objects in two namespaces, one without any."""
    p = ad.table(spark, sf, "part")
    k = F.col("p_partkey")
    item = lambda n, ns: ad.txt('{"metadata":{"name":"', n, '"', *((',"namespace":"ns', ns, '"') if ns is not None else ()), "}}")
    wrap = (lambda x: ad.txt('{"cells":[],"object":', x, "}")) if table else (lambda x: x)
    items = [wrap(item("a", k % 3)), wrap(item("b", k % 3)), wrap(item("c", k % 4 + 3)), wrap(item("d", None))]
    head = '{"kind":"Table","columnDefinitions":[{"name":"Name"}],"rows":[' if table else '{"kind":"PartList","apiVersion":"v1","metadata":{"resourceVersion":"7"},"items":['
    body = ad.txt(head, items[0], ",", items[1], ",", items[2], ",", items[3], "]}")
    return _records(p, ad.txt("/apis/shop/v1/", F.lower("p_type"), "s", "?as=Table" if table else ""), k, body)


_DEMUX = """
SELECT '/apis/shop/v1/namespaces/ns' || ns || '/' || lower(p_type) || 's{suffix}' AS path, p_partkey AS seq, CAST(n AS BIGINT) AS items
FROM (SELECT p_type, p_partkey, p_partkey % 3 AS ns, 2 AS n FROM part UNION ALL SELECT p_type, p_partkey, p_partkey % 4 + 3, 1 FROM part)"""


@query(_DEMUX.format(suffix=""))
def demux_lists(spark, sf):
    """Cluster-wide lists split into per-namespace lists."""
    return shape.demux_lists(_cluster_lists(spark, sf)).select("path", "seq", item_count("body").cast("bigint").alias("items"))


@query(_DEMUX.format(suffix="?as=Table"))
def demux_tables(spark, sf):
    """Cluster-wide Tables split into per-namespace Tables."""
    return shape.demux_tables(_cluster_lists(spark, sf, True)).select("path", "seq", item_count("body").cast("bigint").alias("items"))


@query("SELECT '/apis/shop/v1/' || lower(p_type) || 's?as=Table' AS path, p_partkey AS seq, CAST(0 AS BIGINT) AS items, 'Name' AS first_column FROM part")
def table_schemas(spark, sf):
    """Tables reduced to their column definitions."""
    t = rec.table_schema_rows(_cluster_lists(spark, sf, True))
    return t.select("path", "seq", item_count("body").cast("bigint").alias("items"), F.get_json_object("body", "$.columnDefinitions[0].name").alias("first_column"))


@query("""
SELECT 'list' AS view, CAST(count(*) AS BIGINT) AS records, CAST(sum(4) AS BIGINT) AS items FROM part UNION ALL SELECT 'table', CAST(count(*) AS BIGINT), CAST(sum(4) AS BIGINT) FROM part""")
def payload_kinds(spark, sf):
    """Records and items per payload kind."""
    r = rec.enrich(_cluster_lists(spark, sf).unionByName(_cluster_lists(spark, sf, True)))
    return r.groupBy(F.col("view_kind").alias("view")).agg(F.count("*").alias("records"), F.sum("item_count").alias("items"))


def _discovery(spark, sf):
    """Nations as API groups: each serves two resources and one subresource."""
    n = ad.table(spark, sf, "nation")
    k = F.col("n_nationkey")
    entry = lambda name, ns, kind: ad.txt('{"name":"', name, '","namespaced":', ns, ',"kind":"', kind, '","verbs":["get"', F.when(k % 3 != 1, ',"list"').otherwise(""), "]}")
    body = ad.txt('{"kind":"APIResourceList","resources":[', entry(ad.txt("things", k), k % 2 == 0, ad.txt("Thing", k)), ",",
                  entry(ad.txt("things", k, "/status"), F.lit(True), F.lit("Thing")), ",", entry(F.lit("pods"), F.lit(True), F.lit("Pod")), "]}")
    path = F.when(k == 0, "/api/v1").otherwise(ad.txt("/apis/g", k % 5, ".io/v", k))
    return _records(n, path, k, body, F.when(k % 11 == 10, 500).otherwise(200))


_CAT = """cat AS (
  SELECT CASE WHEN k = 0 THEN '' ELSE 'g' || (k % 5) || '.io' END AS "group", CASE WHEN k = 0 THEN 'v1' ELSE 'v' || k END AS version,
         CASE i WHEN 0 THEN 'things' || k ELSE 'pods' END AS resource, CASE i WHEN 0 THEN k % 2 = 0 ELSE true END AS namespaced,
         CASE i WHEN 0 THEN 'Thing' || k ELSE 'Pod' END AS kind, k % 3 <> 1 AS listable
  FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 11 <> 10), (VALUES (0), (1)) AS v(i))"""


@query(with_(_CAT) + 'SELECT "group", version, resource, namespaced, kind, listable FROM cat')
def api_catalog(spark, sf):
    """Resources from discovery responses; subresources and failed responses skipped."""
    c = shape.api_catalog(_discovery(spark, sf))
    return c.select("group", "version", "resource", "namespaced", "kind", F.array_contains("verbs", "list").alias("listable"))


@query(with_(_CAT) + """SELECT "group", string_agg(version, ',' ORDER BY n DESC) AS versions, arg_max(version, n) AS preferred
FROM (SELECT DISTINCT "group", version, CAST(substr(version, 2) AS INT) AS n FROM cat WHERE "group" <> '') GROUP BY 1""")
def api_groups(spark, sf):
    """Versions of each group, newest first."""
    g = timetravel.api_groups(shape.api_catalog(_discovery(spark, sf)))
    return g.select("group", F.array_join("versions", ",").alias("versions"), "preferred")


@query(with_(_CAT, EV) + """
, seen AS (SELECT DISTINCT '' AS "group", 'v1' AS version, 'widgets' AS resource FROM ev)
SELECT COALESCE(c."group", s."group") AS "group", COALESCE(c.version, s.version) AS version, COALESCE(c.resource, s.resource) AS resource, COALESCE(c.kind, 'Widget') AS kind,
  COALESCE(c.namespaced, true) AS namespaced, CASE WHEN COALESCE(c.resource, s.resource) = 'pods' THEN 'po' ELSE '' END AS short_names, s.resource IS NOT NULL AS captured
FROM cat c FULL OUTER JOIN seen s ON s."group" = c."group" AND s.version = c.version AND s.resource = c.resource""")
def resource_info(spark, sf):
    """Known resources from captured paths and from discovery."""
    info = timetravel.resource_info(ad.event_log(spark, sf).select("capture_id", "path"), shape.api_catalog(_discovery(spark, sf)))
    return info.select("group", "version", "resource", "kind", "namespaced", F.array_join("short_names", ",").alias("short_names"), "captured")


def _directives(spark, sf):
    """Regions as expansion directives, each for cluster-scoped kinds, any kind or namespaced kinds."""
    r, k = ad.table(spark, sf, "region"), F.col("r_regionkey")
    return r.select(k.alias("position"), F.when(k % 3 == 0, "cluster").when(k % 3 == 1, "").otherwise("namespaced").alias("scope"),
                    ad.txt(F.col("r_regionkey") * 10 + 5, "s").alias("interval"), F.array(F.lit("ns1"), F.lit("*")).alias("namespaces"))


def _targets(spark, sf):
    cat = shape.api_catalog(_discovery(spark, sf))
    return shape.expand_targets(cat, cat.filter("resource = 'pods'").select("group", "version", "resource"), _directives(spark, sf), ["g4.io"])


_TARGETS = _CAT + """, directive AS (SELECT r_regionkey AS position, CASE r_regionkey % 3 WHEN 0 THEN 'cluster' WHEN 1 THEN '' ELSE 'namespaced' END AS scope,
  (r_regionkey * 10 + 5) || 's' AS interval FROM region), target AS (
  SELECT "group", version, resource, namespaced, CASE WHEN namespaced THEN (SELECT arg_min(interval, position) FROM directive WHERE scope IN ('', 'namespaced'))
    ELSE (SELECT arg_min(interval, position) FROM directive WHERE scope IN ('', 'cluster')) END AS interval FROM cat WHERE resource <> 'pods' AND "group" <> 'g4.io')"""


@query(with_(_TARGETS) + """SELECT "group", version, resource, interval, CASE WHEN namespaced THEN 'ns1,*' END AS namespaces FROM target""")
def expand_targets(spark, sf):
    """Discovered kinds that no configured target covers, under the first fitting directive."""
    return _targets(spark, sf).select("group", "version", "resource", "interval", F.when(F.col("namespaces").isNotNull(), F.array_join("namespaces", ",")).alias("namespaces"))


@query(with_(_TARGETS) + """
SELECT "group", version, resource, 'ns' || n_nationkey AS namespace FROM target JOIN nation ON true WHERE namespaced UNION ALL SELECT "group", version, resource, NULL FROM target WHERE NOT namespaced""")
def expand_namespaces(spark, sf):
    """Wildcard targets to one row per namespace."""
    return shape.expand_namespaces(_targets(spark, sf), ad.namespaces(spark, sf)).select("group", "version", "resource", "namespace")


@query(with_(_CAT) + """SELECT "group", version, resource FROM cat WHERE listable AND "group" = '' AND resource <> 'pods'""")
def native_listable(spark, sf):
    """Listable kinds of built-in groups without a cluster-wide target."""
    cat = shape.api_catalog(_discovery(spark, sf))
    whole = cat.filter("resource = 'pods'").select("group", "version", "resource", F.array().cast("array<string>").alias("namespaces"))
    return shape.native_listable(cat, whole).select("group", "version", "resource")


@query(with_(EV) + "SELECT path, seq FROM ev WHERE k % 10 = 3")
def integrity_check(spark, sf):
    """Index rows whose record is missing."""
    ev = ad.event_log(spark, sf)
    kept = ev.filter(F.get_json_object("obj", "$.spec.k").cast("int") % 10 != 3)
    return rec.check_capture(kept, ev.select("capture_id", "path", "seq")).select("path", "seq")


# -------------------------------------------------------------------- paths

@query("""
SELECT o_orderkey, CASE k WHEN 0 THEN '' ELSE 'apps' END AS "group", CASE k WHEN 2 THEN 'namespaces' WHEN 1 THEN 'deployments' ELSE 'pods' END AS resource,
  CASE k WHEN 2 THEN '' ELSE 'ns' || (o_custkey % 7) END AS namespace, CASE k WHEN 2 THEN 'ns' || (o_custkey % 7) ELSE 'o' || o_orderkey END AS name,
  CASE k WHEN 0 THEN 'log' WHEN 1 THEN 'scale' ELSE 'status' END AS subresource FROM (SELECT *, o_orderkey % 3 AS k FROM orders)""".replace("CASE k WHEN 0 THEN '' ELSE 'apps' END", "CASE k WHEN 1 THEN 'apps' ELSE '' END"))
def object_paths(spark, sf):
    """Object paths to group, resource, namespace, name and subresource."""
    o = ad.table(spark, sf, "orders")
    ns, k = ad.txt("ns", F.col("o_custkey") % 7), F.col("o_orderkey") % 3
    path = (F.when(k == 0, ad.txt("/api/v1/namespaces/", ns, "/pods/o", F.col("o_orderkey"), "/log?container=c"))
            .when(k == 1, ad.txt("/apis/apps/v1/namespaces/", ns, "/deployments/o", F.col("o_orderkey"), "/scale")).otherwise(ad.txt("/api/v1/namespaces/", ns, "/status")))
    c = o.select("o_orderkey", pf.object_path_cols(path).alias("c"))
    return c.select("o_orderkey", *[F.col(f"c.{f}").alias(f) for f in ("group", "resource", "namespace", "name", "subresource")])


@query("""SELECT 'conv-' || conv_id AS pod, role AS container, turn % 2 = 1 AS previous, CAST(count(*) AS BIGINT) AS logs FROM conversations GROUP BY ALL""")
def log_paths(spark, sf):
    """Log paths to pod, container and variant."""
    c = ad.table(spark, sf, "conversations")
    path = ad.txt("/api/v1/namespaces/chat/pods/conv-", F.col("conv_id"), "/log?container=", F.col("role"), F.when(F.col("turn") % 2 == 1, "&previous=true").otherwise(""))
    p = c.select(pf.log_path_cols(path).alias("p"))
    return p.groupBy("p.pod", "p.container", "p.previous").agg(F.count("*").alias("logs"))


@query("""SELECT conv_id, turn, CAST(CASE WHEN text = '' THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS INT) AS lines,
  trim(regexp_replace(regexp_replace(lower(role || ' ' || (turn % 5) || '!'), '[^a-z0-9]', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, CASE WHEN turn % 2 = 0 THEN turn END AS minor FROM conversations""")
def text_helpers(spark, sf):
    """Line counts, slugs and version minors."""
    c = ad.table(spark, sf, "conversations")
    version = F.when(F.col("turn") % 2 == 0, ad.txt("v1.", F.col("turn"), ".3+")).otherwise("unknown")
    return c.select("conv_id", "turn", line_count("text").alias("lines"), reason_slug(ad.txt(F.col("role"), " ", F.col("turn") % 5, "!")).alias("slug"),
                    minor_version(version).cast("bigint").alias("minor"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'HTTP 403: ' || CASE WHEN length(lang || t) > 300 THEN substr(lang || t, 1, 300) || '...' ELSE lang || t END
  WHEN doc_id % 3 = 1 THEN 'HTTP 500: ' || CASE WHEN length(trim(t, ' ')) > 160 THEN substr(trim(t, ' '), 1, 160) || '...' ELSE trim(t, ' ') END ELSE 'HTTP 404' END AS reason
FROM (SELECT *, regexp_replace(text, '[^A-Za-z ]', 'x', 'g') AS t FROM documents)""")
def http_reasons(spark, sf):
    """Failure texts from status objects and raw bodies."""
    d = ad.table(spark, sf, "documents").withColumn("t", F.regexp_replace("text", "[^A-Za-z ]", "x"))
    k = F.col("doc_id") % 3
    body = F.when(k == 0, ad.txt('{"kind":"Status","message":"', F.col("lang"), F.col("t"), '"}')).when(k == 1, F.col("t")).otherwise("")
    code = F.when(k == 0, 403).when(k == 1, 500).otherwise(404)
    return d.select("doc_id", http_reason(code, body).alias("reason"))


# ------------------------------------------------------------------- detail

@query("SELECT 'part-' || p_partkey AS name, 'shop.example.com/v1' AS api_version, 'Part' AS kind FROM part WHERE p_partkey = 17")
def get_object(spark, sf):
    """One object by name, stamped with its type."""
    o = select.get_object(ad.part_objects(spark, sf), "part-17")
    return o.select("name", F.get_json_object("obj", "$.apiVersion").alias("api_version"), F.get_json_object("obj", "$.kind").alias("kind"))


@query(with_(POD) + """
SELECT name AS pod, 'Owned by' AS title, owner AS name FROM pod UNION ALL SELECT name, 'Mounts ConfigMaps', 'part-' || l_partkey FROM pod
UNION ALL SELECT name, 'Mounts Secrets', 'supp-' || l_suppkey FROM pod WHERE q % 2 = 0 UNION ALL SELECT name, 'Mounts PVCs', 'claim-' || (l_suppkey % 50) FROM pod WHERE q % 3 = 0""")
def pod_relations(spark, sf):
    """Every relation of every pod, titled."""
    pods = ad.pods(spark, sf)
    owned = graph.owner_edges(pods).select(F.col("name").alias("pod"), F.lit("Owned by").alias("title"), F.col("owner_name").alias("name"))
    titles = F.create_map(*[F.lit(x) for x in ("configmap", "Mounts ConfigMaps", "secret", "Mounts Secrets", "persistentvolumeclaim", "Mounts PVCs")])
    return owned.unionByName(graph.mount_edges(pods).select(F.col("name").alias("pod"), titles[F.col("kind")].alias("title"), F.col("target").alias("name")))


@query(with_(POD, WORK) + """
SELECT CAST((SELECT count(*) FROM pod WHERE ns = 'ns3') AS BIGINT) AS pods, CAST((SELECT count(*) FROM work WHERE ns = 'ns3') AS BIGINT) AS workloads,
  CAST((SELECT count(*) FROM customer WHERE c_nationkey = 3) AS BIGINT) AS secrets, CAST((SELECT count(*) FROM pod WHERE ns = 'ns3') + (SELECT count(*) FROM work WHERE ns = 'ns3')
  + 2 * (SELECT count(*) FROM customer WHERE c_nationkey = 3) AS BIGINT) AS resources""")
def namespace_kpis(spark, sf):
    """Headline numbers of one namespace."""
    pods, work = ad.pods(spark, sf), ad.workloads(spark, sf)
    counts = ad.configs(spark, sf).unionByName(ad.claims(spark, sf)).groupBy("capture_id", "namespace", "resource").agg(F.count("*").alias("objects"))
    k = dash.namespace_kpis(counts, pods, work, work.limit(0), "ns3")
    return k.select("pods", "workloads", "secrets", "resources")


@query("SELECT resource, CAST((SELECT count(*) FROM customer WHERE c_nationkey = 3) AS BIGINT) AS objects FROM (VALUES ('secrets'), ('persistentvolumeclaims')) AS v(resource)")
def namespace_tiles(spark, sf):
    """Other kinds of one namespace by count."""
    counts = ad.configs(spark, sf).unionByName(ad.claims(spark, sf)).unionByName(ad.workloads(spark, sf, "deployments")).groupBy("capture_id", "namespace", "resource").agg(F.count("*").alias("objects"))
    return dash.namespace_tiles(counts, "ns3").select("resource", "objects")


@query("SELECT 'w' || p_partkey AS name, CASE WHEN p_size > 25 THEN 'Stopped' ELSE 'Running' END AS status, CASE WHEN p_size > 25 THEN 'warn' ELSE 'good' END AS severity, 'VM' AS kind FROM part")
def vm_rows(spark, sf):
    """Virtual machines with status and severity."""
    p = ad.table(spark, sf, "part")
    ns, name = ad.txt("ns", F.col("p_partkey") % 25), ad.txt("w", F.col("p_partkey"))
    obj = ad.txt('{"metadata":{"name":"', name, '"},"status":{"printableStatus":"', F.when(F.col("p_size") > 25, "Stopped").otherwise("Running"), '"}}')
    vms = p.select(ad.capture_of(F.col("p_partkey")).alias("capture_id"), F.lit("kubevirt.io").alias("group"), F.lit("virtualmachines").alias("resource"), ns.alias("namespace"), name.alias("name"), obj.alias("obj"))
    return dash.vm_rows(vms, NOW).select("name", "status", "severity", "kind")


@query(with_(EV) + """SELECT ns AS namespace, max(seq) + 1 AS rv FROM ev GROUP BY 1""")
def scope_versions(spark, sf):
    """Newest version per overlay scope."""
    return overlay.scope_rv(overlay.compact(ad.change_log(spark, sf))).select(F.col("obj_namespace").alias("namespace"), "rv")


@query(with_(DAILY) + """
, b AS (SELECT path, user_id, value FROM daily WHERE seq = 6), a AS (SELECT path, user_id, value FROM daily WHERE seq = 7)
SELECT 'ns' || (COALESCE(b.user_id, a.user_id) % 10) || '/u' || COALESCE(b.user_id, a.user_id) AS object_key, b.value IS NULL AS before_missing, a.value IS NULL AS after_missing
FROM b FULL OUTER JOIN a ON a.path = b.path AND a.user_id = b.user_id WHERE a.value IS DISTINCT FROM b.value""")
def object_diffs(spark, sf):
    """Objects that differ between two daily lists, from their YAML line diffs."""
    items = ad.daily_items(spark, sf)
    pick = lambda n: items.filter(F.col("seq") == n)
    d = change.object_diff(pick(6), pick(7))
    return d.select("object_key", "before_missing", "after_missing").distinct()


@query("""SELECT o_orderkey AS orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'null' ELSE 'price' END AS added, o_orderkey % 11 = 0 AS gone, false AS new
FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey + 10000000, 'price', false, true FROM orders WHERE o_orderkey % 13 = 0""")
def diff_texts(spark, sf):
    """Line diffs of all orders that changed, went or came between the captures: what the lines added hold."""
    text = change.diff_text(change.diff_captures(ad.order_records(spark, sf), ad.order_records(spark, sf, True)))
    key = F.regexp_extract("path", "/o([0-9]+)$", 1).cast("bigint")
    lines = lambda sign: F.filter(F.split("diff", "\n"), lambda x: x.startswith(sign) & ~x.startswith(sign * 3))
    price = F.exists(lines("+"), lambda x: x.contains('"price"'))
    whole = lambda sign: F.exists(lines(sign), lambda x: x == f"{sign}null")
    return text.select(key.alias("orderkey"), F.when(whole("+"), "null").when(price, "price").alias("added"), whole("+").alias("gone"), whole("-").alias("new"))
