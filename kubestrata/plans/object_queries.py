"""Selection, search, health, dashboard, relationship and redaction queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kubestrata.operators import dash, graph, health, redact, search, select, shape, timetravel
from kubestrata.plans import adapters as ad
from kubestrata.plans.registry import DAILY, EV, POD, WORK, query, with_
from kubestrata.schema import POD_RESOURCES_DDL, POD_RULES_DDL
from kubestrata.session import written

NOW = "2024-02-01 00:00:00"


def union(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


# ---------------------------------------------------------------- selection

@query("""SELECT 'part-' || p_partkey AS name FROM part
WHERE p_brand IN ('Brand#3', 'Brand#7', 'Brand#11') AND p_type <> 'PROMO' AND p_size <= 10""")
def label_filter(spark, sf):
    """Label selector with set, inequality and absence terms."""
    return select.filter_labels(ad.part_objects(spark, sf), "brand in (Brand#3, Brand#7,Brand#11),type!=PROMO,!size").select("name")


@query("""SELECT 'part-' || p_partkey AS name FROM part WHERE p_type NOT IN ('SMALL', 'LARGE') AND p_size > 10 AND p_brand = 'Brand#9'""")
def label_filter_exists(spark, sf):
    """Label selector with notin, equality and existence terms."""
    return select.filter_labels(ad.part_objects(spark, sf), "type notin (SMALL,LARGE),brand==Brand#9,size").select("name")


@query(with_(POD) + "SELECT ns AS namespace, name FROM pod WHERE phase = 'Running' AND 'node-' || l_suppkey <> 'node-7' AND ns = 'ns7'")
def field_filter(spark, sf):
    """Field selector over pods, with an alias and a default."""
    rows = select.filter_fields(ad.pods(spark, sf), "", "pods", "status.phase=Running,spec.host!=node-7,metadata.namespace=ns7,spec.hostNetwork=false")
    return rows.select("namespace", "name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def identity_semi(spark, sf):
    """Table rows whose object survived a selection elsewhere."""
    ns = F.lit("").alias("obj_namespace")
    rows = ad.table(spark, sf, "lineitem").select(F.lit("c0").alias("capture_id"), F.lit("p").alias("path"), ns, F.col("l_orderkey").cast("string").alias("name"),
                                                  "l_orderkey", "l_linenumber", "l_partkey")
    keep = ad.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.lit("c0").alias("capture_id"), F.lit("p").alias("path"), ns, F.col("o_orderkey").cast("string").alias("name"))
    return select.filter_rows_by_identity(rows, keep).select("l_orderkey", "l_linenumber", "l_partkey")


@query(with_(POD) + """SELECT ns AS namespace, name, 'PartialObjectMetadata' AS kind, l_returnflag AS flag, NULL::VARCHAR AS phase FROM pod""")
def metadata_projection(spark, sf):
    """Objects reduced to their metadata."""
    m = select.project_metadata(ad.pods(spark, sf))
    o = F.from_json("obj", "kind string, metadata struct<name: string, labels: struct<flag: string>>, status struct<phase: string>")
    return m.select("namespace", o.alias("o")).select("namespace", "o.metadata.name", "o.kind", "o.metadata.labels.flag", "o.status.phase")


@query(with_(WORK) + """SELECT name, 'apps/v1' AS api_version, CASE resource WHEN 'deployments' THEN 'Deployment' WHEN 'statefulsets' THEN 'StatefulSet'
  WHEN 'daemonsets' THEN 'DaemonSet' WHEN 'jobs' THEN 'Job' WHEN 'replicasets' THEN 'ReplicaSet' ELSE 'CronJob' END AS kind FROM work""")
def type_stamp(spark, sf):
    """Missing apiVersion and kind restored from the path."""
    s = select.stamp_type(ad.workloads(spark, sf))
    return s.select("name", F.get_json_object("obj", "$.apiVersion").alias("api_version"), F.get_json_object("obj", "$.kind").alias("kind"))


@query("SELECT 'claim-' || c_custkey AS name FROM customer WHERE c_nationkey = 4")
def namespace_scope(spark, sf):
    """A cluster list narrowed to one namespace."""
    return select.in_namespace(ad.claims(spark, sf), "ns4").select("name")


def _part_tables(spark, sf):
    p = ad.dealt(ad.table(spark, sf, "part"), "p_partkey")
    row = lambda n, t: ad.txt('{"cells":["', n, '"],"object":{"metadata":{"name":"', n, '","labels":{"type":"', t, '"}}}}')
    n = ad.txt("part-", F.col("p_partkey"))
    body = ad.txt('{"kind":"Table","columnDefinitions":[{"name":"Name","type":"string"}],"rows":[', row(n, F.col("p_type")), ",", row(ad.txt(n, "x"), F.lit("SMALL")), "]}")
    return p.select(F.lit("c0").alias("capture_id"), ad.txt("/apis/shop.example.com/v1/namespaces/ns", F.col("p_partkey"), "/parts?as=Table").alias("path"),
                    F.lit(0).alias("seq"), F.lit("2024-01-01").cast("timestamp_ntz").alias("captured_at"), F.lit(None).cast("string").alias("event_type"),
                    F.lit(200).alias("response_code"), body.alias("body"))


@query("""SELECT name FROM (SELECT 'part-' || p_partkey AS name, p_type AS t FROM part UNION ALL SELECT 'part-' || p_partkey || 'x', 'SMALL' FROM part) WHERE t = 'SMALL'""")
def table_row_filter(spark, sf):
    """Label filter on the objects inside Table rows."""
    return select.filter_table_rows(select.table_rows(_part_tables(spark, sf)), "type=SMALL").select("name")


@query("""SELECT 'part-' || p_partkey AS name, 'Name' AS first_column FROM part UNION ALL SELECT 'part-' || p_partkey || 'x', 'Name' FROM part""")
def aggregate_tables(spark, sf):
    """Per-namespace Tables of one resource as one table."""
    t = timetravel.aggregate_tables(_part_tables(spark, sf), "shop.example.com", "v1", "parts")
    return t.select("name", F.get_json_object("column_definitions", "$[0].name").alias("first_column"))


# ------------------------------------------------------------------- search

@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE CAST(json_extract(props, '$.k') AS INT) > 50")
def jsonpath_scalar(spark, sf):
    """One JSONPath value per change object, filtered."""
    ev = ad.event_log(spark, sf).select("capture_id", "path", F.lit("").alias("group"), F.lit("v1").alias("version"), F.lit("widgets").alias("resource"),
                                        "obj_namespace", F.col("obj_namespace").alias("namespace"), F.col("seq").cast("string").alias("name"), F.lit(True).alias("decodable"), "obj")
    hits = search.query(ev, "{.spec.k}")
    return hits.filter(F.col("value").cast("int") > 50).select(F.col("name").cast("bigint").alias("event_id"), "value")


@query("""SELECT 'part-' || p_partkey AS name, n, CAST(v AS VARCHAR) AS value FROM part, (VALUES (0), (1)) AS i(n),
  LATERAL (SELECT CASE n WHEN 0 THEN p_size ELSE p_size % 7 END AS v)""")
def jsonpath_array(spark, sf):
    """Every element of an array."""
    return search.query(ad.part_objects(spark, sf), "{.spec.items[*].qty}").select("name", F.col("n").cast("int").alias("n"), "value")


@query("""SELECT 'part-' || p_partkey AS name, '"a"' AS value FROM part WHERE p_size > 5 UNION ALL SELECT 'part-' || p_partkey, '"b"' FROM part WHERE p_size % 7 > 5""")
def jsonpath_filter(spark, sf):
    """Array elements that satisfy a predicate."""
    return search.query(ad.part_objects(spark, sf), "{.spec.items[?(@.qty>5)].n}").select("name", "value")


@query("""SELECT 'part-' || p_partkey AS name, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT 'part-' || p_partkey, CAST(p_size % 7 AS VARCHAR) FROM part""")
def jsonpath_deep(spark, sf):
    """Recursive descent."""
    return search.query(ad.part_objects(spark, sf), "{..qty}").select("name", "value")


@query("""SELECT doc_id, CAST(octet_length(encode(substr(text, 1, strpos(text, 'token') - 1))) AS BIGINT) AS byte_start FROM documents WHERE contains(text, 'token')""")
def text_search(spark, sf):
    """Documents containing a word, with the byte offset of the first hit."""
    return search.search_strings(ad.table(spark, sf, "documents"), "text", "token").select("doc_id", "byte_start")


@query("""SELECT 'doc-' || doc_id AS name, field, CAST(octet_length(encode(substr(t, 1, strpos(t, 'de') - 1))) AS BIGINT) AS byte_start
FROM (SELECT doc_id, 'spec.text' AS field, text AS t FROM documents UNION ALL SELECT doc_id, 'spec.lang', lang FROM documents) WHERE contains(t, 'de')""")
def leaf_search(spark, sf):
    """Substring search over every string leaf of the objects."""
    return search.search_text(ad.documents_as_objects(spark, sf), "de").select("name", "field", "byte_start")


@query("""SELECT 'part-' || p_partkey AS name, CAST(6 + CAST(p_size > 10 AS INT) AS BIGINT) AS leaves FROM part""")
def leaf_walk(spark, sf):
    """Number of string leaves per object."""
    return search.leaves(ad.part_objects(spark, sf).select("name", "obj")).groupBy("name").agg(F.count("*").alias("leaves"))


@query(r"""SELECT page_id, regexp_extract(html, 'href="/([a-z]+)"', 0) AS hit FROM pages WHERE regexp_matches(html, 'href="/([a-z]+)"')""")
def regex_search(spark, sf):
    """Pages matching a regular expression, with the first match."""
    pattern = 'href="/([a-z]+)"'
    before, match = search.first_match("html", pattern, True)
    p = ad.table(spark, sf, "pages").filter(F.col("html").rlike(pattern))
    return p.select("page_id", match.alias("hit"))


@query("""SELECT conv_id, role, turn, CAST(n AS INT) AS line_no FROM (
  SELECT conv_id, role, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM conversations)
WHERE contains(line, 'en')""")
def log_search(spark, sf):
    """Lines of container logs containing a substring."""
    hits = search.search_strings(ad.log_line_rows(spark, sf), "line", "en")
    return hits.select("conv_id", F.col("container").alias("role"), "turn", "line_no")


@query("SELECT doc_id, n_chars, CAST((SELECT count(*) FROM documents) AS BIGINT) AS total, (SELECT count(*) FROM documents) > 500 AS truncated FROM documents ORDER BY n_chars DESC, doc_id LIMIT 500")
def limit_total(spark, sf):
    """A page of 500 rows with the full total."""
    d = ad.table(spark, sf, "documents").select("doc_id", "n_chars")
    return search.limit_with_total(d, [F.desc("n_chars"), "doc_id"], 500)


@query("""SELECT 'u' || user_id AS name, CASE event_type WHEN 'error' THEN 'bad' WHEN 'purchase' THEN 'warn' ELSE 'normal' END AS severity, ts AS time,
  event_id % 7 AS count FROM events WHERE user_id % 10 = 3""")
def events_for(spark, sf):
    """Event objects of a namespace with time and severity."""
    rows = search.events_for(ad.kube_events(spark, sf), "ns3", "Pod")
    return rows.select("name", "severity", "time", F.col("count").cast("bigint").alias("count"))


# ------------------------------------------------------------------- health

@query(with_(POD) + "SELECT ns AS namespace, name, phase, issues, ready, total, restarts FROM podi")
def pod_health(spark, sf):
    """Phase, issues, readiness and restarts of every pod."""
    h = health.pod_health(ad.pods(spark, sf), containers=False)
    return h.select("namespace", "name", "phase", F.array_join("issues", ",").alias("issues"), "ready", "total", "restarts")


_FOUND = POD + """, issue AS (
  SELECT ns, owner, unnest(string_split(issues, ',')) AS reason FROM podi WHERE issues <> ''), pod_found AS (
  SELECT CASE reason WHEN 'CrashLoopBackOff' THEN 'pod.crashloopbackoff' WHEN 'OOMKilled' THEN 'pod.oomkilled' WHEN 'Error' THEN 'pod.container-error'
              WHEN 'Failed' THEN 'pod.failed' ELSE 'pod.unknown' END AS rule_id,
         CASE WHEN reason IN ('CrashLoopBackOff', 'OOMKilled') THEN 'critical' ELSE 'warning' END AS severity, 'workload' AS category,
         ns AS namespace, owner AS name, CAST(count(*) AS BIGINT) AS count, reason AS evidence FROM issue GROUP BY ALL), sched AS (
  SELECT 'scheduling.unschedulable' AS rule_id, 'warning' AS severity, 'scheduling' AS category, ns AS namespace, owner AS name,
         CAST(count(*) AS BIGINT) AS count, 'insufficient cpu' AS evidence FROM pod WHERE phase = 'Pending' AND l_discount >= 0.08 GROUP BY ALL), lacking AS (
  SELECT 'workload.no-requests' AS rule_id, 'warning' AS severity, 'workload' AS category, ns AS namespace, owner AS name, CAST(count(*) AS BIGINT) AS count,
         'a container has no resources.requests' AS evidence FROM pod WHERE l_tax < 0.04 GROUP BY ALL
  UNION ALL SELECT 'workload.no-limits', 'info', 'workload', ns, owner, CAST(count(*) AS BIGINT), 'a container has no resources.limits' FROM pod
  WHERE l_partkey % 3 <> 0 GROUP BY ALL), pvc AS (
  SELECT 'storage.pvc-unbound' AS rule_id, 'warning' AS severity, 'storage' AS category, 'ns' || c_nationkey AS namespace, 'claim-' || c_custkey AS name,
         CAST(1 AS BIGINT) AS count, 'phase=' || CASE c_mktsegment WHEN 'BUILDING' THEN 'Pending' ELSE 'Lost' END || ', storageClass='
         || CASE WHEN c_custkey % 3 <> 0 THEN 'sc-' || (c_custkey % 4) ELSE '(default)' END AS evidence
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), skew AS (
  SELECT 'cluster.version-skew' AS rule_id, 'warning' AS severity, 'cluster' AS category, '' AS namespace, 'node-' || s_suppkey AS name, CAST(1 AS BIGINT) AS count,
         'control plane v1.30.2, kubelet v1.' || (20 + s_suppkey % 12) || '.3 (' || abs(10 - s_suppkey % 12) || ' minor versions apart)' AS evidence
  FROM supplier WHERE abs(10 - s_suppkey % 12) >= 3), """ + WORK + """, short AS (
  SELECT 'workload.replicas-unavailable' AS rule_id, 'warning' AS severity, 'workload' AS category, ns AS namespace, name, CAST(1 AS BIGINT) AS count,
         have || '/' || want || CASE resource WHEN 'daemonsets' THEN ' nodes ready' ELSE ' replicas ready' END AS evidence
  FROM (SELECT *, CASE resource WHEN 'daemonsets' THEN p_size ELSE COALESCE(replicas, 1) END AS want FROM work
        WHERE resource IN ('deployments', 'statefulsets', 'replicasets', 'daemonsets')) WHERE want > 0 AND have < want), cond AS (
  SELECT 'node.not-ready' AS rule_id, 'critical' AS severity, 'node' AS category, '' AS namespace, 'node-' || s_suppkey AS name, CAST(1 AS BIGINT) AS count,
         'Ready condition is False' AS evidence FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT 'node.pressure', 'warning', 'node', '', 'node-' || s_suppkey, CAST(1 AS BIGINT), 'DiskPressure is True' FROM supplier WHERE s_suppkey % 7 = 0)"""

_FIND = ["rule_id", "severity", "category", "namespace", "name", "count", "evidence"]


@query(with_(_FOUND) + "SELECT * FROM pod_found")
def find_pod_health(spark, sf):
    """Pod findings per rule, namespace and owner."""
    return health.find_pod_health(health.parse_pods(ad.pods(spark, sf))).select(*_FIND)


@query(with_(_FOUND) + "SELECT * FROM sched")
def find_unschedulable(spark, sf):
    """Pending pods the scheduler refused."""
    return health.find_unschedulable(health.parse_pods(ad.pods(spark, sf), POD_RULES_DDL)).select(*_FIND)


@query(with_(_FOUND) + "SELECT * FROM lacking")
def find_missing_resources(spark, sf):
    """Owners with containers lacking requests or limits."""
    return health.find_missing_resources(health.parse_pods(ad.pods(spark, sf), POD_RESOURCES_DDL)).select(*_FIND)


@query(with_(_FOUND) + "SELECT * FROM pvc")
def find_unbound_pvc(spark, sf):
    """Claims that are not bound."""
    return health.find_unbound_pvc(ad.claims(spark, sf)).select(*_FIND)


@query(with_(_FOUND) + "SELECT * FROM skew")
def version_skew(spark, sf):
    """Nodes too far from the control plane's version."""
    return health.find_version_skew(ad.nodes(spark, sf), ad.captures(spark, sf)).select(*_FIND)


@query(with_(_FOUND) + "SELECT * FROM short")
def replica_shortfall(spark, sf):
    """Workloads with fewer ready replicas than wanted."""
    return health.find_replica_shortfall(ad.workloads(spark, sf)).select(*_FIND)


@query(with_(_FOUND) + "SELECT * FROM cond")
def node_conditions(spark, sf):
    """Nodes not ready or under pressure."""
    return health.find_node_conditions(ad.nodes(spark, sf)).select(*_FIND)


@query("""
WITH p AS (SELECT '/apis/' || CASE p_type WHEN 'STANDARD' THEN 'apps/v1beta1' WHEN 'PROMO' THEN 'batch/v1beta1' WHEN 'SMALL' THEN 'extensions/v1beta1' ELSE 'apps/v1' END
  || '/namespaces/ns' || (p_partkey % 25) || '/things' || (p_size % 3) AS path FROM part)
SELECT split_part(path, '/', 3) || '/' || split_part(path, '/', 4) AS api, split_part(path, '/', 7) AS kind, min(path) AS path FROM p
WHERE split_part(path, '/', 4) = 'v1beta1' GROUP BY 1, 2""")
def deprecated_api(spark, sf):
    """Deprecated group versions among the captured paths."""
    p = ad.table(spark, sf, "part")
    gv = F.when(F.col("p_type") == "STANDARD", "apps/v1beta1").when(F.col("p_type") == "PROMO", "batch/v1beta1").when(F.col("p_type") == "SMALL", "extensions/v1beta1").otherwise("apps/v1")
    idx = p.select(F.lit("c0").alias("capture_id"), ad.txt("/apis/", gv, "/namespaces/ns", F.col("p_partkey") % 25, "/things", F.col("p_size") % 3).alias("path"))
    return health.find_deprecated_api(idx).select(F.substring_index("evidence", " ", 1).alias("api"), "kind", "path")


@query(with_(_FOUND) + """
SELECT * FROM (SELECT * FROM pod_found UNION ALL SELECT * FROM sched UNION ALL SELECT * FROM lacking UNION ALL SELECT * FROM pvc UNION ALL SELECT * FROM skew
  UNION ALL SELECT * FROM short UNION ALL SELECT * FROM cond) WHERE severity <> 'info'
ORDER BY severity = 'critical' DESC, category, rule_id, namespace, name""")
def findings_report(spark, sf):
    """All rules over one state, at least warnings, worst first."""
    objects = union(ad.pods(spark, sf), ad.claims(spark, sf), ad.nodes(spark, sf), ad.workloads(spark, sf))
    return health.diagnose(objects, captures=ad.captures(spark, sf), min_severity="warning").select(*_FIND)


@query(with_(_FOUND) + """
SELECT 'c0' AS capture_id, CAST(count(*) FILTER (severity = 'critical') AS BIGINT) AS critical, CAST(count(*) FILTER (severity = 'warning') AS BIGINT) AS warning,
  CAST(count(*) FILTER (severity = 'info') AS BIGINT) AS info FROM (SELECT * FROM pod_found UNION ALL SELECT * FROM sched UNION ALL SELECT * FROM lacking)""")
def findings_summary(spark, sf):
    """Number of findings per severity."""
    return health.summary(health.diagnose(ad.pods(spark, sf)))


@query(with_(POD) + """, u AS (
  SELECT ns, name, restarts, CASE WHEN regexp_matches(h, '[a-z]') AND regexp_matches(h, '[0-9]') AND l_orderkey % 500 >= 100 THEN 'app-*' ELSE 'app-o' || (l_orderkey % 500) || '-*' END AS prefix,
    CASE WHEN main_issue = 'CrashLoopBackOff' THEN main_issue WHEN init_issue IS NOT NULL THEN init_issue WHEN main_issue IS NOT NULL THEN main_issue ELSE phase_issue END AS reason
  FROM podi WHERE issues <> ''), g AS (
  SELECT ns, prefix, reason, count(*) AS n, sum(restarts) AS r, min(name) AS one FROM u GROUP BY ALL)
SELECT ns AS namespace, reason, CASE WHEN n > 1 THEN prefix ELSE one END AS title, CAST(n AS BIGINT) AS count, CAST(r AS BIGINT) AS restarts,
  CASE WHEN reason = 'Unknown' THEN 'warn' ELSE 'bad' END AS severity,
  CASE WHEN reason = 'CrashLoopBackOff' AND n > 1 THEN reason || ' · ' || r || ' restarts across ' || n || ' pods'
       WHEN reason IN ('CrashLoopBackOff', 'OOMKilled') THEN reason || ' · ' || r || ' restarts' WHEN reason = 'Failed' THEN 'Pod phase = Failed' ELSE reason END AS subtitle
FROM g""")
def issue_grouping(spark, sf):
    """Unhealthy pods by name stem and dominant reason."""
    h = health.pod_health(ad.pods(spark, sf), containers=False)
    return health.issues(h, n=None).select("namespace", "reason", "title", "count", "restarts", "severity", "subtitle")


# --------------------------------------------------------------- dashboards

@query("""
WITH r AS (SELECT p_partkey AS seq, '/apis/shop/v' || (p_size % 2 + 1) || CASE WHEN p_size % 3 = 0 THEN '/' ELSE '/namespaces/ns' || (p_partkey % 7) || '/' END || lower(p_type) || 's' AS path,
  p_size % 2 + 1 AS v, lower(p_type) || 's' AS resource, CASE WHEN p_size % 3 <> 0 THEN 'ns' || (p_partkey % 7) END AS pns, 'n' || (p_partkey % 5) AS ins, CASE WHEN p_size % 10 = 9 THEN 403 ELSE 200 END AS code FROM part),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS rn FROM r) WHERE rn = 1 AND code = 200),
s AS (SELECT v, resource, string_agg(ns, ',' ORDER BY ns) AS namespaces FROM (SELECT v, resource, pns AS ns FROM l WHERE pns IS NOT NULL UNION SELECT v, resource, ins FROM l) GROUP BY ALL)
SELECT 'v' || r.v AS version, r.resource, CAST(count(*) AS BIGINT) AS records, CAST(COALESCE((SELECT 2 * count(*) FROM l WHERE l.v = r.v AND l.resource = r.resource), 0) AS BIGINT) AS items,
  COALESCE(any_value(s.namespaces), '') AS namespaces FROM r LEFT JOIN s ON s.v = r.v AND s.resource = r.resource GROUP BY r.v, r.resource""")
def inspect(spark, sf):
    """Records, items and namespaces per resource."""
    p = ad.table(spark, sf, "part")
    scope = F.when(F.col("p_size") % 3 == 0, "/").otherwise(ad.txt("/namespaces/ns", F.col("p_partkey") % 7, "/"))
    item = ad.txt('{"metadata":{"namespace":"n', F.col("p_partkey") % 5, '"}}')
    recs = p.select(F.lit("c0").alias("capture_id"), ad.txt("/apis/shop/v", F.col("p_size") % 2 + 1, scope, F.lower("p_type"), "s").alias("path"), F.col("p_partkey").alias("seq"),
                    F.lit("2024-01-01").cast("timestamp_ntz").alias("captured_at"), F.lit(None).cast("string").alias("event_type"),
                    F.when(F.col("p_size") % 10 == 9, 403).otherwise(200).alias("response_code"), ad.txt('{"items":[', item, ",", item, "]}").alias("body"))
    return dash.inspect(recs).select("version", "resource", "records", "items", F.array_join("namespaces", ",").alias("namespaces"))


def _counts(objects: DataFrame) -> DataFrame:
    return objects.filter("namespace <> ''").groupBy("capture_id", "namespace", "resource").agg(F.count("*").alias("objects"))


@query(with_(WORK) + """SELECT resource, CAST(count(*) AS BIGINT) AS objects FROM work GROUP BY 1 UNION ALL SELECT 'nodes', CAST(count(*) AS BIGINT) FROM supplier WHERE s_suppkey % 2 = 0""")
def resource_totals(spark, sf):
    """Objects per resource, cluster totals only where nothing is namespaced."""
    cluster = ad.table(spark, sf, "supplier").groupBy(F.when(F.col("s_suppkey") % 2 == 0, "nodes").otherwise("jobs").alias("resource")).agg(F.count("*").alias("objects"))
    return dash.resource_totals(_counts(ad.workloads(spark, sf)), cluster.withColumn("capture_id", F.lit("c0"))).select("resource", "objects")


@query(with_(POD, WORK) + """
SELECT CAST((SELECT count(*) FROM nation) AS BIGINT) AS namespaces, CAST((SELECT count(*) FROM work WHERE resource <> 'cronjobs') AS BIGINT) AS workloads, CAST(count(*) AS BIGINT) AS pods,
  CAST(0 AS BIGINT) AS virtual_machines, CAST(count(*) FILTER (issues <> '') AS BIGINT) AS unhealthy_pods, CAST(count(*) FILTER (main_issue = 'CrashLoopBackOff') AS BIGINT) AS crash_loop,
  CAST(count(*) FILTER (phase = 'Failed') AS BIGINT) AS failed, CAST(count(init_issue) AS BIGINT) AS oom_killed, CAST(count(*) FILTER (issues <> '' AND phase = 'Pending') AS BIGINT) AS pending,
  CAST((SELECT count(*) FROM events) AS BIGINT) AS watch_events FROM podi""")
def overview_kpis(spark, sf):
    """Headline numbers of the cluster."""
    pods = ad.pods(spark, sf)
    counts = _counts(union(ad.workloads(spark, sf), pods))
    return dash.overview_kpis(counts, health.pod_health(pods, containers=False), ad.namespaces(spark, sf), ad.event_log(spark, sf)).drop("capture_id")


@query(with_(POD, WORK) + """
, r AS (SELECT ns, count(*) AS n, count(*) FILTER (resource <> 'cronjobs') AS w, 0 AS p, 0 AS u FROM work GROUP BY ns
  UNION ALL SELECT ns, count(*), 0, count(*), count(*) FILTER (issues <> '') FROM podi GROUP BY ns
  UNION ALL SELECT 'ns' || n_nationkey, 0, 0, 0, 0 FROM nation UNION ALL SELECT 'empty' || n_nationkey, 0, 0, 0, 0 FROM nation)
SELECT ns AS namespace, CAST(sum(n) AS BIGINT) AS resources, CAST(sum(w) AS BIGINT) AS workloads, CAST(sum(p) AS BIGINT) AS pods, CAST(sum(u) AS BIGINT) AS unhealthy FROM r GROUP BY ns""")
def namespace_summary(spark, sf):
    """Counts per namespace, empty ones included."""
    pods = ad.pods(spark, sf)
    known = ad.namespaces(spark, sf).select("capture_id", F.col("name").alias("namespace"))
    known = known.unionByName(known.withColumn("namespace", F.regexp_replace("namespace", "^ns", "empty")))
    return dash.namespace_summary(_counts(union(ad.workloads(spark, sf), pods)), health.pod_health(pods, containers=False), known).drop("capture_id")


@query("SELECT 'ns' || (l_suppkey % 25) AS namespace, CAST(count(*) AS BIGINT) AS resources FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def top_namespaces(spark, sf):
    """The 8 largest namespaces."""
    pods = ad.pods(spark, sf)
    return dash.top_namespaces(dash.namespace_summary(_counts(pods), health.pod_health(pods, containers=False))).select("namespace", "resources")


_TILE = ["pods", "services", "widgets", "gadgets", "secrets", "leases", "jobs", "gears", "bolts", "nuts", "events"]


@query(f"""
WITH t AS (SELECT {_TILE!r}[p_size % 11 + 1] AS resource, count(*) AS objects FROM part GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY objects DESC, resource) AS rn FROM t WHERE resource NOT IN ('pods', 'services', 'secrets'))
SELECT resource, CAST(objects AS BIGINT) AS objects, NULL::VARCHAR AS more FROM t WHERE resource IN ('pods', 'services', 'secrets')
UNION ALL SELECT resource, CAST(objects AS BIGINT), NULL FROM o WHERE rn <= 4 UNION ALL SELECT '', 0, '+ ' || (count(*) - 4) || ' more…' FROM o HAVING count(*) > 4""")
def resource_tiles(spark, sf):
    """Preferred kinds, the next largest, and how many more."""
    names = F.element_at(F.array(*[F.lit(t) for t in _TILE]), F.col("p_size") % 11 + 1)
    totals = ad.table(spark, sf, "part").groupBy(F.lit("c0").alias("capture_id"), names.alias("resource")).agg(F.count("*").alias("objects"))
    return dash.resource_tiles(totals).select("resource", "objects", F.when(F.col("resource") == "", F.col("kind")).alias("more"))


_SPARK = """
, w AS (SELECT min(ts) AS t0, max(ts) AS t1, CAST(floor(date_diff('microsecond', min(ts), max(ts)) / 30) AS BIGINT) AS step FROM events),
h AS (SELECT least(29, CAST(floor(date_diff('microsecond', t0, ts) / step) AS INT)) AS bucket, typ FROM ev, w {where})
SELECT b.bucket, CAST(count(typ) AS BIGINT) AS total, CAST(count(*) FILTER (typ = 'MODIFIED') AS BIGINT) AS warn, CAST(count(*) FILTER (typ = 'DELETED') AS BIGINT) AS bad
FROM (SELECT CAST(unnest(range(30)) AS INT) AS bucket) b LEFT JOIN h ON h.bucket = b.bucket GROUP BY b.bucket"""


def _pod_events(spark, sf):
    return ad.event_log(spark, sf).withColumn("path", F.replace("path", F.lit("widgets"), F.lit("pods")))


@query(with_(EV) + _SPARK.format(where=""))
def activity_histogram(spark, sf):
    """Changes in 30 equal slices of the capture window."""
    return dash.activity(_pod_events(spark, sf), ad.captures(spark, sf)).select("bucket", "total", "warn", "bad")


@query(with_(EV) + _SPARK.format(where="WHERE user_id % 10 = 3 AND name = 'u13'"))
def activity_pod(spark, sf):
    """The same for one pod."""
    return dash.activity(_pod_events(spark, sf), ad.captures(spark, sf), namespace="ns3", pod="u13").select("bucket", "total", "warn", "bad")


@query(with_(POD) + f"""
SELECT ns AS namespace, name, COALESCE(first_issue, CASE WHEN phase = 'Running' AND ready < total THEN 'NotReady' ELSE phase END) AS status,
  CASE WHEN issues <> '' THEN 'bad' WHEN (phase = 'Running' AND ready < total) OR phase = 'Pending' THEN 'warn' ELSE 'good' END AS severity,
  ready || '/' || total AS ready, restarts, CASE WHEN l_shipdate > TIMESTAMP '{NOW}' THEN '0s' ELSE date_diff('day', l_shipdate, TIMESTAMP '{NOW}') || 'd' END AS age FROM podi""")
def pod_rows(spark, sf):
    """Pod list rows with status, severity and age."""
    return dash.pod_rows(ad.pods(spark, sf), NOW).select("namespace", "name", "status", "severity", "ready", "restarts", "age")


@query(with_(WORK) + """
SELECT ns AS namespace, name, resource, CASE resource WHEN 'cronjobs' THEN 'Scheduled' WHEN 'jobs' THEN CASE WHEN p_partkey % 9 = 0 THEN 'Failed: 1' ELSE 'Succeeded: ' || have END
    ELSE have || '/' || w || ' Ready' END AS status,
  CASE resource WHEN 'cronjobs' THEN 'good' WHEN 'jobs' THEN CASE WHEN p_partkey % 9 = 0 THEN 'bad' ELSE 'good' END
    ELSE CASE WHEN w = 0 THEN 'neutral' WHEN have = 0 THEN 'bad' WHEN have < w THEN 'warn' ELSE 'good' END END AS severity, '30d' AS age
FROM (SELECT *, CASE resource WHEN 'daemonsets' THEN p_size ELSE COALESCE(replicas, 0) END AS w FROM work)""")
def workload_rows(spark, sf):
    """Workload list rows with status and severity."""
    return dash.workload_rows(ad.workloads(spark, sf), NOW).select("namespace", "name", "resource", "status", "severity", "age")


@query(with_(POD) + """
SELECT name, CASE WHEN issues <> '' THEN 'bad' WHEN ready < total THEN 'warn' ELSE 'good' END AS severity,
  COALESCE(first_issue || ' · ' || restarts || ' restarts', CASE WHEN ready < total THEN 'Some containers not ready · ' || restarts || ' restarts'
    ELSE ready || '/' || total || ' containers ready · ' || restarts || ' restarts' END) AS subtitle, 'node-' || l_suppkey AS node FROM podi""")
def pod_headline(spark, sf):
    """One-line verdict per pod."""
    return dash.pod_headline(ad.pods(spark, sf), NOW).select("name", "severity", "subtitle", "node")


@query(with_(POD) + """
, cpu AS (SELECT *, CASE WHEN l_tax >= 0.04 THEN q || 'm' ELSE '' END AS cpu, CASE WHEN l_partkey % 3 = 0 THEN q || 'Mi' ELSE '' END AS mem FROM pod)
SELECT name AS pod, 'main' AS container, 'main' AS role, 'part:' || l_partkey AS image, cpu AS cpu_request, mem AS memory_limit,
  CASE l_returnflag WHEN 'N' THEN 'Running · ' || restarts || ' restarts' WHEN 'R' THEN 'CrashLoopBackOff · ' || restarts || ' restarts' ELSE 'Terminated · Error · exit 1' END AS state_badge,
  CASE WHEN l_returnflag = 'R' THEN 'bad' WHEN l_returnflag = 'A' AND l_linestatus <> 'O' THEN 'bad' WHEN restarts > 0 THEN 'warn' ELSE 'good' END AS severity FROM cpu
UNION ALL SELECT name, 'envoy', 'side', 'envoy:1', cpu, mem, 'Running · 0 restarts', 'good' FROM cpu WHERE l_linenumber % 3 = 0
UNION ALL SELECT name, 'setup', 'init', 'setup:1', cpu, mem, CASE WHEN q % 7 = 0 THEN 'Terminated · OOMKilled · exit 137' ELSE 'Terminated · Completed · exit 0' END,
  CASE WHEN q % 7 = 0 THEN 'bad' ELSE 'good' END FROM cpu WHERE l_linenumber % 4 = 0""")
def container_cards(spark, sf):
    """Container status joined to its spec."""
    return dash.container_cards(ad.pods(spark, sf)).select("pod", "container", "role", "image", "cpu_request", "memory_limit", "state_badge", "severity")


@query(with_(POD) + """SELECT name, 'rs-' || (l_orderkey % 500) AS owner_name, 'part-' || l_partkey AS configmaps, CASE WHEN q % 2 = 0 THEN 'supp-' || l_suppkey ELSE '' END AS secrets,
  CASE WHEN q % 3 = 0 THEN 'claim-' || (l_suppkey % 50) ELSE '' END AS claims FROM pod""")
def pod_related(spark, sf):
    """Owner and mounted volumes of each pod."""
    j = lambda c: F.array_join(c, ",").alias(c)
    return dash.pod_related(ad.pods(spark, sf)).select("name", "owner_name", j("configmaps"), j("secrets"), j("claims"))


@query(with_(POD) + "SELECT name, l_shipdate AS created_at, CASE WHEN phase = 'Pending' AND l_discount >= 0.08 THEN 'PodScheduled:bad' END AS condition, l_returnflag AS flag FROM pod")
def pod_meta(spark, sf):
    """Conditions, labels and creation time of each pod."""
    c = F.get("conditions", F.lit(0))
    return dash.pod_meta(ad.pods(spark, sf)).select("name", "created_at", F.concat_ws(":", c["type"], c["severity"]).alias("condition"), F.element_at("labels", "flag").alias("flag")).withColumn(
        "condition", F.nullif("condition", F.lit("")))


@query("""SELECT 'ns' || n_nationkey AS name, TIMESTAMP '2024-01-01' AS created_at, '31d' AS age, CASE WHEN n_nationkey % 10 = 9 THEN 'Terminating' ELSE 'Active' END AS phase,
  CAST(n_regionkey AS VARCHAR) AS region FROM nation""")
def namespace_meta(spark, sf):
    """Namespace facts."""
    m = dash.namespace_meta(ad.namespaces(spark, sf), NOW)
    return m.select("name", "created_at", "age", "phase", F.element_at("labels", "region").alias("region"))


@query("SELECT 'ns' || c_nationkey AS namespace, 'claim-' || c_custkey AS name, '31d' AS age FROM customer")
def object_rows(spark, sf):
    """All objects of one kind."""
    return dash.object_rows(ad.claims(spark, sf), "persistentvolumeclaims", NOW).select("namespace", "name", "age")


@query(with_(DAILY) + """
SELECT 'sessions' AS resource, true AS namespaced, CAST((SELECT count(*) FROM daily JOIN (SELECT path, max(seq) AS seq FROM daily WHERE seq <= 13 GROUP BY path) USING (path, seq)) AS BIGINT) AS objects""")
def resource_catalog(spark, sf):
    """Known resources with scope and count at an instant."""
    idx = ad.daily_snapshots(ad.daily_items(spark, sf))
    return dash.resource_catalog(idx, at="2024-01-15 00:00:00").select("resource", "namespaced", "objects")


@query("""
SELECT conv_id, turn, role, CAST(n AS INT) AS line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, n DESC, role DESC) AS rn FROM (
  SELECT conv_id, role, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM conversations)) WHERE rn <= 8""")
def log_tail(spark, sf):
    """Last 8 log lines per conversation."""
    t = dash.tail_of_lines(ad.log_line_rows(spark, sf), ["conv_id"], ["turn", "line_no", "container"], 8)
    return t.select("conv_id", "turn", F.col("container").alias("role"), "line_no", "line")


@query(with_(POD) + """
SELECT name AS pod, container, previous FROM (SELECT name, unnest(list_filter([CASE WHEN l_linenumber % 4 = 0 THEN 'setup' END, 'main', CASE WHEN l_linenumber % 3 = 0 THEN 'envoy' END],
  lambda x: x IS NOT NULL)) AS container FROM pod), (VALUES (false), (true)) AS v(previous)""")
def log_targets(spark, sf):
    """Every container log that should exist, current and previous."""
    return shape.log_targets(ad.pods(spark, sf)).select("pod", "container", "previous")


@query(with_(POD) + """
, t AS (SELECT name, ns, unnest(list_filter([CASE WHEN l_linenumber % 4 = 0 THEN 'setup' END, 'main', CASE WHEN l_linenumber % 3 = 0 THEN 'envoy' END], lambda x: x IS NOT NULL)) AS container, restarts FROM pod)
SELECT 'c0' AS capture_id, CAST(count(*) AS BIGINT) AS attempted, CAST(count(*) FILTER (container = 'main') AS BIGINT) AS captured, CAST(count(*) FILTER (container <> 'main') AS BIGINT) AS skipped FROM t""")
def log_coverage(spark, sf):
    """Attempted, captured and skipped logs."""
    targets = written(shape.log_targets(ad.pods(spark, sf)).drop("pos"), "log-targets")  # on both sides
    got = targets.filter("container = 'main'").distinct().withColumns({"captured": F.lit(True), "reason": F.lit(None).cast("string")})
    return shape.log_coverage(targets, got)[0].select("capture_id", "attempted", "captured", "skipped")


# ------------------------------------------------------------- relationships

@query(with_(POD) + "SELECT name, ns AS namespace, 'ReplicaSet' AS owner_kind, owner AS owner_name FROM pod")
def owner_edges(spark, sf):
    """child -> owner edges."""
    return graph.owner_edges(ad.pods(spark, sf)).select("name", "namespace", "owner_kind", "owner_name")


@query(with_(POD) + """
SELECT DISTINCT 'dep-' || ((l_orderkey % 500) % 20) AS deployment, owner AS replicaset, name AS pod, ns AS namespace FROM pod""")
def deployment_pods(spark, sf):
    """Deployment -> replica set -> pod, two hops."""
    edges = written(graph.owner_edges(ad.pods(spark, sf)), "owner-edges")  # read by both hops
    n = F.substring("owner_name", 4, 10).cast("int") % 20
    sets = edges.select("capture_id", F.lit("replicasets").alias("resource"), "namespace", F.col("owner_name").alias("name"), "pos",
                        F.lit("Deployment").alias("owner_kind"), ad.txt("dep-", n).alias("owner_name"), F.lit("apps/v1").alias("owner_api_version")).distinct()
    deployments = sets.select("capture_id", "namespace", F.col("owner_name").alias("name"))
    return graph.deployment_pods(edges.unionByName(sets), deployments).select("deployment", "replicaset", "pod", "namespace")


@query(with_(POD) + """
SELECT name, 'configmap' AS kind, 'part-' || l_partkey AS target FROM pod UNION ALL SELECT name, 'secret', 'supp-' || l_suppkey FROM pod WHERE q % 2 = 0
UNION ALL SELECT name, 'persistentvolumeclaim', 'claim-' || (l_suppkey % 50) FROM pod WHERE q % 3 = 0""")
def mount_edges(spark, sf):
    """pod -> configmap, secret and claim edges."""
    return graph.mount_edges(ad.pods(spark, sf)).select("name", "kind", "target")


@query(with_(POD) + """
SELECT 'supp-' || s_suppkey AS secret, pod.name AS pod FROM supplier JOIN pod ON l_suppkey = s_suppkey AND q % 2 = 0 WHERE s_acctbal > 5000""")
def used_by(spark, sf):
    """Pods using given secrets."""
    s = ad.table(spark, sf, "supplier").filter("s_acctbal > 5000")
    targets = s.select(F.lit("c0").alias("capture_id"), ad.txt("ns", F.col("s_suppkey") % 25).alias("namespace"), F.lit("secret").alias("kind"), ad.txt("supp-", F.col("s_suppkey")).alias("target"))
    return graph.used_by(graph.mount_edges(ad.pods(spark, sf)), targets).select(F.col("target").alias("secret"), "pod")


@query("""
SELECT 'pv-' || c_custkey AS volume, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'claim-' || c_custkey END AS claim, CASE WHEN c_custkey % 2 = 0 THEN 'claim-' || c_custkey END AS claim_ref
FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR c_custkey % 2 = 0""")
def bindings(spark, sf):
    """Claims and volumes that name each other."""
    return graph.bindings(union(ad.claims(spark, sf), ad.volumes(spark, sf))).select("volume", "claim", "claim_ref")


# ---------------------------------------------------------------- redaction

def _as_records(objects: DataFrame) -> DataFrame:
    return objects.select("capture_id", "name", F.col("obj").alias("body"))


@query("""
SELECT 'cfg-' || c_custkey AS name, CASE WHEN c_custkey = 5 THEN c_name ELSE 'UkVEQUNURUQ=' END AS data_name,
  CASE WHEN c_custkey % 3 >= 1 THEN CASE WHEN c_custkey = 5 THEN c_mktsegment ELSE 'UkVEQUNURUQ=' END END AS data_seg,
  CASE WHEN c_custkey % 2 = 0 THEN 'REDACTED' END AS note, c_custkey <> 5 AS secrets_masked FROM customer""")
def redact_map(spark, sf):
    """Secret values masked, keys kept, one allowed secret left alone."""
    r = redact.redact_secrets(_as_records(ad.configs(spark, sf)), [f"ns{n}/cfg-5" for n in range(25)])
    g = lambda p: F.get_json_object("body", p)
    return r.select("name", g("$.data.name").alias("data_name"), g("$.data.seg").alias("data_seg"), g("$.stringData.note").alias("note"), "secrets_masked")


@query(with_(EV) + "SELECT seq, CASE WHEN ns = 'ns3' THEN 0 ELSE k END AS k, CASE WHEN ns = 'ns4' THEN 'true' ELSE CAST(value AS VARCHAR) END AS value, ns IN ('ns3', 'ns4') AS fields_masked FROM ev")
def redact_fields(spark, sf):
    """Field rules with a namespace scope; number kept a number, and a typed boolean."""
    rules = [redact.Rule("spec.k", "0", namespace="ns3"), redact.Rule("value", "true", namespace="ns4", value_type="bool")]
    r = redact.redact_fields(ad.event_records(spark, sf), rules)
    g = lambda p: F.get_json_object("body", p)
    value = F.coalesce(g("$.value").try_cast("double").cast("string"), g("$.value"))  # 58 and 58.0 are one JSON number
    return r.select("seq", g("$.spec.k").cast("bigint").alias("k"), value.alias("value"), "fields_masked")


@query("SELECT 'part-' || p_partkey AS name, CAST(0 AS BIGINT) AS qty_sum, lower(p_type) AS type FROM part")
def redact_deep(spark, sf):
    """A recursive rule reaching every quantity."""
    r = redact.redact_fields(_as_records(ad.part_objects(spark, sf)), [redact.Rule("**.qty", "0")])
    q = F.from_json(F.get_json_object("body", "$.spec.items[*].qty"), "array<bigint>")
    return r.select("name", F.aggregate(q, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("qty_sum"), F.get_json_object("body", "$.spec.type").alias("type"))


@query("SELECT 'c0' AS capture_id, CAST(count(*) FILTER (c_custkey <> 5) AS BIGINT) AS secrets_redacted, CAST(count(*) FILTER (c_custkey % 2 = 0) AS BIGINT) AS fields_redacted FROM customer")
def redaction_stats(spark, sf):
    """Counters of masked records."""
    r = redact.redact(_as_records(ad.configs(spark, sf)), True, [f"ns{n}/cfg-5" for n in range(25)], [redact.Rule("stringData.note", "x", kind="Secret")])
    return redact.redaction_stats(r).drop("redacted")
