"""Tabular views over the driver tables, one query per kind of listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kubestrata.functions.scalars import age_short, at_literal, pod_prefix
from kubestrata.operators import views
from kubestrata.plans import adapters as ad
from kubestrata.plans.registry import POD, WORK, query, with_

NOW = "2024-01-02 00:00:00"


def _plain(df: DataFrame) -> DataFrame:
    """Column names usable in SQL: Up-To-Date -> up_to_date."""
    names = {c: c.lower().replace("-", "_").replace(" ", "_").replace("(s)", "s") for c in df.columns}
    return df.withColumnsRenamed(names).drop("capture_id", "path")


def _view(objects: DataFrame, group: str, resource: str, wide: bool = True) -> DataFrame:
    return _plain(views.view_builtin(objects, group, resource, NOW, wide))


@query("""
SELECT 'node-' || s_suppkey AS name, CASE WHEN s_acctbal < 0 THEN 'NotReady' ELSE 'Ready' END || CASE WHEN s_suppkey % 11 = 0 THEN ',SchedulingDisabled' ELSE '' END AS status,
  COALESCE(NULLIF(concat_ws(',', CASE WHEN s_suppkey % 5 = 0 THEN 'control-plane' END, CASE WHEN s_suppkey % 3 = 0 THEN 'worker' END), ''), '<none>') AS roles, '215d' AS age,
  'v1.' || (20 + s_suppkey % 12) || '.3' AS version, '10.0.0.' || (s_suppkey % 250) AS internal_ip, CASE WHEN s_suppkey % 2 = 0 THEN '8.8.8.' || (s_suppkey % 250) ELSE '<none>' END AS external_ip,
  'linux' AS os_image, '6.1' AS kernel_version, 'containerd://1.7' AS container_runtime FROM supplier""")
def view_nodes(spark, sf):
    """Nodes."""
    return _view(ad.nodes(spark, sf), "", "nodes")


@query(with_(POD) + """
SELECT name, CAST(l_linestatus = 'O' AS INT) + CAST(l_linenumber % 3 = 0 AS INT) || '/' || (1 + CAST(l_linenumber % 3 = 0 AS INT)) AS ready, COALESCE(main_issue, phase) AS status,
  CAST(restarts AS BIGINT) AS restarts, '<none>' AS ip, 'node-' || l_suppkey AS node, '<none>' AS nominated_node, '<none>' AS readiness_gates FROM pod""")
def view_pods(spark, sf):
    """Pods."""
    return _view(ad.pods(spark, sf), "", "pods").drop("age")


_TEMPLATE = "'main,side' AS containers, p_brand || ',envoy:1' AS images"


@query(with_(WORK) + f"""SELECT name, have || '/' || COALESCE(replicas, 0) AS ready, CAST(p_size - 1 AS BIGINT) AS up_to_date, CAST(have AS BIGINT) AS available, '18h' AS age, {_TEMPLATE},
  'app=' || name AS selector FROM work""")
def view_deployments(spark, sf):
    """Deployments."""
    return _view(ad.workloads(spark, sf, "deployments"), "apps", "deployments")


_REPLICAS = f"""SELECT name, CAST(COALESCE(replicas, 0) AS BIGINT) AS desired, CAST(p_size AS BIGINT) AS current, CAST(have AS BIGINT) AS ready, '18h' AS age, {_TEMPLATE},
  'app=' || name AS selector FROM work"""


@query(with_(WORK) + _REPLICAS)
def view_replicasets(spark, sf):
    """Replica sets."""
    return _view(ad.workloads(spark, sf, "replicasets"), "apps", "replicasets")


@query(with_(WORK) + _REPLICAS)
def view_rcs(spark, sf):
    """Replication controllers."""
    return _view(ad.workloads(spark, sf, "replicationcontrollers", ""), "", "replicationcontrollers")


@query(with_(WORK) + f"SELECT name, have || '/' || COALESCE(replicas, 0) AS ready, '18h' AS age, {_TEMPLATE} FROM work")
def view_statefulsets(spark, sf):
    """Stateful sets."""
    return _view(ad.workloads(spark, sf, "statefulsets"), "apps", "statefulsets")


@query(with_(WORK) + f"""SELECT name, CAST(p_size AS BIGINT) AS desired, CAST(p_size AS BIGINT) AS current, CAST(have AS BIGINT) AS ready, CAST(p_size - 1 AS BIGINT) AS up_to_date,
  CAST(have AS BIGINT) AS available, 'disk=' || lower(p_type) AS node_selector, '18h' AS age, {_TEMPLATE}, 'app=' || name AS selector FROM work""")
def view_daemonsets(spark, sf):
    """Daemon sets."""
    return _view(ad.workloads(spark, sf, "daemonsets"), "apps", "daemonsets")


@query(with_(WORK) + f"""SELECT name, CASE WHEN p_partkey % 8 = 0 THEN 'Failed' WHEN p_partkey % 4 = 0 THEN 'Complete' WHEN p_partkey % 6 = 0 THEN 'Suspended' ELSE 'Running' END AS status,
  have || '/' || CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE 1 END AS completions, '18h' AS age, {_TEMPLATE}, 'app=' || name AS selector FROM work""")
def view_jobs(spark, sf):
    """Jobs."""
    return _view(ad.workloads(spark, sf, "jobs", "batch"), "batch", "jobs")


@query(with_(WORK) + f"""SELECT name, (p_size % 60) || ' * * * *' AS schedule, CASE WHEN p_partkey % 6 = 0 THEN 'True' ELSE 'False' END AS suspend, CAST(0 AS BIGINT) AS active,
  CASE WHEN p_partkey % 2 = 0 THEN '2024-01-10T00:00:00Z' ELSE '<none>' END AS last_schedule, '18h' AS age, {_TEMPLATE} FROM work""")
def view_cronjobs(spark, sf):
    """Cron jobs."""
    return _view(ad.workloads(spark, sf, "cronjobs", "batch"), "batch", "cronjobs")


@query("""
SELECT 'svc-' || k AS name, ['LoadBalancer', 'ExternalName', 'NodePort', 'ClusterIP'][k % 4 + 1] AS type, '10.1.0.' || (k % 250) AS cluster_ip,
  CASE k % 4 WHEN 0 THEN CASE WHEN k % 8 = 0 THEN '9.9.9.' || (k % 250) ELSE '<pending>' END WHEN 1 THEN 'ext' || k || '.example.com'
    ELSE CASE WHEN k % 12 = 3 THEN '1.1.1.' || (k % 250) || ',1.0.0.1' ELSE '<none>' END END AS external_ip,
  (80 + k % 10) || CASE WHEN k % 4 = 2 THEN ':' || (30000 + k % 1000) ELSE '' END || CASE WHEN k % 3 = 0 THEN '/UDP' ELSE '/TCP' END AS ports, '24h' AS age,
  'app=svc-' || k || ',tier=' || lower(c_mktsegment) AS selector FROM (SELECT c_custkey AS k, c_mktsegment FROM customer)""")
def view_services(spark, sf):
    """Services."""
    return _view(ad.services(spark, sf), "", "services")


@query("""
SELECT 'svc-' || k AS name, CASE WHEN k % 6 = 0 THEN '<none>' WHEN k % 2 = 0 THEN '10.2.0.' || (k % 250) || ':8001,10.2.1.1:8001'
  ELSE '10.2.0.' || (k % 250) || ':8001,10.2.0.' || (k % 250) || ':8002,10.2.1.1:8001 + more...' END AS endpoints, '24h' AS age FROM (SELECT c_custkey AS k FROM customer)""")
def view_endpoints(spark, sf):
    """Endpoints."""
    return _view(ad.services(spark, sf), "", "endpoints")


@query("""
SELECT 'svc-' || k AS name, CASE WHEN k % 2 = 0 THEN 'nginx' ELSE '<none>' END AS class, CASE WHEN k % 3 <> 0 THEN 'h' || k || '.example.com,w.example.com' ELSE '*' END AS hosts,
  CASE WHEN k % 8 = 0 THEN '9.9.9.' || (k % 250) ELSE '' END AS address, CASE WHEN k % 5 = 0 THEN '80, 443' ELSE '80' END AS ports, '24h' AS age FROM (SELECT c_custkey AS k FROM customer)""")
def view_ingresses(spark, sf):
    """Ingresses."""
    return _view(ad.services(spark, sf), "networking.k8s.io", "ingresses")


@query("SELECT 'cfg-' || c_custkey AS name, CAST(c_custkey % 3 + 1 + CAST(c_custkey % 5 = 0 AS INT) AS BIGINT) AS data, '24h' AS age FROM customer")
def view_configmaps(spark, sf):
    """Config maps."""
    return _view(ad.configs(spark, sf), "", "configmaps")


@query("SELECT 'cfg-' || c_custkey AS name, 'Opaque' AS type, CAST(c_custkey % 3 + 1 AS BIGINT) AS data, '24h' AS age FROM customer")
def view_secrets(spark, sf):
    """Secrets."""
    return _view(ad.configs(spark, sf), "", "secrets")


@query("SELECT 'cfg-' || c_custkey AS name, CAST(c_custkey % 4 + 1 AS BIGINT) AS secrets, '24h' AS age FROM customer")
def view_serviceaccounts(spark, sf):
    """Service accounts."""
    return _view(ad.configs(spark, sf), "", "serviceaccounts")


@query("""
SELECT 'claim-' || k AS name, status, CASE WHEN status = 'Bound' THEN 'pv-' || k ELSE '' END AS volume, (k % 90 + 10) || 'Gi' AS capacity, 'RWO,ROX' AS access_modes,
  CASE WHEN k % 3 <> 0 THEN 'sc-' || (k % 4) ELSE '' END AS storageclass, '24h' AS age
FROM (SELECT c_custkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 'Pending' WHEN 'MACHINERY' THEN 'Lost' ELSE 'Bound' END AS status FROM customer)""")
def view_pvcs(spark, sf):
    """Volume claims."""
    return _view(ad.claims(spark, sf), "", "persistentvolumeclaims")


@query("""
SELECT 'pv-' || c_custkey AS name, (c_custkey % 90 + 10) || 'Gi' AS capacity, 'RWX' AS access_modes, 'Retain' AS reclaim_policy, CASE WHEN c_custkey % 2 = 0 THEN 'Bound' ELSE 'Available' END AS status,
  CASE WHEN c_custkey % 2 = 0 THEN 'ns' || c_nationkey || '/claim-' || c_custkey ELSE '' END AS claim, 'sc-' || (c_custkey % 4) AS storageclass, '24h' AS age FROM customer""")
def view_pvs(spark, sf):
    """Volumes."""
    return _view(ad.volumes(spark, sf), "", "persistentvolumes")


@query("SELECT 'ns' || n_nationkey AS name, CASE WHEN n_nationkey % 10 = 9 THEN 'Terminating' ELSE 'Active' END AS status, '24h' AS age FROM nation")
def view_namespaces(spark, sf):
    """Namespaces."""
    return _view(ad.namespaces(spark, sf), "", "namespaces")


@query("""
SELECT 'ev' || event_id AS name, CASE WHEN event_type IN ('error', 'purchase') THEN 'Warning' ELSE 'Normal' END AS type,
  CASE event_type WHEN 'error' THEN 'BackOff' WHEN 'signup' THEN 'Scheduled' ELSE 'Pulled' END AS reason, 'pod/u' || user_id AS object, 'value ' || value AS message FROM events""")
def view_events(spark, sf):
    """Events."""
    return _view(ad.kube_events(spark, sf), "", "events").drop("age")


@query("SELECT 'part-' || p_partkey AS name, CAST(p_size AS VARCHAR) AS size, p_size || ' ' || (p_size % 7) AS quantities, lower(p_type) AS type, '' AS broken, '<unknown>' AS age FROM part")
def view_custom(spark, sf):
    """A custom resource listed by its printer columns."""
    cols = [{"name": "Size", "jsonPath": ".spec.size"}, {"name": "Quantities", "jsonPath": ".spec.items[*].qty"},
            {"name": "Type", "jsonPath": ".spec.type", "priority": 1}, {"name": "Broken", "jsonPath": ".spec.absent"}]
    return _plain(views.view_custom(ad.part_objects(spark, sf), cols, NOW, wide=True))


def _two_captures(df, key):
    return df.withColumn("capture_id", F.concat(F.lit("c"), (key % 2).cast("string")))


@query("""
SELECT 'c' || (p_partkey % 2) AS capture, 'part-' || p_partkey AS name, CASE p_partkey % 2 WHEN 0 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size % 7 AS VARCHAR) END AS size,
  CASE p_partkey % 2 WHEN 0 THEN lower(p_type) END AS type, CASE p_partkey % 2 WHEN 1 THEN p_brand END AS brand, '<unknown>' AS age FROM part""")
def view_choice_custom(spark, sf):
    """The view of a custom resource that two captures define with different columns."""
    same = lambda c: F.regexp_replace(F.regexp_replace(c, '"things[0-9]+"', '"parts"'), '"g[0-9]\\.example\\.com"', '"shop.example.com"')
    crds = _two_captures(ad.crds(spark, sf), F.col("position")).withColumn("obj", same("obj"))
    parts = _two_captures(ad.part_objects(spark, sf), F.col("position"))
    out = views.view(parts, "shop.example.com", "v1", "parts", NOW, True, crds)
    return _plain(out.withColumn("capture", F.col("capture_id")))


@query("""
SELECT 'c' || (p_partkey % 2) AS capture, 'part-' || p_partkey AS name, NULL::VARCHAR AS mystery3, NULL::VARCHAR AS mystery4, '' AS namespace FROM part""")
def view_choice_captured(spark, sf):
    """The view of a kind whose columns two captures captured, each its own."""
    r, k = ad.table(spark, sf, "region"), F.col("r_regionkey")
    body = ad.txt('{"columnDefinitions":[{"name":"Name"},{"name":"Mystery', k, '"},{"name":"Namespace"}]}')
    tables = _two_captures(r.select(F.lit("/apis/shop.example.com/v1/parts?as=Table").alias("path"), k.alias("seq"), F.lit("2024-01-01").cast("timestamp_ntz").alias("captured_at"),
                                    F.lit(None).cast("string").alias("event_type"), F.lit(200).alias("response_code"), body.alias("body")), F.col("seq"))
    parts = _two_captures(ad.part_objects(spark, sf), F.col("position"))
    out = views.view(parts, "shop.example.com", "v1", "parts", NOW, True, None, tables)
    return _plain(out.withColumn("capture", F.col("capture_id")))


@query(with_(WORK) + "SELECT name, have || '/' || COALESCE(replicas, 0) AS ready, NULL::VARCHAR AS mystery, ns AS namespace, '18h' AS age FROM work")
def view_captured(spark, sf):
    """A listing whose columns were captured: known cells computed, others null."""
    cols = [{"name": n} for n in ("Name", "Ready", "Mystery", "Namespace", "Age")]
    return _plain(views.view_captured(ad.workloads(spark, sf, "deployments"), cols, "apps", "deployments", NOW))


@query("SELECT 'claim-' || c_custkey AS name, 'ns' || c_nationkey AS namespace, '24h' AS age FROM customer")
def view_generic(spark, sf):
    """A listing of an unknown kind."""
    return _plain(views.view_generic(ad.claims(spark, sf), NOW))


@query(with_(WORK) + "SELECT name, ns AS namespace, CAST(COALESCE(replicas, 0) AS BIGINT) AS replicas, CAST(p_size AS BIGINT) AS current_replicas, 'app=' || name AS selector FROM work")
def view_scale(spark, sf):
    """Workloads as scale rows."""
    return views.view_scale(ad.workloads(spark, sf)).drop("capture_id", "path")


@query("""
WITH n AS (SELECT *, n_nationkey AS k FROM nation WHERE n_nationkey % 7 <> 3 AND n_nationkey % 9 <> 4)
SELECT 'g' || n_regionkey || '.example.com' AS "group", v AS version, 'things' || k AS resource, k % 2 = 0 AS namespaced, 'Thing' || k AS kind, 'thing' || k AS singular, 't' || k AS short_names
FROM n, LATERAL (SELECT unnest(CASE WHEN k % 5 = 0 THEN ['v1alpha1'] WHEN k % 2 = 0 THEN ['v1', 'v1beta1'] ELSE ['v1'] END) AS v)""")
def crd_catalog(spark, sf):
    """Served versions of custom resource definitions."""
    return views.crd_catalog(ad.crds(spark, sf)).drop("capture_id").withColumn("short_names", F.array_join("short_names", ","))


@query(with_(POD) + """
SELECT CASE WHEN regexp_matches(h, '[a-z]') AND regexp_matches(h, '[0-9]') AND l_orderkey % 500 >= 100 THEN 'app-*' ELSE 'app-o' || (l_orderkey % 500) || '-*' END AS prefix,
  CAST(count(*) AS BIGINT) AS pods FROM pod GROUP BY 1""")
def name_prefixes(spark, sf):
    """Pods per name stem."""
    return ad.pods(spark, sf).groupBy(pod_prefix("name").alias("prefix")).agg(F.count("*").alias("pods"))


@query("""
SELECT o_orderkey, CASE WHEN s < 120 THEN s || 's' WHEN s < 600 THEN (s // 60) || 'm' || CASE WHEN s % 60 = 0 THEN '' ELSE (s % 60) || 's' END WHEN s < 10800 THEN (s // 60) || 'm'
  WHEN s < 28800 THEN (s // 3600) || 'h' || CASE WHEN s // 60 % 60 = 0 THEN '' ELSE (s // 60 % 60) || 'm' END WHEN s < 172800 THEN (s // 3600) || 'h'
  WHEN s < 691200 THEN (s // 86400) || 'd' || CASE WHEN s // 3600 % 24 = 0 THEN '' ELSE (s // 3600 % 24) || 'h' END ELSE (s // 86400) || 'd' END AS age
FROM (SELECT o_orderkey, o_orderkey * 61 % 1000000 AS s FROM orders)""")
def ages(spark, sf):
    """Ages from seconds to days in short form."""
    s = F.col("o_orderkey") * 61 % 1000000
    created = at_literal("2024-01-31 00:00:00") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s.cast("decimal(18,6)"))
    return ad.table(spark, sf, "orders").select("o_orderkey", age_short(created, at_literal("2024-01-31 00:00:00")).alias("age"))
