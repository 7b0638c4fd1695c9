"""Queries of the branches that the main ones do not take: the rest of the read fallback, index rules, configuration facts, landing in batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from kubestrata.operators import shape, timetravel
from kubestrata.plans import adapters as ad
from kubestrata.plans.registry import EV, POD, WORK, query, with_
from kubestrata.plans.shape_queries import _CAT, _discovery
from kubestrata.session import new_folder, written
from kubestrata.sources import records as rec
from kubestrata.streaming import landing


@query(with_(WORK) + """
SELECT source, name FROM (
  SELECT 'merged namespaces' AS source, name FROM work WHERE resource = 'deployments'
  UNION ALL SELECT 'exact', min(name) FROM work WHERE resource = 'statefulsets' AND ns = 'ns3' HAVING count(*) > 0
  UNION ALL SELECT 'narrowed cluster list', 'claim-' || c_custkey FROM customer WHERE c_nationkey = 5)""")
def read_fallback_rest(spark, sf):
    """A cluster list put together from its namespaces, one object by name, and a namespace known to be captured, whose list
    is empty and stays so although the cluster list has objects in it; the next namespace was not captured."""
    work = ad.workloads(spark, sf)
    merged = timetravel.list_objects(work, "apps", "v1", "deployments")
    here = work.filter("resource = 'statefulsets' AND namespace = 'ns3'")
    first = here.agg(F.min("name")).first()[0] or ""
    single = timetravel.list_objects(work, "apps", "v1", "statefulsets", "ns3", name=first)
    cluster = ad.claims(spark, sf).withColumn("namespace", F.lit("")).withColumn("path", F.lit("/api/v1/persistentvolumeclaims"))
    known = cluster.select("capture_id").distinct().withColumn("path", F.lit("/api/v1/namespaces/ns4/persistentvolumeclaims"))
    lists = [timetravel.list_objects(cluster, "", "v1", "persistentvolumeclaims", ns, known=known) for ns in ("ns4", "ns5")]
    cols = ["source", "name"]
    return merged.select(*cols).unionByName(single.select(*cols)).unionByName(lists[0].select(*cols)).unionByName(lists[1].select(*cols))


@query(with_(EV) + """
SELECT path, part, CASE part % 4 WHEN 1 THEN 'parallel arrays of unequal length' WHEN 2 THEN 'null index entry' ELSE 'mixed wrapped and bare keys' END AS issue
FROM (SELECT DISTINCT path, CAST(floor(seq / 500) AS BIGINT) AS part FROM ev) WHERE part % 4 <> 0""")
def index_json_check(spark, sf):
    """Index documents, one for each path and part, three of four with a fault: an event type too few, a null entry, bare keys beside wrapped ones."""
    idx = rec.build_index(ad.event_log(spark, sf).withColumn("item_count", F.lit(0)), rows=500)
    kind = F.col("part") % 4
    types = F.when(kind == 1, F.slice("event_types", F.lit(1), F.size("event_types") - 1)).otherwise(F.col("event_types"))
    stamp = F.transform("times", lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    entry = F.when(kind == 2, F.lit("null")).otherwise(F.to_json(F.struct(F.col("path").alias("api_path"), "seqs", stamp.alias("times"), types.alias("event_types"))))
    member = ad.txt('"', F.col("path"), '":', entry)
    doc = ad.txt('{"entries":{', member, "}", F.when(kind == 3, ad.txt(",", member)).otherwise(""), "}")
    found = rec.check_index_json(idx.select(F.col("part").cast("bigint").alias("part"), doc.alias("j")), "j", watch=True)
    return found.select("path", "part", "issue")


@query("""
SELECT 'c0' AS capture_id, CAST(count(*) AS BIGINT) AS record_count, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS deduplicated_count,
  (SELECT string_agg(DISTINCT (n_regionkey * 10 + 5) || 's', ',' ORDER BY (n_regionkey * 10 + 5) || 's') FROM nation WHERE n_nationkey % 4 <> 0) AS intervals,
  (SELECT bool_or(n_nationkey % 3 = 0) FROM nation WHERE n_nationkey % 4 <> 0) AS watch_configured FROM events""")
def manifest_config(spark, sf):
    """Manifest with the facts that only the configuration knows: nations as targets."""
    events, k = ad.event_records(spark, sf), F.col("n_nationkey")
    targets = ad.table(spark, sf, "nation").select(F.lit("c0").alias("capture_id"), (k % 3 == 0).alias("watch"),
                                                   F.when(k % 4 == 0, "").otherwise(ad.txt(F.col("n_regionkey") * 10 + 5, "s")).alias("interval"))
    dropped = ad.table(spark, sf, "events").agg(F.count_if(F.col("event_type") == "error").alias("deduplicated_count")).withColumn("capture_id", F.lit("c0"))
    facts = rec.with_config_facts(rec.manifest(events), targets, dropped)
    return facts.select("capture_id", "record_count", "deduplicated_count", F.array_join("intervals", ",").alias("intervals"), "watch_configured")


@query(with_(POD) + """
, t AS (SELECT name, ns, unnest(list_filter([CASE WHEN l_linenumber % 4 = 0 THEN 'setup' END, CASE WHEN l_linenumber % 3 = 0 THEN 'envoy' END], lambda x: x IS NOT NULL)) AS container FROM pod)
SELECT ns AS namespace, name AS pod, container, 'no log of ' || container AS reason FROM t ORDER BY ns, name, container LIMIT 20""")
def log_failures(spark, sf):
    """The report's first twenty failures with their reasons."""
    targets = written(shape.log_targets(ad.pods(spark, sf)).drop("pos"), "log-targets")  # on both sides
    main = F.col("container") == "main"
    results = targets.distinct().withColumns({"captured": main, "reason": F.when(~main, ad.txt("no log of ", F.col("container")))})
    return shape.log_coverage(targets, results)[1].select("namespace", "pod", "container", "reason")


@query(with_(_CAT) + """
SELECT "group", version, resource, (SELECT string_agg('ns' || n_nationkey, ',' ORDER BY 'ns' || n_nationkey) FROM nation) AS in_namespaces
FROM cat WHERE listable AND "group" = '' AND resource <> 'pods'""")
def native_listable_namespaces(spark, sf):
    """Listable built-in kinds without a cluster-wide target, and the namespaces that are targeted one by one."""
    cat = shape.api_catalog(_discovery(spark, sf))
    whole = cat.filter("resource = 'pods'").select("group", "version", "resource", F.array().cast("array<string>").alias("namespaces"))
    single = ad.table(spark, sf, "nation").select(F.lit("").alias("group"), F.lit("v1").alias("version"), F.lit("things0").alias("resource"),
                                                  F.array(ad.txt("ns", F.col("n_nationkey")), F.lit("*")).alias("namespaces"))
    found = shape.native_listable(cat, whole.unionByName(single))
    return found.select("group", "version", "resource", F.array_join("in_namespaces", ",").alias("in_namespaces"))


@query(with_(EV) + """
SELECT path, seq AS event_id, CAST(row_number() OVER (PARTITION BY path ORDER BY seq % 3, ts, seq) - 1 AS BIGINT) AS path_seq FROM ev""")
def landed_seq(spark, sf):
    """All events landed in three batches, one of them twice, numbered on from the kept counters."""
    folder = new_folder(spark, "landed")
    events = ad.event_records(spark, sf).select("capture_id", "path", F.col("seq").alias("record_id"), "captured_at", "event_type", "response_code", "body")
    write = landing.land_batch(folder)
    for n in (0, 1, 1, 2):
        write(events.filter(F.col("record_id") % 3 == n), n)
    rows = landing.read_landed(spark, folder, f"{landing.FEED_DDL}, record_id bigint")
    return rows.select("path", F.col("record_id").alias("event_id"), F.col("seq").alias("path_seq"))


@query(with_(EV) + """
, v AS (SELECT path, typ, row_number() OVER (PARTITION BY path ORDER BY seq % 2, ts, seq) + 1 AS rv FROM ev)
SELECT path, CAST(max(rv) AS BIGINT) AS rv FROM v GROUP BY path""")
def landed_versions(spark, sf):
    """The version each landed list has reached, from the counters alone."""
    folder = new_folder(spark, "landed")
    events = ad.event_records(spark, sf).select("capture_id", "path", F.col("seq").alias("record_id"), "captured_at", "event_type", "response_code", "body")
    for n in (0, 1):
        landing.land_batch(folder)(events.filter(F.col("record_id") % 2 == n), n)
    return landing.versions(spark, folder).select("path", "rv")
