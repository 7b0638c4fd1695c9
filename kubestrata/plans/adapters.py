"""The driver tables seen as recorded cluster state.

Every adapter is row-local, or an aggregate with a map-side combine: no group of rows is ever collected into
one value. All of them read their whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kubestrata.functions.scalars import stored

CAPTURE = "c0"


def capture_of(key: Column) -> Column:
    """Which capture a row belongs to: negative keys would be a second one."""
    return F.when(key < 0, "c1").otherwise(CAPTURE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Raw rows dealt out by key before they grow into objects, at every size: a file of one row group would be one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def txt(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _objects(df: DataFrame, path: Column, group: str, version: str, resource: Column | str, namespace: Column,
             name: Column, obj: Column, labels: Column | None = None, position: Column | None = None) -> DataFrame:
    """Object rows with the identity columns the operators expect."""
    res = F.lit(resource) if isinstance(resource, str) else resource
    none = F.lit(None).cast("map<string,string>")
    # obj comes out of a one-row generator, like a stored column: filters on it do not build it a second time. It is a
    # column before, as a projection is compiled at any size and a generator is interpreted beside a large one
    return stored(df.select(
        (F.lit(CAPTURE) if position is None else capture_of(position)).alias("capture_id"), path.alias("path"), F.lit(group).alias("group"), F.lit(version).alias("version"),
        res.alias("resource"), namespace.alias("namespace"), name.alias("name"), namespace.alias("obj_namespace"),
        F.lit("").alias("uid"), (none if labels is None else labels).alias("labels"), F.lit(True).alias("decodable"),
        F.when(namespace == "", name).otherwise(txt(namespace, "/", name)).alias("object_key"),
        (F.lit(0) if position is None else position).cast("bigint").alias("position"), obj.alias("obj")), "obj")


# ------------------------------------------------------------------ events

def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events of widgets u<user> in ns<user % 10>; event_id is the arrival order within every path."""
    e = table(spark, sf_dir, "events")
    ns, name = txt("ns", F.col("user_id") % 10), txt("u", F.col("user_id"))
    kind = F.when(F.col("event_type") == "signup", "ADDED").when(F.col("event_type") == "error", "DELETED").otherwise("MODIFIED")
    obj = txt('{"metadata":{"name":"', name, '","namespace":"', ns, '"},"spec":', F.col("props"), ',"value":', F.col("value"), "}")
    return e.select(
        capture_of(F.col("event_id")).alias("capture_id"), txt("/api/v1/namespaces/", ns, "/widgets").alias("path"),
        F.col("event_id").alias("seq"), F.col("ts").alias("captured_at"), kind.alias("event_type"),
        F.lit(200).alias("response_code"), name.alias("name"), ns.alias("obj_namespace"), txt(ns, "/", name).alias("object_key"),
        obj.alias("obj"))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as raw records (body instead of extracted columns)."""
    return event_log(spark, sf_dir).select(
        "capture_id", "path", "seq", "captured_at", "event_type", F.lit("WATCH").alias("http_method"), "response_code",
        F.col("obj").alias("body"))


def daily_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily list snapshots of sessions: items are the users seen that day with their last value."""
    e = table(spark, sf_dir, "events")
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    last = e.groupBy("user_id", day.cast("bigint").alias("seq")).agg(F.max_by("value", "event_id").alias("value"))
    ns, name = txt("ns", F.col("user_id") % 10), txt("u", F.col("user_id"))
    return last.select(
        F.lit(CAPTURE).alias("capture_id"), txt("/api/v1/namespaces/", ns, "/sessions").alias("path"), "seq",
        (F.lit("2024-01-02").cast("timestamp_ntz") + F.make_dt_interval(F.col("seq").cast("int"))).alias("captured_at"),
        F.col("user_id").alias("pos"), txt(ns, "/", name).alias("object_key"), name.alias("name"),
        txt('{"metadata":{"name":"', name, '","namespace":"', ns, '"},"value":', F.col("value"), "}").alias("obj"))


def daily_snapshots(items: DataFrame) -> DataFrame:
    """Narrow snapshot index of the daily lists."""
    return items.groupBy("capture_id", "path", "seq", "captured_at").agg(F.count("*").cast("int").alias("item_count")).withColumns(
        {"is_list": F.lit(True), "response_code": F.lit(200), "event_type": F.lit(None).cast("string")})


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture: the window of the events table."""
    return table(spark, sf_dir, "events").groupBy(capture_of(F.col("event_id")).alias("capture_id")).agg(
        F.min("ts").alias("captured_at"), F.max("ts").alias("captured_until"),
        F.lit("v1.30.2").alias("kubernetes_version"))


def kube_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as Event objects about pod u<user>."""
    e = table(spark, sf_dir, "events")
    ns, name = txt("ns", F.col("user_id") % 10), txt("ev", F.col("event_id"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    reason = F.when(F.col("event_type") == "error", "BackOff").when(F.col("event_type") == "signup", "Scheduled").otherwise("Pulled")
    obj = F.to_json(F.struct(
        F.struct(name.alias("name"), ns.alias("namespace"), stamp.alias("creationTimestamp")).alias("metadata"),
        F.when(F.col("event_type").isin("error", "purchase"), "Warning").otherwise("Normal").alias("type"),
        reason.alias("reason"), txt("value ", F.col("value")).alias("message"), (F.col("event_id") % 7).cast("int").alias("count"),
        F.when(F.col("event_id") % 2 == 0, stamp).alias("lastTimestamp"), stamp.alias("eventTime"),
        F.struct(F.lit("kubelet").alias("component")).alias("source"),
        F.struct(F.lit("Pod").alias("kind"), ns.alias("namespace"), txt("u", F.col("user_id")).alias("name")).alias("involvedObject")))
    return _objects(e, txt("/api/v1/namespaces/", ns, "/events"), "", "v1", "events", ns, name, obj, position=F.col("event_id"))


# -------------------------------------------------------------------- pods

def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pod per lineitem, built inside the row: main container, a sidecar for every third line number and
    an init container for every fourth.

    The raw columns are dealt out before a row becomes a pod many times their size.
    """
    raw = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    li = dealt(table(spark, sf_dir, "lineitem").select(*raw), "l_orderkey", "l_linenumber")
    digest = F.substring(F.sha2(F.concat_ws("/", *[F.col(c).cast("string") for c in (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]), 256), 1, 6)
    # columns of their own: name and namespace are read several times and made once
    li = li.withColumns({"_q": F.col("l_quantity").cast("int"), "_ns": txt("ns", F.col("l_suppkey") % 25),
                         "_name": txt("app-o", F.col("l_orderkey") % 500, "-", digest)})
    q, ns, name = F.col("_q"), F.col("_ns"), F.col("_name")
    flag, line, supp, part = F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    phase = F.when(q % 10 == 0, "Pending").when(q % 10 == 1, "Failed").when(q % 17 == 2, "Unknown").otherwise("Running")
    iff = lambda cond, *parts: F.when(cond, txt(*parts)).otherwise("")
    resources = txt('"resources":{"x":{}', iff(F.col("l_tax") >= 0.04, ',"requests":{"cpu":"', q, 'm"}'),
                    iff(part % 3 == 0, ',"limits":{"memory":"', q, 'Mi"}'), "}")
    spec = txt(
        '{"nodeName":"node-', supp, '","containers":[{"name":"main","image":"part:', part, '",', resources, "}",
        iff(line % 3 == 0, ',{"name":"envoy","image":"envoy:1",', resources, "}"), "]",
        iff(line % 4 == 0, ',"initContainers":[{"name":"setup","image":"setup:1",', resources, "}]"),
        ',"volumes":[{"configMap":{"name":"part-', part, '"}}', iff(q % 2 == 0, ',{"secret":{"secretName":"supp-', supp, '"}}'),
        iff(q % 3 == 0, ',{"persistentVolumeClaim":{"claimName":"claim-', supp % 50, '"}}'), "]}")
    state = (F.when(flag == "N", '{"running":{"startedAt":"2024-01-01T00:00:00Z"}}')
             .when(flag == "R", '{"waiting":{"reason":"CrashLoopBackOff"}}').otherwise('{"terminated":{"reason":"Error","exitCode":1}}'))
    done = F.when(q % 7 == 0, '"OOMKilled","exitCode":137').otherwise('"Completed","exitCode":0')
    status = txt(
        '{"phase":"', phase, '"',
        iff((phase == "Pending") & (F.col("l_discount") >= 0.08),
            ',"conditions":[{"type":"PodScheduled","status":"False","reason":"Unschedulable","message":"insufficient cpu"}]'),
        ',"containerStatuses":[{"name":"main","ready":', F.col("l_linestatus") == "O", ',"restartCount":', q % 5, ',"state":', state, "}",
        iff(line % 3 == 0, ',{"name":"envoy","ready":true,"restartCount":0,"state":{"running":{}}}'), "]",
        iff(line % 4 == 0, ',"initContainerStatuses":[{"name":"setup","ready":false,"restartCount":0,"state":{"terminated":{"reason":', done, "}}}]"), "}")
    obj = txt(
        '{"metadata":{"name":"', name, '","namespace":"', ns, '","labels":{"flag":"', flag, '","line":"', line, '"},"creationTimestamp":"',
        F.date_format("l_shipdate", "yyyy-MM-dd"), 'T00:00:00Z","ownerReferences":[{"kind":"ReplicaSet","name":"rs-',
        F.col("l_orderkey") % 500, '"}]},"spec":', spec, ',"status":', status, "}")
    labels = F.create_map(F.lit("flag"), flag, F.lit("line"), line.cast("string"))
    return _objects(li, txt("/api/v1/namespaces/", ns, "/pods"), "", "v1", "pods", ns, name, obj, labels, F.col("l_orderkey"))


# --------------------------------------------------------------- workloads

WORKLOAD_OF_TYPE = {"STANDARD": "deployments", "ECONOMY": "statefulsets", "MEDIUM": "daemonsets", "PROMO": "jobs",
                    "LARGE": "replicasets", "SMALL": "cronjobs"}


def workloads(spark: SparkSession, sf_dir: str, resource: str | None = None, group: str | None = None) -> DataFrame:
    """Parts as workloads: the kind follows p_type (or is given), p_size is the wanted size."""
    p = dealt(table(spark, sf_dir, "part"), "p_partkey")
    kinds = F.create_map(*[F.lit(x) for kv in WORKLOAD_OF_TYPE.items() for x in kv])
    res = F.lit(resource) if resource else F.element_at(kinds, F.col("p_type"))
    size, have = F.col("p_size"), (F.col("p_partkey") % (F.col("p_size") + 3)).cast("int")
    ns, name = txt("ns", F.col("p_partkey") % 25), txt("w", F.col("p_partkey"))
    labels = F.create_map(F.lit("app"), name, F.lit("brand"), F.col("p_brand"))
    flat = F.to_json(F.create_map(F.lit("app"), name))
    structured = F.to_json(F.struct(F.create_map(F.lit("app"), name).alias("matchLabels")))
    template = F.struct(F.struct(
        F.create_map(F.lit("disk"), F.lower("p_type")).alias("nodeSelector"),
        F.array(F.struct(F.lit("main").alias("name"), F.col("p_brand").alias("image")),
                F.struct(F.lit("side").alias("name"), F.lit("envoy:1").alias("image"))).alias("containers")).alias("spec"))
    done = F.when(F.col("p_partkey") % 4 == 0, F.array(F.struct(F.when(F.col("p_partkey") % 8 == 0, "Failed").otherwise("Complete").alias("type"), F.lit("True").alias("status"))))
    selector = F.parse_json(F.when(F.col("p_partkey") % 2 == 0, structured).otherwise(flat))
    spec = F.struct(
        F.when(F.col("p_partkey") % 5 != 0, size).alias("replicas"), selector.alias("selector"),
        F.when(F.col("p_partkey") % 3 != 0, size).alias("completions"), (F.col("p_partkey") % 6 == 0).alias("suspend"),
        txt(F.col("p_size") % 60, " * * * *").alias("schedule"), template.alias("template"))
    status = F.struct(
        size.alias("replicas"), have.alias("readyReplicas"), have.alias("availableReplicas"), (size - 1).alias("updatedReplicas"),
        have.alias("numberReady"), size.alias("desiredNumberScheduled"), size.alias("currentNumberScheduled"),
        (size - 1).alias("updatedNumberScheduled"), have.alias("numberAvailable"), have.alias("succeeded"),
        (F.col("p_partkey") % 9 == 0).cast("int").alias("failed"), done.alias("conditions"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("2024-01-10T00:00:00Z")).alias("lastScheduleTime"))
    obj = F.to_json(F.struct(F.struct(name.alias("name"), ns.alias("namespace"), labels.alias("labels"),
                                      F.lit("2024-01-01T06:00:00Z").alias("creationTimestamp")).alias("metadata"),
                             spec.alias("spec"), status.alias("status")))
    g = group if group is not None else "apps"
    base = "/api/v1" if g == "" else f"/apis/{g}/v1"
    return _objects(p, txt(f"{base}/namespaces/", ns, "/", res), g, "v1", res, ns, name, obj, labels, F.col("p_partkey"))


def part_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with brand and type labels; a size label only above 10."""
    p = table(spark, sf_dir, "part")
    name = txt("part-", F.col("p_partkey"))
    labels = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("brand").alias("k"), F.col("p_brand").alias("v")), F.struct(F.lit("type").alias("k"), F.col("p_type").alias("v")),
        F.when(F.col("p_size") > 10, F.struct(F.lit("size").alias("k"), F.col("p_size").cast("string").alias("v"))))))
    obj = F.to_json(F.struct(
        F.struct(name.alias("name"), labels.alias("labels")).alias("metadata"),
        F.struct(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.lower("p_type").alias("type"),
                 F.array(F.struct(F.lit("a").alias("n"), F.col("p_size").alias("qty")),
                         F.struct(F.lit("b").alias("n"), (F.col("p_size") % 7).alias("qty"))).alias("items")).alias("spec")))
    return _objects(p, F.lit("/apis/shop.example.com/v1/parts"), "shop.example.com", "v1", "parts", F.lit(""), name, obj, labels, F.col("p_partkey"))


# ------------------------------------------------------------ cluster kinds

def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    name = txt("node-", k)
    cond = lambda t, st: F.struct(F.lit(t).alias("type"), st.alias("status"))
    addr = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("address"))
    labels = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("zone").alias("k"), F.col("s_nationkey").cast("string").alias("v")),
        F.when(k % 5 == 0, F.struct(F.lit("node-role.kubernetes.io/control-plane").alias("k"), F.lit("").alias("v"))),
        F.when(k % 3 == 0, F.struct(F.lit("node-role.kubernetes.io/worker").alias("k"), F.lit("").alias("v"))))))
    obj = F.to_json(F.struct(
        F.struct(name.alias("name"), labels.alias("labels"), F.lit("2023-06-01T00:00:00Z").alias("creationTimestamp")).alias("metadata"),
        F.struct((k % 11 == 0).alias("unschedulable")).alias("spec"),
        F.struct(
            F.array(cond("DiskPressure", F.when(k % 7 == 0, "True").otherwise("False")),
                    cond("Ready", F.when(F.col("s_acctbal") < 0, "False").otherwise("True"))).alias("conditions"),
            F.array_compact(F.array(addr("InternalIP", txt("10.0.0.", k % 250)),
                                    F.when(k % 2 == 0, addr("ExternalIP", txt("8.8.8.", k % 250))))).alias("addresses"),
            F.struct(txt("v1.", 20 + k % 12, ".3").alias("kubeletVersion"), F.lit("linux").alias("osImage"),
                     F.lit("6.1").alias("kernelVersion"), F.lit("containerd://1.7").alias("containerRuntimeVersion")).alias("nodeInfo")).alias("status")))
    return _objects(s, F.lit("/api/v1/nodes"), "", "v1", "nodes", F.lit(""), name, obj, labels, k)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as volume claims; the market segment decides the phase."""
    c = dealt(table(spark, sf_dir, "customer"), "c_custkey")
    k = F.col("c_custkey")
    ns, name = txt("ns", F.col("c_nationkey")), txt("claim-", k)
    phase = F.when(F.col("c_mktsegment") == "BUILDING", "Pending").when(F.col("c_mktsegment") == "MACHINERY", "Lost").otherwise("Bound")
    obj = F.to_json(F.struct(
        F.struct(name.alias("name"), ns.alias("namespace"), F.lit("2024-01-01T00:00:00Z").alias("creationTimestamp")).alias("metadata"),
        F.struct(F.when(k % 3 != 0, txt("sc-", k % 4)).alias("storageClassName"), F.when(phase == "Bound", txt("pv-", k)).alias("volumeName"),
                 F.array(F.lit("ReadWriteOnce"), F.lit("ReadOnlyMany")).alias("accessModes")).alias("spec"),
        F.struct(phase.alias("phase"), F.struct(txt(k % 90 + 10, "Gi").alias("storage")).alias("capacity")).alias("status")))
    return _objects(c, txt("/api/v1/namespaces/", ns, "/persistentvolumeclaims"), "", "v1", "persistentvolumeclaims", ns, name, obj, position=k)


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = txt("pv-", k)
    obj = F.to_json(F.struct(
        F.struct(name.alias("name"), F.lit("2024-01-01T00:00:00Z").alias("creationTimestamp")).alias("metadata"),
        F.struct(F.struct(txt(k % 90 + 10, "Gi").alias("storage")).alias("capacity"), F.array(F.lit("ReadWriteMany")).alias("accessModes"),
                 F.lit("Retain").alias("persistentVolumeReclaimPolicy"), txt("sc-", k % 4).alias("storageClassName"),
                 F.when(k % 2 == 0, F.struct(txt("ns", F.col("c_nationkey")).alias("namespace"), txt("claim-", k).alias("name"))).alias("claimRef")).alias("spec"),
        F.struct(F.when(k % 2 == 0, "Bound").otherwise("Available").alias("phase")).alias("status")))
    return _objects(c, F.lit("/api/v1/persistentvolumes"), "", "v1", "persistentvolumes", F.lit(""), name, obj, position=k)


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ns, name = txt("ns", F.col("c_nationkey")), txt("svc-", k)
    kind = F.when(k % 4 == 0, "LoadBalancer").when(k % 4 == 1, "ExternalName").when(k % 4 == 2, "NodePort").otherwise("ClusterIP")
    point = F.when(k % 8 == 0, F.array(F.struct(txt("9.9.9.", k % 250).alias("ip"))))
    ports = F.array(F.struct((80 + k % 10).alias("port"), F.when(k % 4 == 2, 30000 + k % 1000).alias("nodePort"), F.when(k % 3 == 0, "UDP").alias("protocol")))
    obj = F.to_json(F.struct(
        F.struct(name.alias("name"), ns.alias("namespace"), F.lit("2024-01-01T00:00:00Z").alias("creationTimestamp")).alias("metadata"),
        F.struct(kind.alias("type"), txt("10.1.0.", k % 250).alias("clusterIP"), F.when(k % 4 == 1, txt("ext", k, ".example.com")).alias("externalName"),
                 F.when(k % 12 == 3, F.array(txt("1.1.1.", k % 250), F.lit("1.0.0.1"))).alias("externalIPs"), ports.alias("ports"),
                 F.create_map(F.lit("tier"), F.lower("c_mktsegment"), F.lit("app"), name).alias("selector"),
                 F.when(k % 2 == 0, "nginx").alias("ingressClassName"), F.when(k % 3 != 0, F.array(F.struct(txt("h", k, ".example.com").alias("host")), F.struct(F.lit("w.example.com").alias("host")))).alias("rules"),
                 F.when(k % 5 == 0, F.array(F.lit("tls"))).alias("tls")).alias("spec"),
        F.struct(F.struct(point.alias("ingress")).alias("loadBalancer")).alias("status"),
        F.when(k % 6 != 0, F.array(F.struct(F.array(F.struct(txt("10.2.0.", k % 250).alias("ip")), F.struct(F.lit("10.2.1.1").alias("ip"))).alias("addresses"),
                                            F.transform(F.sequence(F.lit(1), k % 2 + 1), lambda i: F.struct((8000 + i).alias("port"))).alias("ports")))).alias("subsets")))
    return _objects(c, txt("/api/v1/namespaces/", ns, "/services"), "", "v1", "services", ns, name, obj, position=k)


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as Secrets / ConfigMaps with one to three data entries."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ns, name = txt("ns", F.col("c_nationkey")), txt("cfg-", k)
    data = F.map_from_entries(F.slice(F.array(
        F.struct(F.lit("name").alias("k"), F.col("c_name").alias("v")), F.struct(F.lit("seg").alias("k"), F.col("c_mktsegment").alias("v")),
        F.struct(F.lit("bal").alias("k"), F.col("c_acctbal").cast("string").alias("v"))), F.lit(1), (k % 3 + 1).cast("int")))
    obj = F.to_json(F.struct(
        F.lit("Secret").alias("kind"), F.struct(name.alias("name"), ns.alias("namespace"), F.lit("2024-01-01T00:00:00Z").alias("creationTimestamp")).alias("metadata"),
        F.lit("Opaque").alias("type"), data.alias("data"), F.when(k % 2 == 0, F.create_map(F.lit("note"), F.col("c_mktsegment"))).alias("stringData"),
        F.when(k % 5 == 0, F.create_map(F.lit("blob"), F.lit("AA=="))).alias("binaryData"),
        F.transform(F.sequence(F.lit(1), k % 4 + 1), lambda i: F.struct(txt("tok-", i).alias("name"))).alias("secrets")))
    return _objects(c, txt("/api/v1/namespaces/", ns, "/secrets"), "", "v1", "secrets", ns, name, obj, position=k)


def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    name = txt("ns", F.col("n_nationkey"))
    labels = F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"))
    obj = F.to_json(F.struct(
        F.struct(name.alias("name"), labels.alias("labels"), F.lit("2024-01-01T00:00:00Z").alias("creationTimestamp")).alias("metadata"),
        F.struct(F.when(F.col("n_nationkey") % 10 == 9, "Terminating").otherwise("Active").alias("phase")).alias("status")))
    return _objects(n, F.lit("/api/v1/namespaces"), "", "v1", "namespaces", F.lit(""), name, obj, labels, F.col("n_nationkey"))


def crds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as custom resource definitions."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    name = txt("things", k, ".g", F.col("n_regionkey"), ".example.com")
    column = lambda n, path, wide=0: F.struct(F.lit(n).alias("name"), F.lit(path).alias("jsonPath"), F.lit(wide).alias("priority"))
    printed = F.when(k % 2 == 0, F.array(column("Size", ".spec.size"), column("Type", ".spec.type", 1))).otherwise(
        F.array(column("Size", ".spec.items[1].qty"), column("Brand", ".metadata.labels.brand")))
    version = lambda v, served: F.struct(F.lit(v).alias("name"), served.alias("served"), printed.alias("additionalPrinterColumns"))
    obj = F.to_json(F.struct(F.struct(name.alias("name")).alias("metadata"), F.struct(
        txt("g", F.col("n_regionkey"), ".example.com").alias("group"), F.when(k % 7 == 3, "Odd").when(k % 2 == 0, "Namespaced").otherwise("Cluster").alias("scope"),
        F.struct(F.when(k % 9 != 4, txt("Thing", k)).alias("kind"), txt("things", k).alias("plural"), txt("thing", k).alias("singular"), F.array(txt("t", k)).alias("shortNames")).alias("names"),
        F.when(k % 5 != 0, F.array(version("v1", F.lit(True)), version("v1beta1", k % 2 == 0))).alias("versions"),
        F.when(k % 5 == 0, "v1alpha1").alias("version")).alias("spec")))
    return _objects(n, F.lit("/apis/apiextensions.k8s.io/v1/customresourcedefinitions"), "apiextensions.k8s.io", "v1", "customresourcedefinitions", F.lit(""), name, obj, position=k)


# ----------------------------------------------------------- changes, text

def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as overlay writes: rv = event_id + 1."""
    e = event_log(spark, sf_dir)
    return e.select("capture_id", F.lit("").alias("group"), F.lit("v1").alias("version"), F.lit("widgets").alias("resource"), "obj_namespace", "name",
                    (F.col("seq") + 1).alias("rv"), (F.col("event_type") == "DELETED").alias("deleted"), "obj")


def order_records(spark: SparkSession, sf_dir: str, after: bool = False) -> DataFrame:
    """Orders as one single-object path each; the later capture has changed prices, gaps and new keys."""
    o = dealt(table(spark, sf_dir, "orders"), "o_orderkey")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    base = o.select(k.alias("k"), price.alias("price"), F.col("o_orderpriority").alias("prio"))
    if after:
        kept = base.filter(k % 11 != 0).withColumn("price", F.when(F.col("k") % 7 == 0, F.col("price") + 100).otherwise(F.col("price")))
        base = kept.unionByName(base.filter(F.col("k") % 13 == 0).withColumn("k", F.col("k") + 10_000_000))
    # member order differs between the captures; only the meaning counts
    body = txt('{"prio":"', F.col("prio"), '","price":', F.col("price"), "}") if after else txt('{"price":', F.col("price"), ',"prio":"', F.col("prio"), '"}')
    return base.select(F.lit(CAPTURE).alias("capture_id"), txt("/api/v1/namespaces/ns", F.col("k") % 25, "/orders/o", F.col("k")).alias("path"),
                       F.lit(0).cast("bigint").alias("seq"), F.lit("2024-01-01").cast("timestamp_ntz").alias("captured_at"),
                       F.lit(None).cast("string").alias("event_type"), F.lit(200).alias("response_code"), body.alias("body"))


def log_line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as log lines: pod = conversation, container = role, one row per line of each turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.lit(CAPTURE).alias("capture_id"), txt("conv-", F.col("conv_id")).alias("pod"), F.col("role").alias("container"),
                    F.col("conv_id"), F.col("turn"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def documents_as_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = txt("doc-", F.col("doc_id"))
    obj = F.to_json(F.struct(F.struct(name.alias("name")).alias("metadata"), F.struct(F.col("lang"), F.col("text")).alias("spec")))
    return _objects(d, F.lit("/apis/text.example.com/v1/documents"), "text.example.com", "v1", "documents", F.lit(""), name, obj, position=F.col("doc_id"))

