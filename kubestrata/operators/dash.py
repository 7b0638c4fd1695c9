"""Dashboard aggregates, pod detail and log text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kubestrata.functions.ordered import salted_join
from kubestrata.functions.paths import kind_of, log_path_cols, with_path_cols
from kubestrata.functions.scalars import (
    age_text, at_literal, blank, first_non_empty, is_sidecar, line_count, micros_between, record, rfc3339, zero,
)
from kubestrata.operators.change import as_yaml, pretty
from kubestrata.operators.health import parse_pods
from kubestrata.operators.select import get_object
from kubestrata.operators.timetravel import explode_items, latest_at, namespace_counts
from kubestrata.schema import (
    BAD_WAITING_REASONS, CONFIG_DDL, POD_CARDS_DDL, POD_HEADLINE_DDL, POD_META_DDL, POD_MOUNTS_DDL, POD_ROWS_DDL,
    PREFERRED_TILES, VIRTUAL_MACHINES, WORKLOAD_DDL, WORKLOADS,
)
from kubestrata.session import written

KEYS = ["capture_id", "path"]
GVR = ["group", "version", "resource"]


# ------------------------------------------------------------------ counts

def capture_info(index: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """Paths, resource types, namespaces, events and duration per capture, from index columns only."""
    snap = F.col("event_type").isNull()
    typed = snap & ~F.col("path").contains("?") & (F.col("resource") != "")
    rows = with_path_cols(index)
    # distinct paths first (map-side combined), so the distinct counts run over paths and not over records
    per_path = rows.groupBy("capture_id", "path", *GVR).agg(
        F.count_if(~snap).alias("events"), F.bool_or(snap).alias("snap"),
        F.min("captured_at").alias("t0"), F.max("captured_at").alias("t1"), F.bool_or(typed).alias("typed"))
    info = per_path.groupBy("capture_id").agg(
        F.count_if("snap").alias("resource_paths"),
        F.count_distinct(F.when(F.col("typed"), F.concat_ws("/", *GVR))).alias("resource_types"),
        F.sum("events").alias("watch_events"), F.min("t0").alias("captured_at"), F.max("t1").alias("captured_until"),
    ).withColumn("duration_seconds", F.round(micros_between("captured_at", "captured_until") / 1e6).cast("bigint"))
    spaces = namespace_counts(index).groupBy("capture_id").agg(F.count_distinct("namespace").alias("namespaces"))
    out = info.join(spaces, "capture_id", "left").fillna({"namespaces": 0})
    if captures is not None:
        facts = ["capture_id", "redacted", "secrets_redacted", "fields_redacted", "auto_discovered", "intervals",
                 "uncompressed_bytes", "deduplicated_count"]
        out = out.join(captures.select(*[c for c in facts if c in captures.columns]), "capture_id", "left")
    return out


def inspect(records: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Per resource: records, items of the latest 200 snapshot, namespaced, sorted namespaces."""
    keys = ["capture_id", *GVR]
    recs = with_path_cols(records.filter("event_type IS NULL").filter(~F.col("path").contains("?")).select(
        *KEYS, "seq", "captured_at", "response_code", "body")).filter("resource <> '' AND version <> ''")
    totals = recs.groupBy(*keys).agg(F.count("*").alias("records"))
    latest = latest_at(recs).filter("response_code = 200")
    own = latest.filter("namespace <> ''").select(*keys, "namespace")
    items = explode_items(latest.select(*keys, "path", "body")).select(*keys, F.col("obj_namespace").alias("namespace"))
    n_items = items.groupBy(*keys).agg(F.count("*").alias("items"))
    # distinct names first: the collected list is the answer itself, one entry per namespace
    spaces = own.unionByName(items.filter("namespace <> ''")).distinct().groupBy(*keys).agg(
        F.array_sort(F.collect_list("namespace")).alias("namespaces"))
    out = totals.join(n_items, keys, "left").join(spaces, keys, "left")
    out = out.withColumns({"items": F.coalesce("items", F.lit(0)),
                           "namespaces": F.coalesce("namespaces", F.array().cast("array<string>"))})
    seen = F.size("namespaces") > 0
    if catalog is not None:
        out = out.join(catalog.select(*keys, F.col("namespaced").alias("_d")), keys, "left")
        seen = F.coalesce("_d", seen)
    return out.withColumn("namespaced", seen).select(*keys, "namespaced", "namespaces", "records", "items").orderBy(
        "capture_id", F.concat_ws("/", *GVR))


def resource_catalog(index: DataFrame, catalog: DataFrame | None = None, at=None) -> DataFrame:
    """Per resource: kind, scope and item count at T; core group first."""
    keys = ["capture_id", *GVR]
    snaps = index.filter("event_type IS NULL").filter(~F.col("path").contains("?"))
    paths = snaps.select(*KEYS).distinct()
    rows = snaps if at is None else snaps.filter(F.col("captured_at") <= at_literal(at))
    counts = rows.groupBy(*KEYS).agg(F.max_by("item_count", "seq").alias("n"))
    per = with_path_cols(paths.join(counts, KEYS, "left")).filter("resource <> ''").groupBy(*keys).agg(
        F.bool_or(F.col("namespace") != "").alias("namespaced"),
        F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("objects"))
    if catalog is None:
        return per.withColumn("kind", kind_of("resource")).orderBy("capture_id", "group", "resource")
    meta = catalog.select(*keys, F.col("kind").alias("_k"), "singular", "short_names")
    return per.join(meta, keys, "left").withColumn("kind", first_non_empty("_k", kind_of("resource"))).drop("_k").orderBy(
        "capture_id", "group", "resource")


def resource_totals(by_namespace: DataFrame, by_cluster: DataFrame) -> DataFrame:
    """Objects per resource; cluster totals only where no namespaced rows exist, so nothing counts twice."""
    keys = ["capture_id", "resource"]
    per_ns = by_namespace.groupBy(*keys).agg(F.sum("objects").alias("objects"))
    return per_ns.unionByName(by_cluster.select(*keys, "objects").join(per_ns, keys, "left_anti"))


def overview_kpis(by_namespace: DataFrame, health: DataFrame, namespaces: DataFrame, events: DataFrame) -> DataFrame:
    """One row of headline numbers per capture."""
    n = lambda names: F.coalesce(F.sum(F.when(F.col("resource").isin(names), F.col("objects"))), F.lit(0))
    counts = by_namespace.groupBy("capture_id").agg(
        n(WORKLOADS).alias("workloads"), n(["pods"]).alias("pods"), n(VIRTUAL_MACHINES).alias("virtual_machines"))
    has = lambda r: F.count_if(F.array_contains("issues", r))
    ill = F.size("issues") > 0
    pods = health.groupBy("capture_id").agg(
        F.count_if(ill).alias("unhealthy_pods"), has("CrashLoopBackOff").alias("crash_loop"), has("Failed").alias("failed"),
        has("OOMKilled").alias("oom_killed"), F.count_if(ill & (F.col("phase") == "Pending")).alias("pending"))
    spaces = namespaces.groupBy("capture_id").agg(F.count("*").alias("namespaces"))
    seen = events.groupBy("capture_id").agg(F.count("*").alias("watch_events"))
    out = counts
    for part in (pods, spaces, seen):
        out = out.join(part, "capture_id", "full_outer")
    return out.fillna(0)


def namespace_summary(by_namespace: DataFrame, health: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per namespace: resources, workloads, pods, unhealthy; listed namespaces without objects included."""
    keys = ["capture_id", "namespace"]
    sum_if = lambda names: F.sum(F.when(F.col("resource").isin(names), F.col("objects")).otherwise(0))
    counts = by_namespace.groupBy(*keys).agg(
        F.sum("objects").alias("resources"), sum_if(WORKLOADS).alias("workloads"), sum_if(["pods"]).alias("pods"))
    ill = health.filter(F.size("issues") > 0).groupBy(*keys).agg(F.count("*").alias("unhealthy"))
    out = counts.join(ill, keys, "left")
    if known is not None:
        out = out.join(known.select(*keys, *[c for c in ("labels",) if c in known.columns]), keys, "full_outer")
    return out.fillna(0, ["resources", "workloads", "pods", "unhealthy"])


def top_namespaces(summary: DataFrame, n: int = 8) -> DataFrame:
    return summary.orderBy(F.desc("resources"), "namespace").limit(n)


def resource_tiles(totals: DataFrame, rest: int = 4) -> DataFrame:
    """Preferred kinds in fixed order, then the ``rest`` largest others, then one "+ N more…" row."""
    order = F.array_position(F.array(*[F.lit(r) for r in PREFERRED_TILES]), F.col("resource"))
    rows = totals.filter("objects > 0").withColumn("rank", order)
    tile = lambda df, rank: df.select("capture_id", rank.alias("rank"), kind_of("resource").alias("kind"), "resource", "objects")
    first = tile(rows.filter("rank > 0"), F.col("rank").cast("bigint"))
    others = rows.filter("rank = 0")
    w = Window.partitionBy("capture_id").orderBy(F.desc("objects"), "resource")
    next_ = tile(others.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= rest), F.col("rn").cast("bigint") + 100)
    more = others.groupBy("capture_id").agg((F.count("*") - rest).alias("n")).filter("n > 0").select(
        "capture_id", F.lit(1000).cast("bigint").alias("rank"),
        F.concat(F.lit("+ "), F.col("n").cast("string"), F.lit(" more…")).alias("kind"), F.lit("").alias("resource"),
        F.lit(0).cast("bigint").alias("objects"))
    return first.unionByName(next_).unionByName(more).orderBy("capture_id", "rank")


# ---------------------------------------------------------------- activity

def bucket_of(ts, start, end, buckets: int) -> Column:
    """Index of the equal-width bucket: step floor(window / n) (1 s when zero), clamped to both ends."""
    width = F.floor(micros_between(start, end) / buckets)
    step = F.when(width > 0, width).otherwise(F.lit(1_000_000))
    return F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(micros_between(start, ts) / step))).cast("int")


def activity(events: DataFrame, captures: DataFrame, buckets: int = 30, namespace: str | None = None,
             pod: str | None = None) -> DataFrame:
    """Events per equal slice of the capture window: total, warn (MODIFIED pods), bad (DELETED pods).

    Empty slices are present. Optionally only one namespace's paths, or one pod's events.
    """
    rows = with_path_cols(events) if namespace is not None or pod is not None else events
    if namespace is not None:
        rows = rows.filter(F.col("namespace") == namespace)
    if pod is not None:
        rows = rows.filter((F.col("resource") == "pods") & (F.col("name") == pod))
    window = captures.select("capture_id", F.col("captured_at").alias("_start"), F.col("captured_until").alias("_end")).filter("_end > _start")
    is_pod = F.col("path").contains("/pods")
    kind = lambda t: F.count_if(is_pod & (F.col("event_type") == t))
    # the window is salted: events of one capture meet it in several tasks and are counted before they meet each other
    hit = salted_join(rows, window, ["capture_id"], ["path", "seq"]).withColumn("bucket", bucket_of("captured_at", "_start", "_end", buckets))
    counts = hit.groupBy("capture_id", "bucket").agg(
        F.count("*").alias("total"), kind("MODIFIED").alias("warn"), kind("DELETED").alias("bad"))
    width = F.floor(micros_between("_start", "_end") / buckets)
    step = F.when(width > 0, width).otherwise(F.lit(1_000_000))
    spine = window.select("capture_id", "_start", step.alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    start = F.col("_start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("bucket") * F.col("_step") / F.lit(1e6)).cast("decimal(18,6)"))
    return spine.join(counts, ["capture_id", "bucket"], "left").select(
        "capture_id", "bucket", start.alias("bucket_start"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "warn", "bad")])


# -------------------------------------------------------------- namespaces

def namespace_kpis(counts: DataFrame, pods: DataFrame, workloads: DataFrame, vms: DataFrame, namespace: str) -> DataFrame:
    """Configmaps, secrets, exact pods, workloads and VMs of a namespace, and the sum of all its objects."""
    other = ~F.col("resource").isin([*WORKLOADS, *VIRTUAL_MACHINES, "pods"])
    pick = lambda r: F.coalesce(F.sum(F.when(F.col("resource") == r, F.col("objects"))), F.lit(0))
    base = counts.filter(F.col("namespace") == namespace).groupBy("capture_id").agg(
        pick("configmaps").alias("configmaps"), pick("secrets").alias("secrets"),
        F.coalesce(F.sum(F.when(other, F.col("objects"))), F.lit(0)).alias("_rest"))
    for df, name in ((pods, "pods"), (workloads, "workloads"), (vms, "virtual_machines")):
        n = df.filter(F.col("namespace") == namespace).groupBy("capture_id").agg(F.count("*").alias(name))
        base = base.join(n, "capture_id", "full_outer")
    base = base.fillna(0)
    return base.withColumn("resources", F.col("_rest") + F.col("pods") + F.col("workloads") + F.col("virtual_machines")).drop("_rest")


def namespace_tiles(counts: DataFrame, namespace: str) -> DataFrame:
    rows = counts.filter((F.col("namespace") == namespace) & (F.col("objects") > 0))
    rows = rows.filter(~F.col("resource").isin([*WORKLOADS, *VIRTUAL_MACHINES, "pods"]))
    return rows.select("capture_id", kind_of("resource").alias("kind"), "resource", "objects").orderBy(F.desc("objects"), "resource")


def severity_order(severity) -> Column:
    return F.when(F.col(severity) == "bad", 0).when(F.col(severity) == "warn", 1).otherwise(2)


def pod_rows(objects: DataFrame, at) -> DataFrame:
    """Pods of namespaced lists: phase, status, severity, ready n/m, restarts, age, labels; worst first."""
    p = parse_pods(objects, POD_ROWS_DDL).filter("namespace <> '' AND name <> ''")
    h = lambda f: F.col(f"health.{f}")
    ill = F.size("health.issues") > 0
    partly = (h("phase") == "Running") & (h("ready") < h("total"))
    severity = F.when(ill, "bad").when(partly | (h("phase") == "Pending"), "warn").otherwise("good")
    status = F.when(ill, F.get(h("issues"), F.lit(0))).when(partly, "NotReady").otherwise(h("phase"))
    ratio = F.concat(h("ready").cast("string"), F.lit("/"), h("total").cast("string"))
    age = age_text(rfc3339(F.col("pod.metadata.creationTimestamp")), at_literal(at))
    rows = p.select("capture_id", "namespace", "name", h("phase").alias("phase"), status.alias("status"),
                    severity.alias("severity"), ratio.alias("ready"), h("restarts").alias("restarts"), age.alias("age"),
                    ill.alias("unhealthy"), F.col("pod.metadata.labels").alias("labels"))
    # a sort reads its rows twice, for the borders of its ranges first: pods are decoded once
    return written(rows, "pod-rows").orderBy(severity_order("severity"), "namespace", "name")


_WORKLOAD_KINDS = {"deployments": "Deployment", "statefulsets": "StatefulSet", "daemonsets": "DaemonSet",
                   "replicasets": "ReplicaSet", "jobs": "Job", "cronjobs": "CronJob"}


def workload_rows(objects: DataFrame, at) -> DataFrame:
    """Six workload kinds with status text and severity; a missing replica count means 0 here."""
    o = objects.filter(F.col("resource").isin(list(_WORKLOAD_KINDS)) & (F.col("namespace") != "")).withColumn(
        "o", F.from_json("obj", WORKLOAD_DDL))
    st = lambda f: zero(f"o.status.{f}")
    res = F.col("resource")
    daemon = res == "daemonsets"
    have = F.when(daemon, st("numberReady")).otherwise(st("readyReplicas"))
    want = F.when(daemon, st("desiredNumberScheduled")).otherwise(zero("o.spec.replicas"))
    active = F.coalesce(F.col("o.status.active").try_cast("bigint"), F.lit(0))
    txt = lambda label, n: F.concat(F.lit(f"{label}: "), n.cast("string"))
    job = res == "jobs"
    status = (
        F.when(res == "cronjobs", "Scheduled")
        .when(job & (st("failed") > 0), txt("Failed", st("failed"))).when(job & (active > 0), txt("Active", active))
        .when(job, txt("Succeeded", st("succeeded")))
        .otherwise(F.concat(have.cast("string"), F.lit("/"), want.cast("string"), F.lit(" Ready"))))
    severity = (
        F.when(res == "cronjobs", "good")
        .when(job, F.when(st("failed") > 0, "bad").when(active > 0, "warn").otherwise("good"))
        .when(want == 0, "neutral").when(have == 0, "bad").when(have < want, "warn").otherwise("good"))
    kind = F.create_map(*[F.lit(x) for kv in _WORKLOAD_KINDS.items() for x in kv])[res]
    return o.select("capture_id", "namespace", kind.alias("kind"), "resource", "name", status.alias("status"),
                    severity.alias("severity"), age_text(rfc3339(F.col("o.metadata.creationTimestamp")), at_literal(at)).alias("age"),
                    F.col("o.metadata.labels").alias("labels")).orderBy(severity_order("severity"), "namespace", "name", "kind")


def vm_rows(objects: DataFrame, at) -> DataFrame:
    o = objects.filter(F.col("resource").isin(VIRTUAL_MACHINES) & (F.col("group") == "kubevirt.io")).withColumn(
        "o", F.from_json("obj", CONFIG_DDL))
    status = first_non_empty("o.status.printableStatus", "o.status.phase")
    return o.select("capture_id", "namespace", F.when(F.col("resource") == "virtualmachines", "VM").otherwise("VMI").alias("kind"),
                    "resource", "name", status.alias("status"),
                    F.when((status != "") & (status != "Running"), "warn").otherwise("good").alias("severity"),
                    age_text(rfc3339(F.col("o.metadata.creationTimestamp")), at_literal(at)).alias("age")).orderBy("namespace", "name", "kind")


def namespace_meta(objects: DataFrame, at, namespace: str | None = None) -> DataFrame:
    """Created, age, phase, labels and annotations of namespace objects."""
    o = objects.filter((F.col("resource") == "namespaces") & (F.col("group") == "")).withColumn("o", F.from_json("obj", CONFIG_DDL))
    if namespace is not None:
        o = o.filter(F.col("name") == namespace)
    created = rfc3339(F.col("o.metadata.creationTimestamp"))
    return o.select("capture_id", "name", created.alias("created_at"), age_text(created, at_literal(at)).alias("age"),
                    blank("o.status.phase").alias("phase"), F.col("o.metadata.labels").alias("labels"),
                    F.col("o.metadata.annotations").alias("annotations"))


def object_rows(objects: DataFrame, resource: str, at, namespace: str | None = None) -> DataFrame:
    """All objects of one plural name: namespace, name, age, labels."""
    o = objects.filter((F.col("resource") == resource) & (F.col("name") != ""))
    if namespace is not None:
        o = o.filter(F.col("namespace") == namespace)
    created = rfc3339(F.get_json_object("obj", "$.metadata.creationTimestamp"))
    return o.select("capture_id", "path", "namespace", "name", age_text(created, at_literal(at)).alias("age"), "labels").orderBy(
        "namespace", "name")


def object_detail(objects: DataFrame, path: str, name: str) -> DataFrame:
    """One object, type-stamped, as pretty JSON and YAML."""
    one = get_object(objects.filter(F.col("path") == path), name).select("capture_id", "path", "name", "obj")

    def run(batches):
        for pdf in batches:
            yield pdf.assign(json=pdf["obj"].map(pretty), yaml=pdf["obj"].map(as_yaml)).drop(columns="obj")

    return one.mapInPandas(run, "capture_id string, path string, name string, json string, yaml string")


# --------------------------------------------------------------- pod detail

def pod_headline(objects: DataFrame, at) -> DataFrame:
    """Severity, reason, subtitle and key facts per pod."""
    p = parse_pods(objects, POD_HEADLINE_DDL)
    h = lambda f: F.col(f"health.{f}")
    ill, partly = F.size("health.issues") > 0, h("ready") < h("total")
    reason = F.when(ill, F.get(h("issues"), F.lit(0))).when(partly, "Some containers not ready").otherwise("")
    n = lambda f: h(f).cast("string")
    subtitle = F.when(reason == "", F.concat(n("ready"), F.lit("/"), n("total"), F.lit(" containers ready · "), n("restarts"), F.lit(" restarts"))).otherwise(
        F.concat(reason, F.lit(" · "), n("restarts"), F.lit(" restarts")))
    return p.select("capture_id", "namespace", "name", h("phase").alias("phase"),
                    F.when(ill, "bad").when(partly, "warn").otherwise("good").alias("severity"), reason.alias("reason"),
                    subtitle.alias("subtitle"), h("restarts").alias("restarts"),
                    age_text(rfc3339(F.col("pod.metadata.creationTimestamp")), at_literal(at)).alias("age"),
                    F.concat(n("ready"), F.lit(" / "), n("total")).alias("ready"), blank("pod.spec.nodeName").alias("node"),
                    blank("pod.status.podIP").alias("pod_ip"), blank("pod.status.qosClass").alias("qos_class"))


def _probe_text(p: Column) -> Column:
    http, tcp, ex = p["httpGet"], p["tcpSocket"], p["exec"]
    return (
        F.when(http.isNotNull(), F.concat(F.lit("HTTP "), F.upper(first_non_empty(http["scheme"], F.lit("GET"))), F.lit(" :"), blank(http["port"]), blank(http["path"])))
        .when(tcp.isNotNull(), F.concat(F.lit("TCP :"), blank(tcp["port"])))
        .when(ex.isNotNull(), F.concat(F.lit("exec "), blank(F.array_join(ex["command"], " ")))).otherwise("configured"))


def _card_spec(c: Column) -> Column:
    probes = [F.when(c[f].isNotNull(), F.concat(F.lit(f"{label} "), _probe_text(c[f]))) for f, label in (
        ("livenessProbe", "liveness"), ("readinessProbe", "readiness"), ("startupProbe", "startup"))]
    port = lambda p: F.concat(zero(p["containerPort"]).cast("string"), F.lit("/"), first_non_empty(p["protocol"], F.lit("TCP")),
                              F.when(blank(p["name"]) != "", F.concat(F.lit(" ("), p["name"], F.lit(")"))).otherwise(""))
    res = c["resources"]
    amount = lambda of, what: blank(F.try_element_at(res[of], F.lit(what)))
    return record(
        name=blank(c["name"]), image=blank(c["image"]), cpu_request=amount("requests", "cpu"), cpu_limit=amount("limits", "cpu"),
        memory_request=amount("requests", "memory"), memory_limit=amount("limits", "memory"),
        probes=F.array_compact(F.array(*probes)), ports=F.coalesce(F.transform(c["ports"], port), F.array().cast("array<string>")))


def container_cards(objects: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """Container status joined to its spec by name inside the pod row (a later spec of a name wins).

    ``logs`` (capture_id, namespace, pod, container, previous, tail) adds the log tail and whether an earlier
    log exists.
    """
    p = parse_pods(objects, POD_CARDS_DDL, containers=True)
    specs = F.concat(*[F.coalesce(F.transform(f"pod.spec.{f}", _card_spec), F.array()) for f in ("initContainers", "containers")])
    # specs keyed by container name inside the row; for repeated names the last one counts
    by_name = F.map_from_entries(F.transform(specs, lambda x: record(k=x["name"], v=x)))
    rows = p.select("capture_id", "namespace", F.col("name").alias("pod"), by_name.alias("_specs"),
                    F.posexplode("health.containers").alias("pos", "c"))
    rows = rows.withColumn("s", F.try_element_at("_specs", F.col("c.name")))
    c = lambda f: F.col(f"c.{f}")
    n = c("restart_count").cast("string")
    reason, code = c("state_reason"), c("last_exit_code").cast("string")
    badge = (
        F.when(c("state") == "Running", F.concat(F.lit("Running · "), n, F.lit(" restarts")))
        .when(c("state") == "Waiting", F.concat(first_non_empty(reason, F.lit("Waiting")), F.lit(" · "), n, F.lit(" restarts")))
        .when(c("state") == "Terminated", F.when(reason != "", F.concat(F.lit("Terminated · "), reason, F.lit(" · exit "), code)).otherwise(
            F.concat(F.lit("Terminated · exit "), code))).otherwise("Unknown"))
    ended = (c("state") == "Terminated") & ~c("ready")
    severity = (
        F.when(c("state") == "Waiting", F.when(reason.isin(BAD_WAITING_REASONS), "bad").otherwise("warn"))
        .when(ended, F.when(c("is_init") & (c("last_exit_code") == 0), "good").otherwise("bad"))
        .when(c("restart_count") > 0, "warn").otherwise("good"))
    out = rows.select(
        "capture_id", "namespace", "pod", "pos", c("name").alias("container"),
        F.when(c("is_init"), "init").when(is_sidecar(c("name")), "side").otherwise("main").alias("role"),
        first_non_empty(c("image"), "s.image").alias("image"), c("state").alias("state"), badge.alias("state_badge"),
        severity.alias("severity"), c("restart_count").alias("restart_count"), c("last_terminated").alias("last_terminated"),
        c("last_exit_code").alias("last_exit_code"),
        *[blank(f"s.{f}").alias(f) for f in ("cpu_request", "cpu_limit", "memory_request", "memory_limit")],
        *[F.coalesce(f"s.{f}", F.array().cast("array<string>")).alias(f) for f in ("probes", "ports")])
    if logs is None:
        return out
    keys = ["capture_id", "namespace", "pod", "container"]
    tails = logs.groupBy(*keys).agg(F.max_by(F.when(~F.col("previous"), F.col("tail")), F.when(~F.col("previous"), 1)).alias("log_tail"),
                                    F.bool_or("previous").alias("has_previous_log"))
    return out.join(tails, keys, "left").fillna({"has_previous_log": False})


def pod_meta(objects: DataFrame) -> DataFrame:
    """Conditions with severity, labels, annotations and creation time per pod."""
    p = objects.filter("resource = 'pods'").withColumn("o", F.from_json("obj", POD_META_DDL))
    cond = lambda c: F.struct(blank(c["type"]).alias("type"), blank(c["status"]).alias("status"), blank(c["reason"]).alias("reason"),
                              F.when(c["status"] == "True", "good").when(c["status"] == "False", "bad").otherwise("neutral").alias("severity"))
    return p.select("capture_id", "namespace", "name", rfc3339(F.col("o.metadata.creationTimestamp")).alias("created_at"),
                    F.transform("o.status.conditions", cond).alias("conditions"),
                    F.col("o.metadata.labels").alias("labels"), F.col("o.metadata.annotations").alias("annotations"))


def pod_related(objects: DataFrame) -> DataFrame:
    """First owner, and configmaps, secrets and claims mounted as volumes."""
    p = objects.filter("resource = 'pods'").withColumn("o", F.from_json("obj", POD_MOUNTS_DDL))
    vol = lambda pick: F.filter(F.transform("o.spec.volumes", pick), lambda n: n.isNotNull() & (n != ""))
    owner = F.get(F.col("o.metadata.ownerReferences"), F.lit(0))
    return p.select("capture_id", "namespace", "name", owner["kind"].alias("owner_kind"), owner["name"].alias("owner_name"),
                    vol(lambda v: v["configMap"]["name"]).alias("configmaps"), vol(lambda v: v["secret"]["secretName"]).alias("secrets"),
                    vol(lambda v: v["persistentVolumeClaim"]["claimName"]).alias("claims"))


# --------------------------------------------------------------------- logs

def log_text(body) -> Column:
    """Text of a log body: the JSON string decoded, else the raw body."""
    body = F.col(body) if isinstance(body, str) else body
    decoded = F.get(F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(F.trim(body).startswith('"'), F.coalesce(decoded, body)).otherwise(body)


def pod_log(records: DataFrame, namespace: str, pod: str, container: str | None = None, previous: bool = False, at=None) -> DataFrame:
    """One pod's log text, line count and available variants. Without a container: the first by name that has
    the wanted variant, sidecars only when nothing else has it."""
    p = log_path_cols("path")
    logs = records.filter((p["namespace"] == namespace) & (p["pod"] == pod) & (p["container"] != "")).select("*", p.alias("p"))
    flags = logs.groupBy("capture_id", F.col("p.container").alias("container")).agg(
        F.bool_or(~F.col("p.previous")).alias("has_current"), F.bool_or(F.col("p.previous")).alias("has_previous"))
    wanted = flags.filter("has_previous" if previous else "has_current")
    side = is_sidecar("container")
    # among sidecars the last by name is what a scan that keeps looking ends on
    chosen = flags.filter(F.col("container") == container) if container else wanted.groupBy("capture_id").agg(
        F.coalesce(F.min(F.when(~side, F.col("container"))), F.max(F.when(side, F.col("container")))).alias("container"))
    pick = logs.filter(F.col("p.previous") == previous).withColumn("container", F.col("p.container")).join(
        chosen.select("capture_id", "container"), ["capture_id", "container"], "left_semi")
    body = latest_at(pick.drop("p"), at).filter("response_code = 200").withColumn("text", log_text("body"))
    options = flags.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("container", "has_current", "has_previous"))).alias("containers"))
    return body.select("capture_id", "container", "text", line_count("text").alias("line_count")).join(options, "capture_id")


def log_tail(records: DataFrame, n: int = 8, at=None) -> DataFrame:
    """Last n lines per log path, in order; trailing newlines do not count as lines."""
    p = log_path_cols("path")
    logs = latest_at(records.filter(p.isNotNull()), at).filter("response_code = 200").withColumn("text", log_text("body")).filter("text <> ''")
    lines = F.split(F.regexp_replace("text", "\n+$", ""), "\n")
    return logs.select("capture_id", "path", p["namespace"].alias("namespace"), p["pod"].alias("pod"),
                       p["container"].alias("container"), p["previous"].alias("previous"),
                       F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n).alias("tail"))


def tail_of_lines(lines: DataFrame, keys: list[str], order: list[str], n: int = 8) -> DataFrame:
    """Last n rows per key of an already split log; each task keeps n rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return lines.withColumn("from_end", F.row_number().over(w)).filter(F.col("from_end") <= n)
