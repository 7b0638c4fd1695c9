"""Tabular views: objects flattened to the columns a resource kind is listed with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kubestrata.functions import jsonpath
from kubestrata.functions.ordered import salted_join
from kubestrata.functions.scalars import (
    access_modes, age_short, at_literal, blank, first_non_empty, map_text, or_none, rfc3339, zero,
)
from kubestrata.operators.timetravel import latest_at
from kubestrata.schema import (
    CONFIG_DDL, CRD_DDL, ENDPOINTS_DDL, EVENT_DDL, NODE_DDL, POD_VIEW_DDL, SERVICE_DDL, VOLUME_DDL, WORKLOAD_DDL,
)

# cells read the parsed payload column ``o``

@dataclass
class Col:
    """One column of a view; ``wide`` ones only show on request. ``cell`` None means computed age; where ``when`` is given and
    does not hold, the cell is null."""

    name: str
    cell: Callable[[], Column] | None
    wide: bool = False
    when: Callable[[], Column] | None = None


def _s(path: str) -> Callable[[], Column]:
    return lambda: blank(f"o.{path}")


def _none(path: str) -> Callable[[], Column]:
    return lambda: or_none(f"o.{path}")


def _n(path: str) -> Callable[[], Column]:
    return lambda: zero(f"o.{path}").cast("bigint")


def _size(path: str) -> Callable[[], Column]:
    return lambda: F.greatest(F.coalesce(F.size(f"o.{path}"), F.lit(0)), F.lit(0)).cast("bigint")


def _ratio(have: str, want: str) -> Callable[[], Column]:
    return lambda: F.concat(zero(f"o.{have}").cast("string"), F.lit("/"), zero(f"o.{want}").cast("string"))


def _join(arr: Column, empty: str = "") -> Column:
    text = blank(F.array_join(F.filter(arr, lambda x: x.isNotNull()), ","))
    return F.when(text == "", empty).otherwise(text) if empty else text


AGE = Col("Age", None)


# ---------------------------------------------------------------- cell rules

def node_status() -> Column:
    ready = F.filter("o.status.conditions", lambda c: c["type"] == "Ready")
    last = F.when(F.size(ready) > 0, F.element_at(ready, -1)["status"])
    text = F.when(F.size(ready) < 1, "Unknown").when(ready.isNull(), "Unknown").when(
        last.eqNullSafe(F.lit("True")), "Ready").otherwise("NotReady")
    return F.concat(text, F.when(F.col("o.spec.unschedulable"), ",SchedulingDisabled").otherwise(""))


def node_roles() -> Column:
    role = "node-role.kubernetes.io/"
    keys = F.filter(F.map_keys("o.metadata.labels"), lambda k: k.startswith(role) & (k != role))
    return _join(F.array_sort(F.transform(keys, lambda k: F.substring(k, len(role) + 1, 1 << 30))), "<none>")


def node_address(kind: str) -> Callable[[], Column]:
    def cell() -> Column:
        hits = F.filter("o.status.addresses", lambda a: a["type"] == kind)
        first = F.get(hits, F.lit(0))
        return F.when(first.isNull(), "<none>").otherwise(blank(first["address"]))

    return cell


def pod_ready() -> Column:
    cs = F.coalesce("o.status.containerStatuses", F.array())
    total = F.when(F.size("o.spec.containers") > 0, F.size("o.spec.containers")).otherwise(F.size(cs))
    return F.concat(F.size(F.filter(cs, lambda c: c["ready"])).cast("string"), F.lit("/"), total.cast("string"))


def pod_restarts() -> Column:
    counts = F.transform(F.coalesce("o.status.containerStatuses", F.array()), lambda c: zero(c["restartCount"]))
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)


def pod_status() -> Column:
    reasons = F.filter(
        F.transform("o.status.containerStatuses", lambda c: first_non_empty(
            c["state"]["waiting"]["reason"], c["state"]["terminated"]["reason"])),
        lambda r: r != "")
    return F.when(blank("o.metadata.deletionTimestamp") != "", "Terminating").otherwise(
        first_non_empty(F.get(reasons, F.lit(0)), "o.status.reason", "o.status.phase"))


def job_status() -> Column:
    done = F.filter("o.status.conditions", lambda c: (c["status"] == "True") & c["type"].isin("Complete", "Failed"))
    return F.coalesce(F.get(done, F.lit(0))["type"], F.when(F.col("o.spec.suspend"), "Suspended"), F.lit("Running"))


def _template_containers() -> Column:
    own, cron = F.col("o.spec.template.spec.containers"), F.col("o.spec.jobTemplate.spec.template.spec.containers")
    return F.when(F.size(own) > 0, own).otherwise(cron)


def containers_cell() -> Column:
    return _join(F.transform(_template_containers(), lambda c: blank(c["name"])))


def images_cell() -> Column:
    return _join(F.transform(_template_containers(), lambda c: blank(c["image"])))


_FLAT, _STRUCT = "map<string,string>", "matchLabels map<string,string>, matchExpressions array<struct<key:string,operator:string,values:array<string>>>"


def _is_structured(text: Column) -> Column:
    return F.get_json_object(text, "$.matchLabels").isNotNull() | F.get_json_object(text, "$.matchExpressions").isNotNull()


def selector_cell() -> Column:
    text = F.col("o.spec.selector")
    labels = map_text(F.from_json(text, _STRUCT)["matchLabels"])
    flat = F.when(~_is_structured(text), map_text(F.from_json(text, _FLAT)))
    return or_none(first_non_empty(labels, flat))


def external_ip() -> Column:
    points = _join(F.transform("o.status.loadBalancer.ingress", lambda i: F.nullif(first_non_empty(i["ip"], i["hostname"]), F.lit(""))))
    kind = F.col("o.spec.type")
    return (F.when(kind == "LoadBalancer", F.when(points == "", "<pending>").otherwise(points))
            .when(kind == "ExternalName", or_none("o.spec.externalName"))
            .otherwise(_join(F.col("o.spec.externalIPs"), "<none>")))


def service_ports() -> Column:
    def one(p: Column) -> Column:
        node = zero(p["nodePort"])
        return F.concat(zero(p["port"]).cast("string"), F.when(node != 0, F.concat(F.lit(":"), node.cast("string"))).otherwise(""),
                        F.lit("/"), first_non_empty(p["protocol"], F.lit("TCP")))

    return _join(F.transform("o.spec.ports", one), "<none>")


def endpoints_cell() -> Column:
    pair = lambda a, ports: F.transform(ports, lambda p: F.concat(blank(a["ip"]), F.lit(":"), zero(p["port"]).cast("string")))
    per_subset = F.transform("o.subsets", lambda s: F.flatten(F.transform(
        F.coalesce(s["addresses"], F.array()), lambda a: pair(a, F.coalesce(s["ports"], F.array())))))
    eps = F.flatten(per_subset)
    shown = _join(F.slice(eps, 1, 3), "<none>")
    return F.when(F.size(eps) >= 3, F.concat(shown, F.lit(" + more..."))).otherwise(shown)


def ingress_hosts() -> Column:
    return _join(F.filter(F.transform("o.spec.rules", lambda r: r["host"]), lambda h: h != ""), "*")


def ingress_address() -> Column:
    return _join(F.transform("o.status.loadBalancer.ingress", lambda i: F.nullif(first_non_empty(i["ip"], i["hostname"]), F.lit(""))))


def modes_cell() -> Column:
    spec = F.col("o.spec.accessModes")
    return access_modes(F.when(F.size(spec) > 0, spec).otherwise(F.col("o.status.accessModes")))


def claim_cell() -> Column:
    ns, name = blank("o.spec.claimRef.namespace"), blank("o.spec.claimRef.name")
    return F.when(name == "", "").when(ns == "", name).otherwise(F.concat(ns, F.lit("/"), name))


def data_count() -> Column:
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return (n("o.data") + n("o.binaryData")).cast("bigint")


def event_object() -> Column:
    ref = F.coalesce("o.involvedObject", F.when(F.col("o.regarding").isNotNull(), F.struct(
        *[F.col(f"o.regarding.{f}").alias(f) for f in ("kind", "namespace", "name", "uid")])))
    kind, name = blank(ref["kind"]), blank(ref["name"])
    return F.when((kind == "") & (name == ""), "").otherwise(F.concat(F.lower(kind), F.lit("/"), name))


# ------------------------------------------------------------------ printers

def _wide(*cols: Col) -> list[Col]:
    return [Col(c.name, c.cell, True) for c in cols]


_TEMPLATE_COLS = [Col("Containers", containers_cell), Col("Images", images_cell)]
_SELECTOR = Col("Selector", selector_cell)
_REPLICAS = [Col("Desired", _n("spec.replicas")), Col("Current", _n("status.replicas")), Col("Ready", _n("status.readyReplicas")),
             AGE, *_wide(*_TEMPLATE_COLS, _SELECTOR)]
_EVENTS = [Col("Type", _s("type")), Col("Reason", _s("reason")), Col("Object", event_object),
           Col("Message", lambda: first_non_empty("o.message", "o.note")), AGE]

# (group, resource) -> (payload schema, columns after Name)
PRINTERS: dict[tuple[str, str], tuple[str, list[Col]]] = {
    ("", "nodes"): (NODE_DDL, [
        Col("Status", node_status), Col("Roles", node_roles), AGE, Col("Version", _s("status.nodeInfo.kubeletVersion")),
        *_wide(Col("Internal-IP", node_address("InternalIP")), Col("External-IP", node_address("ExternalIP")),
               Col("OS-Image", _s("status.nodeInfo.osImage")), Col("Kernel-Version", _s("status.nodeInfo.kernelVersion")),
               Col("Container-Runtime", _s("status.nodeInfo.containerRuntimeVersion")))]),
    ("", "pods"): (POD_VIEW_DDL, [
        Col("Ready", pod_ready), Col("Status", pod_status), Col("Restarts", pod_restarts), AGE,
        *_wide(Col("IP", _none("status.podIP")), Col("Node", _none("spec.nodeName")),
               Col("Nominated Node", _none("status.nominatedNodeName")),
               Col("Readiness Gates", lambda: F.when(F.size("o.spec.readinessGates") > 0,
                                                     F.size("o.spec.readinessGates").cast("string")).otherwise("<none>")))]),
    ("apps", "deployments"): (WORKLOAD_DDL, [
        Col("Ready", _ratio("status.readyReplicas", "spec.replicas")), Col("Up-To-Date", _n("status.updatedReplicas")),
        Col("Available", _n("status.availableReplicas")), AGE, *_wide(*_TEMPLATE_COLS, _SELECTOR)]),
    ("apps", "replicasets"): (WORKLOAD_DDL, _REPLICAS),
    ("", "replicationcontrollers"): (WORKLOAD_DDL, _REPLICAS),
    ("apps", "statefulsets"): (WORKLOAD_DDL, [
        Col("Ready", _ratio("status.readyReplicas", "spec.replicas")), AGE, *_wide(*_TEMPLATE_COLS)]),
    ("apps", "daemonsets"): (WORKLOAD_DDL, [
        Col("Desired", _n("status.desiredNumberScheduled")), Col("Current", _n("status.currentNumberScheduled")),
        Col("Ready", _n("status.numberReady")), Col("Up-To-Date", _n("status.updatedNumberScheduled")),
        Col("Available", _n("status.numberAvailable")),
        Col("Node Selector", lambda: or_none(map_text("o.spec.template.spec.nodeSelector"))), AGE,
        *_wide(*_TEMPLATE_COLS, _SELECTOR)]),
    ("batch", "jobs"): (WORKLOAD_DDL, [
        Col("Status", job_status),
        Col("Completions", lambda: F.concat(zero("o.status.succeeded").cast("string"), F.lit("/"),
                                            F.coalesce(F.col("o.spec.completions"), F.lit(1)).cast("string"))),
        AGE, *_wide(*_TEMPLATE_COLS, _SELECTOR)]),
    ("batch", "cronjobs"): (WORKLOAD_DDL, [
        Col("Schedule", _s("spec.schedule")),
        Col("Suspend", lambda: F.when(F.col("o.spec.suspend"), "True").otherwise("False")),
        Col("Active", lambda: F.coalesce(F.json_array_length("o.status.active"), F.lit(0)).cast("bigint")),
        Col("Last Schedule", _none("status.lastScheduleTime")), AGE, *_wide(*_TEMPLATE_COLS)]),
    ("", "services"): (SERVICE_DDL, [
        Col("Type", _none("spec.type")), Col("Cluster-IP", _none("spec.clusterIP")), Col("External-IP", external_ip),
        Col("Port(s)", service_ports), AGE, *_wide(Col("Selector", lambda: or_none(map_text("o.spec.selector"))))]),
    ("", "endpoints"): (ENDPOINTS_DDL, [Col("Endpoints", endpoints_cell), AGE]),
    ("networking.k8s.io", "ingresses"): (SERVICE_DDL, [
        Col("Class", _none("spec.ingressClassName")), Col("Hosts", ingress_hosts), Col("Address", ingress_address),
        Col("Ports", lambda: F.when(F.size("o.spec.tls") > 0, "80, 443").otherwise("80")), AGE]),
    ("", "configmaps"): (CONFIG_DDL, [Col("Data", data_count), AGE]),
    ("", "secrets"): (CONFIG_DDL, [Col("Type", _s("type")), Col("Data", _size("data")), AGE]),
    ("", "persistentvolumeclaims"): (VOLUME_DDL, [
        Col("Status", _s("status.phase")), Col("Volume", _s("spec.volumeName")), Col("Capacity", _s("status.capacity.storage")),
        Col("Access Modes", modes_cell), Col("Storageclass", _s("spec.storageClassName")), AGE]),
    ("", "persistentvolumes"): (VOLUME_DDL, [
        Col("Capacity", _s("spec.capacity.storage")), Col("Access Modes", modes_cell),
        Col("Reclaim Policy", _s("spec.persistentVolumeReclaimPolicy")), Col("Status", _s("status.phase")),
        Col("Claim", claim_cell), Col("Storageclass", _s("spec.storageClassName")), AGE]),
    ("", "namespaces"): (CONFIG_DDL, [Col("Status", _s("status.phase")), AGE]),
    ("", "serviceaccounts"): (CONFIG_DDL, [Col("Secrets", _size("secrets")), AGE]),
    ("", "events"): (EVENT_DDL, _EVENTS),
    ("events.k8s.io", "events"): (EVENT_DDL, _EVENTS),
}

_NAME = Col("Name", _s("metadata.name"))
_ROW = ["capture_id", "path"]


def _render(objects: DataFrame, ddl: str, cols: list[Col], at, wide: bool, metadata: bool = False) -> DataFrame:
    ref = at_literal(at) if at is not None else F.col("captured_until") if "captured_until" in objects.columns else None
    created = rfc3339(F.col("o.metadata.creationTimestamp"))
    age = age_short(created, ref if ref is not None else created)
    shown = [c for c in cols if wide or not c.wide]
    keep = [c for c in objects.columns if c != "obj"] + (["obj"] if metadata else [])
    parsed = objects.select(*[c for c in objects.columns], F.from_json("obj", ddl).alias("o"))
    base = [F.col(c) for c in _ROW if c in keep]
    meta = [F.get_json_object("obj", "$.metadata").alias("metadata")] if metadata else []
    cells = [age if c.cell is None else c.cell() for c in shown]
    return parsed.select(*base, *meta, *[(v if c.when is None else F.when(c.when(), v)).alias(c.name) for c, v in zip(shown, cells, strict=True)])


def view_builtin(objects: DataFrame, group: str, resource: str, at=None, wide: bool = False, metadata: bool = False) -> DataFrame:
    ddl, cols = PRINTERS[group, resource]
    return _render(objects, ddl, [_NAME, *cols], at, wide, metadata)


def view_generic(objects: DataFrame, at=None, namespaced: bool | None = None) -> DataFrame:
    """Name, Namespace (when any object has one) and Age."""
    if namespaced is None:
        namespaced = not objects.filter(F.col("obj_namespace") != "").isEmpty()
    ns = [Col("Namespace", _s("metadata.namespace"))] if namespaced else []
    return _render(objects, CONFIG_DDL, [_NAME, *ns, AGE], at, False)


def _with_columns(objects: DataFrame, columns: DataFrame, of, wide: bool) -> tuple[DataFrame, list[Col]]:
    """Objects with their own capture's ``_columns``, and the columns of all captures in order: a cell is null where the
    object's capture does not define its column. ``of(name, expression)`` is a cell.

    The different columns come to the driver, as they are the header of the result; which capture has which stays in the plan.
    """
    expr = lambda c: F.coalesce(c["jsonPath"], F.lit(""))
    hidden = lambda c: F.coalesce(c["priority"], F.lit(0)) > 0
    each = columns.select(F.posexplode("columns").alias("i", "c"))
    seen = each.groupBy(F.col("c.name").alias("name"), expr(F.col("c")).alias("expr")).agg(
        F.min("i").alias("i"), F.bool_and(hidden(F.col("c"))).alias("wide")).orderBy("i", "name", "expr").collect()
    out = []
    for name in dict.fromkeys(r["name"] for r in seen):
        own = [r for r in seen if r["name"] == name]
        has = lambda e, name=name: F.coalesce(F.exists("_columns", lambda c: (c["name"] == name) & (expr(c) == e) & (F.lit(wide) | ~hidden(c))), F.lit(False))
        cells = {r["expr"]: of(name, r["expr"]) for r in own}
        one = next(iter(cells.values()))
        cell = one if len(cells) == 1 else lambda cells=cells, has=has: F.coalesce(*[F.when(has(e), c()) for e, c in cells.items()])
        out.append(Col(name, cell, all(r["wide"] for r in own), lambda own=own, has=has: reduce(Column.__or__, [has(r["expr"]) for r in own])))
    return salted_join(objects, columns.select("capture_id", F.col("columns").alias("_columns")), ["capture_id"], ["name"], "left"), out


def _custom_cell(expression: str) -> Callable[[], Column]:
    def cell() -> Column:
        if not expression:
            return F.lit("")
        try:
            return blank(jsonpath.as_text(jsonpath.evaluate("obj", expression)))
        except ValueError:
            return F.lit("")

    return cell


def view_custom(objects: DataFrame, columns: list[dict] | DataFrame, at=None, wide: bool = False) -> DataFrame:
    """Columns from a custom resource definition's printer JSONPaths for one version: one list for all objects, or
    each capture's own (``custom_columns``)."""
    if isinstance(columns, DataFrame):
        objects, cols = _with_columns(objects, columns, lambda _name, e: _custom_cell(e), wide)
    else:
        cols = [Col(c["name"], _custom_cell(c.get("jsonPath") or ""), bool(c.get("priority"))) for c in columns]
    return _render(objects, CONFIG_DDL, [_NAME, *cols, AGE], at, wide)


def custom_columns(crds: DataFrame, group: str, version: str, resource: str) -> DataFrame:
    """capture_id, columns: the printer columns of one custom resource version in each capture that defines some; of several
    definitions in a capture the first by path and position."""
    spec = F.from_json("obj", CRD_DDL)["spec"]
    rows = (
        crds.select("capture_id", "path", "position", spec.alias("s")).filter((F.col("s.group") == group) & (F.col("s.names.plural") == resource))
        .select("capture_id", "path", "position", F.explode("s.versions").alias("v")).filter(F.col("v.name") == version)
    )
    first = rows.groupBy("capture_id").agg(F.min_by("v.additionalPrinterColumns", F.struct("path", "position")).alias("columns"))
    return first.filter(F.size("columns") > 0)


def captured_columns_each(records: DataFrame, list_path: str, cluster_path: str, at=None) -> DataFrame:
    """capture_id, columns: definitions captured for a list: its own Table, then its TableSchema, then the cluster path's."""
    candidates = [p + s for p in dict.fromkeys([list_path, cluster_path]) for s in ("?as=Table", "?as=TableSchema")]
    defs = F.from_json(F.get_json_object("body", "$.columnDefinitions"),
                       "array<struct<name: string, type: string, priority: int, description: string, jsonPath: string>>")
    rows = latest_at(records.filter(F.col("path").isin(candidates)), at).filter("response_code = 200").select(
        "capture_id", "path", defs.alias("d")).filter(F.size("d") > 0)
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("path"))
    return rows.groupBy("capture_id").agg(F.min_by("d", rank).alias("columns"))


def captured_columns(records: DataFrame, list_path: str, cluster_path: str, at=None) -> list[dict]:
    """The captured definitions where all captures have the same ones; an error where they differ."""
    found = captured_columns_each(records, list_path, cluster_path, at).select("columns").distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError("captures differ in their columns: use captured_columns_each")
    return [d.asDict() for r in found for d in r["columns"]]


def view_captured(objects: DataFrame, columns: list[dict] | DataFrame, group: str, resource: str, at=None, wide: bool = False) -> DataFrame:
    """Captured columns, one list or each capture's own: cells this library knows are computed, the others are null."""
    ddl, known = PRINTERS.get((group, resource), (CONFIG_DDL, []))
    cells = {c.name.lower(): c.cell for c in known if c.cell is not None}

    def cell(name: str) -> Callable[[], Column] | None:
        return {"name": _s("metadata.name"), "namespace": _s("metadata.namespace"), "age": None}.get(
            name.lower(), cells.get(name.lower(), lambda: F.lit(None).cast("string")))

    if isinstance(columns, DataFrame):
        objects, cols = _with_columns(objects, columns, lambda name, _e: cell(name), wide)
    else:
        cols = [Col(c["name"], cell(c["name"]), bool(c.get("priority"))) for c in columns]
    return _render(objects, ddl, cols, at, wide)


def view(objects: DataFrame, group: str, version: str, resource: str, at=None, wide: bool = False,
         crds: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """The view a list of one kind gets: custom columns, else captured ones, else built in, else generic.

    With several captures the first of these that any of them has is taken, with each capture's own columns; a capture
    without any shows null in them.
    """
    base = f"/apis/{group}/{version}" if group else f"/api/{version}"
    if group and crds is not None and not (cols := custom_columns(crds, group, version, resource)).isEmpty():
        return view_custom(objects, cols, at, wide)
    if tables is not None and not (cols := captured_columns_each(tables, f"{base}/{resource}", f"{base}/{resource}", at)).isEmpty():
        return view_captured(objects, cols, group, resource, at, wide)
    if (group, resource) in PRINTERS:
        return view_builtin(objects, group, resource, at, wide)
    return view_generic(objects, at)


# --------------------------------------------------------------- scale, CRDs

def selector_text(text) -> Column:
    """Selector as a string: a flat map or matchLabels as k=v, matchExpressions as in/notin/key/!key."""
    text = F.col(text) if isinstance(text, str) else text
    st = F.from_json(text, _STRUCT)
    labels = F.transform(F.map_entries(F.coalesce(st["matchLabels"], F.create_map().cast(_FLAT))),
                         lambda e: F.struct(e["key"].alias("k"), F.concat(e["key"], F.lit("="), e["value"]).alias("t")))
    values = lambda e: F.concat(F.lit(" ("), F.array_join(F.array_sort(e["values"]), ","), F.lit(")"))
    exprs = F.transform(F.filter(st["matchExpressions"], lambda e: e["key"].isNotNull()), lambda e: F.struct(
        e["key"].alias("k"),
        F.when(e["operator"] == "In", F.concat(e["key"], F.lit(" in"), values(e)))
        .when(e["operator"] == "NotIn", F.concat(e["key"], F.lit(" notin"), values(e)))
        .when(e["operator"] == "DoesNotExist", F.concat(F.lit("!"), e["key"])).otherwise(e["key"]).alias("t")))
    parts = F.array_sort(F.concat(labels, F.coalesce(exprs, F.array().cast("array<struct<k:string,t:string>>"))))
    structured = F.array_join(F.transform(parts, lambda p: p["t"]), ",")
    return blank(F.when(_is_structured(text), structured).otherwise(map_text(F.from_json(text, _FLAT))))


def view_scale(objects: DataFrame) -> DataFrame:
    """Workloads as scale rows: wanted replicas, current replicas, selector string."""
    o = objects.select("*", F.from_json("obj", WORKLOAD_DDL).alias("o"))
    return o.select(
        "capture_id", "path", "name", F.col("obj_namespace").alias("namespace"),
        zero("o.spec.replicas").alias("replicas"), zero("o.status.replicas").alias("current_replicas"),
        selector_text("o.spec.selector").alias("selector"))


def crd_catalog(objects: DataFrame) -> DataFrame:
    """Served versions of custom resource definitions as catalog rows; incomplete definitions are skipped."""
    s = objects.filter(F.col("resource") == "customresourcedefinitions").select(
        "capture_id", F.from_json("obj", CRD_DDL)["spec"].alias("s"))
    legacy = F.array(F.struct(F.col("s.version").alias("name"), F.lit(True).alias("served")))
    versions = F.when(F.size("s.versions") > 0, F.transform("s.versions", lambda v: F.struct(
        v["name"].alias("name"), v["served"].alias("served")))).otherwise(legacy)
    usable = (blank("s.group") != "") & (blank("s.names.plural") != "") & (blank("s.names.kind") != "") & F.col(
        "s.scope").isin("Namespaced", "Cluster")
    return s.filter(usable).select("capture_id", "s", F.explode(versions).alias("v")).filter(
        F.col("v.served") & (blank("v.name") != "")).select(
        "capture_id", F.col("s.group").alias("group"), F.col("v.name").alias("version"),
        F.col("s.names.plural").alias("resource"), (F.col("s.scope") == "Namespaced").alias("namespaced"),
        F.col("s.names.kind").alias("kind"), F.col("s.names.singular").alias("singular"),
        F.col("s.names.shortNames").alias("short_names"))
