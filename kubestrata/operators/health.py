"""Pod health, diagnosis rules and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kubestrata.functions.ordered import salted_join
from kubestrata.functions.paths import with_path_cols
from kubestrata.functions.scalars import (
    blank, first_non_empty, let, minor_version, pod_prefix, reason_slug, record, stored, zero,
)
from kubestrata.schema import (
    BAD_ISSUES, BENIGN_REASONS, DAEMON_SUGGESTION, DEPRECATED_APIS, ISSUE_PRIORITY, NODE_DDL, OBJECT_RULES,
    OTHER_REASON_SUGGESTION, POD_HEALTH_DDL, POD_RULES_DDL, POD_STATUS_DDL, REASON_RULES, REPLICA_SUGGESTION, VOLUME_DDL, WORKLOAD_DDL,
)

SEVERITIES = ["info", "warning", "critical"]
FINDING = ["capture_id", "rule_id", "severity", "category", "title", "kind", "namespace", "name", "path",
           "evidence", "suggestion", "count"]


def _container(is_init: bool):
    def build(c: Column) -> Column:
        st = c["state"]
        running = st["running"].isNotNull()
        waiting = st["waiting"].isNotNull() & ~running
        term = st["terminated"].isNotNull() & ~running & st["waiting"].isNull()
        last = c["lastState"]["terminated"]
        code = F.when(term, zero(st["terminated"]["exitCode"])).otherwise(0)
        reason = F.when(waiting, blank(st["waiting"]["reason"])).when(term, blank(st["terminated"]["reason"])).otherwise("")
        excused = F.lit(is_init) & term & (code == 0)
        return record(
            name=blank(c["name"]), image=blank(c["image"]), ready=F.coalesce(c["ready"], F.lit(False)),
            restart_count=zero(c["restartCount"]), is_init=is_init,
            state=F.when(running, "Running").when(waiting, "Waiting").when(term, "Terminated").otherwise(""),
            state_reason=reason,
            state_message=F.when(waiting, blank(st["waiting"]["message"])).when(term, blank(st["terminated"]["message"])).otherwise(""),
            last_terminated=blank(last["reason"]),
            last_exit_code=F.when((code == 0) & last.isNotNull(), zero(last["exitCode"])).otherwise(code),
            issue=F.when(excused, "").otherwise(reason),
        )

    return build


def _issue(is_init: bool):
    """A container's issue alone; "" for none."""
    def build(c: Column) -> Column:
        st = c["state"]
        ended = blank(st["terminated"]["reason"])
        if is_init:  # an init container that ended well is done
            ended = F.when(zero(st["terminated"]["exitCode"]) == 0, "").otherwise(ended)
        return F.when(st["running"].isNotNull(), "").when(st["waiting"].isNotNull(), blank(st["waiting"]["reason"])).otherwise(ended)

    return build


_STATUS_LISTS = (("initContainerStatuses", True), ("containerStatuses", False))


def containers_of(status: Column) -> Column:
    """array of container detail of a parsed pod status, init containers first."""
    return F.concat(*[F.coalesce(F.transform(status[name], _container(init)), F.array()) for name, init in _STATUS_LISTS])


def summary_of(status: Column) -> dict[str, Column]:
    """phase, issues, ready, total and restarts of a parsed pod status, each from the members it needs."""
    none = F.array().cast("array<string>")
    phase = blank(status["phase"])
    from_phase = F.when(phase.isin("Failed", "Unknown"), F.array(phase)).otherwise(none)
    issues = F.concat(from_phase, *[F.coalesce(F.transform(status[name], _issue(init)), none) for name, init in _STATUS_LISTS])
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    total = lambda f: f(status["initContainerStatuses"]) + f(status["containerStatuses"])
    ready = lambda cs: F.greatest(size(F.filter(cs["ready"], lambda r: r)), F.lit(0))
    restarts = lambda cs: F.coalesce(F.aggregate(cs["restartCount"], F.lit(0), lambda x, n: x + F.coalesce(n, F.lit(0))), F.lit(0))
    return {"phase": phase, "issues": F.array_distinct(F.array_remove(issues, "")), "ready": total(ready),
            "total": total(lambda cs: F.greatest(size(cs), F.lit(0))), "restarts": total(restarts)}


def health_of(status: Column) -> Column:
    """struct<phase, issues, ready, total, restarts, containers> of a parsed pod status."""
    return record(**summary_of(status), containers=containers_of(status))


def classify(obj) -> Column:
    """Health of a pod's JSON text."""
    obj = F.col(obj) if isinstance(obj, str) else obj
    return let(F.from_json(obj, POD_STATUS_DDL), lambda p: health_of(p["status"]))


def parse_pods(objects: DataFrame, ddl: str = POD_HEALTH_DDL, containers: bool = False) -> DataFrame:
    """Pod objects with the parsed payload ``pod`` (as far as ``ddl`` says) and, where that reads a status, the evaluated ``health``:
    its summary, and the detail of its ``containers`` too if asked for."""
    pods = objects.filter(F.col("resource") == "pods") if "resource" in objects.columns else objects
    # behind one-row generators: later filters and projections cannot pull the parse in and repeat it
    parsed = stored(pods.withColumn("pod", F.from_json("obj", ddl)), "pod")
    if "status" not in parsed.schema["pod"].dataType.names:
        return parsed
    status = F.col("pod.status")
    health = health_of(status) if containers else record(**summary_of(status))
    return stored(parsed.withColumn("health", health), "health")


def pod_health(objects: DataFrame, containers: bool = True) -> DataFrame:
    """One row per pod: phase, issues, ready, total, restarts and, unless left out, container detail."""
    keep = [c for c in ("capture_id", "path", "namespace", "position", "name") if c in objects.columns]
    return parse_pods(objects, POD_STATUS_DDL, containers).select(*keep, "health.*")


def owner_of(meta: Column) -> Column:
    """First owner reference's name, else the object's own."""
    return first_non_empty(F.get(meta["ownerReferences"], F.lit(0))["name"], meta["name"])


# -------------------------------------------------------------------- rules
# A rule is a Column: the array of findings of one parsed object. ``split`` separates findings that must not
# be grouped under one owner. Rules are exploded together, so any number of them costs one pass and one shuffle.

def _found(rule: str | Column, title, kind, name, evidence, severity=None, category=None, suggestion=None, split="") -> Column:
    if isinstance(rule, str) and rule in OBJECT_RULES:
        severity, category, suggestion = OBJECT_RULES[rule]
    return record(rule_id=rule, severity=severity, category=category, title=title, kind=kind, name=name, evidence=evidence,
                  suggestion=suggestion, split=split)


def reason_rule(reason: Column, name: Column) -> Column:
    """Finding of a pod reason; null for benign ones."""
    def rule(rule_id, severity, title, suggestion) -> Column:
        return record(rule_id=rule_id, severity=severity, title=title, suggestion=suggestion)

    table = F.create_map(*[x for reasons, *r in REASON_RULES for one in reasons for x in (F.lit(one), rule(*r))])
    other = rule(F.concat(F.lit("pod."), reason_slug(reason)), "warning", reason, OTHER_REASON_SUGGESTION)
    found = let(F.coalesce(F.try_element_at(table, reason), other), lambda r: _found(
        r["rule_id"], r["title"], "Pod", name, reason, r["severity"], "workload", r["suggestion"]))
    return F.when(~reason.isin(BENIGN_REASONS), found)


def _pod_health(pod: Column, health: Column) -> Column:
    owner = owner_of(pod["metadata"])
    return F.filter(F.transform(health["issues"], lambda r: reason_rule(r, owner)), lambda f: f.isNotNull())


def _unschedulable(pod: Column) -> Column:
    owner = owner_of(pod["metadata"])
    refused = F.filter(pod["status"]["conditions"], lambda c: (c["type"] == "PodScheduled") & (c["status"] == "False"))

    def found(c: Column) -> Column:
        why = first_non_empty(c["message"], c["reason"])
        return _found("scheduling.unschedulable", "Pod cannot be scheduled", "Pod", owner, why, split=why)

    return F.when(pod["status"]["phase"] == "Pending", F.transform(refused, found))


def _missing_resources(pod: Column) -> Column:
    owner = owner_of(pod["metadata"])
    containers = pod["spec"]["containers"]

    def lacks(what: str) -> Column:
        none = F.exists(containers, lambda c: F.coalesce(F.size(c["resources"][what]), F.lit(0)) < 1)
        return F.when(none, _found(f"workload.no-{what}", f"Container without resource {what}", "Pod", owner,
                                   f"a container has no resources.{what}"))

    return F.array_compact(F.array(lacks("requests"), lacks("limits")))


def _unbound_pvc(o: Column) -> Column:
    phase = blank(o["status"]["phase"])
    text = F.concat(F.lit("phase="), phase, F.lit(", storageClass="), F.coalesce(o["spec"]["storageClassName"], F.lit("(default)")))
    return F.when(~phase.isin("Bound", ""), F.array(_found(
        "storage.pvc-unbound", "PersistentVolumeClaim not bound", "PersistentVolumeClaim", blank(o["metadata"]["name"]), text)))


_WORKLOAD_KINDS = {"deployments": "Deployment", "statefulsets": "StatefulSet", "replicasets": "ReplicaSet", "daemonsets": "DaemonSet"}
DIAGNOSED = ["pods", "persistentvolumeclaims", "nodes", *_WORKLOAD_KINDS]


def _replica_shortfall(o: Column, resource: Column, path: Column) -> Column:
    daemon = resource == "daemonsets"
    st = o["status"]
    want = F.when(daemon, zero(st["desiredNumberScheduled"])).otherwise(F.coalesce(o["spec"]["replicas"], F.lit(1)))
    have = F.when(daemon, zero(st["numberReady"])).otherwise(F.greatest(zero(st["readyReplicas"]), zero(st["availableReplicas"])))
    kind = F.create_map(*[F.lit(x) for kv in _WORKLOAD_KINDS.items() for x in kv])[resource]
    text = F.concat(have.cast("string"), F.lit("/"), want.cast("string"), F.when(daemon, " nodes ready").otherwise(" replicas ready"))
    return F.when((want > 0) & (have < want), F.array(_found(
        "workload.replicas-unavailable", F.concat(kind, F.lit(" not fully available")), kind, blank(o["metadata"]["name"]), text,
        "warning", "workload", F.when(daemon, DAEMON_SUGGESTION).otherwise(REPLICA_SUGGESTION), split=path)))


def _node_conditions(o: Column, path: Column) -> Column:
    name = blank(o["metadata"]["name"])

    def found(c: Column) -> Column:
        t, s = blank(c["type"]), blank(c["status"])
        down = _found("node.not-ready", "Node not Ready", "Node", name, F.concat(F.lit("Ready condition is "), s), split=path)
        tight = _found("node.pressure", F.concat(F.lit("Node under "), t), "Node", name, F.concat(t, F.lit(" is True")),
                       split=F.concat(path, t))
        pressure = t.isin("DiskPressure", "MemoryPressure", "PIDPressure") & (s == "True")
        return F.when((t == "Ready") & (s != "True"), down).when(pressure, tight)

    return F.filter(F.transform(o["status"]["conditions"], found), lambda f: f.isNotNull())


def _collect(objects: DataFrame, findings: Column) -> DataFrame:
    """Explode the findings and group them: the first in (path, position) order represents its group."""
    pos = F.col("position") if "position" in objects.columns else F.lit(0)
    rows = objects.select("capture_id", "path", "namespace", pos.alias("_pos"), F.posexplode(findings).alias("_i", "_f"))
    keys = ["rule_id", "name", "split"]
    rest = ["severity", "category", "title", "kind", "evidence", "suggestion"]
    rows = rows.select("capture_id", "path", "namespace", "_pos", "_i", *[f"_f.{c}" for c in keys + rest])
    # equal findings first, by numbers alone, which needs no sort: min_by of a struct would sort every finding. A null position is the first
    equal = rows.groupBy("capture_id", "namespace", *keys, "path", *rest, "_i", F.col("_pos").isNull().alias("_unplaced")).agg(
        F.min("_pos").alias("_pos"), F.count("*").alias("_n"))
    grouped = equal.groupBy("capture_id", "namespace", *keys).agg(
        F.min_by(F.struct("path", *rest), F.struct("path", "_pos", "_i")).alias("_f"), F.sum("_n").alias("count"))
    own = {"capture_id", "namespace", "count", *keys}
    return grouped.select(*[F.col(c) if c in own else F.col("_f")[c].alias(c) for c in FINDING])


def find_pod_health(pods: DataFrame) -> DataFrame:
    """Per (rule, path namespace, owner) one finding with the number of affected pods."""
    return _collect(pods, _pod_health(F.col("pod"), F.col("health")))


def find_unschedulable(pods: DataFrame) -> DataFrame:
    """Pending pods the scheduler refused, per owner and message."""
    return _collect(pods, _unschedulable(F.col("pod")))


def find_missing_resources(pods: DataFrame) -> DataFrame:
    """Owners with a container lacking requests (warning) or limits (info)."""
    return _collect(pods, _missing_resources(F.col("pod")))


def _of(objects: DataFrame, *resources: str) -> DataFrame:
    return objects.filter(F.col("resource").isin(list(resources)) & ~F.col("path").contains("?"))


def find_unbound_pvc(objects: DataFrame) -> DataFrame:
    return _collect(_of(objects, "persistentvolumeclaims"), let(F.from_json("obj", VOLUME_DDL), _unbound_pvc))


def find_replica_shortfall(objects: DataFrame) -> DataFrame:
    """Workloads with fewer ready replicas than wanted; a missing replica count means 1."""
    return _collect(_of(objects, *_WORKLOAD_KINDS), let(
        F.from_json("obj", WORKLOAD_DDL), lambda o: _replica_shortfall(o, F.col("resource"), F.col("path"))))


def find_node_conditions(objects: DataFrame) -> DataFrame:
    """Nodes not ready (critical) or under disk, memory or PID pressure (warning)."""
    return _collect(_of(objects, "nodes"), let(F.from_json("obj", NODE_DDL), lambda o: _node_conditions(o, F.col("path"))))


def find_version_skew(objects: DataFrame, captures: DataFrame) -> DataFrame:
    """Nodes whose kubelet is 3 or more minor versions away from the control plane."""
    plane = captures.select("capture_id", F.col("kubernetes_version").alias("_v"))
    rows = salted_join(_of(objects, "nodes"), plane, ["capture_id"], ["path", "name"])

    def found(o: Column) -> Column:
        kubelet = o["status"]["nodeInfo"]["kubeletVersion"]
        skew = F.abs(minor_version("_v") - minor_version(kubelet))
        text = F.concat(F.lit("control plane "), F.col("_v"), F.lit(", kubelet "), kubelet, F.lit(" ("), skew.cast("string"),
                        F.lit(" minor versions apart)"))
        return F.when(skew >= 3, F.array(_found("cluster.version-skew", "Node/control-plane version skew", "Node",
                                                blank(o["metadata"]["name"]), text, split=F.col("path"))))

    return _collect(rows, let(F.from_json("obj", NODE_DDL), found))


def find_deprecated_api(index: DataFrame) -> DataFrame:
    """One finding per deprecated group/version and resource in the path table; empty lists count."""
    notes = F.create_map(*[F.lit(x) for kv in DEPRECATED_APIS.items() for x in kv])
    gv = F.concat_ws("/", "group", "version")
    paths = index.filter(~F.col("path").contains("?")).select("capture_id", "path").distinct()
    rows = with_path_cols(paths).filter(F.col("group") != "").select(
        "capture_id", "path", gv.alias("_gv"), F.col("resource").alias("kind"), F.try_element_at(notes, gv).alias("_note"),
    ).filter("_note IS NOT NULL").groupBy("capture_id", "_gv", "kind", "_note").agg(F.min("path").alias("path"))
    severity, category, suggestion = OBJECT_RULES["cluster.deprecated-api"]
    lits = {"rule_id": "cluster.deprecated-api", "severity": severity, "category": category, "suggestion": suggestion,
            "title": "Deprecated API in use", "namespace": "", "name": ""}
    return rows.withColumns({k: F.lit(v) for k, v in lits.items()}).withColumns({
        "evidence": F.concat("_gv", F.lit(" "), "kind", F.lit(" — "), "_note"), "count": F.lit(1).cast("bigint")}).select(*FINDING)


def object_findings(objects: DataFrame) -> DataFrame:
    """All object rules in one pass and one shuffle; each row is parsed with the schema of its own kind."""
    res, path = F.col("resource"), F.col("path")

    def pod_rules(pod: Column) -> Column:
        return let(record(**summary_of(pod["status"])), lambda h: F.concat(*[
            F.coalesce(x, F.array()) for x in (_pod_health(pod, h), _unschedulable(pod), _missing_resources(pod))]))

    findings = (
        F.when(res == "pods", let(F.from_json("obj", POD_RULES_DDL), pod_rules))
        .when(res == "persistentvolumeclaims", let(F.from_json("obj", VOLUME_DDL), _unbound_pvc))
        .when(res == "nodes", let(F.from_json("obj", NODE_DDL), lambda o: _node_conditions(o, path)))
        .when(res.isin(list(_WORKLOAD_KINDS)), let(F.from_json("obj", WORKLOAD_DDL), lambda o: _replica_shortfall(o, res, path))))
    return _collect(_of(objects, *DIAGNOSED), findings)


# ------------------------------------------------------------------- report

def severity_rank(severity) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(severity) if isinstance(severity, str) else severity)


def diagnose(objects: DataFrame, index: DataFrame | None = None, captures: DataFrame | None = None,
             min_severity: str = "info", category: str | None = None) -> DataFrame:
    """All rules over one reconstructed state, in no order (see ``worst_first``). With captures the nodes are read twice."""
    parts = [object_findings(objects)]
    if captures is not None:
        parts.append(find_version_skew(objects, captures))
    if index is not None:
        parts.append(find_deprecated_api(index))
    found = reduce(DataFrame.unionByName, [p.select(*FINDING) for p in parts])
    if min_severity not in SEVERITIES:
        return found.limit(0)
    found = found.filter(F.col("severity").isin(SEVERITIES[SEVERITIES.index(min_severity):]))
    if category:
        found = found.filter(F.col("category") == category)
    return found


def worst_first(findings: DataFrame) -> DataFrame:
    """Findings in the order of a report."""
    return findings.orderBy(F.desc(severity_rank("severity")), "category", "rule_id", "namespace", "name")


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("capture_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in reversed(SEVERITIES)])


def fails_on(findings: DataFrame, severity: str) -> bool:
    """True if any finding is at least this severe."""
    worse = SEVERITIES[SEVERITIES.index(severity):]
    return not findings.filter(F.col("severity").isin(worse)).isEmpty()


def dominant_issue(issues) -> Column:
    """The most telling reason of a pod: first of the priority list it has, else its first."""
    issues = F.col(issues) if isinstance(issues, str) else issues
    order = F.array(*[F.lit(p) for p in ISSUE_PRIORITY])
    hit = F.get(F.filter(order, lambda p: F.array_contains(issues, p)), F.lit(0))
    return F.coalesce(hit, F.get(issues, F.lit(0)), F.lit("Unknown"))


def issues(health: DataFrame, n: int | None = None, scope: list[str] = ["capture_id"]) -> DataFrame:  # noqa: B006
    """Unhealthy pods grouped by (namespace, name stem, dominant reason), worst and largest first; ``n`` keeps the first ones."""
    rows = health.filter(F.size("issues") > 0).select(
        *scope, "namespace", "name", "restarts", pod_prefix("name").alias("prefix"), dominant_issue("issues").alias("reason"))
    g = rows.groupBy(*scope, "namespace", "prefix", "reason").agg(
        F.count("*").alias("count"), F.sum("restarts").alias("restarts"), F.min("name").alias("exemplar"))
    r, n_pods, n_restarts = F.col("reason"), F.col("count"), F.col("restarts").cast("string")
    told = F.concat(r, F.lit(" · "), n_restarts, F.lit(" restarts"))
    across = F.concat(told, F.lit(" across "), n_pods.cast("string"), F.lit(" pods"))
    subtitle = (
        F.when((r == "CrashLoopBackOff") & (n_pods > 1), across).when(r.isin("CrashLoopBackOff", "OOMKilled"), told)
        .when(r == "Failed", "Pod phase = Failed").otherwise(r))
    out = g.select(
        *scope, F.when(r.isin(BAD_ISSUES), "bad").otherwise("warn").alias("severity"),
        F.when(n_pods > 1, F.col("prefix")).otherwise(F.col("exemplar")).alias("title"),
        subtitle.alias("subtitle"), "namespace", "reason", "count", "restarts")
    ordered = out.orderBy(F.when(F.col("severity") == "bad", 0).otherwise(1), F.desc("count"), "namespace", "title", "reason")
    return ordered if n is None else ordered.limit(n)
