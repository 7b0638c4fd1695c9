import json

import pytest
from conftest import captures, lst, obj
from pyspark.sql import functions as F

from kubestrata import Capture
from kubestrata.operators import change, dash, graph, health, overlay, redact, search, select, shape, timetravel, views

PODS = "/api/v1/namespaces/ns/pods"


def state(records, at=None):
    rows = timetravel.reconstruct_at(records, at).orderBy("path", "position").collect()
    return [(r["name"], json.loads(r["obj"]).get("v")) for r in rows]


# ------------------------------------------------------------- reconstruction

def test_reconstruct_upserts_and_removes(spark, log):
    log.add(PODS, 0, lst(obj("a", "ns", v=1), obj("b", "ns", v=1), obj("c", "ns", v=1)))
    log.add(PODS, 1, obj("b", "ns", v=2), "MODIFIED").add(PODS, 2, obj("d", "ns", v=1), "ADDED").add(PODS, 3, obj("a", "ns", v=1), "DELETED")
    df = log.df(spark)
    assert state(df) == [("b", 2), ("c", 1), ("d", 1)]
    assert state(df, "2026-04-10T10:01:00Z") == [("a", 1), ("b", 2), ("c", 1)]
    assert state(df, "2026-04-10T09:59:00Z") == []


def test_readded_object_keeps_its_place(spark, log):
    log.add(PODS, 0, lst(obj("a", "ns", v=1), obj("b", "ns", v=1)))
    log.add(PODS, 1, obj("a", "ns"), "DELETED").add(PODS, 2, obj("c", "ns", v=1), "ADDED").add(PODS, 3, obj("a", "ns", v=9), "ADDED")
    assert state(log.df(spark)) == [("a", 9), ("b", 1), ("c", 1)]


def test_events_before_the_snapshot_do_not_count(spark, log):
    log.add(PODS, 0, obj("old", "ns", v=1), "ADDED").add(PODS, 1, lst(obj("a", "ns", v=1))).add(PODS, 1, obj("same", "ns"), "ADDED")
    assert state(log.df(spark)) == [("a", 1)]


def test_failed_snapshot_empties_the_base_but_bounds_events(spark, log):
    log.add(PODS, 0, lst(obj("a", "ns", v=1))).add(PODS, 1, obj("x", "ns", v=1), "ADDED").add(PODS, 2, {"kind": "Status"}, code=403)
    log.add(PODS, 3, obj("y", "ns", v=1), "ADDED")
    assert state(log.df(spark)) == [("y", 1)]


def test_watch_only_path_and_nameless_items(spark, log):
    log.add(PODS, 0, obj("a", "ns", v=1), "ADDED").add("/api/v1/nodes", 0, lst({"v": 5}, obj("n", v=1), obj("n", v=2)))
    log.add("/api/v1/services", 0, lst({"v": 5}, obj("s", v=1))).add("/api/v1/services", 1, obj("t", v=1), "ADDED")
    assert state(log.df(spark)) == [("a", 1), ("", 5), ("n", 1), ("n", 2), ("s", 1), ("t", 1)]


def test_aggregate_is_deterministic_and_capped(spark, log):
    for ns in ("c", "a", "b"):
        log.add(f"/api/v1/namespaces/{ns}/pods", 0, lst(obj(f"p-{ns}", ns, v=1), obj("shared", ns, v=ns), obj(f"u-{ns}", ns, meta={"uid": "same"})))
    rows = timetravel.aggregate_namespaces(timetravel.reconstruct_at(log.df(spark)), "", "v1", "pods")
    assert [r["name"] for r in rows.orderBy("path", "position").collect()] == ["p-a", "shared", "u-a", "p-b", "p-c"]
    assert [r["name"] for r in timetravel.aggregate_namespaces(timetravel.reconstruct_at(log.df(spark)), "", "v1", "pods", 2).collect()] == ["p-a", "shared"]


def test_list_fallback_chain(spark, log):
    log.add("/api/v1/namespaces/a/pods", 0, lst(obj("p", "a"))).add("/api/v1/namespaces/b/pods", 0, lst(obj("q", "b")))
    log.add("/api/v1/services", 0, lst(obj("s1", "a"), obj("s2", "b")))
    st = timetravel.reconstruct_at(log.df(spark))
    pick = lambda *a, **k: sorted((r["name"], r["source"]) for r in timetravel.list_objects(st, *a, **k).select("name", "source").collect())
    assert pick("", "v1", "pods", "a") == [("p", "exact")]
    assert pick("", "v1", "pods") == [("p", "merged namespaces"), ("q", "merged namespaces")]
    assert pick("", "v1", "services", "b") == [("s2", "narrowed cluster list")]
    assert pick("", "v1", "pods", "b", name="q") == [("q", "exact")]
    assert pick("", "v1", "secrets") == []


def test_versions_rank(spark):
    vs = ["v1alpha1", "v2", "v1", "v1beta2", "v1beta1", "v10", "foo"]
    df = spark.createDataFrame([("c", "g", v) for v in vs], "capture_id string, group string, version string")
    row = timetravel.api_groups(df).first()
    assert row["versions"] == ["v10", "v2", "v1", "v1beta2", "v1beta1", "v1alpha1", "foo"] and row["preferred"] == "v10"


def test_resource_info(spark, log):
    log.add("/api/v1/namespaces/a/pods", 0, lst()).add("/api/v1/gizmos", 0, lst())
    res = [{"name": "pods", "namespaced": True, "kind": "Pod", "singularName": "pod", "shortNames": []}, {"name": "pods/log", "kind": "Pod"},
           {"name": "gizmos", "namespaced": True, "kind": "GizMo", "shortNames": ["gz"], "verbs": ["list"]}, {"name": "ghosts", "kind": "Ghost"}]
    log.add("/api/v1", 0, {"kind": "APIResourceList", "groupVersion": "v1", "resources": res})
    cat = shape.api_catalog(log.df(spark))
    info = {r["resource"]: r for r in timetravel.resource_info(log.df(spark), cat).collect()}
    assert (info["pods"]["kind"], info["pods"]["short_names"], info["gizmos"]["namespaced"]) == ("Pod", ["po"], True)
    assert info["gizmos"]["kind"] == "GizMo" and info["gizmos"]["short_names"] == ["gz"] and info["ghosts"]["captured"] is False


# ---------------------------------------------------------------- transitions

def seen(df):
    short = lambda t: None if t is None else json.loads(t).get("v")
    return [(r["event_type"], r["name"], short(r["before"]), short(r["after"])) for r in df.orderBy("captured_at", "seq", "pos").collect()]


def test_transition_report_mixes_events_and_polls(spark, log):
    log.add(PODS, 0, lst(obj("a", "ns", v=0)))
    for i, (e, v) in enumerate([("MODIFIED", 1), ("MODIFIED", 2), ("DELETED", 2), ("ADDED", 3), ("MODIFIED", 4)]):
        log.add(PODS, i + 1, obj("a", "ns", v=v), e)
    cm = "/api/v1/namespaces/ns/configmaps"
    log.add(cm, 0, lst(obj("x", v=1), obj("y", v=1))).add(cm, 10, lst(obj("y", v=2), obj("z", v=1))).add(cm, 11, {"kind": "Status"}, code=403)
    log.add(cm, 12, lst(obj("w", v=1))).add(cm, 13, lst(obj("w", v=1.0)))
    df = log.df(spark)
    ev = timetravel.event_objects(df)
    rep = lambda **k: seen(change.transition_report(df, ev, **k))
    watch = [("MODIFIED", "a", None, 1), ("MODIFIED", "a", 1, 2), ("DELETED", "a", 2, None), ("ADDED", "a", None, 3), ("MODIFIED", "a", 3, 4)]
    poll = [("MODIFIED", "y", 1, 2), ("ADDED", "z", None, 1), ("DELETED", "x", 1, None)]
    full = rep()
    assert full[:5] == watch and sorted(full[5:]) == sorted(poll)
    assert rep(resource="pod") == watch and rep(namespace="other") == []
    assert rep(name="z") == [("ADDED", "z", None, 1)]
    assert rep(resource="pods", since="2026-04-10T10:02:00Z", until="2026-04-10T10:03:00Z") == watch[1:3]


def test_timeline_prefers_the_exact_path(spark, log):
    log.add("/api/v1/namespaces/a/pods", 1, obj("p", "a"), "ADDED").add("/api/v1/namespaces/b/pods", 0, obj("q", "b"), "ADDED")
    log.add("/api/v1/services", 0, obj("s", "a"), "ADDED").add("/api/v1/namespaces/a/services", 1, obj("s", "a"), "ADDED")
    t = change.timeline(timetravel.event_objects(log.df(spark)), cluster=True)
    assert sorted((r["target"], r["name"], r["rv"]) for r in t.collect()) == [("/api/v1/pods", "p", 3), ("/api/v1/pods", "q", 2), ("/api/v1/services", "s", 2)]
    assert sorted((r["target"], r["event_type"], r["rv"]) for r in change.read_since(t, 3).collect()) == [("/api/v1/services", "EXPIRED", 2)]
    assert {r["event_type"] for r in change.read_since(t, 99).collect()} == {"EXPIRED"}


def test_two_captures_do_not_mix(spark, log):
    """Versions, times, newest events, deleted namespaces and diffs are each capture's own."""
    for c in ("c1", "c2"):
        log.add(PODS, 0, obj("a", "ns"), "ADDED", capture=c).add(PODS, 2 if c == "c1" else 9, obj("a", "ns"), "MODIFIED", capture=c)
    df = log.df(spark)
    ev = timetravel.event_objects(df)
    st = timetravel.reconstruct_at(df, "2026-04-10T10:01:00Z")
    got = sorted((r["capture_id"], r["event_type"], r["rv"]) for r in change.list_then_tail(st, ev, "2026-04-10T10:01:00Z", PODS).collect())
    assert got == [("c1", "ADDED", 2), ("c1", "MODIFIED", 3), ("c2", "ADDED", 2), ("c2", "MODIFIED", 3)]
    assert sorted((r["capture_id"], r["captured_at"].minute) for r in timetravel.time_axis(ev, 2).collect()) == [("c1", 0), ("c1", 2), ("c2", 0), ("c2", 9)]
    assert sorted((r["capture_id"], r["seq"]) for r in change.recent(ev, n=1).collect()) == [("c1", 1), ("c2", 1)]
    assert change.recent(ev).count() == 4
    entries = spark.createDataFrame([("c1", "", "v1", "namespaces", "", "ns", 5, 1, True, "{}")],
                                    "capture_id string, group string, version string, resource string, obj_namespace string, name string, rv long, created_rv long, deleted boolean, obj string")
    assert [r["capture_id"] for r in overlay.drop_deleted_namespaces(st, entries).collect()] == ["c2"]
    with pytest.raises(Exception, match="one capture"):
        change.diff_captures(df.withColumn("event_type", F.lit(None).cast("string")), df).collect()


def test_compaction_of_a_busy_object(spark, monkeypatch):
    """90 % of a log is one object; births follow the last delete wherever it lies."""
    import random

    monkeypatch.setattr(overlay, "RUN", 7)
    rng = random.Random(5)
    rows, want = [], {}
    for rv in range(1, 301):
        name = "busy" if rng.random() < 0.9 else f"o{rv % 5}"
        gone = rng.random() < 0.05
        rows.append(("c", "", "v1", "things", "ns", name, rv, gone, str(rv)))
        born = want.get(name, (0, 0, True))[1] if not want.get(name, (0, 0, True))[2] else 0
        want[name] = (rv, 0 if gone else born or rv, gone)
    log = spark.createDataFrame(rows, "capture_id string, group string, version string, resource string, obj_namespace string, name string, rv long, deleted boolean, obj string")
    assert {r["name"]: (r["rv"], r["created_rv"], r["deleted"]) for r in overlay.compact(log).collect()} == want


def test_busy_path_keeps_its_objects(spark, log):
    """90 % of all rows on one path."""
    log.add(PODS, 0, lst(*[obj(f"p{i}", "ns", v=0) for i in range(40)]))
    for i in range(120):
        log.add(PODS, 1 + i, obj(f"p{i % 45}", "ns", v=i), "DELETED" if i % 9 == 0 else "MODIFIED")
    log.add("/api/v1/nodes", 0, lst(obj("n", v=1)))
    alive = {f"p{i}": 0 for i in range(40)}
    for i in range(120):
        alive.pop(f"p{i % 45}", None)
        if i % 9:
            alive[f"p{i % 45}"] = i
    assert dict(state(log.df(spark))) == alive | {"n": 1}


def test_diffs(spark, log):
    log.add(PODS, 0, '{"items":[],"v":1}').add(PODS, 5, '{"v":2,"items":[]}').add("/api/v1/nodes", 0, '{"b":1,"a":2}').add("/api/v1/nodes", 5, '{"a":2.0,"b":1}')
    log.add("/api/v1/gone", 0, "{}").add("/api/v1/gone", 5, "{}", code=404).add("/api/v1/nodes?as=Table", 0, "1").add("/api/v1/nodes?as=Table", 5, "2")
    d = change.diff_times(log.df(spark), "2026-04-10T10:00:00Z", "2026-04-10T10:06:00Z")
    assert sorted(r["path"] for r in d.collect()) == ["/api/v1/gone", PODS]
    text = {r["path"]: r["diff"] for r in change.diff_text(d).collect()}
    assert '-  "v": 1' in text[PODS] and '+  "v": 2' in text[PODS] and "+null" in text["/api/v1/gone"]
    assert [r["path"] for r in change.diff_times(log.df(spark), "2026-04-10T10:00:00Z", "2026-04-10T10:06:00Z", resource="pods").collect()] == [PODS]


def test_object_diff(spark, log):
    log.add(PODS, 0, lst(obj("a", "ns", v=1), obj("b", "ns"))).add(PODS, 5, lst(obj("a", "ns", v=2), obj("b", "ns")))
    st = lambda t: timetravel.reconstruct_at(log.df(spark), t)
    rows = change.object_diff(st("2026-04-10T10:00:00Z"), st("2026-04-10T10:05:00Z")).collect()
    assert {r["object_key"] for r in rows} == {"ns/a"}
    assert [r["text"] for r in rows if r["type"] in ("add", "del")] == ["-v: 1", "+v: 2"]


# ----------------------------------------------------------------- diagnosis

def cs(name="app", ready=False, restarts=0, **st):
    return {"name": name, "ready": ready, "restartCount": restarts, "state": st}


def owned(by):
    return {"ownerReferences": [{"kind": "ReplicaSet", "name": by}]}


def test_diagnose_counts_pods_of_one_owner_together(spark, log):
    """Four looping pods of one owner and one of another are two findings; done and starting containers are none."""
    loop = lambda n: {"phase": "Running", "containerStatuses": [cs("main", False, n, waiting={"reason": "CrashLoopBackOff"})]}
    log.add("/api/v1/namespaces/shop/pods", 0, lst(
        *[obj(f"cart-{i}", meta=owned("cart"), status=loop(i)) for i in range(4)], obj("till-0", meta=owned("till"), status=loop(9)),
        obj("batch", status={"phase": "Succeeded", "containerStatuses": [cs("main", False, 0, terminated={"reason": "Completed", "exitCode": 0})]}),
        obj("fresh", status={"phase": "Pending", "containerStatuses": [cs("main", False, 0, waiting={"reason": "ContainerCreating"})]})))
    found = Capture(log.df(spark), captures(spark)).diagnose().collect()
    assert sorted((f["rule_id"], f["name"], f["count"]) for f in found) == [("pod.crashloopbackoff", "cart", 4), ("pod.crashloopbackoff", "till", 1)]


def test_diagnose_orders_and_filters(spark, log):
    """One finding of each of three severities, worst first; kinds of different categories."""
    log.add("/api/v1/namespaces/lab/pods", 0, lst(obj("probe", spec={"containers": [{"name": "x", "resources": {"requests": {"cpu": "1"}}}]}, status={"phase": "Unknown"})))
    log.add("/api/v1/nodes", 0, lst(obj("rack7", status={"conditions": [{"type": "Ready", "status": "Unknown"}], "nodeInfo": {"kubeletVersion": "v1.29.4"}})))
    log.add("/api/v1/namespaces/lab/persistentvolumeclaims", 0, lst(obj("scratch", status={"phase": "Lost"})))
    log.add("/apis/apps/v1/namespaces/lab/daemonsets", 0, lst(obj("agent", status={"desiredNumberScheduled": 5, "numberReady": 4}), kind="DaemonSetList"))
    log.add("/apis/policy/v1beta1/namespaces/lab/poddisruptionbudgets", 0, lst())
    cap = Capture(log.df(spark), captures(spark))
    found = cap.diagnose().collect()
    want = {"node.not-ready": "critical", "cluster.deprecated-api": "warning", "pod.unknown": "warning", "storage.pvc-unbound": "warning",
            "workload.replicas-unavailable": "warning", "workload.no-limits": "info"}
    assert {f["rule_id"]: f["severity"] for f in found} == want and len(found) == len(want)
    assert (found[0]["rule_id"], found[-1]["rule_id"]) == ("node.not-ready", "workload.no-limits")
    assert [f["name"] for f in cap.diagnose(category="storage").collect()] == ["scratch"]
    assert [f["name"] for f in cap.diagnose(min_severity="critical").collect()] == ["rack7"] and health.fails_on(cap.diagnose(), "critical")
    s = health.summary(cap.diagnose()).first()
    assert (s["critical"], s["warning"], s["info"]) == (1, 4, 1)


def test_no_finding_is_dropped(spark):
    rows = [("c", f"ns{i}", f"p-{i}", ["Failed"], 0) for i in range(30)]
    h = spark.createDataFrame(rows, "capture_id string, namespace string, name string, issues array<string>, restarts int")
    assert health.issues(h).count() == 30 and health.issues(h, n=3).count() == 3


def test_pod_health_details(spark):
    body = obj("p", status={"phase": "Failed", "initContainerStatuses": [cs("i", terminated={"reason": "Completed", "exitCode": 0})],
                            "containerStatuses": [cs("a", True, 2, running={}) | {"lastState": {"terminated": {"reason": "OOMKilled", "exitCode": 137}}},
                                                  cs("b", False, 1, waiting={"reason": "ErrImagePull"}), cs("c", False, 0, waiting={"reason": "ErrImagePull"})]})
    h = spark.createDataFrame([(json.dumps(body),), ("junk",)], "obj string").select(health.classify("obj").alias("h")).collect()
    a = h[0]["h"]
    assert (a["phase"], a["issues"], a["ready"], a["total"], a["restarts"]) == ("Failed", ["Failed", "ErrImagePull"], 1, 4, 3)
    assert (a["containers"][1]["last_terminated"], a["containers"][1]["last_exit_code"]) == ("OOMKilled", 137)


# ----------------------------------------------------------- search, redaction

def test_query_and_search(spark, log):
    log.add(PODS, 0, lst(obj("a", "ns", spec={"image": "nginx:1", "env": [{"value": "s3cret é"}]}), obj("b", "ns", spec={"image": "redis"})))
    log.add("/api/v1/configmaps", 0, lst(obj("c", "other", data={"my.key": "nginx here"}))).add(PODS + "?as=Table", 0, {"rows": []})
    log.add("/api/v1/namespaces/ns/pods/a/log?container=main", 0, json.dumps("start\nnginx up\nerror nginx nginx"))
    cap = Capture(log.df(spark))
    assert sorted((r["name"], r["value"]) for r in cap.query("{.spec.image}").collect()) == [("a", '"nginx:1"'), ("b", '"redis"')]
    assert [r["name"] for r in cap.query("{.metadata.name}", resource="configmaps").collect()] == ["c"]
    escaped = spark.createDataFrame([("c", PODS, "", "v1", "pods", "ns", "e", True, "ns", '{"b":"\\u0064e"}')],
                                    "capture_id string, path string, group string, version string, resource string, namespace string, name string, decodable boolean, obj_namespace string, obj string")
    assert [r["field"] for r in search.search_text(escaped, "de").collect()] == ["b"]  # the raw text does not hold it
    hits = sorted((r["name"], r["field"]) for r in cap.search_text("nginx").collect())
    assert hits == [("a", "spec.image"), ("c", 'data["my.key"]')]
    assert [r["field"] for r in cap.search_text("s3.*é", regex=True, namespace="ns").collect()] == ["spec.env[0].value"]
    logs = cap.search_logs("nginx").orderBy("line_no").collect()
    assert [(r["container"], r["line_no"], r["snippet"]) for r in logs] == [("main", 1, "nginx up"), ("main", 2, "error nginx nginx")]
    assert cap.search_logs("nginx", resource="nodes").count() == 0
    single = Capture(log.add("/api/v1/namespaces/ns/pods/solo", 0, obj("solo", "ns", spec={"image": "solo:1"})).df(spark))
    assert [r["value"] for r in single.query("{.spec.image}", resource="pods").filter("name = 'solo'").collect()] == ['"solo:1"']
    with pytest.raises(ValueError):
        cap.search_text("")


def secret(name, ns="ns", **more):
    return {"kind": "Secret"} | obj(name, ns, data={"a": "YQ==", "b": "Yg=="}, **more)


def test_secret_masking(spark, log):
    log.add("/s", 0, secret("one", stringData={"x": "y"})).add("/s", 1, {"kind": "SecretList", "items": [secret("one"), secret("keep"), obj("empty")]}, "ADDED")
    log.add("/s", 2, {"kind": "ConfigMap", "data": {"a": "YQ=="}}).add("/s", 3, {"kind": "Secret", "metadata": {"name": "n"}, "data": {}}).add("/s", 4, "junk")
    rows = redact.redact_secrets(log.df(spark), ["ns/keep"]).orderBy("seq").collect()
    assert [r["secrets_masked"] for r in rows] == [True, True, False, False, False]
    one = json.loads(rows[0]["body"])
    assert one["data"] == {"a": redact.MASK_B64, "b": redact.MASK_B64} and one["stringData"] == {"x": "REDACTED"} and one["metadata"]["name"] == "one"
    items = json.loads(rows[1]["body"])["items"]
    assert items[0]["data"]["a"] == redact.MASK_B64 and items[1]["data"]["a"] == "YQ==" and items[2] == obj("empty")
    assert rows[4]["body"] == "junk"


def test_field_rules(spark, log):
    pod = {"kind": "Pod"} | obj("p", "ns", meta={"labels": {"app": "web"}}, spec={"nodeName": "n", "containers": [{"name": "a", "image": "x"}, {"name": "b", "image": "y"}]},
                               status={"containerStatuses": [{"restartCount": 4}]})
    log.add("/p", 0, pod).add("/p", 1, {"kind": "PodList", "items": [pod, obj("q", "other", spec={"nodeName": "z"}), obj("r", spec={"nodeName": "z"})]})
    log.add("/p", 2, {"kind": "ConfigMap"} | obj("c", data={"k": "v"}))

    def masked(*rules):
        return [(r["fields_masked"], json.loads(r["body"])) for r in redact.redact_fields(log.df(spark), list(rules)).orderBy("seq").collect()]

    got = masked(redact.Rule("spec.containers[*].image", "X", kind="Pod"), redact.Rule("status.containerStatuses[0].restartCount", "7", kind="Pod"))
    assert [m for m, _ in got] == [True, True, False]
    assert [c["image"] for c in got[0][1]["spec"]["containers"]] == ["X", "X"] and got[0][1]["status"]["containerStatuses"][0]["restartCount"] == 7
    # a list item must match the namespace, a direct object without one passes
    got = masked(redact.Rule("spec.nodeName", "N", namespace="ns"))
    assert [i["spec"]["nodeName"] for i in got[1][1]["items"]] == ["N", "z", "z"]
    got = masked(redact.Rule("data.k", "N", namespace="ns"))
    assert got[2][1]["data"] == {"k": "N"}
    got = masked(redact.Rule("**.name", "N", label_selector="app=web"))
    assert got[0][1]["metadata"]["name"] == "N" and [c["name"] for c in got[0][1]["spec"]["containers"]] == ["N", "N"] and got[1][1]["items"][1]["metadata"]["name"] == "q"
    assert masked(redact.Rule("spec.absent", "N"))[0][0] is False
    with pytest.raises(ValueError):
        masked(redact.Rule("spec.nodeName", "x", value_type="integer"))
    for kind, want in (("bool", True), ("null", None), ("array", []), ("object", {}), ("number", 1)):
        assert redact.convert("1", kind) == want


# ---------------------------------------------------------------------- overlay

def merge_patch(target, patch):
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def test_patch_folding_equals_one_by_one(spark):
    import random

    rng = random.Random(3)
    val = lambda d: rng.choice([None, 1, "s", [1], {}]) if d == 0 else {k: val(d - 1) for k in rng.sample("abc", rng.randint(0, 3))} if rng.random() < 0.7 else val(0)
    patches, want = [], {}
    for name in "xyz":
        doc = {"spec": {"a": 1}, "n": name}
        for i in range(40):
            p = {k: val(2) for k in rng.sample("abcd", 2)}
            patches.append((name, i + 1, json.dumps(p)))
            doc = merge_patch(doc, p)
        want[name] = doc
    base = spark.createDataFrame([(n, json.dumps({"spec": {"a": 1}, "n": n})) for n in "wxyz"], "name string, obj string")
    got = overlay.fold_patches(base, spark.createDataFrame(patches, "name string, rv long, patch string"), ["name"], fan_in=4)
    docs = {r["name"]: json.loads(r["obj"]) for r in got.collect()}
    assert docs == want | {"w": {"spec": {"a": 1}, "n": "w"}}


def test_status_patch_keeps_spec(spark):
    base = spark.createDataFrame([("x", '{"spec":{"a":1}}')], "name string, obj string")
    p = spark.createDataFrame([("x", 1, '{"spec":{"a":2},"status":{"ok":true}}', "status")], "name string, rv long, patch string, subresource string")
    assert json.loads(overlay.fold_patches(base, p, ["name"]).first()["obj"]) == {"spec": {"a": 1}, "status": {"ok": True}}


def test_cascade(spark):
    rows = [("c", "", "v1", "namespaces", "", "dead", 5, 1, True, "{}"), ("c", "", "v1", "pods", "dead", "p", 2, 2, False, "{}"), ("c", "", "v1", "pods", "live", "q", 3, 3, False, "{}")]
    e = spark.createDataFrame(rows, "capture_id string, group string, version string, resource string, obj_namespace string, name string, rv long, created_rv long, deleted boolean, obj string")
    t = overlay.cascade_tombstones(e, 6).collect()
    assert [(r["name"], r["rv"], r["deleted"]) for r in t] == [("p", 6, True)]
    assert sorted(r["name"] for r in overlay.drop_deleted_namespaces(e, e).collect()) == ["dead", "q"]


# ---------------------------------------------------------------------- shaping

def test_demux_and_emptied(spark, log):
    path = "/api/v1/pods"
    log.add(path, 0, lst(obj("a", "x"), obj("b", "y"), obj("c", "x"), obj("none"))).add(path, 1, lst(obj("a", "x"))).add(path, 2, lst())
    df = log.df(spark)
    out = shape.demux_lists(df)
    got = {(r["path"], r["seq"]): json.loads(r["body"]) for r in out.collect()}
    assert set(got) == {("/api/v1/namespaces/x/pods", 0), ("/api/v1/namespaces/y/pods", 0), ("/api/v1/namespaces/x/pods", 1)}
    first = got["/api/v1/namespaces/x/pods", 0]
    assert [i["metadata"]["name"] for i in first["items"]] == ["a", "c"] and first["kind"] == "PodList" and first["metadata"] == {"resourceVersion": "1"}
    full = shape.with_emptied(out, df)
    empty = sorted((r["path"], r["seq"]) for r in full.collect() if json.loads(r["body"])["items"] == [])
    assert empty == [("/api/v1/namespaces/x/pods", 2), ("/api/v1/namespaces/y/pods", 1), ("/api/v1/namespaces/y/pods", 2)]


def test_demux_tables_and_schema_rows(spark, log):
    row = lambda n, ns: {"cells": [n], "object": {"metadata": {"name": n, "namespace": ns}}}
    table = {"kind": "Table", "apiVersion": "meta.k8s.io/v1", "columnDefinitions": [{"name": "Name", "type": "string"}], "rows": [row("a", "x"), row("b", "y")]}
    log.add("/api/v1/pods?as=Table", 0, table)
    out = {r["path"]: json.loads(r["body"]) for r in shape.demux_tables(log.df(spark)).collect()}
    assert set(out) == {"/api/v1/namespaces/x/pods?as=Table", "/api/v1/namespaces/y/pods?as=Table"}
    assert out["/api/v1/namespaces/x/pods?as=Table"]["columnDefinitions"][0]["name"] == "Name"
    from kubestrata.sources.records import table_schema_rows

    stripped = json.loads(table_schema_rows(log.add("/api/v1/pods", 1, lst()).df(spark)).first()["body"])
    assert stripped["rows"] == [] and stripped["metadata"] == {"resourceVersion": "0"}
    rows = select.table_rows(log.df(spark).filter("path LIKE '%Table'"))
    assert [r["name"] for r in select.get_table_row(rows, "b").collect()] == ["b"]
    assert [c["name"] for c in views.captured_columns(log.df(spark), "/api/v1/pods", "/api/v1/pods")] == ["Name"]


def test_targets(spark):
    cat = spark.createDataFrame([("c", "apps", "v1", "deployments", True), ("c", "metrics.k8s.io", "v1", "x", True), ("c", "x.io", "v1", "globals", False), ("c", "apps", "v1", "done", True)],
                                "capture_id string, group string, version string, resource string, namespaced boolean")
    conf = spark.createDataFrame([("apps", "v1", "done")], "group string, version string, resource string")
    dirs = spark.createDataFrame([(1, "cluster", "10s", []), (2, "", "", ["a", "*"])], "position int, scope string, interval string, namespaces array<string>")
    out = {r["resource"]: (r["interval"], r["namespaces"]) for r in shape.expand_targets(cat, conf, dirs).collect()}
    assert out == {"deployments": ("30s", ["a", "*"]), "globals": ("10s", None)}
    ns = spark.createDataFrame([("c", "b"), ("c", "a")], "capture_id string, name string")
    t = shape.expand_targets(cat, conf, dirs)
    rows = shape.expand_namespaces(t, ns).orderBy("resource", "ord", "namespace").collect()
    assert [(r["resource"], r["namespace"]) for r in rows] == [("deployments", "a"), ("deployments", "b"), ("globals", None)]


def test_native_listable(spark):
    cat = spark.createDataFrame([("c", "", "v1", "pods", ["list"]), ("c", "", "v1", "nodes", ["list"]), ("c", "", "v1", "bindings", ["create"]), ("c", "x.io", "v1", "y", ["list"])],
                                "capture_id string, group string, version string, resource string, verbs array<string>")
    caught = spark.createDataFrame([("", "v1", "nodes", []), ("", "v1", "pods", ["a", "*"])], "group string, version string, resource string, namespaces array<string>")
    assert [(r["resource"], r["in_namespaces"]) for r in shape.native_listable(cat, caught).collect()] == [("pods", ["a"])]


def test_http_reason(spark):
    from kubestrata.functions.scalars import http_reason

    df = spark.createDataFrame([(403, '{"kind":"Status","message":"' + "m" * 310 + '"}'), (500, "  boom "), (404, "")], "c int, b string")
    got = [r[0] for r in df.select(http_reason("c", "b")).collect()]
    assert got == ["HTTP 403: " + "m" * 300 + "...", "HTTP 500: boom", "HTTP 404"]


# ------------------------------------------------------------ rest of the handle

def test_logs(spark, log):
    p = "/api/v1/namespaces/n/pods/p/log?container="
    log.add(p + "istio-proxy", 0, json.dumps("side")).add(p + "web", 0, json.dumps("a\nb\n")).add(p + "web&previous=true", 0, json.dumps("old"))
    r = dash.pod_log(log.df(spark), "n", "p").first()
    assert (r["container"], r["text"], r["line_count"]) == ("web", "a\nb\n", 2)
    assert [(c["container"], c["has_current"], c["has_previous"]) for c in r["containers"]] == [("istio-proxy", True, False), ("web", True, True)]
    assert dash.pod_log(log.df(spark), "n", "p", previous=True).first()["text"] == "old"
    tails = {(r["container"], r["previous"]): r["tail"] for r in dash.log_tail(log.df(spark), 1).collect()}
    assert tails == {("istio-proxy", False): ["side"], ("web", False): ["b"], ("web", True): ["old"]}


def test_views_and_relationships(spark, log):
    log.add(PODS, 0, lst(obj("p", "ns", meta={"ownerReferences": [{"kind": "ReplicaSet", "name": "rs"}]},
                             spec={"containers": [{"name": "c", "envFrom": [{"configMapRef": {"name": "cm"}}]}], "volumes": [{"projected": {"sources": [{"secret": {"name": "s"}}]}}]})))
    log.add("/apis/apps/v1/namespaces/ns/replicasets", 0, lst(obj("rs", "ns", meta={"ownerReferences": [{"kind": "Deployment", "name": "d"}]}), kind="ReplicaSetList"))
    log.add("/apis/apps/v1/namespaces/ns/deployments", 0, lst(obj("d", "ns"), kind="DeploymentList"))
    log.add("/apis/x.io/v1/namespaces/ns/things", 0, lst(obj("t", "ns", spec={"size": 3}), kind="ThingList"))
    log.add("/apis/apiextensions.k8s.io/v1/customresourcedefinitions", 0, lst(obj("things.x.io", spec={
        "group": "x.io", "scope": "Namespaced", "names": {"plural": "things", "kind": "Thing"},
        "versions": [{"name": "v1", "served": True, "additionalPrinterColumns": [{"name": "Size", "type": "integer", "jsonPath": ".spec.size"}]}]})))
    cap = Capture(log.df(spark))
    rel = lambda path, name: [(r["title"], r["name"]) for r in cap.relationships(path, name).collect()]
    assert rel(PODS, "p") == [("Mounts ConfigMaps", "cm"), ("Mounts Secrets", "s"), ("Owned by", "rs")]
    assert rel("/apis/apps/v1/namespaces/ns/deployments", "d") == [("ReplicaSets", "rs")]
    assert rel("/apis/apps/v1/namespaces/ns/replicasets", "rs") == [("Owned by", "d"), ("Pods", "p")]
    v = cap.view("x.io", "v1", "things", "ns")
    assert v.columns[2:] == ["Name", "Size", "Age"] and v.first()["Size"] == "3"
    assert cap.view("", "v1", "pods", "ns").columns[2:] == ["Name", "Ready", "Status", "Restarts", "Age"]
    detail = dash.object_detail(cap.state(), PODS, "p").first()
    assert '"kind": "Pod"' in detail["json"] and "kind: Pod" in detail["yaml"]
    edges = graph.mount_edges(cap.state().filter("resource = 'pods'"))
    assert sorted((r["kind"], r["target"]) for r in edges.collect()) == [("configmap", "cm"), ("secret", "s")]


def test_metadata_projection_refuses_incomplete_lists(spark, log):
    log.add(PODS, 0, lst(obj("a", "ns"), {"spec": 1})).add("/api/v1/nodes", 0, lst(obj("n")))
    got = select.project_metadata(timetravel.reconstruct_at(log.df(spark))).collect()
    assert [(r["name"], json.loads(r["obj"])["kind"]) for r in got] == [("n", "PartialObjectMetadata")]


def test_overlay_on_the_handle(spark, log):
    log.add(PODS, 0, lst(obj("a", "ns", v=1), obj("b", "ns", v=1)))
    ch = spark.createDataFrame([("c", "", "v1", "pods", "ns", "a", 2, False, json.dumps(obj("a", "ns", v=5))), ("c", "", "v1", "pods", "ns", "b", 3, True, "{}"),
                                ("c", "", "v1", "pods", "ns", "c", 4, False, json.dumps(obj("c", "ns", v=7)))],
                               "capture_id string, group string, version string, resource string, obj_namespace string, name string, rv long, deleted boolean, obj string")
    rows = Capture(log.df(spark), changes=ch).state().collect()
    assert sorted((r["name"], json.loads(r["obj"])["v"], r["path"]) for r in rows) == [("a", 5, PODS), ("c", 7, PODS)]


def test_inspect_prefers_discovery(spark, log):
    log.add("/apis/x.io/v1/things", 0, lst(obj("t"))).add("/apis/x.io/v1", 0, {"kind": "APIResourceList", "resources": [{"name": "things", "namespaced": True}]})
    r = Capture(log.df(spark)).inspect().first()
    assert (r["resource"], r["namespaced"], r["items"], r["records"], r["namespaces"]) == ("things", True, 1, 1, [])


def test_events_for(spark, log):
    ev = lambda n, **k: obj(n, "ns", involvedObject={"kind": "Pod", "name": "p", "namespace": "ns"}, **k)
    log.add("/api/v1/namespaces/ns/events", 0, lst(ev("1", reason="BackOff", type="Warning", lastTimestamp="2026-04-10T10:00:00Z"), ev("2", type="Warning", eventTime="2026-04-10T10:01:00Z"),
                                                   ev("3", type="Normal", firstTimestamp="2026-04-10T09:00:00Z")))
    rows = search.events_for(timetravel.reconstruct_at(log.df(spark)), "ns", "Pod", "p", top=2).collect()
    assert [(r["severity"], r["time"].minute) for r in rows] == [("warn", 1), ("bad", 0)]


def test_stream_only_path_counts(spark, log):
    log.add(PODS, 0, lst(obj("a", "ns"), obj("b", "ns"))).add("/api/v1/nodes", 0, lst(obj("n"))).add(PODS + "?as=Table", 0, {"rows": [1]})
    idx = Capture(log.df(spark)).index
    assert [tuple(r) for r in timetravel.namespace_counts(idx).collect()] == [("c", "ns", "pods", 2)]
    assert [tuple(r) for r in timetravel.cluster_counts(idx).collect()] == [("c", "nodes", 1)]
    assert idx.filter(F.col("view_kind") == "table").count() == 1
