import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kubestrata.functions import jsonpath, paths, scalars, selectors
from kubestrata.functions.ordered import filled, ranked, shifted
from kubestrata.operators.search import first_match, leaves, snippet


def one(spark, value, fn, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(fn("v").alias("r")).first()[0]


def many(spark, values, fn):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", fn("v").alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


LOOSE = {
    "/api/v1/pods": ("", "v1", "pods", ""),
    "/api/v1/namespaces/ns/pods": ("", "v1", "pods", "ns"),
    "/api/v1/namespaces/ns/pods/web?x=1": ("", "v1", "pods", "ns"),
    "/api/v1/namespaces/ns": ("", "v1", "namespaces", ""),
    "/apis/apps/v1/deployments": ("apps", "v1", "deployments", ""),
    "/apis/apps/v1/namespaces/ns/deployments/d": ("apps", "v1", "deployments", "ns"),
    "/apis/apps/v1": ("", "", "", ""),
    "/api/v1": ("", "", "", ""),
    "/version": ("", "", "", ""),
}
STRICT = {
    "/api/v1/pods": ("", "v1", "pods", ""),
    "/api/v1/namespaces/ns/pods": ("", "v1", "pods", "ns"),
    "/api/v1/namespaces/ns/pods/web": ("", "v1", "", ""),
    "/apis/apps/v1/namespaces/ns/deployments": ("apps", "v1", "deployments", "ns"),
    "/apis/apps/v1/namespaces/ns/deployments/d": ("apps", "v1", "", ""),
}
OBJECT = {
    "/api/v1/namespaces/ns": ("", "v1", "namespaces", "", "ns", ""),
    "/api/v1/namespaces/ns/status": ("", "v1", "namespaces", "", "ns", "status"),
    "/api/v1/namespaces/ns/pods": ("", "v1", "pods", "ns", "", ""),
    "/api/v1/namespaces/ns/pods/p/log": ("", "v1", "pods", "ns", "p", "log"),
    "/apis/apps/v1/namespaces/ns/deployments/d/scale": ("apps", "v1", "deployments", "ns", "d", "scale"),
    "/api/v1/nodes/n": ("", "v1", "nodes", "", "n", ""),
    "/api/v1/namespaces": ("", "v1", "namespaces", "", "", ""),
}


@pytest.mark.parametrize("cases,fn", [(LOOSE, paths.api_path_cols), (STRICT, paths.list_path_cols), (OBJECT, paths.object_path_cols)])
def test_path_parsers(spark, cases, fn):
    assert [tuple(r) for r in many(spark, cases, fn)] == list(cases.values())


def test_log_paths_and_view_kinds(spark):
    p = "/api/v1/namespaces/n/pods/p/log"
    got = many(spark, [p + "?container=c&previous=true", p, "/api/v1/pods"], paths.log_path_cols)
    assert tuple(got[0]) == ("n", "p", "c", True) and tuple(got[1]) == ("n", "p", "", False) and got[2] is None
    kinds = {"/api/v1/pods": "list", "/api/v1/pods?as=Table": "table", "/api/v1/pods?as=TableSchema": "table_schema", p + "?container=c": "log",
             "/api/v1": "discovery", "/apis": "discovery", "/apis/apps/v1": "discovery", "/api/v1/namespaces?limit=500": "other"}
    assert many(spark, kinds, paths.view_kind) == list(kinds.values())


def test_kinds_and_prefixes(spark):
    kinds = {"pods": "Pod", "ingresses": "Ingress", "networkpolicies": "NetworkPolicy", "endpoints": "Endpoints", "apiservices": "APIService",
             "customresourcedefinitions": "CustomResourceDefinition", "widgets": "Widget", "s": "s", "virtualmachines": "Virtualmachine"}
    assert many(spark, kinds, paths.kind_of) == list(kinds.values())
    stems = {"web-7d9f8b6c5-x2x4z": "web-*", "db-0": "db-*", "single": "single-*", "a-b-c": "a-b-*", "job-28f7a": "job-*", "x-12345": "x-*"}
    assert many(spark, stems, scalars.pod_prefix) == list(stems.values())


def test_small_strings(spark):
    assert many(spark, ["v1.27+", "1.30.2", "v1", "x"], scalars.minor_version) == [27, 30, None, None]
    assert many(spark, ["Foo Bar!", "--a--", "ErrX9"], scalars.reason_slug) == ["foo-bar", "a", "errx9"]
    assert many(spark, ["", "a", "a\n", "a\nb"], scalars.line_count) == [0, 1, 1, 2]
    assert many(spark, ["istio-proxy", "app", "My-Sidecar"], scalars.is_sidecar) == [True, False, True]
    assert many(spark, ['{"items":[1,2]}', '{"rows":[1]}', "{}", "bad", '{"items":null,"rows":[1,2,3]}', '{"items":[]}'], scalars.item_count) == [2, 1, 0, 0, 3, 0]


def test_times(spark):
    got = many(spark, ["2026-04-10T10:00:00Z", "2026-04-10T12:00:00.123456789+02:00", "2026-04-10T09:30:00-00:30", "nope", ""], scalars.rfc3339)
    assert got == [dt.datetime(2026, 4, 10, 10), dt.datetime(2026, 4, 10, 10, 0, 0, 123456), dt.datetime(2026, 4, 10, 10), None, None]
    lo, hi = dt.datetime(2026, 4, 10, 10), dt.datetime(2026, 4, 10, 11)
    assert scalars.resolve_at("", lo, hi) is None
    assert scalars.resolve_at("-5m", lo, hi) == dt.datetime(2026, 4, 10, 10, 55)
    assert scalars.resolve_at("2026-04-10T10:30:00Z", lo, hi) == dt.datetime(2026, 4, 10, 10, 30)
    for bad in ("2026-04-10T09:00:00Z", "5m", "-2h", "yesterday"):
        with pytest.raises(ValueError):
            scalars.resolve_at(bad, lo, hi)
    with pytest.raises(ValueError):
        scalars.resolve_window("-5m", "-10m", lo, hi)


def test_age_text(spark):
    now = "2026-04-10 10:00:00"
    seconds = {9: "9s", 61: "1m", 3600: "60m", 3601: "1h0m", 11520: "3h12m", 172800: "48h0m", 172801: "2d"}
    ref = scalars.at_literal(now)
    df = spark.createDataFrame([(s,) for s in seconds], "s int").select("s", scalars.age_text(
        ref - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s").cast("decimal(18,6)")), ref).alias("a"))
    assert {r["s"]: r["a"] for r in df.collect()} == seconds


def test_canonical_json(spark):
    a, b = '{"b":1.0,"a":{"y":[1,2],"x":null}}', '{"a":{"x":null,"y":[1,2]},"b":1}'
    assert one(spark, a, scalars.canon_json) == one(spark, b, scalars.canon_json)
    assert one(spark, "not json", scalars.canon_json) == "not json"


LABELS = {
    "app=web": [0], "app==web": [0], "app!=web": [1, 2], "app in (web, db)": [0, 1], "app notin (web)": [1, 2], "app": [0, 1], "!app": [2],
    "app,tier=x": [1], "": [0, 1, 2], "app!=web,!app": [2], "app in (web,db),tier notin (x)": [0],
}


@pytest.mark.parametrize("selector,want", LABELS.items())
def test_label_selectors(spark, selector, want):
    df = spark.createDataFrame([(0, {"app": "web"}), (1, {"app": "db", "tier": "x"}), (2, None)], "i int, l map<string,string>")
    assert sorted(r["i"] for r in df.filter(selectors.labels_match("l", selector)).collect()) == want
    if selector:
        assert sorted(r["i"] for r in df.filter(selectors.labels_match_strict("l", selector)).collect()) == want


@pytest.mark.parametrize("selector", ["", ",", "app in web", "=x", "app=(", "a b"])
def test_strict_selectors_refuse(spark, selector):
    with pytest.raises(ValueError):
        selectors.labels_match_strict("l", selector)


FIELDS = [
    ("", "pods", "spec.nodeName=n1", True), ("", "pods", "spec.host=n1", True), ("", "pods", "spec.hostNetwork=false", True),
    ("", "pods", "status.podIPs!=x", True), ("", "pods", "status.phase!=Running", False), ("", "pods", "metadata.name=a,metadata.namespace=ns", True),
    ("", "replicationcontrollers", "status.replicas=0", True), ("batch", "jobs", "status.successful=3", True),
    ("", "events", "source=kubelet", True), ("", "nodes", "spec.unschedulable=false", True), ("", "pods", "spec.restartPolicy=", True),
    ("x.io", "things", "metadata.name=a", True),
]


@pytest.mark.parametrize("group,resource,selector,want", FIELDS)
def test_field_selectors(spark, group, resource, selector, want):
    text = ('{"metadata":{"name":"a","namespace":"ns"},"spec":{"nodeName":"n1"},"status":{"phase":"Running","succeeded":3.0},'
            '"source":{},"reportingComponent":"kubelet"}')
    df = spark.createDataFrame([(text,)], "obj string")
    assert df.filter(selectors.fields_match("obj", group, resource, selector)).count() == int(want)


@pytest.mark.parametrize("group,resource,selector", [("", "pods", "spec.x=1"), ("", "nodes", "metadata.namespace=a"), ("batch", "jobs", "status.succeeded=1"), ("", "pods", "noop")])
def test_field_selectors_refuse(spark, group, resource, selector):
    with pytest.raises(ValueError):
        selectors.field_requirements(group, resource, selector)


DOC = '{"a":{"b":[{"n":"x","v":1},{"n":"y","v":5},{"n":"z"}],"nul":null,"e":""},"k.8/s":"odd","list":[1,2,3,4]}'
PATHS = {
    "{.a.b[*].n}": ['"x"', '"y"', '"z"'], "{.a.b[0].v}": ["1"], "{.a.b[-1].n}": ['"z"'], "{.a.b[?(@.v>1)].n}": ['"y"'],
    "{.a.b[?(@.n=='x')].v}": ["1"], "{.a.b[?(@.v)].n}": ['"x"', '"y"'], "{.list[1:3]}": ["2", "3"], "{.list[::2]}": ["1", "3"], "{.list[0,3]}": ["1", "4"],
    "{.a.missing}": [], "{.a.nul}": ["null"], "{.a.e}": ['""'], "{['k.8/s']}": ['"odd"'], "{.k\\.8/s}": ['"odd"'], "{..n}": ['"x"', '"y"', '"z"'],
    "{.a.b[*]['n','v']}": ['"x"', "1", '"y"', "5", '"z"'], "{.list[-2:]}": ["3", "4"], ".list[0]": ["1"], "{$.list[9]}": [], "{.a['b'][1]['n']}": ['"y"'],
}


@pytest.mark.parametrize("expr,want", PATHS.items())
def test_jsonpath(spark, expr, want):
    df = spark.createDataFrame([(DOC,)], "obj string").select(F.transform(jsonpath.evaluate("obj", expr), lambda v: F.to_json(v)).alias("r"))
    assert [x for x in df.first()[0]] == want


@pytest.mark.parametrize("expr", ["{range .items[*]}{.x}{end}", "", "name: {.a}", "{.a[?(@.x=~'y')]}", "{.a[(@.length-1)]}"])
def test_jsonpath_refuses(spark, expr):
    with pytest.raises(ValueError):
        jsonpath.evaluate("obj", expr)


def brute_snippet(s, pat, r=40):
    b, p = s.encode(), pat.encode()
    i = b.find(p)
    lo, hi = max(0, i - r), min(len(b), i + len(p) + r)
    while lo > 0 and b[lo] & 0xC0 == 0x80:
        lo -= 1
    while hi < len(b) and b[hi] & 0xC0 == 0x80:
        hi += 1
    return ("…" if lo > 0 else "") + b[lo:hi].decode() + ("…" if hi < len(b) else "")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(alphabet="aé€😀 x", max_size=90), st.text(alphabet="aé€😀 x", max_size=90)), min_size=1, max_size=30))
def test_snippet_bytes(spark, pairs):
    texts = [a + "NEEDLE" + b for a, b in pairs]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for regex in (False, True):
        before, match = first_match("t", "NEE.LE" if regex else "NEEDLE", regex)
        got = [r["s"] for r in df.select("i", snippet("t", before, match).alias("s")).orderBy("i").collect()]
        assert got == [brute_snippet(t, "NEEDLE") for t in texts]


def test_leaves(spark):
    df = spark.createDataFrame([(1, DOC), (2, "broken")], "i int, obj string")
    got = [(r["field"], r["text"]) for r in leaves(df).filter("i = 1").collect()]
    assert got == [("a.b[0].n", "x"), ("a.b[1].n", "y"), ("a.b[2].n", "z"), ("a.e", ""), ('["k.8/s"]', "odd")]


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_ordered_against_brute_force(spark, chunk):
    rng = random.Random(7)
    rows = [(rng.choice("aaaab"), i, rng.choice([None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, s long, v long")
    by = {}
    for k, s, v in rows:
        by.setdefault(k, []).append((s, v))
    chunks = F.floor(F.col("s") / chunk)
    for forward in (False, True):
        out = shifted(df, ["k"], "s", {"p": F.col("s")}, chunks, forward)
        want = {s: (seq[i + 1][0] if i + 1 < len(seq) else None) if forward else (seq[i - 1][0] if i else None) for seq in by.values() for i, (s, _) in enumerate(seq)}
        assert {r["s"]: r["p"] for r in out.collect()} == want
    assert {r["s"]: r["rank"] for r in ranked(df, ["k"], ["s"]).collect()} == {s: i + 1 for seq in by.values() for i, (s, _) in enumerate(seq)}
    fill = {}
    for seq in by.values():
        last = None
        for s, v in seq:
            last = v if v is not None else last
            fill[s] = last
    assert {r["s"]: r["v"] for r in filled(df, ["k"], ["s"], "v").collect()} == fill
