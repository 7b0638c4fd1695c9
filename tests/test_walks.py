"""JSON walks, field masking and the text index against plain Python on random documents."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from kubestrata import Capture
from kubestrata.functions import variants
from kubestrata.operators import redact, search, textindex
from kubestrata.operators.textindex import TextIndex

from conftest import lst, obj

KEYS = ["a", "b", "name", "odd key", "é", "x.y", "key", "value", "pos"]


def value(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.35:
        return rng.choice(["", "text", 'quo"te\\ {[', "é€😀", "x\ny", 3, -1.5, True, False, None, {}, []])
    if kind < 0.7:
        return {k: value(rng, depth - 1) for k in rng.sample(KEYS, rng.randint(0, 4))}
    return [value(rng, depth - 1) for _ in range(rng.randint(0, 4))]


def strings(v, path=""):
    if isinstance(v, str):
        yield path, v
    elif isinstance(v, dict):
        for k, x in v.items():
            simple = re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", k)
            yield from strings(x, (f"{path}.{k}" if path else k) if simple else f"{path}[{json.dumps(k, ensure_ascii=False)}]")
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from strings(x, f"{path}[{i}]")


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_leaves_of_random_json(spark):
    rng = random.Random(1)
    docs = [(i, value(rng, rng.randint(0, 7))) for i in range(200)]
    deep = "deep"
    for i in range(30):
        deep = {"a": deep} if i % 2 else [deep]
    docs += [(900, deep), (901, "root"), (902, [[[]]])]
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=i % 2 == 0)) for i, v in docs] + [(998, "junk"), (999, None)], "key int, obj string")
    found = variants.string_leaves(df, "obj")
    assert no_python(found) and found.columns == ["key", "field", "text"]
    assert sorted(map(tuple, found.collect())) == sorted((i, f, t) for i, v in docs for f, t in strings(v))
    with pytest.raises(Exception, match="deeper than 3"):
        variants.string_leaves(df, "obj", 3).collect()
    assert variants.deepest(df, "obj") >= 30


def replaced(v, path, new):
    """Plain form of ``touched``: (value, hits)."""
    if not path:
        return new(v), 1
    step, rest, n = path[0], path[1:], 0
    if step is None:
        v, n = replaced(v, rest, new)
        targets, rest = (list(v) if isinstance(v, dict) else range(len(v)) if isinstance(v, list) else ()), path
    elif step is ...:
        targets = range(len(v)) if isinstance(v, list) else ()
    elif isinstance(step, int):
        targets = (step,) if isinstance(v, list) and 0 <= step < len(v) else ()
    else:
        targets = (step,) if isinstance(v, dict) and step in v else ()
    for t in targets:
        v[t], hit = replaced(v[t], rest, new)
        n += hit
    return v, n


@pytest.mark.parametrize("path", ["a.b", "a[*].b", "a[1]", "**.a[*]"])
def test_masking_of_random_json(spark, path):
    rng = random.Random(path)
    docs = [(i, {k: value(rng, 4) for k in rng.sample(KEYS, 5)}) for i in range(120)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in docs] + [(998, "junk"), (999, None), (1000, "[1]")], "seq int, body string")
    masked = redact.redact_fields(df, [redact.Rule(path, "0")])
    assert no_python(masked) == ("**" not in path)
    got = {r["seq"]: (r["fields_masked"], r["body"]) for r in masked.collect()}
    of_type = lambda old: redact.convert("0", {bool: "bool", str: "string", int: "number", float: "number", list: "array", dict: "object"}.get(type(old), "null"))
    for i, v in docs:
        want, hits = replaced(json.loads(json.dumps(v)), redact.tokens(path), of_type)
        assert (got[i][0], json.loads(got[i][1])) == (hits > 0, want if hits else v)
    assert got[998] == (False, "junk") and got[999] == (False, None) and got[1000] == (False, "[1]")


def test_a_replacement_that_does_not_fit_is_an_error(spark):
    df = spark.createDataFrame([('{"a":true}',)], "body string")
    with pytest.raises(Exception, match="not a valid bool"):
        redact.redact_fields(df, [redact.Rule("a", "maybe")]).collect()


# ------------------------------------------------------------------- text index

PATTERNS = ["needle", "ne+dle", "(needle|thread)s?", "^start.*needle$", "n(ee)dle", "x?needle|y", r"\bneedle\b", "(?i)needle", r"ne\x65dle", "[a-z]+dle", "need(?=le)le",
            "(?:needle){2}", "(needle)*thread", r"\Qneedle\E", "[n&&[n]]eedle", "é€😀", "a.c|needle[0-9]", "need.*thread", r"\d{3}", "(?<g>needle)"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_what_a_pattern_requires_is_in_every_match(pattern):
    need = textindex.required(pattern, True)
    rng = random.Random(pattern)
    plain = re.sub(r"\\Q(.*?)\\E", r"\1", pattern).replace("(?<g>", "(?P<g>").replace("[n&&[n]]", "n")
    holds = lambda n, t: n[1] in t if n[0] == "lit" else (all if n[0] == "and" else any)(holds(p, t) for p in n[1])
    for _ in range(300):
        text = "".join(rng.choice(["needle", "thread", "start", "n", "e", "dle", " ", "é€😀", "a", "c", "x", "1", "123", "Need"]) for _ in range(rng.randint(1, 6)))
        if need and re.search(plain, text):
            assert holds(need, text)


def test_requirements():
    r = lambda p: textindex.required(p, True)
    assert r("needle") == ("lit", "needle") and r("ne") is None and textindex.required("a.c*", False) == ("lit", "a.c*")
    assert r("needle|thread") == ("or", [("lit", "needle"), ("lit", "thread")])
    assert r("needle.thread") == ("and", [("lit", "needle"), ("lit", "thread")])
    assert r("needle|x") is None and r("(?i)needle") is None and r(r"\Qneedle\E") is None and r("[a-z]+") is None and r("(needle)?") is None
    assert r("^needle$") == ("lit", "needle") and r("(needle)+") == ("lit", "needle")


@pytest.fixture(scope="module")
def haystack(spark):
    rng = random.Random(4)
    words = ["needle", "thread", "starts", "nee", "dle", "é€😀", "abc", "x", "needles", "Needle", "a.c*"]
    rows = [("c", "/api/v1/namespaces/ns/pods", "", "v1", "pods", "ns", f"p{i}", True, "ns",
             json.dumps({"metadata": {"name": f"p{i}"}, "spec": {"t": [" ".join(rng.choices(words, k=3)) for _ in range(3)], "n": i % 7}}, ensure_ascii=i % 2 == 0)) for i in range(80)]
    rows.append(("c", "/api/v1/namespaces/ns/pods", "", "v1", "pods", "ns", "escaped", True, "ns", '{"b":"n\\u0065edle", "long":"' + "no match " * 3000 + '"}'))
    ddl = "capture_id string, path string, group string, version string, resource string, namespace string, name string, decodable boolean, obj_namespace string, obj string"
    return spark.createDataFrame(rows, ddl)


def found(df):
    return sorted(map(tuple, df.select("name", "field", "snippet", "byte_start").collect()))


def test_index_finds_what_a_scan_finds(spark, haystack, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"))
    assert found(search.search_text(haystack, "needle", index=index)) == found(search.search_text(haystack, "needle"))  # nothing indexed yet
    index.add(haystack.limit(50)).add(haystack)
    assert index.bodies().count() == haystack.select("obj").distinct().count() and index.leaves().count() == search.leaves(haystack).count()
    index.add(haystack)
    assert index.leaves().count() == search.leaves(haystack).count()
    for pattern, regex in [("needle", False), ("a.c*", False), ("x", False), ("needle é€😀", False)] + [
            (p, True) for p in ("(needle|thread)s? x", "^starts", "(?i)NEEDLE")]:
        by_index = search.search_text(haystack, pattern, regex, index=index)
        assert no_python(by_index)
        assert found(by_index) == found(search.search_text(haystack, pattern, regex)), pattern
    cost = index.cost("needle thread").first()
    assert 0 < cost["leaves_matched"] < cost["leaves_indexed"] / 4 and cost["bodies_decoded"] == 0
    assert cost["leaves_matched"] == index.leaves().filter(F.col("text").contains("needle thread")).count()  # places leave no false candidate
    assert index.cost("x").first()["leaves_matched"] == index.leaves().count()
    changed = haystack.withColumn("obj", F.regexp_replace("obj", "starts", "needle"))  # bodies the index has not seen
    assert found(search.search_text(changed, "needle", index=index)) == found(search.search_text(changed, "needle"))


def test_an_unfinished_batch_does_not_count(spark, haystack, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index")).add(haystack)
    index.leaves().write.parquet(f"{index.path}/leaves/batch=lost")
    assert index.leaves().count() == search.leaves(haystack).count()


def test_one_index_serves_every_time(spark, log, tmp_path):
    pods = "/api/v1/namespaces/ns/pods"
    log.add(pods, 0, lst(obj("a", "ns", v="needle one"), obj("b", "ns", v="two"))).add(pods, 1, obj("b", "ns", v="needle now"), "MODIFIED").add(pods, 2, obj("a", "ns"), "DELETED")
    log.add("/api/v1/namespaces/ns/pods/solo", 0, obj("solo", "ns", v="needle solo"))
    cap = Capture(log.df(spark))
    index = cap.index_text(str(tmp_path / "index"))
    for at, names in (("2026-04-10T10:00:00Z", ["a", "solo"]), ("2026-04-10T10:01:00Z", ["a", "b", "solo"]), (None, ["b", "solo"])):
        rows = cap.search_text("needle", at=at, index=index)
        assert sorted(r["name"] for r in rows.collect()) == names == sorted(r["name"] for r in cap.search_text("needle", at=at).collect())
