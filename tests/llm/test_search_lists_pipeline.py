"""Vector search against brute force, URL lists, and the pipeline stage by stage."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kubestrata.llm import adscan, impact, url_lists
from kubestrata.llm.components import components
from kubestrata.llm.credentials import secret_spans
from kubestrata.llm.redaction import without_spans

DDL = "vec_id long, embedding array<float>, label int, query string, shard int, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "q", 1, "v") for i, v in rows], DDL)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 24))
    out = [(i, (centre[i % 6] + 0.6 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(900)]
    out += [(1000, out[0][1]), (1020, out[0][1]), (20, out[20][1])]  # ties, and a repeated row
    return out + [(2000, None), (2020, [None] * 24), (2040, [float("nan")] * 24), (2060, [float("inf")] + [0.0] * 23), (2080, [0.0] * 24), (2100, [1.0, 2.0]), (None, out[1][1])]


def usable(rows, zero):
    fit = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 24 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            fit[i] = np.array(v, np.float32).astype(float)
    return fit


def test_exact_top_k(spark, rows, monkeypatch):
    monkeypatch.setattr(impact, "SHARD_ROWS", 250)
    monkeypatch.setattr(impact, "QUERY_ROWS", 20)
    fit = {i: np.floor(64 * v).astype(int) for i, v in usable(rows, True).items()}
    got = sorted(map(tuple, impact.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()))
    want = []
    for q in fit:
        if q % 20 == 0:
            best = sorted((-int(fit[q] @ v), i) for i, v in fit.items() if i != q)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_exact_top_k_of_few_and_large(spark):
    few = [(0, [1.0, 2.0]), (20, [1e12, -3.0]), (3, [0.0, 0.0])]
    got = sorted(map(tuple, impact.top_k(vectors(spark, few), F.col("vec_id") % 20 == 0).collect()))
    ints = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in few}
    score = lambda a, b: sum(x * y for x, y in zip(ints[a], ints[b]))
    want = [(q, k + 1, i, s) for q in (0, 20) for k, (s, i) in enumerate(sorted(((score(q, i), i) for i in ints if i != q), key=lambda x: (-x[0], x[1])))]
    assert got == sorted(want)
    assert impact.top_k(vectors(spark, few).limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_neighbours(spark, rows, monkeypatch):
    monkeypatch.setattr(adscan, "LIST_ROWS", 60)
    monkeypatch.setattr(adscan, "BLOCK_ROWS", 40)
    fit = usable(rows, False)
    got = {}
    for r in adscan.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {i for i in fit if i % 10 == 0}
    hits = total = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 11)) and q not in {i for i, _ in found.values()}
        for i, s in found.values():
            assert s == pytest.approx(np.sqrt(((fit[q] - fit[i]) ** 2).sum()), abs=1e-12)
        ordered = [(found[k][1], found[k][0]) for k in range(1, 11)]
        assert ordered == sorted(ordered)
        best = sorted((((fit[q] - v) ** 2).sum(), i) for i, v in fit.items() if i != q)[:10]
        hits, total = hits + len({i for _, i in best} & {i for i, _ in found.values()}), total + 10
    assert hits / total >= 0.9


def test_nearest_of_few(spark):
    few = [(0, [1.0, 2.0]), (10, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [5.0, 5.0]), (5, [0.0, 0.0])]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in adscan.nearest_neighbours(vectors(spark, few), F.col("vec_id") % 10 == 0).collect())
    assert got == [(0, 1, 3), (0, 2, 10), (0, 3, 4), (10, 1, 0), (10, 2, 3), (10, 3, 4)]
    assert adscan.nearest_neighbours(vectors(spark, few).limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_url_lists(spark):
    entries = [("bad", "example.com", at(3), 1, True), ("bad", "example.com", at(20), 2, False), ("bad", "Sub.example.com", at(1), 3, True),
               ("spam", "example.com", at(3), 4, True), ("spam", "example.com", at(3), 5, False), ("spam", "example.com", at(25), 6, True),
               (None, "x.org", at(1), 7, True), ("bad", None, at(1), 8, True), ("bad", "x.org", None, 9, True), ("bad", "org", at(2), 10, True), ("bad", "org", at(2), 10, True)]
    pages = [(1, "http://example.com/a", at(2)), (2, "http://example.com/a", at(3)), (3, "https://user@A.Sub.Example.com:8080/x", at(10)), (4, "http://example.com.", at(20)),
             (5, "http://example.com", at(26)), (6, "http://notexample.com", at(10)), (7, None, at(10)), (8, "no url", at(10)), (9, "http://example.com", None), (10, "ftp://y.org?q", at(2)),
             (10, "ftp://y.org?q", at(2)), (None, "http://example.com", at(4))]
    e = spark.createDataFrame(entries, "list string, domain string, ts timestamp, seq long, active boolean")
    p = spark.createDataFrame([(*x, "junk") for x in pages], "page_id long, url string, fetched_at timestamp, since string")
    got = sorted((repr(r.page_id), r.blocked, r.n_entries, r.entry, r.list) for r in url_lists.evaluate(p, e).collect())
    no = (False, 0, None, None)
    want = [("1", *no), ("2", True, 1, "example.com", "bad"), ("3", True, 2, "sub.example.com", "bad"), ("4", *no), ("5", True, 1, "example.com", "spam"), ("6", *no), ("7", *no), ("8", *no),
            ("9", *no), ("10", True, 1, "org", "bad"), ("10", True, 1, "org", "bad"), ("None", True, 1, "example.com", "bad")]
    assert got == sorted(want)
    assert not any(r.blocked for r in url_lists.evaluate(p, e.limit(0)).collect())
    assert url_lists.evaluate(p.limit(0), e).count() == 0


def test_marks_in_place_of_secrets(spark):
    text = 'é token = "abcdef0123456789abcdef0123456789" end'
    docs = spark.createDataFrame([(1, text, len(text)), (2, "clean", 5), (3, None, None), (1, text, 9)], "doc_id long, text string, n_chars long")
    got = sorted((r.doc_id, r.text, r.n_chars) for r in without_spans(docs, secret_spans).collect() if r.text)
    new = 'é [assign]" end'
    assert got == [(1, new, 9), (1, new, len(new)), (2, "clean", 5)]
    assert without_spans(docs, secret_spans).where("text is null").count() == 1


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, seen[-1], sf)
        assert made.columns == docs.columns, name
        seen.append(made.cache())
    source, good, single, clean, mixed = ({r.doc_id: r for r in d.collect()} for d in seen)
    assert set(good) <= set(source) and set(single) <= set(good) and set(clean) == set(single) and set(mixed) <= set(clean)
    grams = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    sets = {i: grams(r.text) for i, r in good.items()}
    ids = sorted(single)
    assert not any(near(sets[a], sets[b]) for k, a in enumerate(ids) for b in ids[k + 1 :])
    # each one that went has a near copy among those before the stage
    assert all(any(near(sets[i], sets[j]) for j in good if j != i) for i in good if i not in single)
    assert not any(re.search("[0-9a-f]{24,}", r.text) for r in clean.values())
    final = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in final} == set(mixed)
    copies = seen[-1].groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {i: sum(r.doc_id == i and r.piece == 0 for r in final) for i in mixed}
