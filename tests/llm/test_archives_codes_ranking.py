"""WARC archives, product codebooks and ranked search against plain Python, and their odd cases."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import zstandard

from kubestrata.llm import cover_tree, lexical, warc
from kubestrata.llm.store import new_path

# WARC archives.

PAGES = "page_id long, url string, html string, _sha string, archive int, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "s", 1, "p") for i, u, h in rows], PAGES)


def html(n):
    return f"<html><head><title>{n}</title></head><body>{' '.join(f'part {n * k % 97} of page' for k in range(60))}</body></html>"


@pytest.fixture(scope="module")
def page_rows():
    rows = [(i, f"http://h{i}/a", html(i)) for i in range(40)]
    rows += [(100 - i, "http://copy/", html(3)) for i in range(30)]  # one payload many times
    rows += [(200, None, None), (201, "http://x/ \r\ny", ""), (202, "http://é/", "é\u0000\n\r\n\r\nWARC/1.1\r\n"), (None, "http://n/", html(5)), (None, "http://n/", "alone"),
             (None, "http://n/", "alone"), (203, "http://twice/", "twice"), (203, "http://twice/", "twice"), (-7, "http://long/", "x" * 300_000)]
    return rows


def wanted(rows, least=0):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == data and j is not None]
        first = min(same) if same and len(data) >= least else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first is None or i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 6])
def test_archives_read_back(spark, page_rows, least):
    assert sorted(map(tuple, warc.archive_table(pages(spark, page_rows), least).collect()), key=str) == wanted(page_rows, least)


def test_archives_of_no_pages(spark):
    assert warc.archive_table(pages(spark, [])).count() == 0


def test_archives_have_their_dictionary_in_front_and_any_reader_reads_them(spark, page_rows, tmp_path):
    path = new_path(spark, "archives")
    warc.write_archives(pages(spark, page_rows).coalesce(1), path, archive_bytes=30_000)
    files = warc.export(spark, path, str(tmp_path)).collect()
    assert len(files) > 1 and sum(r["n_records"] for r in spark.read.parquet(path).collect()) == len(page_rows)
    with_dictionary = 0
    for name, size in files:
        data = (tmp_path / name).read_bytes()
        assert len(data) == size
        known = None
        if data[:4] == b"\x5d\x2a\x4d\x18":
            held = int.from_bytes(data[4:8], "little")
            known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + held]))
            data, with_dictionary = data[8 + held :], with_dictionary + 1
        records = []
        while data:  # frame by frame with the library's own notion of where a frame ends
            one = (zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()).decompressobj()
            records.append(one.decompress(data))
            data = one.unused_data
        assert records[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        for r in records:
            fields, block = warc.parse_record(r)
            assert r.endswith(b"\r\n\r\n") and len(block) == int(fields["content-length"]) and "\r" not in fields.get("warc-target-uri", "")
    assert with_dictionary
    read = warc.read_archives(spark, path, payloads=True).collect()
    whole = {(r["page_id"], bytes(r["payload"])) for r in read if r["record_type"] == "response"}
    assert all(r["intact"] for r in read if r["record_type"] == "response")
    assert (-7, b"x" * 300_000) in whole and (202, "é\u0000\n\r\n\r\nWARC/1.1\r\n".encode()) in whole
    some = next(r for r in read if r["page_id"] == 20)  # one record by its offset alone
    content = spark.read.parquet(path).where(f"archive = '{some['archive']}'").first()["content"]
    record = dict(warc.unpack_archive(bytes(content)))[some["offset"]]
    assert html(20).encode() in record


def test_a_dictionary_saves_space():
    records = [html(i).encode() for i in range(200)]
    packed, held = warc.pack_archive(records)
    plain = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    assert held and len(packed) < plain
    assert [r for _, r in warc.unpack_archive(packed)] == records


# Product codebooks.

VECTORS = "vec_id long, embedding array<float>, label int, code string, v string, error int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "c", "v", 1) for i, v, lab in rows], VECTORS)


def lloyd(rows, dims, entries=16, rounds=6):
    """Plain rounds: (rows of the result, codebooks)."""
    fit = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
           if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    fit = [(i, [max(-(1 << 25), min(1 << 25, x)) for x in v], lab) for i, v, lab in fit]
    cut = [0, *np.cumsum([dims // 8 + (k < dims % 8) for k in range(8)]).tolist()]
    first = [v for _, v in sorted({(math.inf if i is None else i, tuple(v)) for i, v, _ in fit})][:entries]
    books = [[list(v[a:b]) for v in first] for a, b in zip(cut, cut[1:])]
    far = lambda p, c: sum((x - y) ** 2 for x, y in zip(p, c))
    nearest = lambda p, book: min(range(len(book)), key=lambda e: (far(p, book[e]), e))
    for _ in range(rounds):
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            own = [nearest(v[a:b], books[k]) for _, v, _ in fit]
            for e in range(len(books[k])):
                mine = [v[a:b] for (_, v, _), o in zip(fit, own) if o == e]
                if mine:
                    books[k][e] = [sum(x) // len(mine) for x in zip(*mine)]
    out, per_label = [], Counter()
    for i, v, lab in fit:
        code = [nearest(v[a:b], books[k]) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
        error = sum(far(v[a:b], books[k][code[k]]) for k, (a, b) in enumerate(zip(cut, cut[1:])))
        out.append((i, "".join(f"{c:02x}" for c in code), error, lab))
        per_label[lab] += error
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted([(i, c, e, per_label[lab], sha) for i, c, e, lab in out], key=str)


@pytest.mark.parametrize("dims", [16, 19])
def test_product_codes(spark, dims, monkeypatch):
    monkeypatch.setattr(cover_tree, "FAN", 6)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((5, dims))
    rows = [(i * 3 % 701, (centre[i % 5] + 0.2 * rng.standard_normal(dims)).tolist(), i % 3 if i % 7 else None) for i in range(300)]
    rows += [(500 + i, rows[4][1], 1) for i in range(60)]  # one vector many times
    rows += [(9, rows[0][1], 0), (9, rows[0][1], 0), (None, rows[1][1], None), (-1, [0.0] * dims, 9), (-2, [0.0] * dims, 9), (-3, [1e30] * dims, 2), (-4, [-1e9] * dims, 2)]
    rows += [(900, None, 0), (901, [None] * dims, 0), (902, [float("nan")] + [0.0] * (dims - 1), 0), (903, [float("-inf")] * dims, 0), (904, [1.0], 0), (905, [], 0)]
    got = sorted(map(tuple, cover_tree.product_codes(vectors(spark, rows).repartition(3)).collect()), key=str)
    assert got == lloyd(rows, dims)


def test_product_codes_of_few_rows(spark):
    assert cover_tree.product_codes(vectors(spark, [])).count() == 0
    few = [(5, [0.5] * 8, 1), (6, [0.25] * 8, None)]
    assert sorted(map(tuple, cover_tree.product_codes(vectors(spark, few)).collect()), key=str) == lloyd(few, 8)


def test_cover_tree_covers_and_assigns_whole_subtrees():
    rng = np.random.default_rng(1)
    points = np.rint(400 * rng.standard_normal((6, 8))[rng.integers(0, 6, 3000)] + 20 * rng.standard_normal((3000, 8))).astype(np.int64)
    tree = cover_tree.Tree.over(points)
    assert sorted(tree.order.tolist()) == list(range(3000))
    for (centre, start, end, child, children), radius in zip(tree.spans, tree.radii):
        own = tree.order[start:end]
        assert centre in own and np.sqrt(((points[own] - points[centre]) ** 2).sum(axis=1)).max() <= radius * (1 + 1e-12)
        if children:
            spans = tree.spans[child : child + children]
            assert spans[0][1] == start and spans[-1][2] == end and (spans[1:, 1] == spans[:-1, 2]).all()
            apart = np.sqrt(((points[spans[:, 0]][:, None] - points[spans[:, 0]][None]) ** 2).sum(axis=2)) + np.eye(children) * 1e9
            assert apart.min() > radius / 2
    book = points[:16]
    start, end, entry, whole = cover_tree.assign(tree, points, book)
    label = np.full(3000, -1)
    label[tree.order[cover_tree._runs(start, end - start)]] = np.repeat(entry, end - start)
    assert (label == cover_tree.exact_nearest(points, book)).all()
    assert ((end - start) * whole).sum() > 1000  # most of these clusters never come down to points


# Ranked search.

DOCS = "doc_id long, text string, item_id long, term string, tf int, rank int"


def ranking(docs, items, k=10):
    terms = lambda t: [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total, df = len(bags), sum(b.total() for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 100 - 75 + (75 * b.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            if score > 0:
                found.append((-score, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(8)
    words = [f"Wort{i}" if i % 3 else f"été{i}" for i in range(120)]
    docs = [(i, " ".join(words[j] for j in rng.zipf(1.3, rng.integers(1, 80)) % 120)) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # ties
    docs += [(7, docs[7][1]), (None, docs[7][1]), (None, docs[9][1]), (2000, None), (2001, ""), (2002, "!?\n\t"), (2003, "ÉTÉ3 été3 É"), (2004, "x" * 5000 + " wort1"),
             (2005, "wort1," * 200_000), (2006, "a b")]
    items = [(i, docs[i * 5][1]) for i in range(30)] + [(3, "wort1 WORT1 Wort1"), (3, "wort1 WORT1 Wort1"), (None, "wort2 " * 500), (40, None), (41, ""), (42, "nowhere"), (43, "x" * 5000), (44, "a b")]
    return docs, items


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "t", 1, 1) for i, t in rows], DOCS)


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "item_id long, text string, doc_id long, score string")


@pytest.mark.parametrize("tile", [1 << 16, 1024])
def test_ranked_search(spark, corpus, tile, monkeypatch):
    monkeypatch.setattr(lexical, "TILE_TERMS", tile)
    monkeypatch.setattr(lexical, "COLUMNS", 16)
    monkeypatch.setattr(lexical, "DOC_ROWS", 50)
    docs, items = corpus
    got = sorted(map(tuple, lexical.rank_documents(table(spark, docs).repartition(3), benchmark(spark, items)).collect()), key=str)
    assert got == ranking(docs, items)


def test_ranked_search_of_empty_tables(spark, corpus):
    docs, items = corpus
    assert lexical.rank_documents(table(spark, []), benchmark(spark, items)).count() == 0
    assert lexical.rank_documents(table(spark, docs), benchmark(spark, [])).count() == 0


def test_partial_sums_stay_below_the_exact_limit():
    rng = np.random.default_rng(2)
    limit = (lexical.EXACT - 1) // lexical.MOST_IMPACT
    weights = [(np.arange(40), rng.integers(1, limit // 4, 40)), (np.array([3]), np.array([limit * 5 + 17])), (np.array([], np.int64), np.array([], np.int64))]
    blocks = lexical.exact_blocks(weights, 40, 16)
    assert all((w.sum(axis=0) <= limit).all() for _, w in blocks)
    row, term = np.repeat(np.arange(5), 40), np.tile(np.arange(40), 5)
    value = rng.integers(1, lexical.MOST_IMPACT, 200)
    got = lexical.tile_scores(blocks, row, term, value, 5, 40, 3)
    for d in range(5):
        for i, (t, w) in enumerate(weights):
            assert int(got[d, i]) == sum(int(a) * int(value[d * 40 + b]) for a, b in zip(w.tolist(), t.tolist()))
