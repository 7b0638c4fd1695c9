"""Operators on documents against brute force, and their odd cases: nulls, blanks, ties, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kubestrata.llm import credentials, mixing, near_copies, packing, personal, quality, token_files
from kubestrata.llm.components import components
from kubestrata.llm.queries import vocabulary

DDL = "doc_id long, text string, lang string, source string, n_chars long, k1 long, band string, size string, _k int, score int"
WORDS = [f"word{i}" for i in range(400)]


def body(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, 400, n))


def changed(text, *places):
    words = text.split(" ")
    for p in places:
        words[p] = "other"
    return " ".join(words)


def table(spark, rows):
    """Rows of (doc_id, text, source) with the columns of documents and some that clash with ours."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, 7, "b", "x", 1, None) for i, t, s in rows], DDL)


@pytest.fixture(scope="module")
def texts():
    a, b = body(1, 120), body(2, 90)
    rows = [(0, a, "s1"), (1, a, "s2"), (2, changed(a, 5), "s1"), (3, changed(a, 60, 61), None), (4, changed(a, 5, 40, 80, 110), "s1"),
            (5, b, "s1"), (6, b.upper().replace(" ", "\n\t"), "s3"), (7, None, "s1"), (8, "", "s2"), (9, " \n ", None), (10, "one", "s1"), (11, "one", "s1"),
            (12, "a b c d", "s1"), (None, b, "s2"), (13, body(3, 3000), "s1"), (5, b, "s1"), (5, b, "s1"), (14, changed(body(3, 3000), 7), "s4"), (15, "One", None)]
    return rows + [(100 + i, changed(a, i, i + 1), "s1") for i in range(0, 60, 2)]


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    """Brute force: links of each row, and the group of each row as a set of row numbers."""
    sets = [grams(t) for _, t, _ in rows]
    linked = [[j for j in range(len(rows)) if j != i and sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in linked[i])]) for i in range(len(rows))]
    return linked, group


def test_near_copies(spark, texts):
    linked, group = groups(texts)
    out = near_copies.near_copies(table(spark, texts)).collect()
    assert len(out) == len(texts)
    ids = lambda g: min((i for k, (i, _, _) in enumerate(texts) if group[k] == g and i is not None), default=None)
    want = sorted((repr(i), ids(group[k]), len(linked[k])) for k, (i, _, _) in enumerate(texts))
    assert sorted((repr(r.doc_id), r.class_id, r.n_links) for r in out) == want
    kept = near_copies.without_near_copies(table(spark, texts))
    assert kept.columns == table(spark, texts).columns
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got)) == len(set(group))
    assert sorted(got) == sorted({ids(g) for g in group})


def test_near_copies_in_blocks(spark, texts, monkeypatch):
    """A component of more classes than a block holds loses no link."""
    monkeypatch.setattr(near_copies, "BLOCK_CLASSES", 5)
    linked, _ = groups(texts)
    out = near_copies.near_copies(table(spark, texts)).collect()
    assert sorted(r.n_links for r in out) == sorted(map(len, linked))


@pytest.mark.parametrize("pairs", [
    [(i, i + 1) for i in range(20)], [(hub, i) for hub in (0, 99) for i in range(1, 30)], [(i * 7 % 31, (i + 1) * 7 % 31) for i in range(31)], [],
])
def test_components(spark, pairs):
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len(parent)
    assert {r.node: r.label for r in got} == {x: root(x) for x in parent}


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.9, 0.999)):
        bands, rows = near_copies.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall


def test_empty_tables(spark, texts):
    none = table(spark, texts).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert near_copies.near_copies(none).count() == near_copies.without_near_copies(none).count() == 0
    assert token_files.token_file_table(none, vocabulary()).count() == 0
    assert packing.pack_documents(none, vocabulary()).count() == 0
    assert mixing.mix(none).count() == mixing.mixed(none).count() == 0
    assert credentials.scan_secrets(none).count() == personal.scan_personal(none).count() == 0
    assert quality.score_documents(none, labels).count() == quality.accepted(none, labels).count() == 0


def encoded(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["it's  1234 é İSTANBUL ǅ <|endoftext|>x ß\x1cq\x85w z don't", "naïve, Straße... x y 'tis    end", "zzz" * 2000]


def test_token_file(spark, texts, tmp_path):
    rows = texts + [(50 + i, t, "s") for i, t in enumerate(ODD)]
    path = str(tmp_path / "tokens")
    token_files.write_token_file(table(spark, rows), path, vocabulary(), end_id=1, segment_ids=500)
    got = [tuple(r) for r in token_files.read_token_file(spark, path).orderBy("start").collect()]
    want, start = [], 0
    for i, t in sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*encoded(t), 1]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    for segment in spark.read.parquet(path).collect():
        sizes = [len(token_files.document_ids(segment.asDict(), i)) for i in range(segment.n_docs)]
        assert sum(sizes) == segment.n_ids
    ids = {r.doc_id: r.ids for r in token_files.read_token_file(spark, path, token_ids=True).collect()}
    assert ids[51] == [*encoded(ODD[1]), 1]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000])
def test_elias_fano(n):
    values = np.sort(np.random.default_rng(n).integers(0, n * 37, n))
    code = token_files.EliasFano.of(values)
    assert code.values().tolist() == values.tolist()
    assert [code.select(i) for i in range(n)] == values.tolist()
    assert len(code.low) + len(code.high) <= n * (2 + np.log2(max(2, values[-1] / n) if n else 1)) / 8 + 16
    with pytest.raises(IndexError):
        code.select(n)


def test_packing(spark, texts):
    rows = texts + [(60, body(9, 5000), "s"), (61, body(8, 2100), "s")]
    out = packing.pack_documents(table(spark, rows), vocabulary(), end_id=0).collect()
    want = []
    for i, t, _ in rows:
        ids = [*encoded(t), 0]
        want += [(repr(i), k, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in out)
    assert len(by) <= -(-total // 2048) + 1
    whole = {r.sequence_id: len(r.ids) for r in packing.sequences(table(spark, rows), vocabulary()).collect()}
    assert sum(whole.values()) == total and max(whole.values()) <= 2048


def exact_bins(sizes, capacity):
    """The least number of bins, by search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(sizes):
            best = len(room)
            return
        for r in sorted(set(room)):
            if r >= sizes[i]:
                left = list(room)
                left[left.index(r)] -= sizes[i]
                go(i + 1, left)
        go(i + 1, [*room, capacity - sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_dominance_fixes_nothing_that_costs_a_bin(seed):
    rng = np.random.default_rng(seed)
    capacity = 30
    sizes = rng.integers(*((1, 31), (8, 20), (5, 29), (9, 16))[seed % 4], 10).tolist()
    plan = packing.Plan({s: sizes.count(s) for s in sizes}, capacity)
    made = {}
    for length, _, bins, each, sequence, offset in plan.runs:
        for k in range(bins):
            made.setdefault(sequence + k, []).extend((offset + j * length, length) for j in range(each))
    assert sorted(x for b in made.values() for _, x in b) == sorted(sizes)
    assert all(sum(x for _, x in b) <= capacity for b in made.values())
    assert sorted(made) == list(range(plan.sequences))
    # what the reduction fixed is part of some best packing
    rest = [x for s, b in made.items() if s >= plan.fixed for _, x in b]
    assert plan.fixed + exact_bins(rest, capacity) == exact_bins(sizes, capacity)


def test_mixing(spark):
    rows = [(i, body(i, 5 + i % 40), ("a", "b", "c", None, "tiny")[min(i % 7, 4) if i % 50 else 4]) for i in range(900)]
    rows += [(2000, None, "a"), (2001, "", None), (2002, " ", "empty"), (3, rows[3][1], rows[3][2])]
    docs = table(spark, rows)
    out = mixing.mix(docs, carry=["doc_id", "source"]).collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + size(t)
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    fixed, want = {}, sum(total.values()) * 1.5
    while True:
        level = (want - sum(fixed.values())) / sum(weight[s] for s in order if s not in fixed)
        over = {s: 2 * total[s] for s in order if s not in fixed and weight[s] * level > 2 * total[s]}
        if not over:
            break
        fixed |= over
    target = {s: fixed.get(s, weight[s] * level) for s in order}
    taken = {}
    for r in out:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= 45, (s, n, target[s])
    again = mixing.mix(docs.repartition(7), carry=["doc_id", "source"]).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r.copies for r in out)


def test_pivotal_rounding_keeps_expectations():
    total = np.zeros(3)
    for seed in range(4000):
        rng = np.random.default_rng(seed)
        f, size = [0.5, 0.3, 0.8], [10, 30, 5]
        p = 0
        for i in (1, 2):
            if 0 < f[p] < 1:
                p = mixing._play(f, size, p, i, rng.random())
            else:
                p = i
        total += [x if x in (0, 1) else float(rng.random() < x) for x in f]
    assert np.allclose(total / 4000, [0.5, 0.3, 0.8], atol=0.03)


SECRETS = ['password: "hunter22x" user=bob, https://db.example.com/x AbCdefGhijk0123456789lmnopqrstuvw_X', "user: joe is far " + "x " * 300 + "token: abcdefgh",
           "AKIA" + "A" * 20 + " é𝔘 token=abcdefg hex " + "0af" * 10, 'Tokenſecret=aaaaaaaa PASSWD = xx API_KEY:=yyyyyyy secret  :  "abc.def/g"', "a" * 50_000,
           "https://clean.example.com/page?x=1 and text", "token=abcdef token=abcdef"]
PERSONS = ["a@b.com_x@y.org a@b@c.de 1.2.3.4.5.6.7.8 999.1.1.1 000.001.02.255 +1 (555) 123-4567", "4245 1005-8116 9930 4111 1111 1111 1111 4111-1111-1111-1112",
           "GB82 WEST 1234 5698 7654 32 call 555-123-4567 ssn 123-45-6789", "555-123-4567 123-45-6789 GB82 WEST 1234 5698 7654 33", "1 " * 20_000, "7" * 20_000 + " " + "1." * 20_000,
           "a." * 20_000 + "@x.y", "+1 " + "(" * 20_000, "write x@y.co, card 4111111111111111"]


def luhn(x):
    d = [int(c) for c in x if c.isdigit()][::-1]
    return sum(v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2) for i, v in enumerate(d)) % 10 == 0


def n_digits(x):
    return sum(c in "0123456789" for c in x)


def either(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


RULES = {
    "secrets": [
        ("assign", "(" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)],
    "persons": [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split(".") if len(p) < 100)),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= n_digits(m[0]) <= 19 and luhn(m[0])),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= n_digits(m[0]) <= 15)],
}


def base_spans(text, rules):
    found = [(m.start(), i, f"{name}:{m.start()}:{m.end()}") for i, (name, p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m)]
    return [sum(x[1] == i for x in found) for i in range(len(rules))], ",".join(x[2] for x in sorted(found))


@pytest.mark.parametrize("which", ["secrets", "persons"])
def test_scans(spark, which):
    texts = (SECRETS if which == "secrets" else PERSONS[:5] + PERSONS[7:]) + [None, "", "plain words", SECRETS[0], PERSONS[0]]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, texts[0], "s")]
    scan = credentials.scan_secrets if which == "secrets" else personal.scan_personal
    out = scan(table(spark, rows)).collect()
    want = sorted((repr(i), *base_spans(t, RULES[which])[0], hashlib.sha256(base_spans(t, RULES[which])[1].encode()).hexdigest()) for i, t, _ in rows)
    counts = [f"n_{r[0]}" for r in RULES[which]]
    assert sorted((repr(r.doc_id), *(r[c] for c in counts), r.base_sha256) for r in out) == want


def test_long_texts_take_linear_time(spark):
    """Runs that make naive patterns quadratic or exhaust the stack."""
    rows = [(i, t, "s") for i, t in enumerate(PERSONS[4:8] + ["token" * 20_000, "a" * 100_000, "user=" * 20_000])]
    assert credentials.scan_secrets(table(spark, rows)).count() == personal.scan_personal(table(spark, rows)).count() == len(rows)


def test_linked_parts(spark):
    out = {r.doc_id: r.spans for r in credentials.scan_secrets(table(spark, [(i, t, "s") for i, t in enumerate(SECRETS)])).collect()}
    assert out[0] == "assign:0:20,user:22:30,endpoint:32:56,opaque:57:92"
    assert out[1] == "assign:617:632"  # the user name is out of reach
    assert out[5] == ""  # an address alone is no secret


def test_checksums_and_context(spark):
    out = {r.doc_id: (r.spans, r.top_score) for r in personal.scan_personal(table(spark, [(i, t, "s") for i, t in enumerate(PERSONS)])).collect()}
    assert out[2][0] == "iban:0:27,local:33:45,national:50:61"
    assert out[3] == ("", None)  # no word for them, and a wrong remainder
    assert out[8] == ("email:6:12,card:19:35", 1.0)


def test_parts_of_long_configurations(spark):
    """Long keys, names with a prefix, and parts that are further apart than the reach in one scope."""
    key, long = "Ab1" * 12, "aB3+" * 400
    gap = "".join(f"option_{i} = value {i}\n" for i in range(40))
    texts = [f"AKIA{'A' * 16} {long}", f"DB_USER=bob {key}", f"db_username: bob {key}", f"AWS_ACCESS_KEY_ID=xyz {key}", f"superuser=bob {key}",
             f"user = bob\n{gap}key = {key}\n", f"user = bob\n{gap}\nkey = {key}\nmore = 1\n", f"[db]\nuser = bob\n\n{gap}\nkey = {key}\n", f"[db]\nuser = bob\n\n{gap}\n[other]\nkey = {key}\n",
             f'{{"user": "bob", "text": "{"word " * 60}", "in": {{"a": 1}}, "key": "{key}"}}', f'{{"user": "bob", "text": "{"word " * 60}"}} {{"key": "{key}"}}', f"user: bob said\n{'prose of many words\n' * 20}{key}\n"]
    out = {r.doc_id: r.spans for r in credentials.scan_secrets(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert out[0] == f"access:0:20,opaque:21:{21 + len(long)}"
    want = [[], ["USER=bob"], ["username: bob"], ["ACCESS_KEY_ID=xyz"], None, ["user = bob"], None, ["user = bob"], None, ['user": "bob'], None, None]
    for i, names in list(enumerate(want))[1:]:
        parts = [] if names is None else [("user", names[0]), ("opaque", key)]
        assert out[i] == ",".join(f"{k}:{texts[i].index(p)}:{texts[i].index(p) + len(p)}" for k, p in parts), i
    long_runs = ["{" * 50_000, "{}" * 30_000 + "{", "a=1\n" * 30_000, "a=1\nsome prose\n" * 10_000, "[a]\n" * 20_000, "[a]\n" + "\n" * 50_000, "{{a}" * 20_000]
    assert credentials.scan_secrets(table(spark, [(i, t, "s") for i, t in enumerate(long_runs)])).where("spans = ''").count() == len(long_runs)


def test_account_numbers_before_capitals(spark):
    """Account numbers end where they end, whatever capitals or digits follow; reference: mod 97 on each one."""
    gb, de, lc, other = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "LC14BOSL123456789012345678901234", "ZZ68ABCDEFGHIJKLMN"
    lc = next(f"LC{i:02}{lc[4:]}" for i in range(2, 99) if int("".join(str(int(c, 36)) for c in lc[4:] + f"LC{i:02}")) % 97 == 1)
    other = next(f"ZZ{i:02}{other[4:]}" for i in range(2, 99) if int("".join(str(int(c, 36)) for c in other[4:] + f"ZZ{i:02}")) % 97 == 1)
    texts = [(de, " Please"), (gb, " BIC WESTGB22"), (gb, " I paid"), (de, " 12345 67"), (gb, ""), (lc, " A"), (lc[:4] + " " + " ".join(lc[4:]), " B 2"), (other, " XY 3"), (de, "é"), (gb, ", AB12")]
    rows = [(i, a + b, "s") for i, (a, b) in enumerate(texts)] + [(90, f"{de} {gb} {de}", "s"), (91, de + "X", "s"), (92, de + "x y", "s"), (93, de[:-1] + "1 Please", "s"), (94, f"x{de} Y", "s")]
    out = {r.doc_id: r.spans for r in personal.scan_personal(table(spark, rows)).collect()}
    assert [out[i] for i in range(len(texts))] == [f"iban:0:{len(a)}" for a, _ in texts]
    assert out[90] == "iban:0:22,iban:23:50,iban:51:73"
    assert [out[i] for i in range(91, 95)] == [""] * 4


def test_context_of_lists(spark):
    """Numbers in a list see the word before its first one; the context is the text's own 48 code points."""
    texts = ["SSN: 123-45-6789, 987-65-4321, 111-22-3333", "call 555-123-4567, 555-987-6543, 555-111-2222 thanks", "123-45-6789; 987-65-4321 is an ssn",
             "ssn 123-45-6789 " + "x" * 40 + " 987-65-4321", "ssn" + " " * 45 + "123-45-6789", "ssn" + " " * 46 + "123-45-6789"]
    out = {r.doc_id: r.spans for r in personal.scan_personal(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert out[0] == "national:5:16,national:18:29,national:31:42"
    assert out[1] == "local:5:17,local:19:31,local:33:45"
    assert out[2] == "national:0:11,national:13:24"
    assert out[3] == "national:4:15"  # the word is further away
    assert (out[4], out[5]) == ("national:48:59", "")


def test_quality(spark):
    rng = np.random.default_rng(0)
    good = lambda i: ". ".join(body(1000 + i * 7 + k, int(rng.integers(6, 14))).capitalize() for k in range(8)) + "."
    junk = lambda i: ("#$%& " + body(i, 3) + "!!!" + " *** " * int(rng.integers(2, 9))) * 6 if i % 2 else (body(i, 2) + " ") * 60
    rows = [(i, good(i) if i % 4 else junk(i // 4), "s") for i in range(800)] + [(5000, None, "s"), (5001, "", None), (None, good(3), "s"), (1, good(1), "s")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 800) if i % 5 < 3] + [(3, None, None), (None, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_documents(table(spark, rows), labels).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 800]
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) / len(held) > 0.97
    # the held-out fold trains nothing
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score_documents(table(spark, rows), turned).collect()
    assert sorted((repr(r.doc_id), round(r.score, 9)) for r in out) == sorted((repr(r.doc_id), round(r.score, 9)) for r in again)
    kept = quality.accepted(table(spark, rows), labels)
    assert kept.columns == table(spark, rows).columns and kept.count() == sum(r.predicted for r in out)


def plain_statistics(text):
    """Each statistic of one text, in plain Python."""
    data = (text or "").encode()
    size, some = len(data), max(1, len(data))
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    words = [data[a:b].decode().lower() for a, b in spans]
    n, lines = max(1, len(words)), (text or "").split("\n")
    count = lambda chars: sum(b in chars.encode() for b in data)
    logit = lambda x: np.log((x + 0.002) / (1 - x + 0.002))
    borders = [a for a, _ in spans[1:]] + [size]
    blank = sum(b in b" \t\n\x0b\x0c\r" for b in data)
    entropy = -sum(data.count(b) / some * np.log(data.count(b) / some) for b in set(data))
    pairs = list(zip(words, words[1:]))
    return [
        np.log1p(size), np.log1p(len(words)), np.log1p((size - blank) / n), logit(count("#$%&*+/<=>@[\\]^_`{|}~") / some),
        logit(count(".,;:!?'\"()-") / some), logit(count("0123456789") / some), logit(sum(65 <= b <= 90 for b in data) / some),
        np.log1p(data.count(b"\n")), np.log1p(size / (data.count(b"\n") + 1)), logit(sum(b - a <= 4 for (a, _), b in zip(spans, borders)) / n), entropy,
        logit(len(set(words)) / n if words else 0), logit(max(map(words.count, words)) / n if words else 0), logit(len(set(pairs)) / max(1, len(pairs)) if words else 0),
        logit(1 - len(set(lines)) / len(lines) if words else 0), logit(sum(b >= 128 for b in data) / some), logit(sum(65 <= data[a] <= 90 for a, _ in spans) / n),
    ]


QUALITY_TEXTS = ["Aa Bb c", "Zed", "x", None, "", " \n ", "  Lead and trail  ", "line\nline\nLine two\n", "É é Été 12, ab!", "Aa Bb c", "#a {b} <c> d", "A", body(3, 300).title()]


@pytest.mark.parametrize("seed", range(4))
def test_quality_statistics_are_of_one_text(seed):
    import pyarrow as pa

    order = np.random.default_rng(seed).permutation(len(QUALITY_TEXTS))
    texts = [QUALITY_TEXTS[i] for i in order]
    want = np.array([plain_statistics(t) for t in texts])
    together = quality.statistics(pa.array(texts, pa.string()))
    assert np.allclose(together, want, rtol=1e-12, atol=1e-12)
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert (together == alone).all()
    assert (quality.statistics(pa.array([*texts, "More"], pa.string()).slice(2, 5)) == together[2:7]).all()


def test_quality_scores_are_those_of_a_plain_discriminant(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(w.title() if rng.random() < 0.2 + 0.5 * (i % 2) else w for w in body(i, int(rng.integers(5, 60))).split()) + ("." if i % 3 else "!\n"), "s") for i in range(300)]
    rows += [(400 + 5 * i, rows[7][1], "s") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in quality.score_documents(table(spark, rows).repartition(5), labels).collect()}
    assert len({out[400 + 5 * i] for i in range(40)} | {out[7]}) == 1  # repeated rows score alike, wherever they lie
    x = {i: np.array(plain_statistics(t)) for i, t, _ in rows}
    train = [[x[i] for i in range(300) if i % 2 == c and zlib.crc32(str(i).encode()) % 5] for c in (0, 1)]
    cov = [np.cov(np.array(t).T, bias=True) for t in train]
    pooled = sum(len(t) * c for t, c in zip(train, cov)) / sum(map(len, train))
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    d = len(scale)
    for i in out:
        log = []
        for c in (0, 1):
            own = (0.5 * cov[c] + 0.5 * pooled) / np.outer(scale, scale)
            own = 0.9 * own + 0.1 * np.trace(own) / d * np.eye(d)
            z = (x[i] - np.mean(train[c], axis=0)) / scale
            log.append(-0.5 * z @ np.linalg.solve(own, z) - 0.5 * np.linalg.slogdet(own)[1] + np.log(len(train[c])))
        assert out[i] == pytest.approx(1 / (1 + np.exp(log[0] - log[1])), abs=1e-4)  # sums of squares cancel


def test_quality_without_a_class(spark):
    docs = table(spark, [(1, "some text", "s"), (2, "", "s")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(docs, labels).collect()} <= {0.5, 1.0}
