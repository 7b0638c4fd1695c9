import json
import zipfile

import pytest
from pyspark.sql import functions as F

from kubestrata.operators import timetravel
from kubestrata.sources import archives
from kubestrata.sources import records as rec
from kubestrata.streaming import landing
from test_sources import PODS, build_archive

COLS = "capture_id string, path string, record_id string, captured_at timestamp_ntz, event_type string, response_code int, body string"
LIST = "/api/v1/namespaces/a/pods"


def rows(spark, *items):
    """(path, second, event type, name) -> a micro-batch; the record id tells the order."""
    from datetime import datetime, timedelta

    data = []
    for i, (path, second, kind, name) in enumerate(items):
        body = {"metadata": {"name": name, "namespace": "a"}} if kind else {"items": []}
        data.append(("c", path, f"r{i:03d}", datetime(2026, 4, 10) + timedelta(seconds=second), kind, 200, json.dumps(body)))
    return spark.createDataFrame(data, COLS)


def seqs(spark, target):
    return sorted((r["path"], r["seq"]) for r in landing.read_landed(spark, target).collect())


def test_sequence_goes_on_over_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landing, "FULL_EVERY", 4)
    target = str(tmp_path / "t")
    write = landing.land_batch(target)
    for n in range(2 * landing.FULL_EVERY + 2):
        write(rows(spark, ("/p", n, "ADDED", "x"), (f"/q{n}", n, None, "")), n)
    total = 2 * landing.FULL_EVERY + 2
    assert [s for p, s in seqs(spark, target) if p == "/p"] == list(range(total))
    assert all(s == 0 for p, s in seqs(spark, target) if p != "/p")
    known = landing.counters(spark, target, total)
    assert known.count() == total + 1 and known.filter("path = '/p'").first()["next"] == total
    assert len(known.inputFiles()) <= landing.FULL_EVERY * 8  # a full table and small ones, however many batches


def test_retries_keep_numbers(spark, tmp_path):
    target = str(tmp_path / "t")
    write = landing.land_batch(target)
    batch = rows(spark, ("/p", 1, "ADDED", "x"), ("/p", 2, "MODIFIED", "x"))
    write(rows(spark, ("/p", 0, "ADDED", "w")), 0)
    batch.withColumn("seq", F.lit(77).cast("bigint")).write.parquet(f"{target}/batch=1")  # cut off before its counters
    assert seqs(spark, target) == [("/p", 0)]
    write(batch, 1)
    write(batch, 1)
    assert seqs(spark, target) == [("/p", 0), ("/p", 1), ("/p", 2)]


def test_late_records_take_no_number(spark, tmp_path):
    target = str(tmp_path / "t")
    write = landing.land_batch(target, delay="10 seconds")
    write(rows(spark, ("/p", 100, "ADDED", "x"), ("/q", 5, "ADDED", "x")), 0)
    write(rows(spark, ("/p", 50, "ADDED", "late"), ("/p", 95, "ADDED", "y"), ("/q", 6, "ADDED", "y"), ("/new", 0, "ADDED", "z")), 1)
    assert seqs(spark, target) == [("/new", 0), ("/p", 0), ("/p", 1), ("/q", 0), ("/q", 1)]
    late = spark.read.parquet(f"{target}/_late/batch=1").collect()
    assert [json.loads(r["body"])["metadata"]["name"] for r in late] == ["late"]
    write(rows(spark), 2)  # an empty micro-batch
    assert len(seqs(spark, target)) == 5 and landing.landed_batches(target) == [0, 1, 2]


def drain(df, folder, name):
    out = f"{folder}/{name}"
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(out)


def test_feed_stops_and_restarts_without_loss(spark, tmp_path):
    target, out = str(tmp_path / "t"), str(tmp_path)
    write = landing.land_batch(target)
    write(rows(spark, ("/p", 0, "ADDED", "x"), ("/p", 1, "MODIFIED", "x")), 0)
    write(rows(spark, ("/p", 2, "MODIFIED", "x"), ("/q", 2, "ADDED", "y")), 1)
    rows(spark, ("/p", 9, "ADDED", "no")).withColumn("seq", F.lit(9).cast("bigint")).write.parquet(f"{target}/batch=2")  # not landed yet
    first = sorted((r["path"], r["rv"]) for r in drain(landing.feed(spark, target), out, "f").collect())
    assert first == [("/p", 2), ("/p", 3), ("/p", 4), ("/q", 2)]
    write(rows(spark, ("/p", 3, "DELETED", "x")), 2)
    again = sorted((r["path"], r["rv"]) for r in drain(landing.feed(spark, target), out, "f").collect())
    assert again == sorted([*first, ("/p", 5)])
    assert sorted((r["path"], r["rv"]) for r in landing.versions(spark, target).collect()) == [("/p", 5), ("/q", 2)]


def test_follow_goes_on_from_a_version_and_tells_expired_lists(spark, tmp_path):
    target, out = str(tmp_path / "t"), str(tmp_path)
    landing.land_batch(target)(rows(spark, *[("/p", i, "MODIFIED", "x") for i in range(4)], ("/q", 0, None, ""), ("/q", 1, "ADDED", "y")), 0)
    since = spark.createDataFrame([("c", "/p", 3), ("c", "/q", 1), ("c", "/gone", 4), ("c", "/none", 1), ("c", "/zero", 0)], "capture_id string, path string, rv bigint")
    stream, expired = landing.follow(spark, target, since)
    assert sorted((r["path"], r["rv"]) for r in drain(stream, out, "f").collect()) == [("/p", 4), ("/p", 5), ("/q", 3)]
    assert sorted((r["path"], r["rv"], r["newest"]) for r in expired.collect()) == [("/gone", 4, 1), ("/zero", 0, 1)]


def test_feed_from_batches_no_longer_kept_fails(spark, tmp_path):
    target, out = str(tmp_path / "t"), str(tmp_path)
    write = landing.land_batch(target)
    for n in range(3):
        write(rows(spark, ("/p", n, "ADDED", "x")), n)
    (tmp_path / "t" / "_next" / "batch=1" / "_SUCCESS").unlink()
    with pytest.raises(Exception, match="expired"):
        drain(landing.feed(spark, target, first=0), out, "f")


def test_list_then_follow_misses_nothing_of_the_instant(spark, tmp_path):
    target, out = str(tmp_path / "t"), str(tmp_path)
    write = landing.land_batch(target)
    write(rows(spark, (LIST, 0, "ADDED", "x"), (LIST, 10, "ADDED", "later")), 0)
    now, later = landing.list_then_follow(spark, target, "2026-04-10T00:00:05Z", LIST)
    assert [(r["object_key"], r["rv"]) for r in now.collect()] == [("a/x", 3)]
    write(rows(spark, (LIST, 5, "ADDED", "same"), ("/other", 6, "ADDED", "z")), 1)  # of the very instant, landed after the list
    got = drain(later, out, "f").orderBy("rv").collect()
    assert [(r["object_key"], r["rv"]) for r in got] == [("a/later", 3), ("a/same", 4)]
    batch = timetravel.reconstruct_at(landing.read_landed(spark, target).filter(F.col("path") == LIST), "2026-04-10T00:00:20Z")
    assert {r["object_key"] for r in batch.collect()} == {r["object_key"] for r in [*now.collect(), *got]} | {"a/x"}


# ----------------------------------------------------------------- archives

def test_a_bad_entry_goes_to_quarantine_and_the_rest_lands(spark, tmp_path):
    build_archive(str(tmp_path / "one.zip"))
    build_archive(str(tmp_path / "two.zip"))
    with zipfile.ZipFile(tmp_path / "one.zip", "a") as z:
        z.writestr("cap1/records/00ff/7.json.zst", b"no zstd frame")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "bare.zip", "w") as z:
        z.writestr("cap9/records/00ff/0.json", "{}")
    t = archives.land_archives(spark, str(tmp_path / "*.zip"), str(tmp_path / "stage"))
    assert t["records"].count() == 6 and t["captures"].count() == 2
    bad = sorted((r["file"].rsplit("/", 1)[-1], r["name"] or "") for r in t["quarantine"].collect())
    assert bad == [("bare.zip", ""), ("broken.zip", ""), ("one.zip", "cap1/records/00ff/7.json.zst")]


def test_an_entry_beyond_the_cap_goes_to_quarantine(tmp_path):
    import zstandard

    name = "cap/records/00ff/1.json.zst"
    big = zstandard.ZstdCompressor()
    frame = big.compressobj()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z, z.open(name, "w") as f:
        for _ in range(600):
            f.write(frame.compress(b" " * (1 << 20)))
        f.write(frame.flush())
    with zipfile.ZipFile(tmp_path / "a.zip", "a") as z:
        z.writestr("cap/metadata.json", "{}")
    import pandas as pd

    unit = pd.DataFrame({"file": [str(tmp_path / "a.zip")], "slice": [0], "names": [[name, "cap/metadata.json"]], "problem": [None]})
    got = pd.concat(archives._read_slices(iter([unit])))
    assert list(got["text"].isna()) == [True, False] and "beyond" in got["problem"].iloc[0]


def test_one_large_archive_is_many_even_units(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for i in range(900):
            z.writestr(f"cap/records/{i:04x}/0.json", "x" * 1000)
    with zipfile.ZipFile(tmp_path / "small.zip", "w") as z:
        for i in range(100):
            z.writestr(f"cap/records/{i:04x}/0.json", "x" * 1000)
    import pandas as pd

    files = pd.DataFrame({"file": [str(tmp_path / f) for f in ("big.zip", "small.zip")]})
    units = pd.concat(archives._entry_slices(1, 50_000, None)(iter([files])))
    sizes = units.groupby("file")["names"].apply(lambda n: [len(x) for x in n])
    assert list(sizes.iloc[0]) == [50] * 18 and list(sizes.iloc[1]) == [50, 50]
    got = archives.archive_entries(spark, str(tmp_path / "*.zip"), slice_bytes=50_000, wanted="/000[0-3]/")
    assert got.count() == 8 and got.filter("problem IS NOT NULL").count() == 0
