from __future__ import annotations

import hashlib
import json
import logging
import os
import sys
import zipfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
for name in ("DataFrameQueryContextLogger", "SQLQueryContextLogger"):
    logging.getLogger(name).setLevel(logging.CRITICAL)

from kubestrata.schema import CAPTURE_DDL, RECORD_DDL  # noqa: E402
from kubestrata.session import configure  # noqa: E402
from kubestrata.streaming.jobs import use_rocksdb  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "4g")
        # tiny inputs: interpreting beats compiling; the query checks run with code generation
        .config("spark.sql.codegen.wholeStage", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield use_rocksdb(configure(s))
    s.stop()


class Log:
    """Builds record rows: seq counts per path, times are minutes (or seconds) after a start."""

    START = "2026-04-10T10:00:00"

    def __init__(self):
        self.rows, self.seq = [], {}

    def add(self, path, minute, body, event=None, code=200, capture="c"):
        import datetime as dt

        n = self.seq.get((capture, path), 0)
        self.seq[capture, path] = n + 1
        at = dt.datetime.fromisoformat(self.START) + dt.timedelta(minutes=minute)
        text = body if isinstance(body, str) else json.dumps(body)
        self.rows.append((capture, path, n, at, event, "WATCH" if event else "GET", code, text))
        return self

    def df(self, spark):
        return spark.createDataFrame(self.rows, RECORD_DDL)


@pytest.fixture
def log():
    return Log()


def obj(name, ns=None, **more):
    meta = {"name": name} | ({"namespace": ns} if ns else {}) | more.pop("meta", {})
    return {"metadata": meta} | more


def lst(*items, kind="PodList", api="v1"):
    return {"kind": kind, "apiVersion": api, "metadata": {"resourceVersion": "1"}, "items": list(items)}


def captures(spark, version="v1.30.0", start="2026-04-10 09:59:00", end="2026-04-10 10:00:00"):
    import datetime as dt

    row = {"capture_id": "c", "captured_at": dt.datetime.fromisoformat(start), "captured_until": dt.datetime.fromisoformat(end),
           "kubernetes_version": version}
    cols = [c.strip().split(" ")[0] for c in CAPTURE_DDL.split(", ")]
    return spark.createDataFrame([tuple(row.get(c) for c in cols)], CAPTURE_DDL)


def write_archive(path, metadata, records, index, watch_index):
    """A capture archive in the landing format."""
    import zstandard

    pack = lambda v: zstandard.ZstdCompressor().compress(json.dumps(v).encode())
    seen = {}
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("capture/metadata.json", json.dumps(metadata))
        z.writestr("capture/index.json.zst", pack(index))
        if watch_index is not None:
            z.writestr("capture/watch-index.json.zst", pack(watch_index))
        for r in records:
            folder = hashlib.sha256(r["api_path"].encode()).hexdigest()[:16]
            n = seen.get(folder, 0)
            seen[folder] = n + 1
            z.writestr(f"capture/records/{folder}/{n}.json.zst", pack(r))
