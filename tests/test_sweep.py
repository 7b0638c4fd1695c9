"""Counts over a time axis and states from checkpoints against reconstruction at each instant."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kubestrata.functions.ordered import running_sums
from kubestrata.operators import keptstate, sweep, timetravel

from conftest import lst, obj


def history(log, seed, captures=("c1",)):
    """Lists, events, failures and repeats on several paths, with equal times."""
    rng = random.Random(seed)
    for capture in captures:
        for path in ("/api/v1/namespaces/a/pods", "/api/v1/namespaces/b/pods", "/api/v1/namespaces/a/services", "/api/v1/nodes", "/api/v1/namespaces/a/pods?as=Table"):
            events = rng.random() < 0.7
            ns = path.split("/")[4] if "namespaces" in path else None
            minute = rng.randint(0, 2)
            for _ in range(rng.randint(3, 14)):
                minute += rng.choice([0, 1, 1, 2])
                name = rng.choice("uvwxyz")
                kind = rng.random()
                if kind < 0.3 or not events:
                    code = 200 if rng.random() < 0.85 else 500
                    log.add(path, minute, lst(*[obj(n, ns, v=rng.randint(0, 9)) for n in rng.choices("uvwx", k=rng.randint(0, 4))], *([{}] if rng.random() < 0.3 else [])), code=code, capture=capture)
                else:
                    log.add(path, minute, obj(name, ns, v=rng.randint(0, 9)), rng.choice(["ADDED", "MODIFIED", "DELETED"]), capture=capture)
    return log


@pytest.mark.parametrize("seed", range(2))
def test_counts_at_every_instant_are_those_of_the_state(spark, log, seed):
    records = history(log, seed).df(spark).cache()
    axis = timetravel.time_axis(records, 7)
    got = sorted(map(tuple, sweep.counts_over_axis(records, axis).collect()), key=str)
    want = []
    for at in sorted({r["captured_at"] for r in axis.collect()}):
        state = timetravel.reconstruct_at(records, at.isoformat() + "Z").groupBy("capture_id", "namespace", "resource").count().filter("resource <> ''")
        in_axis = {r["capture_id"] for r in axis.filter(F.col("captured_at") == F.lit(at)).collect()}
        want += [(c, at, n, r, k) for c, n, r, k in map(tuple, state.collect()) if c in in_axis]
    assert got == sorted(want, key=str) and got


def test_counts_of_no_records(spark, log):
    records = history(log, 1).df(spark).limit(0)
    assert sweep.counts_over_axis(records, timetravel.time_axis(records)).count() == 0


def test_running_sums(spark):
    rows = [(k, i, (i * 7 + len(k)) % 5 - 2) for k in ("a", "bb") for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {(r["k"], r["i"]): r["s"] for r in running_sums(df, ["k"], "i", "v", "s", F.floor(F.col("i") / 8)).collect()}
    assert got == {(k, i): sum(v for q, j, v in rows if q == k and j <= i) for k, i, _ in rows}


@pytest.mark.parametrize("seed", [5])
def test_a_state_from_a_kept_one_is_the_reconstructed_state(spark, log, tmp_path, seed):
    records = history(log, seed).df(spark).cache()
    folder = str(tmp_path / "kept")
    minute = lambda n: f"2026-04-10T10:{n:02d}:00Z"
    keptstate.keep_states(records, folder, [minute(2), minute(5)])
    keptstate.keep_states(records, folder, [minute(5), minute(9), minute(12)])
    assert len(keptstate.kept_instants(spark, folder)) == 4
    columns = ["capture_id", "path", "position", "obj", "name", "obj_namespace", "resource"]
    for at in [*map(minute, (1, 5, 7, 10)), None]:
        got = keptstate.state_from_kept(records, folder, at).select(*columns)
        want = timetravel.reconstruct_at(records, at).select(*columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str), at
    between = records.filter("captured_at > '2026-04-10 10:05:00' AND captured_at <= '2026-04-10 10:07:00' AND NOT contains(path, '?as=Table')").count()
    assert keptstate.replayed(records, folder, minute(7)).count() == between < records.count() / 3
    plan = keptstate.replayed(records, folder, minute(7))._jdf.queryExecution().optimizedPlan().toString()
    assert "2026-04-10 10:05:00" in plan  # a plain bound on the column
