"""Mixing sources to target weights by pivotal dependent rounding (operator 5).

Each source has a target in words; each of its documents is copied ``target / source size`` times on average. The whole
part is taken as it is; the fractional parts are rounded by the pivotal method: two documents meet, words move at
random from one to the other until one's fraction is 0 or 1, and the other goes on with what is left. Moving words,
not fractions, keeps the expected words of every document and the sum of the source, so that a source ends within one
document of its target.

Documents meet in buckets of about ``BUCKET_ROWS`` by a hash of their content, so a source with a third of all rows is
as many buckets as it needs. A bucket is read in order with one document in hand and leaves at most one unfinished;
those meet again, ``FAN_IN`` buckets at a time, level by level, up to one per source, whose fraction is drawn. Every
draw is seeded by level, source and bucket: reruns agree.

Sources are numbered in code point order, null last, and take ``weights`` in turn; shares above ``most`` times their
size are cut to it and the excess is reshared by weight. The source table has one row per source of the mixture.
Null or blank texts have no words: they are taken 0 times. Repeated rows are documents of their own. An empty table
gives an empty mix. Null and clashing other columns are carried along untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kubestrata.llm.store import carried, plain, restored, staged

BUCKET_ROWS = 256
FAN_IN = 256


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the five control characters from tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, n, source_size) -> with ``no`` (its number), ``target``.

    The level ``x`` at which ``sum(min(weight * x, most * size))`` is the wanted total is found from sums alone; each
    round fixes at least one more source, and most mixtures need two or three.
    """
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    table = staged(sizes.withColumn("no", no).withColumn("_w", w).withColumn("_most", most * F.col("source_size")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = 0.0, -1
    while True:
        over = F.col("_most") < F.col("_w") * level
        r = table.agg(F.sum(over.cast("int")), F.sum(F.when(over, F.col("_most"))), F.sum(F.when(~over, F.col("_w")))).first()
        if r[0] == fixed or not r[2]:
            break
        fixed, level = r[0], (share * total - (r[1] or 0.0)) / r[2]
    return table.withColumn("target", F.least(F.col("_w") * level, F.col("_most"))).drop("_w", "_most")


def _play(f: list[float], size: list[int], p: int, i: int, draw: float) -> int:
    """Documents ``p`` and ``i`` meet; one's fraction becomes 0 or 1. Returns the one that goes on."""
    up = min(size[p] * (1 - f[p]), size[i] * f[i])
    down = min(size[p] * f[p], size[i] * (1 - f[i]))
    if draw * (up + down) < down:  # p gains `up` words with probability down / (up + down)
        if up == size[p] * (1 - f[p]):
            f[i], f[p] = min(1.0, max(0.0, f[i] - up / size[i])), 1.0
            return i
        f[p], f[i] = min(1.0, max(0.0, f[p] + up / size[p])), 0.0
        return p
    if down == size[p] * f[p]:
        f[i], f[p] = min(1.0, max(0.0, f[i] + down / size[i])), 0.0
        return i
    f[p], f[i] = min(1.0, max(0.0, f[p] - down / size[p])), 1.0
    return p


def _round(seed: int, level: int):
    """Over rows sorted by (_no, _bucket, ...): all but one per bucket get ``_up`` 0 or 1; ``_f`` is what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rng, at = None, None, None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            f, size = batch.column("_f").to_pylist(), batch.column("_size").to_pylist()
            keys = list(zip(batch.column("_no").to_pylist(), batch.column("_bucket").to_pylist(), strict=True))
            up: list[int | None] = [None] * len(f)
            p = None
            for i, key in enumerate(keys):
                if key != at:
                    at, rng, p = key, np.random.default_rng([seed, level, *key]), None
                if size[i] == 0 or f[i] <= 0 or f[i] >= 1:
                    up[i] = int(f[i] >= 1 and size[i] > 0)
                elif p is None:
                    p = i
                else:
                    on = _play(f, size, p, i, rng.random())
                    off = p + i - on
                    up[off] = int(f[off])
                    if 0 < f[on] < 1:
                        p = on
                    else:
                        up[on], p = int(f[on]), None
            cols = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"_f": pa.array(f, pa.float64())}
            last = p if p is not None and keys[-1] == keys[p] else None
            held = pa.RecordBatch.from_arrays(list(cols.values()), schema=batch.schema).slice(last, 1) if last is not None else None
            cols["_up"] = pa.array(up, pa.int32())
            done = pa.RecordBatch.from_arrays(list(cols.values()), schema=batch.schema)
            yield done if last is None else done.take(pa.array([i for i in range(len(f)) if i != last], pa.int64()))
        if held is not None:
            yield held

    return run


def mix(docs: DataFrame, carry: list[str] | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
        most: float = 2.0, seed: int = 0) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source, ...) with size, source_size, target and copies, taken (words).

    ``carry`` names the columns that go along (default: all); a carried column of one of those names is replaced.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in made]
    text = F.col("text").cast("string")
    # what the draw depends on is the document itself, never where its row lies
    base = docs.select(*carried(names), word_count(text).alias("_size"), F.col("source").cast("string").alias("_source"),
                       F.xxhash64("doc_id", text).alias("_hash"))
    sizes = base.groupBy(F.col("_source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("source_size"))
    per_source = targets(sizes, weights, share, most).select(
        F.col("source").alias("_s"), F.col("no").alias("_no"), F.col("n").alias("_n"), F.col("source_size").alias("_whole_size"), F.col("target").alias("_target"))
    rate = F.when(F.col("_whole_size") > 0, F.least(F.col("_target") / F.col("_whole_size"), F.lit(float(most)))).otherwise(0.0)
    buckets = F.greatest(F.ceil(F.col("_n") / BUCKET_ROWS), F.lit(1))
    rows = base.join(per_source, F.col("_source").eqNullSafe(F.col("_s"))).select(
        *plain(names), "_size", "_hash", "_whole_size", "_target", "_no", F.pmod("_hash", buckets).alias("_bucket"),
        F.floor(rate).cast("int").alias("_whole"), (rate - F.floor(rate)).alias("_f"), F.lit(None).cast("int").alias("_up"))
    largest = per_source.agg(F.max("_n")).first()[0] or 1
    levels = 1 + math.ceil(math.log(math.ceil(largest / BUCKET_ROWS), FAN_IN) - 1e-9)
    schema, done = rows.schema, []
    for level in range(levels):
        rows = rows.repartition("_no", "_bucket").sortWithinPartitions("_no", "_bucket", "_hash", "_size")
        rows = staged(rows.mapInArrow(_round(seed, level), schema), f"mix-{level}")
        done.append(rows.where(F.col("_up").isNotNull()))
        rows = rows.where(F.col("_up").isNull()).withColumn("_bucket", F.floor(F.col("_bucket") / FAN_IN).cast("long"))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "_no", "_hash"), F.lit(1 << 30)) / float(1 << 30)  # at most one document of each source
    done.append(rows.withColumn("_up", (drawn < F.col("_f")).cast("int")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.when(F.col("_size") > 0, F.col("_whole") + F.col("_up")).otherwise(0)
    return out.select(*restored(names), F.col("_size").alias("size"), F.col("_whole_size").alias("source_size"),
                      F.col("_target").alias("target"), copies.alias("copies"), (copies * F.col("_size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of ``docs``."""
    names = docs.columns
    taken = mix(docs.select(*carried(names), *[F.col(c) for c in ("doc_id", "text", "source")]), plain(names), **options)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return taken.where("copies > 0").select(*plain(names), copies.alias("_copy")).select(*restored(names))
