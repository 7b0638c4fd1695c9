"""Order-dependent work on keys that may hold a large share of all rows.

A window over one hot key would put that key in one task. Two ways around it:

* ``shifted`` cuts every key into bounded chunks (a chunk is a run of a per-path sequence number, so its
  size has a ceiling) and hands only one row per chunk over the border;
* ``ranked`` numbers rows with a range-partitioned sort: each block counts itself and the small table of
  block sizes gives the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kubestrata.session import checkpointed

CHUNK_ROWS = 1 << 16


#: Parts that rows of one key are dealt into before a join with that key's facts.
SALTS = 16


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """Join narrow ``facts`` to ``rows`` on ``keys`` where one key may hold a large share of the rows.

    Facts are repeated once per salt, so a key's rows meet them in ``SALTS`` tasks; and as the salt is part of the
    join's partitioning, an aggregate by a finer key has an exchange of its own.
    """
    salt = F.pmod(F.hash(*by), F.lit(SALTS))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(repeated, [*keys, "_salt"], how).drop("_salt")


def chunk_of(seq, rows: int = CHUNK_ROWS) -> Column:
    return F.floor((F.col(seq) if isinstance(seq, str) else seq) / F.lit(rows))


def shifted(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: dict[str, Column],
    chunk: Column | None = None,
    forward: bool = False,
) -> DataFrame:
    """``lag`` (or ``lead`` with forward=True) of ``values`` per key, without a per-key task.

    ``order`` must be unique within a key. Per chunk the border row is aggregated with a map-side combine and
    placed in the neighbouring chunk as a carry row, so each window group is one chunk plus one row.
    """
    chunk = chunk_of(order) if chunk is None else chunk
    rows = df.withColumn("_chunk", chunk).withColumn("_val", F.struct(*[v.alias(k) for k, v in values.items()]))
    edge = F.min_by if forward else F.max_by
    borders = rows.groupBy(*keys, "_chunk").agg(edge("_val", order).alias("_val"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    target = F.lag("_chunk").over(across) if forward else F.lead("_chunk").over(across)
    carry = borders.withColumn("_chunk", target).filter("_chunk IS NOT NULL").withColumn("_carry", F.lit(True))
    both = rows.withColumn("_carry", F.lit(False)).unionByName(carry, allowMissingColumns=True)
    lead_in = F.col("_carry").asc() if forward else F.col("_carry").desc()
    w = Window.partitionBy(*keys, "_chunk").orderBy(lead_in, order)
    moved = F.lead("_val").over(w) if forward else F.lag("_val").over(w)
    out = both.withColumn("_val", moved).filter("NOT _carry")
    return out.select(*df.columns, *[F.col("_val")[k].alias(k) for k in values])


def _blocks(df: DataFrame, sort: list[str]) -> DataFrame:
    """Range-partitioned, sorted and checkpointed rows with ``_rid`` (order) and ``_block``.

    The checkpoint keeps block borders fixed when an executor is lost.
    """
    return checkpointed(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_rid", F.monotonically_increasing_id())
    ).withColumn("_block", F.shiftright("_rid", 33))


def _with_block_facts(blocks: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Facts per (keys, block) joined to the rows; null keys match each other."""
    right = facts.withColumnsRenamed({c: f"_r_{c}" for c in [*keys, "_block"]})
    on = blocks["_block"] == right["_r__block"]
    for k in keys:
        on = on & blocks[k].eqNullSafe(right[f"_r_{k}"])
    return blocks.join(right, on)


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """1-based row number per key in a total ``order``.

    Only the table of block sizes (one row per key and block) goes through a window.
    """
    blocks = _blocks(df, [*keys, *order])
    spans = blocks.groupBy(*keys, "_block").agg(F.min("_rid").alias("_start"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (
        _with_block_facts(blocks, offsets, keys)
        .withColumn(out, F.col("_before") + F.col("_rid") - F.col("_start") + 1)
        .select(*df.columns, out)
    )


def filled(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``value`` filled forward over nulls per key: inside each block by a window, across blocks by carry."""
    blocks = _blocks(df, [*keys, *order])
    lasts = blocks.groupBy(*keys, "_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_rid"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(*keys, "_block", F.last("_last", ignorenulls=True).over(before).alias("_last"))
    inside = Window.partitionBy("_block", *keys).orderBy("_rid").rowsBetween(Window.unboundedPreceding, 0)
    out = _with_block_facts(blocks.withColumn(value, F.last(value, ignorenulls=True).over(inside)), carry, keys)
    return out.withColumn(value, F.coalesce(value, "_last")).select(*df.columns)


def running_sums(df: DataFrame, keys: list[str], order: str, value: str, out: str, chunk: Column | None = None) -> DataFrame:
    """Sum of ``value`` over a key's rows up to each one, in two passes: inside chunks, and over the table of chunk sums.

    ``order`` must be a unique number within a key.
    """
    rows = df.withColumn("_chunk", chunk_of(order) if chunk is None else chunk)
    sums = rows.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_inside", F.sum(value).over(inside))
    return summed.join(offsets, [*keys, "_chunk"]).withColumn(out, F.col("_before") + F.col("_inside")).select(*df.columns, out)
