"""Texts with marks in the place of spans, by SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kubestrata.llm.store import carried, restored, row_key, staged

MARK = "[{}]"


def without_spans(docs: DataFrame, scan: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``docs`` with its columns; every span that ``scan`` finds in a text is replaced by its kind in brackets.

    Spans that overlap are one, under the first one's kind. Rows without spans stay as they are, a null text too.
    ``n_chars``, if there is one and it was the text's length, follows the text.
    """
    names = docs.columns
    keyed = docs.select(*carried(names), F.col("doc_id"), F.col("text").cast("string").alias("text"), *row_key())
    rows, spans = scan(keyed.select(F.col("_k").alias("doc_id"), "text"))
    # one entry per key: rows with the same key have the same text
    parts = F.array_sort(F.collect_set(F.struct("start", "at", "end", "kind")))
    found = staged(spans.join(rows.withColumnRenamed("doc_id", "_k"), "row").groupBy("_k").agg(parts.alias("parts")), "secret-spans")
    joined = keyed.join(found, "_k", "left")
    # walk the spans once: text so far, and the place behind the last span
    step = lambda a, s: F.when(s["start"] >= a["upto"], F.struct(
        F.concat(a["done"], F.array(F.struct(a["upto"].alias("a"), s["start"].alias("b"), s["kind"].alias("kind")))).alias("done"), s["end"].alias("upto"))
    ).otherwise(F.struct(a["done"].alias("done"), F.greatest(a["upto"], s["end"]).alias("upto")))
    empty = F.struct(F.lit(None).cast("array<struct<a:bigint,b:bigint,kind:string>>").alias("none"))["none"]
    start = F.struct(F.coalesce(empty, F.array().cast("array<struct<a:bigint,b:bigint,kind:string>>")).alias("done"), F.lit(0).cast("long").alias("upto"))
    walked = F.aggregate("parts", start, step)
    text = F.col("text")
    piece = lambda p: F.concat(F.substring(text, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), F.lit("["), p["kind"], F.lit("]"))
    marked = F.concat(F.array_join(F.transform(F.col("w.done"), piece), ""), F.substring(text, (F.col("w.upto") + 1).cast("int"), F.length(text)))
    out = joined.withColumn("w", F.when(F.col("parts").isNotNull(), walked)).withColumn("_new", F.when(F.col("w").isNotNull(), marked))
    cols = []
    for i, c in enumerate(names):
        if c == "text":
            cols.append(F.coalesce("_new", f"carried_{i}").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("_new").isNotNull() & (F.col(f"carried_{i}") == F.length("text")), F.length("_new")).otherwise(F.col(f"carried_{i}")).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(restored(names)[i])
    return out.select(*cols)
