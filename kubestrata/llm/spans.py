"""Spans of regular expressions in whole texts, with their places, by SQL functions only.

``regexp_extract_all`` gives the matches and ``split`` the pieces between them; both walk a text from left to right in
the same way, so the lengths of pieces and matches add up to places. All lengths count code points. The two run once
over the texts and leave a narrow table of matches; the rest works on that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kubestrata.llm.store import staged

#: Code points of text kept on either side of a match.
CONTEXT = 48


@dataclass(frozen=True)
class Kind:
    """A kind of span: its name, the pattern, whether its spans are base ones, which nothing removes, how many code
    points behind a match its rule may read beside the context, and whether its spans are scopes: places without a text.

    Patterns must not need more time than in proportion to a text's length, nor a stack: possessive repetitions, and a
    look behind (or the end of the last match) where a match can only start at the start of a run.
    """

    name: str
    pattern: str
    base: bool = True
    tail: int = 0
    scope: bool = False


def _matches(text: Column, hits: Column, kind: Kind, context: bool) -> Column:
    pieces = F.split(text, kind.pattern, -1)
    cut = (lambda f, x, n: f(x, F.lit(n))) if context else (lambda f, x, n: F.lit(""))
    around = F.transform(pieces, lambda x: F.struct(
        F.length(x).alias("n"), cut(F.right, x, CONTEXT).alias("left"), cut(F.left, x, CONTEXT + kind.tail).alias("right")))
    zipped = lambda a: F.transform(hits, lambda h, i: F.struct(
        F.get(a, i)["n"].alias("skip"), F.length(h).alias("size"), (F.lit("") if kind.scope else h).alias("hit"), F.get(a, i)["left"].alias("left"), F.get(a, i + 1)["right"].alias("right")))
    # the pieces are an array of their own row: one evaluation, then places by index
    return F.when(F.size(hits) > 0, F.element_at(F.transform(F.array(around), zipped), 1))


def _through_neighbours(spans: DataFrame, kinds: list[Kind]) -> DataFrame:
    """``left`` and ``right`` go on through the matches of the kind next to them, as far as the text does.

    Pieces and matches in turn are the text again. A match has one code point at least, so as many matches as there are
    code points in the context reach over it (and over a tail, where matches are longer); the work per match is bounded.
    """
    reach = F.element_at(F.array(*[F.lit(CONTEXT + k.tail) for k in kinds]), F.col("at") + 1)
    order = Window.partitionBy("row", "at").orderBy("pos")
    before = F.collect_list(F.concat("left", F.right("hit", F.lit(CONTEXT)))).over(order.rowsBetween(-CONTEXT, -1))
    after = F.collect_list(F.concat(F.left("hit", reach), "right")).over(order.rowsBetween(1, CONTEXT))
    joined = spans.withColumn("_before", before).withColumn("_after", after)
    return joined.withColumn("left", F.right(F.concat(F.array_join("_before", ""), "left"), F.lit(CONTEXT))).withColumn(
        "right", F.left(F.concat("right", F.array_join("_after", "")), reach)).drop("_before", "_after")


def find(docs: DataFrame, kinds: list[Kind], context: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (row, doc_id), one per row of ``docs``; spans (row, kind, at, start, end, hit, left, right).

    ``at`` is the place of the kind in ``kinds``; a null text is empty. ``left`` and ``right`` are the text around a
    match, whatever it holds, with ``context``; else they are empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hit = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", *[F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)).alias(f"h{i}") for i, k in enumerate(kinds)])
    made = hit.select("doc_id", *[_matches(F.col("text"), F.col(f"h{i}"), k, context).alias(f"k{i}") for i, k in enumerate(kinds)])
    found = staged(made.withColumn("row", F.monotonically_increasing_id()), "found")
    whole = None
    for i in range(len(kinds)):
        one = found.select("row", F.lit(i).alias("at"), F.posexplode(f"k{i}").alias("pos", "m")).select("row", "at", "pos", "m.*")
        whole = one if whole is None else whole.unionByName(one)
    if context:
        whole = _through_neighbours(whole, kinds)
    upto = Window.partitionBy("row", "at").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("size")
    end = F.sum(F.col("skip").cast("long") + size).over(upto)
    names = F.array(*[F.lit(k.name) for k in kinds])
    spans = whole.withColumn("end", end).select("row", F.element_at(names, F.col("at") + 1).alias("kind"), "at", (F.col("end") - size).alias("start"), "end", "hit", "left", "right")
    return found.select("row", "doc_id"), spans


def apart_from_base(spans: DataFrame, kinds: list[Kind]) -> DataFrame:
    """Without spans of other kinds that touch a base span; nested and crossing ones alike."""
    if all(k.base for k in kinds):
        return spans
    base = F.element_at(F.array(*[F.lit(k.base) for k in kinds]), F.col("at") + 1)
    forth = Window.partitionBy("row").orderBy("start", "at").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("_b", base).withColumn("_end", F.max(F.when(F.col("_b"), F.col("end"))).over(forth)).withColumn(
        "_start", F.min(F.when(F.col("_b"), F.col("start"))).over(back))
    clear = (F.coalesce("_end", F.lit(-1)) <= F.col("start")) & (F.coalesce("_start", F.col("end")) >= F.col("end"))
    return marked.where(F.col("_b") | clear).drop("_b", "_end", "_start")


def digest(rows: DataFrame, spans: DataFrame, kinds: list[Kind], *more: Column) -> DataFrame:
    """One row per document: doc_id, n_<base kind>, base_sha256, spans and ``more`` aggregates of its spans."""
    base = F.element_at(F.array(*[F.lit(k.base) for k in kinds]), F.col("at") + 1)
    text = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    item = F.struct("start", "at", text.alias("text"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["text"]), ",")
    counts = [F.sum((F.col("at") == i).cast("long")).alias(f"n_{k.name}") for i, k in enumerate(kinds) if k.base]
    per_row = spans.groupBy("row").agg(*counts, listed(F.collect_list(F.when(base, item))).alias("_base"), listed(F.collect_list(item)).alias("spans"), *more)
    names = [f"n_{k.name}" for k in kinds if k.base]
    extra = [c for c in per_row.columns if c not in ("row", "_base", "spans", *names)]
    return rows.join(per_row, "row", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names], F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), *extra)
