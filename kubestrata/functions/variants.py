"""Walking JSON of any shape natively: one level of all rows at a time, as VARIANT.

Each level is a lateral ``variant_explode_outer``: containers become their members, scalars stay as they are, and the path is
built beside them. All levels are one narrow pass without a shuffle. How many there are is measured first, from the
brackets of the texts; a row that turns out deeper is an error, never a lost leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shape(text) -> Column:
    """The brackets of a JSON text alone, as braces, with runs of siblings that hold nothing taken together."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*+"', ""), r"[^\[\]{}]++", "")
    return F.regexp_replace(F.translate(bare, "[]", "{}"), r"(?:\{\}){2,}+", "{}")


def nesting(shaped: Column) -> Column:
    """How deep the brackets of ``shape`` lie in one another: 0 for a scalar."""
    at = lambda a, c: F.named_struct(
        F.lit("at"), a["at"] + F.when(c == "{", 1).otherwise(-1), F.lit("most"), F.greatest(a["most"], a["at"] + F.when(c == "{", 1).otherwise(0)))
    start = F.named_struct(F.lit("at"), F.lit(0), F.lit("most"), F.lit(0))
    return F.aggregate(F.filter(F.split(shaped, ""), lambda c: c != ""), start, at, lambda a: a["most"])


def deepest(df: DataFrame, column: str) -> int:
    """The greatest nesting in a column of JSON texts; one narrow pass, as objects of a kind have few shapes."""
    shapes = df.select(shape(F.col(f"`{column}`")).alias("s")).distinct()
    return shapes.select(F.max(nesting(F.col("s")))).first()[0] or 0


def step_text(path: Column, key: Column, pos: Column) -> Column:
    """``path`` with one more step: .key, ["odd key"] or [n]."""
    quoted = F.concat(F.lit("["), F.to_json(key.cast("variant")), F.lit("]"))
    plain = F.concat(F.when(path == "", "").otherwise("."), key)
    return F.concat(path, F.when(key.isNull(), F.concat(F.lit("["), pos.cast("string"), F.lit("]")))
                    .when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), plain).otherwise(quoted))


def string_leaves(df: DataFrame, column: str, levels: int | None = None) -> DataFrame:
    """One row per string in the JSON of ``column``: the other columns, ``field`` and ``text``. Texts that are no JSON give none.

    ``levels``, if known, spares the pass that measures it.
    """
    keep = [c for c in df.columns if c != column]
    levels = deepest(df, column) if levels is None else levels
    held = F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("void").alias("_")) if keep else F.lit(0)
    rows = df.select(held.alias("_k"), F.lit("").alias("_f"), F.try_parse_json(F.col(f"`{column}`")).alias("_v"))
    explode = df.sparkSession.tvf.variant_explode_outer
    for _ in range(levels):
        rows = rows.lateralJoin(explode(F.col("_v").outer())).select(
            "_k", F.when(F.col("value").isNull(), F.col("_f")).otherwise(step_text(F.col("_f"), F.col("key"), F.col("pos"))).alias("_f"),
            F.coalesce("value", "_v").alias("_v"))
    kind = F.schema_of_variant("_v")  # of a scalar or an empty container, or it is an error
    deeper = kind.startswith("OBJECT<") & (kind != "OBJECT<>") | kind.startswith("ARRAY<") & (kind != "ARRAY<VOID>")
    text = F.when(kind == "STRING", F.variant_get("_v", "$", "string")).when(deeper, F.raise_error(F.lit(f"JSON nested deeper than {levels} levels")))
    # behind a generator, so that a filter is not pushed to rows that a join below would have dropped
    return rows.select("_k", "_f", F.explode_outer(F.array(text)).alias("_t")).where("_t IS NOT NULL").select(
        *[F.col("_k")[c].alias(c) for c in keep], F.col("_f").alias("field"), F.col("_t").alias("text"))
