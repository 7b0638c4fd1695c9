"""Secret scans with multipart credential linking (operator 3), by SQL functions only.

Base kinds (``assign``, ``access``, ``hex``) stand by themselves. Others are weak: a user name, a long opaque string,
an address. A credential has several parts, and a weak candidate is reported only if a complementary part lies within
``REACH`` code points of it, or, at any distance, in the same scope of the same text: a block of lines of a
configuration up to a blank line, a section below a name in brackets, or braces with those inside them. A user name near a secret, an opaque string near an identifier or an
address, an address near an identifier and a secret. The join of weak candidates with the intervals around their
complements is done by running maxima over the places of a text, one from the left and one from the right, so no pairs
of parts arise; a scope is a number of its parts, and says which roles it has. Weak candidates that touch a base span are part of it and dropped.

Null texts are empty and give no spans; every row of the input gives one row, repeated rows alike. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kubestrata.llm.spans import Kind, apart_from_base, digest, find

REACH = 160

_NAMES = r"(?i:password|passwd|secret|token|api_?key)"
KINDS = [
    Kind("assign", _NAMES + r"""["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""),
    # the least lengths stand in the patterns: a run that is too short holds no match, and most runs are
    Kind("access", r"AKIA[A-Z0-9]{16,}+"),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
    Kind("user", r"""(?<![A-Za-z0-9])(?i:user|username|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9@._-]++""", base=False),
    Kind("opaque", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{32,}+", base=False),
    Kind("endpoint", r"(?i:https?|ftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]++", base=False),
]
# a line of a configuration: an entry, a comment, brackets alone, one word (a wrapped value, an item of a list), a PEM border
_LINE = (r"""[\x20\t]*+(?:(?:-[\x20\t]++)?+(?:export[\x20\t]++)?+["']?+[A-Za-z0-9_./-]++["']?+[\x20\t]*+[:=][^\n]*+|[#;][^\n]*+|-----[^\n]*+"""
         r"""|[\[\]{}(),;]++[\x20\t\r]*+|(?:-[\x20\t]++)?+["']?+[A-Za-z0-9+/_=.-]++["',;\\]*+[\x20\t\r]*+)(?:\n|\z)""")
SCOPES = [
    Kind("block", rf"(?md)^(?:{_LINE}){{2,}}+", base=False, scope=True),
    Kind("section", rf"(?md)^[\x20\t]*+\[[^\[\]\n]++\][\x20\t\r]*+\n(?:{_LINE}|[\x20\t\r]*+\n)++", base=False, scope=True),
    Kind("braces", r"\{[^{}]*+(?:\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}[^{}]*+)*+\}", base=False, scope=True),
]
_ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "user": "identifier", "opaque": "secret", "endpoint": "endpoint"}


def _valid() -> Column:
    """Which matches are spans at all."""
    value = F.regexp_extract("hit", "(?s)^" + _NAMES + r"""["']?\x20*+[:=]\x20*+["']?(.*)$""", 1)
    mixed = F.col("hit").rlike("[0-9]") & F.col("hit").rlike("[a-z]") & F.col("hit").rlike("[A-Z]")
    size = F.length("hit")
    return (F.when(F.col("kind") == "assign", F.length(value) >= 6).when(F.col("kind") == "access", size >= 20).when(F.col("kind") == "hex", size >= 24)
            .when(F.col("kind") == "opaque", (size >= 32) & mixed).otherwise(True))


def scoped(spans: DataFrame) -> DataFrame:
    """Spans without scopes, with the start of the scope of each kind that they lie in, or null.

    Scopes of one kind do not overlap, so the last one that starts up to a span's start is the only one that can hold it.
    """
    upto = Window.partitionBy("row").orderBy("start", F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = spans
    for k in SCOPES:
        out = out.withColumn(f"_{k.name}", F.last(F.when(F.col("kind") == k.name, F.struct("start", "end")), ignorenulls=True).over(upto))
    for k in SCOPES:
        last = F.col(f"_{k.name}")
        out = out.withColumn(f"_{k.name}", F.when(last["end"] >= F.col("end"), last["start"]))
    return out.where(~F.col("kind").isin([k.name for k in SCOPES]))


def linked(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """Base spans, and weak ones that have their complement within reach or in a scope of theirs."""
    role = F.element_at(F.create_map(*[F.lit(x) for pair in _ROLES.items() for x in pair]), F.col("kind"))
    forth = Window.partitionBy("row").orderBy("start", "at").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = spans.withColumn("_role", role)
    near = {}
    for r in ("identifier", "secret", "endpoint"):
        before = F.max(F.when(F.col("_role") == r, F.col("end"))).over(forth)
        after = F.min(F.when(F.col("_role") == r, F.col("start"))).over(back)
        out = out.withColumn(f"_{r}", F.coalesce(before >= F.col("start") - reach, F.lit(False)) | F.coalesce(after <= F.col("end") + reach, F.lit(False)))
        near[r] = F.col(f"_{r}")
        for k in SCOPES:
            there = F.max(F.col("_role") == r).over(Window.partitionBy("row", f"_{k.name}"))
            out = out.withColumn(f"_{r}", F.col(f"_{r}") | (F.col(f"_{k.name}").isNotNull() & there))
    base = F.element_at(F.array(*[F.lit(k.base) for k in KINDS]), F.col("at") + 1)
    complete = (F.when(F.col("_role") == "identifier", near["secret"]).when(F.col("_role") == "secret", near["identifier"] | near["endpoint"])
                .otherwise(near["identifier"] & near["secret"]))
    return out.where(base | complete).drop("_role", *[f"_{r}" for r in near], *[f"_{k.name}" for k in SCOPES])


def secret_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans) of ``docs`` (doc_id, text); a span has row, kind, at, start, end, hit."""
    rows, spans = find(docs, KINDS + SCOPES)
    return rows, linked(apart_from_base(scoped(spans).where(_valid()), KINDS)).drop("left", "right")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs``."""
    rows, spans = secret_spans(docs)
    return digest(rows, spans, KINDS)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS id FROM documents),
h AS (
  SELECT id, kd, regexp_extract_all(text, p) AS hits, regexp_split_to_array(text, p) AS gaps FROM d, (VALUES
    (0, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'), (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]+'),
    (4, '[A-Za-z0-9+/_=-]+'),
    (5, '(?i:https?|ftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"''<>]+'),
    (3, '\b(?i:user|username|login|account|client_?id|access_?key(?:_?id)?)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._-]+')) k(kd, p)),
u AS (SELECT id, kd, i, hits[i] AS hit, length(gaps[i]) + length(hits[i]) AS n FROM h, unnest(generate_series(1, len(hits))) s(i)),
p AS (SELECT id, kd, hit, sum(n) OVER (PARTITION BY id, kd ORDER BY i) AS e FROM u),
v AS (
  SELECT id, kd, e - length(hit) AS s, e, CASE WHEN kd IN (1, 3) THEN 'i' WHEN kd = 5 THEN 'e' ELSE 's' END AS role FROM p
  WHERE CASE kd WHEN 0 THEN length(regexp_replace(hit, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?', '')) >= 6
        WHEN 1 THEN length(hit) >= 20 WHEN 2 THEN length(hit) >= 24
        WHEN 4 THEN length(hit) BETWEEN 32 AND 512 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')
        ELSE true END),
c AS (SELECT * FROM v a WHERE kd < 3 OR NOT EXISTS (SELECT 1 FROM v b WHERE b.id = a.id AND b.kd < 3 AND b.s < a.e AND b.e > a.s)),
l AS (
  SELECT *, ['assign', 'access', 'hex', 'user', 'opaque', 'endpoint'][kd + 1] || ':' || s || ':' || e AS t FROM c a
  WHERE kd < 3 OR CASE role
    WHEN 'i' THEN EXISTS (SELECT 1 FROM c b WHERE b.id = a.id AND b.role = 's' AND b.e >= a.s - 160 AND b.s <= a.e + 160)
    WHEN 's' THEN EXISTS (SELECT 1 FROM c b WHERE b.id = a.id AND b.role <> 's' AND b.e >= a.s - 160 AND b.s <= a.e + 160)
    ELSE EXISTS (SELECT 1 FROM c b WHERE b.id = a.id AND b.role = 'i' AND b.e >= a.s - 160 AND b.s <= a.e + 160)
     AND EXISTS (SELECT 1 FROM c b WHERE b.id = a.id AND b.role = 's' AND b.e >= a.s - 160 AND b.s <= a.e + 160) END)
SELECT doc_id, count(*) FILTER (kd = 0) AS n_assign, count(*) FILTER (kd = 1) AS n_access, count(*) FILTER (kd = 2) AS n_hex,
  sha256(coalesce(string_agg(t, ',' ORDER BY s, kd) FILTER (kd < 3), '')) AS base_sha256, coalesce(string_agg(t, ',' ORDER BY s, kd), '') AS spans
FROM d LEFT JOIN l USING (id) GROUP BY id, doc_id
"""
