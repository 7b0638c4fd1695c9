"""Personal data: patterns propose, checksums confirm, nearby words adjust the score (operator 7), by SQL functions only.

Base kinds are reported whenever their own rule holds. Other kinds start from a prior that a checksum or the words
around them must raise to ``LEAST``: bank account numbers confirmed by their remainder modulo 97, and national numbers
and telephone numbers without a country code, which need a word for them within ``spans.CONTEXT`` code points. Every
span gets a score: prior, plus the confirmed checksum, plus the context word.

A bank account number may be followed by further capitals and digits. The pattern finds where one can start; of its
prefixes of 15 to 34 characters that end at the border of a group and pass modulo 97, the one of the country's length is
taken, else the longest.

Null texts are empty and give no spans; every row of the input gives one row, repeated rows alike. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kubestrata.llm.spans import CONTEXT, Kind, apart_from_base, digest, find

LEAST = 0.5

KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+"),  # a shorter run of digits holds no longer one
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    # only the start is taken, so that a number right behind another is found too; the tail holds 30 characters, each after a space
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})", base=False, tail=60),
    Kind("national", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", base=False),
    Kind("local", r"(?<![0-9+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])", base=False),
]
#: Characters of an account number by country, of the IBAN registry; other countries may have any from 15 to 34.
IBAN_CHARS = {c: n for n, names in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in names.split()}
#: Prior, gain of a confirmed checksum or format, and the words that raise a score by WORD.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.3, "phone": 0.6, "iban": 0.3, "national": 0.3, "local": 0.3}
CHECKED = {"card": 0.4, "iban": 0.5}
WORD = 0.3
WORDS = {
    "email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|mastercard|credit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|contact", "iban": "iban|account|bank|konto|cuenta|compte",
    "national": "ssn|social security|tax id|national id|insurance", "local": "phone|tel|call|mobile|fax|contact",
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: x.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (letters and digits) leaves 1 modulo 97, its first four characters moved behind."""
    turned = F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4)))
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1


def _accounts(spans: DataFrame) -> DataFrame:
    """``spans`` with whole account numbers for their starts; starts of none are left out."""
    rest = F.concat("hit", "right")
    run = F.regexp_extract(rest, r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", 0)
    ends = F.filter(F.sequence(F.lit(15), F.length(run)), lambda n: F.substring(rest, n, F.lit(2)).rlike(r"^[A-Z0-9](?![A-Za-z0-9])"))
    codes = F.transform(ends, lambda n: F.struct(n.alias("n"), F.regexp_replace(F.substring(run, F.lit(1), n), " ", "").alias("code")))
    country = F.left("hit", F.lit(2))
    usual = F.coalesce(*[F.when(country.isin([c for c, m in IBAN_CHARS.items() if m == n]), n) for n in sorted(set(IBAN_CHARS.values()))], F.lit(0))
    good = F.filter(codes, lambda x: (F.length(x["code"]) >= 15) & mod97(x["code"]))
    best = F.array_max(F.transform(good, lambda x: F.struct((F.length(x["code"]) == usual).alias("usual"), x["n"].alias("n"))))["n"]
    iban = F.col("kind") == "iban"
    sized = spans.withColumn("_n", F.when(iban, best)).where(~iban | F.col("_n").isNotNull())
    start = F.length("hit")
    return sized.select(
        "row", "kind", "at", "start", F.coalesce(F.col("start") + F.col("_n"), "end").alias("end"), F.coalesce(F.substring(rest, F.lit(1), F.col("_n")), "hit").alias("hit"),
        "left", F.coalesce(F.substring("right", F.col("_n") - start + 1, F.lit(CONTEXT)), "right").alias("right"))


def _checked() -> Column:
    parts = F.split("hit", r"\.")
    small = F.forall(parts, lambda x: F.regexp_replace(x, "^0+", "").rlike("^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    digits = _digits(F.col("hit"))
    size = F.length(digits)
    return (F.when(F.col("kind") == "ip", small).when(F.col("kind") == "card", F.when(size.between(14, 19), luhn(digits)).otherwise(False))
            .when(F.col("kind") == "phone", size.between(10, 15)).otherwise(True))


def _pick(table: dict[str, object], default: object = None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(F.col("kind") == k, F.lit(v)).otherwise(out)
    return out


def _score() -> Column:
    around = F.lower(F.concat_ws(" ", "left", "right"))
    near = F.lit(False)
    for kind, words in WORDS.items():
        near = F.when(F.col("kind") == kind, around.rlike(rf"(?<![a-z])(?:{words})")).otherwise(near)
    return F.round(F.least(F.lit(1.0), _pick(PRIOR, 0.0) + _pick(CHECKED, 0.0) + F.when(near, WORD).otherwise(0.0)), 2)


def personal_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans) of ``docs`` (doc_id, text); a span has row, kind, at, start, end, hit, score."""
    rows, spans = find(docs, KINDS, context=True)
    scored = _accounts(spans).where(_checked()).withColumn("score", _score()).drop("left", "right")
    base = F.col("kind").isin([k.name for k in KINDS if k.base])
    return rows, apart_from_base(scored.where(base | (F.col("score") >= LEAST)), KINDS)


def scan_personal(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and top_score for every row of ``docs``."""
    rows, spans = personal_spans(docs)
    return digest(rows, spans, KINDS, F.max("score").alias("top_score"))


_WORD_SQL = " ".join(f"WHEN {i} THEN '(?:^|[^a-z])(?:{WORDS[k.name]})'" for i, k in enumerate(KINDS))
_NAME_SQL = ", ".join(f"'{k.name}'" for k in KINDS)
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS id FROM documents),
h AS (
  SELECT id, kd, regexp_extract_all(text, p) AS hits, regexp_split_to_array(text, p) AS gaps FROM d, (VALUES
    (0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), (2, '[0-9](?:[\x20-]?[0-9])+'),
    (3, '\+[0-9][\x20().0-9-]+[0-9]'), (4, '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b'), (5, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b'),
    (6, '(?:\([0-9]{3}\)\x20?|\b[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}\b')) k(kd, p)),
u AS (SELECT id, kd, i, hits[i] AS hit, right(gaps[i], 48) || ' ' || left(gaps[i + 1], 48) AS around, length(gaps[i]) + length(hits[i]) AS n
      FROM h, unnest(generate_series(1, len(hits))) s(i)),
p AS (SELECT *, sum(n) OVER (PARTITION BY id, kd ORDER BY i) AS e, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, replace(hit, ' ', '') AS code FROM u),
v AS (
  SELECT id, kd, e - length(hit) AS s, e, CAST(round(least(1.0, [0.8, 0.5, 0.7, 0.6, 0.8, 0.3, 0.3][kd + 1]
         + CASE WHEN regexp_matches(lower(around), CASE kd @WORDS@ END) THEN 0.3 ELSE 0 END), 2) AS DOUBLE) AS score FROM p
  WHERE CASE kd
    WHEN 1 THEN list_bool_and(list_transform(string_split(hit, '.'), lambda x: regexp_full_match(regexp_replace(x, '^0+', ''), '[0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5]')))
    WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''), lambda x, i:
      CASE WHEN i % 2 = 1 THEN CAST(x AS INT) WHEN CAST(x AS INT) > 4 THEN 2 * CAST(x AS INT) - 9 ELSE 2 * CAST(x AS INT) END)) % 10 = 0
    WHEN 3 THEN length(digits) BETWEEN 10 AND 15
    WHEN 4 THEN list_reduce(list_prepend(0, list_transform(string_split(substr(code, 5) || left(code, 4), ''), lambda c: ord(c) - CASE WHEN c <= '9' THEN 48 ELSE 55 END)),
      lambda a, x: (a * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1
    ELSE true END),
w AS (SELECT *, [@NAMES@][kd + 1] || ':' || s || ':' || e AS t FROM v a WHERE kd < 4 OR (score >= 0.5 AND NOT EXISTS (
  SELECT 1 FROM v b WHERE b.id = a.id AND b.kd < 4 AND b.s < a.e AND b.e > a.s)))
SELECT doc_id, count(*) FILTER (kd = 0) AS n_email, count(*) FILTER (kd = 1) AS n_ip, count(*) FILTER (kd = 2) AS n_card,
  count(*) FILTER (kd = 3) AS n_phone, sha256(coalesce(string_agg(t, ',' ORDER BY s, kd) FILTER (kd < 4), '')) AS base_sha256,
  coalesce(string_agg(t, ',' ORDER BY s, kd), '') AS spans, max(score) AS top_score
FROM d LEFT JOIN w USING (id) GROUP BY id, doc_id
""".replace("@WORDS@", _WORD_SQL).replace("@NAMES@", _NAME_SQL)
