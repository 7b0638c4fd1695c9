"""JSONPath, text and regex search over objects and container logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kubestrata.functions import jsonpath
from kubestrata.functions.paths import log_path_cols
from kubestrata.functions.scalars import blank, first_non_empty, rfc3339
from kubestrata.functions.variants import string_leaves
from kubestrata.operators.textindex import TextIndex, body_digest, may_be_among
from kubestrata.operators.timetravel import latest_at
from kubestrata.schema import BAD_EVENT_REASONS, EVENT_DDL
from kubestrata.session import written

SNIPPET_BYTES = 40
MATCH_COLUMNS = ["capture_id", "path", "group", "version", "resource", "namespace", "name"]


def _own_namespace() -> Column:
    return first_non_empty("obj_namespace", "namespace")


def _scoped(objects: DataFrame, resource: str | None, namespace: str | None) -> DataFrame:
    """Filters first, below any decoding: exact resource, and the object's own namespace (else the path's)."""
    if resource:
        objects = objects.filter(F.col("resource") == resource)
    objects = objects.filter("decodable AND resource <> ''").withColumn("namespace", _own_namespace())
    return objects.filter(F.col("namespace") == namespace) if namespace else objects


def query(objects: DataFrame, expression: str, resource: str | None = None, namespace: str | None = None) -> DataFrame:
    """One row per JSONPath result: match columns and ``value`` as JSON text. Missing keys give no row."""
    hits = _scoped(objects, resource, namespace).select(
        *MATCH_COLUMNS, F.posexplode(F.transform(jsonpath.evaluate("obj", expression), lambda v: F.to_json(v))).alias("n", "value"))
    return hits.select(*MATCH_COLUMNS, "n", F.coalesce("value", F.lit("null")).alias("value"))


# ------------------------------------------------------------------ leaves

def leaves(objects: DataFrame, column: str = "obj", levels: int | None = None) -> DataFrame:
    """One row per string leaf: ``field`` (odd keys quoted, [i] for arrays) and ``text``; ``levels`` as in ``string_leaves``."""
    return string_leaves(objects, column, levels)


# ----------------------------------------------------------------- matching

def first_match(text, pattern: str, regex: bool = False) -> tuple[Column, Column]:
    """(text before the first match, the match) or nulls; matching is exact, on characters."""
    text = F.col(text) if isinstance(text, str) else text
    if not pattern:
        raise ValueError("search pattern must not be empty")
    if not regex:
        at = F.instr(text, F.lit(pattern))
        return F.when(at > 0, F.substring(text, F.lit(1), at - 1)), F.when(at > 0, F.lit(pattern))
    match = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 0))
    # a split yields the text before the first match, except for an empty match at the very start
    empty_at_start = (match == "") & text.rlike(f"\\A(?:{pattern})")
    return F.when(empty_at_start, "").when(match.isNotNull(), F.get(F.split(text, pattern, 2), F.lit(0))), match


def _char_edge(raw: Column, at: Column, step: int) -> Column:
    """Moves a byte offset outward (at most 3 steps) until it does not cut a UTF-8 character."""
    def continues(pos: Column) -> Column:
        byte = F.conv(F.hex(F.substring(raw, pos + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce((byte >= 128) & (byte < 192), F.lit(False))

    c0, c1, c2 = (continues(at + step * k) for k in range(3))
    return (F.when(~c0, at).when(~c1, at + step).when(~c2, at + 2 * step).otherwise(at + 3 * step))


def snippet(text, before: Column, match: Column, radius: int = SNIPPET_BYTES) -> Column:
    """The match with ``radius`` bytes around it, cuts moved outward to character borders, … where cut."""
    text = F.col(text) if isinstance(text, str) else text
    raw = F.encode(text, "UTF-8")
    start = F.octet_length(before)
    size = F.octet_length(text)
    lo = _char_edge(raw, F.greatest(start - radius, F.lit(0)), -1)
    hi_raw = F.least(start + F.octet_length(match) + radius, size)
    hi = F.when(hi_raw >= size, size).otherwise(_char_edge(raw, hi_raw, 1))
    part = F.decode(F.substring(raw, lo + 1, hi - lo), "UTF-8")
    return F.concat(F.when(lo > 0, "…").otherwise(""), part, F.when(hi < size, "…").otherwise(""))


def search_strings(df: DataFrame, column: str, pattern: str, regex: bool = False) -> DataFrame:
    """Rows whose text matches, with ``byte_start`` of the first match and its ``snippet``; whole texts."""
    text = F.col(column)
    hit = text.rlike(pattern) if regex else text.contains(pattern)
    before, match = first_match(column, pattern, regex)
    return (
        df.filter(hit).withColumn("_before", before).withColumn("_match", match)
        .withColumn("byte_start", F.octet_length("_before").cast("bigint"))
        .withColumn("snippet", snippet(column, F.col("_before"), F.col("_match"))).drop("_before", "_match")
    )


def search_text(objects: DataFrame, pattern: str, regex: bool = False, resource: str | None = None,
                namespace: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """Matches in every string leaf: match columns, ``field`` and ``snippet``.

    Without an index every object in scope is decoded: JSON may spell any character as an escape, so the raw text rules
    none out. With one, only texts that may match are read, and only bodies that it does not know are decoded.
    """
    if not pattern:
        raise ValueError("search pattern must not be empty")
    rows = _scoped(objects, resource, namespace)
    if index is None:
        found = search_strings(leaves(rows.select(*MATCH_COLUMNS, "obj")), "text", pattern, regex)
        return found.select(*MATCH_COLUMNS, "field", "snippet", "byte_start")
    known = search_strings(index.to_match(pattern, regex), "text", pattern, regex)
    holders = rows.select(*MATCH_COLUMNS, body_digest("obj").alias("digest"))
    old = holders.join(known, "digest").select(*MATCH_COLUMNS, "field", "snippet", "byte_start")
    # told by digests alone: most often there are none, and bodies need not be shuffled to learn that
    unknown = written(holders.select("digest").distinct().join(index.bodies(), "digest", "left_anti"), "unknown-bodies")
    new = rows.withColumn("digest", body_digest("obj")).filter(may_be_among(unknown)).join(unknown, "digest", "left_semi").drop("digest")
    return old.unionByName(search_text(new, pattern, regex))


def log_lines(records: DataFrame, at=None) -> DataFrame:
    """Pod-log records at T, one row per line: namespace, pod, container, previous, line_no, line."""
    p = log_path_cols("path")
    logs = latest_at(records.filter(p.isNotNull()), at).filter("response_code = 200")
    text = F.get(F.from_json(F.concat(F.lit("["), F.col("body"), F.lit("]")), "array<string>"), F.lit(0))
    is_text = F.trim("body").startswith('"')
    return (
        logs.filter(is_text).select("capture_id", "path", "captured_at", p.alias("p"),
                                    F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
        .select("capture_id", "path", "captured_at", "p.namespace", "p.pod", "p.container", "p.previous", "line_no", "line")
    )


def search_logs(lines: DataFrame, pattern: str, regex: bool = False, resource: str | None = None,
                namespace: str | None = None) -> DataFrame:
    """First match per log line; log lines count as resource ``pods``."""
    if resource and resource != "pods":
        lines = lines.limit(0)
    if namespace:
        lines = lines.filter(F.col("namespace") == namespace)
    return search_strings(lines, "line", pattern, regex)


def limit_with_total(df: DataFrame, order: list, n: int = 500) -> DataFrame:
    """A report page: the first n rows in order, with the full ``total`` and ``truncated`` on each."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).limit(n).withColumn("total", total).withColumn("truncated", F.col("total") > n)


# ------------------------------------------------------------------- events

def event_severity(type_, reason) -> Column:
    return F.when(F.col(reason).isin(BAD_EVENT_REASONS), "bad").when(F.lower(type_) == "warning", "warn").otherwise("normal")


def events_for(objects: DataFrame, namespace: str | None = None, kind: str | None = None, name: str | None = None,
               top: int | None = None) -> DataFrame:
    """Event objects by involved object, with the best known time and a severity; ``top`` newest if given."""
    e = objects.filter(F.col("resource") == "events").select(
        "capture_id", "path", "namespace", F.from_json("obj", EVENT_DDL).alias("e"))
    rows = e.select(
        "capture_id", "path", "namespace", blank("e.involvedObject.kind").alias("kind"),
        blank("e.involvedObject.name").alias("name"), blank("e.type").alias("type"),
        blank("e.reason").alias("reason"), blank("e.message").alias("message"),
        first_non_empty("e.source.component", "e.reportingController").alias("source"),
        F.coalesce(*[rfc3339(F.col(f"e.{c}")) for c in ("lastTimestamp", "eventTime", "firstTimestamp")]).alias("time"),
        F.coalesce("e.count", F.lit(0)).alias("count"),
    ).withColumn("severity", event_severity("type", "reason"))
    for col, want in (("namespace", namespace), ("kind", kind), ("name", name)):
        rows = rows if want is None else rows.filter(F.col(col) == want)
    return rows if top is None else rows.orderBy(F.desc("time"), "reason", "message").limit(top)
