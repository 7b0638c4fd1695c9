"""String, time and JSON helpers as Column expressions."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kubestrata.schema import ACCESS_MODES, META_DDL, SIDECAR_HINTS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank(col) -> Column:
    """'' for null, as absent string fields read everywhere in the payload."""
    return F.coalesce(_c(col), F.lit(""))


def zero(col) -> Column:
    return F.coalesce(_c(col), F.lit(0))


def first_non_empty(*cols) -> Column:
    return blank(F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols]))


def or_none(col) -> Column:
    return F.coalesce(F.nullif(_c(col), F.lit("")), F.lit("<none>"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stored(df: DataFrame, column: str) -> DataFrame:
    """``df`` with its last column passed through a one-row generator: nothing above pulls its expression in and repeats it."""
    return df.select(*[f"`{c}`" for c in df.columns if c != column], F.explode(F.array(column)).alias(column))


def record(**fields) -> Column:
    """struct with explicit names; safe inside nested lambdas."""
    return F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])


# ------------------------------------------------------------------- time

_RFC3339 = "^(\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?)(Z|[+-]\\d{2}:\\d{2})$"


def rfc3339(col) -> Column:
    """RFC3339 text -> TIMESTAMP_NTZ holding the UTC wall clock, whatever the session time zone."""
    col = _c(col)
    offset = F.regexp_extract(col, _RFC3339, 2)
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    hours = F.coalesce(F.substring(offset, 2, 2).try_cast("int"), F.lit(0)) * sign
    minutes = F.coalesce(F.substring(offset, 5, 2).try_cast("int"), F.lit(0)) * sign
    wall = F.nullif(F.regexp_extract(col, _RFC3339, 1), F.lit("")).try_cast("timestamp_ntz")
    # the common form needs no pattern work: the cast reads the wall clock and Z adds nothing
    zulu = col.endswith("Z") & (F.length(col) >= 20) & (F.substring(col, 11, 1) == "T")
    return F.when(zulu, col.try_cast("timestamp_ntz")).otherwise(wall - F.make_dt_interval(F.lit(0), hours, minutes))


def at_literal(at) -> Column | None:
    """A point in time as a TIMESTAMP_NTZ literal; None stays None (meaning unset)."""
    if at is None or isinstance(at, Column):
        return at
    if isinstance(at, str):
        at = datetime.fromisoformat(at.replace("Z", "+00:00"))
    if at.tzinfo is not None:
        at = at.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def parse_duration(raw: str) -> timedelta:
    m = re.fullmatch(r"([+-]?)((?:\d+(?:\.\d*)?|\.\d+)(?:ns|us|µs|ms|s|m|h))+", raw)
    if raw in ("0", "+0", "-0"):
        return timedelta(0)
    if not m:
        raise ValueError(f"invalid duration {raw!r}")
    total = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", raw))
    return timedelta(seconds=-total if raw.startswith("-") else total)


def resolve_at(raw: str | None, captured_at: datetime | None, captured_until: datetime | None) -> datetime | None:
    """User time bound: unset, RFC3339, or a duration relative to the capture end; must be in the window."""
    if not raw:
        return None
    try:
        at = datetime.fromisoformat(raw.replace("Z", "+00:00"))
        if at.tzinfo is None:
            raise ValueError("offset missing")
        at = at.astimezone(timezone.utc).replace(tzinfo=None)
    except ValueError:
        try:
            delta = parse_duration(raw)
        except ValueError:
            raise ValueError(f"{raw!r}: must be RFC3339 or a relative duration like -5m") from None
        if captured_until is None:
            raise ValueError(f"{raw!r}: capture end time is unknown; use an absolute RFC3339 time") from None
        at = captured_until + delta
    if captured_at is not None and at < captured_at:
        raise ValueError(f"{raw!r}: requested time is before capture start {captured_at}")
    if captured_until is not None and at > captured_until:
        raise ValueError(f"{raw!r}: requested time is after capture end {captured_until}")
    return at


def resolve_window(from_raw, to_raw, captured_at, captured_until) -> tuple[datetime, datetime]:
    lo = resolve_at(from_raw, captured_at, captured_until) or captured_at
    hi = resolve_at(to_raw, captured_at, captured_until) or captured_until
    if lo is None or hi is None:
        raise ValueError("capture start or end is unknown; give both bounds")
    if hi <= lo:
        raise ValueError(f"{hi} must be after {lo}")
    return lo, hi


def in_window(ts, since=None, until=None) -> Column:
    cond = F.lit(True)
    if since is not None:
        cond = cond & (_c(ts) >= at_literal(since))
    if until is not None:
        cond = cond & (_c(ts) <= at_literal(until))
    return cond


def seconds_between(start, end) -> Column:
    return F.timestamp_diff("SECOND", _c(start), _c(end))


def micros_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def _txt(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def div(a, n: int) -> Column:
    return F.floor(a / F.lit(n))


def age_text(created, ref) -> Column:
    """Dashboard age: 14d, 3h12m, 5m, 9s; '' when unknown, 0s when negative."""
    def text(us: Column) -> Column:
        s = F.floor(us / 1_000_000)
        over = lambda limit: us > limit * 1_000_000
        return (
            F.when(us.isNull(), "")
            .when(us < 0, "0s")
            .when(over(48 * 3600), _txt(div(s, 86400), "d"))
            .when(over(3600), _txt(div(s, 3600), "h", div(s % 3600, 60), "m"))
            .when(over(60), _txt(div(s, 60), "m"))
            .otherwise(_txt(s, "s"))
        )

    return let(micros_between(created, ref), text)


def age_short(created, ref) -> Column:
    """Column age as kubectl prints it: 90s, 5m30s, 170m, 7h5m, 47h, 7d3h, 400d, 3y20d."""
    def text(s: Column) -> Column:
        m, h = div(s, 60), div(s, 3600)
        d = div(h, 24)
        two = lambda big, bu, small, su: F.when(small == 0, _txt(big, bu)).otherwise(_txt(big, bu, small, su))
        return (
            F.when(s.isNull(), "<unknown>")
            .when(s < -1, "<invalid>").when(s < 0, "0s")
            .when(s < 120, _txt(s, "s"))
            .when(m < 10, two(m, "m", s % 60, "s"))
            .when(m < 180, _txt(m, "m"))
            .when(h < 8, two(h, "h", m % 60, "m"))
            .when(h < 48, _txt(h, "h"))
            .when(h < 192, two(d, "d", h % 24, "h"))
            .when(h < 24 * 365 * 2, _txt(d, "d"))
            .when(h < 24 * 365 * 8, two(div(d, 365), "y", d % 365, "d"))
            .otherwise(_txt(div(d, 365), "y"))
        )

    return let(seconds_between(created, ref), text)


# ------------------------------------------------------------------- json

def canon_json(body) -> Column:
    """Text that is equal for semantically equal JSON: keys sorted, 1, 1.0 and 1e0 alike; raw when unparsable."""
    body = _c(body)
    # numbers with an exponent come back as doubles; whole ones lose their fraction, outside strings only
    whole = r'("(?:[^"\\]++|\\.)*+")|(-?[0-9]+)\.0+(?=[,}\]]|$)'
    plain = F.to_json(F.try_parse_json(body))
    doubtful = body.rlike(r"[0-9](?:\.0|[eE])")  # only such a text can come back with a fraction of zeros
    return F.coalesce(F.when(doubtful, F.regexp_replace(plain, whole, "$1$2")).otherwise(plain), body)


def json_same(a, b) -> Column:
    return blank(canon_json(a)) == blank(canon_json(b))


def item_count(body) -> Column:
    body = _c(body)
    n = lambda p: F.json_array_length(F.get_json_object(body, p))
    return F.coalesce(n("$.items"), n("$.rows"), F.lit(0)).cast("int")


def meta_of(obj) -> Column:
    """struct<name, namespace, uid, labels>; null when the object cannot be decoded."""
    return F.from_json(_c(obj), META_DDL)


def _key(meta: Column) -> Column:
    name = blank(meta["metadata"]["name"])
    ns = blank(meta["metadata"]["namespace"])
    return F.when(meta.isNull(), "").when(ns != "", F.concat(ns, F.lit("/"), name)).otherwise(name)


def object_key(obj) -> Column:
    """ns/name, or name; '' when unparsable."""
    return _key(meta_of(obj))


def dedup_key(obj) -> Column:
    """uid, else the bare name (namespace left out on purpose)."""
    m = meta_of(obj)["metadata"]
    return first_non_empty(m["uid"], m["name"])


def http_reason(code, body) -> Column:
    body = _c(body)
    msg = F.when(F.get_json_object(body, "$.kind") == "Status", F.get_json_object(body, "$.message"))
    cut = lambda t, n: F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)
    head = F.concat(F.lit("HTTP "), _c(code).cast("string"))
    text = F.coalesce(cut(F.nullif(msg, F.lit("")), 300), cut(F.trim(body), 160))
    return F.when(blank(body) == "", head).otherwise(F.concat(head, F.lit(": "), text))


# ---------------------------------------------------------------- strings

_HASH = "(?:-(?=[a-z0-9]*[0-9])(?=[a-z0-9]*[a-z])[0-9a-z]{4,10})+$"


def pod_prefix(name) -> Column:
    """Common stem of a pod's siblings: trailing hash segments dropped, else the last segment; '-*' added."""
    name = _c(name)
    stem = let(F.regexp_replace(name, _HASH, ""),
               lambda cut: F.when(cut != name, cut).otherwise(F.regexp_replace(name, "-[^-]*$", "")))
    return F.concat(stem, F.lit("-*"))


def minor_version(version) -> Column:
    """v1.27+ -> 27, null when there is none."""
    return F.regexp_extract(F.trim(_c(version)), "^v?[^.]*\\.([0-9]+)", 1).try_cast("int")


def reason_slug(reason) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(reason)), "[^a-z0-9]", "-"), "^-+|-+$", "")


def line_count(text) -> Column:
    text = _c(text)
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return F.when(text == "", 0).otherwise(newlines + F.when(text.endswith("\n"), 0).otherwise(1))


def is_sidecar(name) -> Column:
    return F.lower(_c(name)).rlike("|".join(h.replace("-", "\\-") for h in SIDECAR_HINTS))


def map_text(m) -> Column:
    """k=v pairs sorted by key, comma separated; '' when empty."""
    m = _c(m)
    entries = F.array_sort(F.map_entries(m))
    return blank(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


def access_modes(modes) -> Column:
    short = F.create_map(*[F.lit(x) for kv in ACCESS_MODES.items() for x in kv])
    shown = F.transform(_c(modes), lambda m: F.coalesce(F.try_element_at(short, m), m))
    return blank(F.array_join(F.filter(shown, lambda m: m != ""), ","))
