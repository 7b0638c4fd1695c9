"""API path functions, all as Column expressions.

Three parsers answer three different questions and are kept apart: the loose one (what is this path
about), the list one (is this exactly a list path) and the object one (which object or subresource).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kubestrata.functions.scalars import let, record
from kubestrata.schema import KIND_BY_RESOURCE

FIELDS = ["group", "version", "resource", "namespace"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_path(path) -> Column:
    return F.substring_index(_c(path), "?", 1)


def _parts(path: Column) -> Column:
    return F.split(F.when(path.startswith("/"), F.substring(path, 2, 1 << 30)).otherwise(path), "/")


def _struct(cases: list[tuple[Column, list]]) -> Column:
    """struct<group, version, resource, namespace> from the first case that holds, '' where absent."""
    out = {}
    for i, name in enumerate(FIELDS):
        col = None
        for cond, values in cases:
            v = values[i] if isinstance(values[i], Column) else F.lit(values[i])
            col = F.when(cond, v) if col is None else col.when(cond, v)
        out[name] = F.coalesce(col, F.lit(""))
    return record(**out)


def api_path_cols(path) -> Column:
    """Loose parse: query suffix stripped, segments past the resource ignored."""
    def parse(p: Column) -> Column:
        n = F.size(p)
        at = lambda i: F.get(p, F.lit(i))
        core, grouped = at(0) == "api", at(0) == "apis"
        return _struct([
            (core & (n >= 5) & (at(2) == "namespaces"), ["", at(1), at(4), at(3)]),
            (core & (n >= 3), ["", at(1), at(2), ""]),
            (grouped & (n >= 6) & (at(3) == "namespaces"), [at(1), at(2), at(5), at(4)]),
            (grouped & (n >= 4), [at(1), at(2), at(3), ""]),
        ])

    return let(_parts(base_path(path)), parse)


def list_path_cols(path) -> Column:
    """Strict parse: only exact list paths have a resource; nothing is stripped."""
    def parse(p: Column) -> Column:
        n = F.size(p)
        at = lambda i: F.get(p, F.lit(i))
        core, grouped = at(0) == "api", at(0) == "apis"
        return _struct([
            (core & (n == 3), ["", at(1), at(2), ""]),
            (core & (n == 5) & (at(2) == "namespaces"), ["", at(1), at(4), at(3)]),
            (core & (n >= 3), ["", at(1), "", ""]),
            (grouped & (n == 4), [at(1), at(2), at(3), ""]),
            (grouped & (n == 6) & (at(3) == "namespaces"), [at(1), at(2), at(5), at(4)]),
            (grouped & (n >= 4), [at(1), at(2), "", ""]),
        ])

    return let(_parts(_c(path)), parse)


def with_path_cols(df: DataFrame, strict: bool = False, columns: list[str] = FIELDS, prefix: str = "") -> DataFrame:
    """The path columns added to ``df``, parsed once per row (existing ones are replaced)."""
    parsed = (list_path_cols if strict else api_path_cols)("path")
    names = [prefix + c for c in columns]
    keep = [c for c in df.columns if c not in names]
    # a one-row generator keeps later filters from repeating the parse
    rows = df.select(*keep, F.explode(F.array(parsed)).alias("_p"))
    return rows.select(*keep, *[F.col("_p")[c].alias(prefix + c) for c in columns])


def object_path_cols(path) -> Column:
    """Object parse: adds name and subresource. Core ``namespaces`` is both a scope word and a resource."""
    def parse(p: Column) -> Column:
        core = (F.get(p, F.lit(0)) == "api") & (F.size(p) >= 3)
        grouped = (F.get(p, F.lit(0)) == "apis") & (F.size(p) >= 4)
        rest = F.when(core, F.slice(p, 3, 1 << 30)).when(grouped, F.slice(p, 4, 1 << 30)).otherwise(F.array().cast("array<string>"))
        group = F.when(grouped, F.get(p, F.lit(1))).otherwise("")
        version = F.when(core, F.get(p, F.lit(1))).when(grouped, F.get(p, F.lit(2))).otherwise("")

        def scope(r: Column) -> Column:
            n, at = F.size(r), lambda i: F.get(r, F.lit(i))
            in_core = F.when(n == 3, ~at(2).isin("status", "finalize")).otherwise(n >= 4)
            scoped = F.coalesce((at(0) == "namespaces") & F.when(core, in_core).otherwise(n >= 3), F.lit(False))
            return record(namespace=F.when(scoped, at(1)).otherwise(""), tail=F.when(scoped, F.slice(r, 3, 1 << 30)).otherwise(r))

        def named(s: Column) -> Column:
            t = s["tail"]
            part = lambda i: F.when(F.size(t).between(i + 1, 3), F.get(t, F.lit(i))).otherwise("")
            return record(group=group, version=version, resource=part(0), namespace=s["namespace"], name=part(1), subresource=part(2))

        return let(let(rest, scope), named)

    return let(_parts(F.regexp_replace(base_path(path), "/$", "")), parse)


LOG_PATH = "^/api/v1/namespaces/([^/?]*)/pods/([^/?]*)/log(?:\\?(.*))?$"


def is_log_path(path) -> Column:
    return _c(path).rlike(LOG_PATH)


def log_path_cols(path) -> Column:
    """struct<namespace, pod, container, previous>; null when the path is not a pod log."""
    path = _c(path)
    query = F.concat(F.lit("&"), F.regexp_extract(path, LOG_PATH, 3))
    param = lambda k: F.try_url_decode(F.regexp_extract(query, f"&{k}=([^&]*)", 1))
    return F.when(
        is_log_path(path),
        F.struct(
            F.regexp_extract(path, LOG_PATH, 1).alias("namespace"),
            F.regexp_extract(path, LOG_PATH, 2).alias("pod"),
            param("container").alias("container"),
            (param("previous") == "true").alias("previous"),
        ),
    )


def view_kind(path) -> Column:
    """list | table | table_schema | log | discovery | other: what the payload under this path is."""
    path = _c(path)
    suffixed = path.contains("?")
    return (
        F.when(is_log_path(path), "log")
        .when(path.contains("?as=TableSchema"), "table_schema")
        .when(path.contains("?as=Table"), "table")
        .when(suffixed, "other")
        .when(path.rlike("^/api/[^/]+/.+|^/apis/[^/]+/[^/]+/.+"), "list")
        .when(path.rlike("^/(api|apis|version|openapi)(/v[0-9][^/]*|/[^/]+/[^/]+)?$"), "discovery")
        .otherwise("other")
    )


def list_path(group, version, resource, namespace=None) -> Column:
    g, v, r = _c(group), _c(version), _c(resource)
    ns = F.lit("") if namespace is None else _c(namespace)
    base = F.when(g == "", F.concat(F.lit("/api/"), v)).otherwise(F.concat(F.lit("/apis/"), g, F.lit("/"), v))
    scope = F.when(ns == "", F.lit("")).otherwise(F.concat(F.lit("/namespaces/"), ns))
    return F.concat(base, scope, F.lit("/"), r)


def child_match(path, group: str, version: str, resource: str) -> Column:
    """True for the per-namespace list paths below one cluster-wide list path."""
    c = list_path_cols(path)
    return (c["group"] == group) & (c["version"] == version) & (c["resource"] == resource) & (c["namespace"] != "")


def path_dir(path) -> Column:
    return F.substring(F.sha2(_c(path), 256), 1, 16)


def kind_of(resource) -> Column:
    """Kind of a plural resource name: known table, else drop one trailing s and capitalise."""
    resource = _c(resource)
    known = F.create_map(*[F.lit(x) for kv in KIND_BY_RESOURCE.items() for x in kv])
    stem = F.regexp_replace(resource, "s$", "")
    guess = F.concat(F.upper(F.substring(stem, 1, 1)), F.substring(stem, 2, 1 << 30))
    return F.coalesce(F.try_element_at(known, resource), F.when(stem == "", resource).otherwise(guess))
