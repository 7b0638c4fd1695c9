"""Masking of secrets and of user-chosen fields."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FractionalType, IntegralType, MapType, StringType, StructType

from kubestrata.functions.scalars import let, record
from kubestrata.functions.selectors import label_requirements, labels_match
from kubestrata.schema import FIELD_TYPES

MASK = "REDACTED"
MASK_B64 = base64.b64encode(MASK.encode()).decode()


# ----------------------------------------------------------------- secrets

def _masked(field: str, mask: str, obj: Column) -> Column:
    """The field's map with every value masked, as VARIANT; null when absent or empty."""
    values = F.from_json(F.get_json_object(obj, f"$.{field}"), "map<string,string>")
    return let(values, lambda m: F.when(F.size(m) > 0, F.parse_json(F.to_json(F.transform_values(m, lambda _k, _v: F.lit(mask))))))


def mask_secret(obj, allowed: list[str]) -> Column:
    """Masked JSON of one Secret object, or null when nothing changes (allowed, or no values)."""
    obj = F.col(obj) if isinstance(obj, str) else obj
    name = F.coalesce(F.get_json_object(obj, "$.metadata.name"), F.lit(""))
    ns = F.coalesce(F.get_json_object(obj, "$.metadata.namespace"), F.lit(""))
    key = F.when(ns == "", name).otherwise(F.concat(ns, F.lit("/"), name))
    candidates = F.create_map(F.lit("data"), _masked("data", MASK_B64, obj), F.lit("stringData"), _masked("stringData", MASK, obj))

    def rebuilt(new: Column) -> Column:
        old = F.map_filter(F.from_json(obj, "map<string,variant>"), lambda k, _v: ~F.map_contains_key(new, k))
        return F.when(F.size(new) > 0, F.to_json(F.map_concat(old, new)))

    masked = let(F.map_filter(candidates, lambda _k, v: v.isNotNull()), rebuilt)
    return F.when(~key.isin(allowed), masked) if allowed else masked


def redact_secrets(records: DataFrame, allowed: list[str] | None = None, body: str = "body") -> DataFrame:
    """Secret and SecretList bodies masked (keys kept), snapshots and events alike; ``secrets_masked`` flags rows."""
    allowed = allowed or []
    kind = F.get_json_object(body, "$.kind")
    items = F.from_json(F.get_json_object(body, "$.items"), "array<string>")
    rest = F.map_filter(F.from_json(F.col(body), "map<string,variant>"), lambda k, _v: k != "items")

    def rebuilt(done: Column) -> Column:
        texts = F.transform(done, lambda d: F.coalesce(d["new"], d["old"]))
        new_items = F.parse_json(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))
        changed = F.exists(done, lambda d: d["new"].isNotNull())
        return F.when(changed, F.to_json(F.map_concat(rest, F.create_map(F.lit("items"), new_items))))

    new_list = let(F.transform(items, lambda i: record(new=mask_secret(i, allowed), old=i)), rebuilt)
    masked = F.when(kind == "Secret", mask_secret(body, allowed)).when(kind == "SecretList", new_list)
    rows = records.select("*", F.explode(F.array(masked)).alias("_masked"))
    return rows.withColumn("secrets_masked", F.col("_masked").isNotNull()).withColumn(body, F.coalesce("_masked", body)).drop("_masked")


# ------------------------------------------------------------------ fields

@dataclass
class Rule:
    """field_path: keys, [n], [*] and ** separated by dots; kind '' or * means any; FooList matches Foo."""

    field_path: str
    replacement: str
    kind: str = ""
    namespace: str = ""
    label_selector: str = ""
    value_type: str = ""


def tokens(path: str) -> list:
    """'spec.items[*].x' -> ['spec', 'items', ..., 'x']; ints index, Ellipsis is [*], None is **."""
    out: list = []
    for seg in filter(None, path.split(".")):
        m = re.fullmatch(r"([^\[\]]*)((?:\[(?:\*|-?\d+)\])*)", seg)
        if not m:
            raise ValueError(f"bad path segment {seg!r} in {path!r}")
        if m[1]:
            out.append(None if m[1] == "**" else m[1])
        out += [... if i == "*" else int(i) for i in re.findall(r"\[([^\]]+)\]", m[2])]
    return out


def schema_type(kind: str, path: list) -> str | None:
    """JSON type a known kind declares for the path."""
    ddl = FIELD_TYPES.get(kind.removesuffix("List"))
    if ddl is None or not path:
        return None
    t = StructType.fromDDL(ddl)
    for step in path:
        if isinstance(step, str) and isinstance(t, StructType) and step in t.names:
            t = t[step].dataType
        elif isinstance(step, str) and isinstance(t, MapType):
            t = t.valueType
        elif (step is ... or isinstance(step, int)) and isinstance(t, ArrayType):
            t = t.elementType
        else:
            return None
    names = ((BooleanType, "bool"), (IntegralType, "integer"), (FractionalType, "number"), (ArrayType, "array"),
             (StructType, "object"), (MapType, "object"), (StringType, "string"))
    return next((n for c, n in names if isinstance(t, c)), None)


def convert(text: str, kind: str):
    """The replacement text as a value of a JSON type; a text that does not fit is an error."""
    kind = kind.lower()
    if kind in ("int", "integer"):
        return int(text)
    if kind in ("number", "float"):
        f = float(text)
        return int(f) if f.is_integer() else f
    if kind == "bool":
        if text not in ("1", "t", "T", "TRUE", "true", "True", "0", "f", "F", "FALSE", "false", "False"):
            raise ValueError(f"replacement {text!r} is not a valid bool (use true/false)")
        return text[0] in "1tT"
    return {"array": [], "object": {}, "null": None}.get(kind, text)


JSON_TYPES = ["string", "number", "integer", "bool", "array", "object", "null"]


def _text(v: Column, path: str) -> Column:
    """The string at a path of a VARIANT; null where it is missing or no string."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(at, "$", "string"))


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def runtime_type(v: Column) -> Column:
    """The JSON type of a VARIANT."""
    kind = F.schema_of_variant(v)
    return (F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "bool").when(kind.startswith("OBJECT<"), "object")
            .when(kind.startswith("ARRAY<"), "array").when(kind == "VOID", "null").otherwise("number"))


def _replacement(text: str, kind: Column) -> Column:
    """The replacement as a VARIANT of JSON type ``kind``; a text that does not fit the type it meets is an error."""
    out = F.parse_json(F.lit(json.dumps(text)))
    for t in JSON_TYPES:
        try:
            value = F.parse_json(F.lit(json.dumps(convert(text, t))))
        except ValueError:
            value = F.raise_error(F.lit(f"replacement {text!r} is not a valid {t}")).cast("variant")
        out = F.when(kind == t, value).otherwise(out)
    return out


def touched(v: Column, path: list, leaf) -> Column:
    """struct<v, hit>: ``leaf`` (giving such a struct) applied wherever the path leads from ``v``.

    Only containers above a place that was hit are rebuilt. ``v`` must be cheap to repeat (a column or a lambda's variable).
    """
    if not path:
        return leaf(v)
    step, rest = path[0], path[1:]
    kept = record(v=v, hit=F.lit(False))
    if isinstance(step, str):
        def member(m: Column) -> Column:
            into = lambda r: F.when(r["hit"], record(v=F.to_variant_object(F.map_concat(
                F.map_filter(m, lambda k, _v: k != step), F.create_map(F.lit(step), r["v"]))), hit=F.lit(True))).otherwise(kept)
            return F.when(F.map_contains_key(m, F.lit(step)), let(let(m[step], lambda x: touched(x, rest, leaf)), into)).otherwise(kept)

        return F.coalesce(let(_object(v), member), kept)
    reached = (lambda _i: F.lit(True)) if step is ... else (lambda i: i == F.lit(step))

    def elements(done: Column) -> Column:
        whole = F.to_variant_object(F.transform(done, lambda d: d["v"]))
        return F.when(F.exists(done, lambda d: d["hit"]), record(v=whole, hit=F.lit(True))).otherwise(kept)

    each = F.transform(_array(v), lambda x, i: F.when(reached(i), touched(x, rest, leaf)).otherwise(record(v=x, hit=F.lit(False))))
    return F.coalesce(let(each, elements), kept)


def _in_scope(rule: Rule, v: Column, strict_namespace: bool) -> Column:
    """Whether an object is one that the rule means: its namespace and its labels (those that are strings)."""
    ok = _object(v).isNotNull()
    if rule.namespace:
        ns = F.coalesce(_text(v, "$.metadata.namespace"), F.lit(""))
        ok &= (ns == rule.namespace) if strict_namespace else ns.isin(rule.namespace, "")
    if rule.label_selector:
        labels = F.coalesce(F.try_variant_get(v, "$.metadata.labels", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
        strings = F.map_filter(F.transform_values(labels, lambda _k, x: _text(x, "$")), lambda _k, x: x.isNotNull())
        ok &= labels_match(strings, rule.label_selector)
    return ok


def rule_applied(v: Column, kind: Column, rule: Rule, path: list, types: dict) -> Column:
    """struct<v, hit> of one body of a kind under one rule. Lists are handled per item, and only there does a missing namespace fail a
    namespace rule."""
    single = F.regexp_replace(kind, "List$", "")

    def leaf(of_kind: Column):
        declared = F.lit(rule.value_type.lower()) if rule.value_type else F.try_element_at(
            F.create_map(*[F.lit(x) for kv in types.items() for x in kv]), F.regexp_replace(of_kind, "List$", "")) if types else F.lit(None).cast("string")
        return lambda old: record(v=_replacement(rule.replacement, F.coalesce(declared, runtime_type(old))), hit=F.lit(True))

    def item(x: Column) -> Column:
        own = touched(x, path, leaf(F.coalesce(F.nullif(_text(x, "$.kind"), F.lit("")), single)))
        return F.when(_in_scope(rule, x, True), own).otherwise(record(v=x, hit=F.lit(False)))

    kept = record(v=v, hit=F.lit(False))
    in_list = touched(v, ["items", ...], item)
    alone = F.when(_in_scope(rule, v, False), touched(v, path, leaf(kind))).otherwise(kept)
    named = F.lit(True) if rule.kind in ("", "*") else (kind == rule.kind) | (single == rule.kind)
    return F.when(named & kind.isNotNull(), F.when(kind.endswith("List"), in_list).otherwise(alone)).otherwise(kept)


def _json_type(value) -> str:
    if isinstance(value, bool):
        return "bool"
    return {str: "string", int: "number", float: "number", list: "array", dict: "object"}.get(type(value), "null")


# Rules with ** go down to any depth, which no expression of a fixed size does: they are applied in Arrow batches.


def replace_at(value, path: list, new) -> tuple[object, int]:
    """(value with ``new(old)`` at every place the path reaches, number of places)."""
    if not path:
        return new(value), 1
    step, rest = path[0], path[1:]
    n = 0
    if step is None:
        value, n = replace_at(value, rest, new)
        targets, rest = (list(value) if isinstance(value, dict) else range(len(value)) if isinstance(value, list) else ()), path
    elif step is ...:
        targets = range(len(value)) if isinstance(value, list) else ()
    elif isinstance(step, int):
        targets = (step,) if isinstance(value, list) and 0 <= step < len(value) else ()
    else:
        targets = (step,) if isinstance(value, dict) and step in value else ()
    for t in targets:
        value[t], hit = replace_at(value[t], rest, new)
        n += hit
    return value, n


def _labels_ok(selector: str, labels: dict) -> bool:
    test = {"=": lambda v, w: v == w[0], "!=": lambda v, w: v != w[0], "in": lambda v, w: v in w,
            "notin": lambda v, w: v not in w, "exists": lambda v, w: v is not None, "absent": lambda v, w: v is None}
    return all(test[op](labels.get(k), vals) for k, op, vals in label_requirements(selector))


def _apply(obj: dict, kind: str, rule: Rule, path: list, types: dict) -> int:
    declared = rule.value_type or types.get(kind.removesuffix("List"))
    return replace_at(obj, path, lambda old: convert(rule.replacement, declared or _json_type(old)))[1]


def _object_in_scope(rule: Rule, obj: dict, strict_namespace: bool) -> bool:
    meta = obj.get("metadata") if isinstance(obj.get("metadata"), dict) else {}
    ns = meta.get("namespace") or ""
    if rule.namespace and ns != rule.namespace and (strict_namespace or ns):
        return False
    labels = meta.get("labels") if isinstance(meta.get("labels"), dict) else {}
    return _labels_ok(rule.label_selector, {k: v for k, v in labels.items() if isinstance(v, str)})


def mask_fields(text: str, rules: list[tuple[Rule, list, dict]]) -> str | None:
    """Masked body, or None when nothing matched. Lists are handled per item, and only there does a missing
    namespace fail a namespace rule."""
    try:
        body = json.loads(text)
    except (ValueError, TypeError):
        return None
    if not isinstance(body, dict):
        return None
    kind = body.get("kind") if isinstance(body.get("kind"), str) else ""
    hits = 0
    for rule, path, types in rules:
        if rule.kind not in ("", "*", kind, kind.removesuffix("List") if kind.endswith("List") else kind):
            continue
        if kind.endswith("List"):
            items = body.get("items")
            for item in items if isinstance(items, list) else ():
                if isinstance(item, dict) and _object_in_scope(rule, item, True):
                    hits += _apply(item, item.get("kind") or kind.removesuffix("List"), rule, path, types)
        elif _object_in_scope(rule, body, False):
            hits += _apply(body, kind, rule, path, types)
    return json.dumps(body, ensure_ascii=False, separators=(",", ":")) if hits else None


def compile_rules(rules: list[Rule]) -> list[tuple[Rule, list, dict]]:
    """(rule, path, declared type per known kind), worked out once on the driver."""
    out = []
    for r in rules:
        if path := tokens(r.field_path):
            out.append((r, path, {k: t for k in FIELD_TYPES if (t := schema_type(k, path))}))
    return out


def _rewritten(compiled: list[tuple[Rule, list, dict]]):
    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: mask_fields(t, compiled))

    return rewrite


def redact_fields(records: DataFrame, rules: list[Rule], body: str = "body") -> DataFrame:
    """Field rules applied to bodies; ``fields_masked`` flags changed rows. Replacements with a type are checked here.

    Bodies of a kind that some rule names become VARIANT once, and text again where a place was hit. Rules with ``**`` take the
    Arrow-batched form, and so do the rules beside them, as each sees what those before it did.
    """
    compiled = compile_rules(rules)
    for r, _, _ in compiled:
        if r.value_type:
            convert(r.replacement, r.value_type)
    kinds = {r.kind for r, _, _ in compiled}
    named = F.get_json_object(body, "$.kind")
    concerned = F.lit(bool(compiled)) if kinds & {"", "*"} or not kinds else named.isin(
        [k for kind in kinds for k in (kind, kind + "List")])
    if any(None in path for _, path, _ in compiled):
        out = records.withColumn("_new", _rewritten(compiled)(F.when(concerned, F.col(body))))
        return out.withColumn("fields_masked", F.col("_new").isNotNull()).withColumn(body, F.coalesce("_new", body)).drop("_new")
    parsed = records.select("*", F.explode(F.array(F.when(concerned, F.try_parse_json(body)))).alias("_v"))
    # generators, so that no step is worked out twice; the kind is the body's before any rule, and null for no object
    kind = F.when(_object(F.col("_v")).isNotNull(), F.coalesce(_text(F.col("_v"), "$.kind"), F.lit("")))
    rows = parsed.select(*records.columns, F.explode(F.array(record(v=F.col("_v"), hit=F.lit(False), kind=kind))).alias("_r"))
    for rule, path, types in compiled:
        step = rule_applied(F.col("_r.v"), F.col("_r.kind"), rule, path, types)
        after = let(step, lambda s: record(v=s["v"], hit=s["hit"] | F.col("_r.hit"), kind=F.col("_r.kind")))
        rows = rows.select(*records.columns, F.explode(F.array(after)).alias("_r"))
    hit = F.col("_r.hit")
    return rows.withColumn("fields_masked", hit).withColumn(body, F.when(hit, F.to_json("_r.v")).otherwise(F.col(body))).drop("_r")


def redact(records: DataFrame, secrets: bool = True, allowed: list[str] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """Secrets first, then field rules; both flags are always present."""
    out = redact_secrets(records, allowed) if secrets else records.withColumn("secrets_masked", F.lit(False))
    return redact_fields(out, rules) if rules else out.withColumn("fields_masked", F.lit(False))


def redaction_stats(redacted: DataFrame) -> DataFrame:
    """Manifest counters per capture."""
    return redacted.groupBy("capture_id").agg(
        F.lit(True).alias("redacted"), F.count_if("secrets_masked").alias("secrets_redacted"),
        F.count_if("fields_masked").alias("fields_redacted"))
