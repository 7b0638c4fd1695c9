"""kubectl-style JSONPath as Column expressions over VARIANT.

An expression is applied to a set (ARRAY<VARIANT>) step by step: keys, [n], [*], .*, slices [a:b:c], unions
[a,b] / ['k','l'] and filters [?(@.x == v)] stay in the JVM. Only recursive descent (..) has no native form
and runs as an Arrow-batched helper. Anything else raises, so a query never returns part of its rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(
    r"""(?P<deep>\.\.(?P<deep_key>[A-Za-z0-9_\-]+|\*)?)
      | \.(?P<star>\*)
      | \.?(?P<key>(?:\\.|[^.\[\]\\{}()?@$'"\s,:*])+)
      | \[(?P<brk>(?:[^\[\]'"]|'(?:\\.|[^'])*'|"(?:\\.|[^"])*"|\[[^\]]*\])*)\]
      | \.(?=\[)
    """,
    re.X,
)
_FILTER = re.compile(r"^\?\(\s*(?P<left>.+?)\s*(?:(?P<op>==|!=|<=|>=|<|>)\s*(?P<right>.+?)\s*)?\)$", re.S)


def _get(v: Column, key: str) -> Column:
    path = "$[" + json.dumps(key, ensure_ascii=False) + "]"
    return F.variant_get(v, path, "variant")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _none() -> Column:
    return F.from_json(F.lit("[]"), "array<variant>")


def _present(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _each(cur: Column, fn) -> Column:
    return F.flatten(F.transform(cur, lambda v: F.coalesce(fn(v), _none())))


def _children(v: Column) -> Column:
    return F.coalesce(_array(v), F.map_values(_map(v)))


def _member(cur: Column, key: str) -> Column:
    return _present(F.transform(cur, lambda v: _get(v, key)))


def _slice(v: Column, lo, hi, step: int) -> Column:
    arr = _array(v)
    n = F.size(arr)
    clamp = lambda x: F.greatest(F.lit(0), F.least(n, F.lit(x) if x >= 0 else n + x))
    start, stop = clamp(lo if lo is not None else 0), clamp(hi) if hi is not None else n
    part = F.slice(arr, start + 1, F.greatest(stop - start, F.lit(0)))
    if step == 1:
        return part
    return F.filter(part, lambda _x, i: i % step == 0)


def _literal(text: str):
    if text[0] in "'\"" and text[-1] == text[0]:
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    if text in ("true", "false"):
        return text == "true"
    return float(text) if re.search(r"[.eE]", text) else int(text)


def _operand(v: Column, text: str, like) -> Column:
    if not text.startswith("@"):
        return F.lit(_literal(text))
    kind = {bool: "boolean", str: "string"}.get(type(like), "double")
    return F.try_variant_get(F.get(_steps(F.array(v), text[1:]), F.lit(0)), "$", kind)


def _test(v: Column, body: str) -> Column:
    m = _FILTER.match(body)
    if not m:
        raise ValueError(f"unsupported JSONPath filter [{body}]")
    left, op, right = m["left"], m["op"], m["right"]
    if op is None:
        return F.size(_steps(F.array(v), left[1:])) > 0
    like = _literal(right) if not right.startswith("@") else (_literal(left) if not left.startswith("@") else "")
    a, b = _operand(v, left, like), _operand(v, right, like)
    got = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return F.coalesce(got, F.lit(False))


def _bracket(cur: Column, body: str) -> Column:
    body = body.strip()
    if body == "*":
        return _each(cur, _children)
    if body.startswith("?"):
        return _each(cur, lambda v: F.filter(_children(v), lambda x: _test(x, body)))
    parts = re.findall(r"""\s*('(?:\\.|[^'])*'|"(?:\\.|[^"])*"|[^,]+)\s*(?:,|$)""", body)
    if not parts:
        raise ValueError(f"unsupported JSONPath step [{body}]")

    def pick(v: Column) -> Column:
        out = []
        for p in (p.strip() for p in parts):
            if p[0] in "'\"":
                out.append(_present(F.array(_get(v, _literal(p)))))
            elif re.fullmatch(r"-?\d+", p):
                i = int(p)
                arr = _array(v)
                out.append(_present(F.array(F.get(arr, F.lit(i) if i >= 0 else F.size(arr) + i))))
            elif m := re.fullmatch(r"(-?\d+)?:(-?\d+)?(?::(\d+))?", p):
                lo, hi, step = (int(x) if x else None for x in m.groups())
                out.append(_slice(v, lo, hi, step or 1))
            else:
                raise ValueError(f"unsupported JSONPath step [{body}]")
        return F.concat(*out) if len(out) > 1 else out[0]

    return _each(cur, pick)


def _find_deep(value, key: str | None) -> list:
    """All nodes below (and including) value, in document order; only children under ``key`` when given."""
    found = [] if key is not None else [value]
    children = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    if key == "*":
        found.extend(c for _, c in children)
    elif isinstance(value, dict) and key in value:
        found.append(value[key])
    for _, child in children:
        found.extend(_find_deep(child, key))
    return found


def _descend(key: str | None):
    @F.pandas_udf("array<string>")
    def descend(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(
                lambda t: [json.dumps(x, ensure_ascii=False) for v in json.loads(t) for x in _find_deep(v, key)]
            )

    return descend


def _steps(cur: Column, expr: str) -> Column:
    pos = 0
    while pos < len(expr):
        m = _STEP.match(expr, pos)
        if not m or m.end() == pos:
            raise ValueError(f"unsupported JSONPath at {expr[pos:]!r}")
        pos = m.end()
        if m["deep"]:
            cur = F.transform(_descend(m["deep_key"])(F.to_json(cur)), F.parse_json)
        elif m["star"]:
            cur = _each(cur, _children)
        elif m["key"]:
            key = re.sub(r"\\(.)", r"\1", m["key"])
            cur = _member(cur, key)
        elif m["brk"] is not None:
            cur = _bracket(cur, m["brk"])
    return cur


def blocks(template: str) -> list[str]:
    """The expressions of a template; a bare expression without braces counts as one."""
    template = template.strip()
    if not template:
        raise ValueError("empty JSONPath expression")
    if "{" not in template:
        return [template]
    if re.search(r"\{\s*(range|end)\b", template):
        raise ValueError("range/end is a formatting construct and is not supported")
    found = re.findall(r"\{([^{}]*)\}", template)
    if re.sub(r"\{[^{}]*\}", "", template).strip():
        raise ValueError("literal text around {...} is not supported")
    return found


def evaluate(obj, template: str) -> Column:
    """ARRAY<VARIANT> of results for one object's JSON text; missing keys give nothing, nulls stay."""
    obj = F.col(obj) if isinstance(obj, str) else obj
    out = []
    for b in blocks(template):
        expr = b.strip()
        if expr.startswith(("$", "@")):
            expr = expr[1:]
        if expr and expr[0] not in ".[":
            expr = "." + expr
        if expr == ".":
            expr = ""
        out.append(_steps(_present(F.array(F.try_parse_json(obj))), expr))
    return F.concat(*out) if len(out) > 1 else out[0]


def as_text(results) -> Column:
    """Results as printed in a table cell: strings bare, everything else JSON, joined by one space."""
    shown = F.transform(results, lambda v: F.when(
        F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)))
    return F.array_join(shown, " ")
