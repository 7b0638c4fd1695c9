"""Label and field selectors turned into boolean Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kubestrata.functions.scalars import let
from kubestrata.schema import FIELD_LABELS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ labels

_SET = re.compile(r"^(?P<key>.*?)\s(?P<op>notin|in)\s(?P<vals>.*)$", re.S)


def label_requirements(selector: str) -> list[tuple[str, str, list[str]]]:
    """(key, op, values) per comma-separated requirement; commas inside parentheses do not split."""
    reqs = []
    for seg in re.split(r",(?![^(]*\))", selector or ""):
        seg = seg.strip()
        if not seg:
            continue
        if m := _SET.match(seg):
            vals = m["vals"].strip().removeprefix("(").removesuffix(")")
            reqs.append((m["key"].strip(), m["op"], [v.strip() for v in vals.split(",")]))
        elif "!=" in seg:
            k, v = seg.split("!=", 1)
            reqs.append((k.strip(), "!=", [v.strip()]))
        elif "=" in seg:
            k, v = re.split("==?", seg, maxsplit=1)
            reqs.append((k.strip(), "=", [v.strip()]))
        elif seg.startswith("!"):
            reqs.append((seg[1:].strip(), "absent", []))
        else:
            reqs.append((seg, "exists", []))
    return reqs


def labels_match(labels, selector: str) -> Column:
    """AND of all requirements over a map<string,string>; != and notin also match a missing key."""
    labels = _c(labels)
    cond = F.lit(True)
    for key, op, vals in label_requirements(selector):
        v = F.try_element_at(labels, F.lit(key))
        test = {
            "=": lambda: v.eqNullSafe(F.lit(vals[0])),
            "!=": lambda: ~v.eqNullSafe(F.lit(vals[0])),
            "in": lambda: F.coalesce(v.isin(vals), F.lit(False)),
            "notin": lambda: ~F.coalesce(v.isin(vals), F.lit(False)),
            "exists": lambda: v.isNotNull(),
            "absent": lambda: v.isNull(),
        }[op]()
        cond = cond & test
    return cond


_NAME = r"[A-Za-z0-9](?:[-A-Za-z0-9_.]*[A-Za-z0-9])?"
_KEY = rf"(?:{_NAME}/)?{_NAME}"
_VALUE = rf"(?:{_NAME})?"
_STRICT = re.compile(
    rf"^(?:!\s*{_KEY}|{_KEY}|{_KEY}\s*(?:==|=|!=)\s*{_VALUE}|{_KEY}\s*[<>]\s*-?\d+"
    rf"|{_KEY}\s+(?:in|notin)\s*\(\s*{_VALUE}(?:\s*,\s*{_VALUE})*\s*\))$"
)


def labels_match_strict(labels, selector: str) -> Column:
    """As labels_match, but malformed or vacuous selectors are errors; also knows numeric < and >."""
    labels = _c(labels)
    segs = [s.strip() for s in re.split(r",(?![^(]*\))", selector)]
    bad = [s for s in segs if not _STRICT.match(s)]
    if bad or not segs:
        raise ValueError(f"invalid labelSelector {selector!r}: {bad[0] if bad else 'does not restrict the selection'!r}")
    cond = F.lit(True)
    for seg in segs:
        if m := re.match(rf"^({_KEY})\s*([<>])\s*(-?\d+)$", seg):
            v = F.try_element_at(labels, F.lit(m[1])).try_cast("bigint")
            cond = cond & F.coalesce(v > int(m[3]) if m[2] == ">" else v < int(m[3]), F.lit(False))
        else:
            cond = cond & labels_match(labels, re.sub(r"\b(in|notin)\(", r"\1 (", seg))
    return cond


# ------------------------------------------------------------------ fields

def _rules(group: str, resource: str) -> tuple[dict[str, str], dict[str, tuple], str]:
    """(accepted label -> canonical label, canonical label -> value spec, rejection style)."""
    spec = FIELD_LABELS.get((group, resource))
    if spec is None:
        plain = ["metadata.name", "metadata.namespace"]
        return {p: p for p in plain}, {p: (p, "") for p in plain}, "metadata"
    own = ["metadata.name"] + (["metadata.namespace"] if spec.get("namespaced") else [])
    accepted = {p: p for p in own + spec["accepted"]} | spec.get("aliases", {})
    values = {p: (p, "") for p in accepted.values() if p not in spec.get("unreadable", [])}
    return accepted, values | spec.get("values", {}), resource


def _split_terms(selector: str) -> list[str]:
    """Split on unescaped commas (backslash escapes comma, equals and backslash in values)."""
    return [t for t in re.split(r"(?<!\\),", selector) if t != ""]


def field_requirements(group: str, resource: str, selector: str) -> list[tuple[str, str, str]]:
    accepted, _, style = _rules(group, resource)
    out = []
    for term in _split_terms(selector or ""):
        m = re.match(r"^(.*?)(!=|==|=)(.*)$", term, re.S)
        if not m:
            raise ValueError(f"invalid fieldSelector: {selector!r}: can't understand {term!r}")
        label, op, value = m[1], m[2], re.sub(r"\\([\\,=])", r"\1", m[3])
        if label not in accepted:
            raise ValueError({
                "metadata": f'"{label}" is not a known field selector: only "metadata.name", "metadata.namespace"',
                "jobs": f'field label "{label}" not supported for Job',
            }.get(style, f"field label not supported: {label}"))
        out.append((accepted[label], "!=" if op == "!=" else "=", value))
    return out


def _paths_ddl(paths: set[str]) -> str:
    """DDL that reads exactly these dotted paths as text: a.b, a.c -> `a` STRUCT<`b`: STRING, `c`: STRING>."""
    tree: dict = {}
    for path in paths:
        node = tree
        for step in path.split("."):
            node = node.setdefault(step, {})

    def fields(node: dict, sep: str) -> str:
        return ", ".join(f"`{k}`{sep}" + (f"STRUCT<{fields(v, ': ')}>" if v else "STRING") for k, v in sorted(node.items()))

    return fields(tree, " ")


def _field_text(obj: Column, path: str, default: str) -> Column:
    raw = obj
    for step in path.split("."):
        raw = raw[step]
    integral = F.regexp_replace(raw, "^(-?[0-9]+)\\.0+$", "$1")
    return F.coalesce(F.when(raw.rlike("^[\\[{]"), "").otherwise(integral), F.lit(default))


def fields_match(obj, group: str, resource: str, selector: str) -> Column:
    """AND of ``label=value`` / ``label!=value`` over the object's JSON text, which is decoded once.

    Unaccepted labels raise; accepted labels that have no readable path compare as ''.
    """
    obj = _c(obj)
    _, values, _ = _rules(group, resource)
    terms = [(values.get(label), op, want) for label, op, want in field_requirements(group, resource, selector)]
    paths = {p for spec, _, _ in terms if spec for p in (spec[0], *spec[2:])}

    def matches(o: Column) -> Column:
        cond = F.lit(True)
        for spec, op, want in terms:
            got = F.lit("")
            if spec is not None:
                got = _field_text(o, spec[0], spec[1])
                if len(spec) == 3:
                    got = F.coalesce(F.nullif(got, F.lit("")), _field_text(o, spec[2], ""))
            cond = cond & ((got == want) if op == "=" else (got != want))
        return cond

    return let(F.from_json(obj, _paths_ddl(paths)), matches) if paths else matches(obj)


def needs_full_object(group: str, resource: str, selector: str) -> bool:
    """True when a term reads anything but metadata.name / metadata.namespace (Table rows lack the rest)."""
    plain = {"metadata.name", "metadata.namespace"}
    return any(label not in plain for label, _, _ in field_requirements(group, resource, selector))
