"""Selection and projection of object rows and Table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kubestrata.functions.paths import kind_of
from kubestrata.functions.scalars import first_non_empty
from kubestrata.functions.selectors import (
    fields_match, label_requirements, labels_match, labels_match_strict, needs_full_object,
)
from kubestrata.operators.timetravel import with_identity
from kubestrata.schema import TABLE_DDL


def _kept(cond: Column) -> Column:
    """Objects that cannot be decoded are kept, not hidden."""
    return ~F.col("decodable") | cond


def filter_labels(objects: DataFrame, selector: str) -> DataFrame:
    return objects if not label_requirements(selector) else objects.filter(_kept(labels_match("labels", selector)))


def filter_fields(objects: DataFrame, group: str, resource: str, selector: str) -> DataFrame:
    return objects if not selector else objects.filter(_kept(fields_match("obj", group, resource, selector)))


def filter_strict(objects: DataFrame, group: str, resource: str, labels: str = "", fields: str = "") -> DataFrame:
    """Bulk-delete selection: malformed or vacuous selectors raise instead of matching everything."""
    if labels:
        objects = objects.filter(_kept(labels_match_strict("labels", labels)))
    if fields:
        if not fields.strip(", "):
            raise ValueError(f"invalid fieldSelector {fields!r}: does not restrict the selection")
        objects = filter_fields(objects, group, resource, fields)
    return objects


def table_rows(tables: DataFrame) -> DataFrame:
    """Table bodies -> one row per Table row, with the identity of its embedded object."""
    keep = [c for c in tables.columns if c != "body"]
    t = tables.select(*keep, F.from_json("body", TABLE_DDL).alias("_t"))
    rows = t.select(*keep, F.col("_t.columnDefinitions").alias("column_definitions"),
                    F.posexplode("_t.rows").alias("pos", "row"))
    return with_identity(rows.withColumn("obj", F.get_json_object("row", "$.object")))


def filter_table_rows(rows: DataFrame, labels: str = "", fields: str = "", group: str = "", resource: str = "") -> DataFrame:
    """Labels and metadata fields on the embedded object; undecodable rows stay."""
    return filter_fields(filter_labels(rows, labels), group, resource, fields)


def filter_rows_by_identity(rows: DataFrame, survivors: DataFrame, full_list: DataFrame | None = None) -> DataFrame:
    """Table rows whose (namespace, name) survived a field selector on the full list.

    Where the full list of a path has an object whose identity is unreadable the filter is refused and that
    path's rows pass unchanged (pass ``full_list`` to have this checked).
    """
    keys = ["capture_id", "path", "obj_namespace", "name"]
    allowed = survivors.select(*keys).distinct()
    if full_list is None:
        return rows.join(allowed, keys, "left_semi")
    refused = full_list.groupBy("capture_id", "path").agg(F.bool_and("decodable").alias("_ok")).filter("NOT _ok")
    on = ["capture_id", "path"]
    return rows.join(refused, on, "left_anti").join(allowed, keys, "left_semi").unionByName(
        rows.join(refused, on, "left_semi"))


def select_table_rows(rows: DataFrame, objects: DataFrame, group: str, resource: str, labels: str = "",
                      fields: str = "") -> DataFrame:
    """Table rows under any selector: by identity of the full objects when spec or status is read."""
    if needs_full_object(group, resource, fields):
        kept = filter_fields(filter_labels(objects, labels), group, resource, fields)
        return filter_rows_by_identity(rows, kept, objects)
    return filter_table_rows(rows, labels, fields, group, resource)


def in_namespace(objects: DataFrame, namespace: str) -> DataFrame:
    return objects.filter(_kept(F.col("obj_namespace") == namespace))


def project_metadata(objects: DataFrame) -> DataFrame:
    """Objects as {apiVersion, kind, metadata}; a list with one item lacking metadata is refused as a whole."""
    meta = F.get_json_object("obj", "$.metadata")
    refused = objects.filter(meta.isNull()).select("capture_id", "path").distinct()
    partial = F.to_json(F.struct(
        F.lit("meta.k8s.io/v1").alias("apiVersion"), F.lit("PartialObjectMetadata").alias("kind"),
        F.try_parse_json(meta).alias("metadata"),
    ))
    return objects.join(refused, ["capture_id", "path"], "left_anti").withColumn("obj", partial)


def put_fields(obj, fields: dict[str, Column]) -> Column:
    """The JSON object with top-level fields set (a null VARIANT removes the field)."""
    obj = F.col(obj) if isinstance(obj, str) else obj
    old = F.map_filter(F.from_json(obj, "map<string,variant>"), lambda k, _v: ~k.isin(list(fields)))
    new = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    return F.to_json(F.map_concat(old, F.map_filter(new, lambda _k, v: v.isNotNull())))


def _variant_text(col) -> Column:
    """A string column as a VARIANT string."""
    return F.variant_get(F.try_parse_json(F.to_json(F.struct(col.alias("v")))), "$.v", "variant")


def stamp_type(objects: DataFrame, api_version: str = "list_api_version", kind: str = "list_kind") -> DataFrame:
    """Missing apiVersion/kind restored from the list envelope (PodList -> Pod), else from the path.

    Present values are never overwritten; lists and Tables are left alone.
    """
    cols = objects.columns
    av_hint = F.col(api_version) if api_version in cols else F.lit("")
    kind_hint = F.regexp_replace(F.col(kind), "List$", "") if kind in cols else F.lit("")
    from_path = F.when(F.col("group") == "", F.col("version")).otherwise(F.concat_ws("/", "group", "version"))
    have_av, have_kind = F.get_json_object("obj", "$.apiVersion"), F.get_json_object("obj", "$.kind")
    untouched = (F.get_json_object("obj", "$.items").isNotNull() | have_kind.endswith("Table")
                 | ((F.coalesce(have_av, F.lit("")) != "") & (F.coalesce(have_kind, F.lit("")) != "")))
    stamped = put_fields("obj", {
        "apiVersion": _variant_text(first_non_empty(have_av, av_hint, from_path)),
        "kind": _variant_text(first_non_empty(have_kind, kind_hint, kind_of("resource"))),
    })
    return objects.withColumn("obj", F.when(F.coalesce(untouched, F.lit(False)), F.col("obj")).otherwise(
        F.coalesce(stamped, F.col("obj"))))


def get_object(objects: DataFrame, name: str, namespace: str | None = None) -> DataFrame:
    """One object out of a list, stamped with the list's type."""
    picked = objects.filter(F.col("name") == name)
    return stamp_type(picked if namespace is None else picked.filter(F.col("obj_namespace") == namespace))


def get_table_row(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("name") == name)
