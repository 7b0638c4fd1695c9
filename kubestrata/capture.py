"""One handle over the tables of many captures."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kubestrata.functions.paths import list_path
from kubestrata.functions.scalars import resolve_at
from kubestrata.operators import change, dash, graph, health, overlay, redact, search, select, shape, timetravel, views
from kubestrata.operators.textindex import TextIndex
from kubestrata.sources import records as rec


class Capture:
    """Records (capture_id, path, seq, captured_at, event_type, http_method, response_code, body) and, optionally,
    the captures table; the derived tables are lazy DataFrames."""

    def __init__(self, records: DataFrame, captures: DataFrame | None = None, changes: DataFrame | None = None):
        self.records = records
        self.captures = captures
        self.changes = changes

    @classmethod
    def read(cls, spark: SparkSession, tables: str, captures: DataFrame | None = None) -> Capture:
        return cls(rec.read_tables(spark, tables), captures)

    @cached_property
    def index(self) -> DataFrame:
        """Records without bodies; item_count and friends are stored columns when read from tables."""
        have = self.records if "item_count" in self.records.columns else rec.enrich(self.records)
        return have.drop("body")

    @cached_property
    def events(self) -> DataFrame:
        return timetravel.event_objects(self.records.select(*change.KEYS, "seq", "captured_at", "event_type", "body"))

    @cached_property
    def catalog(self) -> DataFrame:
        return shape.api_catalog(self.records)

    def _at(self, at):
        """Relative bounds resolve against the capture's window; with several captures there is no one window."""
        if not isinstance(at, str) or self.captures is None:
            return at
        rows = self.captures.select("captured_at", "captured_until").head(2)
        if len(rows) == 1:
            return resolve_at(at, rows[0]["captured_at"], rows[0]["captured_until"])
        if at[:4].isdigit():
            return at
        raise ValueError("a relative time needs a handle with one capture; give an absolute one")

    def state(self, at=None, resources: list[str] | None = None) -> DataFrame:
        """Objects alive at an instant, overlay changes applied when the handle has some.

        ``resources`` narrows the scan to some plural names before anything is reconstructed.
        """
        objects = timetravel.reconstruct_at(self.records, self._at(at), resources)
        if self.changes is None:
            return objects
        changes = self.changes if resources is None else self.changes.filter(F.col("resource").isin(resources))
        merged = overlay.merge_overlay(objects, overlay.compact(changes))
        # identity is read again: a replaced object may carry other labels, an added one has no path yet
        path = F.coalesce("path", list_path("group", "version", "resource", "obj_namespace"))
        rows = merged.select("capture_id", path.alias("path"), "group", "version", "resource",
                             F.coalesce("namespace", "obj_namespace").alias("namespace"), "position", "obj", "from_overlay")
        return timetravel.with_identity(rows)

    def _searched(self, at, resource: str | None) -> DataFrame:
        """Objects of lists and bodies that are one object themselves."""
        only = [resource] if resource else None
        single = timetravel.single_objects(self.records, self._at(at), only)
        return self.state(at, only).unionByName(single, allowMissingColumns=True)

    def list(self, group, version, resource, namespace="", name=None, at=None, labels="", fields="") -> DataFrame:
        rows = timetravel.list_objects(self.state(at, [resource]), group, version, resource, namespace, name)
        return select.filter_fields(select.filter_labels(rows, labels), group, resource, fields)

    def view(self, group, version, resource, namespace="", at=None, wide=False) -> DataFrame:
        crds = self.state(at, ["customresourcedefinitions"]) if group else None
        return views.view(self.list(group, version, resource, namespace, at=at), group, version, resource, self._at(at), wide, crds, self.records)

    def query(self, expression: str, at=None, resource=None, namespace=None) -> DataFrame:
        return search.query(self._searched(at, resource), expression, resource, namespace)

    def search_text(self, pattern: str, regex=False, at=None, resource=None, namespace=None, index=None) -> DataFrame:
        return search.search_text(self._searched(at, resource), pattern, regex, resource, namespace, index)

    def index_text(self, path: str) -> TextIndex:
        """Add every body of this capture, of all times, to the text index below ``path``."""
        items = timetravel.explode_items(timetravel.in_scope(self.records).filter("event_type IS NULL")).select("obj")
        single = self.records.filter("event_type IS NULL").select(F.col("body").alias("obj"))
        events = self.records.filter("event_type IS NOT NULL").select(F.col("body").alias("obj"))
        return TextIndex(self.records.sparkSession, path).add(items.unionByName(single).unionByName(events))

    def search_logs(self, pattern: str, regex=False, at=None, resource=None, namespace=None) -> DataFrame:
        return search.search_logs(search.log_lines(self.records, self._at(at)), pattern, regex, resource, namespace)

    def transitions(self, **filters) -> DataFrame:
        return change.transition_report(self.records, self.events, **filters)

    def diff(self, t1, t2, resource=None, namespace=None) -> DataFrame:
        return change.diff_times(self.records, self._at(t1), self._at(t2), resource, namespace)

    def diff_with(self, other: Capture, resource=None, namespace=None) -> DataFrame:
        return change.diff_captures(self.records, other.records, resource, namespace)

    def diagnose(self, at=None, min_severity="info", category=None) -> DataFrame:
        return health.worst_first(health.diagnose(self.state(at, health.DIAGNOSED), self.index, self.captures, min_severity, category))

    def inspect(self) -> DataFrame:
        return dash.inspect(self.records, self.catalog)

    def redact(self, **options) -> Capture:
        return Capture(redact.redact(self.records, **options), self.captures, self.changes)

    def relationships(self, path: str, name: str, at=None) -> DataFrame:
        return graph.relationships(self.state(at), path, name)
