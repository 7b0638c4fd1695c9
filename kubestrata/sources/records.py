"""Record tables: NDJSON in and out, Parquet layout, sequence numbers, manifest, index edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kubestrata.functions.ordered import CHUNK_ROWS, chunk_of, ranked
from kubestrata.functions.paths import view_kind, with_path_cols
from kubestrata.functions.scalars import blank, item_count, rfc3339
from kubestrata.schema import NDJSON_DDL, TABLE_DDL

KEYS = ["capture_id", "path"]


# ------------------------------------------------------------------ NDJSON

def _parse_lines(lines: DataFrame, *keep: str) -> DataFrame:
    rec = F.from_json("value", NDJSON_DDL)
    return lines.select("value", *keep, rec.alias("r")).select(
        "value", *keep,
        F.col("r.id").alias("record_id"),
        F.col("r.api_path").alias("path"),
        rfc3339(F.col("r.captured_at")).alias("captured_at"),
        F.nullif(F.col("r.event_type"), F.lit("")).alias("event_type"),
        F.col("r.http_method").alias("http_method"),
        F.col("r.response_code").alias("response_code"),
        F.when(F.get_json_object("value", "$.response_body").isNotNull(),
               F.to_json(F.variant_get(F.try_parse_json("value"), "$.response_body", "variant"))).alias("body"),
    )


def _usable():
    return F.col("path").isNotNull() & F.col("captured_at").isNotNull()


def read_records(spark: SparkSession, path: str, capture_id: str = "stream") -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of newline-delimited record files; unreadable lines land in quarantine.

    Records of one path and time keep the order of their lines: by file, block, and place in the block.
    """
    place = ["_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")]
    lines = spark.read.text(path).select("value", F.struct(*place).alias("_arrival"))
    parsed = _parse_lines(lines.filter(F.trim("value") != ""), "_arrival")
    good = parsed.filter(_usable()).drop("value").withColumn("capture_id", F.lit(capture_id))
    return with_seq(good, ["captured_at", "_arrival"]).drop("_arrival"), parsed.filter(~_usable()).select("value")


def read_records_stream(
    spark: SparkSession, path: str, capture_id: str = "stream", watermark: str = "10 minutes", **options
) -> DataFrame:
    """Streaming form: ``event_time`` carries the watermark; seq is assigned per micro-batch by the sink."""
    lines = spark.readStream.format("text").options(**options).load(path)
    return (
        _parse_lines(lines.filter(F.trim("value") != "")).filter(_usable()).drop("value")
        .withColumn("capture_id", F.lit(capture_id))
        .withColumn("event_time", F.col("captured_at").cast("timestamp"))
        .withWatermark("event_time", watermark)
    )


def write_ndjson(records: DataFrame, path: str) -> None:
    """Records back to newline JSON; the body is embedded as JSON, not as a quoted string."""
    head = F.to_json(F.struct(
        F.concat_ws("#", "path", "seq").alias("id"),
        F.concat(F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("captured_at"),
        F.col("path").alias("api_path"),
        "event_type", "http_method", "response_code",
    ))
    line = F.concat(F.regexp_replace(head, "\\}$", ""), F.lit(',"response_body":'),
                    F.coalesce("body", F.lit("null")), F.lit("}"))
    records.select(line.alias("value")).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- sequence

def with_seq(records: DataFrame, order: list[str] | None = None) -> DataFrame:
    """0-based dense seq per path in arrival order, shared by snapshots and events."""
    out = ranked(records, KEYS, order or ["captured_at", "record_id"], "seq")
    return out.withColumn("seq", F.col("seq") - 1)


def enrich(records: DataFrame) -> DataFrame:
    """Envelope columns extracted once, so index-only queries never read ``body``."""
    return with_path_cols(records).select(
        "*", view_kind("path").alias("view_kind"),
        item_count("body").alias("item_count"), F.octet_length("body").cast("bigint").alias("body_bytes"),
        F.sha2("body", 256).alias("body_hash"),
    )


# ------------------------------------------------------------------ layout

def write_tables(records: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet, partitioned by capture and resource, clustered by path and seq inside.

    Rows are range-partitioned on (capture, resource, path, seq): a hot path is cut into several files with
    disjoint seq ranges instead of one task writing it whole.
    """
    sort = ["capture_id", "resource", "path", "seq"]
    enriched = records if "resource" in records.columns else enrich(records)
    spread = enriched.repartitionByRange(*([partitions] if partitions else []), *sort)
    spread.sortWithinPartitions(*sort).write.mode("overwrite").partitionBy("capture_id", "resource").parquet(path)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Partition columns come back as strings even when the values look like numbers."""
    df = spark.read.parquet(path)
    return df.withColumn("capture_id", F.col("capture_id").cast("string")).withColumn(
        "resource", blank(F.nullif(F.col("resource").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))))


# ---------------------------------------------------------------- manifest

def manifest(records: DataFrame) -> DataFrame:
    """One row per capture, in one pass with a map-side combine."""
    return records.groupBy("capture_id").agg(
        F.min("captured_at").alias("captured_at"),
        F.max("captured_at").alias("captured_until"),
        F.count("*").alias("record_count"),
        F.bool_or(F.col("event_type").isNotNull()).alias("watch_enabled"),
        F.sum(F.octet_length("body")).cast("bigint").alias("uncompressed_bytes"),
        F.count_if(F.col("event_type").isNotNull()).alias("watch_events"),
    )


def with_config_facts(manifests: DataFrame, targets: DataFrame, deduplicated: DataFrame | None = None) -> DataFrame:
    """Adds what only the capture configuration knows: distinct intervals, and rows dropped as duplicates."""
    intervals = targets.filter(F.col("interval") != "").groupBy("capture_id").agg(
        F.array_sort(F.collect_set("interval")).alias("intervals"),
        F.bool_or("watch").alias("watch_configured"),
    )
    out = manifests.join(intervals, "capture_id", "left")
    if deduplicated is not None:
        out = out.join(deduplicated, "capture_id", "left").fillna({"deduplicated_count": 0})
    return out


# ------------------------------------------------------------------- index

def build_index(records: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Export form of the index: parallel arrays per path, cut every ``rows`` sequence numbers.

    A path with fewer records gives one row; a hot path gives several, so no array outgrows a chunk.
    """
    entry = F.struct("seq", "captured_at", "event_type", "item_count")
    grouped = records.groupBy(*KEYS, F.col("event_type").isNotNull().alias("is_watch"), chunk_of("seq", rows).alias("part")).agg(
        F.array_sort(F.collect_list(entry)).alias("e")
    )
    return grouped.select(
        *KEYS, "is_watch", "part",
        F.transform("e", lambda x: x["seq"]).alias("seqs"),
        F.transform("e", lambda x: x["captured_at"]).alias("times"),
        F.when(~F.col("is_watch"), F.transform("e", lambda x: x["item_count"])).alias("counts"),
        F.when(F.col("is_watch"), F.transform("e", lambda x: x["event_type"])).alias("event_types"),
    )


_ENTRY = "struct<api_path: string, seqs: array<bigint>, times: array<string>, counts: array<int>, event_types: array<string>>"


def explode_index(df: DataFrame, json_col: str, watch: bool = False) -> DataFrame:
    """One row per indexed record from index JSON, wrapped ({"entries": ..}) or bare.

    A short or absent counts array leaves item_count null (unknown), not 0. Watch rows stop at the shortest
    of the three arrays.
    """
    wrapped = F.from_json(F.get_json_object(json_col, "$.entries"), f"map<string,{_ENTRY}>")
    bare = F.from_json(F.col(json_col), f"map<string,{_ENTRY}>")
    keep = [c for c in df.columns if c != json_col]
    entries = df.select(*keep, F.explode(F.coalesce(wrapped, bare)).alias("path", "e"))
    rows = entries.select(*keep, "path", "e", F.posexplode("e.seqs").alias("i", "seq"))
    at = lambda name: F.get(F.col(f"e.{name}"), F.col("i"))
    out = rows.select(
        *keep, "path", "seq", rfc3339(at("times")).alias("captured_at"),
        at("counts").alias("item_count"), at("event_types").alias("event_type"),
        F.get(F.col("e.times"), F.col("i")).isNotNull().alias("_timed"),
    )
    if watch:
        out = out.filter(F.col("_timed") & F.col("event_type").isNotNull())
    return out.drop("_timed")


def check_index_json(df: DataFrame, json_col: str, watch: bool = False) -> DataFrame:
    """Structural problems of index JSON: (…, issue, path)."""
    keep = [c for c in df.columns if c != json_col]
    obj = F.from_json(F.col(json_col), "map<string,string>")
    keys = F.map_keys(obj)
    has_entries = F.array_contains(keys, "entries")
    stray = F.filter(keys, lambda k: (k != "entries") & k.startswith("/"))
    top = df.select(
        *keep,
        F.when(F.try_parse_json(json_col).isNull(), "unparsable index")
        .when(F.trim(json_col) == "null", "index is null")
        .when(obj.isNull(), "index is not an object")
        .when(has_entries & (F.size(stray) > 0), "mixed wrapped and bare keys").alias("issue"),
        F.when(has_entries, F.get(stray, F.lit(0))).alias("path"),
    ).filter("issue IS NOT NULL")
    raw = F.coalesce(F.from_json(F.get_json_object(json_col, "$.entries"), "map<string,string>"), obj)
    e = F.from_json("entry", _ENTRY)
    uneven = F.size(e["times"]) != F.size(e["seqs"])
    if watch:
        uneven = uneven | (F.size(e["event_types"]) != F.size(e["seqs"]))
    per_path = df.select(*keep, F.explode(raw).alias("path", "entry")).select(
        *keep,
        F.when(F.col("entry").isNull() | (F.col("entry") == "null"), "null index entry")
        .when(uneven, "parallel arrays of unequal length").alias("issue"),
        "path",
    ).filter("issue IS NOT NULL AND path <> 'entries'")
    return top.unionByName(per_path)


def check_capture(records: DataFrame, index_rows: DataFrame, captures: DataFrame | None = None,
                  newest: int = 2) -> DataFrame:
    """Flagged problems: (capture_id, issue, path, seq)."""
    missing = index_rows.join(records.select(*KEYS, "seq"), [*KEYS, "seq"], "left_anti").select(
        "capture_id", F.lit("indexed record is missing").alias("issue"), "path", "seq")
    if captures is None:
        return missing
    version = F.coalesce("format_version", F.lit(0))
    bad = captures.select(
        "capture_id",
        F.when(version < 0, "format version is negative").when(version > newest, "format version is too new").alias("issue"),
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("seq"),
    ).filter("issue IS NOT NULL")
    return missing.unionByName(bad)


def table_schema_rows(records: DataFrame) -> DataFrame:
    """Table responses reduced to their column definitions (rows emptied); other bodies are skipped."""
    t = F.from_json("body", TABLE_DDL)
    keep = (t["kind"] == "Table") & (blank(t["columnDefinitions"]) != "")
    body = F.to_json(F.struct(
        F.coalesce(F.nullif(t["apiVersion"], F.lit("")), F.lit("meta.k8s.io/v1")).alias("apiVersion"),
        F.lit("Table").alias("kind"),
        F.struct(F.lit("0").alias("resourceVersion")).alias("metadata"),
        F.try_parse_json(t["columnDefinitions"]).alias("columnDefinitions"),
        F.array().cast("array<string>").alias("rows"),
    ))
    return records.filter(F.coalesce(keep, F.lit(False))).withColumn("body", body)
