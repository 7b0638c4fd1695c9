"""Landing job for capture archives: many ZIP files with zstd JSON entries -> record tables.

The glob must be readable as a path from every executor (a shared mount). Spark lists the files, one task per slice of one archive's entries reads and inflates it, and the rows go
straight to Parquet. Nothing of an archive passes through the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kubestrata.functions.scalars import rfc3339
from kubestrata.schema import CURRENT_FORMAT_VERSION
from kubestrata.sources.records import explode_index

# Fixed values of the archive layout: <root>/metadata.json, <root>/index.json.zst, <root>/watch-index.json.zst
# and <root>/records/<16 hex of sha256(path)>/<seq>.json.zst, one inflated entry at most 512 MiB.
MAX_ENTRY_BYTES = 512 << 20
METADATA_ENTRY = "^[^/]+/metadata\\.json$"
INDEX_ENTRY = "^[^/]+/index\\.json\\.zst$"
WATCH_INDEX_ENTRY = "^[^/]+/watch-index\\.json\\.zst$"
RECORD_ENTRY = "^[^/]+/records/[0-9a-f]+/([0-9]+)\\.json\\.zst$"

SLICE_BYTES = 32 << 20  # compressed bytes of entries that one task unit reads
SLICE_ENTRIES = 20_000  # and their number
BATCH_CHARS = 8 << 20  # characters that a reader hands over at once, the last entry's beyond it


def _inflate(archive: zipfile.ZipFile, name: str) -> str:
    import zstandard

    if archive.getinfo(name).file_size > MAX_ENTRY_BYTES:
        raise ValueError(f"entry expands beyond {MAX_ENTRY_BYTES} bytes")
    raw = archive.read(name)
    if not name.endswith(".zst"):
        return raw.decode()
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)) as stream:
        data = stream.read(MAX_ENTRY_BYTES + 1)
    if len(data) > MAX_ENTRY_BYTES:
        raise ValueError(f"entry expands beyond {MAX_ENTRY_BYTES} bytes")
    return data.decode()


def _problem(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:300]


def _cut(sizes: list[tuple[str, int]], most: int) -> Iterator[list[str]]:
    """Names in runs of at most ``most`` bytes and ``SLICE_ENTRIES`` names; a larger entry is a run of its own."""
    run, total = [], 0
    for name, size in sizes:
        if run and (total + size > most or len(run) == SLICE_ENTRIES):
            yield run
            run, total = [], 0
        run.append(name)
        total += size
    if run:
        yield run


def _entry_slices(slices: int, slice_bytes: int, wanted: str | None):
    """Per archive: the wanted names of its central directory, cut into runs by their compressed bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["file"]:
                try:
                    with zipfile.ZipFile(path) as z:
                        found = [(i.filename, i.compress_size) for i in z.infolist()
                                 if not i.is_dir() and (wanted is None or re.search(wanted, i.filename))]
                except (zipfile.BadZipFile, OSError) as e:
                    yield pd.DataFrame({"file": [path], "slice": [0], "names": [None], "problem": [_problem(e)]})
                    continue
                most = min(slice_bytes, -(-sum(size for _, size in found) // slices))
                for i, names in enumerate(_cut(found, most)):
                    yield pd.DataFrame({"file": [path], "slice": [i], "names": [names], "problem": [None]})

    return run


def _read_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples():
            if row.names is None:
                yield pd.DataFrame({"file": [row.file], "name": [None], "text": [None], "problem": [row.problem]})
                continue
            with zipfile.ZipFile(row.file) as z:
                held, size = [], 0
                for name in row.names:
                    try:
                        held.append((row.file, name, _inflate(z, name), None))
                        size += len(held[-1][2])
                    except Exception as e:  # noqa: BLE001 - whatever is wrong with one entry, the others land
                        held.append((row.file, name, None, _problem(e)))
                    if size > BATCH_CHARS:
                        yield pd.DataFrame(held, columns=["file", "name", "text", "problem"])
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=["file", "name", "text", "problem"])


def archive_entries(spark: SparkSession, glob: str, slices: int = 1, slice_bytes: int = SLICE_BYTES,
                    wanted: str | None = None) -> DataFrame:
    """(file, name, text, problem) of every entry, or of those whose name matches ``wanted``; the others are not read.

    The task unit is a run of one archive's entries of at most ``slice_bytes`` compressed bytes, and at least ``slices``
    of them (if it has as many entries), so an archive with nearly all bytes is many tasks. An entry that cannot be
    read, or expands beyond ``MAX_ENTRY_BYTES``, has no text but a problem; so has an archive that cannot be opened
    (its name is null).
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*").load(glob).select(
            F.regexp_replace("path", "^file:/*", "/").alias("file"))
    )
    units = files.repartition("file").mapInPandas(
        _entry_slices(slices, slice_bytes, wanted), "file string, slice int, names array<string>, problem string")
    return units.repartition("file", "slice").mapInPandas(_read_slices, "file string, name string, text string, problem string")


_RECORD = (
    "id string, captured_at string, api_path string, event_type string, http_method string, response_code int"
)
_METADATA = (
    "format_version int, capture_id string, captured_at string, captured_until string, kubernetes_version string, "
    "server_address string, record_count bigint, deduplicated_count bigint, auto_discovered boolean, "
    "watch_enabled boolean, intervals array<string>, uncompressed_bytes bigint, redacted boolean, "
    "secrets_redacted bigint, fields_redacted bigint"
)


def land_archives(spark: SparkSession, glob: str, staging: str, slices: int = 1, slice_bytes: int = SLICE_BYTES) -> dict[str, DataFrame]:
    """records, captures, index, watch_index and quarantine tables of all archives matched by ``glob``.

    The inflated entries are written once to ``staging`` (Parquet); the tables are views over it. What cannot be read is in
    ``quarantine`` (file, name, problem) and the rest lands. An archive whose metadata cannot be read has no capture
    to belong to: it is in quarantine as a whole, with a null name, and its entries stay in ``staging``.
    """
    archive_entries(spark, glob, slices, slice_bytes).write.mode("overwrite").parquet(staging)
    staged = spark.read.parquet(staging)
    entries = staged.filter("problem IS NULL").drop("problem")
    meta = entries.filter(F.col("name").rlike(METADATA_ENTRY)).select(
        "file", F.from_json("text", _METADATA).alias("m")
    ).select("file", "m.*").filter("capture_id IS NOT NULL")
    captures = (
        meta.withColumn("captured_at", rfc3339("captured_at")).withColumn("captured_until", rfc3339("captured_until"))
        .withColumn("format_version", F.when(F.coalesce("format_version", F.lit(0)) == 0, 1).otherwise(F.col("format_version")))
    )
    ids = captures.select("file", "capture_id")
    index = explode_index(
        entries.filter(F.col("name").rlike(INDEX_ENTRY)).select("file", "text").join(ids, "file"), "text")
    watch = explode_index(
        entries.filter(F.col("name").rlike(WATCH_INDEX_ENTRY)).select("file", "text").join(ids, "file"),
        "text", watch=True)
    seq = F.regexp_extract("name", RECORD_ENTRY, 1).cast("bigint")
    rec = F.from_json("text", _RECORD)
    records = (
        entries.filter(F.col("name").rlike(RECORD_ENTRY))
        .select("file", seq.alias("seq"), rec.alias("r"),
                F.to_json(F.variant_get(F.try_parse_json("text"), "$.response_body", "variant")).alias("body"))
        .join(ids, "file")
        .select("capture_id", F.col("r.api_path").alias("path"), "seq", rfc3339(F.col("r.captured_at")).alias("captured_at"),
                F.nullif("r.event_type", F.lit("")).alias("event_type"), "r.http_method", "r.response_code", "body")
    )
    nameless = staged.filter("name IS NOT NULL").select("file").distinct().join(ids, "file", "left_anti").select(
        "file", F.lit(None).cast("string").alias("name"), F.lit("no readable metadata.json with a capture_id").alias("problem"))
    quarantine = staged.filter("problem IS NOT NULL").select("file", "name", "problem").unionByName(nameless)
    drop = lambda df: df.drop("file")
    return {"records": records, "captures": drop(captures), "index": drop(index), "watch_index": drop(watch),
            "quarantine": quarantine}


def unsupported(captures: DataFrame) -> DataFrame:
    """Captures whose format this library does not read."""
    return captures.filter((F.col("format_version") < 0) | (F.col("format_version") > CURRENT_FORMAT_VERSION))
