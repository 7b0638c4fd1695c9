"""WARC archives compressed record by record with a dictionary of their own (operator 11).

Each page becomes one WARC/1.1 record: ``response`` with the payload behind a short HTTP header, or ``revisit`` (profile
"identical payload digest") without it, if another page with the same payload comes before it. Pages are dealt into archives of
about ``ARCHIVE_BYTES`` of payload where they lie, without a shuffle. For each archive the writing task trains a
Zstandard dictionary from records spread evenly over the archive (at most ``SAMPLE_BYTES`` in all and ``SAMPLE_RECORD`` of any one; the
only sample here), puts it into a skippable frame at the start, and compresses every record, its ``warcinfo`` included,
as a frame of its own. So any record can be read from its offset and the dictionary alone. An archive too small to train a
dictionary on has none, and no such frame.

Archives are rows (archive, n_records, dictionary_bytes, content) of a Parquet table, as executors write only through
Spark; ``content`` is the whole file, and ``export`` writes the files to a folder that all executors mount.

Equal payloads are found by their SHA-256. The page with the smallest page_id holds the response; if rows share that page_id, each is
a response. Pages without a page_id are revisits where a page with an id has their payload, else responses. Null html is the
empty payload. Payloads below ``least`` bytes are all responses. Repeated rows are records of their own. An empty table
gives no archive. Columns besides page_id, url and html are ignored. A page longer than ``ARCHIVE_BYTES`` is an archive of
its own. Control characters and blanks in a URL are percent-encoded; a page without a URL gets ``about:blank``.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kubestrata.functions.ordered import salted_join
from kubestrata.llm.store import new_path, staged

ARCHIVE_BYTES = 16 << 20
SAMPLE_BYTES, SAMPLE_RECORD, DICTIONARY_BYTES, LEVEL = 2 << 20, 16 << 10, 64 << 10, 3
#: Of the file format (fixed values): first bytes of a skippable frame that holds a dictionary, of a frame, of a dictionary.
SKIPPABLE, FRAME = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_DDL = "archive string, n_records long, dictionary_bytes long, content binary"
RECORD_DDL = ("archive string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
              "payload_digest string, intact boolean")  # fmt: skip
_ARCHIVE = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("dictionary_bytes", pa.int64()), ("content", pa.large_binary())])
_RECORD = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                     ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Frames.


def frame_end(data: memoryview, at: int) -> int:
    """The byte behind the frame that begins at ``at``: its header, then blocks that each tell their length."""
    import zstandard

    if data[at : at + 4] != FRAME:
        return at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    checked = data[at + 4] >> 2 & 1
    at += zstandard.frame_header_size(bytes(data[at : at + 18]))
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a run-length block holds one byte
        if block & 1:
            return at + 4 * checked


def trained(records: list[bytes]):
    """A dictionary for these records, or None if they are too few or too small."""
    import zstandard

    total = sum(min(len(r), SAMPLE_RECORD) for r in records)
    step = max(1, -(-total // SAMPLE_BYTES))
    samples = [r[:SAMPLE_RECORD] for r in records[::step]]
    samples = samples[: bisect_right(list(accumulate(map(len, samples))), SAMPLE_BYTES)]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 8 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8)
    except zstandard.ZstdError:  # the samples have nothing in common
        return None


def pack_archive(records: list[bytes]) -> tuple[bytes, int]:
    """(the file, bytes of its dictionary): the dictionary's frame if there is one, then a frame for each record."""
    import zstandard

    known = trained(records)
    plain = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    parts, held = [], 0
    if known:
        held = len(known.as_bytes())
        small = plain.compress(known.as_bytes())
        parts += [SKIPPABLE, len(small).to_bytes(4, "little"), small]
        known.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True) if known else plain
    parts += [packer.compress(r) for r in records]
    return b"".join(parts), held


def unpack_archive(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each record of a file, whoever wrote it."""
    import zstandard

    data, at, known = memoryview(content), 0, None
    if data[:4] == SKIPPABLE:
        at = frame_end(data, 0)
        inner = bytes(data[8:at])
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(inner) if inner[:4] == FRAME else inner)
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        if data[at : at + 4] == FRAME:
            yield at, reader.decompressobj().decompress(data[at:end])
        at = end


# Records.


def _safe(url: str | None) -> str:
    return "".join(c if " " < c < "\x7f" or c > "\xa0" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url) if url else "about:blank"


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{sha1}')}>"


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The record of a page; ``refers_to`` is the page that holds its payload, or None."""
    sha1 = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(page_id, sha1)), ("WARC-Date", date), ("WARC-Target-URI", _safe(url)), ("WARC-Payload-Digest", f"sha1:{sha1}"),
              ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is None:
        return _record("response", fields, http + payload)
    fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to, sha1)), ("X-Refers-To-Page-Id", str(refers_to))]
    return _record("revisit", fields, http)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


# Tables.


def with_first(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to, null for a response.

    Only the narrow table of repeated payloads meets the pages: Spark sends it round while it is small by its own check,
    and else shuffles both, with a payload that very many pages share dealt into parts.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    sha = F.unhex(F.sha2("payload", 256))
    seen = rows.where(F.octet_length("payload") >= least).groupBy(sha.alias("_sha")).agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = staged(seen.where("_n > 1 and _first is not null").select("_sha", "_first"), "repeated")
    joined = salted_join(rows.withColumn("_sha", sha), repeated, ["_sha"], ["page_id", "url"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as archives to the table at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, records = TaskContext.get().partitionId(), 0, 0, []

        def archive() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:05d}.warc.zst"
            about = _record("warcinfo", [("WARC-Record-ID", record_id(None, name)), ("WARC-Date", date), ("WARC-Filename", name),
                                         ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            content, dictionary = pack_archive([about, *records])
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": [len(records)], "dictionary_bytes": [dictionary], "content": [content]}, schema=_ARCHIVE)

        for batch in batches:
            for page_id, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                records.append(page_record(page_id.as_py(), url.as_py(), payload.as_py(), refers.as_py(), date))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield archive()
                    number, held, records = number + 1, 0, []
        if records:
            yield archive()

    with_first(pages, least).mapInArrow(run, ARCHIVE_DDL).write.parquet(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per page record of the archives at ``path``, from their bytes alone; ``payload`` too if ``payloads`` (null
    for a revisit). ``intact`` tells whether a response's payload has the digest that its header says; a revisit has none to tell."""
    schema = _RECORD.append(pa.field("payload", pa.large_binary())) if payloads else _RECORD
    number = lambda text: None if text is None else int(text)

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        for offset, record in unpack_archive(content):
            fields, block = parse_record(record)
            if fields["warc-type"] not in ("response", "revisit"):
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            told = fields["warc-payload-digest"].removeprefix("sha1:")
            revisit = fields["warc-type"] == "revisit"
            if revisit:
                size, sha1 = int(http.rpartition(b"Content-Length:")[2]), told
            else:
                size, sha1 = len(payload), digest(payload)
            yield (name, offset, number(fields.get("x-page-id")), fields["warc-target-uri"], fields["warc-type"], number(fields.get("x-refers-to-page-id")),
                   size, sha1, None if revisit else sha1 == told, None if revisit else payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content"), strict=True):
                some, held = [], 0
                for row in rows(name.as_py(), content.as_py()):
                    some.append(row[: len(schema.names)])
                    held += row[6] if payloads else 0
                    if len(some) >= 4096 or held >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), schema.types)], schema=schema)
                        some, held = [], 0
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), schema.types)], schema=schema)

    archives = spark.read.schema(ARCHIVE_DDL).parquet(path).select("archive", "content")
    return archives.mapInArrow(run, RECORD_DDL + (", payload binary" if payloads else ""))


def export(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Write the archives at ``path`` as files to ``folder``, which all executors mount; returns (archive, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content"), strict=True):
                target, data = os.path.join(folder, name.as_py()), content.as_py()
                partial = f"{target}.{uuid.uuid4().hex}"  # a task that is run twice leaves whole files only
                with open(partial, "wb") as f:
                    f.write(data)
                os.replace(partial, target)
                yield pa.RecordBatch.from_pydict({"archive": [name.as_py()], "bytes": [len(data)]})

    return spark.read.schema(ARCHIVE_DDL).parquet(path).select("archive", "content").mapInArrow(run, "archive string, bytes long")


def archive_table(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read their records back."""
    path = new_path(pages.sparkSession, "archives")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
b AS (SELECT p.page_id, octet_length(encode(p.h)) AS payload_bytes, first,
             list_aggregate(list_transform(string_split(sha1(p.h), ''), lambda c: bin(CAST('0x' || c AS INT) + 16)[2:]), 'string_agg', '') AS bits
      FROM p JOIN f ON p.h = f.h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           CAST(list_sum(list_transform(range(5), lambda k: CAST(bits[5 * i + k + 1] AS INT) * (16 >> CAST(k AS INT)))) AS INT) + 1]), 'string_agg', '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM b"""
