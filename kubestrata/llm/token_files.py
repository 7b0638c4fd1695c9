"""Token files: concatenated ids of many documents, their borders as Elias-Fano codes (operator 2).

A file is a Parquet table of segments. A segment holds whole documents: their ids as fixed-width little-endian
integers (2 bytes if the vocabulary allows, else 4), and the border after each document in an Elias-Fano code: with
``n`` borders up to ``u``, the low ``l = floor(log2(u / n))`` bits of each border lie side by side, and the rest is a
bit vector with bit ``(border >> l) + i`` set for the i-th border: at most ``n * (2 + log2(u / n))`` bits together.
``select`` finds the i-th set bit by a sampled directory of one-bits and so gives any border without a table of
64-bit offsets. The start of a segment in the whole corpus is the sum of the shards before it, one row per task that
wrote, and of the segments before it in its shard, which the writing task has counted.

Order: ascending doc_id (null first), equal ids by text. Null text: no ids but the end id. Every row of the input is
one document, repeated rows too. An empty table gives an empty file. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kubestrata.llm.store import new_path
from kubestrata.llm.tokens import Encoder, crc32, slices

#: A segment is closed once it holds so many ids. One document is never split, so a longer one is a segment by itself.
SEGMENT_IDS = 1 << 20
#: One in so many one-bits has its place in the select directory.
SELECT_SAMPLE = 64

SEGMENT_DDL = (
    "shard int, segment int, within long, n_docs int, n_ids long, width int, doc_ids array<long>, ids binary, low_bits int, "
    "low binary, high binary, sampled binary"
)


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space, with select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, sampled: bytes):
        self.n, self.low_bits, self.low, self.high, self.sampled = n, low_bits, low, high, sampled

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(at[-1]) // 8 + 1) * 8 if n else 0, np.uint8)
        bits[at] = 1
        return EliasFano(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), at[::SELECT_SAMPLE].astype("<u4").tobytes())

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        raw = np.frombuffer(self.low, np.uint8)
        bits = (raw[at >> 3] >> (at & 7)) & 1 if self.low_bits else np.zeros(at.shape, np.uint8)
        return (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """The i-th value: from the sampled one-bit before it, at most ``SELECT_SAMPLE`` one-bits are passed."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = int(np.frombuffer(self.sampled, "<u4")[i // SELECT_SAMPLE])
        left, byte, mask = i % SELECT_SAMPLE, first >> 3, 0xFF << (first & 7) & 0xFF
        while (ones := (self.high[byte] & mask).bit_count()) <= left:
            left, byte, mask = left - ones, byte + 1, 0xFF
        bits = self.high[byte] & mask
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        return (place - i) << self.low_bits | int(self._low(np.array([i]))[0])

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return (ones - i) << self.low_bits | self._low(i)


def _segment(shard: int, number: int, within: int, doc_ids: list, parts: list[np.ndarray], sizes: list[int]) -> dict:
    ids = np.concatenate(parts)
    borders = EliasFano.of(np.cumsum(sizes))
    return {"shard": shard, "segment": number, "within": within, "n_docs": len(doc_ids), "n_ids": len(ids), "width": ids.dtype.itemsize, "doc_ids": doc_ids,
            "ids": ids.astype(ids.dtype.newbyteorder("<")).tobytes(), "low_bits": borders.low_bits, "low": borders.low,
            "high": borders.high, "sampled": borders.sampled}


def _encode_shards(tokenizer: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, number, within = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, sizes, held = [], [], [], 0
        for batch in batches:
            for part in slices(batch):
                ids, border = encoder.encode(part.column("text"))
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), border[:-1].tolist(), border[1:].tolist(), strict=True):
                    doc_ids.append(doc_id)
                    parts.append(np.append(ids[a:b], np.array(end_id, ids.dtype)))
                    sizes.append(b - a + 1)
                    held += b - a + 1
                    if held >= segment_ids:
                        yield pa.RecordBatch.from_pylist([_segment(shard, number, within, doc_ids, parts, sizes)], schema=_SCHEMA)
                        doc_ids, parts, sizes, held, number, within = [], [], [], 0, number + 1, within + held
        if doc_ids:
            yield pa.RecordBatch.from_pylist([_segment(shard, number, within, doc_ids, parts, sizes)], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("within", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()),
    ("high", pa.binary()), ("sampled", pa.binary()),
])


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` (doc_id, text) into a token file at ``path``, in ascending doc_id order.

    One shuffle of the texts by range of doc_id; each range is one shard, written by the task that encoded it.
    """
    order = F.col("doc_id").asc_nulls_first()
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(order).sortWithinPartitions(order, "text")
    )
    ordered.mapInArrow(_encode_shards(tokenizer, end_id, segment_ids), SEGMENT_DDL).write.parquet(path)


def _shard_bases(segments: DataFrame) -> DataFrame:
    """(shard, shard_base): ids before each shard; one row per task that wrote, so it may be broadcast."""
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_base"))


def read_token_file(spark: SparkSession, path: str, token_ids: bool = False) -> DataFrame:
    """Documents of a token file: doc_id, start, n_tokens, ids_crc32, and ``ids`` itself if ``token_ids``."""
    segments = spark.read.schema(SEGMENT_DDL).parquet(path)
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if token_ids else "")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
                       + ([("ids", pa.list_(pa.int32()))] if token_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{r['width']}")
                ends = EliasFano(r["n_docs"], r["low_bits"], r["low"], r["high"], r["sampled"]).values()
                begins = np.concatenate([[0], ends[:-1]])
                spans = list(zip(begins.tolist(), ends.tolist(), strict=True))
                cols = {"doc_id": r["doc_ids"], "start": begins + r["shard_base"] + r["within"], "n_tokens": ends - begins, "ids_crc32": [crc32(ids[a:b]) for a, b in spans]}
                if token_ids:
                    cols["ids"] = [ids[a:b].astype(np.int32).tolist() for a, b in spans]
                yield pa.RecordBatch.from_pydict(cols, schema=schema)

    return segments.join(F.broadcast(_shard_bases(segments)), "shard").mapInArrow(run, out)


def document_ids(segment: dict, i: int) -> np.ndarray:
    """Ids of the i-th document of one segment row, found by select alone."""
    borders = EliasFano(segment["n_docs"], segment["low_bits"], bytes(segment["low"]), bytes(segment["high"]), bytes(segment["sampled"]))
    ids = np.frombuffer(bytes(segment["ids"]), f"<u{segment['width']}")
    return ids[borders.select(i - 1) if i else 0 : borders.select(i)]


def token_file_table(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as a token file in the shared folder and read its documents back."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_file(docs, path, tokenizer, end_id)
    return read_token_file(docs.sparkSession, path)

