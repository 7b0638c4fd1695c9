"""Packing documents into sequences of a fixed number of tokens: dominance reduction, then best fit (operator 8).

How well pieces pack depends only on how many there are of each length, and there are at most ``capacity`` lengths. So
the tokenising tasks write one narrow row per piece; the counts by length (at most ``capacity`` rows) come to the
driver, which works out how many sequences of which make-up to build; and each piece finds its place from its rank
among the pieces of its length. Only the counts are gathered, never the pieces.

The reduction is that of Martello and Toth, in counts: for the longest length left, if the set made of it and the
longest length that fits with it dominates every other set (because it fills the sequence, or because no two others
fit with it), or one pair of others does, such sequences are fixed, as many as the counts allow, and the instance
shrinks. What it cannot fix goes by best fit, longest first.

Null or empty texts have only the end id. Repeated rows are documents of their own. An empty table packs into no
sequence. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kubestrata.llm.store import staged
from kubestrata.llm.tokens import Encoder, slices

CAPACITY = 2048

PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, token_ids: bool = False) -> DataFrame:
    """One row per piece; ``rank`` counts the pieces of its length in the task ``part`` that made it.

    Write the result before using it: ranks are those of one run.
    """
    ddl = PIECE_DDL + (", ids array<int>" if token_ids else "")
    schema = _PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if token_ids else _PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seen = Encoder.of(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in slices(batch):
                ids, border = encoder.encode(some.column("text"))
                whole = np.insert(ids, border[1:], end_id).astype("<u4")
                size = np.diff(border) + 1
                pieces = -(-size // capacity)
                of = np.repeat(np.arange(len(size)), pieces)
                k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(capacity, size[of] - k * capacity)
                end = np.cumsum(length)
                turn = np.argsort(length, kind="stable")
                rank = np.empty(len(of), np.int64)
                rank[turn] = np.arange(len(of)) - np.searchsorted(length[turn], length[turn])
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                crc = [zlib.crc32(whole[a:b]) for a, b in zip((end - length).tolist(), end.tolist(), strict=True)]
                cols = [some.column("doc_id").take(pa.array(of)), k.astype(np.int32), k * capacity, length, crc, np.full(len(of), part, np.int32), rank]
                arrays = [pa.array(c, t) for c, t in zip(cols, schema.types, strict=False)]
                if token_ids:  # pieces lie one behind the other
                    arrays.append(pa.ListArray.from_arrays(np.concatenate([[0], end]).astype(np.int32), whole.view(np.int32)))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


class Plan:
    """Sequences to build. A run: ``bins`` sequences from ``sequence`` on, each with ``each`` pieces of ``length`` from
    ``offset`` on, which are the pieces with ranks from ``rank`` on."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences, self.fixed = capacity, 0, 0
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.rank = np.zeros(capacity + 1, np.int64)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _build(self, content: list[tuple[int, int]], bins: int) -> None:
        offset = 0
        for length, each in content:
            self.runs.append((length, int(self.rank[length]), bins, each, self.sequences, offset))
            self.rank[length] += bins * each
            offset += length * each
        self.sequences += bins

    def _fix(self, *lengths: int) -> None:
        """As many sequences of just these lengths as there are pieces for."""
        need = {x: lengths.count(x) for x in lengths}
        bins = min(int(self.left[x]) // n for x, n in need.items())
        for x, n in need.items():
            self.left[x] -= bins * n
        self._build(list(need.items()), bins)

    def _smallest(self, but: int) -> list[int]:
        """The three shortest pieces left besides one of length ``but``."""
        out: list[int] = []
        for x in np.flatnonzero(self.left):
            out += [int(x)] * min(3, int(self.left[x]) - (x == but))
            if len(out) >= 3:
                break
        return out[:3]

    def _longest(self, most: int, *taken: int) -> int:
        """The longest length up to ``most`` with a piece left besides those taken, or 0."""
        for x in np.flatnonzero(self.left[: max(0, most) + 1])[::-1]:
            if self.left[x] > taken.count(int(x)):
                return int(x)
        return 0

    def _pair(self, j: int, room: int, one: int) -> tuple[int, int] | None:
        """Given that at most two pieces fit with ``j``: a pair that dominates all, if there is one."""
        two = self._longest(room - one, j, one)
        if not two:
            return None
        # {one, two} dominates {x, y}, x >= y, if y <= two (x <= one always), or if x + y <= one
        sizes = [int(x) for x in np.flatnonzero(self.left[: room + 1]) if x > two]
        best = 0
        for x in sizes:
            y = self._longest(min(x, room - x), j, x)
            best = max(best, x + y if y > two else 0)
        return (one, two) if best <= one else None

    def _reduce(self) -> None:
        j = self.capacity
        while j > 0:
            if not self.left[j]:
                j -= 1
                continue
            room, small = self.capacity - j, self._smallest(j)
            one = self._longest(room, j)
            if not one:
                self._fix(j)
            elif one == room or len(small) < 2 or small[0] + small[1] > room:
                self._fix(j, one)
            elif (len(small) < 3 or sum(small) > room) and (pair := self._pair(j, room, one)):
                self._fix(j, *pair)
            else:
                j -= 1

    def _best_fit(self) -> None:
        groups: dict[int, list[list]] = {}  # room left -> [sequences, what they hold]

        def put(room: int, bins: int, content: tuple) -> None:
            if bins:
                groups.setdefault(room, []).append([bins, content])

        for length in np.flatnonzero(self.left)[::-1].tolist():
            n = int(self.left[length])
            while n:
                room = min((r for r in groups if r >= length), default=self.capacity)
                bins, content = groups[room].pop() if room in groups else [n, ()]
                if not groups.get(room, [1]):
                    del groups[room]
                each = room // length
                full = min(bins, n // each)
                put(room - each * length, full, (*content, (length, each)))
                n -= full * each
                rest = 0
                if full < bins and n:  # the last one takes what is left
                    rest, n = n, 0
                    put(room - rest * length, 1, (*content, (length, rest)))
                if content:
                    put(room, bins - full - (rest > 0), content)
        for same in groups.values():
            for bins, content in same:
                self._build(list(content), bins)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places for written pieces: adds ``sequence_id`` and ``offset``."""
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    plan = Plan(counts, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    starts = (runs[:, 0] << 48) + runs[:, 1]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).select(*pieces.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = runs[np.searchsorted(starts, (length << 48) + rank, side="right") - 1]
            k = rank - own[:, 1]
            out = {c: batch.column(c) for c in batch.schema.names if c not in ("part", "rank")}
            out |= {"sequence_id": pa.array(own[:, 4] + k // own[:, 3]), "offset": pa.array(own[:, 5] + k % own[:, 3] * length)}
            yield pa.RecordBatch.from_pydict(out)

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name not in ("part", "rank")]
    return ranked.mapInArrow(run, ", ".join([*kept, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece."""
    return pack(staged(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most ``capacity`` in each)."""
    placed = pack(staged(token_pieces(docs, tokenizer, end_id, capacity, token_ids=True), "pieces"), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
