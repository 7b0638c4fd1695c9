"""A positional trigram index over the string leaves of objects, and searches that read only what may match.

Bodies are known by their digest, so a body is decoded and indexed once however many captures, paths and times hold it, and the
index serves any instant. Three tables lie below a folder: ``indexed`` (digest), ``leaves`` (digest, leaf, field, text) and ``segments``:
every three characters of a text with their places there, cut into segments of some texts each. A segment is a row for each of its
trigrams, in their order, and before them a row that tells which leaves lie where (see ``segments``). It is made where the texts lie,
without a shuffle or a sort of rows, and a search reads the pages of its trigrams alone. ``digests`` and ``again`` are left over from
adding, some 20 bytes a body. An index of the earlier layout (``bodies``, ``postings``) counts as empty.

A literal, and what a regular expression must contain, becomes an and/or of literals. A literal is in a leaf where all its
trigrams lie at their distances from one start. Leaves so found are candidates: their texts are matched exactly. A pattern that requires
no three characters in a row matches against all leaf texts, still without decoding an object.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kubestrata.functions.variants import deepest, string_leaves

GRAM = 3
SLICE_CHARS = 1 << 21
#: Characters of a segment that are looked up together: a leaf is listed once for each run of so many that it touches.
REACH = 1 << 12
WRAP = 0xFFFFFFFF
#: Bits that digests are marked in, and those of one ``bitmap_construct_agg``.
MARKS, MARKED = 1 << 23, 1 << 15
SEGMENTS = "gram string, segment binary, base int, places array<int>, digests array<binary>, leaves array<long>"
#: Places grow along a file, so their differences are packed into few bits; short pages let a search skip other trigrams.
PACKED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.page.row.count.limit": "512"}


def body_digest(obj) -> Column:
    return F.unhex(F.md5(obj))


def may_be_among(digests: DataFrame) -> Column:
    """A filter on ``digest`` that is false only for what is not in ``digests``: 1 MB of bits, however many they are.

    A join behind it shuffles few of the bodies that have no match.
    """
    at = F.pmod(F.xxhash64("digest"), F.lit(MARKS))
    marks = digests.select(at.alias("at")).groupBy(F.expr(f"at div {MARKED}").alias("page")).agg(
        F.bitmap_construct_agg(F.col("at") % MARKED).alias("bits"))
    held = marks.agg(F.map_from_entries(F.collect_list(F.struct("page", "bits"))).alias("held"))  # at most MARKS / MARKED pages
    pages = held.select(F.transform(F.sequence(F.lit(0), F.lit(MARKS // MARKED - 1)), lambda n: F.try_element_at("held", n.cast("long")))).scalar()
    byte = F.substring(F.get(pages, F.floor(at / MARKED).cast("int")), (F.floor(at / 8) % (MARKED // 8) + 1).cast("int"), F.lit(1))
    return F.coalesce(F.bit_get(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1, F.lit(False))


def _order(code: np.ndarray) -> np.ndarray:
    """What sorts ``code`` (not negative), equal ones as they lie: 16 bits at a time, which numpy sorts by counting."""
    order = np.argsort(code.astype(np.uint16), kind="stable")
    for shift in range(16, int(code.max()).bit_length(), 16):
        order = order[np.argsort((code[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of rows (digest, leaf, text), of at most ``SLICE_CHARS`` of text and one text.

    The texts of a segment lie behind one another. Its row of gram "" has the digests and leaves of those with a trigram, their
    first places and, last, the end; the others have the places of one trigram. A place is a member of ``places`` less ``base``,
    modulo 2^32: each row goes on where the one before ended.
    """
    for batch in batches:
        batch = batch.filter(pc.greater_equal(pc.utf8_length(batch.column("text")), GRAM))
        size = pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // SLICE_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)] if len(size) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            chars = np.frombuffer("".join(batch.column("text").slice(a, b - a).to_pylist()).encode("utf-32-le"), np.uint32)
            known = np.flatnonzero(np.bincount(chars))  # few characters make short codes, which sort as their texts do
            number = np.zeros(int(known[-1]) + 1, np.int64)
            number[known] = np.arange(len(known))
            chars = number[chars]
            code = (chars[:-2] * len(known) + chars[1:-1]) * len(known) + chars[2:]
            bounds = np.append(0, np.cumsum(size[a:b]))
            inside = np.ones(len(code), bool)  # not over the border of two texts
            inside[bounds[1:-1] - 1] = inside[bounds[1:-1] - 2] = False
            place = np.flatnonzero(inside)
            code = code[place]
            order = _order(code)
            code, place = code[order], np.concatenate([bounds, place[order]])
            at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            first = np.concatenate([[0], len(bounds) + at])
            step = np.diff(place, prepend=0)
            step[first] = place[first] + 1
            kept = np.cumsum(step)
            low = lambda v: pa.array((v & WRAP).astype(np.uint32).view(np.int32))
            text = lambda c: "".join(chr(known[x]) for x in (c // len(known) ** 2, c // len(known) % len(known), c % len(known)))
            rows, listed = len(first), np.append(0, np.full(len(first), b - a)).astype(np.int32)
            lists = lambda name: pa.ListArray.from_arrays(listed, batch.column(name).slice(a, b - a))
            only = pa.array([True] + [False] * (rows - 1))
            yield pa.RecordBatch.from_pydict({
                "gram": pa.array(["", *map(text, code[at].tolist())], pa.string()), "segment": pa.array([uuid.uuid4().bytes] * rows, pa.binary()),
                "base": low(kept[first] - place[first]), "places": pa.ListArray.from_arrays(np.append(first, len(place)).astype(np.int32), low(kept)),
                "digests": pc.if_else(only, lists("digest"), None), "leaves": pc.if_else(only, lists("leaf"), None)})


# --------------------------------------------------------------- what a pattern requires

#: A tree of ("lit", text), ("and", [...]), ("or", [...]); None requires nothing that an index could find.
Need = tuple | None


def _all(parts: list[Need]) -> Need:
    parts = [p for p in parts if p]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: list[Need]) -> Need:
    return None if not parts or not all(parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _literal(text: str) -> Need:
    return ("lit", text) if len(text) >= GRAM else None


def _same_in_both(pattern: str) -> bool:
    """Whether a regular expression means to Python's parser what it means to Java's; else it is not translated."""
    odd_escape = re.search(r"\\[^dDwWsSbBnrtf\W_]", pattern.replace("\\\\", ""))
    return not (odd_escape or "&&" in pattern or re.search(r"\[[^\]]*\[|\[\^?\]", pattern) or re.search(r"\(\?[a-zA-Z-]", pattern))


def required(pattern: str, regex: bool) -> Need:
    """What every match must contain. Follows the parse tree of ``re``; anything it does not know requires nothing."""
    if not regex:
        return _literal(pattern)
    if not _same_in_both(pattern):
        return None
    from re import _constants as op
    from re import _parser as parser

    try:
        tree = parser.parse(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))
    except (re.error, OverflowError):
        return None

    def walk(items) -> Need:
        parts, run = [], []

        def flush() -> None:
            parts.append(_literal("".join(run)))
            run.clear()

        for kind, arg in items:
            if kind is op.LITERAL:
                run.append(chr(arg))
            elif kind is op.SUBPATTERN and all(k is op.LITERAL for k, _ in arg[-1]):
                run += [chr(c) for _, c in arg[-1]]
            elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
                continue  # takes no characters: its neighbours stay neighbours
            else:
                flush()
                if kind is op.SUBPATTERN:
                    parts.append(walk(arg[-1]))
                elif kind is op.ATOMIC_GROUP:
                    parts.append(walk(arg))
                elif kind is op.BRANCH:
                    parts.append(_any([walk(b) for b in arg[1]]))
                elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and arg[0] > 0:
                    parts.append(walk(arg[2]))
        flush()
        return _all(parts)

    return walk(tree)


def literals(need: Need) -> list[str]:
    if need is None:
        return []
    return [need[1]] if need[0] == "lit" else sorted({t for p in need[1] for t in literals(p)})


def _holds(need: Need, has) -> Column:
    if need[0] == "lit":
        return has(need[1])
    return reduce(Column.__and__ if need[0] == "and" else Column.__or__, [_holds(p, has) for p in need[1]])


# ------------------------------------------------------------------------ the index

def _place(kept: Column) -> Column:
    return (kept.cast("long") - F.col("base")).bitwiseAND(F.lit(WRAP))


@dataclass
class TextIndex:
    """The index below ``path``; ``add`` creates it."""

    spark: SparkSession
    path: str

    def _table(self, name: str, ddl: str) -> DataFrame:
        reader = self.spark.read.schema(f"{ddl}, batch string")
        try:
            done = [r["batch"] for r in self.spark.read.schema("digest binary, batch string").parquet(f"{self.path}/indexed").select("batch").distinct().collect()]
        except AnalysisException:  # nothing was added yet
            return self.spark.createDataFrame([], ddl)
        return reader.parquet(f"{self.path}/{name}").filter(F.col("batch").isin(done)).drop("batch")  # whole batches only

    def bodies(self) -> DataFrame:
        return self._table("indexed", "digest binary")

    def leaves(self) -> DataFrame:
        return self._table("leaves", "digest binary, leaf long, field string, text string")

    def _segments(self) -> DataFrame:
        return self._table("segments", SEGMENTS)

    def _found(self, grams: list[str] | None = None) -> DataFrame:
        """(gram, segment, place in the segment) of all or of some trigrams."""
        rows = self._segments().filter(F.col("gram") != "" if grams is None else F.col("gram").isin(grams))
        return rows.select("gram", "segment", "base", F.explode("places").alias("kept")).select("gram", "segment", _place(F.col("kept")).alias("place"))

    def _located(self, places: DataFrame) -> DataFrame:
        """``places`` (segment, place, other columns) with digest, leaf and the ``place`` in the leaf."""
        lists = self._segments().filter("gram = ''").withColumn("at", F.transform("places", _place))
        first, end = (F.slice("at", F.lit(n), F.size("digests")) for n in (1, 2))
        leaves = lists.select("segment", F.inline(F.arrays_zip(
            F.col("digests").alias("digest"), F.col("leaves").alias("leaf"), first.alias("first"), end.alias("end"))))
        reached = leaves.withColumn("reach", F.explode(F.sequence(F.expr(f"first div {REACH}"), F.expr(f"(end - 1) div {REACH}"))))
        met = places.withColumn("reach", F.expr(f"place div {REACH}")).join(reached, ["segment", "reach"]).filter("place >= first AND place < end")
        return met.withColumn("place", (F.col("place") - F.col("first")).cast("int")).drop("segment", "reach", "first", "end")

    def grams(self) -> DataFrame:
        return self._located(self._found()).select("gram", "digest", "leaf", "place")

    def _postings(self) -> DataFrame:
        return self.grams().groupBy("gram", "digest", "leaf").agg(F.sort_array(F.collect_list("place")).alias("places"))  # at most a leaf's places

    def add(self, objects: DataFrame) -> TextIndex:
        """Index the bodies of ``objects`` (column ``obj``) that are not there yet. One writer at a time.

        Which bodies come again or are known is settled by their digests, so a body that comes once stays where it lies.
        """
        batch = f"batch={uuid.uuid4().hex}"
        given = objects.select(body_digest("obj").alias("digest"), "obj")

        def kept(df: DataFrame, name: str, **options: str) -> DataFrame:
            df.write.mode("overwrite").options(**options).parquet(f"{self.path}/{name}/{batch}")
            return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}/{batch}")

        known = F.coalesce("known", F.lit(False)).alias("known")
        digests = kept(given.groupBy("digest").agg(F.count("*").alias("n")).join(
            self.bodies().select("digest", F.lit(True).alias("known")).distinct(), "digest", "left").select("digest", "n", known), "digests")
        again = kept(digests.filter("n > 1 OR known").select("digest", "known"), "again")
        new = given
        if not again.isEmpty():
            marked = may_be_among(again)
            doubtful = given.filter(marked)
            new = given.filter(~marked).unionByName(doubtful.join(again, "digest", "left_anti")).unionByName(
                doubtful.join(again.filter("NOT known").select("digest"), "digest", "left_semi").dropDuplicates(["digest"]))
        found = string_leaves(new, "obj", deepest(objects, "obj")).select("digest", F.xxhash64("field").alias("leaf"), "field", "text")
        leaves = kept(found, "leaves", compression="zstd")
        kept(leaves.select("digest", "leaf", "text").mapInArrow(segments, SEGMENTS), "segments", **PACKED)
        # last, as its rows say that a body is indexed
        kept(digests.filter("NOT known").select("digest"), "indexed")
        return self

    def candidates(self, pattern: str, regex: bool = False) -> DataFrame | None:
        """(digest, leaf) of all leaves that may match, or None where the pattern requires no trigram."""
        need = required(pattern, regex)
        if need is None:
            return None
        texts = literals(need)
        of: dict[str, list[tuple[int, int]]] = {}
        for number, text in enumerate(texts):
            for place in range(len(text) - GRAM + 1):
                of.setdefault(text[place : place + GRAM], []).append((number, place))
        uses = F.create_map(*[x for g, at in of.items() for x in (
            F.lit(g), F.array(*[F.struct(F.lit(n).alias("lit"), F.lit(p).alias("off")) for n, p in at]))])
        size = F.create_map(*[x for n, t in enumerate(texts) for x in (F.lit(n), F.lit(len(t) - GRAM + 1))])
        hits = self._found(list(of)).select("segment", "place", F.explode(F.element_at(uses, F.col("gram"))).alias("u"))
        # neighbouring trigrams share two characters, so those in a row from one start are in one leaf
        whole = hits.groupBy("segment", F.col("u.lit").alias("lit"), (F.col("place") - F.col("u.off")).alias("place")).agg(
            F.count("*").alias("n")).filter(F.col("n") == F.element_at(size, F.col("lit")))
        held = self._located(whole).groupBy("digest", "leaf").agg(F.collect_set("lit").alias("lits"))  # at most the pattern's literals
        return held.filter(_holds(need, lambda t: F.array_contains("lits", texts.index(t)))).select("digest", "leaf")

    def to_match(self, pattern: str, regex: bool = False) -> DataFrame:
        """The leaves whose texts have to be matched: digest, field, text."""
        found = self.candidates(pattern, regex)
        leaves = self.leaves() if found is None else self.leaves().join(found, ["digest", "leaf"], "left_semi")
        return leaves.select("digest", "field", "text")

    def cost(self, pattern: str, regex: bool = False) -> DataFrame:
        """One row: leaves in the index, leaves whose texts the search matches, and that it decodes no indexed body."""
        read = self.to_match(pattern, regex).agg(F.count("*").alias("leaves_matched"))
        return read.withColumns({"leaves_indexed": self.leaves().agg(F.count("*")).scalar(), "bodies_decoded": F.lit(0)})
