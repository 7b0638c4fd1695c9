"""N-gram Jaccard join: near copies among all documents (operator 1).

Two documents are linked if the Jaccard similarity of their sets of word 5-grams is 0.8 or more. Words are runs of
characters other than white space, in lower case; a text of one to four words is one n-gram.

1. Each text becomes a 128-bit key of its n-gram set and ``bands`` hashes of ``rows`` minima each. Their numbers are
   chosen so that a pair at the threshold shares a band with at least the wanted probability.
2. Documents with the same set (exact copies and texts that differ in case or white space) become one class: counted,
   never paired.
3. Classes are shuffled on their band hashes. In a bucket each class is tied to the smallest one, not paired with all;
   buckets are salted, so that no bucket meets in one task. Components of these ties hold every pair that shares a band.
4. The n-gram sets of a component's classes meet in blocks of bounded size, every block with every block, and each pair
   is verified on the full sets, by matrix products over the n-grams that occur twice. A task returns for each class the
   number of its links and a tie to the smallest class of its linked group: rows grow with classes, not with pairs.
5. Components of the verified links are the groups.

Result: one row per row of the input: doc_id, class_id (smallest doc_id of the group), copy_id (smallest doc_id with the
same n-gram set), n_links (other documents linked to it, exact copies included), n_texts (linked classes with another
set), kept (true on one row of each group: the one with the smallest doc_id, then text hash). Null, empty and blank
texts have no n-grams and stand alone, linked to nothing. A null doc_id comes after all others. Repeated rows (same
doc_id and text) are copies of one another; ``kept`` marks all of them, ``without_near_copies`` leaves one of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kubestrata.llm.components import components
from kubestrata.llm.store import carried, restored, row_key, staged
from kubestrata.llm.tokens import slices
from kubestrata.llm.words import scramble, shingle_hashes, word_hashes

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Minima per document at most, when bands and rows are chosen.
MOST_MINIMA = 128
#: Classes and n-grams of one block of a component.
BLOCK_CLASSES, BLOCK_GRAMS = 256, 1 << 20
#: Columns of one matrix product.
COLUMNS = 4096
SALTS = 16
SLICE_BYTES = 1 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_MINIMA) -> tuple[int, int]:
    """(bands, rows): as many rows as ``most`` minima allow while a pair at the threshold is found with ``recall``."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def gram_sets(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of n-grams, border of each text)."""
    return shingle_hashes(*word_hashes(texts), n)


def _signatures(n: int, bands: int, rows: int):
    half = (bands * rows + 1) // 2
    factors = np.random.default_rng(11).integers(1, 1 << 62, half, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salts = scramble(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                grams, at = gram_sets(part.column("text"), n)
                size = np.diff(at)
                full = np.flatnonzero(size)
                keys, count = np.zeros((len(size), 2), np.uint64), np.zeros(len(size), np.int64)
                for i in full:
                    own = np.unique(grams[at[i] : at[i + 1]])
                    keys[i] = scramble(own + np.uint64(1)).sum(), scramble(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
                    count[i] = len(own)
                out = np.zeros((len(size), bands), np.uint64)
                if len(full):
                    minima = np.empty((len(full), half * 2), np.uint64)
                    for k in range(half):  # both halves of a product are a hash value each
                        value = scramble(grams * factors[k])
                        minima[:, 2 * k] = np.minimum.reduceat(value >> np.uint64(32), at[full])
                        minima[:, 2 * k + 1] = np.minimum.reduceat(value & np.uint64(0xFFFFFFFF), at[full])
                    value = np.tile(salts, (len(full), 1))
                    for r in range(rows):
                        value = scramble(value + minima[:, r : bands * rows : rows])
                    out[full] = value
                cols = {c: part.column(c) for c in ("doc_id", "_k", "_t")}
                lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, bands, dtype=np.int32), out.view(np.int64).ravel())
                yield pa.RecordBatch.from_pydict(cols | {"k1": keys[:, 0].view(np.int64), "k2": keys[:, 1].view(np.int64), "grams": count, "bands": lists})

    return run


def _verify(n: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rank = np.argsort(table.column("node").to_numpy(), kind="stable")
        table = table.take(pa.array(rank))
        node, weight, block = (table.column(c).to_numpy() for c in ("node", "n", "block"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
        m, size = len(sets), np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(m), size)
        _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = np.cumsum(times > 1) - 1
        shared = times[gram] > 1
        column, owner = common[gram[shared]], owner[shared]
        both = np.zeros((m, m), np.float32)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        last = int(column[-1]) + 1 if len(column) else 0
        for a in range(0, last, COLUMNS):
            lo, hi = np.searchsorted(column, [a, a + COLUMNS])
            x = np.zeros((m, min(COLUMNS, last - a)), np.float32)
            x[owner[lo:hi], column[lo:hi] - a] = 1
            both += x @ x.T
        union = size[:, None] + size[None, :] - both
        linked = both >= threshold * union - 1e-6
        np.fill_diagonal(linked, False)
        one = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        if one:  # two blocks: pairs within one are counted where it meets itself
            linked &= block[:, None] != block[None, :]
        label = np.arange(m)
        while True:  # smallest class of each linked group in this task
            new = np.minimum(label, np.where(linked, label[None, :], m).min(axis=1, initial=m))
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = linked.any(axis=1)
        return pa.table({"node": node[some], "texts": linked.sum(axis=1)[some].astype(np.int64),
                         "docs": (linked @ weight)[some].astype(np.int64), "root": node[label[some]]})

    return run


def near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """See the module. ``_k``, ``_t`` of the result are the keys of ``store.row_key``."""
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row_key())
    signed = staged(texts.mapInArrow(_signatures(n, bands, rows), "doc_id long, _k long, _t long, k1 long, k2 long, grams long, bands array<long>"), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_t", "_k")  # a null doc_id comes last
    classes = signed.where("grams > 0").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    # ties: each class to the smallest of its bucket, by way of the smallest of its salted part
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    banded = staged(classes.select("node", salt.alias("salt"), F.explode("bands").alias("band")), "bands")
    parts = staged(banded.groupBy("band", "salt").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("m")), "parts")
    whole = parts.groupBy("band").agg(F.min("low").alias("lowest"), F.sum("m").alias("m")).where("m > 1")
    parts = staged(parts.drop("m").join(whole.drop("m"), "band"), "full-parts")
    ties = banded.join(parts, ["band", "salt"]).select(F.col("node").alias("a"), F.col("low").alias("b")).unionByName(
        parts.select(F.col("low").alias("a"), F.col("lowest").alias("b")))
    group = staged(components(ties), "candidates")

    # blocks of bounded size; every block of a component meets every one
    members = classes.select("node", "n", "grams", "first").join(group, "node")
    sizes = members.groupBy("label").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("grams") / BLOCK_GRAMS)).alias("blocks"))
    members = staged(members, "members").join(staged(sizes, "sizes"), "label").select(
        "node", "n", "label", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.col("first._k").alias("_k"), F.col("first._t").alias("_t"))
    # texts are shuffled once whatever the number of candidates: no plan that only holds for few of them
    candidates = texts.select("_k", "_t", "text").join(staged(members, "blocks").hint("merge"), ["_k", "_t"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                grams, at = gram_sets(part.column("text"), n)
                made = [np.unique(grams[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in ("node", "n", "label", "blocks", "block")} | {"set": made})

    made = candidates.mapInArrow(sets, "node long, n long, label long, blocks long, block int, set binary")
    made = made.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "label", "blocks", "block", "set")])  # of repeated rows one
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    units = made.withColumn("other", other).select("node", "n", "label", "block", "set", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    links = staged(units.groupBy("label", "i", "j").applyInArrow(_verify(n, threshold), "node long, texts long, docs long, root long"), "links")

    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    labelled = staged(classes.select("k1", "k2", "node", "n", "first").join(counts, "node", "left").join(groups, "node", "left")
                      .withColumn("label", F.coalesce("label", "node")), "labelled")
    lowest = staged(labelled.groupBy("label").agg(F.min("first").alias("lowest")), "lowest")
    per_class = staged(labelled.join(lowest, "label").select("k1", "k2", "n", "texts", "docs", "first", "lowest"), "per-class")
    out = signed.drop("bands").join(per_class, ["k1", "k2"], "left")
    alone = F.col("n").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("lowest.doc_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("copy_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n") - 1 + F.coalesce("docs", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
        (alone | ((F.col("lowest._k") == F.col("_k")) & (F.col("lowest._t") == F.col("_t")))).alias("kept"), "_k", "_t")


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near copies, with all their columns."""
    names = docs.columns
    kept = staged(near_copies(docs, **options).where("kept").select("_k", "_t").distinct(), "kept")
    return docs.select(*carried(names), *row_key()).join(kept, ["_k", "_t"]).dropDuplicates(["_k", "_t"]).select(*restored(names))
