"""Ranked lexical search by dense blocked matrix products (operator 13).

Items are gathered into tiles of whole items with at most ``TILE_TERMS`` different terms, items counting as ``LEAST_TERMS``
terms at least, so that a tile's weights are bounded; a longer item is a tile of its own. For each tile one pass over the documents
finds the tile's terms in every whole text and writes, per document, its number of terms and the term
numbers with their occurrences. Corpus counts come from those rows: N, L, and the documents of each term. A second pass
multiplies: ``DOC_ROWS`` documents by ``COLUMNS`` terms of impacts, only the columns that occur there, times the same terms by the items'
weights, in float64. Columns are cut so that no partial sum of an item can reach 2^53 (an impact is at most a million), so every product
is exact, and products are added as 64-bit integers.

Of each document tile the k best of each item are kept with all that tie with the k-th score, ordered by score and
doc_id, and merged into the task's k best; a task returns k rows an item at most, and the k best of all tasks are the result.

A term's weight and a document's impact are those of ``weight`` and ``impact`` below. Null or empty texts have no
terms. Repeated rows are documents (or items) of their own; items with one item_id are ranked apart, with equal rows for
each. Documents without a doc_id rank behind those of equal score that have one. Items with no term in common with any
document have no rows. Terms longer than ``LONG`` bytes are compared by their SHA-256. Empty tables give an empty result. Columns besides
doc_id, item_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kubestrata.llm.store import staged
from kubestrata.llm.tokens import slices

TILE_TERMS, LEAST_TERMS, DOC_ROWS, COLUMNS, SLICE_BYTES, LONG = 1 << 16, 128, 256, 2048, 4 << 20, 64
#: No impact is above this, and no float64 integer below the second is inexact.
MOST_IMPACT, EXACT = 1_000_000, 1 << 53
#: Bytes of terms: digits, letters (A-Z lower-cased) and all beyond ASCII; every other byte parts terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def weight(n: int, df: int) -> int:
    """Of a term in ``df`` of ``n`` documents."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """Of a term that occurs ``tf`` times among the ``size`` terms of a document, of ``n`` with ``total`` terms."""
    m = 100 - 75 + (75 * size * n) // max(total, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def term_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms, border of each text's terms), whole texts; blanks where two separators meet are left in as empty terms."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = data[at[0] : at[-1]].to_pybytes().translate(_BYTES) if data is not None else b""
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(raw)])
    lists = pc.ascii_split_whitespace(plain)
    border = lists.offsets.to_numpy().astype(np.int64)
    terms = lists.flatten()
    size = pc.binary_length(terms)
    if len(terms) and pc.max(size).as_py() > LONG:
        far = pc.greater(size, LONG)
        terms = pc.replace_with_mask(terms, far, pa.array(["\n" + hashlib.sha256(t.encode()).hexdigest() for t in terms.filter(far).to_pylist()], terms.type))
    return terms, border - border[0]


def item_tiles(items: DataFrame) -> DataFrame:
    """(tile, item_id, terms, counts): whole items in tiles of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, number, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                terms, border = term_lists(part.column("text"))
                rows = []
                for item_id, a, b in zip(part.column("item_id").to_pylist(), border[:-1].tolist(), border[1:].tolist(), strict=True):
                    own = Counter(t for t in terms[a:b].to_pylist() if t)
                    cost = max(len(own), LEAST_TERMS)
                    if held and held + cost > TILE_TERMS:
                        number, held = number + 1, 0
                    held += cost
                    rows.append((first + number, item_id, list(own), list(own.values())))
                yield pa.RecordBatch.from_pydict(
                    {"tile": pa.array([r[0] for r in rows], pa.int64()), "item_id": pa.array([r[1] for r in rows], pa.int64()),
                     "terms": pa.array([r[2] for r in rows], pa.list_(pa.string())), "counts": pa.array([r[3] for r in rows], pa.list_(pa.int64()))})

    whole = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    few = whole.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    tiles = 1 + max((few["bytes"] or 0) // (8 * TILE_TERMS), few["n"] * LEAST_TERMS // TILE_TERMS)  # so many tasks fill their tiles
    return whole.coalesce(tiles).mapInArrow(run, "tile long, item_id long, terms array<string>, counts array<long>")


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, size, term array, tf array) of each document with a term: how many it has, and those of ``vocabulary``."""
    words = pa.array(vocabulary, pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                terms, border = term_lists(part.column("text"))
                n = len(part)
                owner = np.repeat(np.arange(n), np.diff(border))
                some = pc.greater(pc.binary_length(terms), 0).to_numpy(zero_copy_only=False)
                size = np.bincount(owner[some], minlength=n)
                found = pc.index_in(terms, value_set=words)
                hit = found.is_valid().to_numpy(zero_copy_only=False)
                pair, tf = np.unique(owner[hit] * len(vocabulary) + found.drop_null().to_numpy(), return_counts=True)
                held = size > 0
                mine = np.bincount(pair // max(1, len(vocabulary)), minlength=n)[held]
                offsets = pa.array(np.concatenate([[0], np.cumsum(mine)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (pair % max(1, len(vocabulary)), tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(pa.array(held)), pa.array(size[held], pa.int64()), *lists],
                                                 names=["doc_id", "size", "term", "tf"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return whole.mapInArrow(run, "doc_id long, size long, term array<int>, tf array<int>")


def exact_blocks(weights: list[tuple[np.ndarray, np.ndarray]], n_terms: int, columns: int = COLUMNS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, terms x items weights as float64) so that impacts times weights sum to less than 2^53 for every item.

    ``weights`` holds (terms, weights) of each item. A weight too great for that alone is dealt into several blocks.
    """
    limit = (EXACT - 1) // MOST_IMPACT
    out = []

    def cut(terms: np.ndarray, block: np.ndarray) -> None:
        if (block.sum(axis=0) <= limit).all():
            used = block.any(axis=1)
            if used.any():
                out.append((terms[used], block[used].astype(np.float64)))
        elif len(terms) > 1:
            half = len(terms) // 2
            cut(terms[:half], block[:half])
            cut(terms[half:], block[half:])
        else:
            cut(terms, np.minimum(block, limit))
            cut(terms, block - np.minimum(block, limit))

    item = np.repeat(np.arange(len(weights)), [len(t) for t, _ in weights])
    term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in weights)]).astype(np.int64)
    value = np.concatenate([np.zeros(0, np.int64), *(w for _, w in weights)]).astype(np.int64)
    for a in range(0, n_terms, columns):
        here = (term >= a) & (term < a + columns)
        block = np.zeros((min(columns, n_terms - a), len(weights)), np.int64)
        block[term[here] - a, item[here]] = value[here]
        cut(np.arange(a, a + len(block)), block)
    return out


def tile_scores(blocks: list[tuple[np.ndarray, np.ndarray]], row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, n_terms: int, n_items: int) -> np.ndarray:
    """Scores (documents x items, 64-bit) of ``n`` documents with impacts ``value`` of ``term`` in ``row``."""
    total = np.zeros((n, n_items), np.int64)
    place = np.full(n_terms, -1, np.int64)
    for terms, weights in blocks:
        place[terms] = np.arange(len(terms))
        column = place[term]
        here = column >= 0
        used, narrow = np.unique(column[here], return_inverse=True)
        if len(used):
            impacts = np.zeros((n, len(used)))
            impacts[row[here], narrow] = value[here]
            total += (impacts @ weights[used]).astype(np.int64)
        place[terms] = -1
    return total


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, row, score) of the k best rows above 0 of each item: all that reach its k-th score, then by score and doc_id."""
    least = np.ones(scores.shape[1], np.int64)
    if len(scores) > k:
        least = np.maximum(least, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
    item, row = np.nonzero((scores >= least).T)
    score = scores[row, item]
    order = np.lexsort((ids[row], -score, item))
    item, row, score = item[order], row[order], score[order]
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    return item[rank < k], row[rank < k], score[rank < k]


def tile_top_k(rows: DataFrame, item_weights: list[tuple[np.ndarray, np.ndarray]], n_terms: int, n: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of each item, by place in ``item_weights``."""
    blocks = exact_blocks(item_weights, n_terms)
    n_items = len(item_weights)
    none = np.iinfo(np.int64).max  # stands for a null doc_id in order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3  # item, doc_id, score
        for batch in batches:
            for at in range(0, len(batch), DOC_ROWS):
                part = batch.slice(at, DOC_ROWS)
                size = part.column("size").to_numpy()
                border = part.column("term").offsets.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(part)), np.diff(border))
                term, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("term", "tf"))
                scores = tile_scores(blocks, row, term, impact(tf, size[row], n, total), len(part), n_terms, n_items)
                ids = part.column("doc_id").fill_null(none).to_numpy()
                item, found, score = _best(scores, ids, k)
                kept = [np.concatenate(x) for x in zip(kept, (item, ids[found], score), strict=True)]
                order = np.lexsort((kept[1], -kept[2], kept[0]))
                kept = [x[order] for x in kept]
                first = np.arange(len(order)) - np.searchsorted(kept[0], kept[0]) < k
                kept = [x[first] for x in kept]
        item, ids, score = kept
        yield pa.RecordBatch.from_pydict({"item": item.astype(np.int32), "doc_id": pa.array(ids, mask=ids == none), "score": score})

    return rows.mapInArrow(run, "item int, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    tiles = staged(item_tiles(items), "item-tiles")
    found = []
    for (tile,) in tiles.select("tile").distinct().orderBy("tile").toLocalIterator():
        own = tiles.where(F.col("tile") == tile).collect()  # one tile: bounded by TILE_TERMS
        vocabulary = sorted({t for r in own for t in r["terms"]})
        number = {t: i for i, t in enumerate(vocabulary)}
        rows = staged(postings(docs, vocabulary), "postings")
        n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in rows.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # at most TILE_TERMS
            df[r["term"]] = r["df"]
        w = np.array([weight(n, int(x)) for x in df], np.int64)
        terms = [np.array([number[t] for t in r["terms"]], np.int64) for r in own]
        weights = [(t, w[t] * np.array(r["counts"], np.int64)) for t, r in zip(terms, own, strict=True)]
        best = tile_top_k(rows, weights, len(vocabulary), n, total, k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], "item int, item_id long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        ranked = best.withColumn("rank", place).where(F.col("rank") <= k)
        found.append(staged(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
dt AS (SELECT d, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
it AS MATERIALIZED (SELECT i, term, count(*) AS c FROM (SELECT i, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i) GROUP BY ALL),
tf AS MATERIALIZED (SELECT d, term, count(*) AS tf FROM dt GROUP BY ALL),
n AS (SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY d),
a AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM n),
m AS (SELECT d, 25 + (75 * n * big_n) // l AS m FROM n, a),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, a GROUP BY term),
s AS (SELECT it.i, tf.d, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM it JOIN w USING (term) JOIN tf USING (term) JOIN m USING (d) GROUP BY ALL),
r AS (SELECT i, doc_id, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank FROM s JOIN d USING (d) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN i USING (i) WHERE rank <= 10"""
