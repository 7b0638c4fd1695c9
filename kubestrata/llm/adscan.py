"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan (operator 10).

Centroids come from k-means on a bounded sample (``SAMPLE_ROWS`` rows, the first by hash of their id); every row of
the table is put into the list of its nearest centroid. A query probes the lists of its nearest centroids. In a list
the vectors lie turned by a random rotation, in blocks of columns: after each block the partial squared distance, scaled
up to all dimensions, is tested against the k-th best distance found so far; if it is larger by more than chance allows
(``(1 + EPSILON / sqrt(dimensions seen)) ** 2``), the candidate is abandoned. What survives all blocks is measured on
the original vectors in double precision.

Lists meet queries in blocks of bounded size: a list with a third of all rows is as many blocks as it needs. Each
query probes the share ``PROBED`` of the lists, and more if those hold fewer than k other rows. Ties go to the smaller vec_id. Vectors
that are null, zero, or hold null or non-finite components, or have no vec_id take no part, nor do those whose number
of dimensions is not the most common. Repeated rows count once; a query is not compared with rows of its own vec_id.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kubestrata.llm.store import staged
from kubestrata.llm.vectors import best, blocks, spread, usable

SAMPLE_ROWS, LIST_ROWS, MOST_LISTS, ROUNDS = 20_000, 512, 4096, 8
#: Share of the lists that a query probes. Vectors without much structure need a large one for a recall above 0.9.
PROBED = 0.6
BLOCK_ROWS, QUERY_ROWS, COLUMNS, EPSILON = 4096, 512, 16, 2.1
#: Candidates measured in full to start the test.
FIRST = 64


def centroids(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """k-means on the sample; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centre = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(ROUNDS):
        own = nearest(sample, centre, 1)[:, 0]
        total, count = np.zeros_like(centre), np.bincount(own, minlength=len(centre))
        np.add.at(total, own, sample)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    far = (centre**2).sum(axis=1) - 2 * x @ centre.T
    return np.argsort(far, axis=1, kind="stable")[:, :k]


def rotation(d: int, seed: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def scan(rows: np.ndarray, turned: np.ndarray, q: np.ndarray, q_turned: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``rows``, distance) of the k nearest that survive the tests."""
    d = rows.shape[1]
    head = np.arange(min(max(FIRST, k), len(rows)))
    kept, near = head, ((rows[head] - q) ** 2).sum(axis=1)
    limit = np.partition(near, k - 1)[k - 1] if len(near) >= k else np.inf
    alive = np.arange(len(head), len(rows))
    part = np.zeros(len(alive))
    for a in range(0, d, COLUMNS):
        block = turned[a // COLUMNS][alive]
        part = part + ((block - q_turned[a : a + COLUMNS]) ** 2).sum(axis=1)
        seen = min(d, a + COLUMNS)
        if seen < d:
            stay = part * (d / seen) <= limit * (1 + EPSILON / np.sqrt(seen)) ** 2
            alive, part = alive[stay], part[stay]
    rest = alive[part <= limit * (1 + 1e-9)] if np.isfinite(limit) else alive
    kept, near = np.concatenate([kept, rest]), np.concatenate([near, ((rows[rest] - q) ** 2).sum(axis=1)])
    near = np.sqrt(near)
    first = np.lexsort((ids[kept], near))[:k]
    return kept[first], near[first]


def _search(k: int, turn: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        role, ids, query = (table.column(c).to_numpy() for c in ("role", "vec_id", "query"))
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        out = {"query_id": [], "query": [], "vec_id": [], "score": []}
        order = np.flatnonzero(role == 0)
        order = order[np.lexsort((query[order], ids[order]))]
        rows, row_ids = v[order], ids[order]
        whole = rows @ turn
        turned = [np.ascontiguousarray(whole[:, a : a + COLUMNS]) for a in range(0, v.shape[1], COLUMNS)]
        for i in np.flatnonzero(role == 1) if len(order) else ():
            if (own := row_ids == ids[i]).any():
                other = ~own
                at, far = scan(rows[other], [b[other] for b in turned], v[i], v[i] @ turn, row_ids[other], k)
                found = row_ids[other][at]
            else:
                at, far = scan(rows, turned, v[i], v[i] @ turn, row_ids, k)
                found = row_ids[at]
            for name, value in (("query_id", np.full(len(found), ids[i])), ("query", np.full(len(found), query[i])), ("vec_id", found), ("score", far)):
                out[name].append(value)
        kinds = {"score": np.float64}
        return pa.table({c: np.concatenate(x).astype(kinds.get(c, np.int64)) if x else np.zeros(0, kinds.get(c, np.int64)) for c, x in out.items()})

    return run


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, probed: float = PROBED) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) for the rows of ``vectors`` that ``is_query`` (on vec_id) picks."""
    whole = usable(vectors, nonzero=True).withColumn("query", F.xxhash64("vec_id", "v"))
    sample = np.array([r[0] for r in whole.orderBy("query").limit(SAMPLE_ROWS).select("v").collect()], np.float64)
    n = whole.count()
    sample = sample.reshape(len(sample), -1) if len(sample) else np.zeros((1, 1))
    lists = min(MOST_LISTS, len(sample), blocks(n, LIST_ROWS))
    probes = math.ceil(probed * lists)
    centre, turn = centroids(sample, lists), rotation(sample.shape[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            own = nearest(x, centre, 1)[:, 0] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("vec_id", "query", "v")} | {"list": own.astype(np.int64)})

    placed = staged(whole.select("vec_id", "query", "v").mapInArrow(assign, "vec_id long, query long, v array<double>, list long"), "lists")
    sizes = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["count"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            near = nearest(x, centre, lists) if batch.num_rows else np.zeros((0, lists), np.int64)
            held = np.cumsum(sizes[near], axis=1)
            need = np.maximum(probes, 1 + (held < k + 1).sum(axis=1))
            cols = {c: batch.column(c) for c in ("vec_id", "query", "v")}
            yield pa.RecordBatch.from_pydict(cols | {"probes": [near[i, : need[i]].tolist() for i in range(len(near))]},
                                             schema=pa.schema([*[batch.schema.field(c) for c in cols], ("probes", pa.list_(pa.int64()))]))

    queries = placed.where(is_query).mapInArrow(probe, "vec_id long, query long, v array<double>, probes array<long>")
    queries = staged(queries.select("vec_id", "query", "v", F.explode("probes").alias("list")), "probes")
    asked = queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("blocks"))
    parts = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts")).join(asked, "list")
    parts = F.broadcast(parts)  # at most MOST_LISTS rows
    both = spread(placed.join(parts, "list"), F.pmod("query", "parts"), F.col("blocks"), 0, "part", "block").unionByName(
        spread(queries.join(parts, "list"), F.pmod(F.hash("query"), F.col("blocks")), F.col("parts"), 1, "block", "part"))
    found = both.drop("parts", "blocks").groupBy("list", "part", "block").applyInArrow(_search(k, turn), "query_id long, query long, vec_id long, score double")
    return best(found, [F.col("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")
