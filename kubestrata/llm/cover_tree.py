"""Product codebooks by Lloyd's rounds over cover trees (operator 12).

Vectors become integers ``floor(scale * x)`` and are cut into consecutive parts, each with a codebook of its own. The tasks that
read the rows gather them into blocks of at most ``BLOCK_ROWS`` and build a cover tree over each part of a block: a
node's points lie within its radius of its centre, which is one of them; its children's centres, the node's own among them, are more
than half that radius apart (farthest first) and cover its points within half of it, unless more than ``FAN`` were
needed; then the rest go to their nearest centre, and the radii, which are measured, are larger. A tree's points are
in tree order, so a subtree is a run of them and its sum is a difference of two cumulative sums.

A round sends the codebooks (``entries * dimensions`` integers) to the blocks. A node whose nearest entry leads the
second nearest by more than twice the radius gives its whole run to that entry, by the triangle inequality; only other
nodes are opened, and the points of leaves that stay ambiguous are compared exactly in 64-bit integers. Each task
returns one sum and count for each entry; only sums over all tasks come to the driver. Blocks are written once and read in each round.

Rows whose vector is null or empty, holds null or non-finite components, or has not the most common number of dimensions (of
equally common ones the smallest) take no part. Rows without a vec_id do, as the last by order; repeated rows are rows of
their own, but are one candidate for the first codebook. Components beyond ``LARGEST`` after scaling count as that, so that all
distances fit 64 bits. Dimensions that cannot be cut evenly make the first parts longer by one. With fewer rows than entries, the
codebooks are that much shorter. An empty table gives an empty result. Columns besides vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kubestrata.functions.ordered import salted_join
from kubestrata.llm.store import staged

BLOCK_ROWS, LEAF, FAN, LARGEST = 4096, 8, 64, 1 << 25
#: Bounds are floats; a lead must be larger by this share of the distances to count.
SLACK = 1e-9
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096

BLOCK_DDL = "vec_ids array<long>, labels array<string>, points binary, trees array<struct<orders binary, spans binary, radii binary>>"
_BLOCK = pa.schema([("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("points", pa.binary()),
                    ("trees", pa.list_(pa.struct([("orders", pa.binary()), ("spans", pa.binary()), ("radii", pa.binary())])))])


@dataclass
class Tree:
    """Nodes by level, the root first. ``spans`` has for each node: centre (a row), first and last place in ``order``, first child, children."""

    order: np.ndarray
    spans: np.ndarray
    radii: np.ndarray

    @staticmethod
    def over(points: np.ndarray) -> Tree:
        at = points.astype(np.float64)
        order, spans, radii = np.arange(len(at)), [[0, 0, len(at), 0, 0]], []
        distances = [np.sqrt(((at - at[0]) ** 2).sum(axis=1))]
        for node in spans:  # grows while it is walked
            centre, start, end, _, _ = node
            near = distances[len(radii)]
            distances[len(radii)] = None
            radius = near.max()
            radii.append(radius)
            if end - start <= LEAF or radius == 0:
                continue
            own = order[start:end]
            mine, centres, child = at[own], [centre], np.zeros(end - start, np.int64)
            while len(centres) < FAN and near[far := int(near.argmax())] > radius / 2:
                reach = np.sqrt(((mine - mine[far]) ** 2).sum(axis=1))
                closer = reach < near
                child[closer] = len(centres)
                near = np.where(closer, reach, near)
                centres.append(int(own[far]))
            turn = np.argsort(child, kind="stable")
            order[start:end], near = own[turn], near[turn]
            border = np.concatenate([[0], np.cumsum(np.bincount(child, minlength=len(centres)))])
            node[3:] = len(spans), len(centres)
            for c, a, b in zip(centres, border[:-1].tolist(), border[1:].tolist(), strict=True):
                spans.append([c, start + a, start + b, 0, 0])
                distances.append(near[a:b])
        return Tree(order, np.array(spans, np.int64), np.array(radii))


def exact_nearest(points: np.ndarray, book: np.ndarray, rows: int = 4096) -> np.ndarray:
    """The entry nearest to each point in 64-bit integers, of equally near ones the first."""
    out = [((points[i : i + rows, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(points), rows)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs of ``size`` from ``start`` on."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def assign(tree: Tree, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first place, behind the last, entry) of runs of the tree order, and whether each was given as a whole subtree."""
    _, first = np.unique(book, axis=0, return_index=True)
    first = np.sort(first)  # of equal entries the first takes all
    own, at = book[first], points.astype(np.float64)
    entries = own.astype(np.float64)
    starts, ends, entry, whole = [], [], [], []
    nodes = np.zeros(min(1, len(points)), np.int64)
    while len(nodes):
        centre, start, end, child, children = tree.spans[nodes].T
        d = np.sqrt(((at[centre][:, None, :] - entries[None]) ** 2).sum(axis=2))
        best = d.argmin(axis=1)
        two = np.partition(d, 1, axis=1)[:, :2] if len(own) > 1 else np.column_stack([d[:, 0], np.full(len(d), np.inf)])
        sure = two[:, 1] - two[:, 0] > 2 * tree.radii[nodes] + SLACK * (1 + two[:, 0] + tree.radii[nodes])
        leaf = ~sure & (children == 0)
        place = _runs(start[leaf], (end - start)[leaf])
        starts += [start[sure], place]
        ends += [end[sure], place + 1]
        entry += [first[best[sure]], first[exact_nearest(points[tree.order[place]], own)]]
        whole += [np.ones(sure.sum(), bool), np.zeros(len(place), bool)]
        open_ = ~sure & (children > 0)
        nodes = _runs(child[open_], children[open_])
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return join(starts, np.int64), join(ends, np.int64), join(entry, np.int64), join(whole, bool)


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label (as text) and v, the integers, of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").first()
    most, least = F.lit(float(LARGEST)), F.lit(float(-LARGEST))
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * scale).cast("double"), most), least).cast("int"))
    return rows.where(F.size("v") == (common["d"] if common else 0)).select("vec_id", "label", whole.alias("v"))


def _borders(d: int, parts: int) -> list[int]:
    return [0, *np.cumsum([d // parts + (k < d % parts) for k in range(parts)]).tolist()]


def blocks(rows: DataFrame, parts: int = PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of ``usable`` in blocks, each with a tree for each part; built where the rows lie."""

    def block(ids: list, labels: list, points: np.ndarray) -> pa.RecordBatch:
        cut = _borders(points.shape[1], parts)
        trees = [Tree.over(points[:, a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        packed = [{"orders": t.order.astype(np.int32).tobytes(), "spans": t.spans.astype(np.int32).tobytes(), "radii": t.radii.tobytes()} for t in trees]
        return pa.RecordBatch.from_pylist([{"vec_ids": ids, "labels": labels, "points": points.tobytes(), "trees": packed}], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while len(batch):
                held.append(batch.slice(0, block_rows - n))
                n, batch = n + len(held[-1]), batch.slice(block_rows - n)
                if n == block_rows:
                    yield from made(held)
                    held, n = [], 0
        if held:
            yield from made(held)

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        points = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        yield block(table.column("vec_id").to_pylist(), table.column("label").to_pylist(), points)

    return rows.mapInArrow(run, BLOCK_DDL)


def _parts(block: dict, parts: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """(tree, points) of each part of a block."""
    points = np.frombuffer(block["points"], np.int32).reshape(len(block["vec_ids"]), -1).astype(np.int64)
    cut = _borders(points.shape[1], parts)
    for t, a, b in zip(block["trees"], cut, cut[1:], strict=False):
        yield Tree(np.frombuffer(t["orders"], np.int32), np.frombuffer(t["spans"], np.int32).reshape(-1, 5), np.frombuffer(t["radii"])), points[:, a:b]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def sums(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(part, entry, j, total): component sums of the points of each entry; at j = -1 their number, at j = -2 how many came in whole subtrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), b.shape[1] + 2), np.int64) for b in books]
        for block in _each(batches):
            for own, book, (tree, points) in zip(total, books, _parts(block, len(books)), strict=True):
                upto = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[tree.order], axis=0)])
                start, end, entry, whole = assign(tree, points, book)
                np.add.at(own, entry, np.column_stack([(end - start) * whole, end - start, upto[end] - upto[start]]))
        for part, own in enumerate(total):
            entry, j = np.indices(own.shape)
            yield pa.RecordBatch.from_pydict({"part": np.full(own.size, part, np.int32), "entry": entry.ravel().astype(np.int32),
                                              "j": j.ravel().astype(np.int32) - 2, "total": own.ravel()})

    each = trees.mapInArrow(run, "part int, entry int, j int, total long")
    return each.groupBy("part", "entry", "j").agg(F.sum("total").alias("total"))


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the first rows by vec_id (nulls last)."""
    first = rows.select("vec_id", "v").distinct().orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return []
    v = np.array([r["v"] for r in first], np.int64)
    cut = _borders(v.shape[1], parts)
    return [v[:, a:b] for a, b in zip(cut, cut[1:], strict=False)]


def fitted(trees: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after ``rounds`` of Lloyd's method."""
    for _ in range(rounds):
        new = [np.concatenate([np.zeros((len(b), 2), np.int64), b], axis=1) for b in books]
        for r in sums(trees, books).collect():  # entries * (dimensions + 2 * parts) rows, whatever the input
            new[r["part"]][r["entry"], r["j"] + 2] = r["total"]
        books = [np.where(n[:, 1:2] > 0, n[:, 2:] // np.maximum(n[:, 1:2], 1), b) for n, b in zip(new, books, strict=True)]
    return books


def coded(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _each(batches):
            n = len(block["vec_ids"])
            codes, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
            for k, (book, (tree, points)) in enumerate(zip(books, _parts(block, len(books)), strict=True)):
                start, end, entry, _ = assign(tree, points, book)
                codes[tree.order[_runs(start, end - start)], k] = np.repeat(entry, end - start)
                error += ((points - book[codes[:, k]]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(block["vec_ids"], pa.int64()), "label": pa.array(block["labels"], pa.string()),
                                              "code": [c.tobytes().hex() for c in codes], "error": error})

    return trees.mapInArrow(run, "vec_id long, label string, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def product_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for the rows of ``vectors`` (vec_id, embedding, label) that take part."""
    rows = usable(vectors, scale)
    trees = staged(blocks(rows, parts), "cover-trees")
    books = fitted(trees, first_books(rows, parts, entries), rounds)
    found = staged(coded(trees, books).select("*", F.coalesce("label", F.lit("")).alias("_label"), F.col("label").isNull().alias("_none")), "codes")
    totals = staged(found.groupBy("_label", "_none").agg(F.sum("error").alias("label_error")), "label-errors")
    with_totals = salted_join(found, totals, ["_label", "_none"], ["vec_id", "code"])
    return with_totals.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """SQL for dimensions that ``parts`` divides: one pair of tables for each round."""
    sql = [f"""
k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, i // (len(v) // {parts}) AS part, i % (len(v) // {parts}) AS j, v[i + 1] AS x FROM (SELECT *, unnest(range(len(v))) AS i FROM k)),
s AS (SELECT v, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM (SELECT DISTINCT vec_id, v FROM k)),
c0 AS MATERIALIZED (SELECT i // (len(v) // {parts}) AS part, e, i % (len(v) // {parts}) AS j, v[i + 1] AS c FROM (SELECT *, unnest(range(len(v))) AS i FROM s WHERE e < {entries}))"""]
    for t in range(rounds + 1):
        sql.append(f"""
a{t} AS MATERIALIZED (SELECT r, part, min(d * {entries} + e) AS best FROM
      (SELECT r, p.part, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM p JOIN c{t} c ON p.part = c.part AND p.j = c.j GROUP BY ALL) GROUP BY ALL)""")
        if t < rounds:
            sql.append(f"""
c{t + 1} AS MATERIALIZED (SELECT c.part, c.e, c.j, CAST(CASE WHEN n > 0 THEN (t - ((t % n) + n) % n) // n ELSE c.c END AS BIGINT) AS c FROM c{t} c LEFT JOIN
      (SELECT p.part, a.best % {entries} AS e, p.j, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM a{t} a JOIN p ON a.r = p.r AND a.part = p.part GROUP BY ALL) m
      ON c.part = m.part AND c.e = m.e AND c.j = m.j)""")
    sql.append(f"""
o AS (SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r)""")
    return "WITH " + ",".join(sql) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, e, j)) FROM c{rounds}) AS codebooks_sha256
FROM o JOIN k ON o.r = k.r"""


ORACLE = _oracle()
