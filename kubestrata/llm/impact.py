"""Exact top-k by inner product with an impact-ordered index, score at a time (operator 6).

Vectors become integers ``floor(scale * x)``. Rows are dealt into shards of about ``SHARD_ROWS`` by hash. The index of
a shard holds, for each dimension, posting segments: the rows whose value falls into one of ``LEVELS`` equal steps,
with the least and greatest value in the segment. For a query the impact of a segment is the most it can add to a
score beyond the least that its dimension adds to any. Segments are processed by descending impact into accumulators.
After each share of the postings an upper bound is known for every row: what it has got, and for the dimensions not
yet seen the greatest impacts left. The k best so far are scored exactly; a row whose bound is below the k-th of these
scores cannot be a member. Processing stops only when few rows are left that can be, or at the end of the postings,
and all of those are scored exactly. So the result is exact whatever the data, and only the work depends on them.

A block of queries is processed together: a segment's impacts on all of them are added to its rows at once. Queries meet
shards in blocks; each block returns k rows a query, and the k best of all shards are the result. Ties go
to the smaller vec_id. Vectors that are null, hold null or non-finite components or have no vec_id take no part, nor
do those whose number of dimensions is not the most common. Repeated rows count once; a query is not compared with
rows of its own vec_id. With fewer candidates than k, all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kubestrata.llm.store import staged
from kubestrata.llm.vectors import best, blocks, spread, usable

SHARD_ROWS, QUERY_ROWS, LEVELS, CHUNK_ROWS = 16384, 512, 16, 256
#: Shares of a shard's postings after which the bounds are looked at, and the share of rows that are few enough to score.
LOOKS, FEW = (0.9, 1.0), 0.2


class Shard:
    """The index of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        n, d = self.rows.shape
        low, high = self.rows.min(axis=0), self.rows.max(axis=0)
        level = self.level = ((self.rows - low) * LEVELS // (high - low + 1)).astype(np.int64)
        self.postings = np.argsort(level, axis=0, kind="stable").T.ravel()
        flat = (level + np.arange(d) * LEVELS).ravel()
        self.size = np.bincount(flat, minlength=d * LEVELS)
        self.first = np.cumsum(self.size) - self.size
        least = np.full(d * LEVELS, np.iinfo(np.int64).max)
        most = np.full(d * LEVELS, np.iinfo(np.int64).min)
        np.minimum.at(least, flat, self.rows.ravel())
        np.maximum.at(most, flat, self.rows.ravel())
        empty = self.size == 0
        self.least, self.most = np.where(empty, 0, least).reshape(d, LEVELS), np.where(empty, 0, most).reshape(d, LEVELS)
        self.empty = empty.reshape(d, LEVELS)
        bound = max(abs(int(low.min())), abs(int(high.max()))) if n else 0
        self.exact = self.rows.astype(np.float64) if bound * bound * d < 1 << 52 else self.rows  # float64 is exact below 2**53

    def _scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (self.exact[at] @ q.astype(self.exact.dtype)).astype(np.int64)

    def accumulated(self, tables: np.ndarray) -> np.ndarray:
        """(queries x rows): sums of ``tables`` (dimensions x levels x queries) over each row's levels, segment by segment for all queries."""
        n, d = self.level.shape
        out = np.empty((tables.shape[2], n))
        for a in range(0, n, CHUNK_ROWS):
            level = self.level[a : a + CHUNK_ROWS]
            total, part = np.zeros((len(level), tables.shape[2])), np.empty((len(level), tables.shape[2]))
            for j in range(d):
                np.take(tables[j], level[:, j], axis=0, out=part, mode="clip")
                total += part
            out[:, a : a + CHUNK_ROWS] = total.T
        return out

    def tops(self, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(vec_id, score) of the k best rows of each query."""
        n, d = self.rows.shape
        plans = [_Impacts(self, int(i), q) for i, q in zip(ids, queries, strict=True)]
        out: list = [None] * len(plans)
        for look in LOOKS:
            left = [i for i in range(len(plans)) if out[i] is None]
            once = [i for i in left if plans[i].together]
            tables = np.zeros((d * LEVELS, len(once)))
            for c, i in enumerate(once):
                seen = plans[i].order[: plans[i].upto(look)]
                tables[seen, c] = plans[i].gain.ravel()[seen] + plans[i].step
            sums = self.accumulated(tables.reshape(d, LEVELS, -1)) if once else None
            place = dict(zip(once, range(len(once)), strict=True))
            for i in left:
                p = plans[i]
                if p.together:
                    both = sums[place[i]]
                    seen = (both // p.step).astype(np.int64)
                    got = both - seen * p.step
                else:
                    got, seen = p.summed(look)
                out[i] = self._members(p, look, got, seen, k)
        return out

    def _members(self, p: _Impacts, look: float, got: np.ndarray, seen: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The k best rows if what was added up so far proves that few rows can be among them, or at the end; else None."""
        n, d = self.rows.shape
        other = self.ids != p.query_id
        bound = p.floor.sum() + got
        done = p.upto(look)
        if done < len(p.order):
            left = np.zeros(d)
            np.maximum.at(left, p.order[done:] // LEVELS, p.gain.ravel()[p.order[done:]])
            bound += np.concatenate([[0.0], np.cumsum(np.sort(left)[::-1])])[d - seen]
        lead = np.argpartition(got, n - k - 1)[n - k - 1 :] if n > k + 1 else np.arange(n)  # its own row may be among them
        lead = lead[other[lead]]
        need = np.sort(self._scores(lead, p.q))[-k] if len(lead) >= k else -np.inf
        members = np.flatnonzero(other & (bound >= need - p.slack))
        if len(members) > FEW * n and look < LOOKS[-1]:
            return None
        score = self._scores(members, p.q)
        first = np.lexsort((self.ids[members], -score))[:k]
        return self.ids[members][first], score[first]


class _Impacts:
    """What a query makes of a shard's segments: the impact of each, and their order by descending impact."""

    def __init__(self, shard: Shard, query_id: int, q: np.ndarray):
        self.shard, self.query_id, self.q = shard, query_id, q
        d = len(q)
        gain = np.where(q[:, None] > 0, q[:, None] * shard.most, q[:, None] * shard.least).astype(np.float64)
        self.floor = np.where(shard.empty, np.inf, gain).min(axis=1)
        self.gain = np.where(shard.empty, -1.0, gain - self.floor[:, None])
        order = np.argsort(-self.gain.ravel(), kind="stable")
        self.order = order[self.gain.ravel()[order] > 0]  # the rest adds nothing
        self.reach = np.cumsum(shard.size[self.order])
        most = self.gain.max(axis=1).sum()
        # one sum holds the gains and, above them, how many dimensions were seen; exact below 2**53
        self.step = 2.0 ** np.ceil(np.log2(max(most, 1.0) + 1))
        self.together = self.step * (d + 1) < 1 << 53
        self.slack = 1e-6 + 1e-9 * (np.abs(self.floor).sum() + most)  # rounding of the sums must not rule a member out

    def upto(self, look: float) -> int:
        """How many segments the share ``look`` of all postings takes."""
        if look >= 1 or not len(self.order):
            return len(self.order)
        return int(np.searchsorted(self.reach, look * self.reach[-1])) + 1

    def summed(self, look: float) -> tuple[np.ndarray, np.ndarray]:
        """(gains, dimensions seen) of each row, added up apart."""
        n = len(self.shard.rows)
        part = self.order[: self.upto(look)]
        if not len(part):
            return np.zeros(n), np.zeros(n, np.int64)
        size = self.shard.size[part]
        rows = np.concatenate([self.shard.postings[a : a + m] for a, m in zip(self.shard.first[part].tolist(), size.tolist(), strict=True)])
        return np.bincount(rows, np.repeat(self.gain.ravel()[part], size), n), np.bincount(rows, minlength=n)


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        ids = table.column("vec_id").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        query = table.column("query").to_numpy()
        out = {"query_id": [], "query": [], "vec_id": [], "score": []}
        if (role == 0).any():
            shard = Shard(ids[role == 0], v[role == 0])
            asked = np.flatnonzero(role == 1)
            for i, (found, score) in zip(asked, shard.tops(ids[asked], v[asked], k), strict=True):
                for name, value in (("query_id", np.full(len(found), ids[i])), ("query", np.full(len(found), query[i])), ("vec_id", found), ("score", score)):
                    out[name].append(value)
        return pa.table({c: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for c, x in out.items()})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, embedding) that ``is_query`` (on vec_id) picks."""
    whole = usable(vectors).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    rows = staged(whole.distinct().withColumn("query", F.xxhash64("vec_id", "v")), "integers")
    queries = rows.where(is_query)
    n, m = rows.count(), queries.count()
    shards, many = blocks(n, SHARD_ROWS), blocks(m, QUERY_ROWS)
    both = spread(rows, F.pmod("query", F.lit(shards)), F.lit(many), 0, "shard", "block").unionByName(
        spread(queries, F.pmod(F.hash("query"), F.lit(many)), F.lit(shards), 1, "block", "shard"))
    found = both.groupBy("shard", "block").applyInArrow(_search(k), "query_id long, query long, vec_id long, score long")
    return best(found, [F.col("score").desc(), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")
