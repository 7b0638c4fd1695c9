"""Document quality by regularised quadratic discriminant analysis (operator 9).

Statistics of each text are transformed so that a normal density is a fair model of them. For each class the mean and
the covariance are sums over all labelled documents of the training folds, made where the rows lie; only those sums
(``d * d`` numbers for each class) come to the driver. A class covariance is shrunk towards the pooled one and towards
a multiple of the identity, factored once (Cholesky), and the factors score every document: the difference of the two
log densities, from Mahalanobis distances, with the log prior, through a logistic function.

Inputs of a score are statistics of the text alone. Null or empty texts have statistics like any other and get a
score. A document without a doc_id is in no fold and trains nothing. Repeated rows are scored alike; a document with
several labels counts once for each. If a class has fewer than two labelled documents, every score is the share of
label 1 (0.5 without labels). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kubestrata.llm.store import carried, plain, restored, row_key, staged
from kubestrata.llm.tokens import slices
from kubestrata.llm.words import text_bytes, word_hashes, word_spans

FEATURES = [
    "bytes", "words", "word_length", "symbols", "stops", "digits", "capitals", "lines", "line_length", "short_words",
    "entropy", "different_words", "most_common", "different_pairs", "repeated_lines", "high_bytes", "capital_start",
]
THRESHOLD = 0.3
#: Weight of the pooled covariance and of the identity in a class covariance.
TO_POOLED, TO_IDENTITY = 0.5, 0.1
SLICE_BYTES = 1 << 20


def _class(characters: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(characters.encode())] = 1
    return out


_CLASSES = np.stack([
    _class("#$%&*+/<=>@[\\]^_`{|}~"), _class(".,;:!?'\"()-"), _class("0123456789"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _class("\n"), (np.arange(256) >= 128).astype(float),
])


def _logit(x: np.ndarray, soft: float = 0.002) -> np.ndarray:
    return np.log((x + soft) / (1 - x + soft))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    raw, at = text_bytes(texts)
    n, size = len(texts), np.diff(at)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * 256 + raw, minlength=n * 256).reshape(n, 256)
    some = np.maximum(size, 1)
    share = counts / some[:, None]
    symbols, stops, digits, capitals, newlines, high = (counts @ _CLASSES.T).T
    entropy = -np.sum(share * np.log(np.maximum(share, 1e-12)), axis=1)
    words, border = word_hashes(texts)
    n_words = np.diff(border)
    some_words = np.maximum(n_words, 1)
    blank = counts[:, [32, 9, 10, 11, 12, 13]].sum(axis=1)
    begin, _, first = word_spans(raw, at)
    has = first[1:] > first[:-1]
    behind = np.append(begin[1:], 0)[: len(begin)]  # where the next word begins, or the text ends
    behind[first[1:][has] - 1] = at[1:][has]
    of = np.repeat(np.arange(n), np.diff(first))
    starts = np.bincount(of[(raw[begin] >= 65) & (raw[begin] <= 90)], minlength=n)
    short = np.bincount(of[behind - begin <= 4], minlength=n)
    rows = np.zeros((n, 4))
    for i in range(n):
        own = words[border[i] : border[i + 1]]
        if not len(own):
            continue
        _, each = np.unique(own, return_counts=True)
        pairs = own[:-1] * np.uint64(3) + own[1:]
        lines = texts[i].as_py().split("\n")
        rows[i] = len(each) / len(own), each.max() / len(own), len(np.unique(pairs)) / max(1, len(pairs)), 1 - len(set(lines)) / len(lines)
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), np.log1p((size - blank) / some_words), _logit(symbols / some), _logit(stops / some),
        _logit(digits / some), _logit(capitals / some), np.log1p(newlines), np.log1p(size / (newlines + 1)),
        _logit(np.minimum(short / some_words, 1)), entropy, _logit(rows[:, 0]), _logit(rows[:, 1]), _logit(rows[:, 2]),
        _logit(rows[:, 3]), _logit(high / some), _logit(np.minimum(starts / some_words, 1)),
    ])


def with_statistics(docs: DataFrame, names: list[str]) -> DataFrame:
    """Columns ``names`` of ``docs`` and ``x``, the statistics of the whole text."""
    made = docs.select(*carried(names), F.col("text").cast("string").alias("text"))
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in made.schema if f.name != "text"), "x array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                x = statistics(part.column("text"))
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
                cols = {c: part.column(c) for c in part.schema.names if c != "text"}
                yield pa.RecordBatch.from_pydict(cols | {"x": flat})

    return made.mapInArrow(run, ddl).select(*restored(names), "x")


@dataclass
class Discriminant:
    """Means, inverted Cholesky factors, log normalisers and log priors of classes 0 and 1; or a constant score."""

    mean: np.ndarray | None
    inverse: np.ndarray | None
    offset: np.ndarray | None
    constant: float = 0.5

    @staticmethod
    def of(count: np.ndarray, first: np.ndarray, second: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
        """From each class's number of rows, sum of x and sum of x x'."""
        if count.min() < 2:
            return Discriminant(None, None, None, float(count[1] / count.sum()) if count.sum() else 0.5)
        mean = first / count[:, None]
        scatter = second - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
        pooled = scatter.sum(axis=0) / count.sum()
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))  # shrink correlations, not units
        inverse, offset = [], []
        for c in (0, 1):
            own = (1 - to_pooled) * scatter[c] / count[c] + to_pooled * pooled
            own = own / np.outer(scale, scale)
            own = (1 - to_identity) * own + to_identity * max(np.trace(own) / len(own), 1e-6) * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            inverse.append(np.linalg.inv(factor) / scale)
            offset.append(-np.log(np.diag(factor)).sum() + np.log(count[c] / count.sum()))
        return Discriminant(mean, np.stack(inverse), np.array(offset))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.constant)
        log = []
        for c in (0, 1):
            z = np.zeros_like(x)
            for j in range(x.shape[1]):  # in one order, so that a row's score does not depend on its batch
                z += (x[:, j : j + 1] - self.mean[c, j]) * self.inverse[c, :, j]
            log.append(self.offset[c] - 0.5 * (z**2).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Fold 0 of 5 by crc32 of the id as text; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(x: DataFrame, labels: DataFrame, **shrink: float) -> Discriminant:
    """Fit on ``x`` (doc_id, x) and ``labels`` (doc_id, quality), without the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            rows = batch.column("x").flatten().to_numpy().reshape(-1, d)
            y = batch.column("_y").to_numpy()
            for c in (0, 1):
                own = rows[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_pydict({"c": [0, 1], "sums": list(total)}, schema=pa.schema([("c", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    parts = x.join(known, F.col("doc_id") == F.col("_id")).select("_y", "x").mapInArrow(run, "c int, sums array<double>")
    sums = parts.select("c", F.posexplode("sums").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * d)
    total = np.zeros((2, 1 + d + d * d))
    for r in sums:
        total[r["c"], r["i"]] = r["v"]
    return Discriminant.of(total[:, 0], total[:, 1 : d + 1], total[:, d + 1 :].reshape(2, d, d), **shrink)


def with_scores(x: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """Replace ``x`` by score and predicted."""
    names = [c for c in x.columns if c != "x"]
    made = x.select(*carried(names), "x")
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in made.schema if f.name != "x"), "score double, predicted int"])
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column("x").flatten().to_numpy().reshape(-1, d))
            cols = {c: batch.column(c) for c in batch.schema.names if c != "x"}
            yield pa.RecordBatch.from_pydict(cols | {"score": score, "predicted": (score >= threshold).astype(np.int32)})

    return made.mapInArrow(run, ddl).select(*restored(names), "score", "predicted")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    x = staged(with_statistics(docs, ["doc_id"]), "statistics")
    return with_scores(x, fit(x, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    key = docs.select("doc_id", "text", *row_key())
    x = staged(with_statistics(key, ["doc_id", "_k", "_t"]), "statistics")
    good = with_scores(x, fit(x, labels)).where("predicted = 1").select("_k", "_t").distinct()
    names = docs.columns
    return docs.select(*carried(names), *row_key()).join(good, ["_k", "_t"], "left_semi").select(*restored(names))


__all__ = ["FEATURES", "Discriminant", "accepted", "fit", "held_out", "plain", "score_documents", "statistics", "with_scores", "with_statistics"]
