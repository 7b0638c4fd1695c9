"""Words of whole texts as 64-bit hashes, a batch at a time, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_U = np.uint64
#: One random odd number per byte value, and the base of the polynomial; any fixed draw does.
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[_U(1)], np.full(max(n, 1024), _BASE)]), dtype=np.uint64)
    return _powers[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64; fixed constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, border before each text and after the last). A null text is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte behind the last, border of each text's words): runs other than space, tab, ..., return."""
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True  # words end where texts end
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, at)


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, border of each text's words)."""
    raw, at = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")) if lower else texts)
    begin, end, border = word_spans(raw, at)
    if not len(begin):
        return np.zeros(0, np.uint64), border
    size = end - begin
    which = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    place = which - np.repeat(begin, size)
    terms = _BYTE[raw[which]] * powers(int(size.max()))[place]
    return scramble(np.add.reduceat(terms, np.cumsum(size) - size)), border


def shingle_hashes(words: np.ndarray, border: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words, border of each text's runs). A text of 1 to n - 1 words is one run of them all."""
    count = np.diff(border)
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(runs)])
    first = np.repeat(border[:-1] - out_at[:-1], runs) + np.arange(out_at[-1])
    stop = np.repeat(border[1:], runs)
    total = np.zeros(len(first), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        here = first + k
        total = total * _BASE + np.where(here < stop, padded[here], _U(0)) + _U(k + 1)
    return scramble(total), out_at
