"""Token ids of whole texts by the tokenizers library, a batch of documents at a time.

The vocabulary of ``word_bpe_49k.json`` never joins characters across white space: its normaliser and its splitting
rule work between white spaces only. So a text is cut at ASCII white space, each different piece of a batch is encoded
once by the library, and the ids are put together in order. A piece of Latin letters with ASCII marks behind them
needs no normalising but lower case, so the library's model encodes its letters directly. That gives the ids
of the whole text (``tests/llm/test_documents.py`` compares them with the library's own) at several times the speed. A
tokenizer with any other normaliser or splitting rule encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces and words kept from batch to batch in one Python worker, and the longest that is kept.
CACHED, CACHED_LENGTH = 500_000, 48
#: Bytes of text encoded at once; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: The normaliser and splitting rule under which texts may be cut at white space (fixed values).
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Letters that NFC leaves alone and whose lower case is one letter, with ASCII marks but no apostrophe or < behind them.
_LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
#: Byte-level vocabularies write these bytes as characters from 256 on.
_BYTE_CHARS = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}

_loaded: dict[str, Encoder] = {}


class Encoder:
    """A tokenizer with its cache of encoded pieces; one per Python worker and path."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code, self.dtype = ("I", np.uint32) if self.tokenizer.get_vocab_size() > 1 << 16 else ("H", np.uint16)
        rules = json.loads(self.tokenizer.to_str())
        names = [n.get("type") for n in (rules["normalizer"] or {}).get("normalizers", [])]
        cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_piece = names == NORMALIZERS and cuts[0].get("pattern") == {"Regex": SPLIT} and not rules["post_processor"]
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _loaded:
            _loaded[path] = Encoder(path)
        return _loaded[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        seen = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
        out = self.words[word] = array(self.code, [t.id for t in self.model.tokenize(seen)]).tobytes()
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        for cache in (self.known, self.words, self.marks):
            if len(cache) > CACHED:
                cache.clear()
        known, words, marks = self.known, self.words, self.marks
        out = list(map(known.get, pieces))
        other = []
        for i, ids in enumerate(out):
            if ids is None:
                piece = pieces[i]
                if (m := _LATIN.fullmatch(piece)) and len(piece) <= CACHED_LENGTH:
                    word, mark = m[1].lower(), m[2]
                    if mark not in marks:
                        marks[mark] = self._whole([mark])[0]
                    out[i] = known[piece] = (words.get(word) or self._word(word)) + marks[mark]
                else:
                    other.append(i)
        for i, ids in zip(other, self._whole([pieces[i] for i in other]), strict=True):
            out[i] = ids
            if len(pieces[i]) <= CACHED_LENGTH:
                known[pieces[i]] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, border before each text and after the last). A null text is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.by_piece:
            each = self._whole(texts.to_pylist())
            size = np.fromiter(map(len, each), np.int64, len(each)) // np.dtype(self.dtype).itemsize
            return np.frombuffer(b"".join(each), self.dtype), np.concatenate([[0], np.cumsum(size)])
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        pieces = self._pieces(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // np.dtype(self.dtype).itemsize
        pool = np.frombuffer(b"".join(pieces), self.dtype)
        which = coded.indices.to_numpy(zero_copy_only=False)
        per_piece = size[which]
        border = np.concatenate([[0], np.cumsum(per_piece)])
        ids = pool[np.repeat((np.cumsum(size) - size)[which] - border[:-1], per_piece) + np.arange(border[-1])]
        at = lists.offsets.to_numpy().astype(np.int64)
        return ids, border[at - at[0]]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part holds more than ``most`` bytes of text, unless it is one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
