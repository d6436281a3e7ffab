"""Byte-level BPE with the tokenizers library, each distinct word encoded once.

``WordCache`` splits texts into the pieces that the tokenizer itself would split them into (a letter, digit, other or white
space run, with one leading space), looks the pieces up in a bounded cache of this process by a 64-bit hash and lets the
tokenizers library encode those that are missing. Texts with characters past U+024F, with white space other than
``space \\t \\n \\r`` or with a string that the vocabulary adds as a token of its own (``<|endoftext|>``) go through the library
as they are, so the ids are those of the library with add_special_tokens=False for every text.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textkernel as K

#: Bytes of text that are split into pieces at a time.
BLOCK_BYTES = 1 << 18

_LETTER, _NUMBER, _OTHER, _SPACE, _UNSAFE = range(5)
_LIMIT = 0x250


def _kinds() -> np.ndarray:
    kinds = np.full(_LIMIT + 1, _UNSAFE, np.uint8)
    for c in range(_LIMIT):
        major = unicodedata.category(chr(c))[0]
        if major in "LNPS":
            kinds[c] = {"L": _LETTER, "N": _NUMBER}.get(major, _OTHER)
    kinds[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
    return kinds


def _shown() -> np.ndarray:
    """The character that byte-level models have for each byte: itself if it is printable, else the next past U+00FF."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    out = np.zeros(256, "<u4")
    out[plain] = plain
    rest = np.setdiff1d(np.arange(256), plain)
    out[rest] = 0x100 + np.arange(len(rest))
    return out


_KIND, _SHOWN = _kinds(), _shown()
_SPREAD = K.mix(np.arange(7, _LIMIT + 8, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def load(path: str):
    """The tokenizer of the file, in one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def boundaries(c: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start. c: code points; first: at the first of each document."""
    n = len(c)
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    joined = np.zeros(n, bool)  # the run takes the blank before it along
    joined[1:] = (c[:-1] == 0x20) & ~first[1:]
    start = run & (space | ~joined)
    last = np.zeros(n, bool)  # of white space that other text follows
    last[:-1] = space[:-1] & run[1:] & ~first[1:]
    start |= last
    for i in np.flatnonzero(start[:-1] & (c[:-1] == 0x27) & run[1:] & (kind[1:] == _LETTER) & ~first[1:]):  # 's 't 'm 'd 're 've 'll
        a = int(c[i + 1])
        two = i + 2 < n and not first[i + 2] and (a, int(c[i + 2])) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C))
        if a in (0x73, 0x74, 0x6D, 0x64) or two:
            end = i + (2 if a in (0x73, 0x74, 0x6D, 0x64) else 3)
            start[i + 1] = False
            if end < n:
                start[end] = True
    return start


class WordCache:
    """ids of whole documents. slots: entries of the cache (a power of two); pool: ids it may hold before it starts anew."""

    def __init__(self, path: str, slots: int = 1 << 20, pool: int = 6 << 20):
        self.tokenizer, self.slots, self.pool_size = load(path), slots, pool
        before = self.tokenizer.pre_tokenizer
        self.by_words = type(self.tokenizer.model).__name__ == "BPE" and self.tokenizer.normalizer is None and type(before).__name__ == "ByteLevel" and not before.add_prefix_space and before.use_regex
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.at = np.zeros(self.slots, np.int32)
        self.count = np.zeros(self.slots, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _add(self, hashes: np.ndarray, ids: list[list[int]], grow: bool) -> None:
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.int32, int(count.sum()))
        if self.used + len(flat) > self.pool_size and not grow:
            self._clear()
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        slot = (hashes >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        self.keys[slot], self.count[slot] = hashes, count
        self.at[slot] = self.used + np.cumsum(count) - count
        self.used += len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray, grow: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the documents' ids) of a block. grow: the pool may pass its size, for the block's own pieces."""
        n_docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n_docs + 1, np.int64)
        raw = data.tobytes()
        text = raw.decode("utf-8", "replace")
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        at = lead[offsets]  # documents' first code points
        if at[-1] != len(c) or not self.by_words:  # not UTF-8; one document after the other
            return self._plainly([bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        kind = _KIND[np.minimum(c, _LIMIT)]
        unsafe = np.zeros(len(c) + 1, np.int64)
        np.cumsum(kind == _UNSAFE, out=unsafe[1:])
        odd = unsafe[at[1:]] > unsafe[at[:-1]]
        for token in self.added:
            found = raw.find(token)
            while found >= 0:
                doc = int(np.searchsorted(offsets, found, "right")) - 1
                odd[doc] = True
                found = raw.find(token, max(found + 1, int(offsets[doc + 1]) - len(token) + 1))
        if odd.any():
            return self._mixed(data, offsets, odd)
        first = np.zeros(len(c) + 1, bool)
        first[at] = True
        starts = np.flatnonzero(boundaries(c, kind, first[:-1]))
        ends = np.append(starts[1:], len(c))
        h = K.span_hash(K.prefix_hash(_SPREAD[c]), starts, ends)
        h[h == 0] = 1
        slot = (h >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        missing = np.flatnonzero(self.keys[slot] != h)
        spilt: dict[int, list[int]] = {}
        if len(missing):
            shown = _SHOWN[data].tobytes().decode("utf-32-le")
            byte_at = np.append(np.flatnonzero(np.diff(lead)), len(data))
            tokenize = self.tokenizer.model.tokenize

            def split(some: np.ndarray) -> list[list[int]]:
                return [[t.id for t in tokenize(shown[a:b])] for a, b in zip(byte_at[starts[some]].tolist(), byte_at[ends[some]].tolist(), strict=True)]

            new, which = np.unique(h[missing], return_index=True)
            before = self.used
            self._add(new, split(missing[which]), grow)
            if self.used < before:  # the cache began anew: what was there is missing again
                return self.encode(data, offsets, grow=True)
            lost = np.flatnonzero(self.keys[slot] != h)  # two pieces of this block share a slot
            if len(lost):
                again, which = np.unique(h[lost], return_index=True)
                own = dict(zip(again.tolist(), split(lost[which]), strict=True))
                spilt = {int(i): own[int(h[i])] for i in lost}
        count, source = self.count[slot], self.at[slot].astype(np.int64)
        for i, ids in spilt.items():
            count[i] = len(ids)
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        if spilt:
            extra = np.fromiter((x for ids in spilt.values() for x in ids), np.int32)
            pool, k = np.concatenate([self.pool[: self.used], extra]), self.used
            for i, ids in spilt.items():
                source[i], k = k, k + len(ids)
        else:
            pool = self.pool
        ids = pool[np.repeat(source - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, at, "left")]

    def _plainly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        offsets = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        return np.fromiter((x for y in ids for x in y), np.int32, int(offsets[-1])), offsets

    def _mixed(self, data: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of odd documents go to the library as they are."""
        cuts = np.flatnonzero(np.diff(odd)) + 1
        ids, counts = [], [np.zeros(1, np.int64)]
        for a, b in zip([0, *cuts], [*cuts, len(odd)], strict=True):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            got = self._plainly([bytes(part[x:y]).decode("utf-8", "replace") for x, y in zip(own[:-1], own[1:], strict=True)]) if odd[a] else self.encode(part, own)
            ids.append(got[0])
            counts.append(np.diff(got[1]))
        return np.concatenate(ids), np.cumsum(np.concatenate(counts))


_caches: dict[str, WordCache] = {}


def cache(path: str) -> WordCache:
    """The cache of this Python worker."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def encoded(column: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids with end_id after them as uint32) for each text of a column; null is the empty text."""
    words, tail = cache(path), np.array([end_id], np.uint32)
    for a, b, data, offsets in K.blocks(column, BLOCK_BYTES):
        ids, at = words.encode(data, offsets)
        ids = ids.astype(np.uint32)
        for i in range(b - a):
            yield a + i, np.concatenate([ids[at[i] : at[i + 1]], tail])


def _gf2_times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def crc32_join(left: int, right: int, right_bytes: int) -> int:
    """The crc32 of two byte strings one after the other from the crc32 of each."""
    if not right_bytes:
        return left
    odd = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(2):
        odd = [_gf2_times(odd, x) for x in odd]
    n = right_bytes
    while n:
        odd = [_gf2_times(odd, x) for x in odd]
        if n & 1:
            left = _gf2_times(odd, left)
        n >>= 1
    return left ^ right
