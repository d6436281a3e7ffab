"""Benchmark decontamination with the q-gram lemma.

Texts are compared as bytes of their words (runs without ASCII punctuation, controls and white space; A-Z lower-cased)
with one blank between words. A benchmark item is cut into segments of ``segment`` bytes, one every ``segment`` / 10 bytes,
and into ones of ``excerpt`` bytes, one every ``edits`` + 1 (a shorter item is one segment; the last of each size ends with
the item). A document holds a segment if some part of it is within ``edits`` = floor(percent * segment length / 100)
insertions, deletions and substitutions.

So wherever a verbatim excerpt of ``excerpt`` - ``edits`` bytes of an item stands in it, some segment lacks no more than
``edits`` bytes of it and is held: 57 bytes, some 9 words, with the values below. From ``excerpt`` + ``edits`` (63) bytes on
an excerpt may have 3 edits, and 7 from ``segment`` + ``segment`` / 10 - 1 (131) on.

Such a part shares at least length + 1 - q - q * edits of the segment's q-grams with it, all within ``edits`` of one
diagonal (place in the document less place in the item). Matches of q-grams are counted in overlapping bands of diagonals;
only bands with that many are aligned, in the band alone. So no segment within the budget is missed. Items with fewer than
``least`` bytes are matched only as they are, between blanks; items without words never.

Equal item texts are searched once. The benchmark goes to the executors in blocks of at most ``block_bytes`` of text (or of
one item), each one pass over the documents; the documents are never shuffled. With several blocks each pass is written
before the next begins, so one block at a time is in memory. Matches are counted in chunks of ``CHUNK``, so a text of one
repeated letter against another takes time but not memory.

Null and empty texts match nothing. Repeated items and repeated rows give rows each; null ids are ids like others. An empty
table of either kind gives no rows, and clean() then gives all documents. Very long texts are read whole, in blocks of their
own. Other columns are not read; clean() returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from . import textkernel as K

Q, SEGMENT, PERCENT, LEAST, BLOCK_BYTES = 12, 120, 6, 60, 4 << 20
EXCERPT = 60
#: Pairs of equal q-grams (one in a text, one in an item) that are laid out at a time.
CHUNK = 1 << 21
_BITS = 22


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts' words, one blank before each and one after the last."""
    starts, _, row = K.words(data, offsets, K.PUNCTUATION)
    solid = ~K.PUNCTUATION[data]
    put = np.cumsum(solid)  # bytes kept up to each place
    n = len(offsets) - 1
    words_before = np.searchsorted(row, np.arange(n + 1))
    kept_before = np.append(0, put)[offsets]
    at = kept_before + words_before + np.arange(n + 1)
    out = np.full(int(at[-1]), 0x20, np.uint8)
    word_of = np.zeros(len(data) + 1, np.int64)
    word_of[starts] = 1
    where = put + np.cumsum(word_of[:-1]) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out[(where + doc)[solid]] = K.LOWER[data[solid]]
    return out, at


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit number of each q-gram (q = 12): 8 bytes mixed with the 4 after them."""
    n = max(len(data) - Q + 1, 0)
    if not n:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    eight = np.ndarray((n,), "<u8", data, 0, (1,))
    four = np.ndarray((n,), "<u4", data, 8, (1,))
    return K.mix(eight * np.uint64(K._BASE) + four)


def aligned(pattern: np.ndarray, starts: np.ndarray, size: int, body: np.ndarray, low: int, width: int, edits: int) -> np.ndarray:
    """For each segment [a, a + size) of pattern, a in starts, its fewest edits to a part of body on diagonals low to low + width - 1. Values above edits aren't exact."""
    # Past the ends of body stand bytes that equal none: no better than a deletion.
    at = starts[:, None] + low + np.arange(size + width - 1)
    text = np.where((at >= 0) & (at < len(body)), body[at.clip(0, len(body) - 1)].astype(np.int16), np.int16(-1))
    own = pattern[starts[:, None] + np.arange(size)].astype(np.int16)
    row, steps = np.zeros((len(starts), width), np.int16), np.arange(width, dtype=np.int16)
    for i in range(size):
        new = row + (text[:, i : i + width] != own[:, i : i + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        if i % 8 == 7 and row.min() > edits:
            break
    return row.min(axis=1)


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[object, str]], segment: int, percent: int, least: int, excerpt: int = EXCERPT):
        self.ids = [i for i, _ in items]
        data, at = normalised(*K.column_bytes(pa.array([t for _, t in items], pa.large_string())))
        self.texts = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.segments: list[list[tuple[int, int, int, int]]] = []  # start, end, edits, q-grams needed
        for x in self.texts:
            m, own = len(x), []
            if m > 1:
                for size in sorted({min(m, segment), min(m, segment, excerpt)}):
                    edits = percent * size // 100 if m >= least else 0
                    step = max(1, segment // 10) if size > excerpt else edits + 1
                    for a in sorted({*range(0, m - size + 1, step), m - size}):
                        own.append((a, a + size, edits, max(1, size + 1 - Q - Q * edits)))
            self.segments.append(own)
        found = [(grams(x), k) for k, x in enumerate(self.texts) if len(x) >= Q]
        keys = np.concatenate([g for g, _ in found]) if found else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(g), k) for g, k in found]) if found else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g, _ in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(keys)))
        self.item, self.place = item[order].astype(np.int64), place[order].astype(np.int64)
        self.some = np.zeros(1 << _BITS, bool)
        self.some[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.width = 2 * (1 + max((s[2] for own in self.segments for s in own), default=0))
        self.fewest = np.array([min((s[3] for s in own), default=1 << 40) for own in self.segments], np.int64)
        short = [k for k, x in enumerate(self.texts) if 1 < len(x) < Q]
        own = np.concatenate([self.texts[k] for k in short]) if short else np.zeros(0, np.uint8)
        at = np.cumsum([0, *(len(self.texts[k]) for k in short)])
        h = K.span_hash(K.prefix_hash(K.SPREAD[own]), at[:-1], at[1:])
        order = np.argsort(h, kind="stable")
        self.short_keys, self.short_items = h[order], np.array(short, np.int64)[order]

    def short_matches(self, text: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) for items with fewer bytes than a q-gram that stand in a text as they are: with their blanks, so from one blank to one of the next few."""
        if not len(self.short_keys):
            return []
        blanks = np.flatnonzero(text == 0x20)
        prefix, found = K.prefix_hash(K.SPREAD[text]), set()
        for k in range(1, Q // 2):
            a, b = blanks[:-k], blanks[k:] + 1
            doc = np.searchsorted(at, a, "right") - 1
            fits = (b - a < Q) & (b <= at[doc + 1])
            a, b, doc = a[fits], b[fits], doc[fits]
            h = K.span_hash(prefix, a, b)
            low, high = (np.searchsorted(self.short_keys, h, side) for side in ("left", "right"))
            for i in np.flatnonzero(high > low).tolist():
                found.update((int(doc[i]), int(item)) for item in self.short_items[low[i] : high[i]])
        return sorted(found)

    def counted(self, hits: np.ndarray, slot: np.ndarray, doc: np.ndarray, at: np.ndarray, span: int, reach: int, half: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted keys of half bands, pairs of equal q-grams in each); a band is one and its next."""
        pairs = self.count[slot]
        until = np.cumsum(pairs)
        keys, sizes, a = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while a < len(hits):
            b = max(a + 1, int(np.searchsorted(until, until[a] - pairs[a] + CHUNK, "right")))
            n = pairs[a:b]
            source = np.repeat(self.first[slot[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            diagonal = np.repeat(hits[a:b] - at[doc[a:b]], n) - self.place[source]
            own, size = np.unique((np.repeat(doc[a:b], n) * len(self.ids) + self.item[source]) * span + (diagonal + reach) // half, return_counts=True)
            keys, which = np.unique(np.concatenate([keys, own]), return_inverse=True)
            sizes = np.bincount(which, np.concatenate([sizes, size]), len(keys)).astype(np.int64)
            a = b
        return keys, sizes

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, edits, segments held, segments) for each document and item with a segment held."""
        text, at = normalised(data, offsets)
        out = [(d, k, 0, 1, 1) for d, k in self.short_matches(text, at)]
        h = grams(text)
        hits = np.flatnonzero(self.some[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(hits) or not len(self.keys):
            return out
        slot = np.minimum(np.searchsorted(self.keys, h[hits]), len(self.keys) - 1)
        real = self.keys[slot] == h[hits]
        hits, slot = hits[real], slot[real]
        doc = np.searchsorted(at, hits, "right") - 1
        inside = hits + Q <= at[doc + 1]  # not over a document's end
        hits, slot, doc = hits[inside], slot[inside], doc[inside]
        reach = int(max(map(len, self.texts))) + 1
        half = self.width // 2
        span = int(np.diff(at).max()) // half + reach // half + 4
        halves, size = self.counted(hits, slot, doc, at, span, reach, half)
        following = np.zeros(len(size), np.int64)
        following[:-1] = np.where(halves[1:] == halves[:-1] + 1, size[1:], 0)
        enough = size + following >= self.fewest[halves // span % len(self.ids)]
        best: dict[tuple[int, int], dict[int, int]] = {}
        for key in halves[enough].tolist():
            pair, bin_ = divmod(key, span)
            d, k = divmod(pair, len(self.ids))
            low = bin_ * half - reach  # diagonals low to low + width - 1
            own = best.setdefault((d, k), {})
            body, pattern = text[at[d] : at[d + 1]], self.texts[k]
            sizes: dict[tuple[int, int], list[int]] = {}
            for s, (a, b, edits, _) in enumerate(self.segments[k]):
                if own.get(s) != 0:
                    sizes.setdefault((b - a, edits), []).append(s)
            for (size, edits), some in sizes.items():
                starts = np.array([self.segments[k][s][0] for s in some])
                got = aligned(pattern, starts, size, body, low - edits, self.width + 2 * edits, edits)
                own.update((s, min(own.get(s, x), x)) for s, x in zip(some, got.tolist(), strict=True) if x <= edits)
        out += [(d, k, min(own.values()), len(own), len(self.segments[k])) for (d, k), own in best.items() if own]
        return out


FOUND = ("edits", "n_held", "n_segments")


def _blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    """(h1, h2, text, block): blocks hold consecutive texts in the order of their hashes, at most block_bytes of them or one."""
    size = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= block_bytes:
        return texts.withColumn("block", F.lit(0).cast("long"))
    # Hash parts of about half a block; running sizes inside each, so no window holds more than a part.
    parts = int(2 * size // block_bytes) + 1
    inside = F.sum(F.octet_length("text")).over(Window.partitionBy("part").orderBy("h1", "h2"))
    cut = texts.withColumn("part", F.pmod("h1", F.lit(parts))).withColumn("step", F.floor((inside - F.octet_length("text")) / block_bytes))
    return cut.select("h1", "h2", "text", F.xxhash64("part", "step").alias("block"))


def _held(docs: DataFrame, benchmark: DataFrame, segment: int, percent: int, least: int, block_bytes: int, excerpt: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t1, t2, h1, h2, edits, n_held, n_segments), a row for each document row and item text of which it holds a segment; and (item_id, h1, h2) of the items."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    scratch = shared.Scratch(spark)
    h1, h2 = shared.text_keys()
    items = benchmark.select("item_id", h1.alias("h1"), h2.alias("h2"), shared.text_of().alias("text"))
    texts = scratch.keep(_blocks(items.groupBy("h1", "h2").agg(F.first("text").alias("text")), block_bytes), "items")
    numbers = sorted(r["block"] for r in texts.select("block").distinct().collect())  # one for each block of text
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "t1", "t2", "h1", "h2", *FOUND]
    schema = f"doc_id {kind}, t1 long, t2 long, h1 long, h2 long, edits long, n_held long, n_segments long"
    t1, t2 = shared.text_keys()
    source = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), shared.text_of().alias("text"))

    def block(n: int) -> tuple[DataFrame, object]:
        rows = [((r["h1"], r["h2"]), r["text"]) for r in texts.filter(F.col("block") == n).collect()]  # block_bytes of text, or one
        index = spark.sparkContext.broadcast(Index(rows, segment, percent, least, excerpt))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                for a, _, data, offsets in K.blocks(batch.column(3)):
                    if found := own.matches(data, offsets):
                        d, k, *rest = zip(*found, strict=True)
                        where = pa.array([a + x for x in d])
                        both = zip(*(own.ids[x] for x in k), strict=True)
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(where) for c in range(3)), *(pa.array(x, pa.int64()) for x in both), *(pa.array(x, pa.int64()) for x in rest)], names)

        return source.mapInArrow(run, schema), index

    if not numbers:
        return spark.createDataFrame([], schema), items.select("item_id", "h1", "h2")
    if len(numbers) == 1:
        return block(numbers[0])[0], items.select("item_id", "h1", "h2")
    done = []
    for n in numbers:
        held, index = block(n)
        done.append(scratch.keep(held, "held"))
        index.destroy()
    return reduce(DataFrame.unionAll, done), items.select("item_id", "h1", "h2")


def find(docs: DataFrame, benchmark: DataFrame, segment: int = SEGMENT, percent: int = PERCENT, least: int = LEAST, block_bytes: int = BLOCK_BYTES, excerpt: int = EXCERPT) -> DataFrame:
    """(doc_id, item_id, edits, n_held, n_segments) for each document row and item of which it holds a segment."""
    held, items = _held(docs, benchmark, segment, percent, least, block_bytes, excerpt)
    return held.join(items, ["h1", "h2"]).select("doc_id", "item_id", *FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, segment: int = SEGMENT, percent: int = PERCENT, least: int = LEAST, block_bytes: int = BLOCK_BYTES, excerpt: int = EXCERPT) -> DataFrame:
    """docs without the rows that hold a segment of an item."""
    held, _ = _held(docs, benchmark, segment, percent, least, block_bytes, excerpt)
    named = shared.fresh(docs, "leaked_doc", "leaked_1", "leaked_2")
    leaked = held.select(*(F.col(a).alias(b) for a, b in zip(("doc_id", "t1", "t2"), named, strict=True))).distinct()
    t1, t2 = shared.fresh(docs, "t1", "t2")
    keyed = docs.withColumns(dict(zip([t1, t2], shared.text_keys(), strict=True)))
    return keyed.join(leaked, shared.same_row(keyed, ["doc_id", t1, t2], leaked, named), "left_anti").select(*docs.columns)
