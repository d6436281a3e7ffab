"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, connected components.

A row's set is its distinct runs of ``width`` words (words: anything but ASCII white space, A-Z lower-cased); with fewer
words, the whole sequence is the one element. Rows are linked when their sets' Jaccard similarity is at least
``percent`` / 100, confirmed on full sets (of 64-bit hashes). Rows without words, and null texts, have the empty set and are
linked with nothing. A component's name is its smallest doc_id. Rows that repeat a doc_id, and rows of null doc_id, are rows
of their own; the name of a component without any doc_id is null. Very long texts are read whole. An empty table gives no
rows. Other columns are not read.

Signatures: all coordinates come from two permutations of a universe of 2^20 places. One, sigma, scatters the elements;
coordinate k is the minimum of the other, pi, circularly shifted by k. As neighbouring shifts are neighbouring entries
of pi, one element's values for all coordinates are one contiguous slice.

Work stays linear in a group of copies: equal sets collapse to one class first; then members of a bucket are verified
against one member of it, with other members in each further round, and only classes that are still apart; copies in one
component are never paired with each other. What is apart after these rounds is compared across components: buckets of
few members within themselves, members of larger ones by an exact prefix join (elements in one order, rarest first; two
sets of n >= m elements at similarity t share one of the m - ceil(2 t m / (1 + t)) + 1 rarest of the smaller and of the
n - ceil(t n) + 1 rarest of the larger, at places that leave room for the overlap). Parity bitmaps then rule out pairs that
can't have the similarity, and full sets decide. So no link found by the banding is lost. A pair at the threshold of 0.8
shares no band with probability below 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textkernel as K
from .components import components

UNIVERSE_BITS = 20
BANDS, ROWS = 50, 6
#: Words of 64 bits in a set's parity bitmap.
PARITY_WORDS = 16
STAR_ROUNDS = 3
KEYS = ["doc_id", "t1", "t2"]
#: Members up to which a bucket that is still open is compared within itself; larger ones take the prefix join.
SMALL_BUCKET = 512
#: Bits of the broadcast bitmap that finds the rows whose full sets are wanted (32 MB).
FILTER_BITS = 1 << 28


@lru_cache(2)
def permutations(coordinates: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and for each place of the universe the slice of pi that holds its values for all shifts."""
    n = 1 << UNIVERSE_BITS
    rng = np.random.default_rng(seed)
    sigma, pi = rng.permutation(n).astype(np.int32), rng.permutation(n).astype(np.uint32)
    wrapped = np.concatenate([pi, pi[:coordinates]])
    return sigma, np.lib.stride_tricks.sliding_window_view(wrapped, coordinates)


def signature(elements: np.ndarray, coordinates: int) -> np.ndarray:
    """The circulant MinHash of distinct 64-bit elements."""
    sigma, slices = permutations(coordinates)
    places = sigma[(elements >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
    out = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(places), 256):
        np.minimum(out, slices[places[i : i + 256]].min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) keys as signed 64-bit integers."""
    parts, out = signatures.reshape(len(signatures), bands, rows).astype(np.uint64), np.zeros((len(signatures), bands), np.uint64)
    for i in range(rows):
        out = K.mix(out + parts[:, :, i] + np.uint64(1)) * np.uint64(K._BASE)
    return K.to_signed(K.mix(out + np.arange(bands, dtype=np.uint64)))


def element_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of the runs of ``width`` words)."""
    for a, b, data, offsets in K.blocks(column):
        _, _, row, h = K.word_hashes(data, offsets, K.WHITE)
        runs = K.run_hashes(h, width)
        at = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            s, e = int(at[i]), int(at[i + 1])
            if e - s >= width:
                yield a + i, np.unique(runs[s : e - width + 1])
            else:
                yield a + i, K.run_hashes(h[s:e], e - s) if e > s else h[:0]


def set_name(x: np.ndarray) -> bytes | None:
    """16 bytes that stand for a set; none for the empty set."""
    return np.array([x.sum(dtype=np.uint64), K.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes() if len(x) else None


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]), pa.int64()))


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, t1, t2, n_shingles, set_hash, keys); t1 and t2 are the text's hashes. For the empty set, set_hash is null and there are no keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, names, signs = [], [], []
            for _, x in element_sets(batch.column(3), width):
                size.append(len(x))
                names.append(set_name(x))
                signs.append(signature(x, bands * rows) if len(x) else None)
            full = [x for x in signs if x is not None]
            keys = iter(band_keys(np.array(full), bands, rows) if full else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64()), pa.array(names, pa.binary()), lists([np.zeros(0, np.int64) if x is None else next(keys) for x in signs])], [*KEYS, "n_shingles", "set_hash", "keys"])

    t1, t2 = shared.text_keys()
    return docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), shared.text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, t1 long, t2 long, n_shingles long, set_hash binary, keys array<long>")


def parity(x: np.ndarray) -> np.ndarray:
    """A bitmap in which each element flips one bit, as signed words. Two sets differ in at least as many elements as their bitmaps in bits."""
    bits = np.bincount((x & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def text_filter(texts: DataFrame, column: str) -> np.ndarray | None:
    """A bitmap of the texts' 64-bit hashes, 16 bits or more for each of them and FILTER_BITS at most; none where they are too many for that."""
    n = texts.count()
    size = 1 << max(16, (16 * n - 1).bit_length() if n else 16)
    if size > FILTER_BITS:
        return None
    place = F.col(column).bitwiseAND(size - 1)
    words = texts.select(F.shiftright(place, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def sets(docs: DataFrame, width: int, wanted: np.ndarray | None = None) -> DataFrame:
    """(set_hash, elements, bits) of each row, with the elements as long and the parity bitmap. wanted: of rows whose text's hash is in the bitmap alone."""
    given = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if given is not None:
                place = batch.column(1).to_numpy().view(np.uint64) & np.uint64(64 * len(given.value) - 1)
                batch = batch.filter(pa.array((given.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)))
            got = [x for _, x in element_sets(batch.column(0), width)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(map(set_name, got), pa.binary()), lists([K.to_signed(x) for x in got]), lists([parity(x) for x in got])], ["set_hash", "elements", "bits"])

    return docs.select(shared.text_of().alias("text"), shared.text_keys()[0].alias("t1")).mapInArrow(run, "set_hash binary, elements array<long>, bits array<long>")


def similar(common: Column, left: Column, right: Column, percent: int) -> Column:
    return 100 * common >= percent * (left + right - common)


def may_link(n: Column, m: Column, differ: Column, percent: int) -> Column:
    """Sets of n and m elements with d that only one holds share (n + m - d) / 2; bitmaps differ in at most d bits."""
    return (100 + percent) * (n + m - differ) >= 2 * percent * (n + m)


def prefix_pairs(rest: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of rest's nodes (node, label) of other labels that share an element of their prefixes, whatever their bucket, and whose bitmaps allow the similarity. Every such pair at the similarity is among them."""
    words = [f"w{i}" for i in range(PARITY_WORDS)]
    elements = rest.join(full.select("node", "elements"), "node").select("node", F.explode("elements").alias("element"))
    often = elements.groupBy("element").agg(F.count(F.lit(1)).alias("often"))
    ranked = elements.join(often, "element").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "element"))).alias("ranked"))
    n = F.size("ranked")
    least, overlap = F.ceil(n * percent / 100), F.ceil(n * (2 * percent) / (100 + percent))
    # A place more on either side keeps rounding harmless.
    cut = ranked.select("node", n.alias("n"), (n - overlap + 2).alias("few"), F.posexplode(F.slice("ranked", 1, (n - least + 2).cast("int"))).alias("at", "r")).select("node", "n", "at", (F.col("at") < F.col("few")).alias("few"), F.col("r.element").alias("element"))
    cut = cut.join(rest, "node").join(full.select("node", *words), "node")
    small, large = (cut.select("element", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "n", "at", "few", *words))) for x in "ab")
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    # Of the elements a pair shares the first leaves room for all others.
    fits = (100 * F.col("n_a") >= percent * F.col("n_b")) & ((100 + percent) * (room + 1) >= percent * (F.col("n_a") + F.col("n_b")))
    differ = reduce(add, [F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words])
    joined = small.filter("few_a").join(large, "element").filter(F.col("label_a") != F.col("label_b")).filter(ordered & fits & may_link(F.col("n_a"), F.col("n_b"), differ, percent))
    return joined.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def components_of(docs: DataFrame, width: int, percent: int = 80, bands: int = BANDS, rows: int = ROWS, scratch: shared.Scratch | None = None) -> DataFrame:
    """Per row: doc_id, t1, t2, n_shingles, component_id and head: the struct (unnamed, doc_id, t1, t2) of the component's first row; null for the empty set."""
    shared.bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    scratch = scratch or shared.Scratch(spark)
    docs = docs.select("doc_id", "text")
    signed = scratch.keep(signatures(docs, width, bands, rows), "signatures")
    known = signed.filter("set_hash is not null")
    # A class: all rows of one set. Its number is fixed by being written.
    head = F.struct(F.col("doc_id").isNull().alias("unnamed"), *KEYS)
    grouped = known.groupBy("set_hash", "n_shingles").agg(F.min(head).alias("head"), F.first("keys").alias("keys"))
    classes = scratch.keep(grouped.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    exploded = classes.select("node", F.explode("keys").alias("bucket"))
    shared_keys = exploded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("bucket")
    members = scratch.keep(exploded.join(shared_keys, "bucket", "left_semi").select("bucket", "node"), "members")
    nodes = members.select("node").distinct()
    # The full sets of the classes that share a bucket with another, each from its first row.
    involved = scratch.keep(classes.join(nodes, "node", "left_semi").select("node", "set_hash", *(F.col(f"head.{c}").alias(f"of_{c}") for c in KEYS)), "involved")
    wanted = text_filter(involved, "of_t1")
    sources = docs
    if wanted is None:  # then texts are shuffled to find their rows
        keyed = docs.withColumns(dict(zip(KEYS[1:], shared.text_keys(), strict=True)))
        sources = keyed.join(involved, shared.same_row(keyed, KEYS, involved, [f"of_{c}" for c in KEYS]), "left_semi")
    full = scratch.keep(sets(sources, width, wanted).join(involved.select("node", "set_hash"), "set_hash").select("node", "elements", *(F.col("bits")[i].alias(f"w{i}") for i in range(PARITY_WORDS))).dropDuplicates(["node"]), "sets")
    labels = scratch.keep(nodes.select("node", F.col("node").alias("label")), "labels")
    words = [f"w{i}" for i in range(PARITY_WORDS)]

    def verified(pairs: DataFrame) -> DataFrame:
        left = full.select(F.col("node").alias("a"), F.col("elements").alias("of_a"))
        right = full.select(F.col("node").alias("b"), F.col("elements").alias("of_b"))
        common = F.size(F.array_intersect("of_a", "of_b"))
        return pairs.join(left, "a").join(right, "b").filter(similar(common, F.size("of_a"), F.size("of_b"), percent)).select("a", "b")

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("x")), labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
        between = scratch.keep(links.join(la, "a").join(lb, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        if between.isEmpty():
            return labels
        up = components(between, scratch).withColumnRenamed("node", "was").withColumnRenamed("label", "now")
        return scratch.keep(labels.join(up, labels.label == up.was, "left").select("node", F.coalesce("now", "label").alias("label")), "labels")

    for turn in range(STAR_ROUNDS):
        now = members.join(labels, "node")
        # A bucket's member of the round: the smallest node first, then by a hash that changes each round.
        order = F.struct("node", "label") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node", "label")
        one = now.groupBy("bucket").agg(F.min(order).alias("one"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket", F.col("one.node").alias("b"), F.col("one.label").alias("label_b"))
        pairs = now.join(one, "bucket").filter("label <> label_b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        before, labels = labels, merged(labels, verified(pairs))
        if labels is before:  # the next rounds would most likely add as little; the last one finds all
            break

    now = members.join(labels, "node")
    sized = scratch.keep(now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members")).filter("low <> high").select("bucket", "members"), "open")
    few = now.join(sized.filter(F.col("members") <= SMALL_BUCKET).select("bucket"), "bucket", "left_semi").join(full.select("node", F.size("elements").alias("n"), *words), "node")
    few = scratch.keep(few.select("bucket", "node", "label", "n", *words), "few")
    other = few.select("bucket", *(F.col(c).alias(f"{c}_b") for c in few.columns[1:]))
    differ = reduce(add, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_b"))) for w in words])
    found = few.join(other, "bucket").filter("label < label_b").filter(may_link(F.col("n"), F.col("n_b"), differ, percent)).select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()
    if not sized.filter(F.col("members") > SMALL_BUCKET).isEmpty():
        crowd = scratch.keep(now.join(sized.filter(F.col("members") > SMALL_BUCKET).select("bucket"), "bucket", "left_semi").select("node", "label").distinct(), "crowd")
        found = found.unionByName(prefix_pairs(crowd, full, percent)).distinct()
    labels = merged(labels, verified(found))

    labelled = scratch.keep(classes.select("set_hash", "n_shingles", "node", "head").join(labels, "node", "left").select("set_hash", "n_shingles", "head", F.coalesce("label", "node").alias("label")), "labelled")
    # Written before the join, so that partial minima go to its exchange and Spark can split a large label in the join.
    heads = scratch.keep(labelled.groupBy("label").agg(F.min("head").alias("head")), "heads")
    of_set = scratch.keep(labelled.drop("head").join(heads, "label").select("set_hash", "n_shingles", "head"), "of_set")
    scratch.only(signed, of_set)
    out = signed.select(*KEYS, "n_shingles", "set_hash").join(of_set, ["set_hash", "n_shingles"], "left")
    return out.select(*KEYS, "n_shingles", F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), "head")


def near_duplicates(docs: DataFrame, width: int, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (whether that is its own; true where a component has no doc_id)."""
    found = components_of(docs, width, percent, bands, rows)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def without_copies(docs: DataFrame, width: int, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (a null one is the largest), then the smallest hashes of its text. Of rows equal in doc_id and text one stays, and any one. Rows without words all stay."""
    scratch = shared.Scratch(docs.sparkSession)
    found = components_of(docs, width, percent, scratch=scratch).filter("head is not null")
    first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("t1") == F.col("head.t1")) & (F.col("t2") == F.col("head.t2"))
    named = shared.fresh(docs, "mark_doc", "m1", "m2")
    counted = found.groupBy(*KEYS).agg(F.bool_or(first).alias("first"), F.count(F.lit(1)).alias("n"))
    marks = scratch.keep(counted.filter("not first or n > 1").select(*(F.col(a).alias(b) for a, b in zip(KEYS, named, strict=True)), F.col("first").alias("first_of_equal")), "marks")
    t1, t2 = shared.fresh(docs, "t1", "t2")
    own = ["doc_id", t1, t2]
    keyed = docs.withColumns(dict(zip([t1, t2], shared.text_keys(), strict=True)))
    single = keyed.join(marks, shared.same_row(keyed, own, marks, named), "left_anti").select(*docs.columns)
    several = marks.filter("first_of_equal")
    if several.isEmpty():
        return single
    equal = keyed.join(several, shared.same_row(keyed, own, several, named), "left_semi")
    return single.unionByName(equal.dropDuplicates(own).select(*docs.columns))
