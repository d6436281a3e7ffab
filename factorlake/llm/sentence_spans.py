"""Substring deduplication by sliding runs of sentences.

A sentence ends after a word that ends in ``.``, ``!``, ``?`` or the ideographic full stop (a closing quote or bracket may
follow) and at each line's end. From every sentence a run starts: the fewest consecutive sentences, ``sentences`` at least,
that hold ``least_words`` words or more. A sentence that alone has ``alone`` words or more is a run too. Runs are hashed
(64 bits, over words with A-Z lower-cased, so white space between words doesn't matter) and joined over the whole corpus. A
run's first occurrence is the one in the first row that has it, there at the smallest place; all sentences that any other
occurrence covers are removed.

Every row is a document of its own. Rows stand in ascending doc_id order, null doc_ids last; rows of one doc_id (or of none)
by two hashes of their texts. Of rows equal in doc_id and text any one comes first, and the others lose all sentences of their
runs. Null text is the empty text and has no sentence. Documents with too few words have no run and stay as they are. Very
long texts are read whole; what is removed from one is gathered by its own row, so it is bounded by the text. An empty table
gives an empty result. Other columns stay as they are, whatever their names: added columns take names that are free.

A run that a third of all documents hold is no hot task: its minimum and count are aggregated before the shuffle, and the
join that follows has one row for it on the other side, so that Spark splits the large one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import shared
from . import textkernel as K

SENTENCES, LEAST_WORDS, ALONE = 2, 20, 50

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in "\"')]}"]] = True


def sentence_starts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Indexes of the words that begin sentences."""
    if not len(starts):
        return np.zeros(0, np.int64)
    last = data[ends - 1]
    before = data[np.maximum(ends - 2, 0)]
    wide = (ends - starts >= 3) & (last == 0x82) & (before == 0x80) & (data[np.maximum(ends - 3, 0)] == 0xE3)
    stop = _STOP[last] | wide | (_CLOSE[last] & _STOP[before] & (ends - starts >= 2))
    lines = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0x0A, out=lines[1:])
    begins = np.ones(len(starts), bool)
    begins[1:] = (row[1:] != row[:-1]) | stop[:-1] | (lines[starts[1:]] != lines[ends[:-1]])
    return np.flatnonzero(begins)


def runs(first: np.ndarray, row: np.ndarray, n_words: int, sentences: int, least_words: int, alone: int = ALONE) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, end sentence) of the runs that stay in one document. first: sentences' first words; row: their documents."""
    n = len(first)
    word = np.append(first, n_words)
    end = np.maximum(np.searchsorted(word, first + least_words, "left"), np.arange(n) + sentences)
    whole = end <= n
    at = np.flatnonzero(whole)
    at = at[row[end[at] - 1] == row[at]]
    long = np.flatnonzero(np.diff(word) >= alone)
    begin, until = np.append(at, long), np.append(end[at], long + 1)
    order = np.argsort(begin, kind="stable")
    return begin[order], until[order]


KEYS = ["doc_id", "t1", "t2"]


def spans(docs: DataFrame, sentences: int = SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, t1, t2, hash, sentence, until, again, opens): each run of each row; again if the row has it before, opens for the row's first. t1 and t2 are the text's hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in K.blocks(batch.column(3)):
                starts, ends, row, h = K.word_hashes(data, offsets, K.WHITE)
                first = sentence_starts(data, starts, ends, row)
                doc = row[first]
                at, until = runs(first, doc, len(starts), sentences, least_words)
                word = np.append(first, len(starts))
                span = K.span_hash(K.prefix_hash(h), word[at], word[until])
                _, one = np.unique(K.mix(span + doc[at].astype(np.uint64) * np.uint64(K._BASE)), return_index=True)
                again = np.ones(len(at), bool)
                again[one] = False
                opens = np.ones(len(at), bool)
                opens[1:] = doc[at[1:]] != doc[at[:-1]]
                begin = np.searchsorted(doc, doc[at])
                where = pa.array(doc[at] + a)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(where) for k in range(3)), pa.array(K.to_signed(span)), pa.array((at - begin).astype(np.int32)), pa.array((until - begin).astype(np.int32)), pa.array(again), pa.array(opens)], [*KEYS, "hash", "sentence", "until", "again", "opens"])

    t1, t2 = shared.text_keys()
    return docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), shared.text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, t1 long, t2 long, hash long, sentence int, until int, again boolean, opens boolean")


def repeated(docs: DataFrame, scratch: shared.Scratch, sentences: int = SENTENCES, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t1, t2, covered): for rows with any, the runs to remove as an array of (sentence, until); and (doc_id, t1, t2) of runs' rows that stand more than once."""
    kept = scratch.keep(spans(docs, sentences, least_words), "spans")
    once = kept.filter("not again")
    often = once.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash", "first")
    # Of a row after the first doc_id, or else of one that may be the first.
    many = scratch.keep(once.join(often, "hash").select(*KEYS, "hash", "sentence", "until", F.col("doc_id").eqNullSafe(F.col("first")).alias("leads")), "many")
    leading = many.filter("leads")
    text = F.struct("t1", "t2")
    ties = leading.groupBy("hash").agg(F.min(text).alias("low"), F.max(text).alias("high")).filter("low <> high").select("hash", "low")
    late = leading.join(ties, "hash").filter(text != F.col("low"))
    found = [x.select(*KEYS, "sentence", "until") for x in (many.filter("not leads"), late, kept.filter("again"))]
    marks = found[0].unionByName(found[1]).unionByName(found[2]).groupBy(*KEYS).agg(F.collect_set(F.struct("sentence", "until")).alias("covered"))
    copies = kept.filter("opens").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*KEYS)
    return marks, scratch.keep(copies, "copies")


def without_repeats(docs: DataFrame, sentences: int = SENTENCES, least_words: int = LEAST_WORDS, only_changed: bool = False) -> DataFrame:
    """docs with what repeats cut out of text, and two columns more: n_sentences, n_removed. only_changed: rows that lost something."""
    shared.bound_batches(docs.sparkSession)
    scratch = shared.Scratch(docs.sparkSession)
    marks, copies = repeated(docs, scratch, sentences, least_words)
    t1, t2, doc, m1, m2, number, later, what = shared.fresh(docs, "t1", "t2", "mark_doc", "m1", "m2", "number", "later", "covered")
    n_sentences, n_removed = shared.fresh(docs, "n_sentences", "n_removed")
    own, others = ["doc_id", t1, t2], [doc, m1, m2]
    keyed = docs.withColumns(dict(zip([t1, t2], shared.text_keys(), strict=True)))
    marks = marks.select(*(F.col(a).alias(b) for a, b in zip(KEYS, others, strict=True)), F.col("covered").alias(what))
    if copies.isEmpty():
        joined = keyed.withColumn(later, F.lit(False)).join(marks, shared.same_row(keyed, own, marks, others), "inner" if only_changed else "left")
    else:
        copies = copies.toDF(*others)
        on = shared.same_row(keyed, own, copies, others)
        # Numbers of equal rows are fixed by being written.
        equal = scratch.keep(keyed.join(copies, on, "left_semi").withColumn(number, F.monotonically_increasing_id()), "equal")
        lowest = equal.groupBy(*own).agg(F.min(number).alias(what)).toDF(*others, what)
        ranked = equal.join(lowest, shared.same_row(equal, own, lowest, others)).withColumn(later, F.col(number) != F.col(what))
        single = keyed.join(copies, on, "left_anti").withColumn(later, F.lit(False))
        rows = single.unionByName(ranked.select(*single.columns))
        joined = rows.join(marks, shared.same_row(rows, own, marks, others), "left")
        joined = joined.filter(F.col(what).isNotNull() | F.col(later)) if only_changed else joined
    joined = joined.select(*docs.columns, later, what)
    schema = StructType([*docs.schema.fields, StructField(n_sentences, LongType()), StructField(n_removed, LongType())])
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, copy, marks = batch.column(text_at), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            bounds, flat = np.asarray(marks.offsets, np.int64), marks.flatten()
            size = np.diff(bounds)
            size = np.where(marks.is_valid().to_numpy(zero_copy_only=False), size, 0)
            since = np.asarray(flat.field(0), np.int64), np.asarray(flat.field(1), np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            copy = copy.to_numpy(zero_copy_only=False)
            texts, total, removed = [], np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b, data, offsets in K.blocks(column):
                starts, ends, row = K.words(data, offsets, K.WHITE)
                first = sentence_starts(data, starts, ends, row)
                begin = np.searchsorted(row[first], np.arange(b - a + 1))
                every = runs(first, row[first], len(starts), sentences, least_words) if copy[a:b].any() else None
                for i in range(b - a):
                    lo, hi = int(at[a + i]), int(at[a + i + 1])
                    total[a + i] = begin[i + 1] - begin[i]
                    if lo == hi and not copy[a + i]:
                        texts.append(column[a + i].as_py())
                        continue
                    change = np.zeros(int(total[a + i]) + 1, np.int64)
                    if copy[a + i]:
                        x, y = np.searchsorted(every[0], begin[i : i + 2])
                        np.add.at(change, every[0][x:y] - begin[i], 1)
                        np.add.at(change, every[1][x:y] - begin[i], -1)
                    else:
                        np.add.at(change, since[0][lo:hi], 1)
                        np.add.at(change, since[1][lo:hi], -1)
                    gone = np.cumsum(change)[:-1] > 0
                    removed[a + i] = gone.sum()
                    cut = np.append(starts[first[begin[i] : begin[i + 1]]], offsets[i + 1])
                    parts = [data[offsets[i] : cut[0]], *(data[cut[k] : cut[k + 1]] for k in np.flatnonzero(~gone))]
                    texts.append(np.concatenate(parts).tobytes().decode("utf-8", "replace"))
            columns = [*batch.columns[:-2], pa.array(total), pa.array(removed)]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-2], n_sentences, n_removed])

    return joined.mapInArrow(run, schema)
