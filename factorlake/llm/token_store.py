"""Token ids on disk: ORC files in ascending doc_id order.

Layout: one row per piece of a document, ``row`` (the document's place in the order: partition in the upper bits),
``doc_id``, ``piece``, ``ids`` (array<int>). ORC stores ids with integer run-length encoding in independent stripes; row
indexes and Bloom filters on doc_id let a reader skip stripes and row groups, and readers split files by stripe.

Null text is the empty text, whose document is the end id alone. Null doc_ids sort first. Repeated rows are documents of
their own; rows of one doc_id are ordered by two hashes of their texts. Ranges are cut by doc_id, those hashes and the input's
partition, so that null or repeated doc_ids, however many, are no single task. Very long texts take several rows. An empty
table writes no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from . import tokens as T

#: Token ids in a row at most; a longer document takes several rows.
PIECE = 1 << 16


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, piece: int = PIECE) -> DataFrame:
    """(row, doc_id, piece, ids) in ascending doc_id order. The text is shuffled once, by ranges of doc_id, and tokenised where it is written."""
    shared.bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc = batch.column(0), batch.column(1)
            at, number, ids, held = [], [], [], 0

            def out(at=at, number=number, ids=ids, row=row, doc=doc) -> pa.RecordBatch:
                where = pa.array(at, pa.int64())
                offsets = pa.array([0, *accumulate(map(len, ids))], pa.int32())
                flat = pa.array(np.concatenate(ids).view(np.int32), pa.int32())
                return pa.RecordBatch.from_arrays([row.take(where), doc.take(where), pa.array(number, pa.int32()), pa.ListArray.from_arrays(offsets, flat)], ["row", "doc_id", "piece", "ids"])

            for i, x in T.encoded(batch.column(2), tokenizer, end_id):
                for k in range(0, len(x), piece):
                    at.append(i)
                    number.append(k // piece)
                    ids.append(x[k : k + piece])
                held += len(x)
                if held > 1 << 20:
                    yield out()
                    held = 0
                    at.clear(), number.clear(), ids.clear()
            if at:
                yield out()

    schema = f"row long, doc_id {kind.simpleString()}, piece int, ids array<int>"
    t1, t2 = shared.text_keys()
    keyed = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.spark_partition_id().alias("of"), shared.text_of().alias("text"))
    ordered = keyed.repartitionByRange("doc_id", "t1", "t2", "of").sortWithinPartitions("doc_id", "t1", "t2", "of")
    return ordered.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, piece: int = PIECE, row_index: int = 1000, stripe_mb: int = 32) -> None:
    options = {"orc.compress": "ZSTD", "orc.create.index": "true", "orc.row.index.stride": str(row_index), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(stripe_mb << 20)}
    encode_documents(docs, tokenizer, end_id, piece).write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The pieces. A filter on doc_id reads only row groups whose index and Bloom filter admit it."""
    return spark.read.orc(path)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    stored = read(spark, path)
    kind = stored.schema["doc_id"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = np.asarray(lists.offsets, np.int64)
            flat = np.ascontiguousarray(np.asarray(lists.values, np.int32)).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["row", "doc_id", "piece", "n", "crc"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for parts in batch.column(3).to_pylist():
                whole = parts[0]["crc"]
                for p in parts[1:]:
                    whole = T.crc32_join(whole, p["crc"], 4 * p["n"])
                crc.append(whole)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["row", "doc_id", "n_tokens", "ids_crc32"])

    pieces = stored.select("row", "doc_id", "piece", "ids").mapInArrow(sums, f"row long, doc_id {kind}, piece int, n long, crc long")
    whole = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece", "crc", "n"))).alias("parts"))
    # Kept, as two branches read it: a row of 28 bytes for each document.
    documents = shared.Scratch(spark).keep(whole.mapInArrow(join, f"row long, doc_id {kind}, n_tokens long, ids_crc32 long").withColumn("part", F.shiftright("row", 33)), "documents")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # One row per file of the table, so the frame over all of them is small.
    lengths = documents.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    starts = lengths.select("part", F.coalesce(F.sum("ids").over(before.orderBy("part")), F.lit(0)).alias("part_start"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return documents.withColumn("inside", inside).join(starts, "part").select("doc_id", (F.col("part_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
