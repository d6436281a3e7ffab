"""Cost-balanced packing of documents into training sequences.

A document's ids are cut into whole sequences of ``length`` tokens, each a sequence of its own, and a rest. Rests are
dealt to groups of a bounded number of documents by a hash. Within a group the rests, longest first, each go to the
sequence of the lowest estimated cost (linear plus quadratic in each piece, as attention costs) with enough room left.
Rests that fit nowhere whole are cut to fill what room is left, so a group pads less than one sequence in all.

Null text is the empty text: the end id alone. Repeated rows are packed each by itself; null doc_ids are ids like others. An
empty table gives no rows. Very long texts are cut like others, piece by piece. Ties go by doc_id, then by the ids' crc32.
Other columns are not read. No group depends on a key's frequency: it is a hash of doc_id, ids, start, and of how many equal
rows the same input partition had before, with that partition's number.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textkernel as K
from . import tokens as T

GROUP_DOCUMENTS = 2048


def cost(length: np.ndarray | int, linear: float, quadratic: float):
    return linear * length + quadratic * length * length


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(piece, its first token, tokens, sequence) for pieces given in descending length. Pieces may be cut."""
    n = max(1, math.ceil(int(lengths.sum()) / capacity))
    room, load, out, late = np.full(n, capacity, np.int64), np.zeros(n), [], []
    for i, length in enumerate(lengths.tolist()):
        j = int(np.argmin(np.where(room >= length, load, np.inf)))
        if room[j] < length:
            late.append((i, length))
            continue
        out.append((i, 0, length, j))
        room[j] -= length
        load[j] += cost(length, linear, quadratic)
    for i, length in late:
        done = 0
        while done < length:
            j = int(np.argmax(room))
            take = min(int(room[j]), length - done)
            out.append((i, done, take, j))
            room[j] -= take
            done += take
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, with_ids: bool = True, linear: float = 1.0, quadratic: float = 1 / 1024, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless with_ids is False, ids (array<int>)."""
    shared.bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    groups = max(1, math.ceil(docs.count() / group_documents))
    id_type = "<u2" if T.load(tokenizer).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get(), {}
        part = np.uint64(K._MASK & (task.partitionId() + 1) * 0xD6E8FEB86659FD93)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int, int, bytes | None]] = []
            keys = batch.column(2).to_pylist()
            for i, ids in T.encoded(batch.column(1), tokenizer, end_id):
                whole = len(ids) // length * length
                key = K.mix(np.array([keys[i] & K._MASK], np.uint64) + np.uint64(zlib.crc32(ids)))
                equal = int(key[0])
                seen[equal] = seen.get(equal, 0) + 1  # whatever the rows' order, so a task that runs again deals alike
                key = K.mix(key + part + np.uint64(seen[equal]))
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    full = start < whole
                    group = int(K.mix(key + np.uint64(start if full else 0))[0] % np.uint64(groups))
                    rows.append((i, start, len(piece), len(ids), group, zlib.crc32(piece) if full else -1, piece.astype(id_type).tobytes() if with_ids or not full else None))
                if len(rows) > 5000:
                    yield out(batch, rows)
                    rows = []
            if rows:
                yield out(batch, rows)

    def out(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        at, *columns = zip(*rows, strict=True)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], ["doc_id", "start", "length", "doc_tokens", "group", "crc", "blob"])

    def deal(table: pa.Table) -> pa.Table:
        group = table["group"][0].as_py()
        size, crc, start = table["length"].to_numpy(), table["crc"].to_numpy(), table["start"].to_numpy()
        rest = np.flatnonzero(crc < 0)
        blobs = table["blob"].combine_chunks() if hasattr(table["blob"], "combine_chunks") else table["blob"]
        ids_of = {int(i): np.frombuffer(blobs[int(i)].as_py(), id_type).astype("<u4") for i in rest}
        tie = pd.DataFrame({"length": -size[rest], "doc": table["doc_id"].to_pandas().to_numpy()[rest], "crc": [zlib.crc32(ids_of[int(i)]) for i in rest]})
        order = rest[tie.sort_values(["length", "doc", "crc"], kind="stable").index.to_numpy()] if len(rest) else rest
        dealt = sorted(((int(order[p]), a, n, j) for p, a, n, j in assign(size[order], length, linear, quadratic)), key=lambda x: x[3]) if len(rest) else []
        at, starts, sizes, crcs, sequences, offsets, values = [], [], [], [], [], [], []
        used: dict[int, int] = {}
        for i, a, n, j in dealt:
            ids = ids_of[i][a : a + n]
            at.append(i), starts.append(int(start[i]) + a), sizes.append(n), crcs.append(zlib.crc32(np.ascontiguousarray(ids))), sequences.append(j), offsets.append(used.get(j, 0)), values.append(ids)
            used[j] = used.get(j, 0) + n
        for k, i in enumerate(np.flatnonzero(crc >= 0).tolist(), len(used)):
            at.append(i), starts.append(int(start[i])), sizes.append(int(size[i])), crcs.append(int(crc[i])), sequences.append(k), offsets.append(0)
            values.append(np.frombuffer(blobs[i].as_py(), id_type) if with_ids else None)
        where = pa.array(at, pa.int64())
        columns = [table["doc_id"].take(where), starts, sizes, crcs, table["doc_tokens"].take(where), [(group << 32) + x for x in sequences], offsets]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, pa.int64()) for x in columns]
        if with_ids:
            arrays.append(pa.array([x.astype(np.int32) for x in values], pa.list_(pa.int32())))
            names.append("ids")
        return pa.table(arrays, names)

    ready = docs.select("doc_id", shared.text_of().alias("text"), F.xxhash64("doc_id").alias("key"))
    pieces = ready.mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, group long, crc long, blob binary")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return pieces.groupBy("group").applyInArrow(deal, schema)
