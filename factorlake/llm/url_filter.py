"""URL filters by a cascade of Bloom filters.

Level 1 holds the listed keys. Level 2 holds the keys of the corpus that level 1 takes wrongly for listed, level 3 the listed
keys that level 2 takes wrongly for those, and so on until a level errs no more. A key of the corpus is listed exactly if
the first level that lacks it is an even one (or none lacks it and the last is odd). So membership is exact for every key of
the corpus whose keys the cascade was built over, without a join.

The corpus's keys are scanned in place: only those that level 1 takes for listed are gathered, about 0.7 times as many as
listed ones at level 1's error rate, whatever the corpus's size. A list whose filter would pass ``MOST_BYTES`` is split by the
keys' hashes into several cascades; each is one pass over the pages, written before the next is built, so one is held at a time.

Keys here are rules (a verdict, a host and a path's beginning) and listed host labels. Of a host only the last labels count
for rules, as many as the longest rule has, so a host's length costs no more than reading it. Null urls and urls without
``://`` have an empty host and path, fit no rule and are allowed, as are empty urls. Rows that repeat are judged each, and null
page_ids are ids like others. Of rules that fit the longest wins; ties go by name. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textkernel as K

MOST_BYTES = 64 << 20


@dataclass
class Bloom:
    bits: np.ndarray
    hashes: int

    @classmethod
    def of(cls, keys: np.ndarray, error: float) -> Bloom:
        size = max(64, math.ceil(len(keys) * 1.4427 * math.log2(1 / error)))
        out = cls(np.zeros(size, bool), max(1, round(math.log2(1 / error))))
        for at in out.places(keys):
            out.bits[at] = True
        return out

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        step = K.mix(keys) | np.uint64(1)
        for i in range(self.hashes):
            yield (K.mix(keys + np.uint64(i) * step) % np.uint64(len(self.bits))).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys):
            out &= self.bits[at]
        return out


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether keys are listed: exact for keys of the corpus."""
        out, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
        for number, level in enumerate(self.levels, 1):
            there = level.has(salted(keys[open_], number))
            if number % 2 == 0:
                out[open_[~there]] = True
            open_ = open_[there]
        out[open_] = len(self.levels) % 2 == 1
        return out


def salted(keys: np.ndarray, level: int) -> np.ndarray:
    return K.mix(keys ^ np.uint64(level * 0x9E3779B97F4A7C15 & K._MASK))


def level_error(listed: int, corpus_size: int) -> float:
    return min(0.5, math.sqrt(0.5) * max(1, listed) / max(1, corpus_size))


def parts_of(listed: int, corpus_size: int) -> int:
    """Into how many cascades a list is split."""
    return max(1, math.ceil(listed * 1.4427 * math.log2(1 / level_error(listed, corpus_size)) / (MOST_BYTES * 8)))


def cascade(listed: np.ndarray, keys: DataFrame, corpus_size: int) -> Cascade:
    """keys: a column ``keys`` of arrays of long, all keys of the corpus; listed: distinct uint64."""
    top = Cascade([Bloom.of(salted(listed, 1), level_error(len(listed), corpus_size))])
    if not len(listed):
        return Cascade([])
    given = keys.sparkSession.sparkContext.broadcast(top.levels[0])

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.unique(np.asarray(batch.column(0).flatten(), np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(K.to_signed(own[given.value.has(salted(own, 1))]))], ["key"])

    known = keys.sparkSession.createDataFrame([(int(x),) for x in K.to_signed(listed)], "key long")
    wrong = keys.select("keys").mapInArrow(taken, "key long").distinct().join(known, "key", "left_anti")
    inside, outside = listed, np.array([r["key"] for r in wrong.collect()], np.int64).view(np.uint64)
    while len(outside):
        top.levels.append(Bloom.of(salted(outside, len(top.levels) + 1), 0.5))
        left = inside[top.levels[-1].has(salted(inside, len(top.levels)))]
        inside, outside = outside, left
    return top


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def with_host_and_path(pages: DataFrame) -> DataFrame:
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def _key(kind: str, host: Column, path: Column | str = "") -> Column:
    return F.xxhash64(F.concat(F.lit(f"{kind}\t"), host, F.lit("\t"), path if isinstance(path, Column) else F.lit(path)))


def judge(pages: DataFrame, rules: Sequence[Rule], labels: Sequence[str]) -> DataFrame:
    """page_id, host, path, rule, verdict. A rule that fits decides, the longest of several; else a host with a listed label is blocked and any other allowed."""
    lengths = sorted({len(r.path) for r in rules})
    rules = sorted(set(rules), key=lambda r: (-len(r.name), r.name, r.verdict))  # the longest first; ties by name
    spark = pages.sparkSession
    split = with_host_and_path(pages.select("page_id", "url"))
    # The last labels of a host, as many as some rule's host has. A shorter host stands for itself and equals no such rule.
    depths = sorted({r.host.count(".") + 1 for r in rules})
    tails = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in depths])) if depths else F.array().cast("array<string>")
    split = split.withColumn("parts", F.split("host", r"\.")).withColumn("tails", tails)

    def keys_of(kind: str, n: int) -> Column:
        return F.transform("tails", lambda t: _key(kind, t, F.substring("path", 1, n)))

    candidates = [keys_of(kind, n) for kind in ("allow", "block") for n in lengths]
    keyed = split.select("page_id", "host", "path", F.concat(F.transform("parts", lambda x: _key("label", x)), *candidates).alias("keys"))
    listed = [("rule", i, r.verdict, r.host, r.path) for i, r in enumerate(rules)] + [("label", i, "label", x, "") for i, x in enumerate(sorted(set(labels)))]
    named = spark.createDataFrame(listed, "what string, i int, kind string, host string, path string").select("what", "i", F.xxhash64(F.concat("kind", F.lit("\t"), "host", F.lit("\t"), "path")).alias("key")).collect()
    rule_of = {r["key"]: r["i"] for r in named if r["what"] == "rule"}
    every = np.unique(np.array([r["key"] for r in named], np.int64).view(np.uint64))
    # Keys of the corpus, at most: rows times keys of a row. Only the first level's error rate depends on it.
    size = keyed.agg(F.sum(F.size("keys"))).first()[0] or 0
    names, verdicts = [r.name for r in rules], [r.verdict for r in rules]
    state = keyed.select("page_id", "host", "path", "keys", F.lit(len(names)).alias("best"), F.lit(False).alias("blocked"))
    parts = parts_of(len(every), size)
    scratch = shared.Scratch(spark) if parts > 1 else None

    def marked(state: DataFrame, own: np.ndarray) -> DataFrame:
        given = spark.sparkContext.broadcast(cascade(own, keyed, size))  # MOST_BYTES for the first level, the others are smaller
        part = {k: rule_of.get(k) for k in K.to_signed(own).tolist()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(3)
                at, flat = np.asarray(lists.offsets, np.int64), np.asarray(lists.values, np.int64)
                hit = np.flatnonzero(given.value.has(flat[at[0] : at[-1]].view(np.uint64))) + at[0]
                best, blocked = batch.column(4).to_numpy().copy(), batch.column(5).to_numpy(zero_copy_only=False).copy()
                rows = np.searchsorted(at, hit, "right") - 1
                for place, row in zip(hit.tolist(), rows.tolist(), strict=True):
                    key = int(flat[place])
                    if part.get(key) is None:
                        blocked[row] = True
                    else:
                        best[row] = min(best[row], part[key])
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(best, pa.int32()), pa.array(blocked)], names=batch.schema.names)

        return state.mapInArrow(run, state.schema)

    for i in range(parts):
        state = marked(state, every if parts == 1 else every[K.mix(every) % np.uint64(parts) == np.uint64(i)])
        state = scratch.keep(state, "state") if scratch else state
    no = F.lit(None).cast("string")
    rule = F.get(F.array(*[F.lit(x) for x in names]), F.col("best")) if names else no
    ruled = F.get(F.array(*[F.lit(x) for x in verdicts]), F.col("best")) if names else no
    return state.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
