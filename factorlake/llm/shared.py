"""Where intermediate tables go, and small helpers that several operators use."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import remove, shared_folder

#: Bytes of a batch that goes to a Python worker. A text longer than that makes a batch of its own.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches to Python workers hold BATCH_BYTES at most from now on, unless the session asks for less: rows of text have no bound of their own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_within: ContextVar[str | None] = ContextVar("within", default=None)


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{_within.get() or shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0
        self.kept: list[tuple[DataFrame, str]] = []

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.folder}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.kept.append((out, at))
        return out

    def only(self, *wanted: DataFrame) -> None:
        """Removes all kept tables but the wanted ones."""
        for df, at in self.kept:
            if not any(df is w for w in wanted):
                remove(self.spark, at)
        self.kept = [(df, at) for df, at in self.kept if any(df is w for w in wanted)]


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Tables that operators keep within are removed at the end: what comes from them must be written by then."""
    folder = f"{_within.get() or shared_folder(spark)}/swept-{uuid.uuid4().hex}"
    token = _within.set(folder)
    try:
        yield
    finally:
        _within.reset(token)
        remove(spark, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones which df doesn't have (Spark's names don't differ by case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def text_of(column: str = "text"):
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def text_keys(column: str = "text") -> list[Column]:
    """Two independent 64-bit hashes of the text: with doc_id they name a row, up to rows that are equal in both."""
    text = text_of(column)
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def same_row(left: DataFrame, left_names: list[str], right: DataFrame, right_names: list[str]) -> Column:
    """Whether doc_id (which may be null) and both hashes are equal."""
    (d, *hashes), (e, *others) = left_names, right_names
    on = left[d].eqNullSafe(right[e])
    for a, b in zip(hashes, others, strict=True):
        on = on & (left[a] == right[b])
    return on
