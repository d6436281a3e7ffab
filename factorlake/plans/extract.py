"""Extraction of token vectors through a model: windowed, in shards that resume, or in one table.

A model is what ``extraction.activations`` takes: ``load()`` gives a function from token lists to dicts (site, layer) -> array."""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corpus, extraction
from ..sources import activations, folders


def loader(spec: str) -> Callable:
    """``module:function``, the function that loads a model in a worker."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def number_rows(df: DataFrame, *order: str) -> DataFrame:
    """df with row_id from 0 in the order given, without gaps. The sorted table is written, then its parts' lengths are added up."""
    spark = df.sparkSession
    sorted_ = folders.kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    # A row for each part.
    lengths = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = lengths.select("_part", before.alias("_start"))
    rows = sorted_.withColumn("_part", part).join(starts, "_part")
    return rows.withColumn("row_id", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).select("row_id", *df.columns)


def extract(spark: SparkSession, samples: DataFrame, load: Callable, out: str, layer: int, id_column: str = "id", max_tokens: int = 0, **options) -> DataFrame:
    """(row_id, token, freq, x) of one layer as one table with a config record; max_tokens > 0 keeps the first so many rows."""
    vectors = extraction.activations(samples, load, [layer], id_column, **options)
    rows = number_rows(vectors.select(id_column, "pos", "token", "freq", "x"), id_column, "pos")
    rows = corpus.head(rows, max_tokens, "row_id") if max_tokens > 0 else rows
    rows.select("row_id", "token", "freq", "x").write.mode("overwrite").parquet(f"{out}/activations")
    activations.write_record(spark, f"{out}/config", {"layers": [layer], "mode": options.get("site", "residual"), "max_tokens": max_tokens, "num_rows": samples.count()})
    return spark.read.parquet(f"{out}/activations")


def extract_windows(spark: SparkSession, windows: DataFrame, load: Callable, out: str, layers: list[int], shard_rows: int = 512, wave: int = 64, site: str = "residual", begin: str | None = None, debug: bool = False, log: Callable[[str], None] = print) -> dict:
    """Vectors of numbered windows (global_row, subset, token_ids) as partitions (layer, shard), ``wave`` shards a job.

    A shard is done when its metadata stand in ``out/shards``, which are written after its vectors; a run that goes on does the
    others, and a job that was cut off is written over. Each wave appends to ``out/progress``: seconds, tokens, tokens a second,
    and the time left. debug: the first two shards alone."""
    rows = windows.withColumn("shard", F.floor(F.col("global_row") / shard_rows).cast("int")).withColumn("row_in_shard", (F.col("global_row") % shard_rows).cast("int"))
    rows = corpus.head(rows, 2 * shard_rows, "global_row") if debug else rows
    spark_schema = "shard int, start long, `end` long, n_rows long, n_tokens long"
    made = f"{out}/shards"
    planned = rows.groupBy("shard").agg(F.min("global_row").alias("start"), (F.max("global_row") + 1).alias("end"), F.count("*").alias("n_rows"), F.sum(F.size("token_ids")).alias("n_tokens"))
    done = spark.read.schema(spark_schema).parquet(made) if activations.read_record(spark, f"{out}/config") else spark.createDataFrame([], spark_schema)
    total = planned.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    # Shard numbers: a row for each ``shard_rows`` windows.
    left = sorted(r["shard"] for r in planned.join(done.select("shard"), "shard", "left_anti").select("shard").collect())
    had = done.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    config = {"layers": layers, "mode": site, "shard_size": shard_rows, "prepend_bos": begin is not None}
    old = activations.read_record(spark, f"{out}/config")
    if old is None:
        done.write.mode("append").parquet(made)
        activations.write_record(spark, f"{out}/config", config)
    elif any(old[k] != v for k, v in config.items()):
        raise ValueError(f"{out} holds another extraction: {old}")
    began, new = time.monotonic(), 0
    for i in range(0, len(left), wave):
        some = left[i : i + wave]
        own = rows.filter(F.col("shard").between(some[0], some[-1]) & F.col("shard").isin(some))
        found = extraction.activations(own, load, layers, "global_row", site, text="token_ids", tokenize=lambda ids: ids.cast("array<string>"), begin=begin)
        named = found.join(own.select("global_row", "shard", "row_in_shard", "subset"), "global_row")
        named.select("layer", "shard", "row_in_shard", "global_row", "pos", "subset", "token", "x").repartition("layer", "shard").write.partitionBy("layer", "shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{out}/vectors")
        finished = planned.filter(F.col("shard").isin(some))
        finished.coalesce(1).write.mode("append").parquet(made)
        new += finished.agg(F.sum("n_tokens")).first()[0]
        state = activations.eta(new, total - had, time.monotonic() - began) | {"shards": [some[0], some[-1]]}
        activations.append_progress(spark, f"{out}/progress", state)
        log(f"shards {some[0]}-{some[-1]}: {state['done']}/{state['total']} tokens, {state['per_second']:.0f} a second, {state['seconds_left'] or 0:.0f} s left")
    return {"shards": len(left), "tokens": new}
