"""Activation tables, shard metadata, checkpoints and run records."""

from __future__ import annotations

import io
import json

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "layer int, shard int, row_in_shard int, global_row long, pos int, subset string, token_id int, x array<float>"


def write_shards(df: DataFrame, path: str) -> None:
    """Partitions of layer and shard; those present in df are replaced, others stay. The committer makes each write whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "shard").parquet(path)


def read_shards(spark: SparkSession, path: str, layer: int | None = None, shards: list[int] | None = None, rows: DataFrame | None = None, drop_prefix: int = 0) -> DataFrame:
    """Token vectors, pruned to a layer, to shards and to rows (a frame with global_row), without each row's first positions."""
    df = spark.read.parquet(path)
    if layer is not None:
        df = df.filter(F.col("layer") == layer)
    if shards is not None:
        df = df.filter(F.col("shard").isin(shards))
    df = df.filter(F.col("pos") >= drop_prefix) if drop_prefix else df
    return df.join(rows, "global_row", "left_semi") if rows is not None else df


def todo(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned (layer, shard) that aren't there yet."""
    return planned.join(done.select("layer", "shard").distinct(), ["layer", "shard"], "left_anti")


def token_count(rows: DataFrame, window: int, drop_prefix: int) -> int:
    return rows.count() * (window - drop_prefix)


def concat_layers(df: DataFrame, layers: list[int]) -> DataFrame:
    """Vectors of several layers joined end to end, by row and position."""
    parts = [df.filter(F.col("layer") == k).select("global_row", "pos", "token_id", F.col("x").alias(f"x{k}")) for k in layers]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part.drop("token_id"), ["global_row", "pos"])
    return out.select("global_row", "pos", "token_id", F.concat(*(f"x{k}" for k in layers)).alias("x"))


def shuffled(df: DataFrame, seed: int, epoch: int, id_column: str = "global_row") -> DataFrame:
    """Another order for each epoch, the same for the same seed and epoch: rows are dealt by a hash and sorted by it where they arrive, so no ranges are sampled first."""
    key = F.xxhash64(F.lit(seed), F.lit(epoch), *(c for c in (id_column, "pos") if c in df.columns))
    return df.withColumn("_key", key).repartition("_key").sortWithinPartitions("_key").drop("_key")


def read_shard_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(shard, row_in_shard, global_row, subset, window_start, window_end, doc_len) of shard_*.json files."""
    schema = "start long, `end` long, row_indices array<long>, rows array<struct<subset string, window_start int, window_end int, doc_len int>>"
    raw = spark.read.schema(schema).json(f"{path}/shard_*.json", multiLine=True).withColumn("shard", F.regexp_extract(F.input_file_name(), r"shard_(\d+)\.json", 1).cast("int"))
    rows = raw.select("shard", F.posexplode(F.arrays_zip("row_indices", "rows")).alias("row_in_shard", "z"))
    return rows.select("shard", "row_in_shard", F.col("z.row_indices").alias("global_row"), "z.rows.*")


def write_record(spark: SparkSession, path: str, record: dict) -> None:
    """A json record (config, split, progress) beside a table."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict | None:
    """None if it is not there. One that is there but can't be read is an error."""
    try:
        raw = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if raw is None else json.loads(raw[0])


def append_progress(spark: SparkSession, path: str, entry: dict) -> None:
    """A line more in a progress log."""
    spark.createDataFrame([(json.dumps(entry, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def eta(done: int, total: int, seconds: float) -> dict:
    """Rate and remaining time from what is done so far."""
    rate = done / seconds if seconds > 0 else 0.0
    return {"done": done, "total": total, "per_second": rate, "seconds_left": (total - done) / rate if rate else None}


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, token) of a tokenizer's json file (model.vocab)."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "model struct<vocab: map<string, int>>").alias("j"))
    return whole.select(F.explode("j.model.vocab").alias("token", "token_id")).select("token_id", "token")


def save_mixture(spark: SparkSession, model, path: str, extra: dict | None = None) -> None:
    """Components as Parquet, a row each, and a json meta row."""
    p = model.raw()
    rows = [(k, p["mu"][k].tolist(), p["dir_raw"][k].tolist(), p["scale_rho"][k].tolist(), p["psi_rho"][k if len(p["psi_rho"]) > 1 else 0].tolist(), float(p["pi_logit"][k])) for k in range(len(p["mu"]))]
    spark.createDataFrame(rows, "k int, mu array<double>, dir_raw array<array<double>>, scale_rho array<double>, psi_rho array<double>, pi_logit double").write.mode("overwrite").parquet(f"{path}/components")
    meta = {"K": len(p["mu"]), "D": p["mu"].shape[1], "q": p["scale_rho"].shape[1], "psi_per_component": len(p["psi_rho"]) > 1, "eps_floor": model.eps_floor, "version": 1, "rotation_on": model.rotation is not None, "rotation": None if model.rotation is None else model.rotation.tolist()}
    write_record(spark, f"{path}/meta", meta | {"extra": extra or {}})


def load_mixture(spark: SparkSession, path: str, strict: bool = True):
    """strict: a checkpoint without its meta row is an error, as a rotation and the noise's kind stand there; else both are taken from the shapes, without a rotation."""
    from ..operators.mixture import Mixture

    rows = sorted(spark.read.parquet(f"{path}/components").collect(), key=lambda r: r["k"])
    meta = read_record(spark, f"{path}/meta")
    if meta is None:
        if strict:
            raise ValueError(f"{path}/meta is missing")
        meta = {"psi_per_component": len({tuple(r["psi_rho"]) for r in rows}) > 1}
    stack = lambda name: np.array([r[name] for r in rows], float)
    psi = stack("psi_rho")
    rotation = meta.get("rotation")
    return Mixture.from_raw(stack("mu"), stack("dir_raw"), stack("scale_rho"), psi if meta.get("psi_per_component") else psi[:1], stack("pi_logit"), eps_floor=meta.get("eps_floor", 1e-8), rotation=None if rotation is None else np.array(rotation))


def mixture_from_state(state: dict, strict: bool = True):
    """A mixture from named arrays, bare or wrapped in ``state_dict``, as other programs keep them. Shapes give K, D and q. Without ``strict`` what is missing has a default: unit scales and noise, equal weights, no rotation."""
    from ..operators.mixture import Mixture, softplus_inverse

    state = state.get("state_dict", state)
    missing = [n for n in ("mu", "dir_raw", "scale_rho", "psi_rho", "pi_logit") if n not in state]
    if missing and (strict or {"mu", "dir_raw"} & set(missing)):
        raise ValueError(f"the state lacks {', '.join(missing)}")
    mu, raw = np.asarray(state["mu"], float), np.asarray(state["dir_raw"], float)
    if mu.ndim != 2 or raw.ndim != 3 or raw.shape[:2] != mu.shape:
        raise ValueError(f"shapes {mu.shape} and {raw.shape} of mu and dir_raw don't fit")
    unit = softplus_inverse(np.array(1.0))
    psi = np.asarray(state.get("psi_rho", np.full(mu.shape[1], unit)), float)
    rotation = state.get("rotation")
    return Mixture.from_raw(mu, raw, np.asarray(state.get("scale_rho", np.full((len(mu), raw.shape[2]), unit)), float), psi.reshape(-1, mu.shape[1]), np.asarray(state.get("pi_logit", np.zeros(len(mu))), float), float(state.get("eps_floor", 1e-8)), None if rotation is None else np.asarray(rotation, float))


def read_state(spark: SparkSession, path: str, strict: bool = True):
    """A mixture from an ``npz`` file of named arrays."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    with np.load(io.BytesIO(bytes(raw)), allow_pickle=False) as held:
        return mixture_from_state({name: held[name] for name in held.files}, strict)
