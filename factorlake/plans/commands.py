"""The steps of a run as functions, and a thin command line over them:

    python -m factorlake.plans.commands {windows,extract,extract-windows,split,train,overlap,intrinsic-dim,score,all} --data DIR --out DIR ...

Tables are Parquet, models a folder of components and a json meta row. Each step reads what the one before wrote."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, corpus, kmeans, mixture, training
from ..sources import activations, folders
from . import extract


def build_windows(spark: SparkSession, docs: DataFrame, out: str, subset: str, window: int = 256, total_tokens: int = 100_000_000, seed: int = 42, dry_run: bool = False) -> DataFrame:
    """Balanced windows by subset; subsets that are there already are left alone. dry_run: the counts alone."""
    n = docs.select(subset).distinct().count()
    made = corpus.windows(docs, window, seed=seed).select("doc_id", subset, F.col("window_ids").alias("token_ids"), "prefix_text", "window_start", "window_end", "doc_len")
    target = corpus.rows_per_subset(total_tokens, max(n, 1), window)
    kept = corpus.quota(made, subset, target, "doc_id")
    if dry_run:
        return corpus.subset_counts(kept, subset, window)
    try:
        done = spark.read.parquet(out).select(subset).distinct()
        kept = kept.join(done, subset, "left_anti")
    except Exception as e:  # noqa: BLE001  nothing is there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    kept.write.mode("append").partitionBy(subset).parquet(out)
    return corpus.subset_counts(spark.read.parquet(out), subset, window)


def split(spark: SparkSession, data: DataFrame, out: str, subset: str, id_column: str = "row_id", val_fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """(id, subset, split) as a table with a record of its counts; one that is there is read back."""
    if activations.read_record(spark, f"{out}/split") is None:
        corpus.stratified_split(data.select(id_column, subset), subset, id_column, val_fraction, seed).write.mode("overwrite").parquet(f"{out}/split_rows")
        activations.write_record(spark, f"{out}/split", corpus.split_record(spark.read.parquet(f"{out}/split_rows"), subset, val_fraction, seed, 1))
    return spark.read.parquet(f"{out}/split_rows")


def centroids(spark: SparkSession, data: DataFrame, out: str, k: int, id_column: str, proj_dim: int | None, max_pool: int, refine_epochs: int, seed: int) -> np.ndarray:
    """(K, D), read back if they are there for this k."""
    found = activations.read_record(spark, f"{out}/centroids_meta")
    if found is None:
        fit = kmeans.reservoir_kmeans(data, k, corpus.pool_size(data.count(), k, max_pool), id_column, proj_dim=proj_dim, refine_epochs=refine_epochs, seed=seed)
        spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(fit.centroids)], "k int, mu array<double>").write.mode("overwrite").parquet(f"{out}/centroids")
        activations.write_record(spark, f"{out}/centroids_meta", {"k": k, "inertia": fit.inertia})
    elif found["k"] != k:
        raise ValueError(f"{out}/centroids holds {found['k']} centroids")
    return np.array([r["mu"] for r in spark.read.parquet(f"{out}/centroids").orderBy("k").collect()])  # the model's own size


def train(spark: SparkSession, data: DataFrame, out: str, k: int, rank: int, id_column: str = "row_id", subset: str | None = None, val_fraction: float = 0.05, epochs: int = 10, rate: float = 1e-3, proj_dim: int | None = 32, max_pool: int = 2_000_000, refine_epochs: int = 5, seed: int = 42, batch: int = 0, clip: float | None = None, steps_per_epoch: int | None = None, save_epochs: bool = False) -> dict:
    """Split -> centroids -> mixture -> checkpoint and records. batch: rows of a step (0: all); save_epochs keeps each epoch's model."""
    if subset:
        ids = split(spark, data, out, subset, id_column, val_fraction, seed).select(id_column, "split")
        # Written once, as every epoch reads both.
        part, val = (folders.kept(data.join(ids.filter(F.col("split") == s), id_column, "left_semi"), s) for s in ("train", "val"))
    else:
        part, val = data, None
    start = mixture.Mixture.init(centroids(spark, part, out, k, id_column, proj_dim, max_pool, refine_epochs, seed), rank, seed=seed)
    save = (lambda model, epoch: activations.save_mixture(spark, model, f"{out}/epochs/{epoch:03d}")) if save_epochs else None
    batches = corpus.steps_for(part.count(), batch) if batch else 1
    model, info = training.train(part, start, id_column=id_column, validation=val, epochs=epochs, rate=rate, clip=clip, batches=batches, steps_per_epoch=steps_per_epoch, save=save, seed=seed, scratch=f"{out}/dealt")
    activations.save_mixture(spark, model, f"{out}/model", info)
    return info


def overlap(spark: SparkSession, out: str) -> DataFrame:
    analysis.overlap(spark, activations.load_mixture(spark, f"{out}/model")).write.mode("overwrite").parquet(f"{out}/overlap")
    return spark.read.parquet(f"{out}/overlap")


def intrinsic_dim(spark: SparkSession, data: DataFrame, out: str, id_column: str = "row_id", threshold: float = 0.9, least: int = 100) -> DataFrame:
    found = analysis.intrinsic_dims(data, activations.load_mixture(spark, f"{out}/model"), id_column, threshold=threshold, least=least)
    found.write.mode("overwrite").parquet(f"{out}/intrinsic_dims")
    return spark.read.parquet(f"{out}/intrinsic_dims")


def score(spark: SparkSession, data: DataFrame, out: str) -> DataFrame:
    mixture.score(data, activations.load_mixture(spark, f"{out}/model")).write.mode("overwrite").parquet(f"{out}/scores")
    return spark.read.parquet(f"{out}/scores")


def run_all(spark: SparkSession, data: DataFrame, out: str, k: int, rank: int, load=None, layer: int = 0, text_id: str = "doc_id", **options) -> None:
    """(extraction, if a model is given ->) training -> overlap -> intrinsic dimension."""
    least = options.pop("least", 100)
    if load is not None:
        extract.extract(spark, data, load, f"{out}/extracted", layer, text_id)
        data, options["subset"] = spark.read.parquet(f"{out}/extracted/activations"), None
    train(spark, data, out, k, rank, **options)
    overlap(spark, out)
    intrinsic_dim(spark, data, out, least=least)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="factorlake")
    out.add_argument("command", choices=("windows", "extract", "extract-windows", "split", "train", "overlap", "intrinsic-dim", "score", "all"))
    out.add_argument("--data", required=True, help="Parquet: doc_id, text and a subset column for windows and extract; global_row, subset and token_ids for extract-windows; row_id and x else")
    out.add_argument("--out", required=True)
    out.add_argument("--subset")
    out.add_argument("--model", help="module:function that loads a model, for extract, extract-windows and all")
    out.add_argument("--layers", type=int, nargs="+", default=[0])
    out.add_argument("--site", default="residual")
    out.add_argument("--begin", help="a mark before each text, whose vector is cut off")
    out.add_argument("--shard-rows", type=int, default=512)
    out.add_argument("--wave", type=int, default=64, help="shards a job")
    out.add_argument("--max-tokens", type=int, default=0)
    out.add_argument("--debug", action="store_true", help="two shards alone")
    out.add_argument("--components", type=int, default=500)
    out.add_argument("--rank", type=int, default=10)
    out.add_argument("--epochs", type=int, default=10)
    out.add_argument("--rate", type=float, default=1e-3)
    out.add_argument("--batch", type=int, default=0, help="rows of a training step; 0: all")
    out.add_argument("--clip", type=float)
    out.add_argument("--steps-per-epoch", type=int)
    out.add_argument("--save-epochs", action="store_true")
    out.add_argument("--seed", type=int, default=42)
    out.add_argument("--val-fraction", type=float, default=0.05)
    out.add_argument("--window", type=int, default=256)
    out.add_argument("--total-tokens", type=int, default=100_000_000)
    out.add_argument("--min-population", type=int, default=100)
    out.add_argument("--dry-run", action="store_true")
    return out


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    data = spark.read.parquet(a.data)
    load = extract.loader(a.model) if a.model else None
    if a.command in ("extract", "extract-windows") and load is None:
        raise SystemExit("--model is missing")
    fitting = {"epochs": a.epochs, "rate": a.rate, "seed": a.seed, "val_fraction": a.val_fraction, "batch": a.batch, "clip": a.clip, "steps_per_epoch": a.steps_per_epoch, "save_epochs": a.save_epochs}
    if a.command == "windows":
        build_windows(spark, data, a.out, a.subset or "lang", a.window, a.total_tokens, dry_run=a.dry_run).show()
    if a.command == "extract":
        print(extract.extract(spark, data, load, a.out, a.layers[0], "doc_id", a.max_tokens, site=a.site, begin=a.begin).count())
    if a.command == "extract-windows":
        print(extract.extract_windows(spark, data, load, a.out, a.layers, a.shard_rows, a.wave, a.site, a.begin, a.debug))
    if a.command == "split":
        corpus.subset_counts(split(spark, data, a.out, a.subset or "subset", val_fraction=a.val_fraction, seed=a.seed), "split").show()
    if a.command == "train":
        print(train(spark, data, a.out, a.components, a.rank, subset=a.subset, **fitting))
    if a.command == "all":
        run_all(spark, data, a.out, a.components, a.rank, load, a.layers[0], least=a.min_population, subset=a.subset, **fitting)
    if a.command == "overlap":
        overlap(spark, a.out)
    if a.command in ("overlap", "all"):
        spark.read.parquet(f"{a.out}/overlap").agg(F.min("kl_sym"), F.max("kl_sym"), F.avg("bc")).show()
    if a.command == "intrinsic-dim":
        intrinsic_dim(spark, data, a.out, least=a.min_population)
    if a.command in ("intrinsic-dim", "all"):
        analysis.summary(spark.read.parquet(f"{a.out}/intrinsic_dims"), "dim").show()
    if a.command == "score":
        print(score(spark, data, a.out).count())


if __name__ == "__main__":
    main()
