"""Token windows, quotas, splits, frequencies and sampling."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashed_int, shuffle_key, tokens, uniform, without


def rows_per_subset(total_tokens: int, n_subsets: int, window: int) -> int:
    return total_tokens // n_subsets // window


def scan_budget(target: int) -> int:
    return int(target * 1.3)


def windows(docs: DataFrame, window: int, id_column: str = "doc_id", text: str = "text", tokenize: Callable[[Column], Column] = tokens, special: Column | None = None, seed: int = 42) -> DataFrame:
    """A random window of each document with enough tokens: docs with ids, doc_len, window_start, window_end, window_ids and prefix_text."""
    ids = tokenize(F.col(text)) if special is None else without(tokenize(F.col(text)), special)
    long = docs.withColumn("ids", ids).withColumn("doc_len", F.size("ids")).filter(F.col("doc_len") >= window)
    start = (hashed_int(F.col(id_column), seed) % (F.col("doc_len") - window + 1)).cast("int")
    cut = long.withColumn("window_start", start).withColumn("window_end", F.col("window_start") + window)
    return cut.withColumn("window_ids", F.slice("ids", F.col("window_start") + 1, window)).withColumn("prefix_text", F.array_join(F.slice("ids", 1, F.col("window_end")), " "))


def quota(df: DataFrame, subset: str, target: int, order: str, fits: Column | None = None) -> DataFrame:
    """In scan order, the first target rows of each subset that fit, among the first int(1.3 target) seen."""
    by = Window.partitionBy(subset).orderBy(order)
    seen = df.withColumn("seen", F.row_number().over(by)).filter(F.col("seen") <= scan_budget(target)).drop("seen")
    kept = seen.filter(fits) if fits is not None else seen
    return kept.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= target).drop("rank")


def first_of_subset(df: DataFrame, subset: str, value, target: int, fits: Column | None = None) -> DataFrame:
    """Of one subset, up to target rows that fit among the first int(1.3 target) that the scan meets. The limits stop the scan early; which rows come first is the scan's own order."""
    seen = df.filter(F.col(subset) == value).limit(scan_budget(target))
    return (seen.filter(fits) if fits is not None else seen).limit(target)


def subset_counts(df: DataFrame, subset: str, window: int | None = None) -> DataFrame:
    out = df.groupBy(subset).agg(F.count("*").alias("n"))
    return (out.withColumn("n_tokens", F.col("n") * window) if window else out).orderBy(subset)


def first_per_subset(df: DataFrame, subset: str, order: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(subset).orderBy(order))).filter("rank = 1").drop("rank")


def stratified_split(df: DataFrame, subset: str, id_column: str, val_fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """df with split: ceil(n * fraction) random rows of each subset are val, the others train: those of the smallest hashes, ties by id.

    Rows are counted by subset and the hash's first 16 bits. Running counts name the one such bucket of each subset that the
    border lies in; only its rows are ranked, so a subset of any size is no single task."""
    key = shuffle_key(F.col(id_column), seed)
    bucket = F.substring(key, 1, 4)
    counted = df.groupBy(F.col(subset).alias("_of"), bucket.alias("_bucket")).agg(F.count("*").alias("n"))
    # 65,536 rows a subset at most.
    by = Window.partitionBy("_of").orderBy("_bucket")
    running = counted.withColumn("until", F.sum("n").over(by)).withColumn("n_val", F.ceil(F.sum("n").over(Window.partitionBy("_of")) * F.lit(float(val_fraction))))
    border = running.filter("until >= n_val and until - n < n_val").select("_of", F.col("_bucket").alias("_border"), (F.col("n_val") - F.col("until") + F.col("n")).alias("_left"))
    rows = df.join(border, df[subset].eqNullSafe(border["_of"]), "left").withColumn("_bucket", bucket)  # a row for each subset: Spark broadcasts it if it is small
    clear = rows.filter("_border is null or _bucket <> _border").withColumn("split", F.when(F.col("_bucket") < F.col("_border"), "val").otherwise("train"))
    rank = F.row_number().over(Window.partitionBy("_of").orderBy(key, id_column))
    close = rows.filter("_bucket = _border").withColumn("split", F.when(rank <= F.col("_left"), "val").otherwise("train"))
    return clear.unionByName(close).select(*df.columns, "split")


def split_record(split: DataFrame, subset: str, val_fraction: float, seed: int, per_row_tokens: int) -> dict:
    """Counts by subset. The validation rows' ids are a table of their own."""
    counts = {(r["split"], r[subset]): r["count"] for r in split.groupBy("split", subset).count().collect()}
    by = lambda which: {str(s): n for (w, s), n in sorted(counts.items(), key=str) if w == which}
    return {"seed": seed, "val_frac": val_fraction, "per_row_tokens": per_row_tokens, "train_rows": sum(by("train").values()), "val_rows": sum(by("val").values()), "train_per_subset": by("train"), "val_per_subset": by("val")}


def head(df: DataFrame, n: int, id_column: str) -> DataFrame:
    """The rows numbered below n: a filter that reaches the scan, not a limit."""
    return df.filter(F.col(id_column) < n)


def row_range(df: DataFrame, start: int, stop: int, id_column: str) -> DataFrame:
    """The rows numbered from start to stop - 1."""
    return df.filter((F.col(id_column) >= start) & (F.col(id_column) < stop))


def with_names(rows: DataFrame, vocabulary: DataFrame, token: str = "token_id", name: str = "token") -> DataFrame:
    """Rows with their token's string, null for ids that the vocabulary (token_id, token) lacks."""
    known = vocabulary.select(F.col("token_id").alias("_id"), F.col("token").alias(name))
    return rows.join(known, rows[token] == known["_id"], "left").drop("_id")


def weighted_rows(rows: DataFrame, weights: DataFrame, token: str = "token", otherwise: float = 1.0) -> DataFrame:
    """Rows with the weight of their token, for a weighted sample."""
    known = weights.select(F.col("token").alias("_token"), "weight")
    return rows.join(known, rows[token] == known["_token"], "left").drop("_token").withColumn("weight", F.coalesce("weight", F.lit(otherwise)))


def token_rows(df: DataFrame, ids: Column, *keep: str) -> DataFrame:
    """A row for each token with its position; the other columns repeat."""
    return df.select(*keep, F.posexplode(ids).alias("pos", "token"))


def token_frequency(rows: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    rows = rows.filter(~F.col("token").isin(excluded)) if excluded else rows
    return rows.groupBy("token").agg(F.count("*").alias("freq"))


def with_frequency(rows: DataFrame, frequency: DataFrame) -> DataFrame:
    return rows.join(frequency, "token")


def inverse_frequency_weights(frequency: DataFrame, vocabulary: DataFrame | None = None, smoothing: float = 1.0, power: float = 1.0) -> DataFrame:
    """(token, freq, weight): 1 / (freq + s)^p over its mean across the whole vocabulary, unseen tokens counted."""
    full = frequency if vocabulary is None else vocabulary.join(frequency, "token", "left").select("token", F.coalesce("freq", F.lit(0)).alias("freq"))
    raw = full.withColumn("raw", F.pow(F.col("freq") + float(smoothing), F.lit(-float(power))))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean), how="inner").select("token", "freq", (F.col("raw") / F.col("mean")).alias("weight"))  # one row


def weighted_sample(df: DataFrame, m: int, id_column: str, weight: Column, seed: int = 42) -> DataFrame:
    """Exact weighted sample of m rows without replacement: the largest u^(1/w)."""
    key = F.pow(uniform(F.col(id_column), seed), 1.0 / F.greatest(weight, F.lit(1e-12)))
    return df.withColumn("key", key).orderBy(F.desc("key"), id_column).limit(m)


def random_rows(df: DataFrame, n: int, id_column: str, seed: int = 42) -> DataFrame:
    return df.orderBy(shuffle_key(F.col(id_column), seed), id_column).limit(n)


def sample_from_top(df: DataFrame, score: str, pool: int, n: int, id_column: str, seed: int = 42) -> DataFrame:
    return random_rows(df.orderBy(F.desc(score), id_column).limit(pool), n, id_column, seed)


def pool_size(n_rows: int, k: int, most: int, given: int | None = None) -> int:
    return min(given or min(max(2 * k, n_rows // 5), most), n_rows)


def islands(cells: DataFrame, scratch: str) -> int:
    """4-neighbour connected components of the cells (y, x) that are set. Labels spread until they settle."""
    spark = cells.sparkSession
    labels = cells.select("y", "x", F.struct("y", "x").alias("label"))
    for turn in range(10_000):
        step = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
        spread = labels.select(F.explode(step).alias("at"), "label").select("at.*", "label").groupBy("y", "x").agg(F.min("label").alias("label"))
        fresh = spread.join(labels.withColumnRenamed("label", "old"), ["y", "x"])
        fresh.write.mode("overwrite").parquet(f"{scratch}/labels-{turn}")
        fresh = spark.read.parquet(f"{scratch}/labels-{turn}")
        labels = fresh.drop("old")
        if fresh.filter("label <> old").isEmpty():
            return labels.select("label").distinct().count()
    raise RuntimeError("the labels did not settle")


def steps_for(total: int, batch: int) -> int:
    return math.ceil(total / batch)
