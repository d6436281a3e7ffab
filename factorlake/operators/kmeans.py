"""Reservoir k-means: a weighted pool, an optional random projection, Lloyd with restarts on the pool, refinement over all rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mixture
from .corpus import random_rows, weighted_sample
from .mixture import lists, map_vectors, shaped, vectors


def orthonormal_projector(d: int, to: int, seed: int = 0) -> np.ndarray:
    """(d, to) with orthonormal columns; the sign of each is fixed."""
    if to > d:
        raise ValueError("a projection has at most as many dimensions as the space")
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, to)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def nearest(x: np.ndarray, c: np.ndarray, metric: str = "euclidean", block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """(index, cost): the first of equally near centroids; cost is the squared distance or 1 - cosine. A row with NaN has -1 and infinity."""
    if metric == "cosine":
        x, c = unit(x), unit(c)
    best, at = np.full(len(x), np.inf), np.full(len(x), -1)
    for a in range(0, len(c), block):
        own = c[a : a + block]
        cost = (1 - x @ own.T).clip(0) if metric == "cosine" else ((x * x).sum(axis=1)[:, None] + (own * own).sum(axis=1) - 2 * x @ own.T).clip(0)
        i = cost.argmin(axis=1)  # of NaN if there is any, and NaN is never better
        low = cost[np.arange(len(x)), i]
        better = low < best
        best[better], at[better] = low[better], a + i[better]
    return at, best


def plus_plus(x: np.ndarray, k: int, metric: str, rng: np.random.Generator) -> np.ndarray:
    picks = [int(rng.integers(len(x)))]
    cost = nearest(x, x[picks], metric)[1]
    for _ in range(k - 1):
        total = cost.sum()
        picks.append(int(rng.choice(len(x), p=cost / total)) if total > 0 else int(rng.integers(len(x))))
        cost = np.minimum(cost, nearest(x, x[picks[-1:]], metric)[1])
    return x[picks]


@dataclass
class Fit:
    centroids: np.ndarray
    inertia: float
    iterations: int


def lloyd(x: np.ndarray, k: int, metric: str = "euclidean", iterations: int = 20, restarts: int = 2, tolerance: float = 1e-4, seed: int = 0) -> Fit:
    """The best of several runs on rows in memory. An empty cluster takes a random row."""
    if len(x) < k:
        raise ValueError("fewer rows than clusters")
    best = None
    for turn in range(restarts):
        rng = np.random.default_rng((seed, turn))
        rows = unit(x) if metric == "cosine" else x
        c = plus_plus(rows, k, metric, rng)
        for done in range(1, iterations + 1):  # noqa: B007
            at, _ = nearest(rows, c, metric)
            n = np.bincount(at, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, at, rows)
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rows[rng.integers(len(rows), size=k)])
            new = unit(new) if metric == "cosine" else new
            moved = np.linalg.norm(new - c, axis=1).max()
            c = new
            if moved < tolerance:
                break
        inertia = float(nearest(rows, c, metric)[1].sum())
        if best is None or inertia < best.inertia:
            best = Fit(c, inertia, done)
    return best


#: Numbers of a vector that are added up by one row of an aggregation.
SLICE = 64


def _blocks(centroids: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of centroids that fit a broadcast."""
    step = max(1, mixture.BROADCAST_BYTES // (8 * centroids.shape[1]))
    return [(a, min(len(centroids), a + step)) for a in range(0, len(centroids), step)]


def assign(df: DataFrame, centroids: np.ndarray, column: str = "x", metric: str = "euclidean", projector: np.ndarray | None = None) -> DataFrame:
    """df with cluster and cost (-1 and infinity for a null vector). With a projector, distances are those of projections. Centroids go out in blocks that fit a broadcast, each a map that keeps the nearer of what was and its own."""
    taken = {c.lower() for c in df.columns}
    if taken & {"cluster", "cost"}:
        raise ValueError("df has a column cluster or cost")
    c = centroids if projector is None else centroids @ projector
    out = df
    for a, b in _blocks(c):
        given = df.sparkSession.sparkContext.broadcast((c[a:b], projector))

        def kernel(x, *was, given=given, a=a):
            own, r = given.value
            x = shaped(x, centroids.shape[1])
            at, cost = nearest(x if r is None else x @ r, own, metric)
            at = np.where(at < 0, -1, at + a)
            if was:
                kept = was[0][:, 1] <= cost
                at, cost = np.where(kept, was[0][:, 0].astype(np.int64), at), np.where(kept, was[0][:, 1], cost)
            return at, cost

        if not a:
            out = map_vectors(df, column, kernel, "cluster long, cost double")
        else:
            before = out.withColumn("_was", F.array(F.col("cluster").cast("double"), "cost")).drop("cluster", "cost")
            out = map_vectors(before, column, kernel, "cluster long, cost double", ("_was",)).drop("_was")
    return out


def added_up(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, part, sums): rows (keys, part, sums of SLICE numbers) added up in the executors."""
    added = parts.groupBy(*keys, "part").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(SLICE)])
    return added.select(*keys, "part", F.array(*[f"s{i}" for i in range(SLICE)]).alias("sums"))


def slices(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, part, (rows, SLICE) numbers) of values (keys, n), filled up with 0."""
    n = -(-values.shape[1] // SLICE)
    filled = np.zeros((len(values), n * SLICE))
    filled[:, : values.shape[1]] = values
    return np.repeat(keys, n), np.tile(np.arange(n), len(keys)), filled.reshape(-1, SLICE)


def means(df: DataFrame, centroids: np.ndarray, column: str = "x", metric: str = "euclidean", projector: np.ndarray | None = None, normalise: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """(sums, counts, inertia) by nearest centroid. Each partition sends its sums in slices, which are added up in the executors; the driver gets K (D + 2) numbers."""
    k, d = centroids.shape
    assigned = assign(df.select(column), centroids, column, metric, projector)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            at, cost = (batch.column(i).to_numpy() for i in (1, 2))
            there = at >= 0
            if not there.any():
                continue
            x = vectors(batch.column(0))[there]
            own, which = np.unique(at[there], return_inverse=True)
            new = np.zeros((len(own), d + 2))
            np.add.at(new[:, 2:], which, unit(x) if normalise else x)
            new[:, 0], new[:, 1] = np.bincount(which), np.bincount(which, cost[there])
            for key, row in zip(own.tolist(), new, strict=True):
                sums[key] = sums[key] + row if key in sums else row
        names = sorted(sums)
        for i in range(0, len(names), 256):
            some = names[i : i + 256]
            key, part, values = slices(np.array(some), np.array([sums[x] for x in some]))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part.astype(np.int32)), lists(values)], ["k", "part", "sums"])

    out = np.zeros((k, -(-(d + 2) // SLICE), SLICE))
    for r in added_up(assigned.select(column, "cluster", "cost").mapInArrow(partial, "k long, part int, sums array<double>"), "k").toLocalIterator():
        out[r["k"], r["part"]] = r["sums"]
    out = out.reshape(k, -1)
    return out[:, 2 : d + 2], out[:, 0].astype(np.int64), float(out[:, 1].sum())


def refine(df: DataFrame, centroids: np.ndarray, column: str = "x", metric: str = "euclidean", projector: np.ndarray | None = None, epochs: int = 5, tolerance: float = 1e-4, seed: int = 0) -> Fit:
    """Lloyd epochs over all rows. With a projector rows are assigned by projections and averaged in full space as they are; without, cosine averages unit vectors. An empty cluster takes a random centroid."""
    c, inertia, rng, done = centroids.astype(float), np.inf, np.random.default_rng(seed), 0
    for done in range(1, epochs + 1):  # noqa: B007
        sums, n, inertia = means(df, c, column, metric, projector, normalise=metric == "cosine" and projector is None)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c[rng.integers(len(c), size=len(c))])
        moved = np.linalg.norm(new - c, axis=1).max()
        c = new
        if moved < tolerance:
            break
    return Fit(c, inertia, done)


def reservoir_kmeans(df: DataFrame, k: int, pool: int, id_column: str, column: str = "x", weight: Column | None = None, metric: str = "euclidean", proj_dim: int | None = None, iterations: int = 50, restarts: int = 10, refine_epochs: int = 25, tolerance: float = 1e-4, seed: int = 0) -> Fit:
    """Weighted pool -> k-means on it (projected if 0 < proj_dim < D) -> lifted centroids -> refinement over all rows. pool bounds what the driver holds."""
    if pool < k:
        raise ValueError("the pool has fewer rows than clusters")
    sample = weighted_sample(df, pool, id_column, weight, seed) if weight is not None else random_rows(df, pool, id_column, seed)
    x = np.array([r[0] for r in sample.select(column).collect() if r[0] is not None], float)
    r = orthonormal_projector(x.shape[1], proj_dim, seed) if proj_dim and 0 < proj_dim < x.shape[1] else None
    fit = lloyd(x if r is None else x @ r, k, metric, iterations, restarts, tolerance, seed)
    lifted = fit.centroids if r is None else fit.centroids @ r.T
    return refine(df, lifted, column, metric, r, refine_epochs, tolerance, seed) if refine_epochs else Fit(lifted, fit.inertia, fit.iterations)
