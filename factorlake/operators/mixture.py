"""Mixture of factor analyzers: parameters, numpy kernels, and Arrow maps that score DataFrames.

For component k with loadings W (D x q) and diagonal noise psi, M = I + W' W/psi, e = x - mu and v = W' e/psi:
E[z] = M^-1 v, and the log density is -1/2 (D log 2 pi + sum log psi + log det M + e'e/psi - v' E[z]).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.folders import kept

#: Bytes of parameters in a broadcast. Larger models go to the executors in blocks of components, each a map over the rows.
BROADCAST_BYTES = 256 << 20


def softplus(x):
    return np.logaddexp(0, x)


def softplus_inverse(y):
    return y + np.log(-np.expm1(-y))


@dataclass
class Mixture:
    mu: np.ndarray  # (K, D)
    W: np.ndarray  # (K, D, q)
    psi: np.ndarray  # (K, D), or (1, D) if shared
    log_pi: np.ndarray  # (K,)
    eps_floor: float = 1e-5
    rotation: np.ndarray | None = None  # (K, q, q): scores z become z @ T and loadings W @ inv(T')

    def __post_init__(self):
        k, d, q = self.W.shape
        if self.mu.ndim != 2 or not 1 <= q <= d:
            raise ValueError("centroids (K, D) and a rank from 1 to D are asked for")
        self.A = self.W / self.psi[:, :, None]
        self.M = np.eye(q) + np.einsum("kdq,kdr->kqr", self.W, self.A)
        self.cov_z = np.linalg.inv(self.M)
        self.log_det = np.broadcast_to(np.log(self.psi).sum(axis=1), k) + np.linalg.slogdet(self.M)[1]

    @classmethod
    def init(cls, centroids: np.ndarray, rank: int, psi_init: float = 1.0, psi_per_component: bool = False, scale_init: float = 1.0, eps_floor: float = 1e-5, seed: int = 0) -> Mixture:
        if centroids.ndim != 2 or not 1 <= rank <= centroids.shape[1]:
            raise ValueError("centroids (K, D) and a rank from 1 to D are asked for")
        k, d = centroids.shape
        raw = np.random.default_rng(seed).normal(size=(k, d, rank)) / np.sqrt(d)
        psi = np.full((k if psi_per_component else 1, d), softplus_inverse(np.array(psi_init)))
        return cls.from_raw(centroids, raw, np.full((k, rank), softplus_inverse(np.array(scale_init))), psi, np.zeros(k), eps_floor)

    @classmethod
    def from_raw(cls, mu, dir_raw, scale_rho, psi_rho, pi_logit, eps_floor: float = 1e-5, rotation=None) -> Mixture:
        """Unconstrained parameters: unit directions times softplus scales, softplus noise, softmax weights."""
        directions = dir_raw / np.maximum(np.linalg.norm(dir_raw, axis=1, keepdims=True), eps_floor)
        m = np.max(pi_logit)
        out = cls(np.asarray(mu, float), directions * (softplus(scale_rho) + eps_floor)[:, None, :], softplus(psi_rho) + eps_floor, pi_logit - m - np.log(np.exp(pi_logit - m).sum()), eps_floor, rotation)
        out._raw = {"mu": out.mu, "dir_raw": np.asarray(dir_raw, float), "scale_rho": np.asarray(scale_rho, float), "psi_rho": np.asarray(psi_rho, float), "pi_logit": np.asarray(pi_logit, float)}
        return out

    def part(self, a: int, b: int) -> Mixture:
        """Components a to b - 1, with their weights as they are."""
        return Mixture(self.mu[a:b], self.W[a:b], self.psi if len(self.psi) == 1 else self.psi[a:b], self.log_pi[a:b], self.eps_floor, None if self.rotation is None else self.rotation[a:b])

    def ranges(self) -> list[tuple[int, int]]:
        """Component ranges whose parameters fit a broadcast."""
        k = len(self.mu)
        each = (self.W.nbytes + self.A.nbytes + self.mu.nbytes + self.M.nbytes * 2) // k + 1
        step = max(1, BROADCAST_BYTES // each)
        return [(a, min(k, a + step)) for a in range(0, k, step)]

    def raw(self) -> dict:
        if not hasattr(self, "_raw"):
            scale = np.linalg.norm(self.W, axis=1)
            directions = self.W / np.maximum(scale, 1e-300)[:, None, :]
            self._raw = {"mu": self.mu, "dir_raw": directions, "scale_rho": softplus_inverse(np.maximum(scale - self.eps_floor, 1e-12)), "psi_rho": softplus_inverse(self.psi - self.eps_floor), "pi_logit": self.log_pi}
        return self._raw

    def log_likelihood(self, x: np.ndarray, latents: bool = False):
        """(n, K) by component, without the prior; with latents also E[z] (n, K, q)."""
        n, (k, d, q) = len(x), self.W.shape
        out, z = np.empty((n, k)), np.empty((n, k, q)) if latents else None
        for i in range(k):
            e = x - self.mu[i]
            v = e @ self.A[i]
            ez = v @ self.cov_z[i]
            out[:, i] = -0.5 * (d * np.log(2 * np.pi) + self.log_det[i] + (e * e / self.psi[i % len(self.psi)]).sum(axis=1) - (v * ez).sum(axis=1))
            if latents:
                z[:, i] = ez
        return (out, z) if latents else out

    def posterior(self, ll: np.ndarray, tau: float = 1.0) -> np.ndarray:
        a = (ll + self.log_pi) / tau
        a = np.exp(a - a.max(axis=1, keepdims=True))
        return a / a.sum(axis=1, keepdims=True)

    def log_density(self, ll: np.ndarray) -> np.ndarray:
        a = ll + self.log_pi
        m = a.max(axis=1)
        return m + np.log(np.exp(a - m[:, None]).sum(axis=1))

    def rotated(self, z: np.ndarray) -> np.ndarray:
        return z if self.rotation is None else np.einsum("nkq,kqr->nkr", z, self.rotation)

    def rotated_W(self) -> np.ndarray:
        return self.W if self.rotation is None else np.einsum("kdq,kqr->kdr", self.W, np.linalg.inv(self.rotation.transpose(0, 2, 1)))

    def component_means(self, z: np.ndarray) -> np.ndarray:
        """(n, K, D): mu + W z."""
        return self.mu + np.einsum("kdq,nkq->nkd", self.W, z)

    def mixed_means(self, weights: np.ndarray, z: np.ndarray) -> np.ndarray:
        """(n, D): the components' means added by weight, without laying them out."""
        return weights @ self.mu + (weights[:, :, None] * z).reshape(len(z), -1) @ self.W.transpose(0, 2, 1).reshape(-1, self.mu.shape[1])

    def encode(self, x: np.ndarray, tau: float = 1.0) -> np.ndarray:
        """(n, K, 1 + q): the weight, then weight times scores."""
        ll, z = self.log_likelihood(x, True)
        alpha = self.posterior(ll, tau)
        return np.concatenate([alpha[:, :, None], alpha[:, :, None] * self.rotated(z)], axis=2)

    def dictionary(self) -> np.ndarray:
        """(K, 1 + q, D): centroid and loadings."""
        return np.concatenate([self.mu[:, None], self.rotated_W().transpose(0, 2, 1)], axis=1)

    def decode(self, coefficients: np.ndarray) -> np.ndarray:
        return coefficients.reshape(len(coefficients), -1) @ self.dictionary().reshape(-1, self.mu.shape[1])


def vectors(column: pa.Array) -> np.ndarray:
    """(n, D) in double from a list column. A null vector, or a null in one, is NaN; vectors of other lengths than the first's are an error."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    flat = flat.to_numpy(zero_copy_only=False).astype(float) if flat.null_count else np.asarray(flat, float)
    sizes = np.diff(np.asarray(column.offsets, np.int64))[there]
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} numbers in one table")
    if there.all():
        return flat.reshape(n, -1) if n else np.zeros((0, 0))
    out = np.full((n, sizes[0] if len(sizes) else 0), np.nan)
    if len(sizes):
        out[there] = flat.reshape(len(sizes), -1)
    return out


def shaped(x: np.ndarray, d: int) -> np.ndarray:
    """x, or without any vector (no rows, or null ones alone) rows of NaN."""
    return x if x.shape[1] == d or (len(x) and x.shape[1]) else np.full((len(x), d), np.nan)


def lists(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a, float)
    if a.ndim == 1:
        return pa.array(a)
    inner = lists(a.reshape(-1, *a.shape[2:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.shape[0] * a.shape[1] + 1, a.shape[1], dtype=np.int32)), inner)


def map_vectors(df: DataFrame, column: str, kernel, outputs: str, also: tuple[str, ...] = ()) -> DataFrame:
    """df with what kernel(x: (n, D), also's columns as vectors...) -> tuple of arrays gives; outputs is their schema. One map, no shuffle."""
    at, others = df.columns.index(column), [df.columns.index(c) for c in also]
    added = StructType.fromDDL(outputs)
    names = [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                got = kernel(vectors(part.column(at)), *(vectors(part.column(k)) for k in others))
                columns = [x if isinstance(x, pa.Array) else pa.array(x) if x.dtype.kind in "iub" else lists(x) for x in got]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def first_best(v: np.ndarray) -> np.ndarray:
    """The place of the largest, the first of equal ones; -1 in a row of NaN."""
    return np.where(np.isnan(v).any(axis=1), -1, v.argmax(axis=1)).astype(np.int64)


def numbered(df: DataFrame, id_column: str | None) -> tuple[DataFrame, str]:
    """df with a column that names rows: the given one, or numbers fixed by writing the table to the shared folder."""
    if id_column:
        return df, id_column
    return kept(df.withColumn("_row", F.monotonically_increasing_id()), "numbered"), "_row"


def _weights(m: Mixture, ll: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some components: the highest weighted likelihood's logarithm and place, all over it at tau, and the sum of all over it."""
    v = ll + m.log_pi
    top = v.max(axis=1)
    e = np.exp((v - top[:, None]) / tau)
    return top, first_best(v), e, np.exp(v - top[:, None]).sum(axis=1)


def in_blocks(df: DataFrame, model: Mixture, id_column: str, column: str, tau: float, kernel, outputs: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, parts): by block of components, in order, a struct of first, top, best, mass, mass_tau and what kernel(m, first, x, ll, z, e, kept columns) gives. Each block is a map of its own over the rows; its broadcast stays within the bound."""
    found = []
    for a, b in model.ranges():
        given = df.sparkSession.sparkContext.broadcast(model.part(a, b))

        def run(x, *kept, given=given, a=a):
            m = given.value
            x = shaped(x, m.mu.shape[1])
            ll, z = m.log_likelihood(x, True)
            top, best, e, mass = _weights(m, ll, tau)
            return np.full(len(x), a), top, np.where(best < 0, -1, a + best), mass, e.sum(axis=1), *kernel(m, a, x, ll, z, e, *kept)

        source = df.select(*dict.fromkeys((id_column, column, *keep)))
        found.append(map_vectors(source, column, run, "first long, top double, best long, mass double, mass_tau double" + (f", {outputs}" if outputs else ""), keep).drop(*{column, *keep} - {id_column}))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    own = [c for c in out.columns if c != id_column]
    return out.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("parts"))


def merged(parts: DataFrame, id_column: str, tau: float, **wanted) -> DataFrame:
    """(id, log_density, best, ...): wanted's functions take (parts, share) where share(p) is the factor of block p's exponentials."""
    high = F.array_max(F.transform("parts", lambda p: p["top"]))
    out = parts.withColumn("high", high)
    out = out.withColumn("z", F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["mass"] * F.exp(p["top"] - F.col("high"))))
    out = out.withColumn("zt", F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["mass_tau"] * F.exp((p["top"] - F.col("high")) / tau)))
    best = F.get(F.transform(F.filter("parts", lambda p: p["top"] == F.col("high")), lambda p: p["best"]), 0)

    def share(p):
        return F.exp((p["top"] - F.col("high")) / tau) / F.col("zt")

    return out.select(id_column, (F.col("high") + F.log("z")).alias("log_density"), best.alias("best"), *(f("parts", share).alias(name) for name, f in wanted.items()))


def joined(name: str):
    return lambda parts, share: F.flatten(F.transform(parts, lambda p: p[name]))


def shared_out(name: str, nested: bool = False):
    """Blocks' arrays of exponentials end to end, as shares of the whole."""

    def scale(v, factor):
        return F.transform(v, lambda x: F.transform(x, lambda y: y * factor)) if nested else F.transform(v, lambda x: x * factor)

    return lambda parts, share: F.flatten(F.transform(parts, lambda p: scale(p[name], share(p))))


def summed(name: str, d: int, weighted: bool = True):
    """The sum of the blocks' arrays of d numbers."""
    return lambda parts, share: F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.aggregate(parts, F.lit(0.0), lambda s, p: s + p[name][i] * (share(p) if weighted else F.lit(1.0))))


def attached(df: DataFrame, found: DataFrame, id_column: str, *names: str) -> DataFrame:
    """df with found's columns, by id; a number that was only given for this goes."""
    out = df.join(found.select(F.col(id_column).alias("_of"), *names), df[id_column].eqNullSafe(F.col("_of"))).drop("_of")
    return out.drop("_row") if id_column == "_row" else out


def whole(model: Mixture) -> bool:
    return len(model.ranges()) == 1


def score(df: DataFrame, model: Mixture, column: str = "x", tau: float = 1.0, id_column: str | None = None) -> DataFrame:
    """df with ll (array by component), resp, log_density, best (most likely component; the first of equal ones) and ez (scores by component). A null vector's numbers are NaN, its best is -1."""
    outputs = "ll array<double>, resp array<double>, log_density double, best long, ez array<array<double>>"
    if whole(model):
        given = df.sparkSession.sparkContext.broadcast(model)

        def kernel(x):
            m = given.value
            ll, z = m.log_likelihood(shaped(x, m.mu.shape[1]), True)
            resp = m.posterior(ll, tau)
            return ll, resp, m.log_density(ll), first_best(resp), m.rotated(z)

        return map_vectors(df, column, kernel, outputs)
    df, id_column = numbered(df, id_column)
    parts = in_blocks(df, model, id_column, column, tau, lambda m, a, x, ll, z, e: (ll, e, m.rotated(z)), "ll array<double>, e array<double>, ez array<array<double>>")
    return attached(df, merged(parts, id_column, tau, ll=joined("ll"), resp=shared_out("e"), ez=joined("ez")), id_column, "ll", "resp", "log_density", "best", "ez")


def density(df: DataFrame, model: Mixture, column: str = "x", tau: float = 1.0, component: int | None = None, id_column: str | None = None) -> DataFrame:
    """df with log_density, best and, of one component, its weight: nothing of length K."""
    if component is not None and not 0 <= component < len(model.mu):
        raise ValueError(f"no component {component}")
    more = ", weight double" if component is not None else ""
    if whole(model):
        given = df.sparkSession.sparkContext.broadcast(model)

        def kernel(x):
            m = given.value
            ll = m.log_likelihood(shaped(x, m.mu.shape[1]))
            out = m.log_density(ll), first_best(ll + m.log_pi)
            return (*out, m.posterior(ll, tau)[:, component]) if more else out

        return map_vectors(df, column, kernel, f"log_density double, best long{more}")
    df, id_column = numbered(df, id_column)

    def own(m, a, x, ll, z, e):
        inside = component is not None and a <= component < a + len(m.mu)
        return (e[:, component - a] if inside else np.zeros(len(x)),)

    parts = in_blocks(df, model, id_column, column, tau, own, "weight double")
    weight = {"weight": lambda parts, share: F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["weight"] * share(p))} if more else {}
    return attached(df, merged(parts, id_column, tau, **weight), id_column, "log_density", "best", *weight)


def score_in_blocks(df: DataFrame, model: Mixture, id_column: str, column: str = "x") -> DataFrame:
    """(id, log_density, best)."""
    return density(df, model, column, id_column=id_column).select(id_column, "log_density", "best")


def reconstruct(df: DataFrame, model: Mixture, column: str = "x", tau: float = 1.0, mixture_mean: bool = True, id_column: str | None = None) -> DataFrame:
    """df with recon: the posterior mean's reconstruction, or one by component."""
    if whole(model):
        given = df.sparkSession.sparkContext.broadcast(model)

        def kernel(x):
            m = given.value
            ll, z = m.log_likelihood(shaped(x, m.mu.shape[1]), True)
            return (m.mixed_means(m.posterior(ll, tau), z) if mixture_mean else m.component_means(z),)

        return map_vectors(df, column, kernel, "recon array<double>" if mixture_mean else "recon array<array<double>>")
    df, id_column = numbered(df, id_column)

    def own(m, a, x, ll, z, e):
        return (m.mixed_means(e, z) if mixture_mean else m.component_means(z),)

    parts = in_blocks(df, model, id_column, column, tau, own, "recon array<double>" if mixture_mean else "recon array<array<double>>")
    return attached(df, merged(parts, id_column, tau, recon=summed("recon", model.mu.shape[1]) if mixture_mean else joined("recon")), id_column, "recon")


def encode(df: DataFrame, model: Mixture, column: str = "x", tau: float = 1.0, id_column: str | None = None) -> DataFrame:
    """df with coefficients (by component: the weight, then weighted scores)."""
    if whole(model):
        given = df.sparkSession.sparkContext.broadcast(model)
        return map_vectors(df, column, lambda x: (given.value.encode(shaped(x, given.value.mu.shape[1]), tau),), "coefficients array<array<double>>")
    df, id_column = numbered(df, id_column)
    parts = in_blocks(df, model, id_column, column, tau, lambda m, a, x, ll, z, e: (np.concatenate([e[:, :, None], e[:, :, None] * m.rotated(z)], axis=2),), "c array<array<double>>")
    return attached(df, merged(parts, id_column, tau, coefficients=shared_out("c", nested=True)), id_column, "coefficients")


def decode(encoded: DataFrame, model: Mixture, column: str = "coefficients") -> DataFrame:
    """encoded with decoded: coefficients times the dictionary. A larger model's blocks are maps one after the other, each adding its components' part."""
    out, d = encoded, model.mu.shape[1]
    for i, (a, b) in enumerate(model.ranges()):
        given = encoded.sparkSession.sparkContext.broadcast(model.part(a, b))
        own = F.flatten(F.slice(column, a + 1, b - a))
        flat = out.withColumn("_flat", own if not i else F.concat(own, "decoded"))

        def kernel(c, given=given, i=i):
            m = given.value
            j = 1 + m.W.shape[2]
            n = len(m.mu) * j
            got = m.decode(c[:, :n].reshape(-1, len(m.mu), j)) if c.shape[1] else np.full((len(c), d), np.nan)
            return (got + c[:, n:] if i and c.shape[1] else got,)

        out = map_vectors(flat.drop("decoded") if i else flat, "_flat", kernel, "decoded array<double>").drop("_flat")
    return out


def components(spark, model: Mixture) -> DataFrame:
    """(k, j, atom): the dictionary; j null for centroids."""
    d = model.dictionary()
    return spark.createDataFrame([(k, j - 1 if j else None, d[k, j].tolist()) for k in range(d.shape[0]) for j in range(d.shape[1])], "k int, j int, atom array<double>")


def mean_nll(df: DataFrame, model: Mixture, column: str = "x", id_column: str | None = None) -> float | None:
    """Over the rows with a vector."""
    own = df.filter(F.col(column).isNotNull()).select(*([id_column] if id_column else []), column)
    return density(own, model, column, id_column=id_column).agg(F.avg(-F.col("log_density"))).first()[0]


def from_labels(df: DataFrame, label: str = "label", column: str = "x", shrink: float = 0.5, floor: float = 1e-3) -> Mixture:
    """A rank-1 model from labelled rows: class means, overall variances, loadings along each mean's offset."""
    each = df.select(label, F.posexplode(column).alias("d", "v")).groupBy(label, "d").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"), F.sum(F.col("v").cast("double") * F.col("v")).alias("s"))
    # Labels times dimensions rows.
    rows = each.orderBy(label, "d").collect()
    dim = max(r["d"] for r in rows) + 1
    mu, n = np.array([r["m"] for r in rows]).reshape(-1, dim), np.array([r["n"] for r in rows], float).reshape(-1, dim)
    square = np.array([r["s"] for r in rows]).reshape(-1, dim).sum(axis=0) / n.sum(axis=0)
    mean = (mu * n).sum(axis=0) / n.sum(axis=0)
    return Mixture(mu, shrink * (mu - mean)[:, :, None], (square - mean**2 + floor)[None], np.log(n[:, 0] / n[:, 0].sum()))
