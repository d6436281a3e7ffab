"""Fitting a mixture by gradient steps on the mean negative log-likelihood, without automatic differentiation.

A step is one map over the rows by block of components, whose sums are added up in the executors, and an Adam update on the
driver, which holds the model's O(K D q) numbers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kmeans import SLICE, added_up, slices
from .mixture import Mixture, density, lists, mean_nll, numbered, vectors


def statistics(x: np.ndarray, m: Mixture, log_density: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Sums over rows: R = sum r, S1 = sum r u, S2 = sum r u E[z]', S3 = sum r u^2 with u = C^-1 (x - mu), and the negative log-likelihood. log_density is given where m holds only some components."""
    ll, z = m.log_likelihood(x, True)
    log_density = m.log_density(ll) if log_density is None else log_density
    r = np.exp(ll + m.log_pi - log_density[:, None])
    k, d, q = m.W.shape
    out = {"R": r.sum(axis=0), "S1": np.empty((k, d)), "S2": np.empty((k, d, q)), "S3": np.empty((k, d)), "nll": np.array([-log_density.sum()]), "n": np.array([float(len(x))])}
    for i in range(k):
        u = (x - m.mu[i] - z[:, i] @ m.W[i].T) / m.psi[i % len(m.psi)]
        ru = r[:, i : i + 1] * u
        out["S1"][i], out["S2"][i], out["S3"][i] = ru.sum(axis=0), ru.T @ z[:, i], (ru * u).sum(axis=0)
    return out


def gradients(s: dict[str, np.ndarray], m: Mixture) -> dict[str, np.ndarray]:
    """Of the mean negative log-likelihood, by unconstrained parameter."""
    p, n, (k, d, q) = m.raw(), s["n"][0], m.W.shape
    a = np.einsum("kdq,kqr->kdr", m.A, m.cov_z)  # C^-1 W
    dw = (s["R"][:, None, None] * a - s["S2"]) / n
    diagonal = 1 / m.psi - np.einsum("kdq,kdq->kd", a, m.A)
    dpsi = 0.5 * (s["R"][:, None] * diagonal - s["S3"]) / n
    dpsi = dpsi if len(m.psi) == k and k > 1 else dpsi.sum(axis=0, keepdims=True)
    size = np.maximum(np.linalg.norm(p["dir_raw"], axis=1, keepdims=True), m.eps_floor)
    unit = p["dir_raw"] / size
    scale = np.logaddexp(0, p["scale_rho"]) + m.eps_floor
    along = (dw * unit).sum(axis=1)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    return {"mu": -s["S1"] / n, "dir_raw": scale[:, None] / size * (dw - unit * along[:, None]), "scale_rho": along * sigmoid(p["scale_rho"]), "psi_rho": dpsi * sigmoid(p["psi_rho"]), "pi_logit": np.exp(m.log_pi) - s["R"] / n}


def gather(df: DataFrame, m: Mixture, column: str = "x", id_column: str | None = None) -> dict[str, np.ndarray]:
    """The statistics of all rows with a vector; nothing without any."""
    k, d, q = m.W.shape
    ranges = m.ranges()
    df = df.filter(F.col(column).isNotNull())
    if len(ranges) > 1:
        df, id_column = numbered(df.select(*([id_column] if id_column else []), column), id_column)
        known = density(df, m, column, id_column=id_column)  # "_row" goes with the join
        df = known.select(column, "log_density")
    parts = []
    for a, b in ranges:
        given = df.sparkSession.sparkContext.broadcast(m.part(a, b))

        def run(batches: Iterator[pa.RecordBatch], given=given, a=a, whole=len(ranges) == 1) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                x = vectors(batch.column(0))
                known = None if whole else batch.column(1).to_numpy()
                for i in range(0, len(x), 2048):
                    own = statistics(x[i : i + 2048], given.value, None if whole else known[i : i + 2048])
                    total = own if total is None else {name: total[name] + own[name] for name in own}
            if not total:
                return
            n = len(total["R"])
            for i in range(0, n, 64):
                rows = np.concatenate([total["R"][i : i + 64, None], total["S1"][i : i + 64], total["S3"][i : i + 64], total["S2"][i : i + 64].reshape(-1, d * q)], axis=1)
                key, part, values = slices(np.arange(a + i, a + min(n, i + 64)), rows)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part.astype(np.int32)), lists(values)], ["k", "part", "sums"])
            if not a:  # the rows' own sums once, under a key that no component has
                key, part, values = slices(np.array([-1]), np.array([[total["nll"][0], total["n"][0]]]))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part.astype(np.int32)), lists(values)], ["k", "part", "sums"])

        parts.append(df.select(column, *([] if len(ranges) == 1 else ["log_density"])).mapInArrow(run, "k long, part int, sums array<double>"))
    out, rest = np.zeros((k, -(-(1 + 2 * d + d * q) // SLICE), SLICE)), None
    for r in added_up(reduce(DataFrame.unionAll, parts), "k").toLocalIterator():
        if r["k"] < 0:
            rest = r["sums"]
        else:
            out[r["k"], r["part"]] = r["sums"]
    if rest is None:
        return {}
    out = out.reshape(k, -1)
    cut = 1 + 2 * d
    return {"R": out[:, 0], "S1": out[:, 1 : 1 + d], "S3": out[:, 1 + d : cut], "S2": out[:, cut : cut + d * q].reshape(k, d, q), "nll": np.array([rest[0]]), "n": np.array([rest[1]])}


def dealt(df: DataFrame, batches: int, seed: int, id_column: str, scratch: str) -> list[DataFrame]:
    """df in batches, written once by batch so that a step reads its own rows alone."""
    df.withColumn("_batch", F.pmod(F.xxhash64(F.lit(seed), id_column), F.lit(batches)).cast("int")).write.partitionBy("_batch").mode("overwrite").parquet(scratch)
    return [df.sparkSession.read.schema(df.schema).option("basePath", scratch).parquet(f"{scratch}/_batch={b}") if there else df.limit(0) for b, there in enumerate(_there(df, batches, scratch))]


def _there(df: DataFrame, batches: int, scratch: str) -> list[bool]:
    jvm = df.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(scratch)
    store = folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    return [store.exists(jvm.org.apache.hadoop.fs.Path(f"{scratch}/_batch={b}")) for b in range(batches)]


def train(df: DataFrame, model: Mixture, column: str = "x", id_column: str | None = None, validation: DataFrame | None = None, epochs: int = 5, rate: float = 1e-3, clip: float | None = None, batches: int = 1, steps_per_epoch: int | None = None, save=None, seed: int = 0, scratch: str | None = None) -> tuple[Mixture, dict]:
    """(best model, {best_epoch, best_metric, history}). batches > 1 deals rows to that many hash buckets of id_column, written once below scratch, and takes a step for each in another order each epoch; an epoch then reads the table once. The metric is the validation's mean negative log-likelihood, else the training's; a NaN never wins. Rows without a vector are left out."""
    if batches > 1 and not (id_column and scratch):
        raise ValueError("mini-batches need an id_column and a scratch folder")
    parts = [df] if batches == 1 else dealt(df.select(id_column, column), batches, seed, id_column, scratch)
    rng, moments = np.random.default_rng(seed), {}
    best, info, step = model, {"best_epoch": None, "best_metric": np.inf, "history": []}, 0
    for epoch in range(1, epochs + 1):
        total = count = 0.0
        order = [0] if batches == 1 else rng.permutation(batches)
        for b in order[: steps_per_epoch or batches]:
            s = gather(parts[b], model, column, id_column)
            if not s:
                continue
            g = gradients(s, model)
            size = np.sqrt(sum((v**2).sum() for v in g.values()))
            if clip and size > clip:
                g = {k: v * (clip / size) for k, v in g.items()}
            step += 1
            p = {}
            for name, value in model.raw().items():
                m1, m2 = moments.get(name, (0.0, 0.0))
                m1, m2 = 0.9 * m1 + 0.1 * g[name], 0.999 * m2 + 0.001 * g[name] ** 2
                moments[name] = m1, m2
                p[name] = value - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            model = Mixture.from_raw(p["mu"], p["dir_raw"], p["scale_rho"], p["psi_rho"], p["pi_logit"], model.eps_floor, model.rotation)
            total, count = total + s["nll"][0], count + s["n"][0]
        metric = mean_nll(validation, model, column, id_column) if validation is not None else total / max(count, 1)
        info["history"].append(metric)
        if metric is not None and metric < info["best_metric"]:
            best, info["best_epoch"], info["best_metric"] = model, epoch, metric
        if save:
            save(model, epoch)
    return best, info
