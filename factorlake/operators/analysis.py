"""Reading a fitted mixture: top rows and tokens, subspace coordinates, component overlap, intrinsic dimension, steering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shuffle_key
from .mixture import Mixture, attached, density, in_blocks, map_vectors, merged, numbered, shaped, summed, vectors


def _kept_scores(df: DataFrame, model: Mixture, id_column: str, column: str, kind: str, reduce_, outputs: str, *keep: str) -> DataFrame:
    """What reduce_(scores (n, components), the rows' batch) keeps of each batch, by block of components: (k, score, outputs). Rows with a score that isn't finite are left out."""
    if kind not in ("posterior", "likelihood"):
        raise ValueError(f"kind: {kind}")
    source = density(df.select(*dict.fromkeys((id_column, *keep, column))), model, column, id_column=id_column)
    source = source.filter(F.expr("log_density = log_density and abs(log_density) < double('infinity')"))
    out = []
    for a, b in model.ranges():
        given = df.sparkSession.sparkContext.broadcast(model.part(a, b))

        def run(batches: Iterator[pa.RecordBatch], given=given, a=a) -> Iterator[pa.RecordBatch]:
            m = given.value
            for batch in batches:
                for i in range(0, batch.num_rows, 2048):
                    part = batch.slice(i, 2048)
                    if not part.num_rows:
                        continue
                    ll = m.log_likelihood(vectors(part.column(part.schema.get_field_index(column))))
                    if kind == "posterior":
                        ll = np.exp(ll + m.log_pi - part.column(part.schema.get_field_index("log_density")).to_numpy()[:, None])
                    yield reduce_(ll, part, a)

        out.append(source.mapInArrow(run, outputs))
    return reduce(DataFrame.unionAll, out)


def top_rows(df: DataFrame, model: Mixture, id_column: str, topk: int = 50, kind: str = "posterior", column: str = "x", keep: tuple[str, ...] = ()) -> DataFrame:
    """(k, rank, id, keep..., score): ties to the smaller id. Each batch keeps its own top of every component, so that many rows are shuffled for each batch, not one for each row and component."""
    names = [id_column, *keep]
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)

    def own(scores: np.ndarray, part: pa.RecordBatch, first: int) -> pa.RecordBatch:
        by_id = pc.sort_indices(part.column(part.schema.get_field_index(id_column))).to_numpy()
        order = np.argsort(-scores[by_id], axis=0, kind="stable")[:topk]
        rows = by_id[order]  # (up to topk, components)
        k = np.broadcast_to(np.arange(scores.shape[1]), rows.shape)
        where = pa.array(rows.ravel())
        return pa.RecordBatch.from_arrays([pa.array((first + k).ravel().astype(np.int32)), pa.array(scores[rows, k].ravel()), *(part.column(part.schema.get_field_index(c)).take(where) for c in names)], ["k", "score", *names])

    rows = _kept_scores(df, model, id_column, column, kind, own, f"k int, score double, {types}", *keep)
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), id_column))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= topk).select("k", "rank", *names, "score")


def top_tokens(df: DataFrame, model: Mixture, id_column: str, token: str, topk: int = 50, kind: str = "posterior", aggregate: str = "max", column: str = "x") -> DataFrame:
    """(k, rank, token, score) with a token's scores added or their maximum. Each batch sends one row for each of its tokens and components."""
    how, put = {"max": (F.max, np.maximum), "sum": (F.sum, np.add)}[aggregate]
    kind_of = df.schema[token].dataType.simpleString()

    def own(scores: np.ndarray, part: pa.RecordBatch, first: int) -> pa.RecordBatch:
        coded = part.column(part.schema.get_field_index(token)).dictionary_encode("encode")
        which, n = coded.indices.to_numpy(), len(coded.dictionary)
        out = np.full((n, scores.shape[1]), -np.inf if aggregate == "max" else 0.0)
        put.at(out, which, scores)
        k = np.tile(np.arange(scores.shape[1]), n)
        return pa.RecordBatch.from_arrays([pa.array((first + k).astype(np.int32)), pa.array(out.ravel()), coded.dictionary.take(pa.array(np.repeat(np.arange(n), scores.shape[1])))], ["k", "score", "token"])

    rows = _kept_scores(df, model, id_column, column, kind, own, f"k int, score double, token {kind_of}", token).groupBy("k", "token").agg(how("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), "token"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= topk).select("k", "rank", "token", "score")


def cluster_sizes(assigned: DataFrame, n: int, column: str = "best") -> DataFrame:
    """(k, size) for all k below n, empty ones too."""
    sizes = assigned.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("size"))
    return assigned.sparkSession.range(n).withColumnRenamed("id", "k").join(sizes, "k", "left").select("k", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """min, max, mean, the lower median, and how many are 0; nulls over no rows."""
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.avg(column).alias("mean"), F.expr(f"percentile_disc(0.5) within group (order by {column})").alias("median"), F.count_if(F.col(column) == 0).alias("empty"))


# Subspaces


def subspace_basis(model: Mixture, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(U, G^-1): unit loadings and the inverse of their Gram matrix, with a growing jitter, at last a pseudo-inverse."""
    w = model.rotated_W()[k]
    u = w / np.maximum(np.linalg.norm(w, axis=0, keepdims=True), 1e-12)
    gram, jitter = u.T @ u, 1e-8
    try:
        np.linalg.cholesky(gram)
        return u, np.linalg.inv(gram)
    except np.linalg.LinAlgError:
        pass
    for _ in range(6):
        try:
            np.linalg.cholesky(gram + jitter * np.eye(len(gram)))
            return u, np.linalg.inv(gram + jitter * np.eye(len(gram)))
        except np.linalg.LinAlgError:
            jitter *= 10
    return u, np.linalg.pinv(gram)


def project(df: DataFrame, model: Mixture, k: int, column: str = "x", how: str = "hard", least: float = 0.2, tau: float = 1.0, center: bool = False, most: int | None = None, id_column: str | None = None) -> DataFrame:
    """Rows of component k (its most likely rows, or those with weight ``least`` or more) with coords, energy and ratio."""
    u, inverse = subspace_basis(model, k)
    scored = density(df, model, column, tau, k, id_column)
    own = scored.filter(F.col("best") == k) if how == "hard" else scored.filter(F.col("weight") >= least)
    own = own.limit(most) if most else own
    mu = model.mu[k]
    offset = mu - u @ (inverse @ (u.T @ mu)) if center else np.zeros_like(mu)

    def kernel(x):
        x = (x if len(x) else np.zeros((0, len(mu)))) - offset
        coords = x @ u @ inverse
        energy = ((coords @ u.T) ** 2).sum(axis=1)
        return coords, energy, energy / np.maximum((x**2).sum(axis=1), 1e-6)

    return map_vectors(own, column, kernel, "coords array<double>, energy double, ratio double")


def centroid_coords(model: Mixture, k: int, center: bool = False) -> np.ndarray:
    u, inverse = subspace_basis(model, k)
    return np.zeros(u.shape[1]) if center else inverse @ (u.T @ model.mu[k])


def scatter(projected: DataFrame, label: str, dims: tuple[int, int] = (0, 1), most: int = 200) -> DataFrame:
    """(x, y, label) of two coordinates, for a plotting library to draw."""
    return projected.select(F.col("coords")[dims[0]].alias("x"), F.col("coords")[dims[1]].alias("y"), F.col(label).alias("label")).limit(most)


# Overlap


def _inverse_products(m: Mixture, b: np.ndarray, v: np.ndarray) -> np.ndarray:
    """C_b^-1 v for covariances C = W W' + psi and columns v (n, D, c): v / psi less what the loadings take."""
    plain = v / np.broadcast_to(m.psi, m.mu.shape)[b][:, :, None]
    return plain - m.A[b] @ (m.cov_z[b] @ (m.W[b].transpose(0, 2, 1) @ plain))


def _pair(m: Mixture, i: np.ndarray, j: np.ndarray, jitter: float) -> dict[str, np.ndarray]:
    (_, d, q), psi = m.W.shape, np.broadcast_to(m.psi, m.mu.shape)
    delta = m.mu[j] - m.mu[i]

    def divergence(a, b):
        """KL(a, b). One product with C_b^-1 of b's noise-weighted loadings, a's loadings and the offset gives all its terms."""
        columns = np.concatenate([m.W[a], delta[:, :, None]], axis=2)
        solved = _inverse_products(m, b, columns)
        quadratic = np.einsum("ndc,ndc->nc", columns, solved)  # a's loadings, then the Mahalanobis term
        # trace(C_b^-1 psi_a): the diagonal of C_b^-1 is 1 / psi less that of A cov A'
        diagonal = 1 / psi[b] - np.einsum("ndq,ndq->nd", m.A[b] @ m.cov_z[b], m.A[b])
        return 0.5 * ((diagonal * psi[a]).sum(axis=1) + quadratic.sum(axis=1) - d + m.log_det[b] - m.log_det[a])

    noise = 0.5 * (psi[i] + psi[j])
    half = np.sqrt(0.5) * np.concatenate([m.W[i], m.W[j]], axis=2)
    scaled = half / np.sqrt(noise)[:, :, None]
    shift = delta / np.sqrt(noise)
    small = scaled.transpose(0, 2, 1) @ scaled + (1 + jitter) * np.eye(2 * q)
    root = np.linalg.cholesky(small)
    seen = np.linalg.solve(root, scaled.transpose(0, 2, 1) @ shift[:, :, None])[:, :, 0]
    mean = ((shift**2).sum(axis=1) - (seen**2).sum(axis=1)) / 8
    log_det = np.log(noise).sum(axis=1) + 2 * np.log(np.einsum("nqq->nq", root)).sum(axis=1)
    cov = 0.5 * log_det - 0.25 * (m.log_det[i] + m.log_det[j])
    return {"kl_sym": 0.5 * (divergence(i, j) + divergence(j, i)), "db": mean + cov, "db_mean": mean, "db_cov": cov, "bc": np.exp(-(mean + cov))}


def overlap(spark, model: Mixture, jitter: float = 1e-6, chunk: int = 1024) -> DataFrame:
    """(i, j, kl_sym, db, db_mean, db_cov, bc) for all pairs of components i < j: its feature. Pairs of component blocks go to maps that hold those two blocks alone; in each, rows of the triangle are dealt to tasks, which make their own pairs."""
    names = ["kl_sym", "db", "db_mean", "db_cov", "bc"]
    blocks, out = model.ranges(), []
    for x, (a, b) in enumerate(blocks):
        for c, d in blocks[x:]:
            both = model.part(a, b) if a == c else _joined(model.part(a, b), model.part(c, d))
            given = spark.sparkContext.broadcast(both)

            def run(batches: Iterator[pa.RecordBatch], given=given, a=a, b=b, c=c, d=d) -> Iterator[pa.RecordBatch]:
                shift = 0 if a == c else b - a - c  # of the second block's places
                for batch in batches:
                    for i in batch.column(0).to_pylist():
                        low = i + 1 if a == c else c
                        for at in range(low, d, chunk):
                            j = np.arange(at, min(d, at + chunk))
                            got = _pair(given.value, np.full(len(j), i - a), j - a if a == c else j + shift, jitter)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i)), pa.array(j), *(pa.array(got[n]) for n in names)], ["i", "j", *names])

            rows = spark.range(a, b).repartition(max(1, min(b - a, spark.sparkContext.defaultParallelism * 4)), "id")
            out.append(rows.mapInArrow(run, "i long, j long, " + ", ".join(f"{n} double" for n in names)))
    return reduce(DataFrame.unionAll, out)


def _joined(one: Mixture, other: Mixture) -> Mixture:
    psi = one.psi if len(one.psi) == 1 and np.array_equal(one.psi, other.psi) else np.concatenate([np.broadcast_to(m.psi, m.mu.shape) for m in (one, other)])
    return Mixture(np.concatenate([one.mu, other.mu]), np.concatenate([one.W, other.W]), psi, np.concatenate([one.log_pi, other.log_pi]), one.eps_floor)


def linkage_order(distance: np.ndarray) -> list[int]:
    """Leaves in the order of an average-linkage tree over a symmetric matrix of distances, built by chains of nearest neighbours."""
    d, n = np.array(distance, float), len(distance)
    np.fill_diagonal(d, np.inf)
    size, members, chain, left = np.ones(n), [[i] for i in range(n)], [], set(range(n))
    while len(left) > 1:
        if not chain:
            chain.append(min(left))
        a = chain[-1]
        b = int(np.argmin(d[a]))
        if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
            b = chain[-2]
            del chain[-2:]
            a, b = min(a, b), max(a, b)
            joint = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            d[a] = d[:, a] = joint
            d[b] = d[:, b] = d[a, a] = np.inf
            size[a] += size[b]
            members[a] += members[b]
            left.remove(b)
        else:
            chain.append(b)
    return members[min(left)] if n else []


def heatmap(pairs: DataFrame, n: int, column: str = "bc", most: int = 4000) -> tuple[np.ndarray, list[int]]:
    """The (n, n) matrix of overlaps for a plotting library to draw, and the order that puts similar components beside each other. Its n * n numbers are the driver's, so n is bounded."""
    if n > most:
        raise ValueError(f"{n} components are too many to draw")
    out = np.eye(n)
    for r in pairs.select("i", "j", column).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r[column]
    return out, linkage_order(1 - out)


# Intrinsic dimension


def pca_dim(values: np.ndarray, threshold: float) -> int:
    """First index, from 1, at which squared singular values' cumulative share reaches the threshold; all of them without variance."""
    total = values.sum()
    if not total > 0:
        return len(values)
    reached = np.cumsum(values) / total >= threshold
    return int(np.argmax(reached)) + 1 if reached.any() else len(values)


def intrinsic_dims(df: DataFrame, model: Mixture, id_column: str, column: str = "x", threshold: float = 0.9, least: int = 100, most: int | None = None, seed: int = 42, rows_each: int = 1 << 20) -> DataFrame:
    """(k, size, dim): the PCA dimension of each component's rows, all of them or ``most`` random ones; 0 for fewer than ``least``.

    Rows are dealt by component, those of a component with more than rows_each to several tasks (64 at most); each task
    forms one component's moments (D x D) at a time. A cluster is never gathered."""
    spark = df.sparkSession
    assigned = density(df.select(id_column, column), model, column, id_column=id_column).select(id_column, column, "best")
    sizes = cluster_sizes(assigned, len(model.mu))
    some = assigned.filter("best >= 0")
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("best").orderBy(shuffle_key(F.col(id_column), seed), id_column))
        some = some.withColumn("rank", rank).filter(F.col("rank") <= most)
    d = model.mu.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shift, n, total, square = None, None, 0, None, None

        def out() -> pa.RecordBatch:
            """The rows' number, mean and scatter about it."""
            moved = total / n
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([float(n)]), pa.array([np.concatenate([shift + moved, (square - n * np.outer(moved, moved)).ravel()]).tobytes()], pa.binary())], ["k", "n", "moments"])

        for batch in batches:
            x, best = vectors(batch.column(1)), batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if best[a] != now:
                    if n:
                        yield out()
                    now, shift, n, total, square = int(best[a]), x[a], 0, np.zeros(d), np.zeros((d, d))
                own = x[a:b] - shift
                n += len(own)
                total += own.sum(axis=0)
                square += own.T @ own
        if n:
            yield out()

    def dims(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n, parts = np.array(table["n"].to_pylist()), [np.frombuffer(b) for b in table["moments"].to_pylist()]
        means = np.array([p[:d] for p in parts])
        off = means - n @ means / n.sum()
        scatter = sum(p[d:] for p in parts).reshape(d, d) + (off * n[:, None]).T @ off
        values = np.linalg.eigvalsh(scatter)[::-1].clip(0)[: int(min(n.sum(), d))]
        return pa.table({"k": [key[0].as_py()], "dim": [1 if n.sum() < 2 else pca_dim(values, threshold)]})

    salt = F.pmod(F.xxhash64(id_column), F.least(F.ceil(F.col("size") / rows_each), F.lit(64))).cast("int")
    dealt = some.join(sizes.withColumnRenamed("k", "best"), "best").withColumn("salt", salt).select("best", column, "salt")
    moments = dealt.repartition("best", "salt").sortWithinPartitions("best", "salt").select("best", column).mapInArrow(partial, "k long, n double, moments binary")
    found = moments.groupBy("k").applyInArrow(dims, "k long, dim long")
    return sizes.join(found, "k", "left").select("k", "size", F.when(F.col("size") >= least, F.col("dim")).otherwise(0).alias("dim"))


# Steering

SITES = ("mlp", "mlp_out", "residual", "residual_pre", "attn_out")


def _targets(df: DataFrame, model: Mixture, column: str, id_column: str | None, z=None, per: str = "shared") -> DataFrame:
    """df with _target: the posterior's mean of centroids, and with z after it the mean of the loadings' steps. By blocks for models past a broadcast."""
    d, ranges = model.mu.shape[1], model.ranges()

    def of(m: Mixture, first: int, weights: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        centre = weights @ m.mu
        if z is None:
            return centre
        w = m.rotated_W()
        steps = weights[:, :, None] * (own[:, None, :] if per == "row" else z[first : first + len(w)] if per == "component" else z)
        return np.concatenate([centre, steps.reshape(len(weights), -1) @ w.transpose(0, 2, 1).reshape(-1, d)], axis=1)

    also = (z,) if per == "row" and z is not None else ()
    if len(ranges) == 1:
        given = df.sparkSession.sparkContext.broadcast(model)

        def kernel(x, own=None):
            m = given.value
            x = shaped(x, d)
            return (of(m, 0, m.posterior(m.log_likelihood(x)), own),)

        return map_vectors(df, column, kernel, "_target array<double>", also)
    df, id_column = numbered(df, id_column)
    parts = in_blocks(df, model, id_column, column, 1.0, lambda m, a, x, ll, _, e, own=None: (of(m, a, e, own),), "target array<double>", also)
    return attached(df, merged(parts, id_column, 1.0, _target=summed("target", d if z is None else 2 * d)), id_column, "_target")


def steer_mean(df: DataFrame, model: Mixture, alpha: float, k: int | None = None, column: str = "x", id_column: str | None = None) -> DataFrame:
    """df with steered: (1 - alpha) x + alpha target, the target a component's centroid or the posterior's mean of centroids."""
    if k is not None:
        centre = model.mu[k]
        return map_vectors(df, column, lambda x: ((1 - alpha) * shaped(x, len(centre)) + alpha * centre,), "steered array<double>")
    d, source = model.mu.shape[1], _targets(df, model, column, id_column)
    return map_vectors(source, column, lambda x, target: ((1 - alpha) * shaped(x, d) + alpha * target,), "steered array<double>", ("_target",)).drop("_target")


def steer_latent(df: DataFrame, model: Mixture, alpha: float, z, k: int | None = None, column: str = "x", per: str = "shared", id_column: str | None = None) -> DataFrame:
    """df with steered: towards the centroid, then along loadings by z. per says what z is: ``shared`` (q,), ``component`` (K, q) with k None, or ``row``, the name of a column of arrays."""
    q, d = model.W.shape[2], model.mu.shape[1]
    if per not in ("shared", "component", "row"):
        raise ValueError(f"per: {per}")
    if per != "row":
        z = np.asarray(z, float)
        if z.shape != ((q,) if per == "shared" else (len(model.mu), q)) or (per == "component" and k is not None):
            raise ValueError(f"z has the shape {z.shape}")
    if k is not None:
        centre, w = model.mu[k], model.part(k, k + 1).rotated_W()[0]

        def kernel(x, own=None):
            x = shaped(x, d)
            return (x + alpha * (centre - x) + (z if own is None else own) @ w.T,)

        return map_vectors(df, column, kernel, "steered array<double>", (z,) if per == "row" else ())
    source = _targets(df, model, column, id_column, z, per)
    return map_vectors(source, column, lambda x, t: (shaped(x, d) + alpha * (t[:, :d] - x) + t[:, d:],), "steered array<double>", ("_target",)).drop("_target")


def top_deltas(df: DataFrame, delta: str, n: int, id_column: str) -> dict[str, DataFrame]:
    """The largest, the smallest and the largest absolute changes."""
    return {"up": df.orderBy(F.desc(delta), id_column).limit(n), "down": df.orderBy(delta, id_column).limit(n), "absolute": df.orderBy(F.desc(F.abs(delta)), id_column).limit(n)}


