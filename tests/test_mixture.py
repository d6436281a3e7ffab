"""Golden values of a model with two components, dense formulas, properties, training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.operators import analysis, corpus, kmeans, mixture, training
from factorlake.sources import activations

GOLDEN = mixture.Mixture(np.array([[0.0, 0, 0], [2, 1, 0]]), np.array([[1.0, 0, 0.5], [0, 1, 0]])[:, :, None], np.array([[0.5, 1, 2]]), np.log([1 / 3, 2 / 3]))
ROWS = [(0, [0.0, 0.0, 0.0]), (1, [2.0, 1.0, 0.0]), (2, [1.0, 0.5, 0.0])]


def rows(spark):
    return spark.createDataFrame(ROWS, "row_id long, x array<double>")


def by_row(df, column):
    return np.array([r[0] for r in df.orderBy("row_id").select(column).collect()])


def random_model(seed=1, k=4, d=6, q=2):
    rng = np.random.default_rng(seed)
    return mixture.Mixture(rng.normal(size=(k, d)), rng.normal(size=(k, d, q)), rng.uniform(0.3, 2, (1, d)), np.log(rng.dirichlet(np.ones(k))))


def dense(m, x):
    out = []
    for k in range(len(m.mu)):
        c = m.W[k] @ m.W[k].T + np.diag(m.psi[0])
        e = x - m.mu[k]
        out.append(-0.5 * (x.shape[1] * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + np.einsum("nd,nd->n", e, np.linalg.solve(c, e.T).T)))
    return np.array(out).T


def test_golden_scores(spark):
    s = mixture.score(rows(spark), GOLDEN)
    assert np.allclose(by_row(s, "ll"), [[-3.326533, -7.353389], [-5.266533, -3.103389], [-3.811533, -4.165889]], atol=1e-6)
    assert np.allclose(by_row(s, "log_density"), [-4.390106, -3.452964, -4.033323], atol=1e-6)
    assert np.allclose(by_row(s, "resp"), [[0.965567, 0.034433], [0.054357, 0.945643], [0.416103, 0.583897]], atol=1e-6)
    assert np.allclose(by_row(mixture.score(rows(spark), GOLDEN, tau=2.0), "resp"), [[0.841156, 0.158844], [0.193388, 0.806612], [0.457752, 0.542248]], atol=1e-6)
    assert np.allclose(by_row(s, "ez")[:, :, 0], [[0, -0.5], [1.28, 0], [0.64, -0.25]], atol=1e-6)
    assert by_row(s, "best").tolist() == [0, 1, 1]
    assert np.allclose(by_row(mixture.reconstruct(rows(spark), GOLDEN), "recon"), [[0.068865, 0.017216, 0], [1.960863, 0.945643, 0.034789], [1.4341, 0.437923, 0.133153]], atol=1e-6)
    assert abs(mixture.mean_nll(rows(spark), GOLDEN) - 3.958798) < 1e-6
    assert np.allclose(GOLDEN.M[:, 0, 0], [3.125, 2]) and np.allclose(GOLDEN.log_det, [1.139434, 0.693147], atol=1e-6)


def test_golden_pairs_and_subspace(spark):
    r = analysis.overlap(spark, GOLDEN).first()
    assert (r["i"], r["j"]) == (0, 1)
    assert np.allclose([r["kl_sym"], r["db"], r["db_mean"], r["db_cov"], r["bc"]], [3.58125, 0.7050323, 0.598485, 0.106547, 0.4940926], atol=1e-5)
    assert analysis.overlap(spark, mixture.Mixture(GOLDEN.mu[:1], GOLDEN.W[:1], GOLDEN.psi, np.zeros(1))).count() == 0
    p = analysis.project(rows(spark), GOLDEN, 0, how="threshold", least=0.0)
    assert np.allclose(by_row(p, "coords")[:, 0], [0, 1.788854, 0.894427], atol=1e-6)
    assert np.allclose(by_row(p, "energy"), [0, 3.2, 0.8], atol=1e-6) and np.allclose(by_row(p, "ratio"), [0, 0.64, 0.64], atol=1e-6)
    assert analysis.centroid_coords(GOLDEN, 1, center=True).tolist() == [0.0]
    assert analysis.scatter(p.withColumn("c2", F.lit(0)), "row_id", (0, 0)).count() == 3


def test_golden_steering(spark):
    steered = lambda df: by_row(df, "steered")[2]
    assert np.allclose(steered(analysis.steer_mean(rows(spark), GOLDEN, 0.6, 1)), [1.6, 0.8, 0])
    assert np.allclose(steered(analysis.steer_mean(rows(spark), GOLDEN, 0.6)), [1.100676, 0.550338, 0], atol=1e-6)
    assert np.allclose(steered(analysis.steer_latent(rows(spark), GOLDEN, 0.6, [2.0], 1)), [1.6, 2.8, 0])
    want = [1.932883, 1.718132, 0.416103]
    assert np.allclose(steered(analysis.steer_latent(rows(spark), GOLDEN, 0.6, [2.0])), want, atol=1e-6)
    assert np.allclose(steered(analysis.steer_latent(rows(spark), GOLDEN, 0.6, [[2.0], [2.0]], per="component")), want, atol=1e-6)
    own = rows(spark).withColumn("z", F.array(F.lit(2.0)))
    assert np.allclose(steered(analysis.steer_latent(own, GOLDEN, 0.6, "z", per="row")), want, atol=1e-6)
    assert np.allclose(steered(analysis.steer_latent(own, GOLDEN, 0.6, "z", 1, per="row")), [1.6, 2.8, 0])
    with pytest.raises(ValueError):
        analysis.steer_latent(rows(spark), GOLDEN, 0.6, [1.0, 2.0])


def test_general_rank_against_dense():
    m, x = random_model(), np.random.default_rng(9).normal(size=(50, 6))
    assert np.allclose(m.log_likelihood(x), dense(m, x))
    code = m.encode(x)
    ll, z = m.log_likelihood(x, True)
    assert np.allclose(m.decode(code), np.einsum("nk,nkd->nd", m.posterior(ll), m.component_means(z)))
    turned = mixture.Mixture(m.mu, m.W, m.psi, m.log_pi, rotation=np.linalg.qr(np.random.default_rng(3).normal(size=(4, 2, 2)))[0])
    assert np.allclose(turned.decode(turned.encode(x)), m.decode(code))
    with pytest.raises(ValueError):
        mixture.Mixture.init(x, 7)


def test_partitioning_does_not_matter(spark):
    x = np.random.default_rng(5).normal(size=(300, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>")
    m = random_model()
    got = [by_row(mixture.score(df.repartition(n), m), "log_density") for n in (1, 7)]
    assert np.array_equal(*got) and np.allclose(got[0], m.log_density(dense(m, x)))
    blocks = mixture.score_in_blocks(df, m, "row_id")
    assert np.allclose(by_row(blocks, "log_density"), got[0])
    assert mixture.score(df.limit(0), m).count() == 0


def test_overlap_against_dense(spark):
    m = random_model()
    full = [m.W[k] @ m.W[k].T + np.diag(m.psi[0]) for k in range(4)]
    for r in analysis.overlap(spark, m, jitter=0.0, chunk=2).collect():
        i, j = r["i"], r["j"]
        delta, bar = m.mu[j] - m.mu[i], (full[i] + full[j]) / 2
        kl = lambda a, b, ca, cb, e: 0.5 * (np.trace(np.linalg.solve(cb, ca)) + e @ np.linalg.solve(cb, e) - 6 + np.linalg.slogdet(cb)[1] - np.linalg.slogdet(ca)[1])
        assert np.isclose(r["kl_sym"], (kl(i, j, full[i], full[j], delta) + kl(j, i, full[j], full[i], delta)) / 2)
        assert np.isclose(r["db_mean"], delta @ np.linalg.solve(bar, delta) / 8)
        assert np.isclose(r["db_cov"], 0.5 * np.linalg.slogdet(bar)[1] - 0.25 * (np.linalg.slogdet(full[i])[1] + np.linalg.slogdet(full[j])[1]))


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 5))
    for per in (False, True):
        m = mixture.Mixture.init(rng.normal(size=(3, 5)), 2, psi_per_component=per, seed=2)
        g = training.gradients(training.statistics(x, m), m)
        raw = {k: v.copy() for k, v in m.raw().items()}
        build = lambda p: mixture.Mixture.from_raw(p["mu"], p["dir_raw"], p["scale_rho"], p["psi_rho"], p["pi_logit"])
        for name, value in raw.items():
            for at in list(np.ndindex(value.shape))[:: max(1, value.size // 5)]:
                lossy = []
                for h in (1e-5, -1e-5):
                    p = {k: v.copy() for k, v in raw.items()}
                    p[name][at] += h
                    own = build(p)
                    lossy.append(-own.log_density(own.log_likelihood(x)).mean())
                assert abs((lossy[0] - lossy[1]) / 2e-5 - g[name][at]) < 1e-6, name


def test_training_improves_and_checkpoints(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(150, 4)) + 3, rng.normal(size=(150, 4)) - 3])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>")
    start = mixture.Mixture.init(x[[0, 200]], 1)
    best, info = training.train(df, start, epochs=6, rate=0.05, batches=2, id_column="row_id", clip=5.0, validation=df, scratch=f"{tmp_path}/dealt")
    assert info["best_metric"] < mixture.mean_nll(df, start) and len(info["history"]) == 6
    activations.save_mixture(spark, best, f"{tmp_path}/m", {"a": 1})
    again = activations.load_mixture(spark, f"{tmp_path}/m")
    assert np.allclose(again.W, best.W) and np.allclose(again.psi, best.psi) and np.allclose(again.log_pi, best.log_pi)


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(100, 5)) * 0.1 + 4 * np.eye(5)[k] for k in range(3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>")
    for metric in ("euclidean", "cosine"):
        for proj in (None, 3):
            fit = kmeans.reservoir_kmeans(df, 3, 90, "row_id", metric=metric, proj_dim=proj, restarts=4, refine_epochs=4, weight=F.lit(1.0))
            at = by_row(kmeans.assign(df, fit.centroids, metric=metric), "cluster")
            assert len({tuple(set(at[i : i + 100])) for i in (0, 100, 200)}) == 3
    q = kmeans.orthonormal_projector(5, 3)
    assert np.allclose(q.T @ q, np.eye(3))
    with pytest.raises(ValueError):
        kmeans.orthonormal_projector(3, 5)
    with pytest.raises(ValueError):
        kmeans.reservoir_kmeans(df, 10, 5, "row_id")
    assert kmeans.nearest(np.zeros((1, 2)), np.array([[1.0, 0], [0, 1], [-1, 0]]), block=1)[0].tolist() == [0]


def test_intrinsic_dimension(spark):
    points = np.array([[-3.0, -1, 0], [-3, 1, 0], [3, -1, 0], [3, 1, 0], [0, 0, 0]])
    values = np.linalg.svd(points - points.mean(0), compute_uv=False) ** 2
    assert analysis.pca_dim(values, 0.85) == 1 and analysis.pca_dim(values, 0.95) == 2 and analysis.pca_dim(np.zeros(3), 0.9) == 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "row_id long, x array<double>")
    one = mixture.Mixture(np.array([[0.0, 0, 0], [90, 90, 90]]), np.ones((2, 3, 1)), np.ones((1, 3)), np.log([0.5, 0.5]))
    got = {r["k"]: (r["size"], r["dim"]) for r in analysis.intrinsic_dims(df, one, "row_id", threshold=0.95, least=1).collect()}
    assert got == {0: (5, 2), 1: (0, 0)}
    assert {r["dim"] for r in analysis.intrinsic_dims(df, one, "row_id", least=100).collect()} == {0}


def test_intrinsic_dimension_counts_all_rows(spark):
    axis = "array(if(id = {0}, 1000.0D, 0.0D), if(id = {1}, 1000.0D, 0.0D), (id % 2) * 0.001D)"
    one = mixture.Mixture(np.zeros((1, 3)), np.ones((1, 3, 1)), np.ones((1, 3)), np.zeros(1))
    for a, b in ((3, 10_017), (10_700, 11_999)):  # the two rows that make two dimensions
        df = spark.range(12_000).selectExpr("id as row_id", axis.format(a, b) + " as x")
        assert [tuple(r) for r in analysis.intrinsic_dims(df, one, "row_id").collect()] == [(0, 12_000, 2)]


def test_finite_rows_and_ties(spark):
    df = spark.createDataFrame([(2, [1.0, 0.5, 0.0]), (1, [1.0, 0.5, 0.0]), (3, [float("nan"), 0.0, 0.0])], "row_id long, x array<double>")
    top = analysis.top_rows(df, GOLDEN, "row_id", 1)
    assert {(r["k"], r["row_id"]) for r in top.collect()} == {(0, 1), (1, 1)}
    assert analysis.top_deltas(df.withColumn("delta", F.col("row_id") - 2.0), "delta", 1, "row_id")["down"].first()["row_id"] == 1


def test_sampling_and_splits(spark):
    freq = spark.createDataFrame([("a", 4), ("b", 1)], "token string, freq long")
    vocabulary = spark.createDataFrame([("a",), ("b",), ("c",)], "token string")
    got = {r["token"]: r["weight"] for r in corpus.inverse_frequency_weights(freq, vocabulary).collect()}
    assert np.allclose([got["a"], got["b"], got["c"]], [0.352941, 0.882353, 1.764706], atol=1e-6)
    assert corpus.rows_per_subset(100_000_000, 17, 256) == 22977 and corpus.scan_budget(22977) == 29870
    docs = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 1).alias("s"))
    split = corpus.stratified_split(docs, "s", "doc_id", 0.07)
    assert split.filter("split = 'val'").count() == 8  # in double arithmetic
    assert corpus.split_record(split, "s", 0.07, 42, 224)["val_rows"] == 8
    assert corpus.pool_size(1000, 400, 600) == 600 and corpus.pool_size(100, 10, 600, 50) == 50
    keyed = spark.createDataFrame([(i,) for i in range(5)], "id long")
    assert corpus.weighted_sample(keyed, 9, "id", F.lit(1.0)).count() == 5
    assert corpus.sample_from_top(keyed.withColumn("s", F.col("id") * 1.0), "s", 2, 1, "id").first()["id"] in (3, 4)


def test_islands(spark, tmp_path):
    grid = ["11000", "11000", "00100", "00011"]
    cells = spark.createDataFrame([(y, x) for y, row in enumerate(grid) for x, c in enumerate(row) if c == "1"], "y long, x long")
    assert corpus.islands(cells, str(tmp_path)) == 3


def test_blocks_of_components_give_the_same(spark, monkeypatch):
    """Every operator with parameters past one broadcast against itself with one."""
    m = random_model(k=7)
    turned = mixture.Mixture(m.mu, m.W, np.random.default_rng(8).uniform(0.5, 2, (7, 6)), m.log_pi, rotation=np.linalg.qr(np.random.default_rng(3).normal(size=(7, 2, 2)))[0])
    x = np.random.default_rng(5).normal(size=(200, 6)) * 2
    df = spark.createDataFrame([(i, i % 5, v.tolist(), [float(i % 3), 0.5]) for i, v in enumerate(x)], "row_id long, token long, x array<double>, z array<double>")
    code = mixture.encode(df, turned)
    by_component = np.arange(14).reshape(7, 2) / 10

    def all_of(ids):
        own = {"id_column": "row_id"} if ids else {}
        wide = {
            "score": mixture.score(df, turned, tau=1.5, **own), "density": mixture.density(df, turned, component=4, **own), "mixed": mixture.reconstruct(df, turned, **own),
            "each": mixture.reconstruct(df, turned, mixture_mean=False, **own), "encode": mixture.encode(df, turned, tau=2.0, **own), "decode": mixture.decode(code, turned),
            "assign": kmeans.assign(df, turned.mu), "cosine": kmeans.assign(df, turned.mu, metric="cosine"), "mean": analysis.steer_mean(df, turned, 0.3, **own),
            "latent": analysis.steer_latent(df, turned, 0.3, [1.0, -1.0], **own), "component": analysis.steer_latent(df, turned, 0.3, by_component, per="component", **own), "row": analysis.steer_latent(df, turned, 0.3, "z", per="row", **own),
            "project": analysis.project(df, turned, 2, how="threshold", least=0.01, **own),
        }
        out = {}
        for name, found in wide.items():
            for c in sorted(set(found.columns) - set(df.columns) - {"coefficients"} | ({"coefficients"} if name == "encode" else set())):
                out[name, c] = by_row(found, c)
        for name, found in {
            "top": analysis.top_rows(df, turned, "row_id", 9), "likely": analysis.top_rows(df, turned, "row_id", 9, kind="likelihood"), "tokens": analysis.top_tokens(df, turned, "row_id", "token", 3, aggregate="sum"),
            "pairs": analysis.overlap(spark, turned), "dims": analysis.intrinsic_dims(df, turned, "row_id", least=2, rows_each=20),
        }.items():
            rows_ = sorted(tuple(r) for r in found.collect())
            out[name] = np.array(rows_, float)
        s = training.gather(df, turned, id_column="row_id" if ids else None)
        out |= {("gather", n): v for n, v in s.items()}
        sums, n, inertia = kmeans.means(df, turned.mu)
        return out | {"sums": sums, "n": n, "inertia": np.array(inertia), "nll": np.array(mixture.mean_nll(df, turned, id_column="row_id" if ids else None))}

    want = all_of(False)
    monkeypatch.setattr(mixture, "BROADCAST_BYTES", 900)
    assert len(turned.ranges()) > 2 and len(kmeans._blocks(np.zeros((30, 6)))) > 1
    got = all_of(True)
    assert set(got) == set(want)
    for name, value in want.items():
        assert np.allclose(got[name], value, atol=1e-9), name
    assert np.allclose(by_row(mixture.density(df, turned), "log_density"), want["density", "log_density"])


def test_null_and_ragged_vectors(spark):
    df = spark.createDataFrame([(0, None), (1, [2.0, 1.0, 0.0]), (2, [None, 0.5, 0.0]), (3, None)], "row_id long, x array<double>")
    s = mixture.score(df, GOLDEN)
    assert by_row(s, "best").tolist() == [-1, 1, -1, -1] and np.isnan(by_row(s, "log_density")).tolist() == [True, False, True, True]
    assert by_row(kmeans.assign(df, GOLDEN.mu), "cluster").tolist() == [-1, 1, -1, -1]
    assert kmeans.means(df, GOLDEN.mu)[1].tolist() == [0, 1]
    assert {r["row_id"] for r in analysis.top_rows(df, GOLDEN, "row_id", 4).collect()} == {1}
    assert mixture.score(df.filter("x is null"), GOLDEN).filter("best = -1").count() == 2
    with pytest.raises(Exception, match="vectors of 2 and of 3"):
        mixture.score(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0])], "row_id long, x array<double>").coalesce(1), GOLDEN).collect()


def test_training_finds_a_planted_mixture(spark, tmp_path):
    """Mini-batches; the likelihood comes within 1 percent of the planted model's."""
    rng = np.random.default_rng(2)
    true = mixture.Mixture(rng.normal(size=(3, 6)) * 4, rng.normal(size=(3, 6, 1)), np.full((1, 6), 0.4), np.log([0.2, 0.3, 0.5]))
    k = rng.choice(3, 3000, p=[0.2, 0.3, 0.5])
    x = true.mu[k] + (true.W[k] @ rng.normal(size=(3000, 1, 1)))[:, :, 0] + rng.normal(size=(3000, 6)) * 0.4**0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>")
    fit = kmeans.reservoir_kmeans(df, 3, 600, "row_id", iterations=20, restarts=4, refine_epochs=3)
    best, info = training.train(df, mixture.Mixture.init(fit.centroids, 1), epochs=9, rate=0.2, batches=5, id_column="row_id", scratch=f"{tmp_path}/b")
    want = -true.log_density(true.log_likelihood(x)).mean()
    assert abs(mixture.mean_nll(df, best) - want) < 0.01 * abs(want), (info, want)


def test_heatmap_order(spark):
    rng = np.random.default_rng(3)
    at = np.concatenate([rng.normal(0, 0.1, 5), rng.normal(9, 0.1, 4), rng.normal(4, 0.1, 6)])[rng.permutation(15)]
    order = analysis.linkage_order(np.abs(at[:, None] - at[None]))
    groups = [round(at[i] / 4.5) for i in order]
    assert sorted(order) == list(range(15)) and sum(a != b for a, b in zip(groups[:-1], groups[1:], strict=True)) == 2
    assert analysis.linkage_order(np.zeros((0, 0))) == [] and analysis.linkage_order(np.zeros((1, 1))) == [0]
    m = random_model()
    grid, order = analysis.heatmap(analysis.overlap(spark, m), 4)
    assert np.allclose(grid, grid.T) and np.allclose(np.diag(grid), 1) and sorted(order) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        analysis.heatmap(analysis.overlap(spark, m), 4, most=3)
