"""A query for each operator, over the whole of its stand-in table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import all_finite, first_text, norm, normalised, shuffle_key, tokens
from ..operators import analysis, corpus, extraction, kmeans, mixture, training
from ..sources import activations, folders, prompts

WINDOW = 64


def r4(c) -> Column:
    return (F.round(F.col(c) if isinstance(c, str) else c, 4) + F.lit(0.0)).cast("double")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rows(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with an id and a class."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("x"))


def model(spark: SparkSession, d: str) -> mixture.Mixture:
    return mixture.from_labels(rows(spark, d))


def long(df: DataFrame, column: str, name: str, *keep: str) -> DataFrame:
    return df.select("row_id", *keep, F.posexplode(column).alias("k", "v")).select("row_id", *keep, F.col("k").cast("long").alias("k"), r4("v").alias(name))


def scored(spark: SparkSession, d: str, tau: float = 1.0) -> DataFrame:
    return mixture.score(rows(spark, d), model(spark, d), tau=tau)


def numbered_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Turns as prompts; their position is the order of conversation and turn."""
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), first_text(F.col("text")).alias("prompt"), "role")


# Prompts


def prompt_extract(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", first_text(F.lit(" "), F.col("text")).alias("prompt")).filter("prompt is not null")


def prompt_dedup(spark, d):
    return numbered_conversations(spark, d).groupBy("prompt").agg(F.min("pos").alias("pos"))


def prompt_batches(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("prompt"))
    return prompts.batches(docs, 16).select("batch", F.md5(F.array_join("prompts", ",")).alias("prompts_md5"), F.size("prompts").cast("long").alias("n"))


def labelled_pairs(spark, d):
    return numbered_conversations(spark, d).select("pos", "prompt", first_text(F.col("role")).alias("label")).filter("prompt is not null and label is not null")


def positional_select(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("prompt"))
    return prompts.select_positions(docs, [7, 3, 3, 11, 0]).select("ord", "pos", "prompt")


def prompt_files(spark, d):
    """Benchmark items written as a jsonl file and read back as prompts."""
    at = folders.scratch(spark, "prompts") + ".jsonl"
    table(spark, d, "benchmark").select(F.to_json(F.struct("text")).alias("value")).coalesce(1).write.text(at)
    return prompts.read_prompts(spark, at).select("prompt")


def prompt_csv(spark, d):
    """Benchmark items written as a csv file and read back as prompts, the first of each."""
    at = folders.scratch(spark, "prompts") + ".csv"
    table(spark, d, "benchmark").select(F.col("text").alias("prompt"), "item_id").coalesce(1).write.option("escape", '"').csv(at, header=True)
    return prompts.read_prompts(spark, at, dedup=True).select("prompt")


def subset_head(spark, d):
    """How many rows an early-stopping read of one language gives."""
    return corpus.first_of_subset(documents(spark, d), "lang", "de", 20).agg(F.count("*").alias("n"), F.bool_and(F.col("lang") == "de").alias("all_de"))


def labelled_files(spark, d):
    """Turns written as a csv file and read back as labelled prompts."""
    at = folders.scratch(spark, "labelled") + ".csv"
    table(spark, d, "conversations").select(F.col("text"), F.col("role").alias("label")).coalesce(1).write.option("escape", '"').csv(at, header=True)
    return prompts.read_labelled(spark, at).select("prompt", "label")


# Tokens and windows


def documents(spark, d):
    return table(spark, d, "documents")


def token_frequency(spark, d):
    return corpus.token_frequency(corpus.token_rows(documents(spark, d), tokens(F.col("text"))))


def inverse_freq_weights(spark, d):
    return corpus.inverse_frequency_weights(token_frequency(spark, d)).select("token", "freq", F.round("weight", 6).alias("weight"))


def token_rows_with_labels(spark, d):
    out = extraction.token_ids(documents(spark, d).join(table(spark, d, "labels"), "doc_id"), "doc_id", label="toxic")
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "token", F.col("toxic").cast("long").alias("label"))


def single_token_filter(spark, d):
    return extraction.single_token(extraction.token_ids(documents(spark, d), "doc_id"), "the").select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


def token_freq_lookup(spark, d):
    # Counted by document first, so that the join takes a row for each of a document's words, not for each place.
    counted = extraction.token_ids(documents(spark, d), "doc_id").groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    frequency = counted.groupBy("token").agg(F.sum("n").alias("freq"))
    return corpus.with_frequency(counted, frequency).groupBy("doc_id").agg(F.sum(F.col("freq") * F.col("n")).alias("total_freq"), F.max("freq").alias("top_freq"))


def windows_build(spark, d):
    w = corpus.windows(documents(spark, d), WINDOW)
    return w.select("doc_id", F.col("lang").alias("subset"), *(F.col(c).cast("long").alias(c) for c in ("doc_len", "window_start", "window_end")), F.array_join("window_ids", " ").alias("window_text"), F.md5("prefix_text").alias("prefix_md5"))


def windows_quota(spark, d):
    docs = documents(spark, d).select("doc_id", "lang", F.size(tokens(F.col("text"))).alias("doc_len"))
    return corpus.quota(docs, "lang", 20, "doc_id", F.col("doc_len") >= WINDOW).select("doc_id", "lang", F.col("doc_len").cast("long").alias("doc_len"))


def subset_counts(spark, d):
    return corpus.subset_counts(documents(spark, d), "lang", WINDOW).select("lang", "n", "n_tokens")


def first_per_subset(spark, d):
    return corpus.first_per_subset(documents(spark, d), "source", "doc_id").select("source", "doc_id")


def window_length_check(spark, d):
    w = corpus.windows(documents(spark, d), WINDOW)
    return w.select(F.size("window_ids").cast("long").alias("length"), F.arrays_overlap("window_ids", F.array(F.lit("endoftext"))).alias("special")).distinct()


def special_filter(spark, d):
    from ..functions import without

    return documents(spark, d).select("doc_id", F.size(without(tokens(F.col("text")), F.array(F.lit("the"), F.lit("of")))).cast("long").alias("n"))


def stratified_split(spark, d):
    return corpus.stratified_split(documents(spark, d).select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", "split")


def split_counts(spark, d):
    return stratified_split(spark, d).groupBy("split", "lang").agg(F.count("*").alias("n"))


def train_rows_semi(spark, d):
    kept = stratified_split(spark, d).filter("split = 'train'").select(F.col("doc_id").alias("row_id"))
    return rows(spark, d).join(kept, "row_id", "left_semi").select("row_id", "label")


def union_shards(spark, d):
    docs = documents(spark, d).select("doc_id", "lang").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    parts = [docs.filter(F.col("shard") == i).drop("shard") for i in range(4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def shard_resume_todo(spark, d):
    planned = rows(spark, d).select(F.lit(0).alias("layer"), (F.col("row_id") % 16).cast("int").alias("shard")).distinct()
    return activations.todo(planned, planned.filter("shard < 5")).select(F.col("layer").cast("long").alias("layer"), F.col("shard").cast("long").alias("shard"))


def shard_round_trip(spark, d):
    """Vectors written as shards, and read back without each row's first position."""
    at = folders.scratch(spark, "shards")
    one = rows(spark, d).select(F.lit(0).alias("layer"), (F.col("row_id") % 8).cast("int").alias("shard"), F.lit(0).alias("row_in_shard"), F.col("row_id").alias("global_row"), (F.col("label") % 3).cast("int").alias("pos"), F.col("label").cast("string").alias("subset"), F.col("label").cast("int").alias("token_id"), "x")
    activations.write_shards(one, at)
    return activations.read_shards(spark, at, 0, [1, 2, 5], drop_prefix=1).select("global_row", F.col("shard").cast("long").alias("shard"), r4(F.col("x")[0].cast("double")).alias("first"))


def row_slice(spark, d):
    return corpus.row_range(rows(spark, d), 30, 90, "row_id").select("row_id", "label")


def row_head(spark, d):
    return corpus.head(rows(spark, d), 25, "row_id").select("row_id", "label")


def token_names(spark, d):
    import public_tokenizers

    vocabulary = activations.read_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    named = corpus.with_names(rows(spark, d).select("row_id", F.col("label").cast("int").alias("token_id")), vocabulary)
    return named.select("row_id", F.col("token_id").cast("long").alias("token_id"), "token")


def weight_lookup(spark, d):
    ids = extraction.token_ids(documents(spark, d), "doc_id").groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    weights = corpus.inverse_frequency_weights(token_frequency(spark, d))
    return corpus.weighted_rows(ids, weights).groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.col("n")), 4).alias("weight"))


def random_window_order(spark, d):
    key = shuffle_key(F.col("row_id"), 7)
    return rows(spark, d).select("row_id", F.row_number().over(Window.partitionBy("label").orderBy(key, "row_id")).cast("long").alias("place"), "label")


# Vectors


def row_norms(spark, d):
    return rows(spark, d).select("row_id", r4(norm(F.col("x"))).alias("norm"), r4(normalised(F.col("x"))[0]).alias("first"))


def finite_rows(spark, d):
    return rows(spark, d).filter(all_finite(F.col("x"))).select("row_id")


def pos_norms(spark, d):
    return extraction.position_norms(rows(spark, d).withColumnRenamed("label", "pos")).select("pos", "n", r4("mean_norm").alias("mean_norm"), "finite")


def layer_concat(spark, d):
    one = rows(spark, d).select(F.col("row_id").alias("global_row"), F.lit(0).alias("pos"), F.col("label").alias("token_id"), "x")
    both = one.withColumn("layer", F.lit(0)).unionByName(one.withColumn("layer", F.lit(1)).withColumn("x", F.reverse("x")))
    return activations.concat_layers(both, [0, 1]).select(F.col("global_row").alias("row_id"), F.size("x").cast("long").alias("n"), r4(F.col("x")[64].cast("double")).alias("first_of_second"))


def weighted_sample(spark, d):
    return corpus.weighted_sample(rows(spark, d), 50, "row_id", F.col("label").cast("double") + 1.0).select("row_id", F.round("key", 8).alias("key"))


def random_points(spark, d):
    return corpus.random_rows(rows(spark, d), 20, "row_id").select("row_id", "label")


# k-means: starting from class means


def centroids(spark, d) -> np.ndarray:
    return model(spark, d).mu


def kmeans_assign(spark, d):
    return kmeans.assign(rows(spark, d), centroids(spark, d)).select("row_id", "cluster", r4("cost").alias("cost"))


def kmeans_assign_cosine(spark, d):
    return kmeans.assign(rows(spark, d), centroids(spark, d), metric="cosine").select("row_id", "cluster", r4("cost").alias("cost"))


def kmeans_step(spark, d):
    sums, n, _ = kmeans.means(rows(spark, d), centroids(spark, d))
    return spark.createDataFrame([(k, i, round(float(v), 4) + 0.0) for k in range(len(n)) if n[k] for i, v in enumerate(sums[k] / n[k])], "cluster long, d long, mean double")


def kmeans_inertia(spark, d):
    return kmeans.assign(rows(spark, d), centroids(spark, d)).agg(r4(F.sum("cost")).alias("inertia"))


def kmeans_fit(spark, d):
    fit = kmeans.reservoir_kmeans(rows(spark, d), 8, 400, "row_id", weight=F.lit(1.0), iterations=20, restarts=2, refine_epochs=3)
    return kmeans.assign(rows(spark, d), fit.centroids).select("row_id", "cluster", "cost")


def projected_refine(spark, d):
    fit = kmeans.reservoir_kmeans(rows(spark, d), 8, 400, "row_id", proj_dim=16, iterations=20, restarts=2, refine_epochs=3)
    return kmeans.assign(rows(spark, d), fit.centroids).select("row_id", "cluster", "cost")


# Mixture


def mfa_log_likelihood(spark, d):
    return long(scored(spark, d), "ll", "ll")


def mfa_responsibilities(spark, d):
    return long(scored(spark, d), "resp", "r")


def mfa_responsibilities_tau(spark, d):
    return long(scored(spark, d, 2.0), "resp", "r")


def mfa_log_prob(spark, d):
    return scored(spark, d).select("row_id", r4("log_density").alias("log_prob"))


def mfa_nll(spark, d):
    return scored(spark, d).agg(r4(F.avg(-F.col("log_density"))).alias("nll"))


def mfa_posterior(spark, d):
    return long(scored(spark, d).withColumn("z", F.transform("ez", lambda z: z[0])), "z", "z")


def mfa_reconstruct(spark, d):
    out = mixture.reconstruct(rows(spark, d), model(spark, d)).select("row_id", F.posexplode("recon").alias("d", "v"))
    return out.select("row_id", F.col("d").cast("long").alias("d"), r4("v").alias("recon"))


def mfa_encode(spark, d):
    out = mixture.encode(rows(spark, d), model(spark, d)).select("row_id", F.posexplode("coefficients").alias("k", "c"))
    return out.select("row_id", F.col("k").cast("long").alias("k"), r4(F.col("c")[0]).alias("alpha"), r4(F.col("c")[1]).alias("alpha_z"))


def mfa_decode(spark, d):
    m = model(spark, d)
    out = mixture.decode(mixture.encode(rows(spark, d), m), m).select("row_id", F.posexplode("decoded").alias("d", "v"))
    return out.select("row_id", F.col("d").cast("long").alias("d"), r4("v").alias("recon"))


def mfa_dictionary(spark, d):
    out = mixture.components(spark, model(spark, d)).select("k", F.coalesce("j", F.lit(-1)).alias("j"), F.posexplode("atom").alias("d", "v"))
    return out.select(*(F.col(c).cast("long").alias(c) for c in "kjd"), r4("v").alias("v"))


def mfa_hard_assign(spark, d):
    top = scored(spark, d)
    return top.select("row_id", F.col("best").alias("k"), r4(F.get("resp", F.col("best").cast("int"))).alias("r"), r4(F.get("ez", F.col("best").cast("int"))[0]).alias("z"), r4("log_density").alias("log_prob"))


def mfa_cluster_sizes(spark, d):
    m = model(spark, d)
    return analysis.cluster_sizes(mixture.score(rows(spark, d), m), len(m.mu) + 1)


def cluster_size_summary(spark, d):
    s = analysis.summary(mfa_cluster_sizes(spark, d), "size")
    return s.select("low", "high", r4("mean").alias("mean"), F.col("median").cast("long").alias("median"), "empty")


def mfa_blocks(spark, d):
    return mixture.score_in_blocks(rows(spark, d), model(spark, d), "row_id").select("row_id", r4("log_density").alias("log_prob"), F.col("best").alias("k"))


def _rank_two(spark, d) -> mixture.Mixture:
    """Class means, unit noise, two loadings along the first axes of the space."""
    mu = centroids(spark, d)
    w = np.zeros((*mu.shape, 2))
    w[:, 0, 0], w[:, 1, 0], w[:, 1, 1], w[:, 2, 1] = 0.5, 0.25, 0.5, -0.25
    return mixture.Mixture(mu, w, np.ones((1, mu.shape[1])), np.full(len(mu), -np.log(len(mu))))


def mfa_rank_q_scores(spark, d):
    return mixture.score(rows(spark, d), _rank_two(spark, d)).select("row_id", F.col("best").alias("k"), r4("log_density").alias("log_prob"), r4(F.get("ez", F.col("best").cast("int"))[0]).alias("z0"), r4(F.get("ez", F.col("best").cast("int"))[1]).alias("z1"))


def checkpoint_scores(spark, d):
    """The model saved and loaded again."""
    at, m = folders.scratch(spark, "model"), model(spark, d)
    activations.save_mixture(spark, m, at)
    return mixture.density(rows(spark, d), activations.load_mixture(spark, at)).select("row_id", F.round("log_density", 3).alias("log_prob"))


def kmeans_refine(spark, d):
    """Two epochs over all rows from the class means."""
    fit = kmeans.refine(rows(spark, d), centroids(spark, d), epochs=2, tolerance=0.0)
    return kmeans.assign(rows(spark, d), fit.centroids).select("row_id", "cluster", r4("cost").alias("cost"))


def mfa_train(spark, d):
    fitted, info = training.train(rows(spark, d), mixture.Mixture.init(centroids(spark, d), 2, psi_init=0.05, scale_init=0.1), epochs=5, rate=0.01)
    return spark.createDataFrame(list(enumerate(map(float, info["history"]), 1)), "epoch int, nll double")


def mfa_train_k500(spark, d):
    """A wide model: k-means with as many clusters as a quarter of the rows (500 at most), then an epoch of mini-batches at rank 10."""
    data = rows(spark, d)
    k = min(500, data.count() // 4)
    fit = kmeans.reservoir_kmeans(data, k, 5 * k, "row_id", proj_dim=32, iterations=5, restarts=1, refine_epochs=1)
    start = mixture.Mixture.init(fit.centroids, 10, psi_init=0.05, scale_init=0.05)
    _, info = training.train(data, start, epochs=1, id_column="row_id", batches=4, scratch=folders.scratch(spark, "dealt"))
    return spark.createDataFrame([(1, float(info["history"][0]))], "epoch int, nll double")


# Reading the mixture


def top_rows_per_component(spark, d):
    out = analysis.top_rows(rows(spark, d), model(spark, d), "row_id", 20, kind="likelihood")
    return out.select(F.col("k").cast("long").alias("k"), F.col("rank").cast("long").alias("rank"), "row_id", r4("score").alias("score"))


def top_tokens_max(spark, d):
    out = analysis.top_tokens(rows(spark, d), model(spark, d), "row_id", "label", 3, "likelihood", "max")
    return out.select(F.col("k").cast("long").alias("k"), F.col("rank").cast("long").alias("rank"), "token", r4("score").alias("score"))


def top_tokens_sum(spark, d):
    out = analysis.top_tokens(rows(spark, d), model(spark, d), "row_id", "label", 3, "likelihood", "sum")
    return out.select(F.col("k").cast("long").alias("k"), F.col("rank").cast("long").alias("rank"), "token", r4("score").alias("score"))


def _projected(spark, d, **options):
    out = analysis.project(rows(spark, d), model(spark, d), 3, **options)
    return out.select("row_id", r4(F.col("coords")[0]).alias("coord"), r4("energy").alias("energy"), r4("ratio").alias("ratio"))


def subspace_project_hard(spark, d):
    return _projected(spark, d)


def subspace_project_threshold(spark, d):
    return _projected(spark, d, how="threshold", least=0.2)


def subspace_project_centered(spark, d):
    return _projected(spark, d, center=True)


def component_pairs_kl(spark, d):
    return analysis.overlap(spark, model(spark, d)).select("i", "j", r4("kl_sym").alias("kl_sym"))


def component_pairs_bhattacharyya(spark, d):
    return analysis.overlap(spark, model(spark, d)).select("i", "j", *(r4(c).alias(c) for c in ("db", "db_mean", "db_cov", "bc")))


def intrinsic_dim(spark, d):
    return analysis.intrinsic_dims(rows(spark, d), model(spark, d), "row_id", least=10)


def _steered(df):
    return df.select("row_id", F.posexplode("steered").alias("d", "v")).select("row_id", F.col("d").cast("long").alias("d"), r4("v").alias("v"))


def steer_mean(spark, d):
    return _steered(analysis.steer_mean(rows(spark, d), model(spark, d), 0.6, 3))


def steer_mixture(spark, d):
    return _steered(analysis.steer_mean(rows(spark, d), model(spark, d), 0.6))


def steer_latent(spark, d):
    return _steered(analysis.steer_latent(rows(spark, d), model(spark, d), 0.6, [2.0], 3))


def steer_latent_mixture(spark, d):
    return _steered(analysis.steer_latent(rows(spark, d), model(spark, d), 0.6, [2.0]))


def queries() -> dict:
    own = [
        prompt_extract, prompt_dedup, prompt_batches, labelled_pairs, positional_select, token_frequency, inverse_freq_weights, token_rows_with_labels, single_token_filter,
        token_freq_lookup, windows_build, windows_quota, subset_counts, first_per_subset, window_length_check, special_filter, stratified_split, split_counts, train_rows_semi,
        union_shards, shard_resume_todo, random_window_order, row_norms, finite_rows, pos_norms, layer_concat, weighted_sample, random_points, kmeans_assign, kmeans_assign_cosine,
        kmeans_step, kmeans_inertia, kmeans_fit, projected_refine, mfa_log_likelihood, mfa_responsibilities, mfa_responsibilities_tau, mfa_log_prob, mfa_nll, mfa_posterior,
        prompt_files, prompt_csv, subset_head, labelled_files, shard_round_trip, row_slice, row_head, token_names, weight_lookup, checkpoint_scores, kmeans_refine, mfa_train_k500,
        mfa_reconstruct, mfa_encode, mfa_decode, mfa_dictionary, mfa_hard_assign, mfa_cluster_sizes, cluster_size_summary, mfa_blocks, mfa_rank_q_scores, mfa_train,
        top_rows_per_component, top_tokens_max, top_tokens_sum, subspace_project_hard, subspace_project_threshold, subspace_project_centered, component_pairs_kl,
        component_pairs_bhattacharyya, intrinsic_dim, steer_mean, steer_mixture, steer_latent, steer_latent_mixture,
    ]
    return {f.__name__: f for f in own}
