"""The queries in DuckDB SQL, written from the formulas, at rank 1."""

from __future__ import annotations

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"

_MODEL = """
x AS (SELECT vec_id AS row_id, CAST(label AS BIGINT) AS label, generate_subscripts(embedding, 1) - 1 AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
mus AS (SELECT label AS k, d, avg(v) AS mu FROM x GROUP BY label, d),
noise AS (SELECT d, var_pop(v) + 1e-3 AS psi, avg(v) AS mean FROM x GROUP BY d),
prm AS (SELECT k, d, mu, 0.5 * (mu - mean) AS w, psi FROM mus JOIN noise USING (d)),
comp AS (SELECT k, 1 + sum(w * w / psi) AS m, sum(ln(psi)) AS ldpsi, count(*) AS dim, sqrt(sum(w * w)) AS wn FROM prm GROUP BY k),
prior AS (SELECT CAST(label AS BIGINT) AS k, ln(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM embeddings)) AS lp FROM embeddings GROUP BY label),
raw AS (SELECT row_id, k, sum((v - mu) * (v - mu) / psi) AS e2, sum(w * (v - mu) / psi) AS v1 FROM x JOIN prm USING (d) GROUP BY row_id, k),
sc AS (SELECT row_id, k, v1 / m AS z, lp, -0.5 * (dim * ln(2 * pi()) + ldpsi + ln(m) + e2 - v1 * v1 / m) AS ll FROM raw JOIN comp USING (k) JOIN prior USING (k)),
mx AS (SELECT *, max(ll + lp) OVER (PARTITION BY row_id) AS top FROM sc),
rs AS (SELECT *, exp(ll + lp - top) / sum(exp(ll + lp - top)) OVER (PARTITION BY row_id) AS r, exp((ll + lp - top) / 2) / sum(exp((ll + lp - top) / 2)) OVER (PARTITION BY row_id) AS r2, top + ln(sum(exp(ll + lp - top)) OVER (PARTITION BY row_id)) AS logp FROM mx),
hard AS (SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ll + lp DESC, k) = 1),
recon AS (SELECT row_id, d, sum(r * (mu + w * z)) AS v FROM rs JOIN prm USING (k) GROUP BY row_id, d),
dist AS (SELECT row_id, k, sum((v - mu) * (v - mu)) AS d2, 1 - sum(v * mu) / (sqrt(sum(v * v)) * sqrt(sum(mu * mu))) AS dc FROM x JOIN mus USING (d) GROUP BY row_id, k),
near AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d2, k) = 1),
nearc AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY dc, k) = 1)
"""


def r4(x: str) -> str:
    return f"CAST(round({x}, 4) + 0.0 AS DOUBLE)"


def m(body: str) -> str:
    """The model's tables, more of them if body begins with a comma, and the query."""
    return f"WITH {_MODEL.rstrip()}{'' if body.startswith(',') else ' '}{body}"


_SPLIT = "SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) <= ceil(count(*) OVER (PARTITION BY lang) * 5e-2) THEN 'val' ELSE 'train' END AS split FROM documents"
_TOKEN_ROWS = f"SELECT doc_id, generate_subscripts({_TOKENS}, 1) - 1 AS pos, unnest({_TOKENS}) AS token FROM documents"
_PROMPTS = "SELECT conv_id * 1000 + turn AS pos, nullif(trim(text, ' '), '') AS prompt, role FROM conversations"


def _draw(seed: int, id_: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({id_} AS VARCHAR)), 1, 8) AS BIGINT)"


def _top(aggregate: str) -> str:
    return m(f"SELECT k, rank, token, {r4('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, token) AS rank FROM (SELECT k, label AS token, {aggregate}(ll) AS score FROM sc JOIN (SELECT DISTINCT row_id, label FROM x) USING (row_id) GROUP BY k, label)) WHERE rank <= 3")


_PAIRS = """, pr AS (
  SELECT a.k AS i, b.k AS j, sum(a.psi / b.psi) AS t1, sum(b.w * b.w * a.psi / (b.psi * b.psi)) AS t2, sum(a.w * a.w / b.psi) AS t3, sum(b.w * a.w / b.psi) AS t4,
    sum((b.mu - a.mu) * (b.mu - a.mu) / b.psi) AS t5, sum(b.w * (b.mu - a.mu) / b.psi) AS t6, count(*) AS dim,
    1 + 1e-6 + sum(a.w * a.w / (a.psi + b.psi)) AS ca, 1 + 1e-6 + sum(b.w * b.w / (a.psi + b.psi)) AS cb, sum(a.w * b.w / (a.psi + b.psi)) AS cc,
    sqrt(0.5) * sum(2 * a.w * (b.mu - a.mu) / (a.psi + b.psi)) AS va, sqrt(0.5) * sum(2 * b.w * (b.mu - a.mu) / (a.psi + b.psi)) AS vb,
    sum(2 * (b.mu - a.mu) * (b.mu - a.mu) / (a.psi + b.psi)) AS dd, sum(ln((a.psi + b.psi) / 2)) AS lbar
  FROM prm a JOIN prm b ON a.d = b.d AND a.k <> b.k GROUP BY a.k, b.k
), kl AS (
  SELECT i, j, 0.5 * (t1 - t2 / cj.m + t3 - t4 * t4 / cj.m + t5 - t6 * t6 / cj.m - pr.dim + cj.ldpsi + ln(cj.m) - ci.ldpsi - ln(ci.m)) AS v FROM pr JOIN comp ci ON ci.k = i JOIN comp cj ON cj.k = j
), bh AS (
  SELECT i, j, (dd - (cb * va * va - 2 * cc * va * vb + ca * vb * vb) / (ca * cb - cc * cc)) / 8 AS db_mean,
    0.5 * (lbar + ln(ca * cb - cc * cc)) - 0.25 * (ci.ldpsi + ln(ci.m) + cj.ldpsi + ln(cj.m)) AS db_cov
  FROM pr JOIN comp ci ON ci.k = i JOIN comp cj ON cj.k = j WHERE i < j
)"""


def _after(extra: str, body: str) -> str:
    """The model's tables, more of them (beginning with a comma), and the query."""
    return f"WITH {_MODEL.rstrip()}{extra} {body}"


def oracle_sql() -> dict[str, str]:
    window = f"SELECT doc_id, lang, ids, len(ids) AS doc_len, {_draw(42, 'doc_id')} % (len(ids) - 64 + 1) AS s FROM (SELECT doc_id, lang, {_TOKENS} AS ids FROM documents) WHERE len(ids) >= 64"
    sub = lambda who, center=False: _after(*_subspace_parts(who, center))
    return {
        "prompt_extract": "SELECT conv_id, turn, trim(text, ' ') AS prompt FROM conversations WHERE trim(text, ' ') <> ''",
        "prompt_dedup": f"SELECT prompt, min(pos) AS pos FROM ({_PROMPTS}) GROUP BY prompt",
        "prompt_batches": "SELECT CAST(doc_id // 16 AS BIGINT) AS batch, md5(string_agg(coalesce(text, ''), ',' ORDER BY doc_id)) AS prompts_md5, count(*) AS n FROM documents GROUP BY 1",
        "labelled_pairs": f"SELECT pos, prompt, trim(role, ' ') AS label FROM ({_PROMPTS}) WHERE prompt IS NOT NULL AND trim(role, ' ') <> ''",
        "positional_select": "SELECT CAST(ord AS BIGINT) AS ord, doc_id AS pos, text AS prompt FROM (VALUES (0, 7), (1, 3), (2, 3), (3, 11), (4, 0)) t(ord, place) JOIN documents ON doc_id = place",
        "token_frequency": f"SELECT token, count(*) AS freq FROM ({_TOKEN_ROWS}) GROUP BY token",
        "inverse_freq_weights": f"SELECT token, freq, round((1.0 / (freq + 1)) / avg(1.0 / (freq + 1)) OVER (), 6) AS weight FROM (SELECT token, count(*) AS freq FROM ({_TOKEN_ROWS}) GROUP BY token)",
        "token_rows_with_labels": f"SELECT doc_id, pos, token, CAST(toxic AS BIGINT) AS label FROM ({_TOKEN_ROWS}) JOIN labels USING (doc_id)",
        "single_token_filter": f"SELECT doc_id, pos, token FROM ({_TOKEN_ROWS}) WHERE token = 'the'",
        "token_freq_lookup": f"WITH t AS ({_TOKEN_ROWS}), f AS (SELECT token, count(*) AS freq FROM t GROUP BY token) SELECT doc_id, CAST(sum(freq) AS BIGINT) AS total_freq, max(freq) AS top_freq FROM t JOIN f USING (token) GROUP BY doc_id",
        "windows_build": f"SELECT doc_id, lang AS subset, doc_len, s AS window_start, s + 64 AS window_end, array_to_string(ids[s + 1 : s + 64], ' ') AS window_text, md5(array_to_string(ids[1 : s + 64], ' ')) AS prefix_md5 FROM ({window})",
        "windows_quota": f"SELECT doc_id, lang, doc_len FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM (SELECT doc_id, lang, len({_TOKENS}) AS doc_len FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 26) WHERE doc_len >= 64) WHERE rn <= 20",
        "subset_counts": "SELECT lang, count(*) AS n, count(*) * 64 AS n_tokens FROM documents GROUP BY lang",
        "first_per_subset": "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source",
        "window_length_check": f"SELECT DISTINCT CAST(len(ids[s + 1 : s + 64]) AS BIGINT) AS length, list_contains(ids[s + 1 : s + 64], 'endoftext') AS special FROM ({window})",
        "special_filter": f"SELECT doc_id, CAST(len(list_filter({_TOKENS}, lambda t: t NOT IN ('the', 'of'))) AS BIGINT) AS n FROM documents",
        "stratified_split": _SPLIT,
        "split_counts": f"SELECT split, lang, count(*) AS n FROM ({_SPLIT}) GROUP BY split, lang",
        "train_rows_semi": f"SELECT vec_id AS row_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM ({_SPLIT}) WHERE split = 'train')",
        "union_shards": "SELECT doc_id, lang FROM documents",
        "shard_resume_todo": "SELECT DISTINCT CAST(0 AS BIGINT) AS layer, CAST(vec_id % 16 AS BIGINT) AS shard FROM embeddings WHERE vec_id % 16 >= 5",
        "random_window_order": "SELECT vec_id AS row_id, CAST(label AS BIGINT) AS label, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || CAST(vec_id AS VARCHAR)), vec_id) AS place FROM embeddings",
        "prompt_files": "SELECT trim(text, ' ') AS prompt FROM benchmark WHERE trim(text, ' ') <> ''",
        "prompt_csv": "SELECT DISTINCT trim(text, ' ') AS prompt FROM benchmark WHERE trim(text, ' ') <> ''",
        "subset_head": "SELECT least(count(*), 20) AS n, true AS all_de FROM documents WHERE lang = 'de'",
        "labelled_files": "SELECT trim(text, ' ') AS prompt, trim(role, ' ') AS label FROM conversations WHERE trim(text, ' ') <> '' AND trim(role, ' ') <> ''",
        "shard_round_trip": f"SELECT vec_id AS global_row, CAST(vec_id % 8 AS BIGINT) AS shard, {r4('embedding[1]::DOUBLE')} AS first FROM embeddings WHERE vec_id % 8 IN (1, 2, 5) AND label % 3 >= 1",
        "row_slice": "SELECT vec_id AS row_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id BETWEEN 30 AND 89",
        "row_head": "SELECT vec_id AS row_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id < 25",
        # The vocabulary's first ten entries.
        "token_names": "SELECT vec_id AS row_id, CAST(label AS BIGINT) AS token_id, ['!', chr(34), '#', '$', '%', '&', chr(39), '(', ')', '*'][label + 1] AS token FROM embeddings",
        "weight_lookup": f"WITH t AS ({_TOKEN_ROWS}), f AS (SELECT token, (1.0::DOUBLE / (freq + 1)) / avg(1.0::DOUBLE / (freq + 1)) OVER () AS w FROM (SELECT token, count(*) AS freq FROM t GROUP BY token)) SELECT doc_id, round(sum(w), 4) AS weight FROM t JOIN f USING (token) GROUP BY doc_id",
        "checkpoint_scores": m("SELECT DISTINCT row_id, round(logp, 3) AS log_prob FROM hard"),
        "kmeans_refine": m(f""", c1 AS (SELECT k, d, avg(v) AS mu FROM x JOIN near USING (row_id) GROUP BY k, d),
n1 AS (SELECT row_id, k FROM (SELECT row_id, k, sum((v - mu) * (v - mu)) AS d2 FROM x JOIN c1 USING (d) GROUP BY row_id, k) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d2, k) = 1),
c2 AS (SELECT n1.k, d, avg(v) AS mu FROM x JOIN n1 USING (row_id) GROUP BY n1.k, d)
SELECT row_id, k AS cluster, {r4('d2')} AS cost FROM (SELECT row_id, k, sum((v - mu) * (v - mu)) AS d2 FROM x JOIN c2 USING (d) GROUP BY row_id, k) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d2, k) = 1"""),
        "mfa_rank_q_scores": m(f""", two AS (SELECT row_id, k, sum((v - mu) * (v - mu)) AS e2, sum(CASE d WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 0 END * (v - mu)) AS v0, sum(CASE d WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN -0.25::DOUBLE ELSE 0 END * (v - mu)) AS v1, count(*) AS dim FROM x JOIN mus USING (d) GROUP BY row_id, k),
own AS (SELECT *, (1.3125 * v0 - 0.125 * v1) / 1.70703125 AS z0, (1.3125 * v1 - 0.125 * v0) / 1.70703125 AS z1 FROM two),
lik AS (SELECT *, -0.5 * (dim * ln(2 * pi()) + ln(1.70703125) + e2 - v0 * z0 - v1 * z1) - ln((SELECT count(*) FROM comp)) AS a FROM own)
SELECT row_id, k, {r4('mx + ln(s)')} AS log_prob, {r4('z0')} AS z0, {r4('z1')} AS z1 FROM (SELECT *, sum(exp(a - mx)) OVER (PARTITION BY row_id) AS s FROM (SELECT *, max(a) OVER (PARTITION BY row_id) AS mx FROM lik)) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY a DESC, k) = 1"""),
        "row_norms": f"WITH x AS (SELECT vec_id AS row_id, embedding[1] AS f, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT row_id, {r4('sqrt(sum(v * v))')} AS norm, {r4('any_value(f)::DOUBLE / sqrt(sum(v * v))')} AS first FROM x GROUP BY row_id",
        "finite_rows": "SELECT vec_id AS row_id FROM embeddings WHERE len(list_filter(embedding, lambda v: NOT isfinite(v))) = 0",
        "pos_norms": f"WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v FROM embeddings), n AS (SELECT vec_id, label, sqrt(sum(v * v)) AS nm, bool_and(isfinite(v)) AS f FROM x GROUP BY vec_id, label) SELECT CAST(label AS BIGINT) AS pos, count(*) AS n, {r4('avg(nm)')} AS mean_norm, bool_and(f) AS finite FROM n GROUP BY label",
        "layer_concat": f"SELECT vec_id AS row_id, CAST(2 * len(embedding) AS BIGINT) AS n, {r4('embedding[64]::DOUBLE')} AS first_of_second FROM embeddings",
        "weighted_sample": f"SELECT vec_id AS row_id, round(key, 8) AS key FROM (SELECT vec_id, pow(({_draw(42, 'vec_id')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE, 1.0::DOUBLE / (label + 1)) AS key FROM embeddings) ORDER BY key DESC, vec_id LIMIT 50",
        "random_points": "SELECT vec_id AS row_id, CAST(label AS BIGINT) AS label FROM embeddings ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 20",
        "kmeans_assign": m(f"SELECT row_id, k AS cluster, {r4('d2')} AS cost FROM near"),
        "kmeans_assign_cosine": m(f"SELECT row_id, k AS cluster, {r4('dc')} AS cost FROM nearc"),
        "kmeans_step": m(f"SELECT k AS cluster, d, {r4('avg(v)')} AS mean FROM x JOIN near USING (row_id) GROUP BY k, d"),
        "kmeans_inertia": m(f"SELECT {r4('sum(d2)')} AS inertia FROM near"),
        "mfa_log_likelihood": m(f"SELECT row_id, k, {r4('ll')} AS ll FROM sc"),
        "mfa_responsibilities": m(f"SELECT row_id, k, {r4('r')} AS r FROM rs"),
        "mfa_responsibilities_tau": m(f"SELECT row_id, k, {r4('r2')} AS r FROM rs"),
        "mfa_log_prob": m(f"SELECT DISTINCT row_id, {r4('logp')} AS log_prob FROM hard"),
        "mfa_nll": m(f"SELECT {r4('avg(-logp)')} AS nll FROM hard"),
        "mfa_posterior": m(f"SELECT row_id, k, {r4('z')} AS z FROM sc"),
        "mfa_reconstruct": m(f"SELECT row_id, d, {r4('v')} AS recon FROM recon"),
        "mfa_encode": m(f"SELECT row_id, k, {r4('r')} AS alpha, {r4('r * z')} AS alpha_z FROM rs"),
        "mfa_decode": m(f"SELECT row_id, d, {r4('v')} AS recon FROM recon"),
        "mfa_dictionary": m(f"SELECT k, CAST(-1 AS BIGINT) AS j, d, {r4('mu')} AS v FROM prm UNION ALL SELECT k, CAST(0 AS BIGINT), d, {r4('w')} FROM prm"),
        "mfa_hard_assign": m(f"SELECT row_id, k, {r4('r')} AS r, {r4('z')} AS z, {r4('logp')} AS log_prob FROM hard"),
        "mfa_cluster_sizes": m("SELECT CAST(g.k AS BIGINT) AS k, count(h.row_id) AS size FROM range(0, (SELECT max(k) + 2 FROM comp)) g(k) LEFT JOIN hard h ON h.k = g.k GROUP BY g.k"),
        "cluster_size_summary": _after(", s AS (SELECT g.k, count(h.row_id) AS size FROM range(0, (SELECT max(k) + 2 FROM comp)) g(k) LEFT JOIN hard h ON h.k = g.k GROUP BY g.k)", f"SELECT min(size) AS low, max(size) AS high, {r4('avg(size)')} AS mean, CAST(quantile_disc(size, 0.5) AS BIGINT) AS median, count(*) FILTER (size = 0) AS empty FROM s"),
        "mfa_blocks": m(f"SELECT row_id, {r4('logp')} AS log_prob, k FROM hard"),
        "top_rows_per_component": m(f"SELECT k, rank, row_id, {r4('ll')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ll DESC, row_id) AS rank FROM sc) WHERE rank <= 20"),
        "top_tokens_max": _top("max"),
        "top_tokens_sum": _top("sum"),
        "subspace_project_hard": sub("SELECT row_id FROM hard WHERE k = 3"),
        "subspace_project_threshold": sub("SELECT row_id FROM rs WHERE k = 3 AND r >= 0.2"),
        "subspace_project_centered": sub("SELECT row_id FROM hard WHERE k = 3", True),
        "component_pairs_kl": _after(_PAIRS, f"SELECT a.i, a.j, {r4('(a.v + b.v) / 2')} AS kl_sym FROM kl a JOIN kl b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j"),
        "component_pairs_bhattacharyya": _after(_PAIRS, f"SELECT i, j, {r4('db_mean + db_cov')} AS db, {r4('db_mean')} AS db_mean, {r4('db_cov')} AS db_cov, {r4('exp(-db_mean - db_cov)')} AS bc FROM bh"),
        "steer_mean": m(f"SELECT row_id, d, {r4('0.4 * v + 0.6 * mu')} AS v FROM x JOIN prm USING (d) WHERE k = 3"),
        "steer_mixture": m(f"SELECT row_id, d, {r4('0.4 * any_value(v) + 0.6 * sum(r * mu)')} AS v FROM x JOIN rs USING (row_id) JOIN prm USING (k, d) GROUP BY row_id, d"),
        "steer_latent": m(f"SELECT row_id, d, {r4('v + 0.6 * (mu - v) + 2 * w')} AS v FROM x JOIN prm USING (d) WHERE k = 3"),
        "steer_latent_mixture": m(f"SELECT row_id, d, {r4('0.4 * any_value(v) + 0.6 * sum(r * mu) + 2 * sum(r * w)')} AS v FROM x JOIN rs USING (row_id) JOIN prm USING (k, d) GROUP BY row_id, d"),
    }


def _subspace_parts(who: str, center: bool) -> tuple[str, str]:
    offset = "mu - u * mu_u" if center else "0"
    extra = f""", uv AS (SELECT d, w / wn AS u, mu, (SELECT sum(mu * w / wn) FROM prm JOIN comp USING (k) WHERE k = 3) AS mu_u FROM prm JOIN comp USING (k) WHERE k = 3),
p AS (SELECT row_id, sum((v - ({offset})) * u) AS c, sum((v - ({offset})) * (v - ({offset}))) AS n2 FROM x JOIN uv USING (d) WHERE row_id IN ({who}) GROUP BY row_id)"""
    return extra, f"SELECT row_id, {r4('c')} AS coord, {r4('c * c')} AS energy, {r4('c * c / greatest(n2, 1e-6)')} AS ratio FROM p"
