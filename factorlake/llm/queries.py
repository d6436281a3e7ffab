"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontamination, fingerprints, licenses, near_duplicates, packing, sentence_spans, token_store, toxicity, url_filter
from .shared import Scratch, table

# Rules in order of the contract, and host labels of unwanted sites.
RULES = (
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)
LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary installed beside Python."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.render(table(spark, sf_dir, "conversations"))


def op2_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES, LABELS)


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("tokens.orc")
    token_store.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_store.digest(spark, path)


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item of which the document holds a segment; other documents have none."""
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits as a string: section:paragraph:gone:added of each place."""
    edit = F.transform("edits", lambda e: F.concat_ws(":", e["section"], e["paragraph"], e["gone"], e["added"]))
    return fingerprints.with_edits(table(spark, sf_dir, "documents")).withColumn("edits", F.array_join(edit, " "))


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op8_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose sentences, with the text that stays; other documents have no row."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.without_repeats(documents, only_changed=True).select("doc_id", "n_sentences", "n_removed", "text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict:
    own = [op1_chat_snapshots, op2_url_cascade, op3_token_orc, op4_benchmark_leaks, op5_license_scan, op6_merkle_fingerprints, op7_circulant_minhash, op8_cost_balanced_packing, op9_sentence_spans, op10_toxicity]
    return {f.__name__: f for f in own}


_OP1 = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), numbered AS (
  SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text))
), prefixes AS (
  SELECT conv_id, position, n_turns, md5(string_agg(coalesce('r' || role, '-') || chr(31) || md5(text), chr(30)) OVER (PARTITION BY conv_id ORDER BY position ROWS UNBOUNDED PRECEDING)) AS prefix
  FROM numbered
), ends AS (
  SELECT position, prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes WHERE position = n_turns GROUP BY position, prefix
), kept AS (
  SELECT * FROM ends e WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.position < p.n_turns AND p.position = e.position AND p.prefix = e.prefix)
)
SELECT n.conv_id, CAST(0 AS BIGINT) AS part, CAST(max(n.n_turns) AS BIGINT) AS n_turns, CAST(max(k.n_copies) AS BIGINT) AS n_copies,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY n.position) AS rendered
FROM numbered n JOIN kept k ON n.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY n.conv_id
"""

_OP2 = """
WITH split AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT p.page_id, rule_host || rule_path AS rule, verdict FROM parts p JOIN rules ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path)
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id
)
SELECT p.page_id, host, path, rule,
  coalesce(verdict, CASE WHEN list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best USING (page_id)
"""

_OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)
), pairs AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.b FROM reach r JOIN pairs b ON r.other = b.a
), low AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN low l USING (doc_id)
"""


_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _list(words: Iterable[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _op5() -> str:
    phrases = ", ".join(f"({_list(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"('{name}', {_list(sorted(set(licenses.words_in_order(text))))}, {len(licenses.words_in_order(text))})" for name, text in licenses.TEMPLATES.items())
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
), split AS (
  SELECT r, doc_id, x, regexp_extract_all(x, {_WORDS}) AS words FROM texts
), phrases(phrase, label) AS (
  VALUES {phrases}
), templates(name, own, n) AS (
  VALUES {templates}
), places AS (
  SELECT r, label, unnest(list_filter(range(1, len(words) - len(phrase) + 2), lambda i: words[i : i + len(phrase) - 1] = phrase)) - 1 AS place FROM split, phrases
), base AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS found FROM places GROUP BY r
), may AS (
  SELECT r, x, words, name, own, n, ceil(len(own) * {licenses.THRESHOLD} / 100) AS needed FROM split, templates WHERE len(list_intersect(words, own)) * 100 >= {licenses.THRESHOLD} * len(own)
), lines AS (
  SELECT DISTINCT r, i, len(regexp_extract_all(line, {_WORDS})) AS c FROM (SELECT r, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM (SELECT DISTINCT r, x FROM may))
), starts AS (
  SELECT r, c, sum(c) OVER (PARTITION BY r ORDER BY i) - c AS s FROM lines
), held AS (
  SELECT r, name, max(len(list_intersect(words[s + 1 : s + c + n - 1], own)) / len(own)) AS share, max(len(list_intersect(words[s + 1 : s + c + n - 1], own))) AS most, any_value(needed) AS needed
  FROM may JOIN starts USING (r) WHERE c > 0 GROUP BY r, name
), best AS (
  SELECT r, list(name) AS templates, max(share) AS share FROM held WHERE most >= needed GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(coalesce(found, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(found, []), coalesce(templates, [])))), ',') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM split LEFT JOIN base USING (r) LEFT JOIN best USING (r)
"""


_OP9 = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS x FROM documents
), tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(x, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*')) AS token, generate_subscripts(regexp_extract_all(x, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*'), 1) AS i FROM texts
), words AS (
  SELECT *, regexp_extract(token, '^[^\x20\x09-\x0D]+') AS word, regexp_matches(regexp_extract(token, '^[^\x20\x09-\x0D]+'), '([.!?]["'')\]}}]?|。)$') OR contains(token, chr(10)) AS ends FROM tokens
), placed AS (
  SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM words
), sentences AS (
  SELECT doc_id, s, count(*) AS n, string_agg(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' ORDER BY i) AS said, string_agg(token, '' ORDER BY i) AS body FROM placed GROUP BY doc_id, s
), running AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY s) AS until FROM sentences
), runs AS (
  SELECT a.doc_id, a.s AS a, min(b.s) AS b FROM running a JOIN running b ON a.doc_id = b.doc_id AND b.s BETWEEN a.s + {sentence_spans.SENTENCES - 1} AND a.s + {sentence_spans.LEAST_WORDS} AND b.until - a.until + a.n >= {sentence_spans.LEAST_WORDS} GROUP BY a.doc_id, a.s
  UNION ALL SELECT doc_id, s, s FROM sentences WHERE n >= {sentence_spans.ALONE}
), keys AS (
  SELECT r.doc_id, a, b, md5(string_agg(said, ' ' ORDER BY s)) AS k FROM runs r JOIN sentences t ON r.doc_id = t.doc_id AND t.s BETWEEN a AND b GROUP BY r.doc_id, a, b
), repeats AS (
  SELECT * FROM keys QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, a) > 1
), gone AS (
  SELECT DISTINCT t.doc_id, t.s FROM repeats r JOIN sentences t ON r.doc_id = t.doc_id AND t.s BETWEEN a AND b
)
SELECT t.doc_id, count(*) AS n_sentences, count(g.s) AS n_removed, any_value(regexp_extract(x, '^[\x20\x09-\x0D]*')) || coalesce(string_agg(body, '' ORDER BY t.s) FILTER (g.s IS NULL), '') AS text
FROM sentences t JOIN texts USING (doc_id) LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.s = t.s GROUP BY t.doc_id HAVING count(g.s) > 0
"""


def _op6() -> str:
    def cut(text: str, pattern: str) -> str:
        return f"string_split(regexp_replace({text}, '{pattern}', '\\1' || chr(57344) || '\\2', 'g'), chr(57344))"

    def start(x: str, y: str) -> str:
        """How many entries at the beginning are equal."""
        return f"coalesce(nullif(list_position(list_transform(range(1, greatest(len({x}), len({y})) + 1), lambda i: ({x})[i] IS NOT DISTINCT FROM ({y})[i]), false), 0) - 1, len({x}))"

    short = f"[1:{fingerprints.DIGITS}]"
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS x FROM documents
), followed AS (
  SELECT doc_id, x, coalesce(lead(x) OVER w, first_value(x) OVER w) AS y, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM texts WINDOW w AS (ORDER BY doc_id NULLS FIRST)
), edited AS (
  SELECT *, substr(x, 1, length(x) - length(x) // 2) || substr(y, 1, length(x) // 2) AS z FROM followed
), every AS (
  SELECT doc_id, 'x' AS which, x AS s FROM edited UNION ALL SELECT doc_id, 'z', z FROM edited
), leaves AS (
  SELECT doc_id, which, list_transform({cut("s", "(\n\n)([^\n])")}, lambda s: list_transform({cut("s", "(\n)([^\n])")}, lambda p: list_transform({cut("p", "([.!?])([^.!?\n])")}, lambda q: sha256(q)))) AS tree FROM every
), nodes AS (
  SELECT *, list_transform(tree, lambda s: list_transform(s, lambda p: sha256(array_to_string(p, '')))) AS inside FROM leaves
), heads AS (
  SELECT *, list_transform(inside, lambda s: sha256(array_to_string(s, ''))) AS top FROM nodes
), prints AS (
  SELECT doc_id, which, sha256(array_to_string(top, '')) AS root, list_distinct(list_transform(flatten(flatten(tree)), lambda q: q{short})) AS own, list_transform(top, lambda h: h{short}) AS h,
    list_transform(inside, lambda s: list_transform(s, lambda p: p{short})) AS ps,
    sha256(array_to_string(top, '')) || '|' || array_to_string(list_transform(tree, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(list_transform(p, lambda q: q{short}), ',')), '/')), '|') || '#'
      || array_to_string(list_transform(range(1, len(top) + 1), lambda i: top[i]{short} || '/' || array_to_string(list_transform(inside[i], lambda p: p{short}), '/')), '|') AS print
  FROM heads
), compared AS (
  SELECT a.doc_id, a.h AS ha, b.h AS hb, a.ps AS pa, b.ps AS pb, {start("a.h", "b.h")} AS front FROM prints a JOIN prints b ON a.doc_id = b.doc_id AND a.which = 'x' AND b.which = 'z' AND a.root <> b.root
), narrowed AS (
  SELECT *, {start("list_reverse(ha[front + 1 :])", "list_reverse(hb[front + 1 :])")} AS back FROM compared
), middle AS (
  SELECT doc_id, front, ha[front + 1 : len(ha) - back] AS ha, hb[front + 1 : len(hb) - back] AS hb, pa[front + 1 : len(pa) - back] AS pa, pb[front + 1 : len(pb) - back] AS pb FROM narrowed
), stretches AS (
  SELECT doc_id, front + i - 1 AS section, pa[i] AS a, pb[i] AS b FROM (SELECT *, unnest(range(1, len(ha) + 1)) AS i FROM middle WHERE len(ha) = len(hb) AND len(ha) > 0) WHERE ha[i] <> hb[i]
  UNION ALL SELECT doc_id, front, flatten(pa), flatten(pb) FROM middle WHERE len(ha) <> len(hb) OR len(ha) = 0
), begun AS (
  SELECT *, {start("a", "b")} AS p FROM stretches
), ended AS (
  SELECT *, {start("list_reverse(a[p + 1 :])", "list_reverse(b[p + 1 :])")} AS q FROM begun
), edits AS (
  SELECT doc_id, string_agg(section || ':' || p || ':' || (len(a) - p - q) || ':' || (len(b) - p - q), ' ' ORDER BY section) AS edits FROM ended GROUP BY doc_id
)
SELECT e.doc_id, CAST(length(x) AS BIGINT) AS n_chars, sha256(z) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint,
  len(list_intersect(a.own, b.own)) / greatest(len(a.own), len(b.own)) AS near_edited, len(list_intersect(a.own, c.own)) / greatest(len(a.own), len(c.own)) AS near_next, coalesce(edits, '') AS edits
FROM edited e JOIN prints a ON a.doc_id = e.doc_id AND a.which = 'x' JOIN prints b ON b.doc_id = e.doc_id AND b.which = 'z' JOIN prints c ON c.doc_id = e.next_id AND c.which = 'x' LEFT JOIN edits d ON d.doc_id = e.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_snapshots": _OP1, "op2_url_cascade": _OP2, "op5_license_scan": _op5(), "op6_merkle_fingerprints": _op6(), "op7_circulant_minhash": _OP7, "op9_sentence_spans": _OP9}
