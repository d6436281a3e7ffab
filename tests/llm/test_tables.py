"""Conversations, urls, components, and the pipeline."""

import re
from hashlib import md5

import duckdb
import numpy as np
import pytest

from factorlake.llm import components, conversations, queries, shared, url_filter

SF = "/root/testdata/sf0.001"


def brute_conversations(rows):
    turns = {}
    for c, t, r, x in rows:
        turns.setdefault(c, set()).add((t is not None, t or 0, r is not None, r or "", md5((x or "").encode()).hexdigest(), x or ""))
    whole = {c: tuple((z[2], z[3], z[5]) for z in sorted(v)) for c, v in turns.items()}
    out = {}
    for c, v in whole.items():
        if any(len(w) > len(v) and w[: len(v)] == v for w in whole.values()):
            continue
        equal = [d for d, w in whole.items() if w == v]
        named = [d for d in equal if d is not None]
        if c == (min(named) if named else None):
            out[c] = (len(v), len(equal), "".join(f"<|im_start|>{r if has else 'unknown'}\n{x}<|im_end|>\n" for has, r, x in v))
    return out


@pytest.mark.parametrize("block", [2, conversations.BLOCK])
def test_snapshots_collapse(spark, block):
    rng, rows = np.random.default_rng(1), []
    for c in range(60):
        root = int(rng.integers(0, 6))
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {root if t < 4 else c % 9}"))
    rows += [(100, 0, None, None), (100, 0, None, None), (101, None, "user", ""), (101, 5, "user", "z"), (None, 0, "user", "lost"), (102, 0, "user", "x" * 100000), (103, 0, "user", "a"), (103, 0, "user", "b"), (104, -3, "user", "a"), (105, 7, "user", "a"), (105, 9, "user", "b")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, PART string, position int")
    got = {}
    for r in conversations.render(df, block=block).orderBy("part").collect():
        old = got.get(r["conv_id"], (0, 0, ""))
        got[r["conv_id"]] = (r["n_turns"], r["n_copies"], old[2] + r["rendered"])
    assert got == brute_conversations(rows)
    assert conversations.render(df.limit(0), block=block).count() == 0


def test_rows_of_one_turn_are_no_single_block(spark):
    """Rows without a conv_id, on few turn numbers or none, come out in blocks, and together as one rendering."""
    rows = [(None, (None, 1, 2)[i % 3], ("user", None)[i % 2], f"said {i % 900}") for i in range(4000)] + [(1, t, "user", f"x{t}") for t in range(40)] + [(2, t, "user", f"x{t}") for t in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversations.render(df, block=32).orderBy("conv_id", "part").collect()
    got = {}
    for r in found:
        old = got.get(r["conv_id"], (0, 0, ""))
        got[r["conv_id"]] = (r["n_turns"], r["n_copies"], old[2] + r["rendered"])
    assert got == brute_conversations(rows) and set(got) == {None, 1}
    assert max(r["rendered"].count("<|im_start|>") for r in found) <= 4 * 32 * conversations.HEAVY and len(found) > 40


def test_cascade_is_exact(spark):
    rng = np.random.default_rng(4)
    corpus = rng.integers(-(1 << 62), 1 << 62, 20000)
    listed = np.concatenate([corpus[:700], rng.integers(-(1 << 62), 1 << 62, 50)])
    df = spark.createDataFrame([([int(x) for x in corpus[i : i + 10]],) for i in range(0, len(corpus), 10)], "keys array<long>")
    held = url_filter.cascade(np.unique(listed.view(np.uint64)), df, len(corpus))
    assert len(held.levels) > 2
    assert held.has(corpus.view(np.uint64)).tolist() == np.isin(corpus, listed).tolist()


def test_urls(spark, monkeypatch):
    urls = [None, "", "no scheme/x", "http://", "HTTP://A.Example.NET/en/1?q#f", "http://example.net", "http://example.net/", "http://xexample.net/en/", "https://b.example.com/de/x://y", "http://example.com/fr/", "http://z.org/fr/1", "http://z.org/de/", "http://m.casino-win.example.com/de/1", "http://m.casino-win.example.com/en/1", "http://casino-win", "://host.net/a\nb", "http://e.net:80/", "http://" + "a." * 500 + "net/", "http://z.org/fr"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(3, "http://", "h", "p")], "page_id long, url string, HOST string, rule string")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [r for r in queries.RULES if f".{host}".endswith(f".{r.host}") and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        return host, path, best and best.name, best.verdict if best else "block" if set(host.split(".")) & set(queries.LABELS) else "allow"

    want = sorted(((i, *judge(u)) for i, u in [*enumerate(urls), (3, "http://")]), key=str)
    assert sorted((tuple(r) for r in url_filter.judge(df, queries.RULES, queries.LABELS).collect()), key=str) == want
    assert url_filter.judge(df.limit(0), queries.RULES, queries.LABELS).count() == 0
    monkeypatch.setattr(url_filter, "MOST_BYTES", 4)  # several cascades, one after the other
    assert url_filter.parts_of(10, 200) > 2
    got = sorted((tuple(r) for r in url_filter.judge(df, queries.RULES, queries.LABELS).collect()), key=str)
    assert got == want


def test_a_very_long_host_costs_what_it_takes_to_read(spark):
    host = "a." * 200_000
    df = spark.createDataFrame([(1, f"http://{host}net/x"), (2, f"http://{host}casino-win.{host}com/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"], len(r["host"])) for r in url_filter.judge(df, queries.RULES, queries.LABELS).collect()}
    assert got == {1: ("net/", "block", 400_003), 2: (None, "block", 800_014)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), shared.Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def plain_run(spark, docs, benchmark, toxic):
    """The rows that reach packing, by plain Python: (doc_id, words left). toxic: texts that the classifier rejects."""
    from factorlake.llm import decontamination, sentence_spans

    from .test_text_operators import brute_links, brute_spans, distance, keyed, low

    rows = [r for r in docs if r[1] not in toxic]
    sets, root = brute_links(rows, 5)
    first = {}
    for k in keyed(spark, rows):
        first.setdefault(root[k], k)
    rows = [rows[k] for k in range(len(rows)) if not sets[k] or first[root[k]] == k]
    cut = brute_spans(rows, sentence_spans.SENTENCES, sentence_spans.LEAST_WORDS, keyed(spark, rows))
    rows = [(i, left if gone else None, t) for (i, t), (_, n, gone, left) in zip(rows, cut, strict=True) if gone == 0 or gone < n]
    index = decontamination.Index(list(enumerate(benchmark)), decontamination.SEGMENT, decontamination.PERCENT, decontamination.LEAST)
    plain = lambda t: (" " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))) + " ").encode()
    out = []
    for i, left, t in rows:
        now = plain(t if left is None else left)
        if not any(distance(plain(item)[a:b], now) <= edits for k, item in enumerate(benchmark) for a, b, edits, _ in index.segments[k]):
            out.append((i, now))
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    """The whole run on a small corpus with copies, null and repeated ids, shared passages, excerpts of items and toxic texts."""
    import corpus_pipeline as p

    from factorlake.llm import toxicity

    from .test_text_operators import PASSAGE, SPAN_ROWS, plain_tokenizer

    rng = np.random.default_rng(12)
    some = lambda n, more=(): " ".join(rng.choice([*[f"word{i}" for i in range(300)], *more], n))
    item = "an item of the benchmark asks for the number of apples that are left when some are eaten by the children who found them"
    rows = [r for r in SPAN_ROWS if len(r[1] or "") < 2000] + [(i, some(60) + ".") for i in range(100, 160)] + [(i, some(40, ["vile", "rotten", "nasty"] * 60)) for i in range(200, 240)]
    rows += [(300, rows[-50][1]), (300, rows[-50][1]), (301, f"{some(20)} {item} {some(20)}"), (None, f"{some(20)} {item} {some(20)}"), (None, "clean and without an id, nothing more"), (302, f"{some(30)}. {PASSAGE}")]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    at = str(tmp_path)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "abcdef")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    labels = spark.createDataFrame([(i, 0, int(i >= 200)) for i in [*range(100, 160), *range(200, 240)]], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{at}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    toxic = {r["text"] for r in scored if r["score"] >= p.TOXIC_FROM}
    assert len(toxic) >= 30
    want = plain_run(spark, rows, [item, "abcdef"], toxic)
    out = p.run(spark, at).collect()
    t, by = plain_tokenizer(), {}
    for r in out:
        by.setdefault((r["doc_id"], r["sequence_id"], r["offset"]), (r["start"], r["ids"], r["doc_tokens"]))
    ids = sorted(str(i) for i, _ in want)
    assert sorted(str(r["doc_id"]) for r in out if r["start"] == 0) == ids
    texts = {}
    for r in sorted(out, key=lambda r: r["start"]):
        texts.setdefault((r["doc_id"], r["doc_tokens"]), []).extend(r["ids"])
    named = [i for i, _ in want if i is not None]
    single = {i for i in named if named.count(i) == 1}
    assert len(single) > 60
    for (i, n), own in texts.items():
        if i in single:
            assert len(own) == n and own[-1] == 0
            left = t.decode(own[:-1], skip_special_tokens=False)
            plain = (" " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), left))) + " ").encode()
            assert plain == dict(want)[i], i


def test_stages_keep_columns_and_take_empty_tables(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clashing = docs.selectExpr("*", "1 AS SCORE", "1 AS T1", "1 AS t2", "1 AS mark_doc", "1 AS number", "2 AS covered", "3 AS n_removed", "4 AS leaked_doc", "5 AS copy_id", "6 AS n_sentences")
    for name, apply in p.STAGES[:-1]:
        assert apply(spark, clashing, SF).columns == clashing.columns, name
        assert apply(spark, clashing.limit(0), SF).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == sorted(map(str, want.fetchall()))
