"""Operators on documents against plain Python versions, and odd tables."""

import hashlib
import re
import textwrap
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from factorlake.llm import decontamination, fingerprints, licenses, near_duplicates, packing, sentence_spans, shared, token_store, toxicity
from factorlake.llm import textkernel as K
from factorlake.llm import tokens
from factorlake.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"word{i % 977} and. Then{i}" for i in range(20000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Same text here. It has two sentences! And a third one, which is rather long, so that twenty words are there in all."),
    (6, "Same text here. It has two sentences! And a third one, which is rather long, so that twenty words are there in all."), (6, "Same text here. It has two sentences! And a third one, which is rather long, so that twenty words are there in all."),
    (7, "日本語。 ünïcode İ K €\u2028x\x00y"), (8, LONG), (9, LONG + " more"), (None, "no id"), (None, None), (10, "a b"), (11, "A  b"),
]


def odd(spark):
    rows = [(a, b, "en", "s", "x", 1.5, 7) for a, b in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, TEXT_TO_SCORE string, score double, n_sentences int")


def empty(spark):
    return odd(spark).limit(0)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain_tokenizer():
    """The library's own, as the contract names it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def keyed(spark, rows):
    """The rows' places in the order of doc_id (null last) and the texts' hashes."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "place long, doc_id long, text string")
    found = {r[0]: (r[1], r[2]) for r in df.select("place", *shared.text_keys()).collect()}
    return sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, found[k]))


def test_word_cache_gives_the_librarys_ids():
    t = plain_tokenizer()
    assert t.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    texts = ["I'm here, it's they'll 're we've  x'sabc ''s  \n\n a\t b  ", "", "  ", " '", "\n's", "€ uro", "日本 语", "12ab34", "nb\xa0sp", "<|endoftext|> x", "hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <|endof", "text|> no", "1'2 '1's", "a'", "'", "'ll", "x 'll", LONG[:5000]]
    cache = tokens.WordCache(tokenizer_path(), slots=64, pool=300)  # collisions and fresh starts
    data, offsets = K.column_bytes(__import__("pyarrow").array(texts))
    for _ in range(2):
        ids, at = cache.encode(data, offsets)
        for i, x in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


def test_crc32_join():
    a, b = b"hello", b"world" * 99
    assert tokens.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("piece", [7, token_store.PIECE])
def test_orc_round_trip(spark, tmp_path, piece):
    docs = odd(spark)
    token_store.write(docs, f"{tmp_path}/o", tokenizer_path(), piece=piece)
    got = token_store.digest(spark, f"{tmp_path}/o").orderBy("start").collect()
    t, start, want = plain_tokenizer(), 0, []
    order = keyed(spark, ODD)
    for i, text in (ODD[k] for k in sorted(order, key=lambda k: (ODD[k][0] is not None, order.index(k)))):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    token_store.write(empty(spark), f"{tmp_path}/e", tokenizer_path())


def test_orc_files_have_indexes_and_bloom_filters(spark, tmp_path):
    """The footer names integer run-length encoding; a filter on doc_id reads fewer rows; hot and null ids are spread over files."""
    rows = spark.range(40_000).selectExpr("if(id % 4 = 0, null, if(id % 4 = 1, 7, id)) as doc_id", "concat('some words ', id, ' and ', id % 13) as text").repartition(16)
    path, coalescing = f"{tmp_path}/o", "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalescing, "false")
    token_store.write(rows, path, tokenizer_path(), row_index=1000)
    spark.conf.unset(coalescing)
    files = sorted(p for p in (tmp_path / "o").iterdir() if p.suffix == ".orc")
    sizes = []
    for f in files:
        import pyarrow.orc as orc

        held = orc.ORCFile(f)
        sizes.append(held.nrows)
        assert held.compression == "ZSTD" and held.row_index_stride == 1000 and held.nstripes >= 1
    assert sum(sizes) == 40_000 and len([n for n in sizes if n]) >= 6 and max(sizes) < 12_000
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    largest = files[sizes.index(max(sizes))]
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(largest)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    stripe = reader.getStripes().get(0)
    footer = reader.rows().readStripeFooter(stripe)
    kinds = {str(footer.getStreams(i).getKind()) for i in range(footer.getStreamsCount())}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    encodings = [str(footer.getColumns(i).getKind()) for i in range(footer.getColumnsCount())]
    assert encodings.count("DIRECT_V2") >= 4  # row, doc_id, piece and ids: run-length encoding of the second version
    one = token_store.read(spark, path).filter("doc_id = 20003")
    assert one.count() == 1 and "EqualTo(doc_id,20003)" in one._jdf.queryExecution().toString()


def test_packing_spreads_equal_rows(spark):
    same = spark.range(3000).selectExpr("5L as doc_id", "'the very same words' as text").repartition(5)
    out = packing.pack(same, tokenizer_path(), length=64, group_documents=100, with_ids=False)
    by_group = out.groupBy((out.sequence_id / (1 << 32)).cast("long").alias("g")).count().collect()
    assert len(by_group) > 20 and max(r["count"] for r in by_group) < 220
    again = out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    crc = {}
    for r in again:
        crc[r["start"], r["length"]] = r["ids_crc32"]
    ids = np.array([*plain_tokenizer().encode("the very same words", add_special_tokens=False).ids, 0], "<u4")
    assert all(c == zlib.crc32(ids[a : a + n]) for (a, n), c in crc.items()) and sum(r["length"] for r in again) == 3000 * len(ids)


def test_packing_takes_the_lowest_cost(spark):
    """Every whole rest goes to the sequence that costs least among those with room, by a plain loop."""
    sizes = sorted(np.random.default_rng(3).integers(1, 1024, 300).tolist(), reverse=True)
    n = -(-sum(sizes) // 1024)
    room, load, late, want = [1024] * n, [0.0] * n, [], []
    for i, x in enumerate(sizes):
        fits = [j for j in range(n) if room[j] >= x]
        if not fits:
            late.append(i)
            continue
        j = min(fits, key=lambda j: (load[j], j))
        want.append((i, 0, x, j))
        room[j] -= x
        load[j] += x + x * x / 1024
    got = packing.assign(np.array(sizes), 1024, 1.0, 1 / 1024)
    assert got[: len(want)] == want and {i for i, *_ in got[len(want) :]} == set(late)


def test_packing_round_trip(spark):
    out = packing.pack(odd(spark), tokenizer_path(), length=64, group_documents=4).collect()
    t = plain_tokenizer()
    want = sorted((str(i), tuple([*t.encode(x or "", add_special_tokens=False).ids, 0])) for i, x in ODD)
    sequences = {}
    for r in out:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4")) and len(r["ids"]) == r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r["length"] for r in out) == sum(len(x) for _, x in want)
    padding = sum(64 - sum(n for _, n in p) for p in sequences.values())
    assert padding < 64 * 5
    by = {}
    for r in out:
        by.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], tuple(r["ids"])))
    for (i, n), pieces in by.items():
        texts = [x for j, x in want if j == i and len(x) == n]
        for x in texts:
            for start, ids in pieces:
                assert x[start : start + len(ids)] == ids
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0


def test_assign_fills_and_balances():
    sizes = np.array(sorted(np.random.default_rng(1).integers(1, 1024, 500), reverse=True))
    out = packing.assign(sizes, 1024, 1.0, 1 / 1024)
    used = {}
    for _, _, n, j in out:
        used[j] = used.get(j, 0) + n
    assert max(used.values()) <= 1024 and len(used) == -(-sizes.sum() // 1024) and sum(used.values()) == sizes.sum()


def brute_links(rows, width, percent=80):
    """(sets, the root of each row)."""
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                parent[top(a)] = top(b)
    return sets, [top(k) for k in range(len(rows))]


def brute_components(rows, width, percent=80):
    sets, root = brute_links(rows, width, percent)
    lowest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            lowest[root[k]] = min(lowest.get(root[k], i), i)
    return sorted((str(i), len(sets[k]), str(lowest.get(root[k]) if sets[k] else i)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("filter_bits", [near_duplicates.FILTER_BITS, 0])
def test_near_duplicates(spark, monkeypatch, filter_bits):
    monkeypatch.setattr(near_duplicates, "FILTER_BITS", filter_bits)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 500, 60)]
    rows = list(ODD)
    for i in range(100, 160):  # near copies around the threshold
        w = list(base)
        for j in rng.integers(0, 60, int(rng.integers(0, 9))):
            w[j] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(w)))
    for width in (2, 5):
        out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out) == brute_components(rows, width)
        assert all(r["kept"] == (r["component_id"] is None or r["doc_id"] == r["component_id"]) for r in out)
    assert near_duplicates.near_duplicates(empty(spark), 2).count() == 0


def test_without_copies_keeps_one_row_of_each_component(spark):
    rows = [*ODD, (5, "P q r s t u v w"), (5, "P q r s t u v w"), (5, "P q r s t u v w"), (3, "p Q r s t u v w"), (None, "p q r s t u v w"), (None, "alone x y z w v"), (None, "alone x y z w v"), (6, "something else, all its own, and no copy")]
    clashing = spark.createDataFrame([(*r, k, 1) for k, r in enumerate(rows)], "doc_id long, text string, t1 int, COMPONENT_ID int")
    out = near_duplicates.without_copies(clashing, 5)
    assert out.columns == clashing.columns
    sets, root = brute_links(rows, 5)
    first = {}
    for k in keyed(spark, rows):
        first.setdefault(root[k], k)
    want = sorted(str(rows[k]) for k in range(len(rows)) if not sets[k] or first[root[k]] == k)
    assert sorted(str((r["doc_id"], r["text"])) for r in out.collect()) == want
    assert near_duplicates.without_copies(clashing.limit(0), 5).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_large_open_buckets_lose_no_link(spark, monkeypatch, percent):
    """Sets around the threshold, all in one bucket: the prefix join against all pairs."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(words[: int(rng.integers(60, 80))])
        for j in rng.integers(0, len(w), int(rng.integers(0, 16))):
            w[j] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_duplicates, "STAR_ROUNDS", 0)
    monkeypatch.setattr(near_duplicates, "SMALL_BUCKET", 1)
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent, bands=1200, rows=1).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out) == brute_components(rows, 1, percent)


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    x = K.mix(rng.integers(0, 1 << 60, 600).astype(np.uint64))
    a, b = near_duplicates.signature(x[:500], 300), near_duplicates.signature(x[100:], 300)
    assert abs((a == b).mean() - 400 / 600) < 0.1


def brute_spans(rows, sentences, least, order):
    """order: the rows' places, first occurrences first."""

    def cut(t):
        out = [[]]
        for m in re.finditer(rb"[^\x20\x09-\x0d]+", t):
            word, gap = m[0], t[m.end() :]
            out[-1].append(low(word.decode()))
            if re.search(rb"[.!?][\"')\]}]?$|\xe3\x80\x82$", word) or b"\n" in re.match(rb"[\x20\x09-\x0d]*", gap)[0]:
                out.append([])
        return [s for s in out if s]

    docs = [cut((t or "").encode()) for _, t in rows]
    seen, gone = set(), [set() for _ in rows]
    for k in order:
        own, new = docs[k], set()
        for s in range(len(own)):
            ends = [s + 1] if len(own[s]) >= sentence_spans.ALONE else []
            e = s
            while e < len(own) and (e - s < sentences or sum(map(len, own[s:e])) < least):
                e += 1
            if e - s >= sentences and sum(map(len, own[s:e])) >= least:
                ends.append(e)
            for e in ends:
                key = tuple(w for x in own[s:e] for w in x)
                if key in seen:
                    gone[k] |= set(range(s, e))
                seen.add(key)
    return [(rows[k][0], len(docs[k]), len(gone[k]), " ".join(w for j, x in enumerate(docs[k]) if j not in gone[k] for w in x)) for k in range(len(rows))]


PASSAGE = "Here is a passage of some length. It has sentences that repeat, word for word, elsewhere in the corpus. A few words more make it longer than the least length of a run, even where its beginning is lost. Its end comes soon after this."
SPAN_ROWS = [
    *ODD, (20, f"Before it. {PASSAGE} After it."), (21, f"no end before {PASSAGE} and on"), (22, f"{PASSAGE}\n{PASSAGE}"), (23, "Quite clean. Nothing in here repeats anything that stands anywhere else, one may hope, and so it is left as it stands. End."),
    (20, "A clean text under an id that another has, too. Its sentences stand here only, and none of them may be lost to marks of the other one. So it stays."), (20, f"Short. {PASSAGE}"), (None, f"Without an id. {PASSAGE}"), (None, f"Without an id. {PASSAGE}"),
    (None, "Clean and without an id, so no mark of the others may touch it, which share the missing id and lose much. It stays whole."), (1, f"First of all. {PASSAGE}"), (1, f"First of all. {PASSAGE}"), (24, "Own words twice in one row stand here, a run of them that is long enough for the least number of words. And on. " * 3),
]


def words_of(t):
    return " ".join(w.decode() for w in low(t).encode().split())


def test_sentence_spans(spark):
    want = sorted(map(str, brute_spans(SPAN_ROWS, sentence_spans.SENTENCES, sentence_spans.LEAST_WORDS, keyed(spark, SPAN_ROWS))))
    for parts in (1, 6):
        df = spark.createDataFrame([(*r, 1, "x") for r in SPAN_ROWS], "doc_id long, text string, T1 int, covered string").repartition(parts)
        out = sentence_spans.without_repeats(df)
        assert out.columns == [*df.columns, "n_sentences", "n_removed"]
        assert sorted(str((r["doc_id"], r["n_sentences"], r["n_removed"], words_of(r["text"]))) for r in out.collect()) == want
        changed = sentence_spans.without_repeats(df, only_changed=True).collect()
        assert sorted(str((r["doc_id"], r["n_sentences"], r["n_removed"], words_of(r["text"]))) for r in changed) == [w for w in want if ", 0, '" not in w]
    out = sentence_spans.without_repeats(odd(spark))
    assert out.count() == len(ODD) and out.columns[:7] == odd(spark).columns
    assert sentence_spans.without_repeats(empty(spark)).count() == 0


def test_sentence_spans_takes_long_sentences_alone(spark):
    long, short = (" ".join(f"w{k}x{i}" for i in range(n)) + "." for k, n in enumerate((50, 49)))
    rows = [(1, long), (2, long), (3, short), (4, short), (5, f"Here before. {long} There after it."), (6, f"{long} And this. {long}")]
    got = {r["doc_id"]: (r["n_removed"], r["text"].strip()) for r in sentence_spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, long), 2: (1, ""), 3: (0, short), 4: (0, short), 5: (1, "Here before. There after it."), 6: (2, "And this.")}


def distance(pattern, text):
    """The fewest edits from pattern to a part of text."""
    t, row = np.frombuffer(text, np.uint8), np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for c in pattern:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (t != c))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_decontamination_against_full_alignment(spark):
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghij "))
    text = lambda n: "".join(rng.choice(letters, n))
    items = [(i, text(int(n))) for i, n in enumerate((70, 130, 200, 300))] + [(9, "short one"), (10, "abc"), (11, None), (12, "")]
    rows = [(1, None), (2, ""), (3, text(50)), (4, f"x {items[4][1]} y"), (5, LONG[:3000])]
    for k in range(60):
        _, t = items[k % 4]
        w = list(t)
        for _ in range(int(rng.integers(0, 14))):
            at = int(rng.integers(0, len(w)))
            w[at : at + int(rng.integers(0, 2))] = list(text(int(rng.integers(0, 2))))
        a = int(rng.integers(0, len(w) // 3))
        rows.append((100 + k, f"{text(200)} {''.join(w[a:])} {text(100)}"))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = decontamination.Index([(i, t or "") for i, t in items], decontamination.SEGMENT, decontamination.PERCENT, decontamination.LEAST)
    plain = lambda t: (" " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))) + " ").encode()
    want = set()
    for i, t in rows:
        for k, (item, own) in enumerate(items):
            for a, b, edits, _ in index.segments[k]:
                if distance(plain(own)[a:b], plain(t)) <= edits:
                    want.add((i, item))
    assert len(want) > 20
    for size in (1 << 20, 200):  # one block, several
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.find(docs, bench, block_bytes=size).collect()}
        assert got == want
        assert {r["doc_id"] for r in decontamination.clean(docs, bench, block_bytes=size).collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert decontamination.find(empty(spark), bench).count() == 0 and decontamination.find(docs, bench.limit(0)).count() == 0
    assert decontamination.find(odd(spark), bench).count() >= 0


def test_decontamination_finds_excerpts_wherever_they_lie(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(60)]
    rows = [(a, f"some other words {' '.join(words[a : a + 13])} and what follows") for a in range(48)]  # 77 bytes each
    rows += [(100 + a, f"other {' '.join([*words[a : a + 6], 'q' + words[a + 6][1:], *words[a + 7 : a + 13]])} words") for a in range(48)]  # one edit
    rows += [(200, f"other {' '.join(words[:4])} words {' '.join(words[9:13])}")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontamination.find(docs, bench).collect()) == [*range(48), *range(100, 148)]
    text = " ".join(words).encode()
    index = decontamination.Index([(1, text.decode())], decontamination.SEGMENT, decontamination.PERCENT, decontamination.LEAST)
    least = decontamination.EXCERPT - decontamination.PERCENT * decontamination.EXCERPT // 100
    cut = [b"zzz" + text[a : a + least] + b"zzz" for a in range(len(text) - least + 1)]
    found = index.matches(np.frombuffer(b"".join(cut), np.uint8), np.arange(len(cut) + 1) * (least + 6))
    # The blanks at an excerpt's ends may go with the words beside them.
    assert {d for d, *_ in found} >= {d for d, x in enumerate(cut) if x[3:4] != b" " and x[-4:-3] != b" "}


def test_decontamination_judges_rows_by_themselves(spark):
    item = "these are the words of an item that no document may hold, and they are rather many words"
    rows = [(None, f"x {item} y"), (None, "clean and without an id"), (7, f"a {item}"), (7, "clean under an id that another has"), (None, None), (8, "abc de"), (9, "ab cde"), (8, "abc de"), (10, "")]
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (None, "Abc"), (4, " a"), (5, "")], "item_id long, text string")
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, T1 int, leaked_doc int")
    want = sorted(map(str, [*[(d, i) for d in (None, 7) for i in (1, 1, 2)], (8, None), (8, None), (7, 4)]))
    for size in (1 << 20, 40):
        assert sorted(str((r["doc_id"], r["item_id"])) for r in decontamination.find(docs, bench, block_bytes=size).collect()) == want
        kept = decontamination.clean(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns
        assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, [rows[1], rows[3], rows[4], rows[6], rows[8]]))
    assert decontamination.clean(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_lays_out_few_pairs_at_a_time(monkeypatch):
    """One repeated letter against another: counts by band as without chunks, whatever the chunk."""
    index = decontamination.Index([(1, "a" * 300), (2, "ab" * 100)], decontamination.SEGMENT, decontamination.PERCENT, decontamination.LEAST)
    data, at = K.column_bytes(pa.array(["a" * 4000, "x " + "ab" * 300, "a" * 30, "b" * 500]))
    want = sorted(index.matches(data, at))
    assert {(d, k) for d, k, *_ in want} >= {(0, 0), (1, 1)}
    laid, repeat = [], np.repeat
    monkeypatch.setattr(decontamination, "CHUNK", 1000)
    monkeypatch.setattr(np, "repeat", lambda a, n, *rest, **more: laid.append(out := repeat(a, n, *rest, **more)) or out)
    assert sorted(index.matches(data, at)) == want
    assert max(map(len, laid)) <= 4000 + 600 + 600 + 20  # the texts' bytes; pairs stay below 1000 + one gram's places


def test_license_scan(spark):
    rows = [*ODD, (30, "MIT license, mit LICENSE!\ncc-by CC BY"), (31, "apache  license gnu general\npublic license"), (32, "mit licenses"), (33, "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software and associated\ndocumentation files, to deal in the Software without restriction.\nelse"), (34, "x\nReleased under the license of MIT ok")]
    rows += [(100000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found, expected = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect(), []
    sets = {k: set(v) for k, v in licenses.template_words(licenses.TEMPLATES).items()}
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        best, extra, at = 0.0, set(), 0
        for line in low(t).split("\n"):
            n = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
            for name, own in sets.items():
                held = set(words[at : at + n + len(licenses.words_in_order(licenses.TEMPLATES[name])) - 1]) if n else set()
                if len(held & own) * 100 >= licenses.THRESHOLD * len(own):
                    extra.add(name)
                    best = max(best, len(held & own) / len(own))
            at += n
        want = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | extra)), 1.0 if labels else best)
        expected.append(str((i, *want)))
    assert sorted(map(str, map(tuple, found))) == sorted(expected)
    assert licenses.scan(empty(spark)).count() == 0 and licenses.scan(odd(spark)).count() == len(ODD)


def test_license_scan_finds_notices_on_narrow_lines(spark):
    rows, want = [], {}
    for width in (1, 12, 20, 40, 50, 60, 80, 100):
        for name, notice in licenses.TEMPLATES.items():
            for sign in ("", "# ", " * ", "// "):  # comment signs before each line
                i = len(rows)
                gap = "\n\n" if i % 2 else "\n"
                rows.append((i, "before it\nsomething else\n" + gap.join(sign + x for x in textwrap.wrap(notice, width, break_long_words=False)) + "\nand after it\nmore\nof this"))
                want[i] = name
    first, *rest = textwrap.wrap(licenses.TEMPLATES["mit-grant"], 80)
    for gap in ("\n", "\n\n", "\n \n--\n"):  # from the middle of a long line on, with lines without words
        want[len(rows)] = "mit-grant"
        rows.append((len(rows), f"{'more words stand here ' * 9}{first}{gap}{gap.join(' '.join(rest).split())}{gap}end"))
    spread = licenses.TEMPLATES["mit-grant"].split()  # its words with five others after each are no notice
    rows.append((100_000, "\n".join(f"{w}\nand so on it goes" for w in spread)))
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, name in want.items() if name not in got[i]] == [] and "mit-grant" not in got[100_000]


def test_fingerprints(spark):
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(5000, None), (5001, ""), (5002, LONG)], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprints.with_edits(docs).collect()}
    assert len(got) == len(rows)

    def tree(t):
        h = lambda x: hashlib.sha256(x.encode()).hexdigest()
        parts = [[re.split(r"(?<=[.!?])(?=[^.!?\n])", p) for p in re.split(r"(?<=\n)(?=[^\n])", s)] for s in re.split(r"(?<=\n\n)(?=[^\n])", t)]
        nodes = [[h("".join(map(h, p))) for p in s] for s in parts]
        heads = [h("".join(p)) for p in nodes]
        short = fingerprints.DIGITS
        leaf = "|".join("/".join(",".join(h(x)[:short] for x in p) for p in s) for s in parts)
        return h("".join(heads)) + "|" + leaf + "#" + "|".join("/".join(x[:short] for x in (a, *b)) for a, b in zip(heads, nodes, strict=True))

    for k, (i, t) in enumerate(rows):
        follower = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + follower[: len(t) // 2]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        a, b, c = (set(tree(x)[65:].split("#")[0].replace("|", ",").replace("/", ",").split(",")) for x in (t, edited, follower))
        assert r["fingerprint"] == tree(t) and r["edited_fingerprint"] == tree(edited)
        assert r["near_edited"] == len(a & b) / max(len(a), len(b)) and r["near_next"] == len(a & c) / max(len(a), len(c))
    for each in (1, 100, 5000):
        nexts = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(docs, rows_each=each).collect()}
        assert nexts == {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}
    assert fingerprints.with_edits(odd(spark)).count() == len(ODD) and fingerprints.with_edits(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "A b. C d.\nE f.\n\nG.")], "doc_id long, text string")
    assert fingerprints.with_edits(one).first()["near_next"] == 1.0


def test_fingerprints_of_null_and_repeated_ids(spark):
    rows = [*ODD, *[(6, f"text {i}") for i in range(40)], *[(None, f"text {i % 30}") for i in range(40)], (12, None)]
    order = keyed(spark, rows)
    order = sorted(order, key=lambda k: (rows[k][0] is not None, order.index(k)))
    want = sorted(str((rows[k][0], rows[k][1] or "", rows[order[(at + 1) % len(order)]][1] or "")) for at, k in enumerate(order))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for each in (1, 8, 4096):
        assert sorted(str((r["doc_id"], r["text"], r["next_text"])) for r in fingerprints.with_next(df, rows_each=each).collect()) == want


def test_edits_locate_branches(spark):
    from pyspark.sql import functions as F

    paragraphs = [f"Paragraph {i}. It has two sentences." for i in range(20)]
    whole = "\n".join(paragraphs)
    cases = [
        ("A b. C d.\nE f.\n\nG.", "A b. C d.\nE g.\n\nG.\nH", [(0, 1, 1, 1), (1, 0, 1, 2)]),
        (whole, "New here.\n" + whole, [(0, 0, 0, 1)]),  # one paragraph before twenty marks no other
        (whole, "\n".join([*paragraphs[:7], *paragraphs[8:]]), [(0, 7, 1, 0)]),
        (whole, whole.replace("Paragraph 5.", "Section 5."), [(0, 5, 1, 1)]),
        ("a\n\nb\n\nc", "a\n\nB\n\nc", [(1, 0, 1, 1)]),
        ("a\n\nb\n\nc", "a\n\nx\n\nb\n\nc", [(1, 0, 0, 1)]),
        ("a\n\nb\n\nc", "a\n\nc", [(1, 0, 1, 0)]),
        ("a\na\na\n", "a\na\n", [(0, 2, 1, 0)]),
        ("", "a", [(0, 0, 1, 1)]),
        ("same.", "same.", []),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    prints = df.select("i", *[fingerprints.fingerprint(fingerprints.leaves(F.col(c))).alias(c) for c in "ab"])
    got = {r["i"]: [tuple(x) for x in r["e"]] for r in prints.select("i", fingerprints.edits(F.col("a"), F.col("b")).alias("e")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    net = toxicity.fit(docs.select("doc_id", "text"), labels, toxicity.Settings(sample=300))
    out = toxicity.score(docs, net).select("doc_id", "score", toxicity.held_out().alias("held_out")).join(labels, "doc_id").toPandas()
    out = out[out.held_out]
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) for i in out.doc_id)
    flagged = out.score >= 0.7
    assert (flagged & (out.toxic == 1)).sum() >= 0.75 * (out.toxic == 1).sum()
    assert (flagged & (out.toxic == 0)).sum() <= 0.03 * (out.toxic == 0).sum()
    strange = toxicity.score(odd(spark), net)  # which has a score of its own
    assert strange.columns == [*odd(spark).columns, "_score"] and strange.count() == len(ODD)
    assert all(0 <= r["_score"] <= 1 for r in strange.collect())
    assert toxicity.score(empty(spark), net).count() == 0
    assert toxicity.fit(docs.limit(0), labels) == 0.0


def test_toxicity_training_reads_all_windows(monkeypatch):
    rng = np.random.default_rng(3)
    plain = np.array(["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(50)])
    texts, labels = [], []
    for k in range(16):
        w = rng.choice(plain, 20_000)
        if k % 2:
            w[50 + 80 * k : 54 + 80 * k] = "zzbad"  # in two of 1249 windows
        texts.append(" ".join(w))
        labels.append(k % 2)
    counted, trained, figures, gradients = [], [], toxicity.figures, toxicity.Network.gradients
    monkeypatch.setattr(toxicity, "figures", lambda logits, *rest: counted.append(len(logits)) or figures(logits, *rest))
    monkeypatch.setattr(toxicity.Network, "gradients", lambda net, x, *rest: trained.append(x) or gradients(net, x, *rest))
    toxicity.train(texts, np.array(labels), toxicity.Settings(epochs=1))
    assert counted[0] % 1249 == 0 and counted[0] > 8 * 1249
    assert trained[0][:, 0].max() > 0.3  # the log odds of the one word that only class 1 has


def test_toxicity_training_drops_only_equal_rows(monkeypatch):
    rng = np.random.default_rng(4)
    some = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    shared_part = some(300)  # most smallest runs of three words lie in it
    texts = [f"{shared_part} {some(5)}" for _ in range(8)]
    labels = [0, 0, 0, 0, 1, 1, 1, 1]
    texts += [texts[0].upper().replace(" ", ", "), texts[0], texts[4], "", ""]  # copies, one of them of the other class
    labels += [0, 1, 1, 0, 0]
    rows, read_all = [], toxicity.read_all
    monkeypatch.setattr(toxicity, "read_all", lambda column: rows.append(len(column)) or read_all(column))
    toxicity.train(texts, np.array(labels), toxicity.Settings(epochs=1))
    assert rows == [10]  # the eight, the copy of the other class, and one without words


def test_toxicity_log_odds_of_many_words():
    """The numbers of 800,001 words times 3000 documents don't fit 32 bits."""
    y = np.repeat(np.float32([0, 1]), 1500)
    have, odds = toxicity.log_odds(np.array([1, 800_000, 800_000], np.int32), np.array([0, 2000, 2999]), y, 800_001)
    assert have[[0, 1, 800_000]].tolist() == [0, 1, 2] and odds[1] < 0 < odds[800_000]


def peak(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_toxicity_training_memory():
    """Texts whose words are all different: the network's inputs are those of some windows at a time."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.bytes(5).hex() for _ in range(1500)) for _ in range(400)]
    K.powers(1)
    _, most = peak(lambda: toxicity.train(texts, np.arange(400) % 2, toxicity.Settings(epochs=4)))
    assert most < 20 * sum(map(len, texts))


def test_toxicity_long_text_memory(monkeypatch):
    """A long text is read in pieces, with the windows and the score that it has as a whole."""
    rng = np.random.default_rng(6)
    words = np.array(["".join(rng.choice(list("abcdefghé"), n)) for n in rng.integers(1, 12, 5000)])
    text = " ".join(rng.choice(words, 400_000)) + " " + "x" * 700_000 + "; " + " ".join(rng.choice(words, 100_000))
    net = toxicity.train([" ".join(rng.choice(words, 50)) for _ in range(40)], np.arange(40) % 2, toxicity.Settings(epochs=3))
    data, offsets = K.column_bytes(pa.array([text], pa.large_string()))
    K.powers(len(data) + 1)
    got, most = peak(lambda: toxicity.score_block(net, data, offsets, 32))
    assert most < 15 * len(data)
    pieces = list(toxicity.pieces(data, offsets))
    assert len(pieces) > 3 and b"".join(d.tobytes() for d, _ in pieces) == data.tobytes()
    counts, h, _, which = toxicity.read(data, offsets)
    assert counts.tolist() == [500_001] and (h[which] == K.word_hashes(data, offsets, K.PUNCTUATION)[3]).all()
    monkeypatch.setattr(K, "BLOCK_BYTES", len(data))
    assert np.abs(got - toxicity.score_block(net, data, offsets, 32)).max() < 1e-6


def test_toxicity_training_takes_1500_of_a_class(spark):
    docs = spark.range(2600).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = docs.selectExpr("doc_id", "0 as toxic").filter(~toxicity.held_out())
    assert labels.count() > 1500
    texts, marks = toxicity.training_rows(docs, labels, toxicity.Settings())
    assert len(texts) == len(marks) == 1500


def plain_score(net, text, window):
    """The score of one text by loops over its windows, words and units."""
    sq = lambda v: v / (1 + abs(v))
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(text))]
    vectors = []
    for w in words:
        data = np.frombuffer(w, np.uint8)
        prefix, ends = K.prefix_hash(K.SPREAD[data]), (np.array([0]), np.array([len(w)]))
        parts = toxicity.word_parts(prefix, *ends)[0]
        known = np.flatnonzero(net.vocabulary == K.span_hash(prefix, *ends)[0])
        chars = sum((net.p["chars"][b].astype(float) for b in parts), np.zeros(toxicity.CHAR))
        vectors.append(np.concatenate([net.p["words"][known[0] + 1 if len(known) else 0].astype(float), chars]))
    half, logits = window // 2, []
    for a in range(0, max(1, -(-(len(words) - half) // half)) * half, half):
        own = vectors[a : a + window]
        blank = np.zeros(toxicity.WORD + toxicity.CHAR)
        steps = [*own, *[blank] * (window - len(own))]
        states = [np.zeros(2 * toxicity.HIDDEN) for _ in steps]
        for d, order in (("f", range(window)), ("b", reversed(range(window)))):
            h = np.zeros(toxicity.HIDDEN)
            for t in order:
                g = net.p[f"W{d}"].astype(float) @ steps[t] + net.p[f"c{d}"]
                u = net.p[f"U{d}"].astype(float) @ h
                n = toxicity.HIDDEN
                z, r = (np.array([0.5 + 0.5 * sq(v) for v in g[k : k + n] + u[k : k + n]]) for k in (0, n))
                new = np.array([sq(v) for v in g[2 * n :] + r * u[2 * n :]])
                h = z * h + (1 - z) * new
                states[t][slice(0, n) if d == "f" else slice(n, 2 * n)] = h
        weights = [float(np.exp(s @ net.p["attend"])) for s in states[: len(own)]] + [0.0] * (window - len(own))
        if not own:
            weights = [1.0] * window
        pooled = sum(w * s for w, s in zip(weights, states, strict=True)) / sum(weights)
        logits.append(float(pooled @ net.p["out"] + net.p["bias"][0]))
    values = sorted((sq(v / 2) for v in logits), reverse=True)
    quarter = values[: -(-len(values) // 4)]
    x = net.scale[0] + net.scale[1] * values[0] + net.scale[2] * sum(quarter) / len(quarter) + net.scale[3] * sum(values) / len(values)
    return 1 / (1 + np.exp(-x))


def test_toxicity_score_by_plain_loops(spark):
    rng = np.random.default_rng(6)
    some = lambda n, bad: " ".join(rng.choice(["vile", "rotten"] if bad and rng.random() < 0.3 else [f"w{i}" for i in range(40)]) for _ in range(n))
    texts = [some(int(n), i % 2) for i, n in enumerate(rng.integers(5, 90, 40))]
    net = toxicity.train(texts, np.arange(40) % 2, toxicity.Settings(epochs=3))
    rows = [(i, t) for i, t in enumerate([*texts[:6], "", None, "vile", "New WORDS, ünïcode 日本語 vile! " * 30, " ".join(texts)])]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    for i, t in rows:
        assert abs(got[i] - plain_score(net, t, toxicity.Settings.window)) < 1e-4, (i, t)


def test_toxicity_training_rows_do_not_depend_on_partitions(spark):
    rows = [(i, f"text {i}") for i in range(60)] + [(i, f"another text {i}") for i in range(60)] + [(None, "none")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, 0), (8, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = [toxicity.training_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels.repartition(n), toxicity.Settings()) for n in (1, 5, 9)]
    assert got[0][0] == got[1][0] == got[2][0] and got[0][1].tolist() == got[1][1].tolist()
    ids = {int(t.split()[-1]) for t in got[0][0]}
    assert ids == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1} - {5, 8}
    texts, marks = toxicity.training_rows(spark.createDataFrame(rows, "doc_id long, text string"), labels, toxicity.Settings(sample_bytes=100))
    assert all(sum(len(t) for t, m in zip(texts, marks, strict=True) if m == k) <= 100 for k in (0, 1)) and len(texts) > 8


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    net = toxicity.Network(np.array([1, 2, 3], np.uint64), np.ones(3, np.float32), np.zeros(toxicity.BUCKETS, np.float32), 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(6, toxicity.WORD + toxicity.CHAR))
    x[-1] = 0
    windows = rng.integers(0, 6, (5, 4))
    windows[0] = 0
    y, w = np.array([0.0, 1, 0, 1]), np.array([1.0, 2, 1, 1])

    def loss():
        p = 1 / (1 + np.exp(-net.forward(x.copy(), windows)))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    # States are kept in single precision, hence the tolerance.
    g, _ = net.gradients(x, windows, y, w)
    for name, value in g.items():
        flat = net.p[name].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 4)):
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - value.reshape(-1)[i]) < 3e-3, name
