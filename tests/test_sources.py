"""Readers and writers on small files; extraction; streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake import streaming
from factorlake.operators import extraction, intervention
from factorlake.plans import extract
from factorlake.sources import activations, prompts

from .test_mixture import GOLDEN, rows


def write(path, text):
    path.write_text(text)
    return str(path)


def listed(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("pos").select(*columns).collect()]


def test_prompt_files(spark, tmp_path):
    lines = write(tmp_path / "a.jsonl", '{"text":" a "}\n{bad\n\nplain\n["x",{"sentence":"y"}]\n"quoted"\n{"text":"  ","prompt":"p"}\n')
    assert listed(prompts.read_prompts(spark, lines), "prompt") == ["a", "plain", "x", "y", '"quoted"', "p"]
    keyed = write(tmp_path / "a.JSON", '{"k1":["p","  "],"k2":"no","k3":["q"]}')
    assert listed(prompts.read_prompts(spark, keyed), "prompt") == ["p", "q"]
    assert listed(prompts.read_prompts(spark, keyed, json_key="k3"), "prompt") == ["q"]
    assert listed(prompts.read_prompts(spark, keyed, json_key="no"), "prompt") == []
    with pytest.raises(ValueError):
        prompts.read_prompts(spark, write(tmp_path / "n.json", "3"))
    table = write(tmp_path / "a.csv", 'prompt,other\n"b\nc",1\n" ",2\na,3\na,4\n')
    assert listed(prompts.read_prompts(spark, table), "prompt") == ["b\nc", "a", "a"]
    assert listed(prompts.read_prompts(spark, table, dedup=True), "prompt") == ["b\nc", "a"]
    assert listed(prompts.read_prompts(spark, table, prompt_field="text"), "prompt") == []
    with pytest.raises(ValueError):
        prompts.read_prompts(spark, "a.txt")


def test_labelled_files(spark, tmp_path):
    both = write(tmp_path / "a.json", '[{"prompt":"","text":"t","label":"l"},{"text":"u"},"s"]')
    assert listed(prompts.read_labelled(spark, both), "prompt", "label") == [("t", "l")]
    by = write(tmp_path / "b.json", '{"l1":["a",null," "],"l2":"x"}')
    assert listed(prompts.read_labelled(spark, by), "prompt", "label") == [("a", "l1")]
    table = write(tmp_path / "a.csv", "text,label\nx,\n,l\ny,m\n")
    assert listed(prompts.read_labelled(spark, table), "prompt", "label") == [("y", "m")]
    with pytest.raises(ValueError):
        prompts.read_labelled(spark, write(tmp_path / "c.csv", "prompt,concept\na,b\n"))
    plain = write(tmp_path / "d.json", '["one","two"]')
    assert listed(prompts.read_any(spark, plain), "prompt") == ["one", "two"]
    assert "label" in prompts.read_any(spark, both).columns


def test_positions_and_batches(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate("bacca")], "pos long, prompt string")
    assert listed(prompts.distinct_prompts(df), "prompt") == ["b", "a", "c"]
    assert listed(prompts.select_positions(df, slice(1, None, 2)), "prompt") == ["a", "c"]
    assert [r["prompt"] for r in prompts.select_positions(df, [4, 0, 4]).orderBy("ord").collect()] == ["a", "b", "a"]
    assert [r["prompts"] for r in prompts.batches(df, 2).orderBy("batch").collect()] == [["b", "a"], ["c", "c"], ["a"]]


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([(layer, g // 2, g % 2, g, p, "s", 5, [float(layer), float(g), float(p)]) for layer in (0, 1) for g in range(4) for p in range(3)], activations.SCHEMA)
    path = f"{tmp_path}/acts"
    activations.write_shards(df.filter("shard = 0"), path)
    planned = df.select("layer", "shard").distinct()
    left = activations.todo(planned, activations.read_shards(spark, path))
    assert {tuple(r) for r in left.collect()} == {(0, 1), (1, 1)}
    activations.write_shards(df.join(left, ["layer", "shard"], "left_semi").select(df.columns), path)
    keep = spark.createDataFrame([(1,), (3,)], "global_row long")
    got = activations.read_shards(spark, path, layer=1, rows=keep, drop_prefix=1)
    assert got.count() == 4 and activations.token_count(keep, 3, 1) == 4
    assert activations.concat_layers(activations.read_shards(spark, path), [0, 1]).first()["x"].__len__() == 6
    orders = [[tuple(r) for r in activations.shuffled(df, 1, e).select("global_row", "pos").collect()] for e in (0, 0, 1)]
    assert orders[0] == orders[1] != orders[2]
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "shard_00002.json").write_text(json.dumps({"start": 4, "end": 6, "row_indices": [4, 5], "rows": [{"subset": "a", "window_start": 0, "window_end": 9, "doc_len": 20}, {"subset": "b", "window_start": 1, "window_end": 10, "doc_len": 30}]}))
    meta = activations.read_shard_metadata(spark, f"{tmp_path}/meta").orderBy("row_in_shard").collect()
    assert [(r["shard"], r["row_in_shard"], r["global_row"], r["subset"], r["doc_len"]) for r in meta] == [(2, 0, 4, "a", 20), (2, 1, 5, "b", 30)]
    assert activations.read_record(spark, f"{tmp_path}/none") is None


def test_extraction_with_a_toy_model(spark):
    def load():
        return lambda texts: [{("residual", k): np.array([[k, len(t), i] for i, t in enumerate(x)], float) for k in (0, 1)} for x in texts]

    df = spark.createDataFrame([(1, "The cat sat"), (2, "the end"), (3, None)], "id long, text string")
    out = extraction.activations(df, load, [0, 1], "id", begin="<s>")
    got = {(r["id"], r["layer"], r["pos"]): (r["token"], list(r["x"]), r["freq"]) for r in out.collect()}
    assert len(got) == 10 and got[1, 1, 1] == ("cat", [1.0, 3.0, 2.0], 1) and got[2, 0, 0][2] == 2
    assert extraction.activations(df, load, [0], "id", excluded=["the"]).count() == 3
    with pytest.raises(ValueError):
        extraction.activations(df, load, [0], "id", site="head")
    norms = extraction.position_norms(out.withColumn("x", F.col("x").cast("array<double>")))
    assert norms.count() == 3


def test_streams(spark, tmp_path):
    source = f"{tmp_path}/in"
    rows(spark).repartition(3).write.parquet(source)
    stream = streaming.read(spark, source, "row_id long, x array<double>", 1)
    streaming.write_scores(stream, GOLDEN, f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    streaming.keep_top(stream, GOLDEN, "row_id", 1, f"{tmp_path}/top", f"{tmp_path}/c2").awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/top").orderBy(F.desc("version")).limit(2).collect()
    assert {(r["k"], r["row_id"]) for r in last} == {(0, 0), (1, 1)}


def toy():
    return lambda texts: [{("residual", k): np.array([[k, len(t), i] for i, t in enumerate(x)], float) for k in (0, 1)} for x in texts]


def test_extraction_in_shards_resumes(spark, tmp_path):
    windows = spark.createDataFrame([(g, "ab"[g % 2], [f"t{g}", f"u{g % 3}", "v"]) for g in range(22)], "global_row long, subset string, token_ids array<string>")
    out, said = f"{tmp_path}/w", []
    assert extract.extract_windows(spark, windows, toy, out, [0, 1], shard_rows=4, wave=2, debug=True, log=said.append) == {"shards": 2, "tokens": 24}
    assert extract.extract_windows(spark, windows, toy, out, [0, 1], shard_rows=4, wave=2, log=said.append) == {"shards": 4, "tokens": 42}
    assert extract.extract_windows(spark, windows, toy, out, [0, 1], shard_rows=4, wave=2, log=said.append) == {"shards": 0, "tokens": 0}
    got = spark.read.parquet(f"{out}/vectors")
    assert got.count() == 22 * 3 * 2 and got.select("layer", "global_row", "pos").distinct().count() == 132
    shards = {r["shard"]: (r["start"], r["end"], r["n_rows"]) for r in spark.read.parquet(f"{out}/shards").collect()}
    assert shards == {s: (4 * s, min(22, 4 * s + 4), min(22, 4 * s + 4) - 4 * s) for s in range(6)}
    progress = [json.loads(r["value"]) for r in spark.read.text(f"{out}/progress").collect()]
    assert len(progress) == len(said) == 3 and max(p["done"] for p in progress) == 42
    with pytest.raises(ValueError):
        extract.extract_windows(spark, windows, toy, out, [0], shard_rows=4)


def test_extraction_of_one_layer(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a"), (3, None), (4, "b b")], "id long, text string")
    got = extract.extract(spark, docs, toy, f"{tmp_path}/m", 1, max_tokens=5).orderBy("row_id").collect()
    assert [(r["row_id"], r["token"], r["freq"]) for r in got] == [(0, "a", 2), (1, "b", 3), (2, "c", 1), (3, "a", 2), (4, "b", 3)]
    assert activations.read_record(spark, f"{tmp_path}/m/config")["layers"] == [1]
    assert activations.eta(10, 40, 5.0) == {"done": 10, "total": 40, "per_second": 2.0, "seconds_left": 15.0}


class Toy:
    """Five tokens; a token's vector is (token, place, 0), and the logits of a place prefer the token nearest to its vector's first entry plus one."""

    def logits(self, tokens, change):
        x = np.array([[t, i, 0.0] for i, t in enumerate(tokens)])
        for f in change.values():
            x = f(x)
        return -((x[:, :1] + 1 - np.arange(5)) ** 2)


def test_steering_inside_a_model(spark):
    prompts_ = spark.createDataFrame([(1, [0]), (2, [2, 1]), (3, [])], "id long, ids array<int>")
    still = intervention.Steering(GOLDEN, 0.0, 1)
    got = {r["id"]: r["generated"] for r in intervention.generate(prompts_, Toy, still, [0], 3, "id").collect()}
    assert got == {1: [1, 2, 3], 2: [2, 3, 4]}
    towards = intervention.Steering(GOLDEN, 1.0, 1)  # the centroid's first entry is 2, so 3 always follows
    assert {tuple(r["generated"]) for r in intervention.generate(prompts_, Toy, towards, [0], 3, "id").collect()} == {(3, 3, 3)}
    assert intervention.generate(prompts_, Toy, towards, [0], 3, "id", end_id=3).first()["generated"] == [3]
    logits = {r["id"]: r["logits"] for r in intervention.intervene(prompts_, Toy, towards, [0]).collect()}
    assert logits[3] is None and int(np.argmax(logits[1])) == 3
    how = intervention.Sampling(temperature=1.0, top_k=3, top_p=0.9, penalty=0.5)
    twice = [sorted((r["id"], r["sample"], tuple(r["generated"])) for r in intervention.generate(prompts_.repartition(n), Toy, still, [0], 4, "id", samples=5, sampling=how).collect()) for n in (1, 3)]
    assert twice[0] == twice[1] and len(twice[0]) == 10 and len({g for *_, g in twice[0]}) > 2
    x = np.array([[1.0, 0.5, 0.0]])
    assert np.allclose(intervention.Steering(GOLDEN, 0.6, None, np.array([2.0]))(x), [[1.932883, 1.718132, 0.416103]], atol=1e-6)
    with pytest.raises(ValueError):
        intervention.intervene(prompts_, Toy, towards, [0], site="head")


def test_checkpoints_of_others(spark, tmp_path):
    raw = GOLDEN.raw()
    np.savez(tmp_path / "m.npz", **raw)
    again = activations.read_state(spark, str(tmp_path / "m.npz"))
    assert np.allclose(again.W, GOLDEN.W, atol=1e-4) and np.allclose(again.psi, GOLDEN.psi, atol=1e-4)
    bare = activations.mixture_from_state({"state_dict": {"mu": raw["mu"], "dir_raw": raw["dir_raw"]}}, strict=False)
    assert np.allclose(bare.psi, 1, atol=1e-6) and np.allclose(np.exp(bare.log_pi), 0.5) and bare.rotation is None
    with pytest.raises(ValueError, match="lacks"):
        activations.mixture_from_state({"mu": raw["mu"], "dir_raw": raw["dir_raw"]})
    with pytest.raises(ValueError, match="fit"):
        activations.mixture_from_state(raw | {"dir_raw": raw["dir_raw"][:1]})
    activations.save_mixture(spark, GOLDEN, f"{tmp_path}/m")
    from factorlake.sources import folders

    folders.remove(spark, f"{tmp_path}/m/meta")
    with pytest.raises(ValueError, match="missing"):
        activations.load_mixture(spark, f"{tmp_path}/m")
    assert np.allclose(activations.load_mixture(spark, f"{tmp_path}/m", strict=False).W, GOLDEN.W, atol=1e-4)
    (tmp_path / "broken").write_text("{")
    with pytest.raises(ValueError):
        activations.read_record(spark, str(tmp_path / "broken"))


def test_top_deltas(spark):
    from factorlake.operators import analysis

    df = spark.createDataFrame([(1, 2.0), (2, -5.0), (3, 4.0), (4, 4.0)], "id long, delta double")
    got = {k: [r["id"] for r in v.collect()] for k, v in analysis.top_deltas(df, "delta", 2, "id").items()}
    assert got == {"up": [3, 4], "down": [2, 1], "absolute": [2, 3]}
