"""The steps of a run, one after the other, on small tables."""

from pyspark.sql import functions as F

from factorlake.plans import commands
from factorlake.sources import activations

SF = "/root/testdata/sf0.001"


def test_all_steps(spark, tmp_path):
    data = f"{tmp_path}/data"
    spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("x"), F.col("label").cast("string").alias("subset")).write.parquet(data)
    commands.main(["all", "--data", data, "--out", f"{tmp_path}/run", "--subset", "subset", "--components", "4", "--rank", "2", "--epochs", "2", "--min-population", "5"])
    assert spark.read.parquet(f"{tmp_path}/run/overlap").count() == 6
    assert spark.read.parquet(f"{tmp_path}/run/intrinsic_dims").agg(F.sum("size")).first()[0] == 500
    record = activations.read_record(spark, f"{tmp_path}/run/split")
    assert record["train_rows"] + record["val_rows"] == 500
    commands.main(["score", "--data", data, "--out", f"{tmp_path}/run"])
    assert spark.read.parquet(f"{tmp_path}/run/scores").count() == 500


def test_windows_resume(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = commands.build_windows(spark, docs.filter("lang <> 'de'"), f"{tmp_path}/w", "lang", 64, 64 * 4 * 5).collect()
    again = commands.build_windows(spark, docs, f"{tmp_path}/w", "lang", 64, 64 * 4 * 5).collect()
    assert {r["lang"] for r in again} - {r["lang"] for r in first} == {"de"}
    assert commands.build_windows(spark, docs, f"{tmp_path}/w", "lang", 64, 64 * 4 * 5, dry_run=True).count() == 4


def load_toy():
    import numpy as np

    return lambda texts: [{("residual", 0): np.array([[len(t), i % 3, len(x) % 5, 1.0] for i, t in enumerate(x)], float)} for x in texts]


def test_extraction_commands(spark, tmp_path):
    docs, out = f"{tmp_path}/docs", f"{tmp_path}/x"
    spark.createDataFrame([(i, f"some words of text {i} " * (i % 4 + 1)) for i in range(30)], "doc_id long, text string").write.parquet(docs)
    commands.main(["extract", "--data", docs, "--out", out, "--model", "tests.test_commands:load_toy", "--max-tokens", "100"])
    assert spark.read.parquet(f"{out}/activations").agg(F.max("row_id"), F.count("*")).first()[:] == (99, 100)
    windows = f"{tmp_path}/w"
    spark.range(20).selectExpr("id as global_row", "'s' as subset", "array('a', 'b', concat('t', id)) as token_ids").write.parquet(windows)
    commands.main(["extract-windows", "--data", windows, "--out", f"{out}/w", "--model", "tests.test_commands:load_toy", "--shard-rows", "8", "--wave", "2"])
    assert spark.read.parquet(f"{out}/w/vectors").count() == 60
    commands.main(["all", "--data", docs, "--out", f"{out}/all", "--model", "tests.test_commands:load_toy", "--components", "3", "--rank", "1", "--epochs", "1", "--batch", "100", "--clip", "1", "--save-epochs", "--min-population", "2"])
    assert spark.read.parquet(f"{out}/all/overlap").count() == 3
    assert activations.load_mixture(spark, f"{out}/all/epochs/001").mu.shape == (3, 4)


def test_split_command(spark, tmp_path):
    data = f"{tmp_path}/d"
    spark.range(1000).selectExpr("id as row_id", "if(id % 10 = 0, null, concat('s', id % 3)) as subset").write.parquet(data)
    for _ in range(2):  # the second reads the first's
        commands.main(["split", "--data", data, "--out", f"{tmp_path}/o", "--subset", "subset", "--val-fraction", "0.1"])
    got = {(r["subset"], r["split"]): r["count"] for r in spark.read.parquet(f"{tmp_path}/o/split_rows").groupBy("subset", "split").count().collect()}
    assert {s: n for (s, w), n in got.items() if w == "val"} == {None: 10, "s0": 30, "s1": 30, "s2": 30}
