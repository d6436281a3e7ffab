"""Prompts and labelled prompts from csv, json and jsonl, with an explicit position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import first_text

PAIRS = (("prompt", "label"), ("text", "label"), ("sentence", "concept"), ("sentence", "label"))


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """pos from 0 over a file's prompts; prompt files are small, so one frame orders them."""
    return df.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("pos"), *[c for c in df.columns if c not in order])


def _text(v):
    """A json string's content; null for other kinds of value."""
    return F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string"))


def _from_object(v, prompt_field: str):
    return first_text(*[_text(F.try_variant_get(v, f"$.{name}", "variant")) for name in dict.fromkeys((prompt_field, "sentence", "prompt", "text"))])


def read_prompts(spark: SparkSession, path: str, prompt_field: str = "prompt", json_key: str | None = None, dedup: bool = False) -> DataFrame:
    """(pos, prompt). csv reads prompt_field alone. json: a list, or lists by key (json_key's, else all in order). jsonl: objects, lists, or plain lines; lines of broken json are skipped."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "csv":
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("at", F.monotonically_increasing_id())
        if prompt_field not in raw.columns:
            raw = raw.withColumn(prompt_field, F.lit(None).cast("string"))
        found = raw.select("at", F.lit(0).alias("inner"), first_text(F.col(prompt_field)).alias("prompt"))
    elif kind == "json":
        whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
        top = whole.select(F.schema_of_variant("v")).first()[0]
        if top.startswith("ARRAY"):
            lists = whole.select(F.lit(0).alias("at"), "v")
        elif top.startswith("OBJECT"):
            lists = whole.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("pos").alias("at"), F.col("key"), F.col("value").alias("v"))
            lists = lists.filter(F.col("key") == json_key) if json_key else lists
            lists = lists.select("at", "v").filter(F.schema_of_variant("v").startswith("ARRAY"))
        else:
            raise ValueError(f"{path}: neither a list nor an object")
        items = lists.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("at", F.col("pos").alias("inner"), "value")
        found = items.select("at", "inner", F.coalesce(first_text(_text(F.col("value"))), _from_object(F.col("value"), prompt_field)).alias("prompt"))
    elif kind == "jsonl":
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line")).filter("line <> ''")
        lines = lines.withColumn("v", F.when(F.col("line").rlike(r"^[{\[]"), F.try_parse_json("line")))
        plain = lines.filter(~F.col("line").rlike(r"^[{\[]")).select("at", F.lit(0).alias("inner"), F.col("line").alias("prompt"))
        objects = lines.filter(F.schema_of_variant("v").startswith("OBJECT")).select("at", F.lit(0).alias("inner"), _from_object(F.col("v"), prompt_field).alias("prompt"))
        inner = lines.filter(F.schema_of_variant("v").startswith("ARRAY")).select("at", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("at", F.col("pos").alias("inner"), "value")
        listed = inner.select("at", "inner", F.coalesce(first_text(_text(F.col("value"))), _from_object(F.col("value"), prompt_field)).alias("prompt"))
        found = plain.union(objects).union(listed)
    else:
        raise ValueError(f"{path}: not .csv, .json or .jsonl")
    out = _numbered(found.filter("prompt is not null"), "at", "inner")
    return distinct_prompts(out) if dedup else out


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(pos, prompt, label); rows that lack either are dropped, row by row."""
    if path.endswith(".csv"):
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
        pair = next((p for p in PAIRS if set(p) <= set(raw.columns)), None)
        if not pair:
            raise ValueError(f"{path}: no prompt and label columns")
        found = raw.select(F.monotonically_increasing_id().alias("at"), F.lit(0).alias("inner"), *(first_text(F.col(c)).alias(n) for c, n in zip(pair, ("prompt", "label"), strict=True)))
    elif path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
        top = whole.select(F.schema_of_variant("v")).first()[0]
        each = whole.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        if top.startswith("ARRAY"):
            field = lambda *names: first_text(*[F.try_variant_get(F.col("value"), f"$.{n}", "string") for n in names])
            found = each.select(F.col("pos").alias("at"), F.lit(0).alias("inner"), field("prompt", "text", "sentence").alias("prompt"), field("label", "concept").alias("label"))
        else:
            lists = each.select(F.col("pos").alias("at"), F.col("key").alias("label"), F.col("value").alias("v")).filter(F.schema_of_variant("v").startswith("ARRAY"))
            items = lists.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
            found = items.select("at", F.col("pos").alias("inner"), first_text(F.try_variant_get(F.col("value"), "$", "string")).alias("prompt"), F.trim("label").alias("label"))
    else:
        raise ValueError(f"{path}: not .csv or .json")
    return _numbered(found.filter("prompt is not null and label <> ''"), "at", "inner")


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Labelled prompts if the file has any, else plain ones."""
    try:
        out = read_labelled(spark, path)
        if not out.isEmpty():
            return out
    except ValueError:
        pass
    return read_prompts(spark, path, **options)


def distinct_prompts(prompts: DataFrame) -> DataFrame:
    """The first of each prompt, in order."""
    return _numbered(prompts.groupBy("prompt").agg(F.min("pos").alias("at")), "at")


def select_positions(prompts: DataFrame, positions) -> DataFrame:
    """Rows by a slice, a range or a list of positions; a list's order and repeats stay, as ord."""
    if isinstance(positions, slice):
        start, stop, step = positions.start or 0, positions.stop, positions.step or 1
        inside = (F.col("pos") >= start) & ((F.col("pos") - start) % step == 0)
        return prompts.filter(inside if stop is None else inside & (F.col("pos") < stop))
    wanted = prompts.sparkSession.createDataFrame(list(enumerate(positions)), "ord long, pos long")
    return wanted.join(prompts, "pos")


def batches(prompts: DataFrame, size: int) -> DataFrame:
    """(batch, prompts in order)."""
    return prompts.groupBy(F.floor(F.col("pos") / size).cast("long").alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "prompt"))), lambda x: x["prompt"]).alias("prompts"))
