"""Scoring vectors as they arrive, and a top-k that goes on from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.analysis import top_rows
from ..operators.mixture import Mixture, score, whole


def read(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_scores(stream: DataFrame, model: Mixture, path: str, checkpoint: str, column: str = "x", available_now: bool = True):
    """Scores each batch by the batch operator; the sink's log and the checkpoint make each row count once."""
    if not whole(model):
        raise ValueError("a stream is scored by one map, which the model is too large for")
    writer = score(stream, model, column).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def keep_top(stream: DataFrame, model: Mixture, id_column: str, topk: int, path: str, checkpoint: str, column: str = "x"):
    """The top rows of each component over all batches so far, in the newest ``version=n`` of path. A batch that runs again writes the same version again."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = top_rows(batch, model, id_column, topk, column=column).select(id_column, "k", "score")
        if number:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{path}/version={number - 1}"))
        rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), id_column))
        rows.withColumn("rank", rank).filter(F.col("rank") <= topk).drop("rank").write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
