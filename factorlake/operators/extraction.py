"""Token vectors from texts through a pluggable model.

A model is a function from a list of token lists to a list of dicts (site, layer) -> array (tokens, D), made once in each
Python worker by ``load``. Without a language model the operators below still give token ids, samples and labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from .analysis import SITES
from .corpus import token_frequency, token_rows, with_frequency


def token_ids(df: DataFrame, id_column: str, text: str = "text", label: str | None = None, tokenize: Callable[[Column], Column] = tokens, excluded: list[str] | None = None) -> DataFrame:
    """(id, pos, token[, label]): each token of each sample, without excluded ones (padding and begin marks)."""
    rows = token_rows(df, tokenize(F.col(text)), id_column, *([label] if label else []))
    return rows.filter(~F.col("token").isin(excluded)) if excluded else rows


def single_token(rows: DataFrame, token: str) -> DataFrame:
    return rows.filter(F.col("token") == token)


def activations(df: DataFrame, load: Callable[[], Callable], layers: list[int], id_column: str, site: str = "residual", text: str = "text", tokenize: Callable[[Column], Column] = tokens, begin: str | None = None, excluded: list[str] | None = None, batch: int = 5) -> DataFrame:
    """(id, layer, pos, token, x, freq): vectors of all tokens but excluded ones, with each token's frequency over the table. One forward pass gives all layers; a begin mark goes before each text and its vector is cut off."""
    if site not in SITES:
        raise ValueError(f"{site} is none of {SITES}")
    kind = df.schema[id_column].dataType.simpleString()
    ids = tokenize(F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for part in batches:
            rows, lists = part.column(0).to_pylist(), part.column(1).to_pylist()
            for a in range(0, len(rows), batch):
                texts = [([begin] if begin else []) + (x or []) for x in lists[a : a + batch]]
                for row, own, got in zip(rows[a : a + batch], texts, model(texts), strict=True):
                    for layer in layers:
                        x = np.asarray(got[site, layer], np.float32)[1 if begin else 0 :]
                        names = own[1 if begin else 0 :]
                        if names:
                            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                            yield pa.RecordBatch.from_arrays([pa.array([row] * len(names)), pa.array([layer] * len(names), pa.int32()), pa.array(range(len(names)), pa.int32()), pa.array(names), flat], [id_column, "layer", "pos", "token", "x"])

    out = df.select(id_column, ids.alias("ids")).mapInArrow(run, f"{id_column} {kind}, layer int, pos int, token string, x array<float>")
    out = out.filter(~F.col("token").isin(excluded)) if excluded else out
    return with_frequency(out, token_frequency(token_rows(df, ids, id_column)))


def position_norms(df: DataFrame, column: str = "x") -> DataFrame:
    """(pos, n, mean_norm, finite)."""
    from ..functions import all_finite, norm

    return df.groupBy("pos").agg(F.count("*").alias("n"), F.avg(norm(F.col(column))).alias("mean_norm"), F.bool_and(all_finite(F.col(column))).alias("finite"))
