"""Steering inside a language model: one pass, generation, and parallel samples, each a map over prompts.

There is no language model here: ``load()`` gives, once in each worker, an object with

    logits(tokens, change) -> (len(tokens), vocabulary) array

where ``change`` maps (site, layer) to a function of the vectors (tokens, D) at that place, which the model applies as it runs.
What is done with logits (steps, cut-offs, penalties, draws) is here, and the same for any model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .analysis import SITES
from .mixture import Mixture


@dataclass
class Steering:
    """Towards component k's centroid (or the posterior's mean of centroids) by alpha, then along the loadings by z."""

    model: Mixture
    alpha: float
    k: int | None = None
    z: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        m = self.model
        r = None if self.k is not None else m.posterior(m.log_likelihood(x))
        out = x + self.alpha * ((m.mu[self.k] if r is None else r @ m.mu) - x)
        if self.z is None:
            return out
        w, z = m.rotated_W(), np.asarray(self.z, float)
        if r is None:
            return out + w[self.k] @ z
        return out + r @ np.einsum("kdq,kq->kd", w, z if z.ndim == 2 else np.broadcast_to(z, (len(w), w.shape[2])))


@dataclass
class Sampling:
    """temperature 0 takes the likeliest token. penalty is taken off a logit for each time its token was drawn."""

    temperature: float = 0.0
    top_k: int | None = None
    top_p: float | None = None
    penalty: float = 0.0

    def draw(self, logits: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> int:
        logits = logits.astype(float) - self.penalty * counts
        if self.temperature <= 0:
            return int(np.argmax(logits))
        order = np.argsort(-logits, kind="stable")[: self.top_k or len(logits)]
        p = np.exp((logits[order] - logits[order[0]]) / self.temperature)
        p /= p.sum()
        if self.top_p is not None:
            order, p = (v[: int(np.searchsorted(np.cumsum(p), self.top_p)) + 1] for v in (order, p))
        return int(rng.choice(order, p=p / p.sum()))


def changes(steering: Steering, layers: list[int], site: str) -> dict:
    if site not in SITES:
        raise ValueError(f"{site} is none of {SITES}")
    return {(site, layer): steering for layer in layers}


def intervene(prompts: DataFrame, load: Callable, steering: Steering, layers: list[int], site: str = "residual", ids: str = "ids") -> DataFrame:
    """prompts with logits: those of the last token, after one pass with the vectors changed; null for a prompt without tokens."""
    change, at = changes(steering, layers, site), prompts.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            got = [np.asarray(model.logits(x, change)[-1], float).tolist() if x else None for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.float64()))], names=[*batch.schema.names, "logits"])

    return prompts.mapInArrow(run, StructType([*prompts.schema.fields, StructField("logits", ArrayType(DoubleType()))]))


def generate(prompts: DataFrame, load: Callable, steering: Steering, layers: list[int], steps: int, id_column: str, samples: int = 1, sampling: Sampling | None = None, end_id: int | None = None, site: str = "residual", ids: str = "ids", seed: int = 0) -> DataFrame:
    """(id, sample, generated): ``samples`` continuations of each prompt of at most ``steps`` tokens, to end_id. A draw depends on seed, id and sample alone, so a task that runs again gives the same."""
    how, change = sampling or Sampling(), changes(steering, layers, site)
    kind = prompts.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            rows, numbers, out = [], [], []
            for row, (name, prompt) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                for sample in range(samples if prompt else 0):
                    rng, tokens, counts = np.random.default_rng([seed, sample, *str(name).encode()]), list(prompt), None
                    for _ in range(steps):
                        logits = np.asarray(model.logits(tokens, change)[-1])
                        counts = np.zeros(len(logits)) if counts is None else counts
                        token = how.draw(logits, counts, rng)
                        counts[token] += 1
                        tokens.append(token)
                        if token == end_id:
                            break
                    rows.append(row), numbers.append(sample), out.append(tokens[len(prompt) :])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(out, pa.list_(pa.int32()))], [id_column, "sample", "generated"])

    return prompts.select(id_column, ids).mapInArrow(run, f"{id_column} {kind}, sample int, generated array<int>")
