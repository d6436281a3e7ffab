"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

Words are maximal runs of bytes other than ASCII punctuation, controls and white space, A-Z lower-cased. A word's input is
an embedding of its own (words that fewer than ``least_documents`` training documents hold share one) and the sum of
embeddings of its hashed first 2 to 9 and last 2 to 5 bytes. A document is read in windows of ``window`` words, each half
over the next, all of them. A document's score is logistic in three figures of its windows' logits, squashed: the highest,
the mean of the highest quarter, and the mean. The gates use x / (1 + |x|) in place of exponentials.

Training sees at most ``sample`` labelled documents of each class, and of those at most ``sample_bytes`` of text (in the
order of hashes of doc_id, leaving out what no longer fits), whole and with all their windows; rows of equal words and the
same class count once, and of several texts under one doc_id the one with the smallest hashes. Ids labelled both ways are no
examples. That sample is the only bound; scoring reads every word of every document. The network learns from the window that
scores highest in each document, starting with the one whose words' log odds are highest.

Null and empty texts score as an empty window; very long ones by all their windows. Repeated rows score alike, null doc_ids
like others. With no labelled rows of either class, or an empty table, every score is the share of class 1 among labels (0.0
without any). Other columns are not read and stay; the score takes a free name.

Settings are chosen by ``cross_validated`` on the rows that may be learnt from, never on those held out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import shared
from . import textkernel as K

HIDDEN, WORD, CHAR, BUCKETS = 4, 6, 6, 1 << 15
PREFIXES, SUFFIXES = range(2, 10), range(2, 6)
WINDOWS = 4096  # of which states are held at a time


@dataclass
class Settings:
    window: int = 32
    sample: int = 1500
    sample_bytes: int = 16 << 20
    least_documents: int = 3
    epochs: int = 14
    rate: float = 0.02
    decay: float = 3e-2
    seed: int = 7


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * squash(x)


class Network:
    """Parameters, scoring and training. Arrays of states are (units, windows)."""

    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray, bucket_odds: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.vocabulary = vocabulary  # sorted hashes; entry i has embedding i + 1, all other words 0
        n = len(vocabulary) + 1
        words = small(n, WORD) * 0.1
        words[1:, 0] = odds / 4
        words[0] = 0
        chars = small(BUCKETS, CHAR) * 0.1
        chars[:, 0] = bucket_odds / 8
        chars[0] = 0  # no such prefix or suffix
        h = HIDDEN
        self.scale = np.array([0.0, 1.0, 0.0, 0.0])
        self.p = {"words": words, "chars": chars}
        for d in "fb":
            self.p |= {f"W{d}": small(3 * h, WORD + CHAR) * 3, f"U{d}": small(3 * h, h) * 3, f"c{d}": np.zeros(3 * h, np.float32)}
        self.p |= {"attend": small(2 * h), "out": small(2 * h) * 3, "bias": np.full(1, -1.0, np.float32)}

    # Inputs

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """(words + 1, WORD + CHAR); the last row is the padding's. parts: (words, buckets of prefixes and suffixes)."""
        x = np.zeros((len(ids) + 1, WORD + CHAR), np.float32)
        x[:-1, :WORD] = self.p["words"][ids]
        for k in range(parts.shape[1]):
            x[:-1, WORD:] += self.p["chars"][parts[:, k]]
        return x

    def direction(self, d: str, x: np.ndarray, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(steps, HIDDEN, windows) states. windows: (steps, windows) rows of x."""
        h, u = HIDDEN, self.p[f"U{d}"]
        given = np.ascontiguousarray((x @ self.p[f"W{d}"].T + self.p[f"c{d}"]).T)
        state, out = np.zeros((h, windows.shape[1]), np.float32), np.empty((len(windows), h, windows.shape[1]), np.float32)
        for t in range(len(windows)) if d == "f" else reversed(range(len(windows))):
            a, b = given[:, windows[t]], u @ state
            zr = a[: 2 * h] + b[: 2 * h]
            zr /= 1 + np.abs(zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:h], zr[h:]
            n = a[2 * h :] + r * b[2 * h :]
            n /= 1 + np.abs(n)
            new = n + z * (state - n)
            if keep is not None:
                keep.append((t, state, z, r, n, b[2 * h :]))
            state = new
            out[t] = state
        return out

    def forward(self, x: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows (steps, windows) whose entries are rows of x; len(x) - 1 is padding."""
        traces = {d: [] if keep is not None else None for d in "fb"}
        s = np.concatenate([self.direction(d, x, windows, traces[d]) for d in "fb"], axis=1)
        e = np.tensordot(s, self.p["attend"], axes=(1, 0))
        e[windows == len(x) - 1] = -1e9
        e -= e.max(axis=0)
        np.exp(e, out=e)
        e /= e.sum(axis=0)
        pooled = np.einsum("tub,tb->ub", s, e)
        if keep is not None:
            keep |= {"traces": traces, "s": s, "e": e, "pooled": pooled}
        return self.p["out"] @ pooled + self.p["bias"][0]

    # Training

    def gradients(self, x: np.ndarray, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted logistic loss, and with respect to x."""
        keep: dict = {}
        logits = self.forward(x, windows, keep)
        err = weights * (1 / (1 + np.exp(-logits)) - labels) / weights.sum()
        s, e, pooled, h = keep["s"], keep["e"], keep["pooled"], HIDDEN
        g = {"out": pooled @ err, "bias": np.array([err.sum()], np.float32)}
        d_pooled = self.p["out"][:, None] * err
        along = np.einsum("tub,ub->tb", s, d_pooled)
        de = e * (along - (e * along).sum(axis=0))
        g["attend"] = np.einsum("tub,tb->u", s, de)
        ds = e[:, None] * d_pooled[None] + de[:, None] * self.p["attend"][None, :, None]
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, back = self.p[f"U{d}"], np.zeros((h, windows.shape[1]), np.float32)
            gu, given = np.zeros_like(u), np.zeros((len(x), 3 * h), np.float32)
            for t, state, z, r, n, b in reversed(keep["traces"][d]):
                dh = back + ds[t, k * h : (k + 1) * h]
                dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
                dz = dh * (state - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dn * b * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                db = np.concatenate([dz, dr, dn * r])
                gu += db @ state.T
                back = dh * z + u.T @ db
                np.add.at(given, windows[t], np.concatenate([dz, dr, dn]).T)
            g[f"U{d}"], g[f"W{d}"], g[f"c{d}"] = gu, given.T @ x, given.sum(axis=0)
            dx += given @ self.p[f"W{d}"]
        return g, dx


def word_parts(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, prefixes and suffixes) hash buckets of words' first and last bytes; 0 where the word is shorter."""
    out = np.zeros((len(starts), len(PREFIXES) + len(SUFFIXES)), np.uint16)
    for k, (n, tail) in enumerate([*((n, False) for n in PREFIXES), *((n, True) for n in SUFFIXES)]):
        some = np.flatnonzero(ends - starts >= n)
        a = ends[some] - n if tail else starts[some]
        h = K.span_hash(prefix, a, a + n) ^ np.uint64(k + 1)
        out[some, k] = 1 + (K.mix(h) % np.uint64(BUCKETS - 1)).astype(np.uint16)
    return out


def window_rows(counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, counted within the block, and the document of each. counts: words of documents."""
    half = window // 2
    n = np.maximum(1, -(-(counts - half) // half))
    doc = np.repeat(np.arange(len(counts)), n)
    first = np.cumsum(counts) - counts
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return first[doc] + at * half, doc


def filled(starts: np.ndarray, doc: np.ndarray, counts: np.ndarray, window: int, padding: int) -> np.ndarray:
    """(window, windows) word numbers; padding past the document's end."""
    end = np.cumsum(counts)[doc]
    out = starts[None, :] + np.arange(window)[:, None]
    return np.where(out < end[None, :], out, padding)


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The block itself, or a text that makes one alone in pieces of some BLOCK_BYTES, cut before bytes that separate words."""
    begin = 0
    while len(offsets) == 2 and len(data) - begin > 2 * K.BLOCK_BYTES:
        end = begin + K.BLOCK_BYTES
        while end < len(data) and not K.PUNCTUATION[data[end : end + 4096]].any():  # within a very long word
            end += 4096
        end = min(len(data), end + int(np.argmax(K.PUNCTUATION[data[end : end + 4096]])) if end < len(data) else end)
        yield data[begin:end], np.array([0, end - begin])
        begin = end
    yield data[begin:], offsets if not begin else np.array([0, len(data) - begin])


def read_piece(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, row = K.words(data, offsets, K.PUNCTUATION)
    prefix = K.prefix_hash(K.SPREAD[K.LOWER[data]])
    h, first, which = np.unique(K.span_hash(prefix, starts, ends), return_index=True, return_inverse=True)
    return np.bincount(row, minlength=len(offsets) - 1), h, word_parts(prefix, starts[first], ends[first]), which


def merged(got: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What read() gives of several blocks as that of one."""
    h, at_h = np.unique(np.concatenate([g[1] for g in got]), return_inverse=True)
    at_h = np.split(at_h.astype(np.int32), np.cumsum([len(g[1]) for g in got])[:-1])
    parts = np.empty((len(h), got[0][2].shape[1]), np.uint16)
    for at, g in zip(at_h, got, strict=True):
        parts[at] = g[2]
    return np.concatenate([g[0] for g in got]), h, parts, np.concatenate([at[g[3]] for at, g in zip(at_h, got, strict=True)])


def read(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' counts by document; hashes and parts of the distinct words; and which distinct word each word is."""
    got = [read_piece(*piece) for piece in pieces(data, offsets)]
    if len(got) == 1:
        return got[0]
    counts, *rest = merged(got)
    return counts.sum(keepdims=True), *rest


def read_all(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """read() of a whole column, block by block."""
    return merged([read(data, offsets) for _, _, data, offsets in K.blocks(column)])


def figures(logits: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(documents, 4): 1, and of the windows' squashed logits the highest, the mean of the highest quarter, the mean."""
    order = np.lexsort((-logits, doc))
    v, doc = squash(logits[order].astype(np.float64) / 2), doc[order]
    begin = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(begin)
    total = np.concatenate([[0], np.cumsum(v)])
    quarter = -(-size // 4)
    return np.stack([np.ones(n), v[begin[:-1]], (total[begin[:-1] + quarter] - total[begin[:-1]]) / quarter, (total[begin[1:]] - total[begin[:-1]]) / size], axis=1)


def logits_of(net: Network, ids: np.ndarray, parts: np.ndarray, which: np.ndarray, first: np.ndarray, doc: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Logits of all windows, WINDOWS at a time with the inputs of their own words alone. ids, parts: of distinct words; which: the distinct word that each word is."""
    out = [np.zeros(0, np.float32)]
    for i in range(0, len(first), WINDOWS):
        some = slice(i, i + WINDOWS)
        begin, end = first[i], min(first[some][-1] + window, len(which))
        own, local = np.unique(which[begin:end], return_inverse=True)
        rows = filled(first[some], doc[some], counts, window, end) - begin
        out.append(net.forward(net.inputs(ids[own], parts[own]), np.append(local, len(own))[rows]))
    return np.concatenate(out)


def score_block(net: Network, data: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    counts, h, parts, which = read(data, offsets)
    first, doc = window_rows(counts, window)
    logits = logits_of(net, net.word_ids(h), parts, which, first, doc, counts, window)
    return 1 / (1 + np.exp(-(figures(logits, doc, len(counts)) @ net.scale)))


def log_odds(ids: np.ndarray, doc: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By id below n: documents that have it, and the log odds of class 1 in them, drawn to 0 where they are few."""
    pairs = np.unique(ids.astype(np.int64) * len(y) + doc)
    ids, toxic = pairs // len(y), y[pairs % len(y)] > 0
    have, p = np.bincount(ids, minlength=n), np.bincount(ids[toxic], minlength=n)
    odds = np.log((p + 0.5) / (y.sum() + 1)) - np.log((have - p + 0.5) / (len(y) - y.sum() + 1))
    return have, odds * np.minimum(1, have / 8)


def train(texts: list[str], labels: np.ndarray, settings: Settings) -> Network | float:
    """A network, or the share of class 1 where one class is missing."""
    seen: set[tuple] = set()
    kept = []
    for i, text in enumerate(texts):
        h = np.concatenate([K.word_hashes(*piece, K.PUNCTUATION)[3] for piece in pieces(*K.column_bytes(pa.array([text], pa.large_string())))])
        same = (labels[i], len(h), int(K.span_hash(K.prefix_hash(h), np.array([0]), np.array([len(h)]))[0]))
        if same not in seen:
            seen.add(same)
            kept.append(i)
    y = np.asarray(labels)[kept].astype(np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    counts, hashes, parts, which = read_all(pa.array([texts[i] for i in kept], pa.large_string()))
    word_doc = np.repeat(np.arange(len(y)), counts)
    have, odds = log_odds(which, word_doc, y, len(hashes))
    often = have >= settings.least_documents
    each = np.unique(which.astype(np.int64) * len(y) + word_doc)  # distinct words of documents
    each_word, each_doc = (each // len(y)).astype(np.int32), (each % len(y)).astype(np.int32)
    del each, word_doc
    bucket_odds = np.zeros(BUCKETS)
    for k in range(parts.shape[1]):  # one kind after the other, for memory
        bucket_have, own = log_odds(parts[each_word, k], each_doc, y, BUCKETS)
        own[bucket_have < settings.least_documents] = 0
        bucket_odds = np.where(np.abs(own) > np.abs(bucket_odds), own, bucket_odds)
    bucket_odds[0] = 0
    del each_word, each_doc
    net = Network(hashes[often], odds[often].astype(np.float32), bucket_odds.astype(np.float32), settings.seed)
    ids = net.word_ids(hashes)
    first, doc = window_rows(counts, settings.window)
    begin = np.searchsorted(doc, np.arange(len(y) + 1))
    hints = np.full(len(ids) + 1, -np.inf)
    for k in range(parts.shape[1]):
        np.maximum(hints[:-1], bucket_odds[parts[:, k]], out=hints[:-1])
    hints[:-1] += np.where(often, odds, 0)
    hints[-1] = -99
    padded = np.append(which, np.int32(len(ids)))

    def rows(some: np.ndarray | slice) -> np.ndarray:
        """(window, windows) distinct words of some windows. All windows' at once could be too many for memory."""
        return padded[filled(first[some], doc[some], counts, settings.window, len(which))]

    hint = np.concatenate([hints[rows(slice(i, i + WINDOWS))].max(axis=0) for i in range(0, len(first), WINDOWS)])
    del hashes, hints, have, odds, often
    rng, moments, step = np.random.default_rng(settings.seed), {}, 0
    weight = np.where(y > 0, (len(y) - y.sum()) / y.sum(), 1.0)

    def update(name: str, g: np.ndarray) -> None:
        m, v = moments.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
        m *= 0.9
        m += 0.1 * g
        v *= 0.99
        v += 0.01 * g * g
        net.p[name] -= (settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def all_logits() -> np.ndarray:
        return logits_of(net, ids, parts, which, first, doc, counts, settings.window)

    for epoch in range(settings.epochs):
        value = hint if epoch < 3 else all_logits()
        best = np.array([b + int(np.argmax(value[b:e])) for b, e in zip(begin[:-1], begin[1:], strict=True)])
        order = rng.permutation(len(y))
        for i in range(0, len(order), 128):
            some = order[i : i + 128]
            other = rng.integers(begin[:-1][some], begin[1:][some])[y[some] == 0]
            pick = np.concatenate([best[some], other])
            words, local = np.unique(rows(pick), return_inverse=True)
            real = words[words < len(ids)]
            x = net.inputs(ids[real], parts[real])
            g, dx = net.gradients(x, local.reshape(settings.window, -1), np.concatenate([y[some], np.zeros(len(other), np.float32)]), np.concatenate([weight[some], np.ones(len(other))]).astype(np.float32))
            step += 1
            gw, gc = np.zeros_like(net.p["words"]), np.zeros_like(net.p["chars"])
            np.add.at(gw, ids[real], dx[:-1, :WORD])
            for k in range(parts.shape[1]):
                np.add.at(gc, parts[real, k], dx[:-1, WORD:])
            gw[0] = gc[0] = 0
            for name, value_of in (g | {"words": gw + settings.decay * net.p["words"], "chars": gc + settings.decay * net.p["chars"]}).items():
                update(name, value_of)
    f, w = figures(all_logits(), doc, len(y)), np.array([-1.0, 1.0, 1.0, 1.0])
    for _ in range(50):  # Newton's method, with a small penalty
        p = 1 / (1 + np.exp(-f @ w))
        curve = (f * (p * (1 - p))[:, None]).T @ f + 0.5 * np.eye(4)
        w = w - np.linalg.solve(curve, f.T @ (p - y) + 0.5 * w)
    net.scale = w
    return net


def cross_validated(texts: list[str], labels: np.ndarray, settings: Settings, folds: int = 3) -> dict[str, float]:
    """Mean log loss, and the shares of either class that score 0.7 or more, of rows scored by networks that the other folds trained."""
    fold = np.random.default_rng(0).permutation(len(labels)) % folds
    scores = np.zeros(len(labels))
    for f in range(folds):
        net = train([t for t, k in zip(texts, fold, strict=True) if k != f], np.asarray(labels)[fold != f], settings)
        column = pa.array([t for t, k in zip(texts, fold, strict=True) if k == f], pa.large_string())
        scores[fold == f] = net if isinstance(net, float) else np.concatenate([score_block(net, data, offsets, settings.window) for _, _, data, offsets in K.blocks(column)])
    y, p = np.asarray(labels) > 0, scores.clip(1e-6, 1 - 1e-6)
    return {"loss": float(-np.where(y, np.log(p), np.log(1 - p)).mean()), "caught": float((scores[y] >= 0.7).mean()), "wrong": float((scores[~y] >= 0.7).mean())}


def training_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame | None:
    """(label, doc_id, text): at most ``sample`` rows and ``sample_bytes`` of each class, whole texts; never rows that are held out. None without any."""
    usable = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
    clear = usable.groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high")).filter("low = high")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    each = [clear.filter(F.col("low") == value).select("doc_id", F.col("low").alias("label")).orderBy(*order).limit(settings.sample) for value in (0, 1)]
    # At most ``sample`` numbers of each class.
    found = docs.select("doc_id", shared.text_of().alias("text")).join(F.broadcast(each[0].unionByName(each[1])), "doc_id")
    one = found.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.struct(*shared.text_keys())).alias("text"))
    # Written once: the sizes and then the texts are read from it.
    kept = shared.Scratch(docs.sparkSession).keep(one.select("label", "doc_id", "text"), "sample")
    took, left = [], {0: settings.sample_bytes, 1: settings.sample_bytes}
    for r in kept.select("doc_id", "label", F.octet_length("text").alias("size")).orderBy(*order).collect():
        if r["size"] <= left[r["label"]]:
            took.append((r["doc_id"],))
            left[r["label"]] -= r["size"]
    if not took:
        return None
    wanted = docs.sparkSession.createDataFrame(took, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    return kept.join(F.broadcast(wanted), "doc_id").select("label", "doc_id", "text")


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[list[str], np.ndarray]:
    """The sample's texts and labels, by label and doc_id."""
    sample = training_sample(docs, labels, settings)
    rows = [] if sample is None else sample.orderBy("label", "doc_id").collect()
    return [r["text"] for r in rows], np.array([r["label"] for r in rows], dtype=np.int64)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Network | float:
    """Trains in one task of an executor, which reads the bounded sample; the driver gets the network alone, and a lost task runs again and gives the same."""
    settings = settings or Settings()
    shared.bound_batches(docs.sparkSession)
    sample = training_sample(docs, labels, settings)
    if sample is None:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            marks += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(marks), settings))], pa.binary())], ["network"])

    # As many rows and bytes as the settings allow.
    ordered = sample.repartition(1).sortWithinPartitions("label", "doc_id").select("label", "text")
    return pickle.loads(ordered.mapInArrow(run, "network binary").first()["network"])


def score(docs: DataFrame, net: Network | float, window: int = Settings.window) -> DataFrame:
    """docs with score appended (0 to 1; under another name where docs has one of that); other columns stay. One map over the rows, without a shuffle."""
    shared.bound_batches(docs.sparkSession)
    (name,) = shared.fresh(docs, "score")
    if isinstance(net, float):
        return docs.withColumn(name, F.lit(net))
    given = docs.sparkSession.sparkContext.broadcast(net)  # vocabulary of the bounded sample

    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [score_block(given.value, data, offsets, window) for _, _, data, offsets in K.blocks(batch.column(text_at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*out, np.zeros(0)]))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
