"""Operator 8: document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words, all of them.  Each
passage is encoded by a small network over its measures (case, symbols, marks,
repetition, word lengths); gated attention, learnt from document labels alone,
weighs the passages, and the document's score is a logistic function of the
weighted passage representation.

Fitting reads at most ``TRAINING_ROWS`` labelled rows, none of the held-out
fold; every document is scored on its whole text.

Edge cases: null, empty and wordless texts are one passage of zeros; one class
or no labels at all gives score 1 for all (nothing is rejected unlearnt);
repeated rows score alike; other columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingle_kernel as K
from .common import read_table
from .labelled import filtered, held_out, scored, training_rows
from .toxicity import text_chunks

TRAINING_ROWS = 6_000
PASSAGE_WORDS = 64
ACCEPTED = 0.3
HIDDEN, GATES = 24, 12
EPOCHS, RATE = 250, 0.02


def _table(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[ord(c) for c in chars]] = True
    return found


_CLASSES = [
    _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _table("abcdefghijklmnopqrstuvwxyz"),
    _table("#*$%&<>"),
    _table("!"),
    _table("|"),
    _table(".?"),
    _table(",;:"),
    _table("0123456789"),
    _table("\n"),
    np.arange(256) >= 128,
]
N_MEASURES = len(_CLASSES) + 6


def passage_measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Measures of every passage of a batch, and each text's first passage."""
    texts = len(offsets) - 1
    hashes, at = K.word_hashes(data, offsets)
    n_words = np.diff(at)
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(n_passages)])
    measures = np.zeros((first[-1], N_MEASURES))
    owner = np.repeat(np.arange(texts), n_passages)
    inside = np.arange(first[-1]) - first[owner]
    measures[:, -1] = np.log1p(n_words)[owner]
    # the words of a passage, and its bytes up to the next passage of its text
    low = at[owner] + inside * PASSAGE_WORDS
    high = np.minimum(low + PASSAGE_WORDS, at[owner + 1])
    words = np.maximum(high - low, 1)
    begin = _begins(data, offsets)
    some = high > low
    byte_low = offsets[owner].copy()
    byte_low[inside > 0] = begin[low[inside > 0]]
    byte_high = np.where(np.arange(len(owner)) + 1 < first[owner + 1], np.append(byte_low, len(data))[1:][np.arange(len(owner))], offsets[owner + 1])
    for column, table in enumerate(_CLASSES):
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        measures[:, column] = (sums[byte_high] - sums[byte_low]) / words
    column = len(_CLASSES)
    measures[:, column] = np.log1p(high - low)
    measures[:, column + 1] = (byte_high - byte_low) / words
    passage = np.repeat(np.arange(len(owner)), high - low)
    text = owner[passage]
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    measures[:, column + 2] = np.bincount(passage, same, len(owner)) / words
    _, kept = np.unique(K.mix(hashes + K.mix(passage.astype(np.uint64))), return_index=True)
    measures[:, column + 3] = np.where(some, np.bincount(passage[kept], minlength=len(owner)) / words, 1)
    if len(hashes) >= 3:
        runs = K.mix(hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7))
        whole = text[:-2] == text[2:]
        keys = K.mix(runs + K.mix(text[:-2].astype(np.uint64)))
        _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
        twice = (times[back] > 1) & whole
        measures[:, column + 4] = np.bincount(passage[:-2], twice, len(owner)) / words
    return measures, first


def _begins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each word of the batch begins."""
    word = ~K._SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    first[starts] = word[starts]
    return np.flatnonzero(first)


class GatedAttention:
    """A passage encoder, gated attention over a bag and a logistic output."""

    def __init__(self, inputs: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.spread = np.zeros(inputs), np.ones(inputs)
        self.p = {
            "W": draw(inputs, HIDDEN),
            "b": np.zeros(HIDDEN),
            "V": draw(HIDDEN, GATES),
            "U": draw(HIDDEN, GATES),
            "w": draw(GATES),
            "c": draw(HIDDEN),
            "d": np.zeros(1),
        }

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """first: each bag's first passage and the end; no bag is empty."""
        p = self.p
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        a = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"bag": bag, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y}

    def gradients(self, x: np.ndarray, first: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first)
        bag, h, t, s, a = (f[k] for k in ("bag", "h", "t", "s", "a"))
        out = (f["y"] - target) * weight / weight.sum()
        dz = (out[:, None] * p["c"])[bag]
        da = (dz * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
        dgate = de[:, None] * p["w"]
        dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {
            "W": x.T @ dh,
            "b": dh.sum(0),
            "V": h.T @ dt,
            "U": h.T @ ds,
            "w": (t * s).T @ de,
            "c": f["z"].T @ out,
            "d": np.array([out.sum()]),
        }

    def fit(self, x: np.ndarray, first: np.ndarray, target: np.ndarray) -> GatedAttention:
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-3
        x = self.inputs(x)
        share = target.mean()
        weight = np.where(target == 1, 0.5 / share, 0.5 / (1 - share))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, EPOCHS + 1):
            for k, g in self.gradients(x, first, target, weight).items():
                g = g + 1e-4 * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(self.inputs(x), first)["y"]


def _training_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = []
        for data, offsets in text_chunks(batch.column(0)):
            x, first = passage_measures(data, offsets)
            bags += [x[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(bags, pa.binary())], names=["y", "bag"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAINING_ROWS) -> GatedAttention | None:
    """Fits the network; None without both classes."""
    rows = training_rows(docs, labels, label, bound).select("text", "y").mapInArrow(_training_bags, "y int, bag binary").toPandas()
    rows = rows.sort_values(["y", "bag"]).drop_duplicates()
    target = rows["y"].to_numpy().astype(float)
    if not len(target) or target.min() == target.max():
        return None
    bags = [np.frombuffer(b, "<f4").reshape(-1, N_MEASURES) for b in rows["bag"]]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return GatedAttention(N_MEASURES).fit(np.concatenate(bags).astype(float), first, target)


def scorer(model: GatedAttention | None):
    """A function that scores an Arrow array of texts."""

    def score(texts: pa.Array) -> np.ndarray:
        if model is None:
            return np.ones(len(texts))
        return np.concatenate([np.zeros(0), *(model.score(*passage_measures(*chunk)) for chunk in text_chunks(texts))])

    return score


def score_documents(docs: DataFrame, model: GatedAttention | None) -> DataFrame:
    """doc_id, score of every row."""
    return scored(docs, scorer(model))


def keep_good(docs: DataFrame, model: GatedAttention | None, threshold: float = ACCEPTED) -> DataFrame:
    """The rows, with all their columns, that score the threshold or more."""
    return filtered(docs, scorer(model), lambda score: score >= threshold)


def op8_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))
