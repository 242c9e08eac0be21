"""Operator 5: toxicity by weak supervision.

Voters are weak: each entry of a lexicon (words and word beginnings that go
with the label in the training fold) votes "toxic" where it occurs, and pattern
voters judge the number and density of entries, shouting and symbols, or vote
"clean" where nothing is found.  A generative label model, fitted by
expectation maximisation, estimates how often each voter votes either way given
the hidden label; voters that agree beyond that (a word and its beginning) are
correlated and share one weight.  A logistic classifier is then trained on the
posterior labels, and its intercept is set on the training fold's labels.

Fitting reads at most ``TRAINING_ROWS`` labelled rows, none of the held-out
fold; every document is scored on its whole text.

Edge cases: null, empty and wordless texts get the score of a text without any
vote; one class or no labels at all gives score 0 for all; repeated rows score
alike; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingle_kernel as K
from .common import read_table, release
from .labelled import filtered, held_out, scored, training_rows

TRAINING_ROWS = 12_000
#: An entry's documents must be toxic in at least this share, and so unlikely
#: by chance (natural logarithm of the binomial tail's bound).
LEAST_PRECISION = 0.9
LEAST_EVIDENCE = 14.0
BUCKET_BITS = 22
PREFIXES = (4, 5, 6)
ROUNDS = 12
#: Voters whose residual correlation is above this share their weight.
CORRELATED = 0.3

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#*$%&|<>"]] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[ord("!")] = True


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of each word and of its beginnings: (words, 4); text places."""
    n = len(data)
    if not n:
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), np.zeros(len(offsets), np.int64)
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    starts, ends = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
    first[starts], last[ends] = word[starts], word[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = K._powers_to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((K._LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    base, scale = sums[begin], inverse[begin]
    units = np.empty((len(begin), 1 + len(PREFIXES)), np.int32)
    whole = K.mix((sums[end] - base) * scale)
    shift = np.uint64(64 - BUCKET_BITS)
    units[:, 0] = whole >> shift
    for column, length in enumerate(PREFIXES, 1):
        part = K.mix((sums[np.minimum(begin + length, end)] - base) * scale + np.uint64(length))
        units[:, column] = np.where(end - begin > length, part, whole) >> shift
    return units, np.searchsorted(begin, offsets)


def _own(units: np.ndarray) -> np.ndarray:
    """Which cells of ``word_units`` count: a short word's prefixes are itself."""
    own = units != units[:, :1]
    own[:, 0] = True
    return own


def _shares(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Capitals per byte, exclamation marks and symbols per word, by text."""
    found = []
    for table, over in ((_UPPER, np.diff(offsets)), (_SHOUT, words), (_MARK, words)):
        sums = np.concatenate([[0], np.cumsum(table[data])])
        found.append((sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(over, 1))
    return np.stack(found, 1)


def text_chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of some texts at a time, about K.CHUNK_BYTES."""
    texts, low = texts.cast(pa.large_binary()), 0
    while low < len(texts):
        rest = texts.slice(low)
        offsets = np.frombuffer(rest.buffers()[1], np.int64)[rest.offset : rest.offset + len(rest) + 1]
        high = max(1, int(np.searchsorted(offsets, offsets[0] + K.CHUNK_BYTES)) - 1)
        offsets, buffer = offsets[: high + 1], rest.buffers()[2]
        yield (
            np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.zeros(0, np.uint8),
            offsets - offsets[0],
        )
        low += high


def _training_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units, counts, shares, near, near2, n_words = [], [], [], [], [], []
        for data, offsets in text_chunks(batch.column(0)):
            found, at = word_units(data, offsets)
            counted = _own(found)
            shares += [row.astype("<f4").tobytes() for row in _shares(data, offsets, np.diff(at))]
            for a, b in zip(at[:-1], at[1:], strict=True):
                own, times = np.unique(found[a:b][counted[a:b]], return_counts=True)
                units.append(own.astype("<i4").tobytes())
                counts.append(times.astype("<i4").tobytes())
                n_words.append(int(b - a))
                # near copies mostly share their least hashes of three words
                words = found[a:b, 0].astype(np.uint64)
                runs = K.mix(words[:-2] + words[1:-1] * np.uint64(1 << 22) + words[2:] * np.uint64(1 << 44)) >> np.uint64(1)
                if not len(runs):  # of shorter texts only equal ones are copies
                    runs = K.mix(np.array([len(words), *words[:1], *words[-1:]], np.uint64).cumsum(dtype=np.uint64)[-1:]) >> np.uint64(1)
                near.append(int(runs.min()))
                near2.append(int((runs ^ np.uint64(0x5555555555555555)).min()))
        columns = [batch.column(1), pa.array(near, pa.int64()), pa.array(near2, pa.int64()), pa.array(n_words, pa.int64())]
        columns += [pa.array(units, pa.binary()), pa.array(counts, pa.binary()), pa.array(shares, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["y", "near", "near2", "n_words", "units", "counts", "shares"])


@dataclass
class Model:
    """The lexicon's buckets and the classifier's weights (intercept last)."""

    lexicon: np.ndarray
    weights: np.ndarray


def pattern_votes(hits: np.ndarray, distinct: np.ndarray, n_words: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Votes of the pattern voters: 1 toxic, -1 clean, 0 abstains."""
    density = hits / np.maximum(n_words, 1)
    votes = [
        np.where(distinct >= 2, 1, 0),
        np.where(distinct >= 4, 1, 0),
        np.where(density >= 0.02, 1, np.where(hits == 0, -1, 0)),
        np.where(hits == 0, -1, 0),
        np.where((hits == 0) & (n_words >= 200), -1, 0),
        np.where(shares[:, 1] > 0.3, 1, 0),
        np.where((shares[:, 0] > 0.4) & (hits > 0), 1, 0),
        np.where((shares[:, 2] < 0.01) & (hits == 0), -1, 0),
    ]
    return np.stack(votes, 1)


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior P(toxic) of each row, and the voters' weights.

    votes: (rows, voters) in -1, 0, 1.  start: first guess of the posterior.
    """
    q = start.astype(float)
    weight = np.ones(votes.shape[1])
    values = [(votes == v).astype(np.float32) for v in (-1, 0, 1)]
    for turn in range(rounds):
        share = np.clip(q.mean(), 0.01, 0.99)
        log = np.full(len(q), np.log(share / (1 - share)))
        for seen in values:
            given = [(seen.T @ c + 0.5) / (c.sum() + 1.5) for c in (q.astype(np.float32), (1 - q).astype(np.float32))]
            log += seen @ (weight * (np.log(given[0]) - np.log(given[1])))
        q = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        if turn == 1:  # what is left of agreement once the label is known
            mean = [votes.T @ c / max(c.sum(), 1e-9) for c in (q, 1 - q)]
            rest = votes - np.outer(q, mean[0]) - np.outer(1 - q, mean[1])
            spread = np.sqrt((rest**2).mean(0)) + 1e-9
            together = np.abs(rest.T @ rest / len(rest) / np.outer(spread, spread))
            together[together < CORRELATED] = 0
            np.fill_diagonal(together, 0)
            weight = 1 / (1 + together.sum(0))
    return q, weight


def classifier_inputs(hits, distinct, n_words, shares) -> np.ndarray:
    """The inputs beside the lexicon's entries, each of which is an input of its own."""
    density = np.minimum(hits / np.maximum(n_words, 1), 0.2)
    columns = [np.log1p(hits), np.log1p(distinct), 10 * density, (hits == 0) * 1.0, np.minimum(shares[:, 1], 1), np.minimum(shares[:, 2], 1)]
    return np.stack(columns, 1)


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression on soft targets (Newton steps)."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) / len(x) + ridge * w
        hessian = (x.T * np.maximum(p * (1 - p), 1e-4)) @ x / len(x) + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return w



def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = TRAINING_ROWS) -> Model | None:
    """Fits lexicon, label model and classifier; None without both classes."""
    schema = "y int, near long, near2 long, n_words long, units binary, counts binary, shares binary"
    rows = training_rows(docs, labels, label, bound).select("text", "y").mapInArrow(_training_features, schema).toPandas()
    rows = rows.sort_values(["near", "near2", "y", "n_words", "units"])
    rows = rows.drop_duplicates(["near", "y"]).drop_duplicates(["near2", "y"])
    y = rows["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    units = [np.frombuffer(u, "<i4") for u in rows["units"]]
    # the driver holds two small counters a bucket; all else is of the buckets that toxic rows have
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int32)
    for own, side in zip(units, y, strict=True):
        counts[side, own] += 1  # a row has each of its units once
    known = np.flatnonzero(counts[1])
    with_, seen = counts[1, known].astype(np.int64), counts[:, known].sum(0, dtype=np.int64)
    del counts
    share = y.mean()
    rate = np.clip(with_ / np.maximum(seen, 1), 1e-9, 1 - 1e-9)
    evidence = seen * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
    chosen = np.flatnonzero((rate >= LEAST_PRECISION) & (evidence >= LEAST_EVIDENCE))
    lexicon = known[chosen[np.argsort(-evidence[chosen], kind="stable")]]
    place = np.full(1 << BUCKET_BITS, -1, np.int32)
    place[lexicon] = np.arange(len(lexicon))
    present = np.zeros((len(y), len(lexicon)), np.float32)
    hits = np.zeros(len(y))
    for row, (u, times) in enumerate(zip(units, rows["counts"], strict=True)):
        found = place[u]
        present[row, found[found >= 0]] = 1
        hits[row] = np.frombuffer(times, "<i4")[found >= 0].sum()
    n_words = rows["n_words"].to_numpy()
    shares = np.stack([np.frombuffer(s, "<f4") for s in rows["shares"]]).astype(float)
    # distinct entries stand in for distinct words, of which each has a few units
    distinct = present.sum(1)
    votes = np.concatenate([present, pattern_votes(hits, distinct, n_words, shares)], 1)
    start = np.where(distinct >= 3, 0.95, np.where(distinct > 0, 0.6, 0.02))
    q, _ = label_model(votes, start)
    x = np.concatenate([classifier_inputs(hits, distinct, n_words, shares), present, np.ones((len(y), 1))], 1)
    w = logistic(x, q)
    # the intercept that errs least on the training fold's labels; the last cut is
    # above all rows, so that a classifier that found nothing calls nothing toxic
    margin = x @ w
    cuts = np.append(np.unique(np.quantile(margin, np.linspace(0, 1, 400))), margin.max() + 1)
    errors = [np.mean((margin >= c) != (y == 1)) for c in cuts]
    best = np.flatnonzero(np.array(errors) == min(errors))
    low = cuts[best[0]]
    below = margin[margin < low]
    w[-1] -= (low + below.max()) / 2 if len(below) else low
    del rows, units, place, present, votes, x
    release()
    return Model(lexicon.astype(np.int64), w)


def scorer(model: Model | None):
    """A function that scores an Arrow array of texts."""
    place = None

    def score(texts: pa.Array) -> np.ndarray:
        nonlocal place
        if model is None:
            return np.zeros(len(texts))
        if place is None:
            place = np.zeros(1 << BUCKET_BITS, np.int32)
            place[model.lexicon] = np.arange(1, len(model.lexicon) + 1)
        n_entries, scores = len(model.lexicon), [np.zeros(0)]
        general, own, intercept = model.weights[: -n_entries - 1], model.weights[-n_entries - 1 : -1], model.weights[-1]
        for data, offsets in text_chunks(texts):
            n = len(offsets) - 1
            units, at = word_units(data, offsets)
            entry = place[units]
            word, column = np.nonzero(entry * _own(units))
            text = np.searchsorted(at, word, "right") - 1
            pairs = np.unique(text.astype(np.int64) * (n_entries + 1) + entry[word, column])
            owner, which = pairs // (n_entries + 1), pairs % (n_entries + 1) - 1
            distinct = np.bincount(owner, minlength=n).astype(float)
            hits = np.bincount(text, minlength=n).astype(float)
            n_words = np.diff(at)
            margin = classifier_inputs(hits, distinct, n_words, _shares(data, offsets, n_words)) @ general + intercept
            margin += np.bincount(owner, weights=own[which], minlength=n)
            scores.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
        return np.concatenate(scores)

    return score


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of every row."""
    return scored(docs, scorer(model))


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    return filtered(docs, scorer(model), lambda score: score < threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
