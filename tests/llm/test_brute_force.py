"""Scores and choices recomputed one text, word or tree at a time in plain Python."""

import math
import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import html_extraction, quality_mil, toxicity
from paperloom.llm import shingle_kernel as K
from paperloom.llm.dom import parse

MASK = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def polynomial(word):
    """A word's sum over its bytes, letters folded."""
    return sum(((b + 32 if 65 <= b <= 90 else b) + 1) * pow(K._BASE, k, 1 << 64) for k, b in enumerate(word)) & MASK


def split(data, inside):
    words, word = [], b""
    for byte in data:
        if inside(byte):
            word += bytes([byte])
        elif word:
            words.append(word)
            word = b""
    return words + ([word] if word else [])


def texts(rng, n=60):
    pool = ["Alpha", "beta", "gammaray", "DELTA", "epsilonic", "zéta", "eta", "theta9", "iotas!", "kap$pa", "x", "alphabet", "Alphas"]
    out = [" ".join(rng.choice(pool) + rng.choice(["", "", ".", "!", ",", "\n", " |"]) for _ in range(rng.randint(0, 150))) for _ in range(n)]
    return [*out, None, "", " \n", "!", "alpha " * 3000, "é" * 5000]


def toxicity_by_hand(text, model):
    data = (text or "").encode()
    places = {int(b): k for k, b in enumerate(model.lexicon)}
    words = split(data, lambda b: bool(toxicity._WORD[b]))
    hits, found = 0, set()
    for word in words:
        whole = mix(polynomial(word)) >> (64 - toxicity.BUCKET_BITS)
        units = [whole]
        for length in toxicity.PREFIXES:
            unit = mix((polynomial(word[:length]) + length) & MASK) >> (64 - toxicity.BUCKET_BITS)
            if len(word) > length and unit != whole:
                units.append(unit)
        for unit in units:
            if unit in places:
                hits += 1
                found.add(places[unit])
    n = len(words)
    upper = sum(65 <= b <= 90 for b in data) / max(len(data), 1)
    shouts, marks = data.count(b"!") / max(n, 1), sum(chr(b) in "#*$%&|<>" for b in data) / max(n, 1)
    assert upper >= 0
    inputs = [math.log1p(hits), math.log1p(len(found)), 10 * min(hits / max(n, 1), 0.2), float(hits == 0), min(shouts, 1), min(marks, 1)]
    margin = sum(a * b for a, b in zip(inputs, model.weights, strict=False)) + sum(model.weights[6 + k] for k in found) + model.weights[-1]
    return 1 / (1 + math.exp(-min(30, max(-30, margin))))


@pytest.mark.parametrize("n_entries", [0, 3, 700])
def test_toxicity_scores(n_entries):
    rng = random.Random(n_entries)
    known = [b"alpha", b"Gammaray", b"epsilonic"]
    buckets = [mix(polynomial(w)) >> (64 - toxicity.BUCKET_BITS) for w in known][:n_entries]
    buckets += [mix((polynomial(b"epsi") + 4) & MASK) >> (64 - toxicity.BUCKET_BITS)] * (n_entries > 3)
    while len(buckets) < n_entries:  # more entries than any earlier bound held
        bucket = rng.randrange(1 << toxicity.BUCKET_BITS)
        if bucket not in buckets:
            buckets.append(bucket)
    model = toxicity.Model(np.array(buckets, np.int64), np.array([rng.gauss(0, 1) for _ in range(6 + n_entries + 1)]))
    rows = texts(rng)
    got = toxicity.scorer(model)(pa.array(rows, pa.large_string()))
    assert got == pytest.approx([toxicity_by_hand(t, model) for t in rows], abs=1e-9)


def measures_by_hand(text):
    """The measures of each passage of a text."""
    data = (text or "").encode()
    space = lambda b: b == 32 or 9 <= b <= 13
    begins = [k for k, b in enumerate(data) if not space(b) and (k == 0 or space(data[k - 1]))]
    words = [w.lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in split(data, lambda b: not space(b))]
    runs = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    size = quality_mil.PASSAGE_WORDS
    out = []
    for low in range(0, max(1, len(words)), size):
        own = words[low : low + size]
        begin = begins[low] if low else 0
        end = begins[low + size] if low + size < len(words) else len(data)
        n = max(1, len(own))
        row = [sum(bool(t[b]) for b in data[begin:end]) / n for t in quality_mil._CLASSES]
        same = sum(k > 0 and words[k] == words[k - 1] for k in range(low, low + len(own)))
        twice = sum(runs.count(runs[k]) > 1 for k in range(low, min(low + len(own), len(runs))))
        row += [math.log1p(len(own)), (end - begin) / n, same / n, len(set(own)) / n if own else 1.0, twice / n]
        out.append([*row, math.log1p(len(words))])
    return out


def quality_by_hand(text, model):
    p = model.p
    bag = []
    for row in measures_by_hand(text):
        x = [min(6, max(-6, (v - m) / s)) for v, m, s in zip(row, model.mean, model.spread, strict=True)]
        h = [math.tanh(sum(a * w for a, w in zip(x, p["W"][:, k], strict=True)) + p["b"][k]) for k in range(quality_mil.HIDDEN)]
        e = 0.0
        for g in range(quality_mil.GATES):
            t = math.tanh(sum(a * w for a, w in zip(h, p["V"][:, g], strict=True)))
            s = 1 / (1 + math.exp(-sum(a * w for a, w in zip(h, p["U"][:, g], strict=True))))
            e += t * s * p["w"][g]
        bag.append((e, h))
    total = sum(math.exp(e) for e, _ in bag)
    z = [sum(math.exp(e) / total * h[k] for e, h in bag) for k in range(quality_mil.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["d"][0])))


def test_quality_scores():
    rng = random.Random(9)
    model = quality_mil.GatedAttention(quality_mil.N_MEASURES, seed=4)
    model.mean, model.spread = np.full(quality_mil.N_MEASURES, 0.3), np.full(quality_mil.N_MEASURES, 0.8)
    rows = texts(rng, 40)
    got = quality_mil.scorer(model)(pa.array(rows, pa.large_string()))
    assert got == pytest.approx([quality_by_hand(t, model) for t in rows], abs=1e-9)


def test_quality_of_blank_texts_does_not_depend_on_their_neighbours():
    model = quality_mil.GatedAttention(quality_mil.N_MEASURES, seed=4)
    alone = [quality_mil.scorer(model)(pa.array([t], pa.large_string()))[0] for t in ("", " \n", None)]
    beside = quality_mil.scorer(model)(pa.array(["", " \n", None, "some words"], pa.large_string()))[:3]
    by_hand = [quality_by_hand(t, model) for t in ("", " \n", None)]
    assert alone == pytest.approx(by_hand) and list(beside) == pytest.approx(by_hand)


def test_decoding_finds_the_likeliest_choice():
    rng = np.random.default_rng(3)
    for html in ("<div><p>a</p><p>b<b>c</b></p></div><i>d</i>", "<ul><li>a<li>b<ul><li>c</ul></ul>", "<p>x", "", "<a><b><i><u><s>deep</s></u></i></b></a>"):
        page = parse(html)
        n = len(page.nodes)
        for _ in range(40):
            margin = rng.normal(size=n) * 2
            inside, outside = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)

            def likelihood(chosen):
                return sum(inside[k] if c else outside[k] for k, c in enumerate(chosen))

            allowed = [c for c in product([False, True], repeat=n) if all(not c[k] or page.nodes[k].parent < 0 or c[page.nodes[k].parent] for k in range(n))]
            best = max(map(likelihood, allowed))
            assert likelihood(html_extraction.decode(page, margin)) == pytest.approx(best)
