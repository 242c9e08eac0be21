"""Symbols encoded, drawn with noise and at odd scales, and read back."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.image import barcodes as B

DOC_ID = re.compile(r"[0-9]{2}-[0-9]{10}")


def drawn(modules, scale=2.0, height=40, quiet=12, noise=0.0, seed=0):
    """A grey crop with a symbol; edges fall between pixels where the scale is odd."""
    line = np.repeat(np.array([0] * quiet + [int(m) for m in modules] + [0] * quiet, float), 60)
    width = round(len(line) * scale / 60)
    ends = np.rint(np.linspace(0, len(line), width + 1)).astype(int)
    ink = np.add.reduceat(line, ends[:-1]) / np.diff(ends)
    plane = np.tile(255 * (1 - ink), (height, 1))
    plane += np.random.default_rng(seed).normal(0, noise, plane.shape)
    return np.clip(plane, 0, 255).astype(np.uint8)


CASES = [
    ("Code128", "15-0000163307", B.code128_modules),
    ("Code128", "1000076316479", B.code128_modules),
    ("Code128", "100007631647", B.code128_modules),
    ("Code39", "15-0000163307", B.code39_modules),
    ("EAN-13", "1000076316479", B.ean13_modules),
    ("ITF", "15000016330712", B.itf_modules),
]


@pytest.mark.parametrize("scale", [1.0, 1.6, 2.0, 2.7, 5.0])
@pytest.mark.parametrize(("kind", "text", "encode"), CASES)
def test_symbols_are_read_at_any_scale(kind, text, encode, scale):
    for plane in (drawn(encode(text), scale), drawn(encode(text), scale)[:, ::-1]):
        assert B.decode_symbol(np.ascontiguousarray(plane), lambda t: t == text) == (text, kind)


@pytest.mark.parametrize(("kind", "text", "encode"), CASES)
def test_symbols_are_read_through_noise(kind, text, encode):
    plane = drawn(encode(text), 3.0, height=60, noise=25.0)
    plane[25:32] = 255  # a streak through the bars
    assert B.decode_symbol(plane, lambda t: True) == (text, kind)


@settings(max_examples=60, deadline=None)
@given(st.text([chr(c) for c in range(32, 127)], min_size=1, max_size=20).filter(lambda t: t.strip() == t))
def test_code128_round_trip(text):
    assert [s.text for s in B.symbols(drawn(B.code128_modules(text)))] == [text]


def test_code128_sets_and_shifts():
    values = [B._START_A, 33, 98, 65, 99, 12, 100, 66, 101, 33]  # A, shifted a, then 12 in C, b in B, A in A
    check = (values[0] + sum(k * v for k, v in enumerate(values[1:], 1))) % 103
    modules = "".join(B._bars(B._C128[v]) for v in [*values, check]) + B._bars(B._C128_STOP)
    assert B.symbols(drawn(modules))[0].text == "Aa12bA"


def test_a_wrong_checksum_is_refused():
    good = B.code128_modules("15-0000163307")
    bad = good[:33] + B._bars(B._C128[20]) + good[44:]
    assert B.symbols(drawn(bad)) == []


def test_patterns_are_consistent():
    assert len(set(B._C128)) == 106 and all(sum(map(int, p)) == 11 and sum(map(int, p[::2])) % 2 == 0 for p in B._C128)
    assert len(B._C39) == 44 == len(set(B._C39.values())) and all(p.count("1") == 3 for p in B._C39.values())
    assert all(p.count("1") == 2 for p in B._ITF) and len(set(B._ITF)) == 10


def test_the_accepted_one_of_several_symbols():
    plane = np.hstack([drawn(m, quiet=15) for m in (B.ean13_modules("1000076316479"), B.code128_modules("15-0000163307"), B.code39_modules("ABC"))])
    assert {s.text for s in B.symbols(plane)} == {"1000076316479", "15-0000163307", "ABC"}
    assert B.decode_crop(plane, lambda t: bool(DOC_ID.fullmatch(t))) == "15-0000163307"
    assert B.decode_crop(plane, lambda t: t == "none") is None


def test_crops_without_symbols():
    rng = np.random.default_rng(3)
    assert B.symbols(np.full((30, 200), 255, np.uint8)) == [] == B.symbols(np.zeros((30, 200), np.uint8))
    assert B.decode_crop(np.zeros((7, 200), np.uint8), lambda t: True) is None
    assert B.decode_crop(np.zeros((30, 20), np.uint8), lambda t: True) is None
    found = [s for k in range(20) for s in B.symbols(rng.integers(0, 256, (40, 400)).astype(np.uint8))]
    assert [s for s in found if s.format != "ITF" and len(s.text) > 3] == []
