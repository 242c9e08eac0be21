"""Linear symbols read from scan lines of a crop: Code 128, Code 39, EAN-13, ITF.

A line becomes the widths of its dark and light runs; a symbol is found by
comparing runs with patterns, wherever it begins, in both directions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

# Fixed values (GS1 General Specifications): EAN odd-parity digits, and the first digit's parities.
_L = "0001101 0011001 0010011 0111101 0100011 0110001 0101111 0111011 0110111 0001011".split()
_G = [p.translate(str.maketrans("01", "10"))[::-1] for p in _L]
_R = [p.translate(str.maketrans("01", "10")) for p in _L]
_FIRST = "LLLLLL LLGLGG LLGGLG LLGGGL LGLLGG LGGLLG LGGGLL LGLGLG LGLGGL LGGLGL".split()
# Fixed values (ISO/IEC 15417): run widths of the Code 128 symbols 0 to 105, and of the stop.
_C128 = (
    "212222 222122 222221 121223 121322 131222 122213 122312 132212 221213 221312 231212 112232 122132 122231 113222 123122 123221 "
    "223211 221132 221231 213212 223112 312131 311222 321122 321221 312212 322112 322211 212123 212321 232121 111323 131123 131321 "
    "112313 132113 132311 211313 231113 231311 112133 112331 132131 113123 113321 133121 313121 211331 231131 213113 213311 213131 "
    "311123 311321 331121 312113 312311 332111 314111 221411 431111 111224 111422 121124 121421 141122 141221 112214 112412 122114 "
    "122411 142112 142211 241211 221114 413111 241112 134111 111242 121142 121241 114212 124112 124211 411212 421112 421211 212141 "
    "214121 412121 111143 111341 131141 114113 114311 411113 411311 113141 114131 311141 411131 211412 211214 211232"
).split()
_C128_STOP = "2331112"
# Fixed values (ISO/IEC 16388): the nine runs of each Code 39 character, 1 for wide.
_C39 = dict(
    zip(
        "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-. *$/+%",
        (
            "000110100 100100001 001100001 101100000 000110001 100110000 001110000 000100101 100100100 001100100 100001001 001001001 "
            "101001000 000011001 100011000 001011000 000001101 100001100 001001100 000011100 100000011 001000011 101000010 000010011 "
            "100010010 001010010 000000111 100000110 001000110 000010110 110000001 011000001 111000000 010010001 110010000 011010000 "
            "010000101 110000100 011000100 010010100 010101000 010100010 010001010 000101010"
        ).split(),
        strict=True,
    )
)
# Fixed values (ISO/IEC 16390): the five runs of each ITF digit, 1 for wide.
_ITF = "00110 10001 01001 11000 00101 10100 01100 00011 10010 01010".split()
# Fixed values of the search: least sizes, symbols of a crop, scales in order.
LEAST_WIDTH, LEAST_HEIGHT, MODULES = 24, 8, 95
MOST_SYMBOLS = 4
SCALES = (1, 2, 3, 0.5)
#: A run may differ from its pattern by so many modules, all runs of a character on average by so many.
_RUN_ERROR, _MEAN_ERROR = 0.8, 0.4
_ITF_LEAST_DIGITS = 6

_DIGITS = {("L", p): d for d, p in enumerate(_L)} | {("G", p): d for d, p in enumerate(_G)}
_RIGHT = {p: d for d, p in enumerate(_R)}
_C128_RUNS = np.array([list(map(int, p)) for p in _C128], float)
_C39_CHARS = {p: c for c, p in _C39.items()}
_ITF_DIGITS = {p: str(d) for d, p in enumerate(_ITF)}
_START_A, _START_B, _START_C = 103, 104, 105


class Symbol(NamedTuple):
    text: str
    format: str


def _bars(widths: str) -> str:
    return "".join(("1" if k % 2 == 0 else "0") * int(w) for k, w in enumerate(widths))


def ean13_modules(code: str) -> str:
    """The 95 modules of a 13-digit code, 1 for dark."""
    parity = _FIRST[int(code[0])]
    left = "".join((_L if p == "L" else _G)[int(d)] for p, d in zip(parity, code[1:7], strict=True))
    return "101" + left + "01010" + "".join(_R[int(d)] for d in code[7:]) + "101"


def code128_modules(text: str) -> str:
    """The modules of printable ASCII in set B, or of an even number of digits in set C."""
    if text.isdigit() and len(text) % 2 == 0:
        values = [_START_C, *(int(text[k : k + 2]) for k in range(0, len(text), 2))]
    else:
        values = [_START_B, *(ord(c) - 32 for c in text)]
    check = (values[0] + sum(k * v for k, v in enumerate(values[1:], 1))) % 103
    return "".join(_bars(_C128[v]) for v in [*values, check]) + _bars(_C128_STOP)


def code39_modules(text: str, wide: int = 3) -> str:
    return "0".join(_bars(_C39[c].replace("1", str(wide)).replace("0", "1")) for c in f"*{text}*")


def itf_modules(digits: str, wide: int = 3) -> str:
    pairs = ["".join(a + b for a, b in zip(_ITF[int(x)], _ITF[int(y)], strict=True)) for x, y in zip(digits[::2], digits[1::2], strict=True)]
    return _bars(("0000" + "".join(pairs) + "100").replace("1", str(wide)).replace("0", "1"))


def _runs(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the runs of a line and their beginnings; the first run is dark."""
    edges = np.flatnonzero(np.diff(line, prepend=0, append=0))
    return np.diff(edges), edges[:-1]


def _code128_at(widths: np.ndarray, at: int) -> tuple[str, int] | None:
    """Text and number of runs of the Code 128 symbol that begins at a dark run."""

    def value(k: int) -> int | None:
        six = widths[k : k + 6]
        if len(six) < 6:
            return None
        error = np.abs(six * (11 / six.sum()) - _C128_RUNS)
        best = int(error.sum(1).argmin())
        return best if error[best].max() <= _RUN_ERROR and error[best].mean() <= _MEAN_ERROR else None

    first = value(at)
    if first not in (_START_A, _START_B, _START_C):
        return None
    values, k = [first], at + 6
    stop = np.array(list(map(int, _C128_STOP)), float)
    while True:
        seven = widths[k : k + 7]
        if len(seven) == 7 and np.abs(seven * (13 / seven.sum()) - stop).max() <= _RUN_ERROR:
            break
        found = value(k)
        if found is None or found >= _START_A:
            return None
        values.append(found)
        k += 6
    if len(values) < 3 or (values[0] + sum(n * v for n, v in enumerate(values[1:-1], 1))) % 103 != values[-1]:
        return None
    text = _code128_text(values[:-1])
    return (text, k + 7 - at) if text else None


def _code128_text(values: list[int]) -> str:
    kind, shifted, out = "ABC"[values[0] - _START_A], False, []
    for v in values[1:]:
        now = {"A": "B", "B": "A"}.get(kind, kind) if shifted else kind
        shifted = False
        if now == "C":
            if v < 100:
                out.append(f"{v:02d}")
            kind = {100: "B", 101: "A"}.get(v, kind)
        elif v < 96:
            out.append(chr(v + 32 if now == "B" or v < 64 else v - 64))
        elif v == 98:
            shifted = True
        elif v == 99 or (v == 100 and now == "A") or (v == 101 and now == "B"):
            kind = {99: "C", 100: "B", 101: "A"}[v]
    return "".join(out)


def _wide(runs: np.ndarray, n_wide: int) -> str | None:
    """1 for the widest runs, if they stand apart from the others."""
    order = np.sort(runs)[::-1]
    if len(runs) <= n_wide or order[n_wide - 1] < 1.5 * order[n_wide]:
        return None
    return "".join("1" if w >= order[n_wide - 1] else "0" for w in runs)


def _code39_at(widths: np.ndarray, at: int) -> tuple[str, int] | None:
    out, k = [], at
    while k + 9 <= len(widths):
        char = _C39_CHARS.get(_wide(widths[k : k + 9], 3) or "")
        if char is None or (not out and char != "*"):
            return None
        out.append(char)
        k += 9
        if char == "*" and len(out) > 1:
            return ("".join(out[1:-1]), k - at) if len(out) > 2 else None
        if k < len(widths) and widths[k] > widths[k - 9 : k].max() * 2:
            return None
        k += 1
    return None


def _itf_at(widths: np.ndarray, at: int) -> tuple[str, int] | None:
    start = widths[at : at + 4]
    if len(start) < 4 or start.max() > 2 * start.min() or (at and widths[at - 1] < 6 * start.mean()):
        return None
    out, k = [], at + 4
    while k + 3 <= len(widths):
        end = widths[k : k + 3]
        quiet = k + 3 == len(widths) or widths[k + 3] >= 6 * start.mean()
        if quiet and end[0] >= 1.5 * max(end[1:]):
            return ("".join(out), k + 3 - at) if len(out) >= _ITF_LEAST_DIGITS else None
        ten = widths[k : k + 10]
        if len(ten) < 10:
            return None
        pair = [_ITF_DIGITS.get(_wide(ten[side::2], 2) or "") for side in (0, 1)]
        if None in pair:
            return None
        out += pair
        k += 10
    return None


def _ean13_at(widths: np.ndarray, at: int) -> tuple[str, int] | None:
    runs = widths[at : at + 59]
    if len(runs) < 59 or runs.sum() < MODULES:
        return None
    bounds = np.cumsum(runs)
    centres = (np.arange(MODULES) + 0.5) * bounds[-1] / MODULES
    modules = "".join("10"[k % 2] for k in np.searchsorted(bounds, centres, "right"))
    if modules[:3] != "101" or modules[45:50] != "01010" or modules[92:] != "101":
        return None
    left = [modules[3 + 7 * k : 10 + 7 * k] for k in range(6)]
    parity = "".join("L" if p.count("1") % 2 else "G" for p in left)
    if parity not in _FIRST:
        return None
    digits = [_FIRST.index(parity)] + [_DIGITS.get((s, p)) for s, p in zip(parity, left, strict=True)]
    digits += [_RIGHT.get(modules[50 + 7 * k : 57 + 7 * k]) for k in range(6)]
    return None if None in digits else ("".join(map(str, digits)), 59)


_FORMATS = {"Code128": _code128_at, "Code39": _code39_at, "EAN-13": _ean13_at, "ITF": _itf_at}


def _of_line(line: np.ndarray) -> Iterator[Symbol]:
    """Symbols of a line from left to right; then, if none, from right to left."""
    for direction in (line, line[::-1]):
        widths, _ = _runs(direction)
        at, found = 0, False
        while at < len(widths):
            hits = ((name, read(widths, at)) for name, read in _FORMATS.items())
            name, hit = next(((n, h) for n, h in hits if h is not None), (None, None))
            if hit is None:
                at += 2
                continue
            found = True
            yield Symbol(hit[0], name)
            at += hit[1] + hit[1] % 2
        if found:
            return


def symbols(plane: np.ndarray) -> list[Symbol]:
    """At most ``MOST_SYMBOLS`` symbols of a grey crop, those that most lines agree on first."""
    height, width = plane.shape
    if width < LEAST_WIDTH or height < LEAST_HEIGHT:
        return []
    ink = (plane < (int(plane.min()) + int(plane.max())) / 2).astype(np.int8)
    lines = range(height // 16, height, max(1, min(height // 16, 12)))
    seen = Counter(s for y in lines if ink[y].any() for s in _of_line(ink[y]))
    return [s for s, _ in seen.most_common(MOST_SYMBOLS)]


def decode_ean13(plane: np.ndarray) -> str | None:
    """The EAN-13 code that most of the scan lines of a grey crop agree on."""
    return next((s.text for s in symbols(plane) if s.format == "EAN-13"), None)


def resized(plane: np.ndarray, scale: float) -> np.ndarray:
    """A crop stretched along its lines, linearly between pixel centres; its rows are kept."""
    if scale == 1:
        return plane
    own = plane.shape[1]
    width = max(LEAST_WIDTH, round(own * scale))
    at = np.clip((np.arange(width) + 0.5) * own / width - 0.5, 0, own - 1)
    low = np.minimum(at.astype(int), max(0, own - 2))
    high, share = np.minimum(low + 1, own - 1), at - low
    if scale < 1:  # each pixel from all that it covers
        sums = np.pad(np.cumsum(plane, 1, dtype=float), ((0, 0), (1, 0)))
        ends = np.rint(np.arange(width + 1) * own / width).astype(int)
        return np.rint(np.diff(sums[:, ends], axis=1) / np.maximum(1, np.diff(ends))).astype(np.uint8)
    return np.rint(plane[:, low] * (1 - share) + plane[:, high] * share).astype(np.uint8)


def decode_symbol(plane: np.ndarray, accept: Callable[[str], bool], scales=SCALES) -> Symbol | None:
    """The first accepted symbol over the scales in order."""
    if plane.shape[1] < LEAST_WIDTH or plane.shape[0] < LEAST_HEIGHT:
        return None
    for scale in scales:
        for symbol in symbols(resized(plane, scale)):
            text = symbol.text.strip()
            if text and accept(text):
                return Symbol(text, symbol.format)
    return None


def decode_crop(plane: np.ndarray, accept: Callable[[str], bool], decoder=None, scales=SCALES) -> str | None:
    """The text of the first accepted symbol; ``decoder(plane)`` may stand in for the symbologies here."""
    if decoder is None:
        symbol = decode_symbol(plane, accept, scales)
        return symbol.text if symbol else None
    for scale in scales:
        code = decoder(resized(plane, scale))
        if code is not None and accept(code):
            return code
    return None
