"""Pixel kernels of one page, vectorised with numpy.

Images are height x width arrays; ink is 1 in binary images.  The constants are
those of the measured scans and are kept together under FIXED.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class FIXED:
    """Thresholds measured on scanned forms."""

    SKEW_LIMIT, SKEW_COARSE, SKEW_FINE = 2.5, 0.25, 0.05
    ROTATE_FROM = 0.06
    WORK_WIDTH, SKEW_WIDTH = 2481, 760
    LINE_SHARE, LINE_PROMINENCE = 0.45, 0.12
    COLUMN_FILL, COLUMN_INSET, EDGE_ZONE, EDGE_NEED = 0.85, 0.15, 0.12, 0.5
    LEAST_EDGES, LEAST_SIMILARITY, SEEN_SHARE = 6, 0.75, 0.5
    TALL, SPLIT_PEAK, SPLIT_LOW, SPLIT_HIGH = 1.6, 0.5, 0.7, 1.35
    BLUE, BLUE_GROW, PALE = 18, 2, 150
    CELL_LINE_SHARE, CELL_LINE_DARK, BOX_DARK, BOX_LEAST = 0.55, 160, 128, 2


def grey(rgb: np.ndarray) -> np.ndarray:
    """BT.601 luma, rounded."""
    return np.rint(rgb[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def otsu_threshold(plane: np.ndarray) -> int:
    """The level of greatest between-class variance; the first of equals."""
    n = np.bincount(plane.ravel(), minlength=256).astype(float)
    below, mass = n.cumsum(), (n * np.arange(256)).cumsum()
    above = below[-1] - below
    ok = (below > 0) & (above > 0)
    if not ok.any():
        return 127
    apart = mass[ok] / below[ok] - (mass[-1] - mass[ok]) / above[ok]
    return int(np.flatnonzero(ok)[np.argmax(below[ok] * above[ok] * apart**2)])


def binarize(plane: np.ndarray, threshold: int) -> np.ndarray:
    return (plane <= threshold).astype(np.uint8)


def _sheared_rows(ink: np.ndarray, degrees: float, step: int = 1) -> np.ndarray:
    """Ink per row after columns move down by round(x tan a)."""
    height, width = ink.shape
    x = np.arange(0, width, step)
    down = np.rint(x * np.tan(np.radians(degrees))).astype(int)
    total = np.zeros(height)
    for shift in np.unique(down):
        rows = ink[:, x[down == shift]].sum(1)
        low, high = max(0, -shift), min(height, height - shift)
        total[low:high] += rows[low + shift : high + shift]
    return total


def estimate_skew(ink: np.ndarray) -> float:
    """Degrees whose shear concentrates ink in rows most; 3 decimals."""

    def best(angles: np.ndarray) -> float:
        scores = [float((_sheared_rows(ink, a) ** 2).sum()) for a in angles]
        return float(angles[int(np.argmax(scores))])

    f = FIXED
    coarse = best(np.arange(-f.SKEW_LIMIT, f.SKEW_LIMIT + 1e-9, f.SKEW_COARSE))
    return round(best(coarse + np.arange(-f.SKEW_COARSE, f.SKEW_COARSE + 1e-9, f.SKEW_FINE)), 3)


def resize_width(plane: np.ndarray, width: int) -> np.ndarray:
    """Nearest sampling to a width, never wider than the image."""
    height, own = plane.shape[:2]
    if own <= width:
        return plane
    x = (np.arange(width) + 0.5) * own / width
    y = (np.arange(max(1, round(height * width / own))) + 0.5) * own / width
    return plane[np.minimum(y.astype(int), height - 1)][:, x.astype(int)]


def rotate(plane: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """About the centre, nearest sampling; positive turns content clockwise."""
    height, width = plane.shape[:2]
    a = np.radians(degrees)
    y, x = np.mgrid[:height, :width].astype(np.float32)
    y -= (height - 1) / 2
    x -= (width - 1) / 2
    from_x = np.rint(np.cos(a) * x + np.sin(a) * y + (width - 1) / 2).astype(int)
    from_y = np.rint(-np.sin(a) * x + np.cos(a) * y + (height - 1) / 2).astype(int)
    inside = (from_x >= 0) & (from_x < width) & (from_y >= 0) & (from_y < height)
    out = np.full_like(plane, fill)
    out[inside] = plane[from_y[inside], from_x[inside]]
    return out


@dataclass
class Prepared:
    rgb: np.ndarray
    plane: np.ndarray
    ink: np.ndarray
    skew: float
    threshold: int


def prepare_page(rgb: np.ndarray) -> Prepared:
    """Deskewed page with its working-size grey and binary planes."""
    small = resize_width(grey(rgb), FIXED.SKEW_WIDTH)
    skew = estimate_skew(binarize(small, otsu_threshold(small)))
    if abs(skew) >= FIXED.ROTATE_FROM:
        rgb = rotate(rgb, -skew)
    plane = resize_width(grey(rgb), FIXED.WORK_WIDTH)
    threshold = otsu_threshold(plane)
    return Prepared(rgb, plane, binarize(plane, threshold), skew, threshold)


def row_profile(ink: np.ndarray) -> np.ndarray:
    """Share of dark pixels per row, the greatest over small shears."""
    width = len(range(0, ink.shape[1], 2))
    return np.max([_sheared_rows(ink, a, 2) / width for a in (-0.5, -0.25, 0.0, 0.25, 0.5)], axis=0)


def merge_peaks(places: np.ndarray, weights: np.ndarray, gap: int) -> list[int]:
    """The heaviest place of each cluster with steps of at most ``gap``."""
    if not len(places):
        return []
    return [int(c[np.argmax(weights[c])]) for c in np.split(places, np.flatnonzero(np.diff(places) > gap) + 1)]


def horizontal_lines(profile: np.ndarray) -> list[int]:
    """Rows dark enough, and darker than what lies a little above and below."""
    height = len(profile)
    near = max(4, int(0.0025 * height))
    found = []
    for y in np.flatnonzero(profile >= FIXED.LINE_SHARE):
        around = np.concatenate([profile[max(0, y - 4 * near) : max(0, y - near)], profile[y + near : y + 4 * near]])
        if not len(around) or profile[y] - around.mean() >= FIXED.LINE_PROMINENCE:
            found.append(y)
    return merge_peaks(np.array(found, int), profile, max(3, int(0.002 * height)))


def vertical_lines(ink: np.ndarray, top: int, bottom: int) -> list[int]:
    """Columns that fill a band and reach both of its edges.

    Bars of a barcode fill the middle but stop short of the edges.
    """
    height = bottom - top
    inset, zone = int(height * FIXED.COLUMN_INSET), max(1, int(height * FIXED.EDGE_ZONE))
    inner = ink[top + inset : bottom - inset]
    if not len(inner):
        return []
    full = inner.mean(0) >= FIXED.COLUMN_FILL
    full &= ink[top : top + zone].mean(0) >= FIXED.EDGE_NEED
    full &= ink[bottom - zone : bottom].mean(0) >= FIXED.EDGE_NEED
    x = np.flatnonzero(full)
    if not len(x):
        return []
    return [int((c[0] + c[-1]) // 2) for c in np.split(x, np.flatnonzero(np.diff(x) > 3) + 1)]


def full_height_columns(ink: np.ndarray) -> list[int]:
    """Dark columns along the whole page near its sides: the scanner's shadow."""
    height, width = ink.shape
    side, drift = int(width * 0.055), max(1, int(width * 0.008))
    segments = [s for s in np.array_split(ink, 40) if len(s)]
    dark = np.stack([s.mean(0) >= 0.85 for s in segments])
    grown = dark.copy()
    for shift in range(1, drift + 1):
        grown[:, shift:] |= dark[:, :-shift]
        grown[:, :-shift] |= dark[:, shift:]
    x = np.flatnonzero(grown.mean(0) >= 0.9)
    return x[(x < side) | (x >= width - side)].tolist()


def similarity(a: list[int], b: list[int], tolerance: float) -> float:
    if not a or not b:
        return 0.0
    near = (np.abs(np.subtract.outer(a, b)) <= tolerance).any(1).sum()
    return float(near) / max(len(a), len(b))


def upper_median(values) -> float:
    return sorted(values)[len(values) // 2]


def cluster_medians(values: list[int], tolerance: float) -> list[tuple[float, int]]:
    """(upper median, size) of clusters with steps of at most the tolerance."""
    ordered = np.sort(values)
    groups = np.split(ordered, np.flatnonzero(np.diff(ordered) > tolerance) + 1) if len(ordered) else []
    return [(upper_median(g.tolist()), len(g)) for g in groups]


@dataclass
class Grid:
    rows: list[int]
    columns: list[int]


def detect_table(ink: np.ndarray) -> Grid | None:
    """The longest run of bands between lines that share their columns."""
    height, width = ink.shape
    profile = row_profile(ink)
    lines = horizontal_lines(profile)
    if len(lines) < 3:
        return None
    shadow, margin = full_height_columns(ink), round(width * 0.02)
    spare, tolerance = max(6, round(width * 0.008)), max(6, round(width * 0.005))
    bands = []
    for top, bottom in zip(lines, lines[1:], strict=False):
        if bottom - top < max(8, round(height * 0.006)):
            continue
        edges = [x for x in vertical_lines(ink, top, bottom) if margin <= x <= width - margin and all(abs(x - s) > spare for s in shadow)]
        bands.append((top, bottom, edges))
    runs, current = [], []
    for band in bands:
        usable = len(band[2]) >= FIXED.LEAST_EDGES
        joins = usable and current and similarity(current[-1][2], band[2], tolerance) >= FIXED.LEAST_SIMILARITY
        if not joins:
            runs.append(current)
            current = []
        if usable:
            current.append(band)
    runs.append(current)
    table = max(runs, key=len)
    if len(table) < 2:
        return None
    seen = [x for band in table for x in band[2]]
    columns = [int(m) for m, n in cluster_medians(seen, tolerance) if n >= FIXED.SEEN_SHARE * len(table)]
    rows = [table[0][0], *(band[1] for band in table)]
    usual = upper_median([profile[y] for y in rows])
    return Grid(repair_rows(rows, profile, usual), columns)


def repair_rows(rows: list[int], profile: np.ndarray, usual: float) -> list[int]:
    """Splits bands that hide a faint line, where both halves look like rows."""
    if len(rows) < 3:
        return rows
    median = upper_median(np.diff(rows).tolist())
    out = [rows[0]]
    for top, bottom in zip(rows, rows[1:], strict=False):
        tall = bottom - top
        if median >= 8 and tall >= FIXED.TALL * median:
            inset = round(tall * 0.2)
            y = np.arange(top + inset, bottom - inset)
            y = y[(y > 0) & (y < len(profile) - 1)]
            peak = (profile[y] >= profile[y - 1]) & (profile[y] >= profile[y + 1]) & (profile[y] >= FIXED.SPLIT_PEAK * usual)
            for half in (y - top, bottom - y):
                peak &= (half >= FIXED.SPLIT_LOW * median) & (half <= FIXED.SPLIT_HIGH * median)
            y = y[peak]
            if len(y):  # the last of equal peaks
                out.append(int(y[len(y) - 1 - np.argmax(profile[y][::-1])]))
        out.append(bottom)
    return out


def dilate(mask: np.ndarray, by: int) -> np.ndarray:
    """Grows a mask by a square; rows and columns apart."""
    for axis in (0, 1):
        grown = mask.copy()
        for shift in range(1, by + 1):
            ahead, back = [slice(None)] * 2, [slice(None)] * 2
            ahead[axis], back[axis] = slice(shift, None), slice(None, -shift)
            grown[tuple(ahead)] |= mask[tuple(back)]
            grown[tuple(back)] |= mask[tuple(ahead)]
        mask = grown
    return mask


def remove_blue_ink(rgb: np.ndarray) -> np.ndarray:
    """Grey plane without blue pen strokes and pale shades."""
    wide = rgb.astype(np.int16)
    blue = wide[..., 2] - np.maximum(wide[..., 0], wide[..., 1]) > FIXED.BLUE
    plane = grey(rgb)
    plane[dilate(blue, FIXED.BLUE_GROW) | (plane > FIXED.PALE)] = 255
    return plane


def suppress_lines(plane: np.ndarray) -> np.ndarray:
    """White where whole rows or columns of a cell are dark."""
    dark = plane < FIXED.CELL_LINE_DARK
    out = plane.copy()
    out[dark.mean(1) >= FIXED.CELL_LINE_SHARE] = 255
    out[:, dark.mean(0) >= FIXED.CELL_LINE_SHARE] = 255
    return out


def content_box(plane: np.ndarray) -> tuple[int, int, int, int] | None:
    """x, y, width, height around rows and columns with dark pixels; or None."""
    dark = plane < FIXED.BOX_DARK
    y, x = (np.flatnonzero(dark.sum(axis) >= FIXED.BOX_LEAST) for axis in (1, 0))
    if not len(x) or not len(y):
        return None
    return int(x[0]), int(y[0]), int(x[-1] - x[0] + 1), int(y[-1] - y[0] + 1)


def prepare_for_reading(plane: np.ndarray, height: int = 60, threshold: int | None = 170, margin: int = 20) -> np.ndarray | None:
    """A cell's content, scaled up to a height and framed; None if empty."""
    plain = suppress_lines(plane)
    box = content_box(plain)
    if box is None:
        return None
    x, y, w, h = box
    cut = plain[max(0, y - 4) : y + h + 4, max(0, x - 4) : x + w + 4]
    scale = int(np.clip(round(height / cut.shape[0]), 1, 4))
    cut = np.kron(cut, np.ones((scale, scale), np.uint8))
    cut = normalized(cut)
    if threshold is not None:
        cut = np.where(cut > threshold, 255, 0).astype(np.uint8)
    return np.pad(cut, margin, constant_values=255)


def normalized(plane: np.ndarray) -> np.ndarray:
    """The plane's darkest level at 0 and its lightest at 255."""
    low, high = int(plane.min()), int(plane.max())
    return ((plane.astype(int) - low) * 255 // (high - low)).astype(np.uint8) if high > low else plane


def binary_plane(plane: np.ndarray, threshold: int) -> np.ndarray:
    """White from the threshold on, else black."""
    return np.where(plane >= threshold, 255, 0).astype(np.uint8)
