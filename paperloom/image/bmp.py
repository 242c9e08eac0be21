"""Uncompressed BMP files, which Spark's image source gives without their DPI."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

METRES_PER_INCH = 0.0254


@dataclass
class Bitmap:
    rgb: np.ndarray  # height x width x 3, uint8
    dpi: int | None


def is_bmp(data: bytes) -> bool:
    return data[:2] == b"BM"


def decode_bmp(data: bytes) -> Bitmap:
    """1, 8, 24 or 32 bits a pixel; ValueError for anything else or cut files."""
    if not is_bmp(data) or len(data) < 54:
        raise ValueError("not a BMP file")
    (start,) = struct.unpack_from("<I", data, 10)
    header, width, signed_height, _, bits, method, _, x_ppm, _, n_colours = struct.unpack_from("<IiiHHIIiiI", data, 14)
    if method not in (0, 3):
        raise ValueError("compressed BMP files are not supported")
    if bits not in (1, 8, 24, 32) or width <= 0 or signed_height == 0:
        raise ValueError(f"BMP of {bits} bits is not supported")
    height = abs(signed_height)
    stride = (width * bits + 31) // 32 * 4
    if len(data) < start + stride * height:
        raise ValueError("BMP file is cut off")
    rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
    if signed_height > 0:
        rows = rows[::-1]
    if bits <= 8:
        palette = np.frombuffer(data, np.uint8, 4 * (n_colours or 1 << bits), 14 + header).reshape(-1, 4)
        index = np.unpackbits(rows, axis=1)[:, :width] if bits == 1 else rows[:, :width]
        rgb = palette[index][..., 2::-1]
    else:
        step = bits // 8
        rgb = rows[:, : width * step].reshape(height, width, step)[..., 2::-1]
    return Bitmap(np.ascontiguousarray(rgb), round(x_ppm * METRES_PER_INCH) if x_ppm > 0 else None)


def encode_bmp(rgb: np.ndarray, dpi: int = 300) -> bytes:
    """24 bits a pixel, bottom row first; what tests and scanners write."""
    height, width, _ = rgb.shape
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = rgb[::-1, :, ::-1].reshape(height, -1)
    ppm = round(dpi / METRES_PER_INCH)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, ppm, ppm, 0, 0) + rows.tobytes()
