"""PNG images with their resolution, and PDF files of page images."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .bmp import METRES_PER_INCH

POINTS_PER_INCH = 72


def encode_png(plane: np.ndarray, dpi: int = 300) -> bytes:
    """A grey or RGB image, 8 bits a sample, with its resolution."""
    height, width = plane.shape[:2]
    ppm = round(dpi / METRES_PER_INCH)
    rows = np.concatenate([np.zeros((height, 1), np.uint8), plane.reshape(height, -1)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if plane.ndim == 3 else 0, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", head)
        + chunk(b"pHYs", struct.pack(">IIB", ppm, ppm, 1))
        + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6))
        + chunk(b"IEND", b"")
    )


def _png_parts(data: bytes) -> tuple[int, int, int, float, bytes]:
    """Width, height, samples a pixel, dpi and the packed rows of an 8-bit PNG."""
    at, packed, dpi = 8, b"", float(POINTS_PER_INCH)
    while at < len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, _, colour = struct.unpack_from(">IIBB", body)
        elif kind == b"pHYs":
            dpi = struct.unpack_from(">I", body)[0] * METRES_PER_INCH
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    return width, height, 3 if colour == 2 else 1, dpi, packed


def encode_pdf(pages: list[bytes]) -> bytes:
    """A PDF with one page for each PNG of ``encode_png``, at the size that its resolution tells.

    The packed rows go in as they are: PDF's predictor 15 is PNG's row filter.
    """
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    for data in pages:
        width, height, samples, dpi, packed = _png_parts(data)
        across, down = width * POINTS_PER_INCH / dpi, height * POINTS_PER_INCH / dpi
        draw = f"q {across:.2f} 0 0 {down:.2f} 0 0 cm /I Do Q".encode()
        first = len(objects) + 1
        space = b"/DeviceRGB" if samples == 3 else b"/DeviceGray"
        kids.append(b"%d 0 R" % first)
        objects += [
            b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Resources << /XObject << /I %d 0 R >> >> /Contents %d 0 R >>" % (across, down, first + 1, first + 2),
            b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent 8 /Filter /FlateDecode "
            b"/DecodeParms << /Predictor 15 /Colors %d /BitsPerComponent 8 /Columns %d >> /Length %d >>\nstream\n" % (width, height, space, samples, width, len(packed))
            + packed
            + b"\nendstream",
            b"<< /Length %d >>\nstream\n%s\nendstream" % (len(draw), draw),
        ]
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    out, places = b"%PDF-1.5\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
