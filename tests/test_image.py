"""Kernels on drawn pages with known edges."""

import numpy as np
import pytest

from paperloom.image import barcodes, bmp, extract
from paperloom.image import kernels as K

COLUMNS = [60, 95, 210, 470, 690, 760, 830, 940]


def draw(angle=0.0, top=400):
    image = np.full((1400, 1000, 3), 255, np.uint8)
    rows, codes = [top + 60 * k for k in range(9)], []
    for x in COLUMNS:
        image[rows[0] : rows[-1] + 2, x - 1 : x + 2] = 0
    for y in rows:
        image[y - 1 : y + 2, COLUMNS[0] : COLUMNS[-1] + 2] = 0
    for k in range(8):
        codes.append(f"{1000076316479 + 37 * k:013d}")
        modules = np.array([int(c) for c in barcodes.ean13_modules(codes[-1])], np.uint8)
        image[rows[k] + 12 : rows[k] + 48, 485 : 485 + 190] = np.where(np.repeat(modules, 2), 0, 255)[None, :, None]
    return (K.rotate(image, angle) if angle else image), rows, codes


@pytest.mark.parametrize("angle", [0.0, 1.0, -1.5, 2.0])
def test_pages_are_straightened_and_read(angle):
    image, rows, codes = draw(angle)
    record = extract.extract_page(image)
    assert record["skew_deg"] == pytest.approx(angle, abs=0.06)
    assert record["grid_found"] and record["is_header_page"]
    assert np.abs(np.subtract(record["columns"], COLUMNS)).max() <= 2
    assert [r["item_barcode"] for r in record["rows"]] == codes


def test_continuation_and_empty_pages():
    assert not extract.extract_page(draw(top=100)[0])["is_header_page"]
    blank = extract.extract_page(np.full((300, 200, 3), 255, np.uint8))
    assert not blank["grid_found"] and blank["rows"] == []


def test_a_reader_votes_over_variants():
    image, *_ = draw()
    image[420:440, 780:784] = image[420:440, 800:804] = 0
    answers = iter(["1 2", "12", "12"] * 50)
    record = extract.extract_page(image, lambda plane, mode: (next(answers), 90.0))
    assert record["rows"][0]["quantity"] == 12


def test_bmp_round_trip_and_refusals():
    rgb = np.random.default_rng(1).integers(0, 256, (7, 5, 3), np.uint8)
    data = bmp.encode_bmp(rgb, 600)
    back = bmp.decode_bmp(data)
    assert (back.rgb == rgb).all() and back.dpi == 600
    for bad in (b"PNG", data[:-9], data[:30] + b"\x01" + data[31:]):
        with pytest.raises(ValueError):
            bmp.decode_bmp(bad)


def test_otsu_and_skew_of_empty_images():
    assert K.otsu_threshold(np.full((4, 4), 9, np.uint8)) == 127
    two = np.array([[10] * 50 + [200] * 50], np.uint8)
    assert 10 <= K.otsu_threshold(two) < 200


def test_blue_ink_goes_and_black_stays():
    rgb = np.full((20, 20, 3), 255, np.uint8)
    rgb[5, 5], rgb[15, 15] = (20, 20, 200), (0, 0, 0)
    plane = K.remove_blue_ink(rgb)
    assert plane[5, 5] == 255 and plane[15, 15] == 0


def test_repair_splits_only_balanced_bands():
    profile = np.zeros(400)
    profile[[0, 50, 100, 150, 250, 300]] = 0.6
    profile[200] = 0.35
    assert K.repair_rows([0, 50, 100, 150, 250, 300], profile, 0.6) == [0, 50, 100, 150, 200, 250, 300]
    profile[200], profile[170] = 0, 0.35
    assert K.repair_rows([0, 50, 100, 150, 250, 300], profile, 0.6) == [0, 50, 100, 150, 250, 300]


def test_upper_median_and_similarity():
    assert K.upper_median([4, 1, 3, 2]) == 3
    assert K.similarity([10, 20, 30], [12, 29], 2) == pytest.approx(2 / 3)
    assert K.merge_peaks(np.array([1, 2, 9]), np.array([0, 5, 7, 0, 0, 0, 0, 0, 0, 1]), 3) == [2, 9]


def test_extract_stage(spark):
    files = spark.createDataFrame([("a.bmp", bytearray(bmp.encode_bmp(draw()[0]))), ("b.txt", bytearray(b"x"))], "path string, content binary")
    got = {r.path: r for r in extract.extract_pages(files).collect()}
    assert len(got["a.bmp"].rows) == 8 and not got["b.txt"].grid_found


def test_files_that_are_not_read_say_so(spark):
    png = bytearray(b"\x89PNG\r\n\x1a\n")
    files = spark.createDataFrame([("a.bmp", bytearray(bmp.encode_bmp(draw()[0]))), ("b.png", png)], "path string, content binary")
    got = {r.path: r.error for r in extract.extract_pages(files).collect()}
    assert got == {"a.bmp": None, "b.png": "not a BMP image"}
