"""Drawn pages of the form, and a reader that reads them.

Text is drawn as small Code 128 symbols, so that a stub can read it back from
the very crops that extraction prepares.
"""

import numpy as np

from paperloom.image import barcodes as B

WIDTH, HEIGHT, LEFT, ROW = 2400, 1800, 100, 60
#: row number, SKU, description, barcode, price, quantity, sum
WIDTHS = [78, 390, 721, 422, 218, 157, 197]
COLOURS = {"ALYJ": "АЛЫЙ", "BELYJ": "БЕЛЫЙ", "BAGROV": "БАГРОВ"}


def edges(widths=WIDTHS):
    return np.cumsum([LEFT, *widths]).tolist()


def write(image, x, y, modules, scale=1, height=24):
    line = np.repeat(np.array([int(m) for m in modules], np.uint8), scale)
    image[y : y + height, x : x + len(line)] = np.where(line, 0, 255)[None, :, None]


def text(image, x, y, value, **how):
    write(image, x, y, B.code128_modules(value), **how)


def page(rows, top, header=None, total=None, total_sum=None, widths=WIDTHS, faded=False, blue=False, no_table=False):
    """``rows``: (barcode, latin sku, quantity); ``header``: (doc id, number, date), any of them None."""
    image = np.full((HEIGHT, WIDTH, 3), 255, np.uint8)
    if header:
        doc_id, number, date = header
        if doc_id:
            text(image, 900, 10, doc_id, scale=2, height=60)
            if faded:
                image[10:70, 1120:1300] = 255
        if number:
            text(image, 1700, 20, number, scale=2, height=40)
        if date:
            text(image, 1500, 100, date, scale=2, height=50)
    if no_table:
        return image
    x, y = edges(widths), [top + ROW * k for k in range(len(rows) + 2)]
    for at in x:
        image[y[0] : y[-1] + 2, at - 1 : at + 2] = 0
    for at in y:
        image[at - 1 : at + 2, x[0] : x[-1] + 2] = 0
    for k, (code, sku, quantity) in enumerate(rows, 1):  # the first band holds the titles
        write(image, x[3] + 30, y[k] + 8, B.code128_modules(code), 2, 44)
        if sku:
            text(image, x[1] + 30, y[k] + 18, sku)
        if quantity is not None:
            text(image, x[5] + 34, y[k] + 18, str(quantity))
        if blue:
            image[y[k] + 10 : y[k] + 40, x[5] + 26 : x[5] + 29] = (30, 40, 200)
    if total is not None or total_sum is not None:
        end = y[-1] + 66
        image[end - 1 : end + 2, x[0] : x[-1] + 2] = 0
        if total is not None:
            text(image, x[5] + 24, y[-1] + 20, str(total))
        if total_sum is not None:
            text(image, x[6] + 24, y[-1] + 20, str(total_sum))
    return image


def read(plane, mode):
    """What an engine would read of a crop."""
    found = [s.text for s in B.symbols(plane) if s.format == "Code128"]
    if mode == "headerBlock":
        return " ".join(sorted((t for t in found if not t.startswith("15-")), key=len)), 80.0  # the number stands before the date
    first = found[0] if found else ""
    if mode == "cyrillic":
        return "-".join(COLOURS.get(part, "Ж") for part in first.split("-")), 70.0
    return first, 90.0
