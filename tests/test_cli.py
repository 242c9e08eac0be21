"""Commands end to end on small inputs."""

from paperloom import cli
from paperloom.image import bmp

from . import drawn
from .test_operators import BAR, PAGE, page


def test_pages_and_catalogue(spark, tmp_path, capsys):
    store, run = str(tmp_path / "store"), "r1"
    spark.createDataFrame([(0, "A-B-Я", BAR), (1, "C-D-Я", BAR)], "pos bigint, sku string, barcode string").write.parquet(str(tmp_path / "cat"))
    assert cli.main(["sync-catalogue", str(tmp_path / "cat"), store], spark) == 0
    assert cli.main(["sync-catalogue", str(tmp_path / "none"), store], spark) == 1
    said = capsys.readouterr().out
    assert "1 entries (synced)" in said and "WARNING: 1 conflicting rows" in said and "the old one of 1 entries stays" in said
    spark.createDataFrame([page(0, True, total=3, rows=[(BAR, None, 2)])], PAGE).write.parquet(str(tmp_path / "pages"))
    assert cli.main([str(tmp_path / "pages"), store, run], spark) == 0
    said = capsys.readouterr().out
    assert "15-0000163307  163307  2026-03-05 19:38  1 rows" in said and "error TOTAL_QTY_MISMATCH: 1" in said
    assert f"{BAR}     2  A-B-Я ⚠" in said and "documents: 1" in said


def test_scan_of_a_folder(spark, tmp_path, capsys):
    folder = tmp_path / "landing"
    folder.mkdir()
    store = str(tmp_path / "store")
    assert cli.main(["scan", str(folder), store, "s0"], spark) == 1 and "NO_PAGES" in capsys.readouterr().out
    (folder / "page_000.bmp").write_bytes(bmp.encode_bmp(drawn.page([(BAR, "NOVYGOD-CIF0001-ALYJ", 4)], 600, ("15-0000163307", "163307", "2026-03-05 19:38"), total=4)))
    args = ["scan", str(folder), store, "s1", "--reader", "tests.drawn:read", "--invoices", str(tmp_path / "pdf")]
    assert cli.main(args, spark) == 0
    said = capsys.readouterr().out
    assert "15-0000163307  163307  2026-03-05 19:38  1 rows" in said and "NOVYGOD-CIF0001-АЛЫЙ" in said and "PDF: " in said
    assert len(list((tmp_path / "pdf").rglob("*.pdf"))) == 1


def test_wrong_arguments(capsys):
    assert cli.main(["nonsense"]) == 2 and cli.main(["watch", "x"]) == 2
    capsys.readouterr()
