"""Every registered query of the engine against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

from paperloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return round(float(value), 9)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([names[k] for k in order] and tuple(map(repr, (plain(r[k]) for k in order))) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
