import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make(spark):
    """Documents with clashing extra columns from (doc_id, text) pairs."""

    def docs(rows, **extra):
        found = [(i, t, "x", 1) for i, t in rows]
        return spark.createDataFrame(found, "doc_id long, text string, node string, n long").repartition(3)

    return docs


#: Nulls, blanks, a repeated row, a repeated id and a null id.
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (5, "one two"), (None, "a b c d e f g"), (None, None), (6, "word " * 30_000)]
