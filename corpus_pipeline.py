"""A training corpus from raw documents, in five stages.

Each stage takes what its predecessor kept, written as Parquet and reread:
documents of too low quality go, then toxic ones, then all but one document of
each group of near copies, then those that hold benchmark items; what is left
is packed into windows of token ids.

Every stage but the last returns the columns of its input, whatever their names
beside doc_id and text.  Null ids, null or blank texts and repeated rows are rows
like others unless a stage says otherwise; an empty table gives an empty one, and
without labels of both classes a classifier rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontamination, jaccard_join, packing, quality_mil, toxicity
from paperloom.llm.common import read_table, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose quality scores below 0.3; texts without passages are scored too."""
    return quality_mil.keep_good(docs, quality_mil.fit(docs, read_table(spark, sf_dir, "labels")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that the toxicity classifier scores 0.5 or more."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least id (null ids last).

    Rows without words are no copies and all stay; of rows that repeat in id and
    text, one stays where the text has words.
    """
    return jaccard_join.drop_copies(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold 75 % or more of a benchmark item's shingles; empty items are in none."""
    return decontamination.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids by sequence; a null or blank text is its end id alone."""
    pieces = packing.pack_documents(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_items),
    ("packing", packed),
]

#: Two stages are trained classifiers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
