"""The pipeline against its stages by hand, in brute force but for the classifiers' scores."""

import random
from collections import Counter

import corpus_pipeline
from paperloom.llm import quality_mil, toxicity
from paperloom.llm.common import read_table

from .conftest import EDGES
from .test_operators import brute_components, check_packing, near_copies, prose, shingles


def without_copies(rows):
    """The rows ``(doc_id, text)`` that the third stage keeps; ids repeat only with their texts."""
    rows_of = {}
    for row in rows:
        rows_of.setdefault(row[0] if row[0] is not None else row, []).append(row)
    found = brute_components(rows)
    kept = [row for row in rows if not shingles(row[1])]
    kept += [rows_of[i][0] for i, n, comp in found if n and i is not None and i == comp]
    return kept + [row for row in dict.fromkeys(rows) if row[0] is None and shingles(row[1])]


def without_leaks(rows, items):
    own = [o for o in map(shingles, items) if o]
    return [row for row in rows if not any(100 * len(o & shingles(row[1])) >= 75 * len(o) for o in own)]


def write(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    rng = random.Random(21)
    items = [(k, " ".join(prose(rng, 20))) for k in range(4)] + [(8, None), (9, " ")]
    rows = near_copies(6, groups=6) + EDGES[:-1]
    rows += [(5000 + k, " ".join(prose(rng, 60)) + f" {text} " + " ".join(prose(rng, 40))) for k, text in items[:4]]
    names = "doc_id long, text string, _text_hash string, node long, score double, `odd.name` int"
    docs = spark.createDataFrame([(*row, "x", 1, 0.5, None) for row in rows], names).repartition(3)
    folder = write(spark, tmp_path, docs, [], items)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.names == docs.columns
    pieces = corpus_pipeline.run(spark, folder).collect()
    want = without_leaks(without_copies(rows), [t for _, t in items])
    assert not any(i is not None and i >= 5000 for i, _ in want) and len(want) < len(rows)
    check_packing(want, pieces, 2048)
    assert Counter({r.doc_id for r in pieces}) == Counter({i for i, _ in want})


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert corpus_pipeline.run(spark, write(spark, tmp_path, docs, [(1, 0, 1)], [])).count() == 0


def test_pipeline_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = read_table(spark, folder, "documents")
    labels = read_table(spark, folder, "labels")
    good = quality_mil.keep_good(docs, quality_mil.fit(docs, labels))
    clean = toxicity.drop_toxic(good, toxicity.fit(good, labels))
    rows = [(r.doc_id, r.text) for r in clean.select("doc_id", "text").collect()]
    assert 0 < len(rows) < docs.count()
    want = without_leaks(without_copies(rows), [r.text for r in read_table(spark, folder, "benchmark").collect()])
    pieces = corpus_pipeline.run(spark, folder).collect()
    check_packing(want, pieces, 2048)
    assert {r.doc_id for r in pieces} == {i for i, _ in want}
