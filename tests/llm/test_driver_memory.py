"""What fitting holds on the driver."""

import random
import tracemalloc

from paperloom.llm import toxicity


def test_fitting_the_lexicon_holds_few_arrays_of_its_buckets(spark):
    rng = random.Random(1)
    words = [f"word{k}" for k in range(300)]
    rows = [(k, " ".join([*rng.choices(words, k=40), *(["vile", "nasty"] if k % 3 == 0 else [])])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    toxicity.fit(docs, labels)
    tracemalloc.start()
    model = toxicity.fit(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.lexicon) >= 2 and peak < 20 * (1 << toxicity.BUCKET_BITS)
