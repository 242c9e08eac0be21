"""Each operator against brute force on small fixtures, and on edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import (
    decontamination,
    html_extraction,
    jaccard_join,
    license_scan,
    packing,
    quality_mil,
    quality_rules,
    sharding,
    shingle_kernel,
    token_files,
    token_kernel,
    toxicity,
)
from paperloom.llm.common import scratch
from paperloom.llm.graph import components
from paperloom.llm.license_templates import TEMPLATES

from .conftest import EDGES

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in SPACE.split(low) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(seed=3, groups=12):
    """Groups of near copies, shared passages, copies and loners."""
    rng = random.Random(seed)
    passage, rows = prose(rng, 40), []
    for _ in range(groups):
        base = prose(rng, rng.choice([6, 30, 200, 700]))
        rows.append(base)
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append(copy)
    rows += [passage + prose(rng, 50) for _ in range(25)]
    rows += [["same"] * 7] * 5
    rng.shuffle(rows)
    return [(10 * k + 7, " ".join(r)) for k, r in enumerate(rows)]


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        r = root(k)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return Counter((d, len(s), least.get(root(k))) for k, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("block", [1024, 20])
def test_jaccard_join_equals_brute_force(make, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", block)
    rows = near_copies()
    got = jaccard_join.link_documents(make(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_components(rows)


def test_exact_stage_finds_all_links_without_star_rounds(make, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_MASKS", np.zeros(4, np.uint64))
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 1)
    rows = near_copies(5)
    got = jaccard_join.link_documents(make(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_components(rows)


def trees_of(monkeypatch, docs):
    """Rows of the trees and of each turn's part of them, and the result."""
    seen, put = [], jaccard_join.Shelf.put

    def counted(shelf, df, label):
        table = put(shelf, df, label)
        seen.append((label, table.count() if label in ("jaccard-trees", "jaccard-met") else 0))
        return table

    monkeypatch.setattr(jaccard_join.Shelf, "put", counted)
    got = jaccard_join.link_documents(docs).select("doc_id", "n_shingles", "component_id").collect()
    return [[n for label, n in seen if label == want] for want in ("jaccard-trees", "jaccard-met")], Counter(map(tuple, got))


def test_documents_that_share_a_passage_are_in_no_tree(make, monkeypatch):
    rng = random.Random(8)
    texts = []
    for _ in range(20):  # two documents each, so the passage counts as rare
        passage = prose(rng, 30)
        texts += [prose(rng, 140) + passage + prose(rng, 140) for _ in range(2)]
    for _ in range(5):
        base = prose(rng, 300)
        texts += [base, base[:-9] + prose(rng, 9)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    ((trees,), _), got = trees_of(monkeypatch, make(rows))
    assert got == brute_components(rows)
    assert trees == 10  # the near copies


def test_prefixes_are_dealt_in_parts(make, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART_SHINGLES", 100)
    rows = near_copies(3)
    (_, met), got = trees_of(monkeypatch, make(rows))
    assert got == brute_components(rows)
    # one for each part, the frequent shingles, and all of them together
    assert len(met) == jaccard_join.PREFIX_PARTS + 2 and all(met[: jaccard_join.PREFIX_PARTS])


def test_links_share_more_of_their_prefixes_than_is_spare():
    rng = np.random.default_rng(6)
    found = 0
    for _ in range(2000):
        size = int(rng.integers(1, 400))
        base = rng.permutation(1000)[:size]
        other = np.union1d(base[int(rng.integers(0, size // 4 + 1)) :], rng.permutation(1000)[: int(rng.integers(0, size // 4 + 1))])
        one, both = np.sort(base), len(np.intersect1d(base, other))
        if 100 * both >= 75 * (len(one) + len(other) - both):
            found += 1
            shared = np.intersect1d(one[: jaccard_join.prefix_length(len(one))], other[: jaccard_join.prefix_length(len(other))])
            for n in (len(one), len(other)):
                assert len(shared) > jaccard_join.SPARE_PERCENT * -(-75 * n // 100) // 100
    assert found > 500


def test_jaccard_join_edges(make, spark):
    got = jaccard_join.link_documents(make(EDGES)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_components(EDGES)
    kept = jaccard_join.drop_copies(make(EDGES))
    assert kept.columns == ["doc_id", "text", "node", "n"]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (None, "a b c d e f g"), (None, None), (6, "word " * 30_000)]
    )
    empty = make([])
    assert jaccard_join.link_documents(empty).count() == 0 == jaccard_join.drop_copies(empty).count()


def test_count_bound_never_rejects_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 900))
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        cut = int(rng.integers(0, max(1, len(base) // 4)))
        other = np.union1d(base[cut:], rng.integers(0, 2**63, int(rng.integers(0, 5)), dtype=np.uint64))
        both = len(np.intersect1d(base, other))
        links = 100 * both >= 75 * (len(base) + len(other) - both)
        vectors = []
        for own in (base, other):
            bits = jaccard_join.groups_of(len(own)).bit_length() - 1
            vectors.append(np.minimum(np.bincount((own >> np.uint64(64 - bits)).astype(int), minlength=1 << bits), 255).astype("u1").tobytes())
        sizes = [np.array([len(base)]), np.array([len(other)])]
        assert not links or jaccard_join._bounded([vectors[0]], [vectors[1]], *sizes)[0]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)], "a long, b long")
    got = {r.node: r.comp for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_shingles_equal_plain_python():
    rng = random.Random(2)
    texts = [None, "", "  ", "A b", "É é a\x0bb c d e f"] + ["".join(rng.choices("aB c\n\té", k=60)) for _ in range(300)]
    hashed = [set(s.tolist()) for s in shingle_kernel.shingle_strings(texts)]
    plain = [shingles(t) for t in texts]
    assert [len(s) for s in hashed] == [len(s) for s in plain]
    seen = {}
    for h, p in zip(hashed, plain):
        assert (h == seen.setdefault(frozenset(p), h)) and len(h) == len(p)
    assert len(set().union(*hashed)) == len(set().union(*plain))


def test_license_scan_equals_brute_force(make):
    rng = random.Random(4)
    rows = []
    for k, (_, text) in enumerate(TEMPLATES):
        own = text.split()
        rows.append((k, " ".join(prose(rng, 37) + own + prose(rng, 50))))
        cut = own[: max(1, int(len(own) * 0.9))]
        rows.append((100 + k, " ".join(prose(rng, 11) + cut + prose(rng, 9))))
        rows.append((200 + k, " ".join(own[: len(own) // 2] + prose(rng, 30))))
    rows += [(400 + i, t) for i, (_, t) in enumerate(EDGES)]
    want = Counter()
    for doc_id, text in rows:
        for name, template in TEMPLATES:
            own = shingles(template.lower())
            both = len(own & shingles((text or "").lower()))
            if 100 * both >= 75 * len(own):
                want[doc_id, name, both, len(own)] += 1
    assert Counter(map(tuple, license_scan.scan_licenses(make(rows)).collect())) == want
    with pytest.raises(ValueError):
        license_scan.scan_licenses(make(rows), [("short", "all rights reserved")])


def test_notices_under_five_words_are_found(make):
    rows = [(1, "x\n\tAll  RIGHTS\nreserved. y"), (2, "all rights reserved."), (3, "overall rights reserved."), (4, "all rights reserved.x"), (5, "all rights are reserved.")]
    rows += [(2, "all rights reserved."), *[(400 + i, t) for i, (_, t) in enumerate(EDGES)]]
    got = license_scan.scan_notices(make(rows)).collect()
    assert Counter(map(tuple, got)) == {(1, "all-rights-reserved", 1, 1): 1, (2, "all-rights-reserved", 1, 1): 2}
    with pytest.raises(ValueError):
        license_scan.scan_notices(make(rows), [("long", "one two three four five")])


def brute_rules(text):
    text = text or ""
    plain = [w for w in SPACE.split(text) if w]
    windows = Counter(tuple(plain[i : i + 3]) for i in range(len(plain) - 2))
    covered = {p for i in range(len(plain) - 2) if windows[tuple(plain[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    return len(plain), sum(map(len, plain)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_equal_brute_force(make):
    rng = random.Random(6)
    texts = [" ".join(rng.choices("ab cd ef gh. ij! #x |".split(), k=rng.randint(0, 90))).replace("gh.", "gh.\n") for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + EDGES
    got = quality_rules.clean_lines(make(rows)).collect()
    for r in got:
        counts = brute_rules(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.kept and r.base_failed)
    assert len(got) == len(rows)


def test_quality_rules_judge_lines(make):
    clean = "This is a plain line that ends well.\n" + "\n".join(" ".join(f"v{i}{j}" for j in range(12)) + "." for i in range(8))
    loud = "\n".join(" ".join(f"V{i}{j}!!" for j in range(12)) for i in range(8))
    bars = "\n".join(" | ".join(f"v{i}{j}" for j in range(12)) + "." for i in range(8))
    mixed = clean + "\nHome | About | News | Contact\nAccept all cookies to go on."
    got = {r.doc_id: r for r in quality_rules.clean_lines(make([(1, clean), (2, loud), (3, bars), (4, mixed)])).collect()}
    assert [got[k].kept for k in (1, 2, 3, 4)] == [True, False, False, True]
    assert got[4].clean_text == clean


def test_token_files_round_trip(make, spark):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(token_kernel.default_path())
    rows = [(k * 3 % 97, f"Some text {k}, with café!") for k in range(97)] + EDGES
    path = token_files.write_token_files(make(rows), scratch(spark, "test"))
    files = token_files.read_token_files(spark, path)
    by_text = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in files.collect()) == by_text
    digest = sorted(token_files.token_digest(spark, path).collect(), key=lambda r: r.start)
    at, ids = 0, [(r.doc_id is not None, r.doc_id or 0) for r in digest]
    assert ids == sorted(ids)
    for r in digest:
        assert r.start == at
        at += r.n_tokens
    crcs = Counter((i, zlib.crc32(np.array(t, "<u4").tobytes())) for i, t in by_text.elements())
    assert Counter((r.doc_id, r.ids_crc32) for r in digest) == crcs
    empty = token_files.write_token_files(make([]), scratch(spark, "test"))
    assert token_files.token_digest(spark, empty).count() == 0


def check_packing(rows, pieces, window):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(token_kernel.default_path())
    want = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    sequences = {}
    for r in pieces:
        assert r.length == len(r.ids) // 4 > 0
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert sorted(sequences) == list(range(len(sequences)))
    by_doc = {}
    for r in pieces:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    found = sum(r.length for r in pieces)
    assert found == sum(len(t) for _, t in want.elements())
    for (doc_id, n), own in by_doc.items():
        copies = Counter(t for (i, t) in want.elements() if i == doc_id and len(t) == n)
        if sum(copies.values()) == 1:
            ids = b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.start))
            assert tuple(np.frombuffer(ids, "<u4").tolist()) == next(iter(copies))
    return padding


@pytest.mark.parametrize("block", [10**6, 300])
def test_packing_loses_nothing_and_needs_no_padding(make, block):
    rng = random.Random(8)
    rows = [(k, " ".join(prose(rng, rng.choice([1, 5, 20, 60, 150])))) for k in range(120)] + EDGES[:-1]
    pieces = packing.pack_documents(make(rows), window=256, block_tokens=block).collect()
    assert check_packing(rows, pieces, 256) == 0
    assert packing.pack_documents(make([])).count() == 0


def test_fill_is_the_best_subset_sum():
    rng = random.Random(9)
    for _ in range(200):
        counts = Counter(rng.choices(range(1, 40), k=rng.randint(1, 7)))
        room = rng.randint(0, 90)
        sums = {0}
        for x in counts.elements():
            sums |= {s + x for s in sums if s + x <= room}
        best, used = packing.fill(sorted(counts), counts, room)
        assert best == max(sums) == sum(k * v for k, v in used.items())
        assert all(0 < v <= counts[k] for k, v in used.items())


def test_shards_are_even_and_keep_groups(make, spark):
    rng = random.Random(10)
    rows = [(k, f"text {k}") for k in range(300)]
    rows += [(1000 + 10 * g + c, f"copy {g}") for g in range(30) for c in range(rng.randint(2, 6))] + [(5000 + k, "hot") for k in range(160)] + EDGES
    got = sharding.shard_documents(make(rows)).collect()
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))
    texts = dict(zip([r for r, _ in rows], [t for _, t in rows]))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    groups = {}
    for r in got:
        if r.doc_id is not None and str(texts[r.doc_id]).startswith(("copy", "hot")):
            groups.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for t, s in groups.items() if t != "hot") <= 3
    assert len(groups["hot"]) <= 4
    assert sharding.shard_documents(make([])).count() == 0


@pytest.mark.parametrize("hot, groups", [(0, {2: 215}), (160, {2: 100, 20: 3}), (160, {2: 15, 20: 5}), (150, {36: 8})])
def test_no_group_that_fits_a_shard_is_cut(make, hot, groups):
    texts = ["hot"] * hot + [f"copy {n} {g}" for n, count in groups.items() for g in range(count) for _ in range(n)]
    texts += [f"text {k}" for k in range(480 - len(texts))]
    random.Random(5).shuffle(texts)
    got = sharding.shard_documents(make(list(enumerate(texts)))).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [60] * 8
    shards = {}
    for r in got:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert [t for t, s in shards.items() if len(s) > 1 and t != "hot"] == []
    assert len(shards.get("hot", ())) <= (3 if 36 not in groups else 8)


def test_leaks_equal_brute_force(make, spark):
    rng = random.Random(12)
    items = [(k, " ".join(prose(rng, rng.choice([3, 5, 12, 40])))) for k in range(30)] + [(50, None), (51, " ")]
    rows = []
    for k, text in items[:30]:
        own = text.split()
        rows.append((k, " ".join(prose(rng, 400) + own + prose(rng, 300))))
        rows.append((100 + k, " ".join(prose(rng, 40) + own[: max(1, len(own) * 4 // 5)] + prose(rng, 30))))
        rows.append((200 + k, text))
    rows += EDGES
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    want = Counter()
    for doc_id, text in rows:
        for item_id, item in items:
            own = shingles(item)
            both = len(own & shingles(text))
            if own and 100 * both >= 75 * len(own):
                want[doc_id, item_id, both, len(own)] += 1
    for block in (20_000, 7):
        got = decontamination.find_leaks(make(rows), table, block_items=block).select("doc_id", "item_id", "n_shared", "n_shingles")
        assert Counter(map(tuple, got.collect())) == want
    kept = decontamination.drop_leaks(make(rows), table)
    own = [shingles(t) for _, t in items]
    leaked = {t for _, t in rows if any(o and 100 * len(o & shingles(t)) >= 75 * len(o) for o in own)}
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in rows if t not in leaked)
    assert decontamination.find_leaks(make([]), table).count() == 0
    assert decontamination.find_leaks(make(rows), table.limit(0)).count() == 0


def labelled_docs(seed=14, n=1500):
    rng = random.Random(seed)
    bad_words = ["vexo" + s for s in ("a", "b", "ct", "dr", "ena")] + ["grumk", "snarf", "blorf"]
    rows, labels = [], []
    for k in range(n):
        body = [f"{w}{'.' if rng.random() < 0.1 else ''}" for w in prose(rng, rng.randint(20, 200), 800)]
        toxic, good = rng.random() < 0.15, rng.random() < 0.8
        if toxic:
            for _ in range(rng.randint(2, 6)):
                body.insert(rng.randrange(len(body)), rng.choice(bad_words))
        if not good:
            body = [w.upper() + "!!" for w in body] if rng.random() < 0.5 else body[:5] * 20
        rows.append((k, " ".join(body)))
        labels.append((k, int(good), int(toxic), "y"))
    return rows, labels


def test_classifiers_on_the_held_out_fold(make, spark):
    rows, labels = labelled_docs()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, y string")
    docs = make(rows + EDGES)
    for module, name, threshold in ((toxicity, "toxic", 0.5), (quality_mil, "quality", 0.3)):
        scores = {}
        for r in module.score_documents(docs, module.fit(docs, table)).collect():
            assert 0 <= r.score <= 1
            scores.setdefault(r.doc_id, r.score)
        truth = {k: (q if name == "quality" else t) for k, q, t, _ in labels}
        fold = [k for k in truth if k > 10 and zlib.crc32(str(k).encode()) % 5 == 0]
        right = sum((scores[k] >= threshold) == bool(truth[k]) for k in fold) / len(fold)
        assert right > 0.95, (name, right)


def test_labels_of_the_held_out_fold_are_never_read(make, spark):
    rows, labels = labelled_docs(n=400)
    flipped = [(k, 1 - q, 1 - t, y) if zlib.crc32(str(k).encode()) % 5 == 0 else (k, q, t, y) for k, q, t, y in labels]
    schema = "doc_id long, quality int, toxic int, y string"
    docs = make(rows)
    for module in (toxicity, quality_mil):
        one, other = ({r.doc_id: r.score for r in module.score_documents(docs, module.fit(docs, spark.createDataFrame(t, schema))).collect()} for t in (labels, flipped))
        assert one == pytest.approx(other)


def test_classifiers_without_labels(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make(EDGES)
    assert toxicity.fit(docs, none) is None and quality_mil.fit(docs, none) is None
    assert toxicity.drop_toxic(docs, None).count() == len(EDGES) == quality_mil.keep_good(docs, None).count()
    assert toxicity.drop_toxic(docs, None).columns == docs.columns


def test_every_occurrence_of_an_entry_counts():
    bad = np.frombuffer(b"xy", np.uint8)
    units, _ = toxicity.word_units(bad, np.array([0, 2]))
    lexicon = np.unique(units).astype(np.int64)  # a short word is one entry
    assert len(lexicon) == 1
    weights = np.zeros(6 + len(lexicon) + 1)
    weights[0] = 1  # log1p of the hits
    scores = toxicity.scorer(toxicity.Model(lexicon, weights))(pa.array(["a b", "a xy b", "xy a xy b XY", None]))
    assert np.exp(np.log(scores / (1 - scores))) == pytest.approx([1, 2, 4, 1])


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    votes = np.zeros((4000, 8))
    for j, accuracy in enumerate([0.9, 0.85, 0.8, 0.8, 0.75, 0.7, 0.6, 0.55]):
        right = rng.random(4000) < accuracy
        votes[:, j] = np.where(right == y, 1, -1) * (rng.random(4000) < 0.7)
    posterior, _ = toxicity.label_model(votes, np.where(votes.sum(1) > 0, 0.8, 0.2))
    assert ((posterior > 0.5) == y).mean() > 0.9


def test_gated_attention_gradients():
    rng = np.random.default_rng(4)
    model = quality_mil.GatedAttention(5)
    x, first = rng.normal(size=(9, 5)), np.array([0, 4, 5, 9])
    target, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        y = model.forward(x, first)["y"]
        return -(weight * (target * np.log(y) + (1 - target) * np.log(1 - y))).sum() / weight.sum()

    gradients = model.gradients(x, first, target, weight)
    for name, values in model.p.items():
        at = tuple(0 for _ in values.shape)
        values[at] += 1e-5
        up = loss()
        values[at] -= 2e-5
        down = loss()
        values[at] += 1e-5
        assert gradients[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)


def test_html_extraction(spark):
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav>"
        "<!-- <p>hidden</p> --><div class=\"ad\">Buy this now. Cheap offers.</div><article><h1>A title of some words</h1><p>First &amp; second&nbsp;thing,\n  with a <b>bold</b> word. And another sentence here.<p>"
        "An open paragraph<br>goes on to its end. It has more text.</article><section class=comments><h3>Comments</h3><div class=comment><p>Nice post, thanks a lot.</p></div></section>"
        "<footer>&copy; Some site</footer>"
    )
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<p>cut <b"), (4, "x", "</div></p>"), (1, "u", page)]
    table = spark.createDataFrame([(a, b, c, "z") for a, b, c in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html_extraction.extract_main_text(table).collect()]
    want = "A title of some words\n\nFirst & second thing, with a bold word. And another sentence here.\n\nAn open paragraph goes on to its end. It has more text."
    found = Counter(got)
    assert found[1, want] == 2 and found[2, ""] == 1 and found[None, ""] == 1 and len(got) == 6


def test_embedded_elements_drop_no_article_text():
    model = html_extraction.trained()
    title, first, second = "A title of some words", "First thing, with a bold word. And another sentence here, of some length.", "The second paragraph goes on to its end. It has more text, and then it ends."
    nav = "<html><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav>"
    article = f"<article><h1>{title}</h1><p>{first}</p>%s<p>{second}</p></article></body></html>"
    want = [title, first, second]
    for embedded in ("", '<svg class="icon" viewBox="0 0 1 1"/>', "<math/>", "<svg><title/><path d='M0 0'/></svg>", "<object data=a>", "<canvas>", "<select>", "<iframe src=a>", "<svg>"):
        for page in (nav + embedded + article % "", nav + article % embedded):
            assert html_extraction.extract_pages([page], model)[0].split("\n\n") == want, embedded
    for inside in ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "<object data=a><p>Some words that stand for it, in a sentence. And one more.</p></object>"):
        text = html_extraction.extract_pages([nav + article % inside], model)[0]
        assert all(w in text for w in [*want, re.sub("<[^>]*>", "", inside)]), inside


def test_made_up_pages_are_extracted():
    from paperloom.llm.dom import parse

    maker, model, right = html_extraction.PageMaker(77), html_extraction.trained(), 0
    for _ in range(60):
        html = maker.page()
        truth = sum(len(p.replace(html_extraction._MAIN, "").split()) for b in parse(html).blocks for _, p in b if html_extraction._MAIN in p)
        text = html_extraction.extract_pages([html.replace(html_extraction._MAIN, "")], model)[0]
        right += abs(len(text.split()) - truth) <= 2
    assert right >= 54


def test_decoding_never_keeps_a_child_of_a_dropped_parent():
    from paperloom.llm.dom import parse

    rng, maker = np.random.default_rng(5), html_extraction.PageMaker(5)
    for _ in range(20):
        page = parse(maker.page())
        chosen = html_extraction.decode(page, rng.normal(size=len(page.nodes)) * 3)
        assert all(chosen[n.parent] for k, n in enumerate(page.nodes) if chosen[k] and n.parent >= 0)


def test_broken_quotes_are_tags_and_not_text():
    from paperloom.llm import dom

    def texts(html):
        return [" ".join("".join(t for _, t in b).split()) for b in dom.parse(html).blocks]

    assert texts('<p>one <a href="foo>two</a> three</p><p>four</p>') == ["one two three", "four"]
    assert texts("<p title='x>one <b class=\"y\">two</b></p>") == ["one two"]
    assert texts('<p title="a > b">1 < 2 and "x" > y</p>') == ['1 < 2 and "x" > y']


def test_license_query_finds_short_notices_too(spark, tmp_path):
    rows = [(1, "x All Rights  Reserved. y"), (2, "all rights reserved"), (3, None), (4, "Licensed under CC BY-NC 4.0. and more")]
    rows += [(1, "x All Rights  Reserved. y"), (None, ""), (5, "w " * 30_000 + "all rights reserved.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.template) for r in license_scan.op2_license_scan(spark, str(tmp_path)).collect())
    assert got == Counter({(1, "all-rights-reserved"): 2, (5, "all-rights-reserved"): 1, (4, "cc-by-nc-4.0-line"): 1})


def test_short_texts_of_training_do_not_depend_on_the_batch():
    texts = ["bad word", "good word", "bad word", "", "one", None, "two"]
    key = lambda some: [
        r for b in toxicity._training_features(iter([pa.record_batch([pa.array(some), pa.array([0] * len(some))], names=["text", "y"])])) for r in b.column(1).to_pylist()
    ]
    whole = key(texts)
    assert whole == [k for t in texts for k in key([t])]
    assert whole[0] == whole[2] != whole[1] and len({whole[4], whole[6], whole[3]}) == 3


def test_drop_copies_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g", "x", 7, 1.5), (2, "a b c d e f g", "y", 8, 2.5), (3, None, "z", 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_hash string, w_id long, `odd.name` double")
    got = jaccard_join.drop_copies(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_bit_bounds_and_box_joins_never_miss_a_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 1500)), dtype=np.uint64) << np.uint64(1))
        sets.append(base)
        for _ in range(int(rng.integers(0, 4))):
            cut = int(rng.integers(0, len(base) // 5 + 1))
            sets.append(np.union1d(base[cut:], rng.integers(0, 2**63, cut // 2, dtype=np.uint64)))
    sets.append(np.arange(40_000, dtype=np.uint64))  # all in one group
    sets.append(np.arange(2_000, 41_000, dtype=np.uint64))
    n, bits = np.array([len(x) for x in sets]), []
    for own in sets:
        width = jaccard_join.groups_of(len(own)).bit_length() - 1
        counts = np.bincount((own >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width)
        bits.append(jaccard_join.as_bits(jaccard_join.closed(counts)))
    node = np.arange(len(sets))
    links = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 75 * (n[i] + n[j] - both):
                links.add((j, i))
    assert len(links) > 50
    whole = set(jaccard_join.tree_pairs(node, node, n, bits, np.zeros(len(sets), int)))
    assert links <= whole and len(whole) < 3 * len(links)
    side = rng.integers(1, 3, len(sets))
    split = set(jaccard_join.tree_pairs(node, node, n, bits, side))
    assert {(i, j) for i, j in links if side[i] != side[j]} <= split
    best = set(jaccard_join.tree_pairs(node, node, n, bits, np.zeros(len(sets), int), best=True))
    assert best <= whole and {i for p in links for i in p} <= {i for p in best for i in p}
    bulk = set(jaccard_join.leaf_pairs(np.zeros(16, int), node[:16], node[:16], n[:16], bits[:16]))
    assert {p for p in links if max(p) < 16} <= bulk


def test_few_labels_that_show_nothing_reject_nothing(make, spark):
    rng = random.Random(31)
    rows = [(k, " ".join(prose(rng, 50))) for k in range(60)]
    labels = spark.createDataFrame([(k, 1, int(k % 8 == 3)) for k in range(60)], "doc_id long, quality int, toxic int")
    docs = make(rows)
    assert toxicity.drop_toxic(docs, toxicity.fit(docs, labels)).count() == 60


def test_token_files_are_written_by_workers_that_give_memory_back(spark, tmp_path):
    keys = ["spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k) for k in keys]
    seen = []
    real = token_files.tidy
    token_files.tidy = lambda run: seen.append(run) or real(run)
    try:
        docs = spark.createDataFrame([(k, "then the end. " * k) for k in range(50)], "doc_id long, text string")
        path = token_files.write_token_files(docs, str(tmp_path / "ids"))
    finally:
        token_files.tidy = real
    rows = {r["doc_id"]: r["n_tokens"] for r in token_files.read_token_files(spark, path).collect()}
    assert len(seen) == 1 and rows[0] == 1 and rows[49] == 49 * (rows[1] - 1) + 1
    assert before == [spark.conf.get(k) for k in keys]
