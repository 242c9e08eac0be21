"""Operators 11 to 13 against plain Python."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from paperloom.llm import phrases, spelling, url_filters
from paperloom.llm.common import Shelf


@pytest.fixture(scope="module")
def docs(spark):
    def made(rows):
        full = [(i, t, lang, "x", 1, 2) for i, t, lang in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, word string, n long, key long").repartition(3)

    return made


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def variants(rows):
    n = Counter()
    for doc_id, text, _ in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for word in n:
        found = [w for w in n if near(word, w)]
        best = min(found, key=lambda w: (-n[w], w)) if found else None
        form = best if best and n[best] >= 10 * n[word] else None
        out[word] = [form, word, n[word], len(found), n[form] if form else None]
    for row in out.values():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(row) for w, row in out.items()}


def edited(rng, word):
    at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
    letter = rng.choice("abé×ÿ")
    return word[:at] + letter + word[at:] if kind == 0 else word[:at] + (letter if kind == 1 else "") + word[at + 1 :]


def test_variants_equal_plain_python(docs):
    rng = random.Random(5)
    stems = ["".join(rng.choices(["ab", "aa", "é", "the", "ÿo", "×n"], k=rng.randint(3, 6))) for _ in range(30)]
    words = stems + [edited(rng, rng.choice(stems)) for _ in range(250)]
    words += [edited(rng, rng.choice(words)) for _ in range(250)]
    weights = [rng.choice([1, 1, 3, 40, 600]) for _ in words]
    texts = [" ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=rng.randint(0, 60))) for _ in range(120)]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    rows += [(200 + k, " ".join(["chainwort"] * 40 + ["chainwork"] * 3 + ["chaiwork"] * (k % 11 == 0)), "en") for k in range(60)]
    rows += [(300 + k, " ".join(["chainwerk"] * 2), "en") for k in range(5)]
    rows += [(None, "Spelling spelling spelling", None), (7, None, "en"), (8, "", "en"), (3, texts[3], "en"), (3, texts[3], "en"), (900, "aaaaaaaa aaaaaaa aaaaaaaaa " * 3000, "en")]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group_variants(docs(rows)).collect()}
    assert got == variants(rows)
    assert any(r[0] and r[1] != r[0] for r in got.values())  # chains of two steps


def test_near_words_come_once_each(spark):
    rng = random.Random(8)
    words = {"".join(rng.choices("ab", k=rng.randint(7, 11))) for _ in range(700)}
    found = spelling.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).select("a", "b").collect()
    cut = {(len(w), i, w[:i] + w[i + 1 :]) for w in words for i in range(len(w))}
    want = {tuple(sorted(p)) for p in combinations(words, 2) if len(p[0]) == len(p[1]) and sum(x != y for x, y in zip(*p, strict=True)) == 1}
    want |= {tuple(sorted((w, rest))) for w in words for n, i, rest in [(len(w), i, w[:i] + w[i + 1 :]) for i in range(len(w))] if rest in words}
    assert cut and len(found) == len(want) and {tuple(sorted((r["a"], r["b"]))) for r in found} == want


def test_long_texts_are_read_whole(docs, monkeypatch):
    monkeypatch.setattr(spelling, "_LONG", 10)
    monkeypatch.setattr(spelling, "_HELD", 3)
    rows = [(1, "letters letters numbers " * 50, "en"), (2, "numbers symbols symbols", None)]
    assert spelling._runs(b"Letters, LETTERS numbers") == {"letters": 2, "numbers": 1}
    got = {r["word"]: r["n"] for r in spelling.words_of(docs(rows)).collect()}
    assert got == {w: r[2] for w, r in variants(rows).items()}


def collocations(rows, top, least):
    f, n, names = Counter(), Counter(), {}
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    f = {p: a for p, a in f.items() if a >= least}
    out = {}
    for (lang, p), a in f.items():
        inside = [b for (m, q), b in f.items() if m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if len(p) < 2 or any(100 * b >= 80 * a for b in inside):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        names.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    for lang, found in names.items():
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out[lang, rank] = (p.decode(), -a, l, r, n[lang], -score)
    return out


def phrase_rows(rng):
    words = ["the", "of", "Ärz", "x\u00a0y", "new", "york", "a\x01", "a", "b"] + [f"w{k}" for k in range(12)]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(" ".join(rng.choices(words, [9, 7] + [1] * (len(words) - 2), k=rng.randint(1, 9))))
            parts.append(rng.choice(["New York City ", "in the United States of America", "\tto be or not\tto be", ""]))
            parts.append(rng.choice([" ", ". ", ",", "\n", " ; "]))
        texts.append("".join(parts))
    rows = [(k, t, rng.choice(["en", "en", "de", None, "und"])) for k, t in enumerate(texts)]
    return [*rows, (None, None, "en"), (1, "", "fr"), (2, "solo", "fr"), (3, texts[3], "en"), (3, texts[3], "en")]


def test_phrases_equal_plain_python(docs):
    rows = phrase_rows(random.Random(3))
    got = {(r["lang"], r["rank"]): tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(docs(rows), 40, 5).collect()}
    want = collocations(rows, 40, 5)
    assert got == want and len(want) > 60


def test_phrases_over_borders_of_slices_blocks_and_ranges(docs, spark, monkeypatch):
    rows = phrase_rows(random.Random(4)) + [(99, "to be or not to be the question of the day " * 40, "en")]
    for name, value in (("BLOCK_WORDS", 50), ("_SLICE", 90), ("CHUNK_KEYS", 300), ("RANGE_KEYS", 60)):
        monkeypatch.setattr(phrases, name, value)
    shelf = Shelf(spark)
    # folded here: workers would import the module anew, with its own sizes
    table = docs(rows).select("lang", "text").toArrow().to_batches()
    lang = [(("und" if x is None else x), t) for b in table for x, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in lang]), pa.array([t for _, t in lang], pa.string())], names=["lang", "text"])
    folded = pa.Table.from_batches(list(phrases._encode(iter([batch]))))
    assert folded.num_rows > 20
    blocks = shelf.put(spark.createDataFrame(folded.add_column(0, "block", pa.array(range(folded.num_rows)))), "blocks")
    words = shelf.put(phrases.dictionary(blocks, shelf, 5), "words")
    encoded = shelf.put(phrases.encode_ids(blocks, words), "ids")
    names = {r["id"]: r["word"] for r in words.collect()}
    got = {}
    for r in phrases.phrase_counts(encoded, folded.num_rows, 3000, 5).collect():
        ids = [int.from_bytes(r["key"][k : k + 4], "big") for k in range(0, len(r["key"]), 4)]
        got[tuple(ids)] = r["a"]
    of = {r["id"]: r["lang"] for r in words.collect()}
    got = {(of[k[0]], tuple(names[i] for i in k)): a for k, a in got.items()}
    f = Counter()
    for _, text, x in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            for k in range(2, 5):
                f.update((("und" if x is None else x), tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    assert got == {p: a for p, a in f.items() if a >= 5}


def test_no_rows_give_no_rows(docs, spark):
    assert spelling.group_variants(docs([])).count() == 0
    assert phrases.collocations(docs([])).count() == 0
    assert phrases.collocations(docs([(1, None, None), (2, "one two", "en")])).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_filters.judge(pages, labels).count() == 0


def plain_tokens(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.match("[^/?#]*", rest)[0])
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    query = re.match(r"[^?#]*\?([^#]*)", url or "")
    keys = [k.split("=")[0] for k in query[1].split("&")] if query and host else []
    found = [("h:", x) for x in host.split(".")] + [("p:", x) for x in path.split("/")] + [("q:", x) for x in keys]
    return host, path, {k + re.sub("[0-9]+", "0", x) for k, x in found if x}


def plain_verdicts(pages, labels, least, sure):
    bad = {}
    for doc_id, quality, toxic in labels:
        bad[doc_id] = bad.get(doc_id, False) or toxic == 1 or quality == 0
    held, hit = Counter(), Counter()
    for page_id, url in pages:
        tokens = sorted(plain_tokens(url)[2])
        if page_id in bad:
            for k in range(1, len(tokens) + 1):
                for s in combinations(tokens, k):
                    held[s] += 1
                    hit[s] += bad[page_id]
    rules = [set(s) for s, n in held.items() if n >= least and hit[s] / n >= sure]
    out = []
    for page_id, url in pages:
        host, path, tokens = plain_tokens(url)
        fits = [(r.host + r.path, r.verdict) for r in url_filters.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "block" if any(s <= tokens for s in rules) else "allow")
        out.append((page_id, host, path, rule, verdict))
    return out, rules


def test_verdicts_equal_plain_python(spark):
    rng = random.Random(2)
    hosts = ["Shop.Example.COM", "casino.example.com", "a.example.net", "net", "bets.example.org", "notnet", "x.net:80"]
    pages = []
    for k in range(400):
        path = rng.choice(["", "/", "/en/1", "/de/22", "/fr/3.html", "/win/9", "//win//", "/en"])
        pages.append((k, rng.choice(["http", "https"]) + "://" + rng.choice(hosts) + path + rng.choice(["", "?ref=a&id=7", "#top", "?win"])))
    pages += [(None, None), (401, None), (402, ""), (403, "no scheme/en/"), (404, "http://"), (5, pages[5][1]), (405, "a?b://net/x"), (406, "http://q.net\n/x?y\nz")]

    def toxic(url):
        return int(rng.random() < (0.95 if "casino" in url and "win" in url else 0.9 if "bets" in url else 0.1))

    labels = [(k, rng.choice([1, 1, 1, None]), toxic(url)) for k, url in pages[:300]] + [(5, 1, 0), (None, 0, 1), (9999, 0, 1)]
    table = spark.createDataFrame([(i, u, "h", "t") for i, u in pages], "page_id long, url string, host string, tokens string").repartition(3)
    marks = spark.createDataFrame([(*row, "r") for row in labels], "doc_id long, quality int, toxic int, page_id string")
    got = url_filters.judge(table, marks, min_held=8)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want, rules = plain_verdicts(pages, labels, 8, 0.8)
    order = lambda rows: sorted(map(repr, rows))
    assert order(tuple(r) for r in got.collect()) == order(want)
    assert {"h:bets"} in rules and any({"h:casino", "q:win"} <= r for r in rules)


def test_mined_rules_are_the_smallest(spark):
    rng = random.Random(6)
    rows = [([f"h:{a}", "h:com", f"p:{b}"], a == "spam" and b == "x" or rng.random() < 0.1) for a in ("spam", "shop", "news") for b in ("x", "y") for _ in range(60)]
    table = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    found = url_filters.mine(table, Shelf(spark), min_held=20).collect()
    assert [sorted(r["tokens"]) for r in found] == [["h:spam", "p:x"]] and found[0]["post"] == "h:spam"
