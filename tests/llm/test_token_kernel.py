import random

import numpy as np
import pytest

from paperloom.llm import token_kernel as K

tokenizers = pytest.importorskip("tokenizers")

CASES = [
    "",
    " \t\n",
    "The then, THE end.",
    "it's don't 'tis",
    "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>.",
    "café café, ÉLÈVE! naïve—dash",
    "a b　c d",
    "İstanbul ΣΣ ß ***thnd*** word### a,b 12.5% $$$",
    "\x1c\x1d odd \x85 control",
    "long" * 500,
]


def test_equals_whole_text_encoding_with_any_memo_size():
    path = K.default_path()
    whole = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(5)
    letters = "abcTHE é́,.!#'\n\t€<|>0ß"
    texts = CASES + ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(400)]
    for bound in (5, 10**6):
        encoder = K.ChunkEncoder(path, bound)
        packed = []
        for at in range(0, len(texts), 7):
            packed += encoder.encode_many([t.encode() for t in texts[at : at + 7]])
        for text, ids in zip(texts, packed):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
        assert len(encoder._chunks.new) <= max(bound, 600)


def test_null_is_empty():
    assert K.encoder(K.default_path()).encode(None) == b""


def test_files_that_keep_case_and_space_are_encoded_whole():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    packed = K.ChunkEncoder(path).encode_many([t.encode() for t in CASES])
    for text, ids in zip(CASES, packed):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def _whole(tokenizer, texts):
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_every_letter_of_unicode_before_every_mark():
    path = K.default_path()
    whole, encoder = tokenizers.Tokenizer.from_file(path), K.ChunkEncoder(path)
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    rare = [c for c in letters if whole.encode(c + ".", add_special_tokens=False).ids != whole.encode(c + " .", add_special_tokens=False).ids]
    assert "\u0130" in rare and "\u0958" in rare
    some = letters[:: len(letters) // 4000]
    marks = K.TAIL.decode()
    texts = [f"{c}{m} A{c}{m}{m}b" for c in rare + some for m in marks] + [f"x{c}." for c in letters]
    texts += [f"{c}{m}." for c in "ABHIJKTWYhjtwy" for m in map(chr, range(0x300, 0x370))]
    packed = encoder.encode_many([t.encode() for t in texts])
    for text, ids, want in zip(texts, packed, _whole(whole, texts)):
        assert np.frombuffer(ids, "<u4").tolist() == want, text


def test_mixed_scripts_with_each_shipped_file():
    import public_tokenizers

    rng = random.Random(11)
    pieces = "GELD\u0130. ANKARAL\u0130! T\u00dcRK\u0130YES\u0130, \u0915\u093c. \u0958? H\u0331. T\u0308 J\u030c; \u05d0\ufb31: \u1112\u1161\u11ab. \uff21\uff0e 'S 'll \u03a3\u03a3. <|endoftext|>. \u2126; \u212a. \u00bd, \u2160. na\u00efve \u4e2d\u6587\u3002".split()
    texts = [rng.choice(["", " ", "\u00a0"]).join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(500)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        packed = K.ChunkEncoder(path).encode_many([t.encode() for t in texts])
        for text, ids, want in zip(texts, packed, _whole(tokenizers.Tokenizer.from_file(path), texts)):
            assert np.frombuffer(ids, "<u4").tolist() == want, text
    assert K.parts_at_space(public_tokenizers.path("word_bpe_49k.json"))
    assert not K.parts_at_space(public_tokenizers.path("byte_bpe_50k.json"))


class Counting(dict):
    looked = 0

    def get(self, key):
        self.looked += 1
        return super().get(key)


def test_only_distinct_chunks_are_looked_up():
    encoder = K.ChunkEncoder(K.default_path())
    encoder._chunks.new = seen = Counting()
    once = encoder.encode(b"then the end")
    assert encoder.encode_many([b"then the end " * 5000] * 3) == [once * 5000] * 3
    assert seen.looked <= 50


def test_words_with_and_without_punctuation_are_remembered_once():
    encoder = K.ChunkEncoder(K.default_path())
    encoder.encode(b"then. then, then! end end. the")
    memos = [m for m in vars(encoder).values() if isinstance(m, K.Memo)]
    assert sum(b"end" in m.new for m in memos) == 1 == sum(b"then" in m.new for m in memos)


def test_slices_are_bounded_and_whole():
    import pyarrow as pa

    texts = ["x" * n for n in (0, 1, K.SLICE_BYTES, 5, 3 * K.SLICE_BYTES)] + [None] + ["y"] * 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(K.slices(batch, 1))
    assert [t for _, some in parts for t in some] == [None if t is None else t.encode() for t in texts]
    assert [k for rows, _ in parts for k in rows.column(0).to_pylist()] == list(range(len(texts)))
    assert all(len(some) == 1 or (len(some) <= K.SLICE_ROWS and sum(len(t or b"") for t in some) <= K.SLICE_BYTES) for _, some in parts)


def test_a_block_of_packing_holds_its_ids_once():
    import tracemalloc

    import pyarrow as pa

    from paperloom.llm import packing

    run = packing._pack_partition(K.default_path(), 1, 2048, 2_000_000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array([0] * 700), pa.array(["then the end " * 1000] * 700)], names=["doc_id", "part", "text"])
    list(run(iter([batch.slice(0, 5)])))
    tracemalloc.start()
    n = sum(sum(rows.column(3).to_pylist()) for rows in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 700 * 3001 and peak < 40e6
