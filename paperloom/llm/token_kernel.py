"""Word-memoised encoding with a public ``tokenizers`` file.

A file whose steps are exactly ``WORD_STEPS`` drops white space and case and never
joins characters across white space, so the ids of a text are the ids of its
ASCII-white-space-separated chunks one after the other; any other file is encoded
text by text.  Each distinct chunk is encoded once by the ``tokenizers`` library
and remembered as little-endian uint32 bytes; the chunks of some texts are coded
in bulk, so only distinct ones are looked up, and their ids gathered in one step.
Other Unicode white space stays inside a chunk and is left to the library.  A
chunk that is a word followed by plain punctuation shares the ids of the word and
of the punctuation where the library itself parts them after the word's last
letter: composition or lower-casing may turn a letter into one with a mark, which
the pre-tokenizer joins to the punctuation.  ASCII letters are lower-cased ahead
but where a combining mark could make another letter of the small one.

Memory is bounded: a memo that reaches its bound becomes the old generation,
from which chunks still in use move back; results never depend on the memo.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most entries in one generation of a memo (about 200 bytes each).
MEMO_BOUND = 400_000
#: Chunks longer than this are not remembered, to bound the memo's bytes.
LONGEST_REMEMBERED = 100
#: Most rows and bytes of texts that are encoded at once.
SLICE_ROWS, SLICE_BYTES = 1024, 2 << 20
#: Punctuation that the pre-tokenizer splits from a letter or digit before it.
TAIL = b".,;:!?*#$%&"
#: The steps of a file for which chunks may be encoded apart.
WORD_STEPS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def parts_at_space(path: str) -> bool:
    """Whether the file's own steps never join what white space parts, nor heed case."""
    with open(path, encoding="utf-8") as file:
        steps = json.load(file)
    special = all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in steps["added_tokens"])
    return special and steps["model"]["type"] == "BPE" and all(steps.get(k) == v for k, v in WORD_STEPS.items())


def keeps_case(text: bytes) -> bool:
    """Whether lower-casing ASCII ahead could change ids.

    Special tokens keep their case; a capital and a combining mark (U+0300 to
    U+036F, lead bytes CC and CD) may stay apart where the small letter joins it.
    """
    return b"<|" in text or b"\xcc" in text or b"\xcd" in text


class Memo:
    """Two generations of a bounded dictionary."""

    def __init__(self, bound: int):
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.bound = bound

    def turn(self, coming: int) -> None:
        if len(self.new) + coming > self.bound:
            self.old, self.new = self.new, {}

    def add(self, found: dict[bytes, bytes]) -> None:
        self.turn(len(found))
        self.new.update(found)


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies, by rule."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in shown}
    letters |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letters)}
    return letters


_BYTE_LETTERS = _byte_letters()
#: Lower-case Latin letters that no earlier step changes; none of them joins another.
_PLAIN = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower() == c and is_normalized("NFC", c))


def plain_word(part: bytes) -> str | None:
    """The byte letters of a lower-case Latin word that no earlier step changes."""
    if part.isalpha():  # ASCII letters only
        return part.decode("ascii") if part.islower() else None
    if not part or not _PLAIN.issuperset(part.decode("utf-8")):
        return None
    return part.decode("latin-1").translate(_BYTE_LETTERS)


class ChunkEncoder:
    """Encodes UTF-8 texts to ids packed as little-endian uint32."""

    def __init__(self, path: str, bound: int = MEMO_BOUND):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._chunks = Memo(bound)
        self._by_chunk = parts_at_space(path)
        self._letters: dict[str, bool] = {}
        # the shortcut must agree with the library on this file
        words = [b"thentionable", "\u00e9l\u00e8ve\u00e7\u00e4\u00f1\u00f3\u00df".encode(), b"a"]
        self._by_word = False
        plain = self._encode_each(words)
        self._by_word = True
        self._by_word = self._encode_each(words) == plain

    def _ends_word(self, letter: str) -> bool:
        """Whether the library parts punctuation from a word with this last letter."""
        known = self._letters.get(letter)
        if known is None:
            both, alone, mark = (
                self._tokenizer.encode(text, add_special_tokens=False).ids for text in (letter + ".", letter, ".")
            )
            known = self._letters[letter] = letter.isalpha() and both == alone + mark
        return known

    def _word_and_tail(self, chunk: bytes) -> tuple[bytes, bytes] | None:
        """(lower-cased word, punctuation) where both encode independently."""
        word = chunk.rstrip(TAIL)
        if word.isalpha():  # ASCII letters only
            return word.lower(), chunk[len(word) :]
        if not word or keeps_case(chunk):
            return None
        last = word[-1]
        if last < 128:
            if not (48 <= last <= 57 or 65 <= last <= 90 or 97 <= last <= 122):
                return None
        else:
            text = word.decode("utf-8")
            if not self._ends_word(text[-1]) or not is_normalized("NFC", text):
                return None
        return word.lower(), chunk[len(word) :]

    def _encode_each(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part; plain lower-case words go straight to the merges."""
        out: list[bytes] = [b""] * len(parts)
        rest, tokenize = [], self._tokenizer.model.tokenize
        for place, part in enumerate(parts):
            letters = plain_word(part) if self._by_word else None
            if letters is None:
                rest.append(place)
            else:
                out[place] = array("I", [t.id for t in tokenize(letters)]).tobytes()
        if rest:
            found = self._tokenizer.encode_batch_fast([parts[p].decode("utf-8") for p in rest], add_special_tokens=False)
            for place, encoded in zip(rest, found, strict=True):
                out[place] = array("I", encoded.ids).tobytes()
        return out

    def _learn(self, unknown: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that the memo lacks, and of the words and punctuation they split into; remembers them."""
        get, old = self._chunks.new.get, self._chunks.old
        out = {c: old[c] for c in unknown if c in old}
        splits = {c: self._word_and_tail(c) or (c, b"") for c in unknown if c not in out}
        parts = {part: get(part) or old.get(part) for split in splits.values() for part in split}
        parts[b""] = b""
        lacking = [part for part, ids in parts.items() if ids is None]
        for at in range(0, len(lacking), 4096):
            some = lacking[at : at + 4096]
            parts.update(zip(some, self._encode_each(some), strict=True))
        out.update((chunk, parts[word] + parts[tail] if tail else parts[word]) for chunk, (word, tail) in splits.items())
        for found in (out, {part: parts[part] for part in lacking if part not in out}):
            self._chunks.add({c: ids for c, ids in found.items() if len(c) <= LONGEST_REMEMBERED})
        return out

    def _ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """The packed ids of distinct chunks."""
        found = list(map(self._chunks.new.get, chunks))
        unknown = [c for c, ids in zip(chunks, found, strict=True) if ids is None]
        if unknown:
            learnt = self._learn(unknown)
            found = [learnt[c] if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
        return found

    def encode_flat(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and end in it; null and empty give none.

        Only the distinct chunks of the texts are looked up; their ids are gathered in bulk.
        """
        if not self._by_chunk:  # white space or case matter to this file
            packed = self._encode_each([t or b"" for t in texts])
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
            return np.frombuffer(b"".join(packed), "<u4"), ends
        folded = pa.array([(t if keeps_case(t) else t.lower()) if t else b"" for t in texts], pa.large_binary())
        chunked = pc.ascii_split_whitespace(folded.view(pa.large_string()))
        of_text = chunked.offsets.to_numpy()
        coded = chunked.values.view(pa.large_binary()).dictionary_encode()
        found = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        n = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ids = np.frombuffer(b"".join(found), "<u4")
        code = coded.indices.to_numpy()
        each = n[code]
        ends = np.concatenate([[0], np.cumsum(each)])
        # place of each id of a chunk: where the chunk's ids begin, less where they come to stand
        shift = (np.cumsum(n) - n)[code] - ends[:-1]
        return ids[np.repeat(shift, each) + np.arange(ends[-1])], ends[of_text]

    def encode_ended(self, texts: list[bytes | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with an end id after each text."""
        ids, ends = self.encode_flat(texts)
        ends = ends + np.arange(len(ends))
        out, own = np.full(ends[-1], end_id, "<u4"), np.ones(ends[-1], bool)
        own[ends[1:] - 1] = False
        out[own] = ids
        return out, ends

    def encode_many(self, texts: list[bytes | None]) -> list[bytes]:
        """The packed ids of each whole text."""
        ids, ends = self.encode_flat(texts)
        raw, at = memoryview(np.ascontiguousarray(ids)).cast("B"), (ends * 4).tolist()
        return [bytes(raw[a:b]) for a, b in zip(at, at[1:])]

    def encode(self, text: bytes | None) -> bytes:
        return self.encode_many([text])[0]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """A batch in slices of a few rows and bytes (one row at least) with their texts."""
    texts = batch.column(column).cast(pa.large_binary())
    size, low = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 0
    while low < len(size):
        n = max(1, int(np.searchsorted(np.cumsum(size[low : low + SLICE_ROWS]), SLICE_BYTES, "right")))
        yield batch.slice(low, n), texts.slice(low, n).to_pylist()
        low += n


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def default_path() -> str:
    """The public word-end BPE file; a parameter wherever it is used."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
