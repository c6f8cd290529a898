"""Token ids of whole texts, by the ``tokenizers`` library.

``LibraryEncoder`` gives whole texts to the library.  ``ByteEncoder`` does less of the
same work for a byte-level vocabulary: such a vocabulary cuts a text into words first
and encodes each word by itself, so each different word goes to the library once and its
ids are kept.  The cutting is done here for texts of long-settled characters, whose
letter, digit and space classes are those of ``\\p{L}``, ``\\p{N}`` and ``\\s`` everywhere
(``tests/llm`` goes through all of them); a text with any other character or with one of
the vocabulary's special strings goes to the library whole.  ``WordEncoder`` is the same for
a vocabulary of lower-case words with word ends, which drops white space: what stands between
white space is encoded by itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

_held: dict[tuple, object] = {}
#: Anything but characters whose classes all Unicode versions and patterns agree on.
_OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-±´-¸º»¿-ɏΑ-ΡΣ-Ωα-ωА-я‐-‧‰-⁞一-龥가-힣]")
#: How the library's byte-level pre-tokenizer cuts words, for all other texts.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held(kind, *args):
    """One encoder of a kind for each worker process."""
    if (kind, *args) not in _held:
        _held[kind, *args] = kind(*args)
    return _held[kind, *args]


class LibraryEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _alphabet() -> dict[int, int]:
    """The character for each byte in a byte-level vocabulary's words: printable Latin-1
    stands for itself, the rest follow from U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 0x100 + i for i, b in enumerate(rest)}


class _Words(dict):
    """The ids of each word as bytes, from the library's model.  Words of more than 64
    characters are not kept.  When it holds ``most`` words they become the older ones,
    from which those met again come back, and the oldest go."""

    def __init__(self, library: LibraryEncoder, most: int):
        self.cut, self.most, self.older, self.bytes = library.tokenizer.model.tokenize, most, {}, _alphabet()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", [t.id for t in self.cut(word.encode().decode("latin-1").translate(self.bytes))]).tobytes()
        if len(word) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class ByteEncoder:
    def __init__(self, path: str, most: int = 500_000):
        self.library = held(LibraryEncoder, path)
        self.words = _Words(self.library, most)
        with open(path) as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]

    def plain(self, text: str) -> bool:
        return not _OTHER.search(text) and not any(s in text for s in self.special)

    def _ids(self, text: str) -> np.ndarray:
        if self.plain(text):
            return np.frombuffer(b"".join(map(self.words.__getitem__, _WORD.findall(text))), "<u4")
        return np.array(self.library.encode([text])[0], "<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._ids(t) for t in texts]


#: Two of those characters have lower cases that depend on their place or are two characters.
_CASED = re.compile(f"{_OTHER.pattern}|[Σİ]")
#: How the library's pre-tokenizer cuts lower-cased text with word ends.
_ENDED = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class _Chunks(_Words):
    """The ids of each string between white space, as bytes; kept as words are."""

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = array("I", [t.id for w in _ENDED.findall(chunk.lower()) for t in self.cut(w.encode().decode("latin-1").translate(self.bytes))]).tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class WordEncoder(ByteEncoder):
    def __init__(self, path: str, most: int = 500_000):
        super().__init__(path, most)
        self.words = _Chunks(self.library, most)

    def plain(self, text: str) -> bool:
        other = any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else _CASED.search(text)
        return not other and not any(s in text for s in self.special)

    def _ids(self, text: str) -> np.ndarray:
        if self.plain(text):
            return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), "<u4")
        return np.array(self.library.encode([text])[0], "<u4")


def encoder_of(path: str):
    """The encoder for a vocabulary file: ``WordEncoder`` where the file says that it lower-cases,
    drops white space and cuts words as that does, else the library alone."""
    with open(path) as f:
        kind = json.load(f)
    steps = kind.get("pre_tokenizer") or {}
    cut = [s.get("pattern", {}).get("Regex") for s in steps.get("pretokenizers", ())]
    lower = [s["type"] for s in (kind.get("normalizer") or {}).get("normalizers", ())]
    own = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    same = kind["model"].get("end_of_word_suffix") == "</w>" and lower == ["NFC", "Replace", "Lowercase"] and cut[:1] == [own]
    return held(WordEncoder if same else LibraryEncoder, path)
