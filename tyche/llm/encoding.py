"""Token ids of whole texts by a public tokenizer that sees each distinct word of a worker once.

A text is cut only where a run of non-space characters ends and white space begins. No pre-tokenizer or
normalizer of the supported vocabularies looks across such a place (white space is either dropped or starts the
next word), so the ids of the pieces, joined, are the ids of the text. Natural text repeats its words: each worker
keeps what it knows of the words seen so far and asks the library only for new ones: for lengths, all new words of
a batch in one call; for ids, words of plain letters and marks go straight to the library's model.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

# The characters with Unicode's property White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
#: Where cutting before each blank would part white space that belongs together.
SPACE_THEN_BLANK = re.compile(f"[{SPACE}] |[{SPACE}]$")
WORD_WITH_SPACE_BEFORE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WORD = re.compile(f"[^{SPACE}]+")
#: What ``str.split`` takes for white space although Unicode's property does not.
ONLY_PYTHON = re.compile("[\x1c-\x1f]")
#: Words that need no normalizer or pre-tokenizer: Latin letters, then marks that never join with letters.
SIMPLE = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,!?%#$&*;:]*)")

#: Words kept by a worker, and the longest of them in characters.
KEPT_WORDS, KEPT_CHARS = 1_250_000, 64
#: Words that the library encodes in one call.
BATCH_WORDS = 8192
#: A longer text is cut at word ends into slices of about this many characters.
SLICE_CHARS = 1 << 20


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """``text`` cut before white space that follows a word."""
    start, cut = 0, re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
    while len(text) - start > size and (found := cut.search(text, start + size)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


class Kept(dict):
    """Values by word, made when first asked for; at most ``most``, and none of words over ``KEPT_CHARS``."""

    def __init__(self, make: Callable[[str], object], most: int = KEPT_WORDS):
        self.make, self.most = make, most

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


class WordEncoder:
    """``words`` are keys of the kept ids: bare words, where the vocabulary drops white space; else a key stands for a
    blank and itself, and the first piece of a text, or any piece of irregular spacing, carries a NUL in front."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre = json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}
        self.bare = any(x.get("behavior") == "Removed" and x.get("invert") for x in pre.get("pretokenizers", [pre]))
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        #: Byte-level vocabularies write printable bytes as themselves, the others as the letters from U+0100.
        self.letters = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in printable)}
        self.cores = Kept(self._model)
        self.known = Kept(self._ids)
        self.counts: dict[str, int] = {}
        probes = ["Stra\xdfe.", "\xc0\xc9ta\xff,", "a", "ing%%%", "Thnterion"]
        self.simple = [self._simple(*SIMPLE.fullmatch(w).groups()) for w in probes] == [self._by_library(w if self.bare else " " + w) for w in probes]

    def _model(self, text: str) -> bytes:
        """Ids of one pre-token, by the model alone."""
        if text.isascii() and "\n" not in text:
            spelled = text.replace(" ", "\u0120")
        else:
            spelled = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def _simple(self, letters: str, marks: str, blank: bool = True) -> bytes:
        """Ids of a word of letters and marks, each part a pre-token; after a ``blank``, where the vocabulary keeps it."""
        letters = letters.lower() if self.bare else " " + letters if blank else letters
        return self.cores[letters] + self.cores[marks] if marks else self.cores[letters]

    def _ids(self, word: str) -> bytes:
        first = not self.bare and word[:1] == "\0"
        lines = [SIMPLE.fullmatch(line, first and not k) for k, line in enumerate(word.split("\n"))] if self.simple else [None]
        if None in lines:
            return self._by_library(self._spelled(word))
        ids = self._simple(*lines[0].groups(), not first)
        for line in lines[1:]:  # a line end alone between words is a pre-token of its own
            ids += self.cores["\n"] + self._simple(*line.groups(), False)
        return ids

    def _spelled(self, word: str) -> str:
        """The text that a key stands for."""
        return word if self.bare else word[1:] if word[:1] == "\0" else " " + word

    def _by_library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        if self.bare:
            return WORD.findall(text) if ONLY_PYTHON.search(text) else text.split()
        if not text or "\0" in text or SPACE_THEN_BLANK.search(text):
            return ["\0" + x for x in WORD_WITH_SPACE_BEFORE.findall(text)]
        first, *rest = text.split(" ")
        return ["\0" + first, *rest] if first else rest

    def ids(self, text: str) -> bytes:
        """All ids as little-endian unsigned 32-bit integers."""
        return b"".join(b"".join(map(self.known.__getitem__, self.words(x))) for x in slices(text))

    def _known(self, words: set[str]) -> dict[str, int]:
        """The lengths of ``words``; new ones by the library, in batches."""
        found = {w: self.counts[w] for w in words if w in self.counts}
        new = list(words - found.keys())
        for k in range(0, len(new), BATCH_WORDS):
            part = new[k : k + BATCH_WORDS]
            encoded = self.tokenizer.encode_batch_fast(list(map(self._spelled, part)), add_special_tokens=False)
            found.update(zip(part, map(len, encoded), strict=True))
        if len(self.counts) + len(new) > KEPT_WORDS:
            self.counts.clear()
        self.counts.update((w, found[w]) for w in new[:KEPT_WORDS] if len(w) <= KEPT_CHARS)
        return found

    def lengths(self, texts: list[str]) -> list[int]:
        """The number of ids of each text; slices are looked up together, about ``SLICE_CHARS`` characters at a time."""
        counts, held, size = [0] * len(texts), [], 0

        def count() -> None:
            known = self._known(set().union(*(words for _, words in held)))
            for k, words in held:
                counts[k] += sum(map(known.__getitem__, words))

        for k, text in enumerate(texts):
            for part in slices(text):
                held.append((k, self.words(part)))
                size += len(part)
                if size > SLICE_CHARS:
                    count()
                    held, size = [], 0
        count()
        return counts


class PieceEncoder:
    """Lengths by the sentencepiece library, for its ``.model`` files."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.encode = SentencePieceProcessor(model_file=path).encode

    def lengths(self, texts: list[str]) -> list[int]:
        return list(map(len, self.encode(texts, out_type=int, num_threads=1)))


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary and Python worker; a task keeps to its core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PieceEncoder(path) if path.endswith(".model") else WordEncoder(path)
