"""SentencePiece ids of whole texts, and texts of ids, for vocabularies of the merge type.

The library merges, again and again, the two neighbours whose union is the best piece (the leftmost of equal ones).
A row of pieces is its result exactly if every two neighbours, merged anew from their characters, come out as those
two: as long as no merge crosses a border, what happens left and right of it does not depend on the rest. So
encoding looks for such a row: from each place it takes the longest piece that fits its left neighbour, then shorter
ones, and goes back when none is left; a bit for each place tells whether a row that ends there is known to lead
nowhere, so no place is tried twice and the work is linear in the text.

No piece holds a space mark after another character, so words with the spaces before them are encoded apart, each
distinct word once per worker.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .encoding import Kept
from .shared import mapped
from .token_counts import balanced

#: What the library writes for a space.
MARK = "▁"
#: Pairs of pieces kept by a worker, parts of words, and words (some 230 bytes each).
KEPT_PAIRS, KEPT_CORES, KEPT_WORDS = 300_000, 250_000, 1_000_000


class PieceCoder:
    """Ids and texts by the file of a sentencepiece model; raises for models of another type or with a normalizer."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model_file

        model = model_file.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds, spec, trained = model_file.ModelProto.SentencePiece, model.normalizer_spec, model.trainer_spec
        plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and spec.escape_whitespaces
        whole = all(p.type in (kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN) for p in model.pieces)
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix or not plain or not whole:
            raise ValueError("needs a merge-type model with byte fallback and without normalization or symbols of its own")
        #: Piece to id and to score; the ids of single bytes.
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.byte_ids = [library(path).piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.by_words = not any(MARK in p.lstrip(MARK) for p in self.ids)
        # Characters that only longer pieces hold can be merged, but are bytes when they stay alone.
        known = [*self.ids, *({c for p in self.ids for c in p} - self.ids.keys())]
        self.longest = ahocorasick.Automaton()
        for piece in known:
            if self.merged(piece) == [piece]:
                self.longest.add_word(piece, piece)
        #: The longest piece that a piece begins with, itself left out.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if self.longest.exists(p[:n])), None) for p in self.longest.keys()}
        self.longest.make_automaton()
        #: Neighbours that some piece holds; between other characters no merge takes place.
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.fits = Kept(self.fit, KEPT_PAIRS)
        self.cores = Kept(self.core, KEPT_CORES)
        self.words = Kept(self.word, KEPT_WORDS)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging itself: each time the best union of neighbours, the leftmost of equal ones."""
        row, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(row) - 1):
                s = score.get(row[k] + row[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return row
            row[at : at + 2] = [row[at] + row[at + 1]]

    def fit(self, pair: tuple[str, str]) -> bool:
        return self.merged(pair[0] + pair[1]) == [*pair]

    def row(self, text: str) -> list[str]:
        """The pieces of a text; a character that no piece holds stands for itself."""
        longest: list[str | None] = [None] * len(text)
        for end, piece in self.longest.iter(text):
            longest[end - len(piece) + 1] = piece  # matches come by their ends, so the longest is last
        row: list[str] = []
        open_ = bytearray(b"\1") * (len(text) + 1)  # 0: rows that end here lead nowhere
        shorter, fits, at = self.shorter, self.fits, 0
        piece = longest[0] if text else None
        while at < len(text):
            if piece is None and longest[at] is None:
                row.append(text[at])  # bytes, which nothing merges with
                at += 1
            else:
                while piece is not None and not (open_[at + len(piece)] and (not row or fits[row[-1], piece])):
                    piece = shorter[piece]
                if piece is None:  # nothing fits the left neighbour: it has to be another
                    open_[at] = 0
                    piece = row.pop()
                    at -= len(piece)
                    continue
                row.append(piece)
                at += len(piece)
            piece = longest[at] if at < len(text) else None
        return row

    def core(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        row, known = self.row(text), self.ids
        try:
            return array("i", [known[piece] for piece in row]).tobytes()
        except KeyError:
            ids = ([known[p]] if p in known else [self.byte_ids[b] for b in p.encode("utf-8")] for p in row)
            return array("i", chain.from_iterable(ids)).tobytes()

    def word(self, text: str) -> bytes:
        """The same for a word without its first space mark, from the parts that no merge can join."""
        text, inside = MARK + text, self.inside
        cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in inside]
        if not cuts:
            return self.core(text)
        return b"".join([self.cores[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)])])

    def encode(self, text: str) -> np.ndarray:
        """The ids that the library gives for ``text``, without begin and end."""
        if not text:
            return np.empty(0, "i4")
        if not self.by_words:
            return np.frombuffer(self.core(MARK + text.replace(" ", MARK)), "i4")
        if "  " in text or MARK in text or text[-1] == " ":
            words = [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
        else:
            words = text.split(" ") if text[0] != " " else [MARK + w if not k else w for k, w in enumerate(text[1:].split(" "))]
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "i4")


@lru_cache(maxsize=2)
def library(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>`` of each row of ``docs`` by the sentencepiece model at ``model``.

    Rows map one to one: a repeated row is encoded again, a null text counts as empty (no ids), a null id stays null,
    texts of any length are encoded whole, other columns are not read, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for batch in balanced(batches, 1):
            found = [own.encode(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(found)], ["id", "ids"])

    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = StructType([StructField("id", docs.schema[id_col].dataType), StructField("ids", ArrayType(IntegerType()))])
    return mapped(narrow, run, out).withColumnRenamed("id", id_col)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype="i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "i4"), *arrays])))


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The rows of ``encoded(id, ids)`` with ``decoded string``, the library's text of the ids; null ids give an empty text.

    An id outside the vocabulary, or null among the ids, is an error. Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = library(model).decode
        for batch in batches:
            ids = batch.column(1)
            whole, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            texts = [decode(x.tolist()) if len(x) else "" for x in np.split(whole, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    out = StructType([StructField("id", encoded.schema[id_col].dataType), StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return mapped(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, out).withColumnRenamed("id", id_col)
