"""Token counts, packing and the token store against the tokenizers library itself."""

from __future__ import annotations

import itertools
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tyche.llm import encoding, packing
from tyche.llm.encoding import WordEncoder, slices
from tyche.llm.shared import fresh_path
from tyche.llm.token_counts import count_tokens
from tyche.llm.token_store import read_token_store, write_token_store

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = [
    "", " ", "  a", "a ", "a\n\nb", " a\n b", "a\x1cb c", "x  y", "á ́b", "<|endoftext|> a <|endoftext|>b", "it's 'S don't", "a\x00b c", "Ġa b Ġ", "ΑΣ ΑΣ. Σ", "İ ǅ",
    "a" * 100 + " b", "1 23 ½ ²", "\t\tq\r\n w", "e f 　g", "日本 語 日本", "😀 😀a", "\0a b", "Straße. ÿ ÀÉ!! Ö.,; ß?", "x×y ÷ a.b a.,!",
]
DOCS = "doc_id long, text string, lang string, ids binary, length int"


def exact(path, text):
    return Tokenizer.from_file(public_tokenizers.path(path)).encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = public_tokenizers.path(request.param)
    return WordEncoder(path), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" \n\ta<|>b.'s é́\x1c\x01\0Ġ1ÀΣ", "<|endoftext|>"]), max_size=40))
def test_any_text(pair, parts):
    (own, library), text = pair, "".join(parts)
    wanted = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.ids(text), "<u4").tolist() == wanted and own.lengths([text, "", text]) == [len(wanted), 0, len(wanted)]


def test_odd_texts_and_slices(pair):
    own, library = pair
    for text in ODD:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    long = " ".join(ODD) * 30
    assert "".join(slices(long, 50)) == long and len(list(slices(long, 50))) > 10
    assert [sum(own.lengths(list(slices(long, 50))))] == own.lengths([long]) == [len(own.ids(long)) // 4]


def test_lengths_with_a_small_memory(pair, monkeypatch):
    own, library = pair
    monkeypatch.setattr(encoding, "KEPT_WORDS", 3)
    monkeypatch.setattr(encoding, "BATCH_WORDS", 2)
    monkeypatch.setattr(encoding, "SLICE_CHARS", 20)
    assert own.lengths(ODD) == [len(e) for e in library.encode_batch(ODD, add_special_tokens=False)] and len(own.counts) <= 3


def test_lengths_by_sentencepiece(spark):
    from sentencepiece import SentencePieceProcessor

    models = sorted(x for x in os.listdir(os.path.dirname(public_tokenizers.path(FILES[0]))) if x.endswith(".model"))
    path = public_tokenizers.path(models[0])
    own = SentencePieceProcessor(model_file=path)
    rows = {(r.doc_id, r.n_tokens) for r in count_tokens(table(spark, CASES), path).collect()}
    assert rows == {(i, len(own.encode(t or ""))) for i, t in CASES}


def table(spark, rows):
    """Rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", b"x", 7) for i, t in rows], DOCS)


CASES = [(3, "one two"), (1, None), (None, "no id"), (2, ""), (3, "one two"), (9, "word " * 3000), (4, "one two")]


def test_counts(spark):
    rows = {(r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(table(spark, CASES), public_tokenizers.path(FILES[1])).collect()}
    assert rows == {(i, len((t or "").encode()), len(exact(FILES[1], t or ""))) for i, t in CASES}
    assert count_tokens(table(spark, []), public_tokenizers.path(FILES[1])).count() == 0


def test_token_store(spark):
    path = fresh_path(spark, "store")
    write_token_store(table(spark, CASES), path, public_tokenizers.path(FILES[1]))
    rows = sorted(read_token_store(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == [None, 1, 2, 3, 3, 4, 9]
    at = 0
    for r in rows:
        text = {None: "no id", 9: "word " * 3000, 3: "one two", 4: "one two"}.get(r.doc_id, "")
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == [*exact(FILES[1], text), 1]
        at += r.n_tokens
    assert [(r.doc_id, r.start) for r in read_token_store(spark, path, (4, 4)).collect()] == [(4, rows[5].start)]
    empty = fresh_path(spark, "store")
    write_token_store(table(spark, []), empty, public_tokenizers.path(FILES[1]))
    assert read_token_store(spark, empty).count() == 0


def test_store_with_a_dictionary(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(200))) for k in range(300)]
    path = fresh_path(spark, "store")
    write_token_store(table(spark, docs), path, public_tokenizers.path(FILES[1]))
    assert len(spark.read.parquet(f"{path}/dictionary").first().dictionary) > 0
    assert {r.doc_id: bytes(r.ids) for r in read_token_store(spark, path).collect()} == {i: np.array([*exact(FILES[1], t), 1], "<u4").tobytes() for i, t in docs}


def check_packed(rows, capacity):
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packed_documents(spark):
    rows = packing.pack_documents(table(spark, CASES), public_tokenizers.path(FILES[0]), 64).collect()
    check_packed(rows, 64)
    nine = sorted((r for r in rows if r.doc_id == 9), key=lambda r: r.piece)
    whole = np.array([*exact(FILES[0], "word " * 3000), 0], "<u4").tobytes()
    assert b"".join(bytes(r.ids) for r in nine) == whole and all(r.length == 64 for r in nine[1:])
    assert [r.start for r in nine] == [0, *np.cumsum([r.length for r in nine])[:-1]]
    assert len(rows) == len(CASES) - 1 + len(nine)
    assert packing.pack_documents(table(spark, []), public_tokenizers.path(FILES[0])).count() == 0
    crc = packing.pack_documents(table(spark, CASES[:1]), public_tokenizers.path(FILES[0])).select(F.crc32("ids")).first()[0]
    assert crc == zlib.crc32(np.array([*exact(FILES[0], "one two"), 0], "<u4").tobytes())


def fewest_bins(items, capacity):
    """Brute force over all assignments of a few items."""
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity:
                bins[i] += items[k]
                place(k + 1, bins)
                bins[i] -= items[k]
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.randint(8, 40)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 11))), reverse=True)
        histogram = {x: items.count(x) for x in items}
        patterns = packing.bin_completion(histogram, capacity)
        held: dict = {}
        for filling, many in patterns:
            assert sum(x * n for x, n in filling) <= capacity
            for x, n in filling:
                held[x] = held.get(x, 0) + n * many
        assert held == histogram
        assert sum(m for _, m in patterns) == fewest_bins(items, capacity) >= packing.lower_bound(histogram, capacity)


def test_completion_beats_best_fit():
    histogram = {6: 1, 5: 1, 4: 2, 3: 2, 2: 1}  # 6+4, 5+3+2, 4+3: best-fit decreasing finds as many or more
    assert sum(m for _, m in packing.bin_completion(histogram, 9)) == fewest_bins([6, 5, 4, 4, 3, 3, 2], 9)
    assert packing.bin_completion({}, 10) == []


def test_completion_looks_beyond_the_first_filling_without_waste():
    lengths = [60, 59, 58, 32, 30, 20, 20, 11, 10]  # 60+20+20, 59+30+11, 58+32+10
    assert sum(m for _, m in packing.bin_completion({x: lengths.count(x) for x in lengths}, 100)) == 3


def test_the_search_beats_best_fit_on_whole_sequences():
    histogram = {1228: 20, 1208: 20, 1188: 20, 655: 20, 614: 20, 410: 40, 226: 20, 205: 20}  # 1228+410+410, 1208+614+226, 1188+655+205
    greedy = sum(m for _, m in packing.best_fit(histogram, 2048))
    found = packing.bin_completion(histogram, 2048)
    assert sum(m for _, m in found) == packing.lower_bound(histogram, 2048) == 60 < greedy


def test_a_bound_by_number_ends_the_search():
    rng = random.Random(6)
    histogram: dict[int, int] = {}
    for x in (rng.randint(600, 682) for _ in range(1000)):
        histogram[x] = histogram.get(x, 0) + 1
    assert packing.lower_bound(histogram, 2048) == 334 == sum(m for _, m in packing.bin_completion(histogram, 2048, nodes=0))


def test_fillings_are_all_undominated_ones():
    rng = random.Random(5)
    for _ in range(200):
        space, left = rng.randint(5, 40), {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(1, 7))}
        lengths = sorted(left, reverse=True)
        found = list(packing.fillings(space, lengths, left, iter(range(10**6))))
        wanted = set()
        for counts in itertools.product(*(range(left[x] + 1) for x in lengths)):
            items = tuple((x, n) for x, n in zip(lengths, counts, strict=True) if n)
            waste = space - sum(x * n for x, n in items)
            spare = [x for x, n in zip(lengths, counts, strict=True) if n < left[x]]
            if waste >= 0 and not any(x <= waste or any(y < x <= y + waste for y, _ in items) for x in spare):
                wanted.add((items, waste))
        if space in left:
            wanted = {(((space, 1),), 0)}
        assert len(found) == len(set(found)) and set(found) == wanted


def test_many_tiny_pieces(spark):
    assert sum(m for _, m in packing.bin_completion({1: 5000}, 2048)) == 3
    assert next(packing.fillings(5000, [1], {1: 5000}, iter(range(9)))) == (((1, 5000),), 0)
    rows = packing.pack_documents(table(spark, [(k, "") for k in range(5000)]), public_tokenizers.path(FILES[0]), 2048).collect()
    check_packed(rows, 2048)
    assert len(rows) == 5000 and len({r.sequence_id for r in rows}) == 3
