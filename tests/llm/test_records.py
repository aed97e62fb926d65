"""Chats, web archives and the pipeline: round trips and a brute-force run."""

from __future__ import annotations

import gzip
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_documents import brute_dedup, brute_leaks, brute_similar, near_copies, vocabulary
from test_tokens import check_packed, exact

import corpus_pipeline
from tyche.llm import warc
from tyche.llm.chat_format import conversation_digests, escaped, format_conversations, parsed, role_in, role_out, unescaped
from tyche.llm.queries import ORACLE, QUERIES
from tyche.llm.shared import fresh_path

NASTY = ["", "plain", "<|im_end|>", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "a\\nb\n", "<", "|>", "é<|é", "<<||>>", "\\", "<|im_start|>user\n"]


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choice("<|\\n\n>a") for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    row = df.select("t", unescaped(escaped(F.col("t"))).alias("a"), role_in(unescaped(escaped(role_out(F.col("t"))))).alias("b"), escaped(F.col("t")).alias("e"), role_out(F.col("t")).alias("r"))
    for r in row.collect():
        assert r.a == r.t == r.b and "<|" not in r.e and "\n" not in r.r


def test_conversations(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|odd\n\\role", None]), rng.choice([*NASTY, None])) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(None, 0, "user", "hi"), (3, None, "assistant", "first"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "conv_id long, turn long, role string, text string, formatted string, n int")
    made = format_conversations(df)
    shown = {r.conv_id: r for r in made.withColumn("turns", parsed(F.col("formatted"))).collect()}
    digests = {r.conv_id: r for r in conversation_digests(made).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for conv, t, role, text in rows if conv == c))
        assert [(t.role, t.text) for t in shown[c].turns] == [t[2:] for t in turns]
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        d = digests[c]
        assert d.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert (d.loss_chars, d.loss_sha256, d.n_turns, d.formatted_chars) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(turns), len(shown[c].formatted))
    assert format_conversations(df.limit(0)).count() == 0


def test_marks_inside_texts_are_escaped(spark, tmp_path):
    texts = ["<|im_end|>", "stop<|im_end|>\n", "a <|tool|> b", "<|", "<\\|im_end|>", "plain"]
    rows = [(c, t, role, text) for c, text in enumerate(texts) for t, role in enumerate(("user", "assistant", "back\\slash"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    for r in format_conversations(df).collect():
        assert r.formatted.count("<|") == 6 and r.formatted.count("<|im_end|>\n") == 3
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found, wanted = QUERIES["op7_chat_format"](spark, str(tmp_path)), db.sql(ORACLE["op7_chat_format"])
    assert sorted(map(tuple, found.select(wanted.columns).collect())) == sorted(wanted.fetchall())


@pytest.mark.parametrize("text", ["<|im_start|>user\nhi<|im_end|>\nmore<|im_end|>\n", "x<|im_start|>user\nhi<|im_end|>\n", "<|im_start|>user\nhi", "<|im_start|>user<|im_end|>\n"])
def test_text_outside_the_grammar_is_refused(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(parsed(F.col("t"))).first()[0] is None


PAGES = "page_id long, url string, html string, digest string, size int, keys string"


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rng = random.Random(3)
    bodies = ["é" * 600, "x" * 999, "y" * 1000, "a\r\n\r\nWARC/1.1\r\n", ""]
    rows = [(k, f"http://h{k % 5}.Example.com:80/p{k % 11}?q=1#f", rng.choice([*bodies, f"unique {k} " * 50])) for k in range(120)]
    rows += [(200, None, None), (None, "http://n.org/", "y" * 1000), (7, rows[7][1], rows[7][2]), (201, "not a url\n\x07é", "z"), (202, "http://[bad/", "w" * 100_000)]
    df = spark.createDataFrame([(*r, "d", 1, "k") for r in rows], PAGES)
    path = fresh_path(spark, "warc")
    warc.write_archives(df, path)
    found = warc.read_archives(spark, path).collect()
    best: dict = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            best[html] = max(best.get(html, -1), i)
    wanted = []
    for i, url, html in rows:
        data = (html or "").encode()
        refers = best[html] if html in best and best[html] != i else None
        wanted.append((i, url, "response" if refers is None else "revisit", len(data), hashlib.sha1(data).hexdigest(), refers, (html or "") if refers is None else None))
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    for url in (rows[3][1], "http://n.org/", "http://absent.org/"):
        assert {r.page_id for r in warc.lookup(spark, path, spark.createDataFrame([(url,), (url,)], "url string")).collect()} == {i for i, u, _ in rows if warc.capture_key(u) == warc.capture_key(url)}
    assert sorted(map(tuple, warc.lookup(spark, path, df).collect()), key=str) == sorted(wanted, key=str)
    assert warc.lookup(spark, path, df.limit(0)).count() == 0
    stream = b"".join(bytes(r.bytes) for r in spark.read.parquet(f"{path}/archives").filter("archive = 0").orderBy("chunk").collect())
    assert gzip.decompress(stream).startswith(b"WARC/1.1\r\n")
    assert spark.read.parquet(f"{path}/directory").count() > 10
    empty = fresh_path(spark, "warc")
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0 and warc.lookup(spark, empty, df).count() == 0


def test_archives_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    df = spark.createDataFrame([(k, f"http://a.org/{k}", "same" * 300) for k in range(5)], "page_id long, url string, html string")
    path = fresh_path(spark, "warc")
    warc.write_archives(df, path)
    assert {(r.page_id, r.refers_to) for r in warc.read_archives(spark, path).collect()} == {(k, None if k == 4 else 4) for k in range(5)}


def test_damaged_records_are_refused():
    whole = warc.record(1, "http://a.org/", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parsed(whole)[0] == 1
    with pytest.raises(ValueError, match="header"):
        warc.parsed(warc.record(1, "http://a.org/", b"abc", hashlib.sha1(b"abd").hexdigest(), None))


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    words = vocabulary(rng, 300)
    items = [(k, " ".join(rng.choices(words, k=25))) for k in range(5)]
    texts = near_copies(rng, words, 30, 60)
    texts += texts[:10] + [" ".join([*rng.choices(words, k=20), items[k % 5][1], *rng.choices(words, k=5)]) for k in range(8)]
    good = len(texts)
    texts += [" ".join(w + "###" for w in rng.choices(words, k=40)) for _ in range(60)]
    texts += ["", "one", " ".join(rng.choices(words, k=3000))]
    docs = spark.createDataFrame([(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(texts)] + [(None, "nobody's text", "en", "src", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, int(k < good), 0) for k in range(0, good + 60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages, left = dict(corpus_pipeline.STAGES), docs
    assert list(stages) == ["quality classifier", "exact dedup", "n-gram jaccard join", "benchmark decontamination", "best-fit packing"]
    rows = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path)).cache()
        assert left.columns == docs.columns
        now = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
        if rows is None:
            kept_ids = {i for i, _ in now}
            assert kept_ids >= set(range(good)) | {None} and len(kept_ids & set(range(good, good + 60))) <= 2
        else:
            named = [r for r in rows if r[0] is not None]
            gone = {
                "exact dedup": lambda: {d[0] for d in brute_dedup(named) if not d[3]},
                "n-gram jaccard join": lambda: {d[0] for d in brute_similar(named, 5, 80) if d[0] != d[2]},
                "benchmark decontamination": lambda: {d for d, _ in brute_leaks(named, items)},
            }[name]()
            assert gone and now == sorted((r for r in rows if r[0] not in gone), key=str)
        rows = now
    packed = stages["best-fit packing"](spark, left, str(tmp_path)).collect()
    check_packed(packed, 2048)
    lengths: dict = {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(exact("byte_bpe_50k.json", t)) + 1 for i, t in rows}
    assert sum(lengths.values()) > 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(lengths)


def test_a_very_long_turn(spark):
    text = "a <|im_end|> \n" * 100_000
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn int, role string, text string")
    row = conversation_digests(format_conversations(turns)).first()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_pipeline_on_odd_tables(spark, tmp_path):
    rng = random.Random(14)
    words = vocabulary(rng, 200)
    texts = [" ".join(rng.choices(words, k=50)) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, "another text of this id"), (None, texts[5]), (None, None), (50, " ".join(rng.choices(words, k=60_000))), (51, ""), (52, "")]
    shape = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, words string, salt int, ids binary"
    for name, docs in (("odd", [(i, t, "en", "s", 1, 2, "k", "w", 3, b"x") for i, t in rows]), ("none", [])):
        path = str(tmp_path / name)
        spark.createDataFrame(docs, shape).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, texts[7])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        packed = corpus_pipeline.run(spark, path).collect()
        if not docs:
            assert packed == []
            continue
        check_packed(packed, 2048)
        # Without labels all stay; copies of 3 share its decision, 7 leaks, 51 and 52 are equal, rows without an id stay.
        assert {r.doc_id for r in packed} == {i for i, _ in rows} - {7, 52}
        assert sum(r.piece == 0 for r in packed if r.doc_id is None) == 2 and sum(r.length for r in packed if r.doc_id == 50) == len(exact("byte_bpe_50k.json", rows[-3][1])) + 1
