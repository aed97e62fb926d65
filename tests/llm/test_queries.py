"""The registered queries over whole test tables, against their SQL or brute force."""

from __future__ import annotations

import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_documents import brute_spans
from test_tokens import check_packed
from tokenizers import Tokenizer

from tyche.llm import packing, quality, secrets
from tyche.llm.queries import ORACLE, QUERIES
from tyche.llm.shared import table

SMALL, MIDDLE, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}


def ids_of(file, texts, end):
    library = Tokenizer.from_file(public_tokenizers.path(file))
    return [np.array([*e.ids, *end], "<u4") for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found, wanted = QUERIES[name](spark, SMALL), db.sql(ORACLE[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    rows = sorted(map(tuple, found.select(columns).collect()), key=str)
    assert rows == sorted(wanted.select(*columns).fetchall(), key=str) and rows


def test_packed_table(spark, texts):
    rows = QUERIES["op1_best_fit_packing"](spark, SMALL).collect()
    wanted = dict(zip(texts, ids_of("byte_bpe_50k.json", list(texts.values()), [0]), strict=True))
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        ids, before = wanted[r.doc_id], by.setdefault(r.doc_id, [])
        assert r.piece == len(before) and r.start == sum(before) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        before.append(r.length)
    assert {k: sum(v) for k, v in by.items()} == {k: len(v) for k, v in wanted.items()}
    assert all(len(v) == 1 or v[1:] == [2048] * (len(v) - 1) for v in by.values())
    lengths = [r.length for r in rows]
    assert check_packed(rows, 2048) == packing.lower_bound({x: lengths.count(x) for x in lengths}, 2048)


def test_stored_table(spark, texts):
    at = 0
    rows = sorted(QUERIES["op2_token_store"](spark, SMALL).collect())
    ids = ids_of("word_bpe_49k.json", [texts[k] for k in sorted(texts)], [1])
    for r, k, own in zip(rows, sorted(texts), ids, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_counted_table(spark, texts):
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op10_token_counts"](spark, SMALL).collect()}
    counts = dict(zip(texts, map(len, ids_of("word_bpe_49k.json", list(texts.values()), [])), strict=True))
    assert found == {k: (len(t.encode()), counts[k], counts[k] > 2048) for k, t in texts.items()}


def test_scanned_table(spark, texts):
    rows = QUERIES["op3_secret_scan"](spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        base = brute_spans(texts[r.doc_id])
        own = [s for s in r.spans.split(",") if s and not s.startswith("net:")]
        assert ",".join(own) == base and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(f"{k}:") for k in ("assign", "access", "hex"))


def test_the_network_keeps_the_recall_on_the_table(spark):
    windows, labels, keys = secrets.labelled_candidates(table(spark, MIDDLE, "documents"))
    net = secrets.train(windows, labels, keys)
    assert 0 < labels.mean() < 1 and net.recall >= 0.99 and net.threshold <= 1


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="needs the test tables")
def test_planted_keys_of_no_pattern_are_found_on_the_table(spark):
    """Keys too short or of another case than the patterns say, without a keyword, put into documents of the table.

    The keys of this table are hexadecimal, so that is the form that can be learnt from it.
    """
    rng = np.random.default_rng(5)
    kinds = [lambda: "".join(rng.choice(list("0123456789abcdef"), 14)) + "0a", lambda: "".join(rng.choice(list("0123456789ABCDEF"), 24))]
    docs = table(spark, LARGE, "documents").select("doc_id", "text").filter("text is not null")
    planted = [(r.doc_id, kinds[k % 2]()[: 14 + 10 * (k % 2)]) for k, r in enumerate(docs.select("doc_id").orderBy("doc_id").limit(200).collect())]
    middle = F.expr("length(text) div 2")
    texts = docs.join(spark.createDataFrame(planted, "doc_id long, key string"), "doc_id", "left").withColumn("at", F.when(F.col("key").isNotNull(), middle + 1))
    texts = texts.withColumn("text", F.when(F.col("key").isNull(), F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), middle), F.lit(" "), "key", F.lit(" "), F.substring("text", middle + 1, F.length("text"))))).cache()
    spans = {r.doc_id: r.spans.split(",") for r in secrets.scan(texts).select("doc_id", "spans").collect()}
    places = {r.doc_id: f"net:{r.at}:{r.at + len(r.key)}" for r in texts.filter("key is not null").select("doc_id", "at", "key").collect()}
    found = [[places[i] in spans[i] for i, _ in planted[kind::2]] for kind in range(2)]
    false = sum(s.startswith("net:") and s != places.get(i) for i, all_ in spans.items() for s in all_)
    assert min(map(np.mean, found)) >= 0.9, [np.mean(x) for x in found]
    assert false <= 2 * texts.agg(F.sum(F.length("text"))).first()[0] / 1e6, false


def test_scored_table(spark):
    rows = QUERIES["op6_quality_classifier"](spark, MIDDLE).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    marks = {r.doc_id: r.quality for r in table(spark, MIDDLE, "labels").filter("quality is not null").collect()}
    held = [(r.score, marks[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in marks]
    good, bad = [s for s, m, _ in held if m], [s for s, m, _ in held if not m]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.98
    assert np.mean([m == p for _, m, p in held]) > 0.93


def test_a_score_reads_the_text_alone(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert sorted(quality.quality_scores(docs, labels).collect()) == sorted(quality.quality_scores(changed, labels).collect())
    held = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality.quality_scores(docs, held).collect()) == sorted(quality.quality_scores(docs, labels).collect())
