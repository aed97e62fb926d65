"""Quality classifier: a factorisation machine over hashed words, word shapes, structure statistics and length.

A document's score is the logistic of ``w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)``: all
pairwise interactions of its features, by the sum-of-squares identity in time linear in their number.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import Kept
from .shared import kept, mapped
from .token_counts import balanced

#: Labelled rows that may train the model (those with the smallest hashes of their id), and the bytes of all their features.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 64 << 20
#: Hashed features, the rank of the interactions, and the bins of a statistic.
BUCKETS, RANK, BINS = 1 << 16, 8, 12
STATISTICS = 12
LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")
UPPER, DIGITS, MARKS = bytes(range(65, 91)), bytes(range(48, 58)), bytes(x for x in range(33, 127) if not chr(x).isalnum())
SHAPE = bytes(ord("A") if 65 <= x <= 90 else ord("a") if 97 <= x <= 122 or x >= 128 else ord("0") if 48 <= x <= 57 else x for x in range(256))


def statistics(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Structure of a whole text as numbers in 0..1."""
    size, many = max(1, len(text)), max(1, len(words))
    lines = text.split(b"\n")
    letters = lambda drop: (len(text) - len(text.translate(None, drop))) / size
    return [
        min(1.0, np.log1p(len(text)) / 16), min(1.0, np.log1p(len(words)) / 14), min(1.0, size / many / 20), letters(UPPER), letters(DIGITS), letters(MARKS),
        len(counts) / many, max(counts.values(), default=0) / many, min(1.0, many / len(lines) / 200), len(set(lines)) / len(lines),
        sum(n for n in counts.values() if n > 1) / many, min(1.0, len(max(counts, key=len, default=b"")) / 60),
    ]


def places(word: bytes) -> tuple[int, int]:
    """Buckets of a word's letters, lower-cased, and of its shape: runs of upper case, lower case and digits shortened."""
    from xxhash import xxh32_intdigest

    core = LETTERS.search(word)
    shape = re.sub(rb"a+", b"a", re.sub(rb"A+", b"A", re.sub(rb"0+", b"0", word.translate(SHAPE))))
    return xxh32_intdigest(core[0].lower() if core else b"") % BUCKETS, xxh32_intdigest(b"shape " + shape) % BUCKETS


#: Buckets of the words that a worker has met.
PLACES = Kept(places, 100_000)


def features(text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Bucket numbers and values of the hashed words and shapes, and the statistics; one pass over the whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    counts = Counter(words)
    hashed: dict[int, int] = {}
    for (core, shape), n in zip(map(PLACES.__getitem__, counts), counts.values(), strict=True):
        hashed[core] = hashed.get(core, 0) + n
        hashed[shape] = hashed.get(shape, 0) + n
    at = np.fromiter(hashed.keys(), np.int64, len(hashed))
    x = np.log1p(np.fromiter(hashed.values(), np.float64, len(hashed)))
    norm = np.sqrt((x * x).sum()) or 1.0
    return at, (x / norm).astype(np.float32), statistics(data, words, counts)


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    edges: np.ndarray

    def inputs(self, at: np.ndarray, x: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Words and one indicator for the bin of each statistic."""
        bins = [BUCKETS + k * BINS + int(np.searchsorted(e, s, "right")) for k, (e, s) in enumerate(zip(self.edges, stats, strict=True))]
        return np.append(at, np.array(bins, at.dtype)), np.append(x, np.full(len(bins), 0.5, np.float32))

    def logit(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        total = v.sum(0)
        return self.bias + float(self.linear[at] @ x) + 0.5 * float(total @ total - (v * v).sum())

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(*self.inputs(*features(text))), -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray, seed: int = 11, updates: int = 36_000) -> FactorisationMachine:
    """AdaGrad on the logistic loss, for about ``updates`` rows in at most 60 passes; each class has half the weight,
    and the bias is moved back to the classes' shares.

    Rows of one class only, or none, give a constant score.
    """
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS * BINS
    stats = np.array([r[2] for r in rows]).reshape(-1, STATISTICS)
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(rows) else np.zeros((STATISTICS, BINS - 1))
    model = FactorisationMachine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32), edges)
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        model.factors[:] = 0
        model.bias = float(np.log((share * len(labels) + 1) / ((1 - share) * len(labels) + 1)))
        return model
    seen = [model.inputs(*r) for r in rows]
    g0, gw, gv = 1e-6, np.full(size, 1e-6, np.float32), np.full((size, RANK), 1e-6, np.float32)
    for _ in range(min(60, max(1, round(updates / len(labels))))):
        for k in rng.permutation(len(labels)):
            at, x = seen[k]
            v = model.factors[at] * x[:, None]
            total = v.sum(0)
            z = model.bias + float(model.linear[at] @ x) + 0.5 * float(total @ total - (v * v).sum())
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[k]) * 0.5 / (share if labels[k] else 1 - share)
            dw = d * x + 1e-5 * model.linear[at]
            dv = d * x[:, None] * (total - v) + 1e-5 * model.factors[at]
            g0 += d * d
            gw[at] += dw * dw
            gv[at] += dv * dv
            model.bias -= 0.1 * d / np.sqrt(g0)
            model.linear[at] -= 0.1 * dw / np.sqrt(gw[at])
            model.factors[at] -= 0.05 * dv / np.sqrt(gv[at])
    model.bias += float(np.log(share / (1 - share)))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> tuple[list, np.ndarray]:
    """Features and labels of a bounded sample of labelled ids whose crc32 is not 0 modulo 5.

    The ``sample_rows`` ids with the smallest hashes, each with one text (that of the smallest hash, where its id is
    repeated) and all its features, as for its score; ids whose features exceed ``sample_bytes`` together are fewer.
    """
    usable = labels.filter("doc_id is not null and quality is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, 1):
            rows = [features(t) for t in batch.column(1).to_pylist()]
            packed = [[r[0].astype("<i4").tobytes() for r in rows], [r[1].tobytes() for r in rows], [np.array(r[2], "<f4").tobytes() for r in rows]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(p, pa.binary()) for p in packed)], ["doc_id", "quality", "at", "x", "stats"])

    found = mapped(texts, run, f"doc_id long, quality {dict(labels.dtypes)['quality']}, at binary, x binary, stats binary")
    sample = kept(found, "training")
    order, total = F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id"), 0
    for r in sample.groupBy(order.alias("place")).agg(F.sum(F.length("at") + F.length("x")).alias("size")).orderBy("place").collect():
        total += r.size
        if total > sample_bytes:
            sample = sample.filter(order < F.struct(F.lit(r.place.hash).alias("hash"), F.lit(r.place.doc_id).alias("doc_id")))
            break
    found = sample.toArrow().sort_by("doc_id")  # its buffers hold the rows' features
    rows = [(np.frombuffer(a.as_buffer(), "<i4"), np.frombuffer(x.as_buffer(), "<f4"), np.frombuffer(s.as_buffer(), "<f4").tolist()) for a, x, s in zip(*(found.column(c) for c in ("at", "x", "stats")), strict=True)]
    return rows, found.column("quality").to_numpy().astype(np.int64)


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, score`` of each row of ``docs``; the score is the probability of label 1, learned from ``sample_rows`` labelled rows at most.

    Only the text is read for a score. A null text counts as empty and gets a score as any other; null ids and
    repeated rows keep their rows; without labels of both classes the score is constant; an empty table gives an
    empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(*training_rows(docs, labels, sample_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.value.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, score double")


def keep_quality(docs: DataFrame, labels: DataFrame, least: float, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``, as :func:`quality_scores` gives it."""
    model = docs.sparkSession.sparkContext.broadcast(train(*training_rows(docs, labels, sample_rows)))
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, text_at):
            yield batch.filter(pa.array([model.value.score(t or "") >= least for t in batch.column(text_at).to_pylist()], pa.bool_()))

    return mapped(docs, run, docs.schema)
