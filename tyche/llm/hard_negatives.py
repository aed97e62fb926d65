"""Hard negatives by distributed radix selection.

A window is an anchor with a range of scores, of which the first ``need`` rows are wanted: highest scores first, ties
by smaller id. Its rows stand in order of a key, first the distance of their score below the top of the range, then
the id. The key of the last wanted row is found digit by digit: every task scores its rows against a block of
anchors and counts, for each window, the rows by the next digit of the key among those that share the digits found so
far; the counts are added up by Spark, and the digit is the one at which the running count reaches what is still
needed. Once few enough rows lie at or before a key, exactly these are gathered and ranked. Equal scores, however
many, are told apart by the digits of the id, so nothing is capped.

Anchors are a stated set: they pass block by block (a bounded number of vectors, broadcast) over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.edges import numbered
from .centroids import scaled, unusable
from .shared import fresh_path, kept, mapped

#: Anchors of a block, at most, and scores that a task holds at once.
BLOCK, SCORES = 1024, 1 << 20
#: Bits of a digit; windows of at most so many rows beyond those wanted are gathered without further digits.
BITS, SPARE = 8, 64


@dataclass
class Windows:
    """Windows of one block of anchors; ``anchor`` is a place in the block, in ascending order.

    A row's key is ``high - score``, then its id less the smallest id. The digits found so far are those of ``far``
    and ``id``; of the rows whose keys begin with them, the first ``need`` are wanted.
    """

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    need: np.ndarray
    far: np.ndarray
    id: np.ndarray

    @classmethod
    def start(cls, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, need: int) -> Windows:
        zero = np.zeros(len(anchor), "i8")
        return cls(anchor, low, high, zero + need, zero.copy(), zero.astype("u8"))


@dataclass
class Anchors:
    """A block: ids, labels and vectors, these by their length with the places they belong to; and the smallest id of all rows."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: dict[int, tuple[np.ndarray, np.ndarray]]
    lowest: int

    @classmethod
    def of(cls, rows: list, lowest: int) -> Anchors:
        sizes = [len(r.v) for r in rows]
        places = {n: np.array([k for k, m in enumerate(sizes) if m == n]) for n in set(sizes)}
        vectors = {n: (at, np.array([rows[k].v for k in at], "i8").reshape(len(at), n)) for n, at in places.items()}
        return cls(np.array([r.vec_id for r in rows], "i8"), np.array([r.label for r in rows], "i8"), vectors, lowest)

    def steps(self, ids: np.ndarray) -> np.ndarray:
        """How far ids are above the smallest one, without a sign."""
        return ids.astype("u8") - np.array(self.lowest, "i8").astype("u8")


def usable_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id long, label int, v array<int>`` of the rows that take part, each id once.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; of rows that repeat an
    id, the one with the smallest label, then vector, does. Labels change as :func:`mined` says; components become
    ``floor(scale * x)``.
    """
    x = F.col("embedding")
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, unusable))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = good.select(F.col("vec_id").cast("long"), F.struct(label.cast("int").alias("label"), F.transform(x, lambda c: scaled(c, scale)).alias("v")).alias("row"))
    return whole.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v")


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, anchors by rows; an error where 64 bits are not enough."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(anchors).max(initial=0)) * max(1, rows.shape[1])
    if most < 1 << 53:
        return (anchors.astype("f8") @ rows.T.astype("f8")).astype("i8")
    if most >= 1 << 62:
        raise OverflowError("inner products exceed 64 bits")
    return anchors @ rows.T


def scored(batches: Iterator[pa.RecordBatch], block: Anchors) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels, places of anchors, and the scores of these (anchors by rows), a bounded number at a time."""
    step = max(1, SCORES // max(1, len(block.ids)))
    for whole in batches:
        for start in range(0, whole.num_rows, step):
            batch = whole.slice(start, step)
            ids, labels, v = (batch.column(k) for k in range(3))
            ids, labels = ids.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False)
            sizes, flat = v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False).astype("i8")
            begins = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                if int(size) in block.vectors:
                    at = (sizes == size).nonzero()[0]
                    places, anchors = block.vectors[int(size)]
                    yield ids[at], labels[at], places, products(flat[begins[at][:, None] + np.arange(size)], anchors)


def members(block: Anchors, windows: Windows, same: bool, ids: np.ndarray, labels: np.ndarray, places: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window the rows of a batch in its range: its number, their places in the batch, and ``high - score``."""
    for row, place in enumerate(places):
        first, last = np.searchsorted(windows.anchor, [place, place + 1])
        if first == last:
            continue
        like = labels == block.labels[place]
        fit = (like & (ids != block.ids[place]) if same else ~like).nonzero()[0]
        mine = scores[row, fit]
        order = np.argsort(mine)  # each window is then a range
        fit, mine = fit[order], mine[order]
        begins, ends = np.searchsorted(mine, windows.low[first:last]), np.searchsorted(mine, windows.high[first:last], "right")
        for w, a, b in zip(range(first, last), begins, ends):
            if a < b:
                yield w, fit[a:b], windows.high[w] - mine[a:b]


def counted(rows: DataFrame, block: Anchors, windows: Windows, same: bool, far_shift: int, id_shift: int | None) -> DataFrame:
    """``window, digit, n``: open rows of each window by the next digit of their key.

    The digit is that of ``high - score`` above ``far_shift``, or, where ``id_shift`` is given, that of the id. A task
    leaves out the digits after the one at which its own rows are already as many as the window needs: the digit
    looked for cannot be among them.
    """
    shared = rows.sparkSession.sparkContext.broadcast((block, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows = shared.value
        counts = np.zeros((len(windows.anchor), 1 << BITS), "i8")
        for ids, labels, places, scores in scored(batches, block):
            for w, at, far in members(block, windows, same, ids, labels, places, scores):
                if id_shift is None:
                    key, found, shift = far, windows.far[w], np.int64(far_shift)
                else:
                    key, found, shift = block.steps(ids[at[far == windows.far[w]]]), windows.id[w], np.uint64(id_shift)
                key = key[key >= found]
                digits = (key >> shift) - (found >> shift)
                counts[w] += np.bincount(digits[digits < 1 << BITS].astype("i8"), minlength=1 << BITS)
        before = np.cumsum(counts, axis=1) - counts
        window, digit = ((counts > 0) & (before < windows.need[:, None])).nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(window, pa.int64()), pa.array(digit, pa.int64()), pa.array(counts[window, digit], pa.int64())], ["window", "digit", "n"])

    parts = mapped(rows, run, "window long, digit long, n long")
    return parts.groupBy("window", "digit").agg(F.sum("n").alias("n"))


def shift_of(span: int) -> int:
    """Bits below the first digit of numbers from 0 to ``span``."""
    return max(0, span.bit_length() - BITS)


def refined(rows: DataFrame, block: Anchors, windows: Windows, same: bool, far_shift: int, id_shift: int | None = None) -> np.ndarray:
    """Fixes the next digit of every window; returns how many rows share all digits found so far, or come before them in this digit."""
    counts = counted(rows, block, windows, same, far_shift, id_shift)
    order = Window.partitionBy("window").orderBy("digit")  # at most a row for each value of a digit
    running = counts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy("window")))
    need = rows.sparkSession.createDataFrame([(w, int(n)) for w, n in enumerate(windows.need)], "window long, need long")
    reached = running.join(F.broadcast(need), "window").filter((F.col("upto") >= F.col("need")) | (F.col("upto") == F.col("total")))
    first = reached.groupBy("window").agg(F.min(F.struct("digit", "upto", "n")).alias("at")).select("window", "at.*").collect()  # a row for each window of the block
    left = np.zeros(len(windows.anchor), "i8")
    for r in first:
        if id_shift is None:
            windows.far[r.window] += r.digit << far_shift
        else:
            windows.id[r.window] += np.uint64(r.digit << id_shift)
        left[r.window] = r.upto
        windows.need[r.window] -= r.upto - r.n  # rows before this digit are wanted for certain
    return left


def gathered(rows: DataFrame, block: Anchors, windows: Windows, same: bool, far_shift: int, id_shift: int | None) -> DataFrame:
    """``window, vec_id, score`` of the rows whose keys are not beyond the digits found."""
    shared = rows.sparkSession.sparkContext.broadcast((block, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows = shared.value
        for ids, labels, places, scores in scored(batches, block):
            found = [[np.empty(0, "i8")] for _ in range(3)]
            for w, at, far in members(block, windows, same, ids, labels, places, scores):
                digits, last = far >> far_shift, windows.far[w] >> far_shift
                take = digits <= last
                if id_shift is not None:
                    take &= (digits < last) | (block.steps(ids[at]) >> np.uint64(id_shift) <= windows.id[w] >> np.uint64(id_shift))
                for kind, values in zip(found, (np.full(take.sum(), w), ids[at[take]], windows.high[w] - far[take])):
                    kind.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in found], ["window", "vec_id", "score"])

    return mapped(rows, run, "window long, vec_id long, score long")


def first_rows(rows: DataFrame, block: Anchors, windows: Windows, same: bool, highest: int) -> DataFrame:
    """``window, rank, vec_id, score``: the first ``need`` rows (all, if fewer) of every window; ids go up to ``highest``."""
    wanted = int(windows.need.max(initial=0))
    far_shift, id_shift = shift_of(int((windows.high - windows.low).max(initial=0))), None
    left = refined(rows, block, windows, same, far_shift)
    while far_shift and left.max(initial=0) > wanted + SPARE:
        far_shift = max(0, far_shift - BITS)
        left = refined(rows, block, windows, same, far_shift)
    while id_shift != 0 and left.max(initial=0) > wanted + SPARE:  # so many equal scores that digits of the ids decide
        id_shift = shift_of(highest - block.lowest) if id_shift is None else max(0, id_shift - BITS)
        left = refined(rows, block, windows, same, far_shift, id_shift)
    found = gathered(rows, block, windows, same, far_shift, id_shift)
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= wanted)


def mined(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank int, negative_id, positive_score, negative_score`` of ``rows(vec_id, label, embedding)``.

    Anchors are the rows whose id is divisible by ``every``; labels first become ``(label + 1) % 10`` where the id is
    divisible by 7. An anchor's positives are its first ``positives`` other rows of the same label; for each, the first
    ``negatives`` rows of another label whose scores are from ``least`` to ``most`` hundredths of the positive's are
    returned. Which rows take part says :func:`usable_vectors`; only vectors of the same length have a score. An anchor
    without positives, or a positive without negatives, gives no row; extra columns are not read, and an empty table
    gives an empty result.
    """
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    used = kept(usable_vectors(rows), "vectors")
    anchors = kept(numbered(used.filter(F.col("vec_id") % every == 0), ["vec_id"], "n"), "anchors")
    size = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
    facts = used.agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high"), F.max(size).alias("component"), F.max(F.size("v")).alias("dims")).first()
    bound = (facts.component or 0) ** 2 * (facts.dims or 0)
    for start in range(0, anchors.count(), BLOCK):
        members_ = anchors.filter(F.col("n").between(start, start + BLOCK - 1)).orderBy("n").collect()
        block = Anchors.of(members_, facts.low)
        each = np.arange(len(block.ids))
        near = Windows.start(each, np.full(len(each), -bound), np.full(len(each), bound), positives)
        found = sorted((r.window, r["rank"], r.vec_id, r.score) for r in first_rows(used, block, near, True, facts.high).collect())  # bounded by the block
        pairs = [(place, id_, score, -(-least * score // 100), most * score // 100) for place, _, id_, score in found]
        pairs = [p for p in pairs if p[3] <= p[4]]
        if pairs:
            place, _, _, low, high = (np.array(x, "i8") for x in zip(*pairs))
            named = [(w, int(block.ids[p[0]]), p[1], p[2]) for w, p in enumerate(pairs)]
            windows = spark.createDataFrame(named, "window long, anchor_id long, positive_id long, positive_score long")
            far = first_rows(used, block, Windows.start(place, low, high, negatives), False, facts.high).join(F.broadcast(windows), "window")
            far = far.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            far.write.mode("append").parquet(path)
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
