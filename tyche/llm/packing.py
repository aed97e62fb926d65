"""Best-fit packing of token sequences by bin completion.

Items of the same length are alike, so the search works on the histogram of lengths (at most ``capacity`` rows,
whatever the corpus holds) and returns patterns: fillings of one bin with the number of bins that use them. Spark
then numbers the pieces of each length and looks up the place that the plan gives to that number.
"""

from __future__ import annotations

import logging
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .encoding import encoder
from .shared import kept, mapped
from .token_counts import balanced

log = logging.getLogger(__name__)
#: Pieces of one length are numbered in so many independent groups.
SALTS = 64
#: Fillings looked at for each branch of the search, on average, and those that are sorted together.
LOOKS = RUN = 60
Filling = tuple[tuple[int, int], ...]
Pattern = tuple[Filling, int]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids``: each document's ids with ``end_id`` appended, cut if over ``capacity``.

    The first piece of a long document takes the remainder, so that all others fill a sequence alone. ``ids`` holds
    little-endian unsigned 32-bit integers. A null or empty text is the end id alone; a null doc_id stays null;
    repeated rows are packed each; other columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary).ids, np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        size = 0
        names = ["doc_id", "piece", "start", "length", "ids"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in balanced(batches, 1):
            for doc_id, ids in zip(batch.column(0).to_pylist(), map(encode, batch.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)] if n > capacity else [0]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    rows.append((doc_id, k, a, b - a, ids[4 * a : 4 * b]))
                size += len(ids)
                if size > 1 << 20:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    out = StructType([StructField("doc_id", LongType()), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType())])
    return mapped(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))), cut, out)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: the tightest open bins take the items of a length, many bins at a time."""
    bins: dict[int, list[list]] = {}  # free space -> [filling, number of bins]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for free in sorted(k for k in bins if k >= length):
            while left and bins[free]:
                filling, many = bins[free].pop()
                each = min(free // length, left)
                used = min(many, left // each)
                if used < many:
                    bins[free].append([filling, many - used])
                bins.setdefault(free - each * length, []).append([(*filling, (length, each)), used])
                left -= used * each
            if not left:
                break
        while left:
            each = min(capacity // length, left)
            used = left // each
            bins.setdefault(capacity - each * length, []).append([((length, each),), used])
            left -= used * each
    return [(tuple(filling), many) for same in bins.values() for filling, many in same]


def fillings(space: int, lengths: list[int], left: dict[int, int], looks: Iterator[int]) -> Iterator[tuple[Filling, int]]:
    """All undominated fillings of ``space`` around the largest item, one by one: (lengths and counts in descending order, waste).

    A filling is dominated if another remaining item still fits, or fits in place of a smaller one of its items
    within the waste, or if one item fills the space alone. Fillings without waste come as they are found, the others
    in runs of ``RUN`` looked at, the fullest of a run first. Each one looked at takes one of ``looks``; nothing else
    ends the enumeration. ``left`` must be the same whenever the next filling is asked for.
    """
    usable = [x for x in lengths if x <= space]
    if usable and usable[0] == space:
        yield ((space, 1),), 0
        return
    rising = usable[::-1]

    def dominated(items: Filling, waste: int) -> bool:
        used = dict(items)
        free = lambda above, most: any(left[x] > used.get(x, 0) for x in rising[bisect_right(rising, above) : bisect_right(rising, most)])
        return free(0, waste) or any(free(x, x + waste) for x in used)

    run: list[tuple[Filling, int]] = []
    seen = 0
    # Room, place of the next length and its count still to be tried, items, and whether no length fitted so far.
    stack: list[list] = [[space, 0, None, (), True]]
    while stack:
        top = stack[-1]
        room, at, many, items, lowest = top
        if many is None:
            at = bisect_left(usable, -room, at, key=neg)
            if room == 0 or at == len(usable):
                stack.pop()
                if not lowest:
                    continue
                if next(looks, None) is None:
                    break
                seen += 1
                if room == 0:
                    yield items, 0
                elif not dominated(items, room):
                    run.append((items, room))
                if seen % RUN == 0:
                    yield from sorted(run, key=lambda f: f[1])
                    run = []
                continue
            many = min(left[usable[at]], room // usable[at])
        top[1:] = (at + 1, None, items, False) if many == 1 else (at, many - 1, items, False)
        x = usable[at]
        stack.append([room - many * x, at + 1, None, (*items, (x, many)), True])
    yield from sorted(run, key=lambda f: f[1])


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The largest of the volume bound, Martello and Toth's bound over all thresholds, and how many items a bin can hold."""
    volume = sum(k * n for k, n in counts.items())
    best, many = math.ceil(volume / capacity), 0
    for k in sorted(counts, reverse=True):  # items of k and more: capacity // k of them fit a bin at most
        many += counts[k]
        best = max(best, math.ceil(many / (capacity // k)))
    for a in [x for x in counts if 2 * x <= capacity] or [0]:
        big = sum(n for k, n in counts.items() if k > capacity - a)
        half = {k: n for k, n in counts.items() if capacity - a >= k > capacity / 2}
        small = sum(k * n for k, n in counts.items() if a <= k <= capacity / 2)
        free = sum((capacity - k) * n for k, n in half.items())
        best = max(best, big + sum(half.values()) + max(0, math.ceil((small - free) / capacity)))
    return best


def bin_completion(histogram: dict[int, int], capacity: int, nodes: int = 6000) -> list[Pattern]:
    """Patterns that hold every item of ``histogram`` in as few bins as the search finds.

    Depth first: the largest remaining item is completed by each undominated filling, for as many bins as the counts
    allow, then by each for fewer; for the same length, no filling comes again behind one that it stands before. A branch is
    left once its waste alone rules out fewer bins than the best so far. Best-fit decreasing gives the first
    incumbent. The search ends at the lower bound, when nothing is left to try (the packing is then optimal), or after
    ``nodes`` branches or ``LOOKS`` times as many fillings looked at.
    """
    histogram = {int(k): int(n) for k, n in histogram.items() if n}
    if not histogram:
        return []
    best = best_fit(histogram, capacity)
    fewest, bound = sum(m for _, m in best), lower_bound(histogram, capacity)
    if fewest == bound:
        return best
    volume = sum(k * n for k, n in histogram.items())
    left = dict(histogram)
    looks = iter(range(LOOKS * nodes))
    path: list[Pattern] = []
    tried: set[Filling] = set()
    stack: list[tuple[Iterator, list[Filling], int, int]] = []  # choices still open, their fillings tried, bins and waste before them

    def choices(mine: list[Filling]) -> Iterator[tuple[Filling, int, int]]:
        lengths = sorted((k for k, n in left.items() if n), reverse=True)
        first = lengths[0]
        others = {**left, first: left[first] - 1}
        found: list[tuple[Filling, int, int]] = []
        for items, waste in fillings(capacity - first, [x for x in lengths if others[x]], others, looks):
            again = items[0][1] if items and items[0][0] == first else 0
            filling = ((first, 1 + again), *items[again > 0 :])
            if filling not in tried:
                tried.add(filling)
                mine.append(filling)
                found.append((filling, min(left[x] // n for x, n in filling), waste))
                yield found[-1]
        tried.difference_update(mine)
        for filling, most, waste in found:
            tried.add(filling)
            for many in range(most - 1, 0, -1):
                yield filling, many, waste

    def open_choices(bins: int, waste: int) -> None:
        mine: list[Filling] = []
        stack.append((choices(mine), mine, bins, waste))

    open_choices(0, 0)
    while stack and fewest > bound and nodes:
        options, mine, bins, waste = stack[-1]
        while len(path) >= len(stack):
            filling, many = path.pop()
            for x, n in filling:
                left[x] += n * many
        option = next(options, None)
        if option is None:
            tried.difference_update(mine)
            stack.pop()
            continue
        nodes -= 1
        filling, many, more = option
        bins, waste = bins + many, waste + more * many
        if math.ceil((volume + waste) / capacity) >= fewest:
            continue
        path.append((filling, many))
        for x, n in filling:
            left[x] -= n * many
        if any(left.values()):
            open_choices(bins, waste)
        elif bins < fewest:
            best, fewest = list(path), bins
    return best


def layout(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """``length, first_rank, first_bin, per_bin, offset``: where the items of a length, by their rank, are put."""
    taken: dict[int, int] = {}
    out, first_bin = [], 0
    for filling, many in patterns:
        offset = 0
        for length, n in filling:
            out.append((length, taken.get(length, 0), first_bin, n, offset))
            taken[length] = taken.get(length, 0) + n * many
            offset += n * length
        first_bin += many
    return out


def pack(cut: DataFrame, capacity: int = 2048, nodes: int = 6000) -> DataFrame:
    """``cut`` (rows of :func:`pieces`, each ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Within a sequence the pieces follow each other from offset 0 without gaps. Pieces are numbered per length and
    salt, so a length that most of the rows share is numbered by many tasks. The driver holds the histogram and the
    plan, at most ``capacity`` lengths. Repeated rows are packed each, an empty input gives an empty result.
    """
    spark = cut.sparkSession
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = kept(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    places: dict[int, list] = {}
    patterns = bin_completion(histogram, capacity, nodes)
    log.info("%s sequences; no packing has fewer than %s", sum(m for _, m in patterns), lower_bound(histogram, capacity))
    for length, *place in layout(patterns):
        places.setdefault(length, []).append(tuple(place))
    plan = spark.createDataFrame(list(places.items()), "length long, places array<struct<first_rank: long, first_bin: long, per_bin: long, at: long>>")
    numbered = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    placed = (
        numbered.join(base.hint("merge"), ["length", "salt"])  # dealt out and sorted alike already
        .join(F.broadcast(plan), "length")
        .withColumn("rank", F.col("base") + F.col("nth"))
        .withColumn("place", F.element_at(F.filter("places", lambda p: p["first_rank"] <= F.col("rank")), -1))
        .withColumn("within", F.col("rank") - F.col("place.first_rank"))
    )
    sequence = F.col("place.first_bin") + F.expr("within div place.per_bin")
    offset = F.col("place.at") + (F.col("within") % F.col("place.per_bin")) * F.col("length")
    return placed.select(*cut.columns, sequence.alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, nodes: int = 6000) -> DataFrame:
    """All of ``docs`` packed: encoded once into the shared folder, then placed by :func:`pack`, whose search takes ``nodes``."""
    return pack(kept(pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity, nodes)
