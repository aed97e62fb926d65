"""Connection probabilities and reliabilities over sampled worlds.

``comps`` is ``world, vertex, comp`` over worlds ``0 .. r - 1``; every probability is a count of worlds over ``r``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import kept, mapped
from .components import components

#: Worlds whose edges, or whose reached vertices, are the bits of one number.
BITS = 64
#: Members of a component whose pairs are listed, and vertices of a part that is compared with another in one task.
LISTED, PART = 32, 2000
#: Places of a part's vertices in components of worlds, at most, and pairs that a task compares at a time.
PLACES, CELLS = 1 << 22, 1 << 17
#: Pairs compared in 64 worlds at once that take as long as one that is listed.
LISTING = 5
#: Numbers of an array in which a task searches the worlds of a block.
ELEMENTS = 1 << 22
#: The arcs of a block in one row.
PACKED = "block long, arcs array<struct<a: long, b: long, bits: long>>"


def from_source(comps: DataFrame, source: int, r: int, targets: DataFrame | None = None) -> DataFrame:
    """``vertex, probability`` of a connection with ``source``, zeros included; only ``targets`` if given."""
    own = comps.filter(F.col("vertex") == source).select("world", "comp")
    aims = comps if targets is None else comps.join(targets.select("vertex"), "vertex", "left_semi")
    met = aims.join(own.withColumn("met", F.lit(1)), ["world", "comp"], "left")
    return met.groupBy("vertex").agg((F.count("met") / F.lit(r)).alias("probability"))


def hits_since(comps: DataFrame, sources: DataFrame, stop: int, few: bool = False) -> DataFrame:
    """``source, vertex, hits`` in worlds ``first .. stop - 1`` of each of ``sources(source, first)``.

    ``few`` sources times worlds are broadcast; then the components, whatever their sizes, are not shuffled before
    they are counted.
    """
    chosen = F.broadcast(sources) if few else sources
    own = comps.filter(F.col("world") < stop).join(chosen, comps.vertex == sources.source).filter("world >= first").select("world", "comp", "source")
    return comps.join(F.broadcast(own) if few else own, ["world", "comp"]).groupBy("source", "vertex").agg(F.count("*").alias("hits"))


def source_hits(comps: DataFrame, sources: DataFrame, first: int, stop: int) -> DataFrame:
    """``source, vertex, hits`` in worlds ``first .. stop - 1`` for several ``sources(vertex)`` in one pass."""
    return hits_since(comps, sources.select(F.col("vertex").alias("source"), F.lit(first).alias("first")), stop)


def added_hits(before: DataFrame, more: DataFrame) -> DataFrame:
    """Counts over earlier worlds brought up to date by those over later ones."""
    return before.unionByName(more).groupBy("source", "vertex").agg(F.sum("hits").alias("hits"))


def pair_probabilities(comps: DataFrame, r: int, least: float = 0.0) -> DataFrame:
    """``a, b, probability`` for ``a < b`` that ever meet, of at least ``least``.

    The result lists pairs, but no pair of a single world is ever shuffled (:func:`pair_counts`). :func:`source_hits` takes chosen sources.
    """
    return pair_counts(comps, r, least).select("a", "b", (F.col("n") / F.lit(r)).alias("probability"))


def pair_counts(comps: DataFrame, r: int, least: float = 0.0) -> DataFrame:
    """``a, b, n`` for ``a < b`` that meet in ``n`` worlds, at least once and in a share of at least ``least`` of ``r``.

    Vertices that are in a component of over ``LISTED`` members in some world are compared by the components that all
    worlds give them, ``PART`` by ``PART`` vertices in a task (:func:`meetings`), and only with those they can be linked to.
    A pair with a vertex that never is meets in small components alone; these pairs are listed and counted.
    """
    fewest = next((n for n in range(r + 1) if n / r >= least), r + 1)
    sizes = comps.groupBy("world", "comp").agg(F.count("*").alias("size"))
    often = kept(comps.join(sizes.filter(F.col("size") > LISTED).select("world", "comp"), ["world", "comp"], "left_semi").select("vertex").distinct(), "often")
    rest = comps.join(often, "vertex", "left_anti").select("world", "comp", F.col("vertex").alias("a"))
    others = comps.join(often.withColumn("often", F.lit(True)), "vertex", "left").select("world", "comp", F.col("vertex").alias("b"), "often")
    listed = rest.join(others, ["world", "comp"]).filter((F.col("a") < F.col("b")) | (F.col("often") & (F.col("a") != F.col("b"))))
    few = listed.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").cast("int").alias("n")).filter(F.col("n") >= fewest)
    return few.unionByName(meetings(comps.join(often, "vertex", "left_semi"), fewest - 1, min(PART, max(1, PLACES // r))))


def meetings(comps: DataFrame, over: int = 0, most: int | None = None) -> DataFrame:
    """``a, b, n``: in how many worlds of ``comps`` the vertices ``a < b`` share a component, if in more than ``over`` (or 0).

    The vertices that components link over all worlds are cut into parts of about ``most``; each two parts, or a part
    with itself, go to a task with the components of their vertices, and leave it as counted pairs. Vertices of the
    largest component of each world are bits of numbers, so a pair takes one step for 64 worlds; so are those of the
    second largest, and so on while that is less work than to list the pairs of those left.
    """
    linked = components(comps.select(F.col("vertex").alias("src"), F.col("comp").alias("dst")).distinct()).withColumnRenamed("comp", "top")
    # In order of worlds the rows of vertices are nearly equal, and shuffle files small.
    rows = comps.groupBy("vertex").agg(F.sort_array(F.collect_list(F.struct("world", "comp"))).alias("seen")).join(linked, "vertex")
    parts = linked.join(comps.select("vertex").distinct(), "vertex", "left_semi").groupBy("top").agg(F.ceil(F.count("*") / (most or PART)).cast("int").alias("parts"))
    placed = rows.join(parts, "top").withColumn("part", F.pmod(F.xxhash64("vertex"), F.col("parts")).cast("int"))
    each = placed.select("top", "vertex", "seen.world", "seen.comp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = each.select("top", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), F.col("part"), "vertex", "world", "comp")
    many = int(comps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        vertex, part, lists = table.column("vertex").to_numpy(), table.column("part").to_numpy(), table.column("world").combine_chunks()
        one = table.column("p")[0].as_py() == table.column("q")[0].as_py()
        left = part == table.column("p")[0].as_py()
        ends = [np.flatnonzero(left), np.flatnonzero(left if one else ~left)]
        if not len(ends[0]) or not len(ends[1]):
            return
        row = np.repeat(np.arange(len(vertex)), lists.value_lengths().to_numpy())
        worlds, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        names, label = np.unique(table.column("comp").combine_chunks().flatten().to_numpy(), return_inverse=True)
        groups, group = np.unique(column * np.int64(len(names)) + label, return_inverse=True)
        # Of each place in a component, and of each side: the place's row among those of the side.
        at = np.zeros(len(vertex), np.int64)
        sides = []
        for rows in ends:
            here = np.isin(row, rows)
            at[rows] = np.arange(len(rows))
            sides.append((at[row[here]], column[here], group[here], np.bincount(group[here], minlength=len(groups))))
        pairs = sides[0][3] * (sides[1][3] - one)
        of = groups // len(names)
        order = np.lexsort((-pairs, of))
        layer = np.empty(len(groups), np.int64)
        layer[order] = np.arange(len(groups)) - np.searchsorted(of[order], of[order])
        cells, words = len(ends[0]) * len(ends[1]), -(-len(worlds) // BITS)
        worth = np.bincount(layer, pairs) * LISTING > cells * words
        layers = len(worth) if worth.all() else int(np.argmin(worth))
        masks, spare = [], []
        for rows, (place, world, own, _) in zip(ends, sides, strict=True):
            mask = np.zeros((layers, words, len(rows)), np.uint64)
            big = layer[own] < layers
            np.bitwise_or.at(mask, (layer[own[big]], world[big] // BITS, place[big]), np.uint64(1) << (world[big] % BITS).astype(np.uint64))
            masks.append(mask)
            rare = ~big & (pairs[own] > 0)
            spare.append((place[rare], own[rare]))
        first, second = (vertex[rows] for rows in ends)
        by_place, by_group = np.argsort(spare[0][0], kind="stable"), np.argsort(spare[1][1], kind="stable")
        place, own = (x[by_place] for x in spare[0])
        mates = spare[1][0][by_group]
        begin = np.searchsorted(spare[1][1][by_group], own)
        length = sides[1][3][own]
        size = max(1, CELLS // max(1, len(second)))
        for nth in range(0, len(first), size):
            some = slice(nth, min(nth + size, len(first)))
            met = np.zeros((some.stop - nth, len(second)), np.int32)
            for a, b in zip(masks[0].reshape(-1, len(first)), masks[1].reshape(-1, len(second)), strict=True):
                met += np.bitwise_count(a[some, None] & b)
            lo, hi = np.searchsorted(place, [nth, some.stop])
            if lo < hi:
                n = length[lo:hi]
                with_ = mates[np.arange(n.sum()) + np.repeat(begin[lo:hi] - np.cumsum(n) + n, n)]
                met += np.bincount(np.repeat(place[lo:hi] - nth, n) * len(second) + with_, minlength=met.size).reshape(met.shape).astype(np.int32)
            wanted = met > max(over, 0)
            if one:
                wanted &= first[some, None] < second
            starts = np.concatenate([[0], np.cumsum(wanted.sum(1))]).astype(np.int32)
            found = (pa.ListArray.from_arrays(starts, x[wanted]) for x in (np.broadcast_to(second, met.shape), met))
            yield pa.RecordBatch.from_arrays([pa.array(first[some]), *found], ["vertex", "others", "counts"])

    # A row for each vertex of a part and batch: fewer bytes come back from Python than as rows of pairs.
    found = dealt.repartition(many, "top", "p", "q").groupBy("top", "p", "q").applyInArrow(counted, "vertex long, others array<long>, counts array<int>")
    each = found.select("vertex", "counts", F.posexplode("others").alias("at", "other"))
    return each.select(F.least("vertex", "other").alias("a"), F.greatest("vertex", "other").alias("b"), F.get("counts", "at").alias("n"))


def set_reliability(comps: DataFrame, sets: DataFrame, r: int, depth: int | None = None) -> DataFrame:
    """``set_id, size, reliability``: the share of worlds in which all of ``sets(set_id, vertex)`` are connected.

    It is not defined for paths of at most ``depth`` edges; asking for that is an error.
    """
    if depth is not None:
        raise NotImplementedError("the reliability of a set is not defined for paths of bounded length")
    worlds = comps.join(sets, "vertex").groupBy("set_id", "world").agg((F.min("comp") == F.max("comp")).alias("whole"), F.count("*").alias("size"))
    return worlds.groupBy("set_id").agg(F.max("size").alias("size"), (F.count_if("whole") / F.lit(r)).alias("reliability"))


def average_connection_probability(comps: DataFrame, n: int, r: int) -> DataFrame:
    """``avg_conn_prob`` (each vertex also meets itself, as the definition has it) and ``avg_pair_prob`` without that."""
    sizes = comps.groupBy("world", "comp").agg(F.count("*").alias("size"))
    pairs = F.lit(float(n) * (n - 1))
    return sizes.agg((F.sum(F.col("size") * F.col("size")) / F.lit(r) / pairs).alias("avg_conn_prob"), (F.sum(F.col("size") * (F.col("size") - 1)) / F.lit(r) / pairs).alias("avg_pair_prob"))


def arcs_of(bits: DataFrame) -> DataFrame:
    """``block, a, b, bits`` of ``block, src, dst, bits``, each edge both ways."""
    there = bits.select("block", F.col("src").alias("a"), F.col("dst").alias("b"), "bits")
    return there.unionByName(bits.select("block", F.col("dst").alias("a"), F.col("src").alias("b"), "bits"))


def depth_hits(arcs: DataFrame, sources: DataFrame, depth: int, stop: int) -> DataFrame:
    """``source, vertex, hits``: worlds ``first .. stop - 1`` of each of ``sources(source, first)`` with a path of at most ``depth`` edges.

    ``arcs`` is ``block, a, b, bits``, the worlds of a block in which an edge exists as the bits of one number. A step of
    breadth-first search takes all worlds of a block at once: whoever is reached over an edge is so in the worlds of both.
    """
    blocks = F.explode(F.sequence(F.floor(F.col("first") / BITS), F.lit((stop - 1) // BITS).cast("long")))
    start = sources.filter(F.col("first") < stop).select("source", F.col("source").alias("vertex"), "first", blocks.alias("block"))
    own = mask(F.greatest(F.lit(0), F.col("first") - F.col("block") * BITS), F.least(F.lit(BITS), stop - F.col("block") * BITS))
    state = start.select("source", "vertex", "block", own.alias("seen"), own.alias("fresh"))
    for step in range(depth):
        state = kept(state, "reached") if step else state
        front = state.filter("fresh != 0").select("source", F.col("vertex").alias("a"), "block", "fresh")
        reached = front.join(arcs, ["block", "a"]).select("source", F.col("b").alias("vertex"), "block", F.lit(0).cast("long").alias("seen"), F.col("fresh").bitwiseAND(F.col("bits")).alias("got")).filter("got != 0")
        both = state.select("source", "vertex", "block", "seen", F.lit(0).cast("long").alias("got")).unionByName(reached)
        merged = both.groupBy("source", "vertex", "block").agg(F.bit_or("seen").alias("seen"), F.bit_or("got").alias("got"))
        state = merged.select("source", "vertex", "block", F.col("seen").bitwiseOR(F.col("got")).alias("seen"), F.col("got").bitwiseAND(F.bitwise_not("seen")).alias("fresh"))
    return state.groupBy("source", "vertex").agg(F.sum(F.bit_count("seen")).cast("long").alias("hits"))


def packed(arcs: DataFrame) -> DataFrame:
    """``block, arcs``: one row for each block of ``arcs(block, a, b, bits)``, dealt to many files."""
    dealt = arcs.repartition(int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
    return dealt.groupBy("block").agg(F.collect_list(F.struct("a", "b", "bits")).alias("arcs"))


def block_hits(arcs: DataFrame, sources: list[tuple[int, int]], depth: int, stop: int) -> DataFrame:
    """:func:`packed_hits` of arcs that are not packed yet."""
    return packed_hits(packed(arcs), sources, depth, stop)


def packed_hits(blocks: DataFrame, sources: list[tuple[int, int]], depth: int, stop: int) -> DataFrame:
    """:func:`depth_hits` of a list of ``source, first``, for graphs of which one task can hold the arcs of a block.

    The worlds of a block do not depend on others, so the whole search of a block is one task's and only counts leave it.
    ``blocks`` is as :func:`packed` makes it; where that is kept no arc is shuffled.
    """
    spark = blocks.sparkSession
    sources = [(s, first) for s, first in sources if first < stop]
    own = spark.createDataFrame([(s, s, stop - first) for s, first in sources], "source long, vertex long, hits long")
    if not depth or not sources:
        return own

    def searched(block: int, arcs: pa.StructArray) -> Iterator[pa.RecordBatch]:
        begin = BITS * block
        ends = [arcs.field(c).to_numpy() for c in "ab"]
        order = np.argsort(ends[1], kind="stable")
        a, b, bits = ends[0][order], ends[1][order], arcs.field("bits").to_numpy().astype(np.uint64)[order]
        vertices = np.unique(np.concatenate([*ends, np.array([s for s, _ in sources])]))
        from_, (to, at) = np.searchsorted(vertices, a), np.unique(np.searchsorted(vertices, b), return_index=True)
        size = max(1, ELEMENTS // max(len(a), len(vertices)))
        for nth in range(0, len(sources), size):
            some = sources[nth : nth + size]
            place = np.searchsorted(vertices, [s for s, _ in some])
            seen = np.zeros((len(some), len(vertices)), np.uint64)
            seen[np.arange(len(some)), place] = [sum(1 << w for w in range(max(0, first - begin), min(BITS, stop - begin))) for _, first in some]
            fresh = seen.copy()
            for _ in range(depth):
                got = np.zeros_like(seen)
                got[:, to] = np.bitwise_or.reduceat(fresh[:, from_] & bits, at, axis=1)
                fresh = got & ~seen
                seen |= got
            seen[np.arange(len(some)), place] = 0
            i, j = seen.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array([s for s, _ in some])[i], vertices[j], np.bitwise_count(seen[i, j]).astype(np.int64))], ["source", "vertex", "hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from searched(batch.column(0)[row].as_py(), batch.column(1)[row].values)

    here = blocks.filter(F.col("block").between(min(first for _, first in sources) // BITS, (stop - 1) // BITS))
    there = mapped(here.select("block", "arcs"), run, "source long, vertex long, hits long")
    return there.unionByName(own).groupBy("source", "vertex").agg(F.sum("hits").alias("hits"))


def mask(first: Column, stop: Column) -> Column:
    """A number whose bits ``first`` to ``stop - 1`` are set, of 64."""
    ones = F.lit(-1).cast("long")
    upto = F.when(stop <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", ones, (BITS - stop).cast("int")))
    return upto.bitwiseAND(F.when(first >= BITS, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", ones, first.cast("int"))))


def within_depth(arcs: DataFrame, vertices: DataFrame, sources: DataFrame, depth: int, r: int, targets: DataFrame | None = None) -> DataFrame:
    """``source, vertex, probability`` of a path of at most ``depth`` edges, zeros included; only ``targets`` if given.

    ``arcs`` as in :func:`depth_hits`. One row for each source and vertex: for few sources, as the caller sees to.
    """
    hits = depth_hits(arcs, sources.select(F.col("vertex").alias("source"), F.lit(0).alias("first")), depth, r)
    aims = vertices.select("vertex") if targets is None else vertices.join(targets.select("vertex"), "vertex", "left_semi").select("vertex")
    every = aims.crossJoin(sources.select(F.col("vertex").alias("source")))  # the rows of the result
    return every.join(hits, ["source", "vertex"], "left").select("source", "vertex", (F.coalesce("hits", F.lit(0)) / F.lit(r)).alias("probability"))


def qualifying(probabilities: DataFrame, p: float) -> int:
    """How many vertices reach the reliability target."""
    return probabilities.filter(F.col("probability") >= p).count()


