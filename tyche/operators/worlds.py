"""Possible worlds: which edges exist, and the components of each world.

Worlds are numbered; more worlds only ever append, and fewer are a prefix of the numbers. The edges of 64 worlds are
one number for each edge, a bit for each world. The components of all worlds are one table, so a probability is a
count over ``(world, comp)`` groups.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chance import fast_uniform, sample_count, uniform
from ..sources.edges import vertices_of
from ..storage import kept, written
from .components import WHOLE, components
from .counts import CountStore
from .reliability import BITS, PACKED, arcs_of, depth_hits, hits_since, packed, packed_hits

log = logging.getLogger(__name__)
#: Sources times worlds up to this number (24 bytes each) are broadcast; more worlds are counted range by range.
BROADCAST_ROWS = 1_000_000
#: Sources whose connections are counted in one job.
SOURCES = 10_000


def world_edges(edges: DataFrame, first: int, stop: int, seed: int = 42, fast: bool = False) -> DataFrame:
    """``world, src, dst``: the edges that exist in worlds ``first`` to ``stop - 1``; one coin per edge and world.

    The edges are dealt to the session's number of tasks: a file of few edges would toss the coins of all worlds in one.
    """
    if stop <= first:
        return edges.select(F.lit(0).cast("long").alias("world"), "src", "dst").limit(0)
    dealt = edges.select("src", "dst", "probability").repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "dst")
    each = dealt.select("src", "dst", "probability", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(stop - 1).cast("long"))).alias("world"))
    coin = (fast_uniform if fast else uniform)(F.lit(seed), F.col("world"), F.col("src"), F.col("dst"))
    return each.filter(coin <= F.col("probability")).select("world", "src", "dst")


def world_bits(edges: DataFrame, first: int, stop: int, seed: int = 42, fast: bool = False) -> DataFrame:
    """``block, src, dst, bits``: bit ``w`` of block ``b`` tells whether the edge exists in world ``64 b + w``.

    For blocks ``first`` to ``stop - 1``, with the coins of :func:`world_edges`. Edges that exist in no world of a
    block have no row; each task puts the bits of an edge together before they are shuffled.
    """
    world = F.col("world")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (world % BITS).cast("int"))
    alive = world_edges(edges, first * BITS, stop * BITS, seed, fast)
    return alive.groupBy(F.floor(world / BITS).alias("block"), "src", "dst").agg(F.bit_or(bit).alias("bits"))


def world_rows(bits: DataFrame, first: int, stop: int) -> DataFrame:
    """``world, src, dst`` of worlds ``first`` to ``stop - 1`` from their bits."""
    here = bits.filter(F.col("block").between(first // BITS, (stop - 1) // BITS))
    set_ = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda w: F.call_function("shiftrightunsigned", F.col("bits"), w).bitwiseAND(F.lit(1).cast("long")) == 1)
    rows = here.select("block", F.explode(set_).alias("bit"), "src", "dst")
    return rows.select((F.col("block") * BITS + F.col("bit")).alias("world"), "src", "dst").filter(F.col("world").between(first, stop - 1))


def components_of(alive: DataFrame, vertices: DataFrame, first: int, stop: int, most: int | None = None) -> DataFrame:
    """``world, vertex, comp`` for every vertex of worlds ``first`` to ``stop - 1``, whose edges are ``alive``, at most ``most`` each."""
    worlds = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(stop - 1).cast("long")))
    every = vertices.select(worlds.alias("world"), F.col("vertex").alias("src"), F.col("vertex").alias("dst"))  # each joined with itself
    return components(alive.select("world", "src", "dst").unionByName(every), ["world"], most=most)


def world_components(edges: DataFrame, vertices: DataFrame, first: int, stop: int, seed: int = 42, fast: bool = False) -> DataFrame:
    """``world, vertex, comp`` for every vertex of every world."""
    edges, vertices = kept(edges.select("src", "dst", "probability"), "edges"), kept(vertices.select("vertex"), "vertices")
    return components_of(world_edges(edges, first, stop, seed, fast), vertices, first, stop, edges.count() + vertices.count())


def union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@dataclass
class Worlds:
    """A growing sample of the worlds of one graph; ``max_worlds`` caps it, and ``capped`` tells whether it did.

    Edges, components and the connections of chosen sources are kept, and further worlds are added to each. Of the
    connections at most ``max_counts`` rows stay for each depth (:class:`CountStore`).
    """

    edges: DataFrame
    vertices: DataFrame | None = None
    seed: int = 42
    epsilon: float = 0.1
    delta: float = 0.01
    fraction: float = 0.1
    max_worlds: int = 50_000
    fast: bool = False
    max_counts: int = 100_000_000
    count: int = 0
    capped: bool = False
    _bits: list[DataFrame] = field(default_factory=list)
    _arcs: list[DataFrame] = field(default_factory=list)
    _packed: list[str] = field(default_factory=list)
    _components: list[DataFrame] = field(default_factory=list)
    _blocks: int = 0
    _joined: int = 0
    _most: int | None = None
    _hits: dict[int | None, CountStore] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.edges = kept(self.edges.select("src", "dst", "probability"), "edges")
        self.vertices = kept((self.vertices if self.vertices is not None else vertices_of(self.edges)).select("vertex"), "vertices")

    def wanted(self, p: float) -> int:
        want = sample_count(p, self.epsilon, self.delta, self.fraction)
        if want > self.max_worlds and not self.capped:
            log.warning("probability %s asks for %s worlds, but max_worlds allows %s", p, want, self.max_worlds)
            self.capped = True
        return max(1, min(want, self.max_worlds))

    def grow(self, count: int) -> None:
        """Samples further worlds up to ``count``, by whole blocks of 64; those there stay as they are."""
        blocks = -(-count // BITS)
        if blocks > self._blocks:
            self._bits.append(kept(world_bits(self.edges, self._blocks, blocks, self.seed, self.fast), "world-bits"))
            self._blocks = blocks
        self.count = max(self.count, count)

    def reach(self, p: float) -> int:
        """Grows to what probability ``p`` asks for; returns the number of worlds there are."""
        self.grow(self.wanted(p))
        return self.count

    def alive(self, count: int | None = None) -> DataFrame:
        """``world, src, dst``: the edges of the first ``count`` worlds (all by default)."""
        return world_rows(union(self._bits), 0, self.count if count is None else min(count, self.count))

    def arcs(self) -> DataFrame:
        """``block, a, b, bits``: the edges both ways, also of the last block's worlds beyond those asked for."""
        for part in self._bits[len(self._arcs) :]:
            self._arcs.append(kept(arcs_of(part), "arcs"))
        return union(self._arcs)

    def packed(self) -> DataFrame:
        """``block, arcs``: the :meth:`arcs` of a block in one row, for graphs of which one task can hold them."""
        for part in self._bits[len(self._packed) :]:
            self._packed.append(written(packed(arcs_of(part)), "packed"))
        return self.edges.sparkSession.read.schema(PACKED).parquet(*self._packed)  # one scan, of few tasks

    def most(self) -> int:
        """The edges of a world, at most, a loop for each vertex included."""
        if self._most is None:
            self._most = self.edges.count() + self.vertices.count()
        return self._most

    def components(self, count: int | None = None) -> DataFrame:
        """The components of the first ``count`` worlds (all by default)."""
        if self._joined < self.count:
            alive = world_rows(union(self._bits), self._joined, self.count)
            self._components.append(kept(components_of(alive, self.vertices, self._joined, self.count, self.most()), "components"))
            self._joined = self.count
        whole = union(self._components)
        return whole if count is None or count >= self.count else whole.filter(F.col("world") < count)

    def counts(self, depth: int | None = None) -> CountStore:
        return self._hits.setdefault(depth, CountStore(self.vertices.sparkSession, self.max_counts))

    def hits(self, sources: DataFrame, depth: int | None = None) -> DataFrame:
        """``source, vertex, hits``: in how many of the worlds each of ``sources(vertex)`` is connected with a vertex.

        With ``depth`` only paths of so many edges count. A source asked for again is looked up in later worlds alone.
        The ids of the sources pass through the driver: a block of candidates, or the centers of a clustering.
        """
        return self.hits_of([r.vertex for r in sources.select("vertex").distinct().collect()], depth)

    def hits_of(self, sources: list[int], depth: int | None = None) -> DataFrame:
        """:meth:`hits` of a list of sources; good until the next call for the same depth."""
        spark, store = self.vertices.sparkSession, self.counts(depth)
        asked = lambda block: spark.createDataFrame(block, "source long, first int")
        missing = store.missing(sources, self.count)
        if depth is not None:
            firsts = [(s, first) for first, some in missing.items() for s in some]
            for at in range(0, len(firsts), SOURCES):
                block = firsts[at : at + SOURCES]
                found = packed_hits(self.packed(), block, depth, self.count) if self.most() <= WHOLE else depth_hits(self.arcs(), asked(block), depth, self.count)
                store.add([s for s, _ in block], self.count, found)
            return store.read(sources)
        for first, some in missing.items():
            for at in range(0, len(some), SOURCES):
                block = some[at : at + SOURCES]
                step = max(1, BROADCAST_ROWS // len(block))
                for begin in range(first, self.count, step):
                    stop = min(begin + step, self.count)
                    store.add(block, stop, hits_since(self.components().filter(F.col("world").between(begin, stop - 1)), asked([(s, begin) for s in block]), stop, True))
        return store.read(sources)
