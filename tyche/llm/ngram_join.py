"""N-gram Jaccard self-join with PartEnum signatures.

Two sets with 100 * intersection >= percent * union differ in at most k elements, where k follows from the size of
the smaller one. Sizes are banded; a set signs for the band of its size and for each band that may hold a smaller
partner. For a band, the feature domain is hashed into ``n1`` parts of ``n2`` sub-parts, and a part signs each subset
of ``n2 - k2`` of its sub-parts. As ``n1 = k // (k2 + 1) + spare``, at least ``spare`` parts of a similar pair differ
in at most ``k2`` elements, and so share a signature.

A subset of at most one element says little, and an empty one nothing: such weak signatures are left out unless
``spare`` or more parts of the set have one. If fewer do, one of the ``spare`` agreeing parts is not weak, so the pair
still meets; if both sets have as many, both keep all their signatures.

Equal sets are one node. Nodes that share a signature are first told apart by parity sketches: a node's bit b is the
parity of its features that hash to b, and two sketches never differ in more bits than the sets differ in elements, so
the test only rules out. What is left ties nodes into clusters, and each cluster is compared exactly: a task multiplies
the incidence matrices of two blocks. Both steps contract as they go: a node is compared with a few leads of its group,
and only what those leave in different classes is compared further. Every pair that shares a signature is decided, by
a comparison or by being in one class, while a group that hangs together takes rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .shared import kept, mapped
from .token_counts import balanced

#: Ratio of the bands' bounds, and the largest size that has a band of its own.
RATIO, LARGEST = 1.2, 10**9
#: Nodes and bytes of a block at most, about, and columns multiplied at a time.
GROUP, BLOCK_BYTES, COLUMNS = 1024, 1 << 20, 2048
#: Nodes of a group that are compared with all others before the rest.
LEADS = 4
#: Nodes of a batch that make a signature they share a hot one, and the tasks that its rows are dealt to.
HOT, SALTS = 32, 64
#: Bits of a sketch for each feature, before rounding up to a power of two.
SKETCH_BITS = 2
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's runs of ``size`` words; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.array([len(w) for w in words])
    stops = np.cumsum(counts)
    flat = np.fromiter((h for w in words for h in map(xxh64_intdigest, w)), U, int(stops[-1]) if len(stops) else 0)
    runs = flat[: max(0, len(flat) - size + 1)]
    for k in range(1, size):
        runs = mixed(runs) + flat[k : len(flat) - size + 1 + k]
    runs = mixed(runs)
    for n, stop in zip(counts.tolist(), stops.tolist(), strict=True):
        if n >= size:
            yield np.unique(runs[stop - n : stop - size + 1])
        elif n:
            few = flat[stop - n : stop]
            yield mixed(np.array([np.bitwise_xor.reduce(mixed(few + np.arange(1, n + 1, dtype=U))) + U(n)], U))
        else:
            yield flat[:0]


def node_of(features: np.ndarray) -> int:
    """A set's identity: 64 bits of a hash of its features."""
    from xxhash import xxh3_64_intdigest

    return int(np.array(xxh3_64_intdigest(features.tobytes()), U).astype(np.int64))


@lru_cache
def bands() -> np.ndarray:
    """Upper bounds (exclusive) of the size bands."""
    bounds = [2]
    while bounds[-1] < LARGEST:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * RATIO)))
    return np.array(bounds)


@lru_cache(maxsize=None)
def scheme(band: int, percent: int) -> tuple[int, int, int, int] | None:
    """``n1, n2, k2, spare`` of a band; None where only equal sets are similar."""
    k = (100 - percent) * (int(bands()[band]) - 1) // percent
    if k == 0:
        return None
    if k <= 3:
        return 1, k + 3, k, 1
    n2, k2, spare = (5, 2, 1) if k <= 12 else (3, 1, 2)
    return k // (k2 + 1) + spare, n2, k2, spare


def signatures(features: np.ndarray, percent: int) -> np.ndarray:
    """The PartEnum signatures of a set, over all bands in which it may have a partner."""
    low, high = np.searchsorted(bands(), [-(-percent * len(features) // 100), len(features)], "right")
    found = [np.zeros(0, U)]
    for band in range(low, high + 1):
        if not (plan := scheme(int(band), percent)):
            continue
        n1, n2, k2, spare = plan
        place = mixed(features + U(band + 1))
        cells = ((place >> U(32)) % U(n1) * U(n2) + (place & U(0xFFFFFFFF)) % U(n2)).astype(np.int64)
        counts = np.bincount(cells, minlength=n1 * n2).reshape(n1, n2)
        sums = np.zeros(n1 * n2, U)
        np.add.at(sums, cells, mixed(place))
        sums = sums.reshape(n1, n2)
        left_out = np.array(list(combinations(range(n2), k2)))
        within = counts.sum(1, keepdims=True) - counts[:, left_out].sum(2)
        signed = sums.sum(1, keepdims=True) - sums[:, left_out].sum(2)
        label = mixed(np.arange(n1 * len(left_out), dtype=U) + (U(band) << U(32))).reshape(n1, -1)
        weak = within <= 1
        wanted = ~weak if weak.any(1).sum() < spare else np.ones_like(weak)
        found.append(mixed(signed ^ label)[wanted])
    return np.concatenate(found)


def _sets(batches: Iterator[pa.RecordBatch], text_at: int, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in balanced(batches, text_at):
        yield batch, list(shingle_sets(batch.column(text_at).to_pylist(), size))


def sketch(features: np.ndarray) -> bytes:
    """Parity bits, a power of two of them; XOR of its halves is the sketch of half the length."""
    bits = 1 << max(6, (SKETCH_BITS * len(features) - 1).bit_length())
    counts = np.bincount((mixed(features ^ U(0x5EED)) & U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1).tobytes()


def set_nodes(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, node, sketch`` of each row; ``node`` is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, 1, size):
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), nodes, pa.array(map(sketch, sets), pa.binary())], ["doc_id", "n_shingles", "node", "sketch"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, node long, sketch binary")


def signature_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``sig, salt, node`` of all sets; equal sets within a task sign once.

    Where ``HOT`` nodes of one batch share a signature, their rows are dealt to salts from 1 on, so that no task gets
    all rows of a very common signature, and a row without node tells salt 0 that others have more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches, 0, size):
            signed, nodes = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for s in sets:
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    signed.append(signatures(s, percent))
                    nodes.append(np.full(len(signed[-1]), node))
            sigs, owners = np.concatenate(signed).view(np.int64), np.concatenate(nodes)
            known, counts = np.unique(sigs, return_counts=True)
            hot = known[counts >= HOT]
            many = np.isin(sigs, hot)
            salts = np.where(many, 1 + (mixed(owners.view(U)) % U(SALTS)).astype(np.int32), 0).astype(np.int32)
            columns = [pa.array(np.append(sigs, hot)), pa.array(np.append(salts, np.zeros(len(hot), np.int32))), pa.concat_arrays([pa.array(owners, pa.int64()), pa.nulls(len(hot), pa.int64())])]
            yield pa.RecordBatch.from_arrays(columns, ["sig", "salt", "node"])

    return mapped(docs.select("text"), run, "sig long, salt int, node long")


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of ``linked`` that span its connected components; those with most links come first."""
    seen = [np.zeros(n, bool) for n in linked.shape]
    sides, edges = (linked, linked.T), []
    degree = linked.sum(1)
    for root in np.argsort(-degree, kind="stable")[: np.count_nonzero(degree)]:
        if seen[0][root]:
            continue
        seen[0][root] = True
        front, side = np.array([root]), 0
        while len(front):
            near = sides[side][front]
            new = np.flatnonzero(near.any(0) & ~seen[1 - side])
            by = front[near[:, new].argmax(0)]
            edges += zip(*((by, new) if side == 0 else (new, by)), strict=True)
            seen[1 - side][new] = True
            front, side = new, 1 - side
    return edges


def similar_blocks(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of ``left`` and ``right`` are similar, by products of incidence matrices over shared features."""
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    places = []
    for side, n in zip((left, right), sizes, strict=True):
        flat, row = np.concatenate(side), np.repeat(np.arange(len(side)), n)
        at = np.minimum(np.searchsorted(common, flat), max(0, len(common) - 1))
        hit = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((row[hit][order], at[hit][order]))
    shared = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, len(common), COLUMNS):
        matrices = []
        for (row, at), side in zip(places, (left, right), strict=True):
            a, b = np.searchsorted(at, [first, first + COLUMNS])
            x = np.zeros((len(side), min(COLUMNS, len(common) - first)), np.float32)
            x[row[a:b], at[a:b] - first] = 1
            matrices.append(x)
        shared += matrices[0] @ matrices[1].T
    return 100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared)


def similar(left: pa.StructArray, right: pa.StructArray, percent: int) -> np.ndarray:
    """Which items, whose data are features, are similar."""
    return similar_blocks(*([np.frombuffer(x.as_buffer(), U) for x in side.field(2)] for side in (left, right)), percent)


def may_be_similar(left: pa.StructArray, right: pa.StructArray, percent: int) -> np.ndarray:
    """Which items are not ruled out by their sizes and sketches (their data); sketches are folded to the shortest."""
    sizes = [side.field(1).to_numpy(zero_copy_only=False).astype(np.int64) for side in (left, right)]
    sketches = [side.field(2).to_pylist() for side in (left, right)]
    shortest = min(map(len, sketches[0] + sketches[1]))
    signs = []
    for side in sketches:
        folded = [np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, shortest), 0) for x in side]
        signs.append(1 - 2 * np.unpackbits(np.stack(folded), axis=1).astype(np.float32))
    differ = (8 * shortest - signs[0] @ signs[1].T) / 2
    together = np.add.outer(*sizes)
    return (differ * (100 + percent) <= together * (100 - percent)) & (100 * np.minimum.outer(*sizes) >= percent * np.maximum.outer(*sizes))


def spanning(pairs: DataFrame, compare: Callable[[pa.StructArray, pa.StructArray, int], np.ndarray], percent: int) -> DataFrame:
    """``src, dst``: edges that span what ``compare`` links between the items of ``left`` and ``right`` (within ``left`` where that is null).

    Items are ``node, n, data, class``; a task returns edges only between classes that it has not joined yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        for batch in batches:
            found: list[tuple[int, int]] = []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                left = x.values
                right = y.values if y.is_valid else left
                (a, class_a), (b, class_b) = ([side.field(k).to_pylist() for k in (0, 3)] for side in (left, right))
                for i, j in forest(compare(left, right, percent)):
                    p, q = top(class_a[i]), top(class_b[j])
                    if p != q:
                        above[p] = q
                        found.append((min(a[i], b[j]), max(a[i], b[j])))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["src", "dst"])

    return mapped(pairs.select("left", "right"), run, "src long, dst long")


def in_parts(rows: DataFrame, scope: list[str], size: Column) -> DataFrame:
    """``rows`` (with ``node``) with ``part`` and ``parts`` within each ``scope``: about ``BLOCK_BYTES`` of ``size`` and ``GROUP`` rows a part."""
    sizes = rows.groupBy(*scope).agg(F.ceil(F.greatest(F.sum(size) / BLOCK_BYTES, F.count("*") / GROUP)).cast("int").alias("parts"))
    return rows.join(sizes, scope).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def class_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (with ``node``) and the ``class`` that ``edges`` put each in; its own without an edge."""
    labels = components(edges).select(F.col("vertex").alias("node"), "comp")
    return nodes.join(labels, "node", "left").withColumn("class", F.coalesce("comp", "node")).drop("comp")


def decided(parts: DataFrame, edges: DataFrame | None, compare: Callable[[pa.StructArray, pa.StructArray, int], np.ndarray], percent: int, passes: int = 1) -> DataFrame:
    """``src, dst``: ``edges``, and more that span what ``compare`` links within each scope of ``parts(scope, part, parts, items)``.

    Pairs within a part are compared first. Where a scope has several parts, its nodes of most links are then compared
    with all parts, ``passes`` times, and last every node outside the scope's largest class: of any two nodes that no
    edge has joined by then, one is compared with the other. So a group that hangs together takes rows in proportion
    to its size.
    """
    within = kept(spanning(parts.select(F.col("items").alias("left"), F.lit(None).cast(parts.schema["items"].dataType).alias("right")), compare, percent), "within")
    edges = within if edges is None else edges.unionByName(within)
    several = parts.filter("parts > 1")
    places = kept(several.select("scope", "part", "parts", F.explode("items.node").alias("node")).distinct(), "places")
    if places.isEmpty():
        return edges
    for last in [False] * passes + [True]:
        state = class_of(places, edges)
        classes = state.groupBy("scope", "class").agg(F.count("*").alias("n"), F.max("parts").alias("parts"))
        unsettled = classes.groupBy("scope").agg(F.max(F.struct("n", "class"))["class"].alias("largest"), F.max("parts").alias("parts"), F.count("*").alias("classes")).filter("classes > 1")
        spread = unsettled.select("scope", "largest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        open_ = kept(state.join(spread, ["scope", "part"]), "unsettled")
        if open_.isEmpty():
            break
        if last:
            chosen = open_.filter(F.col("class") != F.col("largest")).select("scope", "part", "node")
        else:
            ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
            ranked = open_.join(ends.groupBy("node").agg(F.count("*").alias("links")), "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
            for scope in (["scope", "part"], ["scope"]):
                nth = F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("links"), "node"))
                ranked = ranked.withColumn("nth", nth).filter(F.col("nth") <= LEADS)
            chosen = ranked.select("scope", "part", "node")
        items = several.select("scope", "part", F.col("parts").alias("all"), F.explode("items").alias("item")).select("scope", "part", "all", F.col("item.node").alias("node"), "item")
        left = in_parts(items.join(chosen, ["scope", "part", "node"]).drop("part"), ["scope", "all"], F.length("item.data"))
        left = left.groupBy("scope", "all", "part").agg(F.collect_list("item").alias("left")).select("scope", "left", F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("part"))
        right = several.select("scope", "part", F.col("items").alias("right"))
        edges = edges.unionByName(kept(spanning(left.join(right, ["scope", "part"]), compare, percent), "across"))
    return edges


def scopes_of(rows: DataFrame) -> DataFrame:
    """``scope, part, nodes``: the distinct sets of nodes that share a signature, those of more than ``GROUP`` in parts."""
    by = Window.partitionBy("sig", "salt").orderBy("node")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    single = rows.withColumn("before", F.lag("node").over(by)).filter("node is null or before is null or before != node")
    met = single.withColumn("n", F.count("node").over(whole)).withColumn("salted", (F.count("*").over(whole) > F.col("n")) | (F.col("salt") > 0))
    met = met.filter("node is not null and (n > 1 or salted)").withColumn("many", F.col("salted") | (F.col("n") > GROUP))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / GROUP)).cast("int").alias("part")
    lists = kept(met.groupBy("sig", "salt", "many", part).agg(F.sort_array(F.collect_list("node")).alias("nodes")).drop("salt", "part").withColumn("sig", F.when(F.col("many"), F.col("sig"))), "lists")
    few = lists.filter("not many").select("nodes").distinct().select(F.xxhash64("nodes").alias("scope"), F.lit(0).alias("part"), "nodes")
    many = lists.filter("many")
    totals = many.groupBy("sig").agg(F.ceil(F.sum(F.size("nodes")) / GROUP).cast("int").alias("parts"))
    dealt = many.join(totals, "sig").select(F.xxhash64("sig").alias("scope"), "parts", F.explode("nodes").alias("node"))
    dealt = dealt.groupBy("scope", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")).agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    return few.unionByName(dealt)


def tested(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """``src, dst, far, linked`` for ``pairs(src, dst)``: the share of bits in which their sketches differ, and whether they may be similar."""
    side = lambda name: known.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch"))
    both = pairs.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", "src_n", "dst_n", "src_sketch", "dst_sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, linked = [], []
            for n, m, a, b in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                a, b = sorted((a, b), key=len)
                b = np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, len(a)), 0).tobytes()
                differ = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
                far.append(differ / (n + m))
                linked.append(differ * (100 + percent) <= (n + m) * (100 - percent) and 100 * min(n, m) >= percent * max(n, m))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.float64()), pa.array(linked, pa.bool_())], ["src", "dst", "far", "linked"])

    return mapped(both, run, "src long, dst long, far double, linked boolean")


def clusters_of(scopes: DataFrame, nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``node, n, doc_id`` of the nodes that share a signature with another, and ``vertex, comp``: clusters that sketches do not tell apart.

    Each node is first tested against the lowest and the highest node of its scopes. Scopes whose nodes that puts in one
    cluster need no more. Where scopes are large, each node of the others is tested against the one nearest to those
    leads; what then still lies in different clusters is compared by :func:`decided`.
    """
    ends = scopes.groupBy("scope").agg(F.min(F.get("nodes", F.lit(0))).alias("low"), F.max(F.element_at("nodes", -1)).alias("high"))
    leads = scopes.join(ends, "scope").select(F.explode("nodes").alias("node"), "low", "high").groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    single = nodes.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    known = kept(single.join(leads, "node"), "known")
    pairs = known.select(F.col("node").alias("src"), F.explode(F.array_distinct(F.array("low", "high"))).alias("dst")).filter("src != dst")
    tests = kept(tested(pairs, known, percent), "tests")
    links = tests.filter("linked").select("src", "dst")
    far = tests.groupBy(F.col("src").alias("node")).agg(F.avg("far").alias("far"))
    own = kept(scopes.select("scope", F.explode("nodes").alias("node")).groupBy("node").agg(F.collect_list("scope").alias("scopes")), "own-scopes")

    def unsettled(state: DataFrame) -> DataFrame:
        """Scopes of several classes, with the node nearest to the leads and its class."""
        near = F.min(F.struct("far", "node", "class"))
        found = own.join(state, "node").select(F.explode("scopes").alias("scope"), "far", "node", "class").groupBy("scope")
        return found.agg(near.alias("near"), F.min("class").alias("least"), F.max("class").alias("most")).filter("least != most").select("scope", F.col("near.node").alias("lead"), F.col("near.class").alias("lead_class"))

    if not scopes.filter("part > 0").isEmpty():
        state = kept(class_of(known.select("node").join(far, "node", "left").withColumn("far", F.coalesce("far", F.lit(9.0))), links), "state")
        met = scopes.join(unsettled(state), "scope").select(F.explode("nodes").alias("node"), "lead", "lead_class")
        pairs = met.join(state, "node").filter("class != lead_class").groupBy("node").agg(F.min(F.struct("far", "lead")).alias("best")).select(F.col("node").alias("src"), F.col("best.lead").alias("dst"))
        links = links.unionByName(kept(tested(pairs, known, percent).filter("linked").select("src", "dst"), "more-links"))

    state = kept(class_of(known.select("node", "n", "sketch", F.lit(0.0).alias("far")), links), "state")
    left = scopes.join(unsettled(state).select("scope"), "scope")
    sizes = left.groupBy("scope").agg((F.max("part") + 1).alias("parts"))
    items = left.join(sizes, "scope").select("scope", "part", "parts", F.explode("nodes").alias("node")).join(state.drop("far"), "node")
    parts = items.groupBy("scope", "part", "parts").agg(F.collect_list(F.struct("node", "n", F.col("sketch").alias("data"), "class")).alias("items"))
    edges = decided(kept(parts, "unsettled-parts"), links, may_be_similar, percent, passes=0)
    return known.select("node", "n", "doc_id"), components(edges)


def placed_features(docs: DataFrame, size: int, placed: DataFrame) -> DataFrame:
    """``scope, part, parts, node, n, features`` of the nodes in ``placed``, each from its document ``doc_id``.

    A node comes more than once where its document's id is repeated or null.
    """
    columns = ["scope", "part", "parts", "n"]
    docs = docs.select(F.col("doc_id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, sets in _sets(batches, 0, size):
            nodes = [node_of(s) if len(s) else None for s in sets]
            wanted = [k for k, (node, known) in enumerate(zip(nodes, batch.column(1).to_pylist(), strict=True)) if node is not None and known in (None, node) and node not in seen and not seen.add(node)]
            rest = batch.select(range(2, batch.num_columns)).take(pa.array(wanted, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in wanted], pa.int64()), pa.array([sets[k].tobytes() for k in wanted], pa.binary()), *rest.columns], ["node", "data", *rest.schema.names])

    # One shuffle of the texts, at every size: what is placed grows with the documents.
    named = docs.join(placed.filter("doc_id is not null").hint("merge"), "doc_id").select("text", "node", *columns)
    named = mapped(named, run, "node long, data binary, scope long, part int, parts int, n long")
    # Documents without an id are found by their sets.
    unnamed = mapped(docs.filter("doc_id is null").select("text", F.lit(None).cast("long").alias("node")), run, "node long, data binary")
    return named.unionByName(unnamed.join(placed.filter("doc_id is null").select("node", *columns), "node"))


def cluster_links(docs: DataFrame, known: DataFrame, clusters: DataFrame, size: int, percent: int) -> DataFrame:
    """``src, dst``: links that span the similar pairs within each of ``clusters(vertex, comp)``."""
    members = kept(known.join(clusters.select(F.col("vertex").alias("node"), F.col("comp").alias("scope")), "node"), "members")
    placed = kept(in_parts(members, ["scope"], 8 * F.col("n")), "placed")
    found = placed_features(docs, size, placed)
    parts = found.groupBy("scope", "part", "parts").agg(F.collect_list(F.struct("node", "n", "data", F.col("node").alias("class"))).alias("items"))
    return decided(kept(parts, "blocks"), None, similar, percent)  # a part holds about BLOCK_BYTES


def similar_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (``doc_id``, ``text``).

    Words are runs of characters other than ASCII white space, with A-Z lowered. Two documents are linked when
    100 * intersection >= percent * union of their sets of ``size``-word shingles; a text of fewer words is one
    shingle; a text without words, or null, is empty and linked with nothing (component_id is its own id).
    ``component_id`` is the smallest doc_id reachable by links. Null ids are never smallest; a component of null
    ids only has a null component_id. Repeated rows are in one component; other columns are not read; an empty table
    gives an empty result. Sets are told apart by 64 bits of a hash, features by 64 bits each.
    """
    nodes = kept(set_nodes(docs, size), "set-nodes")
    scopes = kept(scopes_of(signature_rows(docs, size, percent)), "scopes")
    known, clusters = clusters_of(scopes, nodes, percent)
    labels = components(cluster_links(docs, known, clusters, size, percent))

    first = nodes.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    rooted = first.join(labels.select(F.col("vertex").alias("node"), "comp"), "node", "left").select("node", "first_id", F.coalesce("comp", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = kept(rooted.join(named, "root").select("node", "component_id"), "components")
    alone = nodes.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return nodes.join(named, "node").select("doc_id", "n_shingles", "component_id").unionByName(alone)
