"""Structures that keep work in bounds, against plain brute force: bitmaps, kept counts, local joins, bucketed paths, sparse flow."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tyche.functions import chance
from tyche.operators import clustering, components as joining, graph, guess, reliability
from tyche.operators.components import components
from tyche.operators.worlds import Worlds, world_bits, world_edges, world_rows
from tyche.plans.queries import suppliers

EDGES = "src long, dst long, probability double"


def random_edges(rng, n, m):
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return [(a, b, round(rng.uniform(0.2, 0.95), 3)) for a, b in sorted(pairs)]


def smallest_reached(vertices, pairs):
    label = {v: v for v in vertices}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {v: root(v) for v in vertices}


# --- worlds as bits


@pytest.mark.parametrize("fast", [False, True])
def test_bits_are_the_rows(spark, fast):
    edges = spark.createDataFrame([*random_edges(random.Random(1), 12, 30), (50, 51, 1.0), (51, 52, 0.0), (7, 7, 0.5)], EDGES)
    bits = world_bits(edges, 0, 3, 42, fast).cache()
    assert sorted(map(tuple, world_rows(bits, 0, 192).collect())) == sorted(map(tuple, world_edges(edges, 0, 192, 42, fast).collect()))
    assert sorted(map(tuple, world_rows(bits, 60, 131).collect())) == sorted(map(tuple, world_edges(edges, 60, 131, 42, fast).collect()))
    assert bits.count() == bits.select("block", "src", "dst").distinct().count() <= 3 * edges.count()
    assert {r.bits for r in bits.filter("src = 50").collect()} == {-1} and bits.filter("src = 51").isEmpty()


def test_bounded_search_in_bits(spark):
    rng = random.Random(2)
    edges = random_edges(rng, 14, 24)
    w = Worlds(spark.createDataFrame(edges, EDGES))
    w.grow(70)
    w.grow(150)
    alive: dict = {}
    for r in w.alive().collect():
        for a, b in ((r.src, r.dst), (r.dst, r.src)):
            alive.setdefault((r.world, a), set()).add(b)
    firsts = {0: 0, 3: 65, 5: 149, 6: 150}
    sources = spark.createDataFrame(list(firsts.items()), "source long, first int")
    for depth in (0, 1, 3):
        wanted: dict = {}
        for s, first in firsts.items():
            for world in range(first, 150):
                seen = {s}
                for _ in range(depth):
                    seen |= {b for a in seen for b in alive.get((world, a), ())}
                for v in seen:
                    wanted[s, v] = wanted.get((s, v), 0) + 1
        assert {(r.source, r.vertex): r.hits for r in reliability.depth_hits(w.arcs(), sources, depth, 150).collect()} == wanted


# --- kept counts


def test_counts_go_when_they_are_too_many_and_nothing_changes(spark):
    edges = spark.createDataFrame(random_edges(random.Random(3), 30, 90), EDGES)
    whole, small = Worlds(edges), Worlds(edges, max_counts=150)
    rng, rows = random.Random(4), lambda df: sorted(map(tuple, df.collect()))
    for count in (40, 40, 90, 90, 130):
        whole.grow(count), small.grow(count)
        asked = rng.sample(range(30), 4)
        direct = reliability.source_hits(whole.components(), spark.createDataFrame([(v,) for v in asked], "vertex long"), 0, count)
        assert rows(whole.hits_of(asked)) == rows(small.hits_of(asked)) == rows(direct)
        store = small.counts()
        assert store.rows <= max(150, sum(p.rows for p in store.parts.values() if p.used == store._clock))
    assert small.counts().evicted and not whole.counts().evicted
    assert whole.hits_of([0, 1, 2, 3]) and whole.hits_of([0, 1, 2, 3]) and whole.counts().hit_rate > small.counts().hit_rate
    assert rows(whole.hits_of([])) == []


def test_a_block_writes_its_own_counts_only(spark):
    w = Worlds(spark.createDataFrame(random_edges(random.Random(5), 20, 60), EDGES))
    w.grow(50)
    for block in ([0, 1], [2, 3], [4, 5]):
        w.hits_of(block)
    store = w.counts()
    assert [sorted(p.sources) for p in store.parts.values()] == [[0, 1], [2, 3], [4, 5]] and all(p.rows <= 2 * 20 for p in store.parts.values())


def test_ranges_of_worlds_add_up(spark, monkeypatch):
    monkeypatch.setattr("tyche.operators.worlds.BROADCAST_ROWS", 40)  # 20 worlds at a time for two sources
    w = Worlds(spark.createDataFrame(random_edges(random.Random(6), 15, 40), EDGES))
    w.grow(50)
    found = sorted(map(tuple, w.hits_of([0, 7]).collect()))
    assert len(w.counts().parts) == 3
    assert found == sorted(map(tuple, reliability.source_hits(w.components(), spark.createDataFrame([(0,), (7,)], "vertex long"), 0, 50).collect()))


# --- components


@pytest.mark.parametrize("whole, few, chunk", [(2_000_000, 100_000, 1 << 20), (0, 100_000, 16), (0, 0, 16)])
def test_components_by_tasks_and_by_rounds(spark, monkeypatch, whole, few, chunk):
    for name, value in (("WHOLE", whole), ("BROADCAST_ROWS", few), ("CHUNK", chunk)):
        monkeypatch.setattr(joining, name, value)
    rng = random.Random(7)
    rows = [(g, rng.randrange(80), rng.randrange(80)) for g in ("a", "b", None) for _ in range(60)] + [("c", k, k + 1) for k in range(40)] + [("d", 9, 9)]
    wanted = {}
    for g in {r[0] for r in rows}:
        pairs = [r[1:] for r in rows if r[0] == g]
        wanted |= {(g, v): c for v, c in smallest_reached({v for p in pairs for v in p}, pairs).items()}
    keyed = spark.createDataFrame(rows, "g string, src long, dst long").repartition(7)
    if whole:  # keys of joins are not null
        assert {(r.g, r.vertex): r.comp for r in components(keyed, ["g"]).collect()} == wanted
    keyed, wanted = keyed.filter("g is not null"), {k: v for k, v in wanted.items() if k[0]}
    assert {(r.g, r.vertex): r.comp for r in components(keyed, ["g"]).collect()} == wanted
    single = keyed.filter("g in ('a', 'b')")
    pairs = [r[1:] for r in rows if r[0] in ("a", "b")]
    assert {r.vertex: r.comp for r in components(single).collect()} == smallest_reached({v for p in pairs for v in p}, pairs)
    assert components(single.limit(0)).count() == components(single.limit(0), ["g"]).count() == 0


def test_a_star_is_joined_where_it_is_read(spark):
    n = 1_000_000
    leaves = spark.range(1, n + 1, 1, 16).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    found = components(leaves)
    assert found.filter("comp != 0").isEmpty() and found.count() == n + 1
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]  # no task has the star to itself


# --- paths


def dijkstra(edges, source):
    near: dict = {}
    for a, b, p in edges:
        if p > 0:
            near.setdefault(a, []).append((b, -math.log(p)))
            near.setdefault(b, []).append((a, -math.log(p)))
    best, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if d == best[v]:
            for u, w in near.get(v, ()):
                if d + w < best.get(u, math.inf):
                    best[u] = d + w
                    heapq.heappush(heap, (d + w, u))
    return best


@pytest.mark.parametrize("width", [0.05, 1.0, 100.0])
def test_paths(spark, width):
    edges = [*random_edges(random.Random(8), 40, 70), (0, 1, 1.0), (100, 101, 0.5), (0, 100, 0.0), (3, 3, 0.4)]
    arcs, _ = graph.weighted_arcs(spark.createDataFrame(edges, EDGES))
    found = graph.paths_from(arcs, width, spark.createDataFrame([(0,), (100,)], "vertex long"))
    wanted = {(s, v): d for s in (0, 100) for v, d in dijkstra(edges, s).items()}
    assert {(r.source, r.vertex): r.distance for r in found.collect()} == pytest.approx(wanted)


def test_long_paths_and_certain_edges(spark):
    edges = [(k, k + 1, 1.0 if k % 3 else 0.5) for k in range(40)]
    found = graph.shortest_paths(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(0,)], "vertex long"))
    assert {r.vertex: r.distance for r in found.collect()} == pytest.approx(dijkstra(edges, 0))


def test_a_bounded_search_brings_only_what_is_nearer(spark):
    edges = random_edges(random.Random(9), 40, 70)
    arcs, width = graph.weighted_arcs(spark.createDataFrame(edges, EDGES))
    first, second = dijkstra(edges, 0), dijkstra(edges, 17)
    known = spark.createDataFrame(list(first.items()), "vertex long, distance double")
    found = {r.vertex: r.distance for r in graph.paths_from(arcs, width, spark.createDataFrame([(17,)], "vertex long"), known).collect()}
    assert found == pytest.approx({v: d for v, d in second.items() if d < first.get(v, math.inf) - 1e-12})


@pytest.mark.parametrize("truncate", [False, True])
def test_farthest_first(spark, truncate):
    edges = [*random_edges(random.Random(10), 30, 45), (200, 201, 0.01), (201, 202, 0.2)]
    vertices = sorted({v for e in edges for v in e[:2]})
    prio = lambda v: int(hashlib.md5(f"priority|1|0|{v}".encode()).hexdigest()[:13], 16)
    center = min(vertices, key=lambda v: (prio(v), v))
    state = {}
    for number in range(4):
        d = dijkstra(edges, center)
        for v in vertices:
            if v not in state or d.get(v, math.inf) < state[v][0] - 1e-12:
                state[v] = (d.get(v, math.inf), center)
        if truncate:
            record = 0
            for v in vertices:
                if state[v][0] > record:
                    record, center = (2**63 if state[v][0] == math.inf else int(state[v][0])), v
        else:
            center = max(vertices, key=lambda v: (state[v][0], -v))
    found = clustering.gmm(Worlds(spark.createDataFrame(edges, EDGES)), k=4, p_floor=0.9, compat_truncate=truncate).table
    assert {r.vertex: r.center for r in found.collect()} == {v: c for v, (_, c) in state.items()}


# --- flow


def dense_flow(edges, prune, rounds=60):
    import numpy as np

    n = 1 + max(v for e in edges for v in e[:2])
    m = np.zeros((n, n))
    for a, b, p in edges:
        m[a, b] = m[b, a] = p
    m += np.diag(m.max(axis=0))
    m /= m.sum(axis=0)
    for _ in range(rounds):
        m = m @ m
        m[m < prune] = 0
        m **= 2
        m /= m.sum(axis=0)
    return {j: int(np.round(m[:, j], 6).argmax()) for j in range(n)}, m


def test_flow_is_that_of_the_dense_matrix(spark, monkeypatch):
    monkeypatch.setattr(clustering, "ROW_PART", 3)  # some rows are cut
    monkeypatch.setattr(clustering, "PRODUCTS", 50)
    edges = random_edges(random.Random(11), 24, 40)
    edges = [e for e in edges if {e[0], e[1]} & set(range(24))] + [(k, k + 1, 0.1) for k in range(23) if not any(e[:2] == (k, k + 1) for e in edges)]
    found = {r.vertex: r.center for r in clustering.mcl(spark.createDataFrame(edges, EDGES), prune=1e-4).collect()}
    wanted, limit = dense_flow(edges, 1e-4)
    assert found == wanted and all(limit[c, c] > 0 for c in found.values())


def test_a_hub_and_a_bound_of_entries(spark):
    leaves = 20_000
    star = spark.range(1, leaves + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(0.5).alias("probability"))
    found = clustering.mcl(star, entries=50)
    assert found.count() == leaves + 1 and found.filter("center != 0").count() <= 50
    matrix = clustering.largest_entries(clustering.mcl_matrix(star), 50)
    assert matrix.groupBy("j").agg(F.count("*").alias("n"), F.sum("v").alias("v")).filter("n > 50 or abs(v - 1) > 1e-9").isEmpty()


def test_an_unsettled_flow_is_an_error(spark):
    with pytest.raises(RuntimeError, match="not settled"):
        clustering.mcl(spark.createDataFrame(random_edges(random.Random(12), 12, 20), EDGES), rounds=1)


# --- whole searches at a fine rate and with many centers


def plain_worlds(edges, count):
    """Labels of each world, by the same coins."""
    vertices = sorted({v for e in edges for v in e[:2]})
    coin = lambda w, a, b: int(hashlib.md5(f"42|{w}|{a}|{b}".encode()).hexdigest()[:13], 16) / 2**52
    return [smallest_reached(vertices, [(a, b) for a, b, p in edges if coin(w, a, b) <= p]) for w in range(count)]


def plain_guess(vertices, worlds, p, k, allowed, round_):
    prio = lambda v: int(hashlib.md5(f"priority|1|{round_}|{v}".encode()).hexdigest()[:13], 16)
    covers: dict = {v: [] for v in vertices}
    open_, rank, done = set(vertices), 0, False
    while rank < k - 1 and open_ and not done:
        center = min(open_, key=lambda v: (prio(v), v))
        rank += 1
        for v in vertices:
            share = sum(w[v] == w[center] for w in worlds) / len(worlds)
            if share >= p:
                covers[v].append((share, -rank, center))
                open_.discard(v)
        done = rank + len(open_) <= allowed
    found = {}
    for v, c in covers.items():
        share, _, center = max(c) if c else (1.0, 0, v) if done else (None, 0, None)
        found[v] = (center, share)
    return found, 0 if done else len(open_)


def plain_search(edges, k, best_sum):
    vertices = sorted({v for e in edges for v in e[:2]})
    worlds: list = []
    best, top, step = None, -1.0, 0
    guesses = guess.bisecting(0.1, 0.0001)
    p = next(guesses)
    try:
        while True:
            want = chance.sample_count(p)
            if want > len(worlds):
                worlds = plain_worlds(edges, want)
            found, uncovered = plain_guess(vertices, worlds, p, k, k, step)
            step += 1
            total = sum(share or 0.0 for _, share in found.values())
            if best_sum and total > top or not best_sum and not uncovered:
                best, top = (found, p), total
            p = guesses.send(not uncovered)
    except StopIteration:
        return best


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
@pytest.mark.parametrize("k", [6, 50])
def test_searches_at_the_fine_rate(spark, k):
    """At rate 0.1, as the experiments run it, on the suppliers' graph: every guess as one center after another."""
    table = suppliers(spark, "/root/testdata/sf0.01").select("src", "dst", "probability").cache()
    edges = [tuple(r) for r in table.collect()]
    wanted, p = plain_search(edges, k, False)
    found = clustering.mcp(Worlds(table), k=k, rate=0.1)
    assert found.probability == p
    assert {r.vertex: (r.center, r.probability) for r in found.table.collect()} == {v: (c, pytest.approx(s)) for v, (c, s) in wanted.items()}
    wanted, p = plain_search(edges, k, True)
    found = clustering.acp(Worlds(table), k=k, rate=0.1)
    assert found.probability == p
    covered = {v: (c, pytest.approx(s)) for v, (c, s) in wanted.items() if c is not None}
    assert {r.vertex: (r.center, r.probability) for r in found.table.collect() if r.vertex in covered} == covered
