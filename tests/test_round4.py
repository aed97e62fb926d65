"""What a review of round 4 found: searches over many worlds, and all pairs of larger graphs."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tyche.operators import clustering, reliability
from tyche.operators.worlds import Worlds, world_edges

EDGES = "src long, dst long, probability double"


def random_edges(rng, n, m):
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return [(a, b, round(rng.uniform(0.2, 0.95), 3)) for a, b in sorted(pairs)]


def test_the_coins_of_one_file_are_tossed_by_many_tasks(spark):
    """Before, a file of few edges was one task for all worlds."""
    edges = spark.createDataFrame(random_edges(random.Random(1), 40, 120), EDGES).coalesce(1)
    alive = world_edges(edges, 0, 30)
    assert alive.select(F.spark_partition_id()).distinct().count() > 1
    assert world_edges(edges, 3, 3).count() == 0 and alive.count() == len(set(map(tuple, alive.collect())))


def test_blocks_are_packed_once_and_searched_in_one_job(spark):
    """Sources that miss different worlds are one part of the store; before, each first world was a search of its own."""
    w = Worlds(spark.createDataFrame([*random_edges(random.Random(5), 14, 24), (50, 51, 0.0)], EDGES))
    w.grow(70)
    w.hits_of([1, 2], depth=3)
    w.grow(200)
    found = {tuple(r) for r in w.hits_of([1, 3, 50], depth=3).collect()}
    wanted = reliability.depth_hits(w.arcs(), spark.createDataFrame([(1, 0), (3, 0), (50, 0)], "source long, first int"), 3, 200)
    assert found == {tuple(r) for r in wanted.collect()} and len(w.counts(3).parts) == 2
    assert len(w._packed) == 2 and w.packed().count() == 4
    firsts = [(1, 65), (3, 0), (50, 199)]
    together = reliability.packed_hits(w.packed().coalesce(1), firsts, 3, 200)
    assert sorted(map(tuple, together.collect())) == sorted(map(tuple, reliability.depth_hits(w.arcs(), spark.createDataFrame(firsts, "source long, first int"), 3, 200).collect()))


def test_only_the_clustering_that_stands_is_made(spark, monkeypatch):
    made = []
    monkeypatch.setattr(clustering, "cover", lambda *args, own=clustering.cover: made.append(args) or own(*args))
    edges = spark.createDataFrame(random_edges(random.Random(7), 12, 30), EDGES)
    found = clustering.mcp(Worlds(edges), k=3, depth=2)
    assert len(found.steps) > 1 and len(made) == 1
    w = Worlds(edges)
    w.reach(1.0)
    assert clustering.greedy_at(w, 1.0, 3, 3, clustering.ALGORITHM_SEED, 0, 2)[1] == found.steps[0]["uncovered"]
    assert found.table.filter("center is null").isEmpty() and found.table.count() == w.vertices.count()


@pytest.mark.parametrize(("listing", "cells", "part"), [(5, 1 << 17, 2000), (5, 40, 11), (0, 40, 11), (10**9, 1 << 17, 3)])
def test_pairs_are_counted_by_bits_of_worlds_and_by_lists(spark, monkeypatch, listing, cells, part):
    """Over two numbers of worlds, with components of all sizes and vertices that some worlds lack, against brute force."""
    monkeypatch.setattr(reliability, "LISTED", 3)
    monkeypatch.setattr(reliability, "LISTING", listing)
    monkeypatch.setattr(reliability, "CELLS", cells)
    monkeypatch.setattr(reliability, "PART", part)
    rng, r = random.Random(8), 70
    rows = [(w, v, rng.choices([0, 1, 2, 3 + v % 4, 100 + v], [9, 4, 2, 2, 3])[0] + 1000 * (v % 2)) for w in range(r) for v in range(30) if rng.random() < 0.95]
    rows += [(w, 50 + v, 5000 + v // 2) for w in range(r) for v in range(4)]
    wanted: dict = {}
    for world in range(r):
        here = sorted((v, c) for w, v, c in rows if w == world)
        for (a, ca), (b, cb) in itertools.combinations(here, 2):
            if ca == cb:
                wanted[a, b] = wanted.get((a, b), 0) + 1
    comps = spark.createDataFrame(rows, "world long, vertex long, comp long")
    for least in (0.0, 0.25):
        found = reliability.pair_counts(comps, r, least).collect()
        assert {(x.a, x.b): x.n for x in found} == {k: n for k, n in wanted.items() if n / r >= least} and len(found) == len({(x.a, x.b) for x in found})


def test_probabilities_of_pairs_are_looked_up(spark):
    """Before, each pair of the result was rounded as a decimal number."""
    found = entry.queries()["conn_prob_pairs"](spark, "/root/testdata/sf0.001")
    assert "round(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert dict(found.dtypes) == {"a": "bigint", "b": "bigint", "probability": "double"}
