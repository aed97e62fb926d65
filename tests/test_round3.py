"""What a review of round 3 found: number formats, listed pairs, searches, components and flow on larger graphs."""

from __future__ import annotations

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tyche.functions import chance
from tyche.operators import clustering, components, evaluate, reliability, scores
from tyche.operators.worlds import Worlds
from tyche.sources import edges as es

EDGES = "src long, dst long, probability double"


def test_exponents_round_halves_as_c_does(spark):
    values = [50125.0, 50135.0, 123450.0, -50125.0, 10.125, 10.375, 10.005, 1.0005, 99995.0, 0.0, 2.5, 1e22]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [tuple(r) for r in df.select("v", chance.format_exponent(F.col("v")), chance.format_point(F.abs("v") / 1e6)).collect()]
    sql = r"""SELECT '$' || replace(printf('%.3E', round(v::DOUBLE, 3)), 'E', '\cdot 10^{') || '}$', CASE WHEN v = 0 THEN '$< 10^{-3}$' ELSE '$' || printf('%.3f', round(abs(v::DOUBLE) / 1e6, 3))[2:] || '$' END"""
    assert found == [(v, *duckdb.sql(f"{sql} FROM (SELECT '{v}'::DOUBLE AS v)").fetchall()[0]) for v in values]
    assert found[0][1] == r"$5.012\cdot 10^{+04}$" and found[1][1] == r"$5.014\cdot 10^{+04}$"
    assert spark.createDataFrame([(None,)], "v double").select(chance.format_exponent(F.col("v"))).first()[0] is None


def random_edges(rng, n, m):
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return [(a, b, round(rng.uniform(0.2, 0.95), 3)) for a, b in sorted(pairs)]


def test_a_task_holds_one_graph_at_a_time(spark, monkeypatch):
    """Graphs leave a task in order of their keys, across chunks; before, batches that differ in what they say of nulls were an error."""
    rng = random.Random(1)
    rows = [(w, min(a, b), max(a, b)) for w in range(23) for a, b, _ in random_edges(rng, 40, 25)] + [(None, 3, 4), (None, 4, 900)]
    wanted = {}
    for key in {r[0] for r in rows}:
        label = {v: v for r in rows if r[0] == key for v in r[1:]}
        for _ in label:
            for _, a, b in (r for r in rows if r[0] == key):
                label[a] = label[b] = min(label[a], label[b])
        wanted |= {(key, v): c for v, c in label.items()}
    monkeypatch.setattr(components, "CHUNK", 40)
    df = spark.createDataFrame(rows, "world long, src long, dst long").withColumn("world", F.when(F.col("world").isNotNull(), F.col("world")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        found = {(r.world, r.vertex): r.comp for r in components.components(df, ["world"]).collect()}
        mixed = spark.range(900).select(F.lit(0).cast("long").alias("world"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
        assert {r.comp for r in components.components(mixed, ["world"]).collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == wanted


def test_pairs_of_small_and_large_components(spark, monkeypatch):
    """Pairs of vertices in large components come from blocks, others are listed; both against brute force."""
    monkeypatch.setattr(reliability, "LISTED", 4)
    rng = random.Random(2)
    rows = []
    for world in range(9):
        for v in range(60):
            rows.append((world, v, v if v % 7 == 0 else rng.choice([0, 1]) * 20 + 60 * (v // 30) if v < 40 else 1000 + v // rng.choice([2, 3])))
    rows = [r for r in rows if r[:2] != (3, 5)]  # a vertex without a component in a world
    comps = spark.createDataFrame(rows, "world long, vertex long, comp long")
    wanted = {}
    for (wa, a, ca), (wb, b, cb) in itertools.product(rows, rows):
        if wa == wb and ca == cb and a < b:
            wanted[a, b] = wanted.get((a, b), 0) + 1
    for part in (1000, 6):
        monkeypatch.setattr(reliability, "PART", part)
        for least in (0.0, 4 / 9):
            found = reliability.pair_probabilities(comps, 9, least).collect()
            assert {(r.a, r.b): round(9 * r.probability) for r in found} == {k: n for k, n in wanted.items() if n / 9 >= least} and len(found) == len({(r.a, r.b) for r in found})


def pairs_of(rows):
    groups: dict = {}
    for c, m in rows:
        groups.setdefault(c, set()).add(m)
    return {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}


def test_listed_pairs_of_overlapping_clusters(spark, monkeypatch):
    """Each pair once and without a shuffle of pairs; the clusters of a small table are dealt to the session's number of tasks."""
    rng = random.Random(3)
    rows = [(c, m) for c in range(5) for m in rng.sample(range(60), 25)] * 2
    monkeypatch.setattr(es.pairs_within, "__defaults__", (4,))
    found = evaluate.same_cluster_pairs(spark.createDataFrame([*rows, (None, 1), (None, 2), (1, None)], "cluster_id int, member int"))
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(pairs_of(rows))
    spread = evaluate.same_cluster_pairs(spark.range(600).select(F.lit(1).alias("cluster_id"), F.col("id").alias("member"))).groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and sum(r["count"] for r in spread) == 600 * 599 // 2


@pytest.mark.parametrize("sets", [4096, 1])
def test_pairs_by_sets_and_by_classes_of_clusters(spark, monkeypatch, sets):
    monkeypatch.setattr(evaluate, "SETS", sets)
    rng = random.Random(4)
    truth = [(c, m) for c in range(5) for m in rng.sample(range(40), 15)] + [(9, 55)]
    own = [(c, m) for c in range(6) for m in rng.sample(range(40), 12)]
    names, df = {m for _, m in truth}, lambda rows: spark.createDataFrame(rows, "cluster_id int, member int")
    found, wanted = evaluate.confusion_matrix(df(own), df(truth)).first(), pairs_of(truth)
    got = pairs_of([x for x in own if x[1] in names])
    assert (found.tp, found.fp, found.fn) == (len(got & wanted), len(got - wanted), len(wanted - got))
    assert evaluate.pair_counts(df(own)).first().distinct_pairs == len(pairs_of(own))


def test_pairs_of_a_cluster_are_counted(spark):
    """200,000 vertices of one cluster in one component make 2 * 10^10 pairs, which cannot be listed."""
    n = 200_000
    comps = spark.range(n).select(F.lit(0).cast("long").alias("world"), F.col("id").alias("vertex"), F.lit(0).cast("long").alias("comp"))
    members = spark.range(n).select(F.col("id").alias("vertex"), F.lit(0).cast("long").alias("center"))
    assert scores.vertex_pair_reliability_by_pairs(members, comps, 1).first().inner_avpr == 1.0


def test_a_search_by_blocks_of_worlds_is_that_of_all(spark, monkeypatch):
    edges = spark.createDataFrame([*random_edges(random.Random(5), 14, 24), (7, 7, 0.5), (50, 51, 0.0)], EDGES)
    w = Worlds(edges)
    w.grow(150)
    firsts = [(0, 0), (3, 65), (5, 149), (6, 150), (51, 10)]
    for depth, most in ((0, 1 << 22), (1, 20), (3, 1 << 22)):
        monkeypatch.setattr(reliability, "ELEMENTS", most)
        wanted = reliability.depth_hits(w.arcs(), spark.createDataFrame(firsts, "source long, first int"), depth, 150)
        assert sorted(map(tuple, reliability.block_hits(w.arcs(), firsts, depth, 150).collect())) == sorted(map(tuple, wanted.collect()))


def test_what_no_guess_can_cover_is_an_error_at_once(spark, monkeypatch):
    """Three components, of which two centers cover two: no world is drawn to find that out."""
    monkeypatch.setattr(Worlds, "reach", lambda *_: pytest.fail("a world was drawn"))
    three = spark.createDataFrame([(10 * c + a, 10 * c + a + 1, 0.9) for c in range(3) for a in range(4)], EDGES)
    with pytest.raises(RuntimeError, match="no clustering"):
        clustering.mcp(Worlds(three), k=3, depth=4)


@pytest.mark.parametrize(("columns", "products", "entries"), [(1800, 1 << 22, 1100), (4, 60, 1100), (6, 1 << 22, 3), (1, 4, 1100)])
def test_a_flow_is_squared_by_blocks_of_columns(spark, monkeypatch, columns, products, entries):
    """Whole components and parts of them against dense matrices; before, sums of products by entry were shuffled."""
    monkeypatch.setattr(clustering, "ROW_PART", columns)
    monkeypatch.setattr(clustering, "PRODUCTS", products)
    rng = random.Random(6)
    edges = [(30 * c + a, 30 * c + b, p) for c in range(3) for a, b, p in random_edges(rng, 5 + 12 * c, 9 + 30 * c)]
    matrix = clustering.kept(clustering.mcl_matrix(spark.createDataFrame(edges, EDGES)), "matrix")
    m = np.zeros((100, 100))
    for r in matrix.collect():
        m[r.i, r.j] = r.v
    m = m @ m
    m = np.where(m >= 1e-3, m, 0) ** 2
    for j in range(100):
        m[sorted(range(100), key=lambda i: (-m[i, j], i))[entries:], j] = 0  # noqa: B023
    wanted = {(i, j): m[i, j] / m[:, j].sum() for i, j in zip(*m.nonzero(), strict=True)}
    step = clustering.mcl_step(matrix, 2.0, 1e-3, entries)
    found = {(r.i, r.j): r.v for r in step.collect()}
    assert found == pytest.approx(wanted)
    plan = step._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")] and "HashAggregate" not in plan[: plan.index("MapInArrow")]
