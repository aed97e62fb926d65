"""Known answers, invariants and formats of the possible-world operators."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tyche import storage
from tyche.functions import chance
from tyche.operators import clustering, evaluate, graph, greedy, guess, reliability, report, scores
from tyche.operators.components import components
from tyche.operators.worlds import Worlds, world_bits, world_components, world_edges
from tyche.sources import clusters as cs
from tyche.sources import edges as es
from tyche.sources import results


def uncertain(spark, *rows):
    return spark.createDataFrame(list(rows), "src long, dst long, probability double")


def as_map(df, key="vertex", value="probability"):
    return {r[key]: r[value] for r in df.collect()}


def test_components_of_several_graphs(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(30), rng.randrange(30)) for g in range(3) for _ in range(22)]
    found = {(r.g, r.vertex): r.comp for r in components(spark.createDataFrame(rows, "g int, src long, dst long"), ["g"]).collect()}
    for g in range(3):
        parent = {v: v for e in rows if e[0] == g for v in e[1:]}
        changed = True
        while changed:
            changed = False
            for _, a, b in (e for e in rows if e[0] == g):
                low = min(parent[a], parent[b])
                changed |= parent[a] != low or parent[b] != low
                parent[a] = parent[b] = low
        assert {k[1]: v for k, v in found.items() if k[0] == g} == parent


def test_no_edges_no_components(spark):
    assert components(uncertain(spark).select("src", "dst")).count() == 0


@pytest.mark.parametrize("valid, rate, expected", [(0.3, 0.1, [1, 0.9, 0.8, 0.6, 0.2, 0.4, 0.3, 0.35, 0.325]), (0.3, 0.5, [1, 0.5, 0.25005]), (0.75, 0.1, [1, 0.9, 0.8, 0.6, 0.7, 0.75]), (1.0, 0.1, [1])])
def test_guesses(valid, rate, expected):
    assert guess.trace(guess.bisecting(rate, 0.0001), valid + 1e-12) == pytest.approx(expected)


def test_sample_counts():
    assert [chance.sample_count(p) for p in (1, 0.9, 0.5, 0.1, 0.01, 0.0001)] == [46, 51, 92, 460, 4605, 460517]
    assert chance.sample_count(0.01, fraction=1.0) == 46051


def test_closed_forms(spark):
    r = 4000
    edges = uncertain(spark, (0, 1, 0.6), (1, 2, 0.5), (10, 11, 0.4), (11, 12, 0.4), (10, 12, 0.4))
    comps = world_components(edges, es.vertices_of(edges), 0, r).cache()
    path, triangle = as_map(reliability.from_source(comps, 0, r)), as_map(reliability.from_source(comps, 10, r))
    assert path[0] == 1 and path[10] == 0
    assert path[1] == pytest.approx(0.6, abs=0.03) and path[2] == pytest.approx(0.3, abs=0.03)
    assert triangle[11] == pytest.approx(0.4 + 0.6 * 0.16, abs=0.03)
    arcs = reliability.arcs_of(world_bits(edges, 0, 63)).cache()
    sources = spark.createDataFrame([(0,), (10,)], "vertex long")
    by_depth = [{(x.source, x.vertex): x.probability for x in reliability.within_depth(arcs, es.vertices_of(edges), sources, d, r).collect()} for d in (1, 2)]
    assert by_depth[0][0, 2] == 0 and by_depth[0][10, 11] == pytest.approx(0.4, abs=0.03)
    assert by_depth[1][0, 2] == path[2] and by_depth[1][10, 11] == triangle[11]
    assert all(by_depth[0][k] <= by_depth[1][k] for k in by_depth[0])


def test_certain_and_impossible_edges(spark):
    edges = uncertain(spark, (0, 1, 1.0), (1, 2, 1.0), (3, 4, 0.0))
    comps = world_components(edges, es.vertices_of(edges), 0, 20)
    assert {(r.vertex, r.comp) for r in comps.collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 4)}
    assert world_edges(edges, 5, 5).count() == 0


def test_worlds_grow_by_appending(spark):
    edges = uncertain(spark, *((a, b, 0.4) for a, b in itertools.combinations(range(7), 2)))
    w = Worlds(edges)
    w.grow(5)
    early = {tuple(r) for r in w.components().collect()}
    w.grow(12)
    assert {tuple(r) for r in w.components(5).collect()} == early
    assert w.components().select("world").distinct().count() == 12
    fast = Worlds(edges, fast=True)
    fast.grow(3)
    assert fast.components().count() == 21


def test_greedy_is_the_sequential_choice(spark):
    rng = random.Random(5)
    for _ in range(4):
        n = 14
        near = {(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.2}
        covers = spark.createDataFrame([p for a, b in near for p in ((a, b), (b, a))], "a long, b long")
        order = rng.sample(range(n), n)
        ordered = spark.createDataFrame([(v, k) for k, v in enumerate(order)], "vertex long, prio long")
        expected, covered = set(), set()
        for v in order:
            if v not in covered:
                expected.add(v)
                covered |= {v} | {b for a, b in near if a == v} | {a for a, b in near if b == v}
        assert {r.vertex for r in greedy.first_independent_set(ordered, covers).collect()} == expected


def test_blocks_make_the_same_choice(spark):
    rng = random.Random(8)
    for most in (2, 30):
        order, near = rng.sample(range(40), 40), {(a, b) for a, b in itertools.product(range(40), repeat=2) if a == b or rng.random() < 0.05}
        near |= {(b, a) for a, b in near}
        expected: list = []
        for v in order:
            if len(expected) < most and not any((c, v) in near for c in expected):
                expected.append(v)
        chosen: list = []
        rest = list(order)
        while rest and len(chosen) < most:  # as the clusterings do, five at a time
            new = clustering.first_uncovered(rest[:5], near, most - len(chosen))
            chosen += new
            rest = [v for v in rest if not any((c, v) in near for c in new)]
        assert chosen == expected


def test_hits_are_kept_and_added_to(spark, two_cliques):
    w = Worlds(two_cliques)
    some, more = (spark.createDataFrame([(v,) for v in vs], "vertex long") for vs in ([0, 5], [5, 7]))
    rows = lambda df: {(r.source, r.vertex): r.hits for r in df.collect()}
    w.grow(20)
    w.hits(some), w.hits(some, depth=2)
    w.grow(50)
    assert rows(w.hits(more)) == rows(reliability.source_hits(w.components(), more, 0, 50))
    limited = {(r.source, r.vertex): r.probability for r in reliability.within_depth(w.arcs(), w.vertices, more, 2, 50).collect()}
    assert {k: n / 50 for k, n in rows(w.hits(more, depth=2)).items()} == {k: p for k, p in limited.items() if p}
    targets = spark.createDataFrame([(6,), (8,)], "vertex long")
    assert {(r.source, r.vertex): r.probability for r in reliability.within_depth(w.arcs(), w.vertices, more, 2, 50, targets).collect()} == {k: p for k, p in limited.items() if k[1] in (6, 8)}
    with pytest.raises(NotImplementedError, match="bounded"):
        reliability.set_reliability(w.components(), targets.withColumn("set_id", F.lit(1)), 50, depth=2)
    assert reliability.qualifying(reliability.from_source(w.components(), 0, 50), 0.9) >= 1


def test_too_few_worlds_are_noticed(spark, two_cliques, caplog):
    w = Worlds(two_cliques, max_worlds=60)
    assert w.reach(0.9) == 51 and not w.capped and w.reach(0.01) == 60 and w.capped
    assert "max_worlds" in caplog.text


def clusters_ok(table, n):
    rows = table.collect()
    assert len(rows) == n and all(r.center is not None and 0 <= r.probability <= 1 for r in rows)
    centers = {r.center for r in rows}
    assert all(r.is_center == (r.vertex in centers) for r in rows) and all(r.probability == 1 for r in rows if r.is_center)
    return centers


@pytest.fixture(scope="module")
def two_cliques(spark):
    rows = [(a, b, 0.9) for base in (0, 5) for a, b in itertools.combinations(range(base, base + 5), 2)] + [(4, 5, 0.2)]
    return uncertain(spark, *rows)


def test_mcp_acp_gmm(spark, two_cliques):
    found = clustering.mcp(Worlds(two_cliques), k=3)
    assert len(clusters_ok(found.table, 10)) <= 3 and found.steps[0]["p_curr"] == 1
    assert len(clusters_ok(clustering.acp(Worlds(two_cliques), k=3).table, 10)) <= 3
    assert len(clusters_ok(clustering.acp(Worlds(two_cliques), k=3, batch=4).table, 10)) <= 3
    assert len(clusters_ok(clustering.mcp(Worlds(two_cliques), k=3, depth=2).table, 10)) <= 3
    assert len(clusters_ok(clustering.acp(Worlds(two_cliques), k=3, batch=4, depth=2).table, 10)) <= 3
    assert found.time > 0 and found.performance().first().time == found.time and found.guesses().count() == len(found.steps)
    assert len(clusters_ok(clustering.gmm(Worlds(two_cliques), k=2).table, 10)) == 2
    assert len(clusters_ok(clustering.gmm(Worlds(two_cliques), k=2, compat_truncate=True).table, 10)) == 2


def test_infeasible_clusterings(spark):
    apart = uncertain(spark, (0, 1, 1.0), (1, 2, 1.0), (10, 11, 1.0))
    with pytest.raises(ValueError, match="at least 2"):
        clustering.mcp(Worlds(apart), k=1)
    with pytest.raises(ValueError, match="components"):
        clustering.acp(Worlds(uncertain(spark, (0, 1, 1.0), (2, 3, 1.0), (4, 5, 1.0))), k=2)
    with pytest.raises(RuntimeError, match="no clustering"):
        clustering.mcp(Worlds(apart, max_worlds=50), k=2, p_low=0.2)
    assert clusters_ok(clustering.mcp(Worlds(apart), k=3).table, 5) < {0, 1, 2, 10, 11}


def test_pkwik_and_mcl(spark, two_cliques):
    star = uncertain(spark, *((0, leaf, 0.5) for leaf in range(1, 6)), (6, 7, 0.3))
    found = as_map(clustering.pkwik(star), value="center")
    assert set(found) == set(range(6))
    assert set(found.values()) == {0} or found[0] != 0 and len({v for v in found.values()}) == 5
    assert len(as_map(clustering.pkwik(star, singletons=es.vertices_of(star)), value="center")) == 8
    found = as_map(clustering.mcl(two_cliques), value="center")
    assert len({found[v] for v in range(5)}) == 1 and found[0] != found[9]


def test_scores_agree(spark, two_cliques):
    w = Worlds(two_cliques)
    w.grow(50)
    comps = w.components()
    members = w.vertices.select("vertex", F.when(F.col("vertex") < 5, 0).otherwise(5).cast("long").alias("center"))
    inner = scores.vertex_pair_reliability(members, comps, 50, 10).first()
    assert inner.inner_avpr == pytest.approx(scores.vertex_pair_reliability_by_pairs(members, comps, 50).first().inner_avpr)
    alone = w.vertices.select("vertex", F.col("vertex").alias("center"))
    assert scores.vertex_pair_reliability(alone, comps, 50, 10).first().inner_avpr is None
    whole = clustering.rebuild(members, comps, 50)
    row = scores.scores(w, whole, acr=True, avpr=True, p_floor=0.5).first()
    assert 0 <= row.acr <= 1 and row.num_clusters == 2 and row.outer_avpr < row.inner_avpr
    both = reliability.average_connection_probability(comps, 10, 50).first()
    each = reliability.source_hits(comps, w.vertices, 0, 50).agg(F.sum("hits")).first()[0]
    assert both.avg_conn_prob == pytest.approx(each / 50 / 90) and both.avg_pair_prob == pytest.approx((each - 500) / 50 / 90)


def test_edge_list(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# graph\n\nb a 0.1\na\tb 0.9\na c\nc  c 0.25\n")
    g = es.read_edge_list(spark, str(tmp_path / "g.txt"))
    assert as_map(g.vertices, "label", "vertex") == {"b": 0, "a": 1, "c": 2}
    assert es.vertex_of(g, "c") == 2
    with pytest.raises(KeyError):
        es.vertex_of(g, "d")
    (tmp_path / "several").mkdir()
    (tmp_path / "several" / "1.txt").write_text("a b 0.25\n")
    (tmp_path / "several" / "2.txt").write_text("b a 0.5\n" + "c d 0.5\n" * 2000)  # read first, as it is larger
    assert [(r.line_no, r.value) for r in es.read_lines(spark, str(tmp_path / "several")).orderBy("line_no").limit(3).collect()] == [(0, "a b 0.25"), (1, "b a 0.5"), (2, "c d 0.5")]
    assert [r.probability for r in es.read_edge_list(spark, str(tmp_path / "several")).edges.orderBy("edge_id").collect()] == [0.25, 0.5]
    rows = {(r.edge_id, r.src, r.dst, r.probability) for r in g.edges.collect()}
    assert rows == {(0, 0, 1, 0.10000000149011612), (1, 1, 2, 1.0), (2, 2, 2, 0.25)}
    es.write_edge_list(g, str(tmp_path / "out"))
    again = es.read_edge_list(spark, str(tmp_path / "out"))
    assert again.edges.count() == 3
    for wrong in ("lonely\n", "a b 1.5\n"):
        (tmp_path / "w.txt").write_text(wrong)
        with pytest.raises(Exception, match="malformed"):
            es.read_edge_list(spark, str(tmp_path / "w.txt")).edges.collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        es.read_edge_list(spark, str(tmp_path / "absent"))


def test_certain_graph_operators(spark):
    edges = uncertain(spark, (0, 1, 0.5), (1, 2, 0.5), (0, 2, 0.1), (5, 6, 0.9), (7, 7, 0.5))
    assert {(r.src, r.dst) for r in graph.largest_component(edges).collect()} == {(0, 1), (1, 2), (0, 2)}
    d = as_map(graph.shortest_paths(edges, spark.createDataFrame([(0,)], "vertex long")), value="distance")
    assert d == pytest.approx({0: 0, 1: math.log(2), 2: 2 * math.log(2)})
    assert graph.induced_subgraph(edges, spark.createDataFrame([(0,), (1,)], "vertex long")).count() == 1


def test_cluster_files_and_confusion(spark, tmp_path):
    (tmp_path / "truth.txt").write_text("a b c\nd e f\ng h x\n")
    (tmp_path / "pairs.txt").write_text("a b\nb c\n")
    truth = cs.read_clusters(spark, str(tmp_path / "truth.txt"))
    pairs = cs.read_clusters(spark, str(tmp_path / "pairs.txt"))
    row = evaluate.confusion_matrix(pairs, truth).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (2, 0, 7, 27)
    (tmp_path / "apart.txt").write_text("a b d\nc e f g\n")
    for name, wanted in (("pairs", (2, 0, 7, 27)), ("apart", (2, 7, 7, 20))):
        matrix = evaluate.confusion_matrix_of_files(spark, str(tmp_path / f"{name}.txt"), str(tmp_path / "truth.txt"))
        evaluate.write_confusion(matrix, str(tmp_path / f"{name}.json"))
        row = spark.read.json(str(tmp_path / f"{name}.json")).first()
        assert (row.tp, row.fp, row.fn, row.tn) == wanted and row.tpr == pytest.approx(2 / 9)
    assert evaluate.pair_counts(truth).first() == (9, 9)
    assert evaluate.pair_counts(pairs.unionByName(truth.withColumn("cluster_id", F.col("cluster_id") + 100))).first() == (9, 11)
    assert evaluate.distinct_members(truth) == 9
    (tmp_path / "doc.json").write_text('{"tables": {"clustering": [{"label": "a", "center label": "a"}, {"label": "d", "center label": "a"}]}}')
    row = evaluate.confusion_matrix(cs.read_clusters(spark, str(tmp_path / "doc.json")), truth).first()
    assert (row.tp, row.fp) == (0, 1)
    cs.write_clusters(truth, str(tmp_path / "out"))
    assert evaluate.same_cluster_pairs(cs.read_clusters(spark, str(tmp_path / "out"))).count() == 9


def test_other_sources(spark, tmp_path):
    (tmp_path / "mips").write_text("ya|c1|x\nyb|c1|x\nyc|c2|x\n")
    (tmp_path / "ppi").write_text("ya yb 0.5\nyz yb 0.1\nbad line\n")
    known = cs.known_members(cs.read_complexes(spark, str(tmp_path / "mips")), cs.read_proteins(spark, str(tmp_path / "ppi")))
    assert {tuple(r) for r in known.collect()} == {("c1", "YA"), ("c1", "YB")}
    assert {tuple(r) for r in cs.known_complexes(spark, str(tmp_path / "mips"), str(tmp_path / "ppi")).collect()} == {("c1", "YA"), ("c1", "YB")}
    (tmp_path / "notes.csv").write_text('ORF,x,MIPS complex annotation\np,1,"c1,c2"\nq,2,NOVEL\n')
    assert {tuple(r) for r in cs.read_annotations(spark, str(tmp_path / "notes.csv")).collect()} == {("c1", "p"), ("c2", "p")}
    rows = spark.createDataFrame([("p", "x, NOVEL"), ("q", "x,y"), ("r", None)], "orf string, note string")
    assert {tuple(r) for r in cs.annotation_clusters(rows, "orf", "note").collect()} == {("x", "p"), ("x", "q"), ("y", "q")}
    (tmp_path / "d.xml").write_text("<dblp><article key='journals/1'><author>A B</author><author>C</author><year>2001</year></article></dblp>")
    record = es.read_xml_records(spark, str(tmp_path / "d.xml"), "article").select("_key", F.transform("author", es.person_name).alias("a")).first()
    assert record._key == "journals/1" and record.a == ["A_B", "C"]


def test_result_documents(spark, tmp_path):
    rows = spark.createDataFrame([(0.5, float("nan"))], "`p_min` double, `average probability` double")
    results.save_run(str(tmp_path / "run"), {"algorithm": "mcp", "k": 3, "input": "g.txt"}, {"scores": rows}, date="2017-05-01T10:00:00")
    back = results.load_table(spark, str(tmp_path / "run"), "scores").first()
    assert back.p_min == 0.5 and back.asDict().get("average probability") is None
    assert back.algorithm == "mcp" and back.k == 3 and str(back.date) == "2017-05-01 10:00:00"
    with pytest.raises(ValueError, match="no document"):
        results.load_table(spark, str(tmp_path / "run"), "absent")
    doc = spark.read.option("multiLine", True).json(str(tmp_path / "run"))
    assert results.graph_path(doc) == "g.txt" and results.graph_path(doc, "h.txt") == "h.txt"
    vertices = spark.createDataFrame([(0, "a"), (1, "b")], "vertex long, label string")
    covered = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.5)], "vertex long, center long, probability double")
    assert {tuple(r) for r in results.clustering_rows(covered, vertices).collect()} == {(0, 0, "a", "a", 1.0), (1, 0, "b", "a", 0.5)}
    with pytest.raises(Exception, match="not covered"):
        results.clustering_rows(covered.withColumn("center", F.lit(None).cast("long")), vertices).collect()


def test_scores_are_added_to_a_document(spark, tmp_path):
    first = spark.createDataFrame([(1, 1, 1.0)], "id int, center int, probability double")
    results.save_run(str(tmp_path / "run"), {"algorithm": "mcp"}, {"clustering": first, "scores": first})
    results.with_tables(spark, str(tmp_path / "run"), str(tmp_path / "scored"), {"scores": spark.createDataFrame([(0.25, float("inf"))], "acr double, `inner-avpr` double")})
    assert results.load_table(spark, str(tmp_path / "scored"), "scores").first().acr == 0.25
    assert results.load_table(spark, str(tmp_path / "scored"), "clustering").first().center == 1
    assert scores.needs_scores(["p_min"]) and not scores.needs_scores(["p_min", "acr", "inner-avpr", "outer-avpr", "x"])
    (tmp_path / "lines.json").write_text('{"k": 3, "time": 2.0}\n{"k": 4, "time": 4.0}\n')
    assert {(r.k, r.algorithm) for r in results.load_json_lines(spark, str(tmp_path / "lines.json"), "mcl").collect()} == {(3, "mcl"), (4, "mcl")}
    runs = spark.createDataFrame([("DBLP", 3, "mcp", 2.0), ("DBLP", 3, "mcp", 4.0), ("Gavin", 3, "mcp", 9.0)], "input string, k int, algorithm string, time double")
    assert [tuple(r) for r in report.scalability(runs, "DBLP").collect()] == [(3, "mcp", 3.0)]


def test_fast_coins_are_uniform(spark):
    row = spark.range(20_000).select(chance.fast_uniform(F.lit(1), F.col("id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u"), F.avg((F.col("u") < 0.25).cast("int"))).first()
    assert 0 <= row[0] < row[1] < 1 and row[2] == pytest.approx(0.5, abs=0.01) and row[3] == pytest.approx(0.25, abs=0.015)


def test_a_shared_folder_is_demanded_of_clusters(spark, monkeypatch):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_folder(Elsewhere)


def test_cached_table(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(source)

    for _ in range(2):
        assert results.cached_table(build, str(tmp_path / "cache"), spark.read.parquet(source)).count() == 3
    assert len(calls) == 1


def test_report_expressions(spark):
    df = spark.createDataFrame([("x/collins-lcc.txt", 0.1234, 1234.4), ("other.a.txt", 0.0, 0.0)], "input string, a double, b double")
    rows = df.select(report.input_name(F.col("input")).alias("n"), chance.format_point(F.col("a")).alias("p"), chance.format_exponent(F.col("b")).alias("e")).collect()
    assert [tuple(r) for r in rows] == [("Collins", "$.123$", r"$1.234\cdot 10^{+03}$"), ("other", "$< 10^{-3}$", r"$0.000\cdot 10^{+00}$")]
