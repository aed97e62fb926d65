"""The library's queries by name: each applies an operator to the test tables' graph of suppliers.

Suppliers are linked by orders that both deliver 48 pieces or more to; 46 worlds are what probability 1 asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chance
from ..operators import clustering as cl
from ..operators import evaluate, graph, greedy, guess, reliability, report, scores
from ..operators.worlds import Worlds, world_bits, world_components, world_edges
from ..sources import clusters as cs
from ..sources import edges as es
from ..sources import results
from ..storage import fresh_path, kept

WORLDS, SEED, CENTERS = 46, 42, 5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return es.cooccurrence_edges(table(spark, sf_dir, "lineitem").filter("l_quantity >= 48"), "l_orderkey", "l_suppkey")


def world_table(spark: SparkSession, sf_dir: str, r: int = WORLDS) -> tuple[DataFrame, DataFrame]:
    """Vertices and the components of the worlds, kept."""
    edges = kept(suppliers(spark, sf_dir), "edges")
    vertices = kept(es.vertices_of(edges), "vertices")
    return vertices, kept(world_components(edges, vertices, 0, r, SEED), "components")


def lowest(vertices: DataFrame) -> int:
    return vertices.agg(F.min("vertex")).first()[0]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine digits, so that engines that add in another order agree."""
    return df.select(*(F.round(c, 9).alias(c) if k == "double" else c for c, k in df.dtypes))


def first_centers(vertices: DataFrame) -> DataFrame:
    return vertices.orderBy("vertex").limit(CENTERS).select("vertex")


def fixed_clustering(vertices: DataFrame, comps: DataFrame) -> DataFrame:
    """Each vertex with the most probable of the first centers; ties to the lower id."""
    centers = first_centers(vertices)
    hits = reliability.source_hits(comps, centers, 0, WORLDS)
    near = hits.select("vertex", F.col("source").alias("center"), F.col("source").alias("center_rank"), (F.col("hits") / F.lit(WORLDS)).alias("probability"))
    met = greedy.best_covers(near)
    first = lowest(vertices)
    filled = vertices.join(met, "vertex", "left")
    return filled.select("vertex", F.coalesce("center", F.lit(first)).alias("center"), F.coalesce("is_center", F.lit(False)).alias("is_center"), F.coalesce("probability", F.lit(0.0)).alias("probability"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """The edges as text with a comment, a blank line, probabilities left out and reversed repeats."""
    p = F.format_string("%.6f", "probability")
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    at = F.col("src") * 100_000 + F.col("dst")
    full = edges.select((at * 4).alias("line_no"), F.when(F.col("dst") % 10 == 0, F.concat_ws(" ", name("src"), name("dst"))).otherwise(F.concat_ws("\t", name("src"), name("dst"), p)).alias("value"))
    again = edges.filter("src % 3 = 0").select((at * 4 + 1).alias("line_no"), F.concat_ws(" ", name("dst"), name("src"), F.lit("0.5")).alias("value"))
    extra = edges.sparkSession.createDataFrame([(-2, "# suppliers"), (-1, ""), (0, "   ")], "line_no long, value string")
    return full.unionByName(again).unionByName(extra)


def supplier_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fixed clusters and, as truth, the suppliers' nations."""
    vertices, comps = world_table(spark, sf_dir)
    found = fixed_clustering(vertices, comps).select(F.col("center").alias("cluster_id"), F.col("vertex").alias("member"))
    truth = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cluster_id"), F.col("s_suppkey").alias("member"))
    return found, truth


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("cluster_id"), F.col("p_partkey").alias("member"))


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of runs: an algorithm, an input, k and measures for each flag, status and month of shipping."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", F.month("l_shipdate").alias("month"))
    rows = line.agg(F.avg("l_discount").alias("p_min"), F.avg("l_tax").alias("average probability"), F.count("*").alias("time"))
    named = F.when(F.col("l_returnflag") == "A", "k-center").when(F.col("l_returnflag") == "N", "k-median").otherwise("gmm")
    file = F.when(F.col("l_linestatus") == "F", "data/collins-lcc.txt").otherwise("data/dblp-vldb.lcc.txt")
    return rows.select(F.concat_ws("-", "l_returnflag", "l_linestatus", "month").alias("run"), named.alias("algorithm"), file.alias("input"), (F.col("month") % 4 + 2).cast("long").alias("k"), "p_min", "average probability", F.col("time").cast("double").alias("time"))


# --- edges, vertices, certain graphs


@query
def edge_cooccurrence(spark, sf_dir):
    return suppliers(spark, sf_dir).select("src", "dst", "cnt")


@query
def edge_probability(spark, sf_dir):
    edges = suppliers(spark, sf_dir)
    return rounded(edges.select("src", "dst", "probability", chance.edge_weight(F.col("probability")).alias("weight")))


@query
def edge_text_parse(spark, sf_dir):
    g = es.graph_from_lines(edge_lines(suppliers(spark, sf_dir)))
    return rounded(g.edges)


@query
def vertex_dictionary(spark, sf_dir):
    return es.vertex_dictionary(es.parse_edge_lines(edge_lines(suppliers(spark, sf_dir))))


@query
def static_components(spark, sf_dir):
    return graph.static_components(suppliers(spark, sf_dir))


@query
def component_sizes(spark, sf_dir):
    return graph.component_sizes(graph.static_components(suppliers(spark, sf_dir)))


@query
def lcc_edges(spark, sf_dir):
    return graph.largest_component(suppliers(spark, sf_dir).filter("cnt >= 2")).select("src", "dst", "cnt")


@query
def induced_subgraph(spark, sf_dir):
    nations = table(spark, sf_dir, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("vertex"))
    return graph.induced_subgraph(suppliers(spark, sf_dir), nations).select("src", "dst", "cnt")


@query
def symmetric_edges(spark, sf_dir):
    return graph.both_directions(suppliers(spark, sf_dir), "cnt")


@query
def article_filter(spark, sf_dir):
    """Orders as articles, their suppliers as authors."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    authors = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("authors"))
    kind = F.concat_ws("/", F.when(F.col("o_orderpriority").startswith("1"), "article").when(F.col("o_orderpriority").startswith("2"), "inproceedings").otherwise("www"), F.col("o_orderkey").cast("string"))
    articles = orders.join(authors, "o_orderkey").select(kind.alias("key"), F.year("o_orderdate").alias("year"), "authors", (F.col("o_orderstatus") == "P").alias("informal"))
    good = es.valid_article(F.col("year"), F.col("authors"), F.col("key"), F.col("informal"), 1996, ("article", "inproceedings"))
    return articles.filter(good).select("key", "year", F.size("authors").alias("n_authors"))


# --- worlds and reliability


@query
def world_edge_counts(spark, sf_dir):
    return world_edges(suppliers(spark, sf_dir), 0, WORLDS, SEED).groupBy("world").agg(F.count("*").alias("n_edges"))


@query
def edge_survival_rate(spark, sf_dir):
    edges = suppliers(spark, sf_dir)
    alive = world_edges(edges, 0, WORLDS, SEED).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return rounded(edges.join(alive, ["src", "dst"], "left").select("src", "dst", "probability", (F.coalesce("n", F.lit(0)) / F.lit(WORLDS)).alias("rate")))


@query
def world_component_table(spark, sf_dir):
    return world_table(spark, sf_dir)[1]


@query
def world_component_sizes(spark, sf_dir):
    comps = world_table(spark, sf_dir)[1]
    return comps.groupBy("world", "comp").agg(F.count("*").alias("size"))


@query
def progressive_worlds(spark, sf_dir):
    """Worlds sampled in three steps are those sampled at once."""
    w = Worlds(suppliers(spark, sf_dir), seed=SEED)
    for r in (10, 30, WORLDS):
        w.grow(r)
    return w.components(40).groupBy("world").agg(F.count_distinct("comp").alias("n_components"))


@query
def conn_prob_source(spark, sf_dir):
    vertices, comps = world_table(spark, sf_dir)
    return rounded(reliability.from_source(comps, lowest(vertices), WORLDS))


@query
def conn_prob_incremental(spark, sf_dir):
    vertices, comps = world_table(spark, sf_dir)
    source = vertices.filter(F.col("vertex") == lowest(vertices))
    early = reliability.source_hits(comps, source, 0, 30)
    whole = reliability.added_hits(early, reliability.source_hits(comps, source, 30, WORLDS))
    return rounded(whole.select("vertex", "hits", (F.col("hits") / F.lit(WORLDS)).alias("probability")))


@query
def conn_prob_targets(spark, sf_dir):
    vertices, comps = world_table(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    targets = table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select(F.col("s_suppkey").alias("vertex"))
    return rounded(reliability.from_source(comps, lowest(vertices), WORLDS, targets))


@query
def conn_prob_pairs(spark, sf_dir):
    """The probabilities are looked up by count: to round each pair's own takes longer than to count it."""
    pairs = reliability.pair_counts(world_table(spark, sf_dir)[1], WORLDS, 0.25)
    shares = F.array(*(F.round(F.lit(n) / F.lit(WORLDS), 9) for n in range(WORLDS + 1)))
    return pairs.select("a", "b", F.get(shares, F.col("n")).alias("probability"))


def depth_query(spark, sf_dir, depth):
    edges = kept(suppliers(spark, sf_dir), "edges")
    vertices = kept(es.vertices_of(edges), "vertices")
    source = vertices.orderBy("vertex").limit(1)
    arcs = kept(reliability.arcs_of(world_bits(edges, 0, -(-WORLDS // reliability.BITS), SEED)), "arcs")
    return rounded(reliability.within_depth(arcs, vertices, source, depth, WORLDS).select("vertex", "probability"))


@query
def conn_prob_depth2(spark, sf_dir):
    return depth_query(spark, sf_dir, 2)


@query
def conn_prob_depth4(spark, sf_dir):
    return depth_query(spark, sf_dir, 4)


@query
def set_reliability(spark, sf_dir):
    sets = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("set_id"), F.col("s_suppkey").alias("vertex"))
    return rounded(reliability.set_reliability(world_table(spark, sf_dir)[1], sets, WORLDS))


@query
def avg_conn_prob(spark, sf_dir):
    vertices, comps = world_table(spark, sf_dir)
    return rounded(reliability.average_connection_probability(comps, vertices.count(), WORLDS))


@query
def sample_sizes(spark, sf_dir):
    """For each probability that an edge has."""
    thresholds = suppliers(spark, sf_dir).select(F.round("probability", 6).alias("p")).distinct()
    return thresholds.select("p", chance.sample_count_column(F.col("p")).alias("clustering"), chance.sample_count_column(F.col("p"), fraction=1.0).alias("scoring"))


@query
def guess_trace(spark, sf_dir):
    """Searches whose guesses are valid up to what the lines of each return flag say."""
    kinds = [("exponential", 0.1), ("exponential", 0.5), ("extended", 0.1), ("geometric", 0.5)]
    start = {"exponential": guess.bisecting, "extended": lambda r, low: guess.bisecting(r, low, lag=2), "geometric": guess.geometric}
    line = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") >= 20).alias("some"), F.count("*").alias("n"))
    valid = [(r.l_returnflag, r.some * 1000 // r.n / 1000) for r in line.collect()]  # one row for each flag
    rows = [(flag, kind, rate, upto, step, p) for flag, upto in valid for kind, rate in kinds for step, p in enumerate(guess.trace(start[kind](rate, 0.0001), upto))]
    return rounded(spark.createDataFrame(rows, "flag string, guesser string, rate double, valid_up_to double, step int, guess double"))


# --- clusterings


@query
def assign_fixed_centers(spark, sf_dir):
    vertices, comps = world_table(spark, sf_dir)
    return rounded(fixed_clustering(vertices, comps))


@query
def cluster_rebuild(spark, sf_dir):
    vertices, comps = world_table(spark, sf_dir)
    return rounded(cl.rebuild(fixed_clustering(vertices, comps).select("vertex", "center"), comps, WORLDS))


@query
def cluster_groups(spark, sf_dir):
    vertices, comps = world_table(spark, sf_dir)
    return evaluate.cluster_members(fixed_clustering(vertices, comps))


def one_guess(spark, sf_dir, p, k, allowed):
    w = Worlds(suppliers(spark, sf_dir), seed=SEED)
    w.grow(WORLDS)
    return rounded(cl.greedy_at(w, p, k, allowed, cl.ALGORITHM_SEED, 0)[0])


@query
def mcp_fixed_p(spark, sf_dir):
    return one_guess(spark, sf_dir, 0.9, 6, 6 + 3)


@query
def acp_fixed_p(spark, sf_dir):
    return one_guess(spark, sf_dir, 0.97, 4, 4)


@query
def mcp(spark, sf_dir):
    return rounded(cl.mcp(Worlds(suppliers(spark, sf_dir), seed=SEED), k=6).table)


@query
def acp(spark, sf_dir):
    return rounded(cl.acp(Worlds(suppliers(spark, sf_dir), seed=SEED), k=4).table)


@query
def acp_batch(spark, sf_dir):
    return rounded(cl.acp(Worlds(suppliers(spark, sf_dir), seed=SEED), k=4, batch=8).table)


@query
def mcp_depth(spark, sf_dir):
    return rounded(cl.mcp(Worlds(suppliers(spark, sf_dir), seed=SEED), k=6, depth=4).table)


@query
def acp_completion(spark, sf_dir):
    vertices, comps = world_table(spark, sf_dir)
    w = Worlds(suppliers(spark, sf_dir), vertices, seed=SEED)
    fixed = fixed_clustering(vertices, comps)
    partial = fixed.select("vertex", F.when(F.col("probability") >= 0.9, F.col("center")).alias("center"), "is_center", F.when(F.col("probability") >= 0.9, F.col("probability")).alias("probability"))
    return rounded(cl.complete(w, kept(partial, "partial"), 1.0))


@query
def sssp_distances(spark, sf_dir):
    edges = kept(suppliers(spark, sf_dir), "edges")
    return rounded(graph.shortest_paths(edges, es.vertices_of(edges).orderBy("vertex").limit(2)))


@query
def gmm(spark, sf_dir):
    return rounded(cl.gmm(Worlds(suppliers(spark, sf_dir), seed=SEED), k=3).table)


@query
def pkwik(spark, sf_dir):
    return cl.pkwik(suppliers(spark, sf_dir))


@query
def mcl_step(spark, sf_dir):
    matrix = kept(cl.mcl_matrix(kept(suppliers(spark, sf_dir), "edges")), "mcl")
    return rounded(cl.mcl_step(matrix, 2.0, 1e-3))


@query
def mcl(spark, sf_dir):
    return cl.mcl(suppliers(spark, sf_dir), 2.0, prune=1e-3)


# --- scores and agreement


@query
def score_basic(spark, sf_dir):
    return rounded(scores.basic_scores(fixed_clustering(*world_table(spark, sf_dir))))


@query
def score_acr(spark, sf_dir):
    vertices, comps = world_table(spark, sf_dir)
    return rounded(scores.average_cluster_reliability(fixed_clustering(vertices, comps), comps, WORLDS))


@query
def score_avpr(spark, sf_dir):
    vertices, comps = world_table(spark, sf_dir)
    return rounded(scores.vertex_pair_reliability(fixed_clustering(vertices, comps), comps, WORLDS, vertices.count()))


@query
def score_avpr_pairs(spark, sf_dir):
    vertices, comps = world_table(spark, sf_dir)
    return rounded(scores.vertex_pair_reliability_by_pairs(fixed_clustering(vertices, comps), comps, WORLDS))


@query
def score_fill_in(spark, sf_dir):
    vertices, comps = world_table(spark, sf_dir)
    basic = scores.basic_scores(fixed_clustering(vertices, comps))
    old = spark.createDataFrame([(0.125, None)], "p_min double, average_probability double")
    return rounded(scores.missing_scores(old, basic))


@query
def same_cluster_pairs(spark, sf_dir):
    truth = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cluster_id"), F.col("s_suppkey").alias("member"))
    return evaluate.same_cluster_pairs(truth)


@query
def confusion_matrix(spark, sf_dir):
    return rounded(evaluate.confusion_matrix(*supplier_clusters(spark, sf_dir)))


@query
def confusion_by_group(spark, sf_dir):
    """Several clusterings against one truth: suppliers by account balance, cut into 2 to 6 parts."""
    s = table(spark, sf_dir, "supplier")
    parts = s.select(F.explode(F.sequence(F.lit(2), F.lit(6))).alias("depth"), F.col("s_suppkey").alias("member"))
    actual = parts.select("depth", (F.col("member") % F.col("depth")).alias("cluster_id"), "member")
    truth = s.select(F.col("s_nationkey").alias("cluster_id"), F.col("s_suppkey").alias("member"))
    return rounded(evaluate.confusion_matrix(actual, truth, ("depth",)))


@query
def complex_stats(spark, sf_dir):
    return rounded(evaluate.size_statistics(brands(spark, sf_dir)))


@query
def complex_filter(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(F.col("l_partkey").alias("member"))
    return cs.known_members(brands(spark, sf_dir), sold).groupBy("cluster_id").agg(F.count("*").alias("size"))


@query
def annotation_clusters(spark, sf_dir):
    notes = F.concat_ws(", ", "p_brand", F.when(F.col("p_size") > 25, "NOVEL").otherwise(F.concat(F.lit("size"), F.col("p_size").cast("string"))))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("orf"), notes.alias("note"))
    return cs.annotation_clusters(rows, "orf", "note").groupBy("cluster_id").agg(F.count("*").alias("size"))


# --- reports


@query
def result_flatten(spark, sf_dir):
    """Documents of runs written as JSON and read back as one table of rows and tags."""
    rows = result_rows(spark, sf_dir)
    path = fresh_path(spark, "runs")
    tags, own = ("algorithm", "input", "k"), ("p_min", "average probability", "time")
    row = F.struct(*(F.col(f"`{c}`") for c in own), F.lit("row").alias("algorithm"))
    docs = rows.select(F.lit("2017-01-01T00:00:00").alias("date"), F.struct("run", *tags).alias("tags"), F.struct(F.array(row).alias("scores")).alias("tables"))
    docs.write.json(path)
    flat = results.flatten(spark.read.json(path), "scores")
    return rounded(flat.select("run", *tags, *(F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in own)))


@query
def scores_join_perf(spark, sf_dir):
    rows = result_rows(spark, sf_dir)
    times = rows.filter("k != 3").select(F.col("run").alias("date"), "time")
    return rounded(report.scores_with_times(rows.select(F.col("run").alias("date"), "algorithm", "p_min"), times))


@query
def replace_normalize(spark, sf_dir):
    rows = result_rows(spark, sf_dir).withColumn("input", report.input_name(F.col("input")))
    return report.renamed_values(rows, "algorithm", report.ALGORITHMS).select("run", "algorithm", "input")


@query
def wanted_rows(spark, sf_dir):
    rows = result_rows(spark, sf_dir).withColumn("input", report.input_name(F.col("input")))
    return report.wanted_rows(rows, large_k=(5,), least_k=2).select("run", "input", "k")


@query
def group_mean(spark, sf_dir):
    return rounded(report.group_means(result_rows(spark, sf_dir), ["algorithm", "k"], ["p_min", "time"]))


@query
def group_mean_max(spark, sf_dir):
    return rounded(report.highest_means(result_rows(spark, sf_dir), ["k", "algorithm", "input"], ["p_min", "time"]))


@query
def pivot_depth(spark, sf_dir):
    means = report.group_means(result_rows(spark, sf_dir), ["algorithm", "k"], ["time"])
    return rounded(report.pivoted(means, "k", "algorithm", "time", ["gmm", "k-center", "k-median"]).withColumnsRenamed({"k-center": "k_center", "k-median": "k_median"}))


@query
def unpivot_measures(spark, sf_dir):
    return rounded(report.unpivoted(result_rows(spark, sf_dir), ["run"], ["p_min", "average probability", "time"]))


@query
def union_by_name(spark, sf_dir):
    rows = result_rows(spark, sf_dir)
    return rounded(report.union_by_name(rows.filter("algorithm = 'gmm'").select("run", "p_min"), rows.filter("algorithm != 'gmm'").select("run", "k")))


@query
def number_formats(spark, sf_dir):
    rows = result_rows(spark, sf_dir)
    return rows.select("run", chance.format_point(F.round("p_min", 6)).alias("point"), chance.format_exponent(F.col("time")).alias("exponent"))


# --- files: what is written is read again


def supplier_names(vertices: DataFrame) -> DataFrame:
    return vertices.select("vertex", F.concat(F.lit("s"), F.col("vertex").cast("string")).alias("label"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cluster_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("member"))


@query
def edge_list_file(spark, sf_dir):
    edges = kept(suppliers(spark, sf_dir).withColumn("probability", (F.floor(F.col("probability") * 1024) / 1024)), "edges")
    path = fresh_path(spark, "edge-list")
    es.write_edge_list(es.Graph(supplier_names(es.vertices_of(edges)), edges), path)
    g = es.read_edge_list(spark, path)
    named = g.edges.join(g.vertices.toDF("src", "a"), "src").join(g.vertices.toDF("dst", "b"), "dst")
    return rounded(named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "probability"))


@query
def label_lookup(spark, sf_dir):
    """The number that the dictionary gives the label which is last by name."""
    g = es.graph_from_lines(edge_lines(suppliers(spark, sf_dir)))
    label = g.vertices.agg(F.max("label")).first()[0]
    return spark.createDataFrame([(label, es.vertex_of(g, label))], "label string, vertex long")


@query
def cluster_lines_file(spark, sf_dir):
    path = fresh_path(spark, "clusters")
    cs.write_clusters(nations(spark, sf_dir), path)
    return cs.read_clusters(spark, path)


@query
def clustering_document(spark, sf_dir):
    vertices, comps = world_table(spark, sf_dir)
    rows = results.clustering_rows(fixed_clustering(vertices, comps), supplier_names(vertices))
    path = results.save_run(fresh_path(spark, "documents"), {"algorithm": "mcp", "k": CENTERS}, {"clustering": rows}, "2017-05-01T10:00:00")
    return rounded(results.load_table(spark, path, "clustering").withColumnRenamed("center label", "center_label").drop("date"))


@query
def confusion_of_files(spark, sf_dir):
    """The clustering in a result document against the lines of a ground truth, and back from JSON."""
    vertices, comps = world_table(spark, sf_dir)
    rows = results.clustering_rows(fixed_clustering(vertices, comps), supplier_names(vertices))
    document = results.save_run(fresh_path(spark, "documents"), {"algorithm": "mcp"}, {"clustering": rows})
    truth, matrix = fresh_path(spark, "truth"), fresh_path(spark, "matrix")
    cs.write_clusters(nations(spark, sf_dir), truth)
    evaluate.write_confusion(evaluate.confusion_matrix_of_files(spark, document, truth), matrix)
    names = ["tp", "fp", "fn", "tn", "tpr", "fpr", "fnr", "tnr"]
    return rounded(spark.read.schema(", ".join(f"{c} {'long' if len(c) == 2 else 'double'}" for c in names)).json(matrix))


@query
def scored_document(spark, sf_dir):
    """A document of runs with a table of means put beside its own."""
    rows = result_rows(spark, sf_dir)
    path = results.save_run(fresh_path(spark, "documents"), {"graph": "lines"}, {"runs": rows})
    means = report.group_means(rows, ["algorithm", "k"], ["time"])
    whole = results.with_tables(spark, path, fresh_path(spark, "scored"), {"means": means})
    own, new = (results.load_table(spark, whole, name).drop("date") for name in ("runs", "means"))
    return rounded(own.select("run", "graph", "algorithm", "k", F.col("time").alias("run_time")).join(new.select("algorithm", "k", "time"), ["algorithm", "k"]))


@query
def json_lines_file(spark, sf_dir):
    path = fresh_path(spark, "lines")
    result_rows(spark, sf_dir).select("run", "k", "time").write.json(path)
    return rounded(results.load_json_lines(spark, path, "pkwik"))


@query
def known_complexes_file(spark, sf_dir):
    complexes, pairs = fresh_path(spark, "complexes"), fresh_path(spark, "interactions")
    nations(spark, sf_dir).select(F.concat_ws("|", "member", F.concat(F.lit("n"), F.col("cluster_id").cast("string")))).write.text(complexes)
    edges = suppliers(spark, sf_dir).filter("cnt >= 2")
    edges.select(F.concat_ws(" ", F.concat(F.lit("s"), F.col("src").cast("string")), F.concat(F.lit("s"), F.col("dst").cast("string")), F.col("probability").cast("string"))).write.text(pairs)
    return cs.known_complexes(spark, complexes, pairs)


@query
def annotation_file(spark, sf_dir):
    path = fresh_path(spark, "annotations")
    notes = F.concat_ws(", ", "p_brand", F.when(F.col("p_size") > 25, "NOVEL").otherwise(F.concat(F.lit("size"), F.col("p_size").cast("string"))))
    table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("ORF"), notes.alias("MIPS complex annotation")).write.option("header", True).csv(path)
    return cs.read_annotations(spark, path).groupBy("cluster_id").agg(F.count("*").alias("size"))


@query
def xml_records(spark, sf_dir):
    """Orders as records of compressed dumps."""
    path = fresh_path(spark, "dump")
    authors = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    orders = table(spark, sf_dir, "orders").join(authors, "o_orderkey")
    persons = F.array_join(F.transform("s", lambda s: F.concat(F.lit("<author>Supplier "), s.cast("string"), F.lit("</author>"))), "")
    line = F.concat(F.lit('<article key="journals/'), F.col("o_orderkey").cast("string"), F.lit('"><year>'), F.year("o_orderdate").cast("string"), F.lit("</year>"), persons, F.lit("</article><www/>"))
    orders.select(line).write.option("compression", "gzip").text(path)
    records = es.read_packed_xml_records(spark, path, "article")
    return records.select(F.col("_key").alias("key"), F.col("year").cast("long").alias("year"), F.array_join(F.transform(F.col("author").cast("array<string>"), es.person_name), " ").alias("authors"))


@query
def cached_means(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    path = fresh_path(spark, "cache")
    build = lambda: report.group_means(result_rows(spark, sf_dir), ["k"], ["time"])
    results.cached_table(build, path, lines)
    return rounded(results.cached_table(lambda: lines.limit(0), path, lines))


# --- further counts


@query
def conn_prob_depth_targets(spark, sf_dir):
    edges = kept(suppliers(spark, sf_dir), "edges")
    vertices = kept(es.vertices_of(edges), "vertices")
    targets = table(spark, sf_dir, "supplier").filter("s_nationkey % 5 = 2").select(F.col("s_suppkey").alias("vertex"))
    arcs = kept(reliability.arcs_of(world_bits(edges, 0, -(-WORLDS // reliability.BITS), SEED)), "arcs")
    return rounded(reliability.within_depth(arcs, vertices, vertices.orderBy("vertex").limit(1), 2, WORLDS, targets).select("vertex", "probability"))


@query
def qualifying_vertices(spark, sf_dir):
    vertices, comps = world_table(spark, sf_dir)
    n = reliability.qualifying(reliability.from_source(comps, lowest(vertices), WORLDS), 0.9)
    return spark.createDataFrame([(n,)], "qualifying long")


@query
def guesses_made(spark, sf_dir):
    return rounded(cl.mcp(Worlds(suppliers(spark, sf_dir), seed=SEED), k=6).guesses().select("iteration", "p_curr", "uncovered"))


@query
def all_scores(spark, sf_dir):
    vertices, comps = world_table(spark, sf_dir)
    w = Worlds(kept(suppliers(spark, sf_dir), "edges"), vertices, seed=SEED)
    return rounded(scores.scores(w, fixed_clustering(vertices, comps), acr=True, avpr=True, p_floor=1.0))


def part_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand and, overlapping these, by size."""
    sizes = table(spark, sf_dir, "part").select(F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("cluster_id"), F.col("p_partkey").alias("member"))
    return brands(spark, sf_dir).unionByName(sizes)


@query
def overlapping_pair_counts(spark, sf_dir):
    return evaluate.pair_counts(part_groups(spark, sf_dir))


@query
def confusion_overlapping(spark, sf_dir):
    truth = table(spark, sf_dir, "part").select(F.explode(F.array(F.col("p_name"), F.concat_ws(" ", "p_type", "p_brand"))).alias("cluster_id"), F.col("p_partkey").alias("member"))
    return rounded(evaluate.confusion_matrix(part_groups(spark, sf_dir), truth))


@query
def distinct_members(spark, sf_dir):
    return spark.createDataFrame([(evaluate.distinct_members(part_groups(spark, sf_dir)),)], "members long")


@query
def scalability_means(spark, sf_dir):
    return rounded(report.scalability(result_rows(spark, sf_dir), "data/collins-lcc.txt"))


@query
def figure_rows(spark, sf_dir):
    shown = report.figure_inputs(result_rows(spark, sf_dir).withColumn("k", F.col("k") * 2))
    return rounded(report.union_by_name(*(df.select(F.lit(name).alias("figure"), "*") for name, df in sorted(shown.items()))))


@query
def prediction_table(spark, sf_dir):
    """Two ways to cut suppliers into 2 to 6 parts as algorithms, against their nations."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member"), F.col("s_nationkey").alias("nation"))
    cut = s.withColumn("depth", F.explode(F.sequence(F.lit(2), F.lit(6)))).withColumn("algorithm", F.explode(F.array(F.lit("k-center"), F.lit("k-median-2"))))
    part = F.when(F.col("algorithm") == "k-center", F.col("member")).otherwise(F.floor(F.col("member") / 3)) % F.col("depth")
    truth = s.select(F.col("nation").alias("cluster_id"), "member")
    found = evaluate.confusion_matrix(cut.select("algorithm", "depth", part.alias("cluster_id"), "member"), truth, ("algorithm", "depth"))
    return rounded(report.prediction_tables(found, found)[0])
