"""The greedy kernel of the clusterings: first uncovered vertex by priority, many at a time.

Taking the first uncovered vertex in a random order, again and again, picks the lexicographically first maximal
independent set of the graph "covers each other". It is found in a few rounds: a vertex is a center once all its
neighbours of earlier priority are known not to be, and no center once one of them is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept


def priority(seed: int, round_: int, vertex: Column) -> Column:
    """52 random bits for a vertex in a round."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("priority"), F.lit(str(seed)), F.lit(str(round_)), vertex)), 1, 13), 16, 10).cast("long")


def first_independent_set(ordered: DataFrame, covers: DataFrame) -> DataFrame:
    """``vertex, prio`` of the set; ``ordered`` is ``vertex, prio``, ``covers`` the symmetric pairs ``a, b``.

    Each round decides at least the earliest undecided vertex of each component of ``covers``, usually most of all.
    """
    by_order = F.struct("prio", "vertex")
    state = kept(ordered.select("vertex", "prio", by_order.alias("place")), "order")
    earlier = covers.filter("a != b").join(state.select(F.col("vertex").alias("a"), F.col("place").alias("place_a")), "a").join(state.select(F.col("vertex").alias("b"), F.col("place").alias("place_b")), "b")
    earlier = kept(earlier.filter("place_b < place_a").select(F.col("a").alias("vertex"), F.col("b").alias("other")), "earlier")  # other comes first
    open_, centers = state.select("vertex"), None
    while True:
        waiting = earlier.join(open_, "vertex", "left_semi").join(open_.withColumnRenamed("vertex", "other"), "other", "left_semi").select("vertex").distinct()
        new = kept(open_.join(waiting, "vertex", "left_anti"), "centers")
        centers = new if centers is None else centers.unionByName(new)
        covered = earlier.join(new.withColumnRenamed("vertex", "other"), "other", "left_semi").select("vertex").distinct()
        open_ = kept(open_.join(new, "vertex", "left_anti").join(covered, "vertex", "left_anti"), "open")
        if open_.isEmpty():
            return centers.join(state.select("vertex", "prio"), "vertex")


def best_covers(candidates: DataFrame) -> DataFrame:
    """Of ``vertex, center, center_rank, probability`` the best center of each vertex; ties go to the earlier center."""
    best = candidates.groupBy("vertex").agg(F.max(F.struct("probability", (-F.col("center_rank")).alias("early"), "center")).alias("best"))
    return best.select("vertex", "best.center", (F.col("vertex") == F.col("best.center")).alias("is_center"), "best.probability")


def cover(vertices: DataFrame, candidates: DataFrame, allowed: int) -> tuple[DataFrame, int]:
    """A clustering by ranked centers, and how many vertices it leaves uncovered.

    ``candidates`` is ``vertex, center, center_rank, probability``: whom each center covers, itself included. After
    the first center c with ``c + uncovered <= allowed`` the uncovered vertices become clusters of their own. Columns
    ``vertex, center, is_center, probability``, null if uncovered.
    """
    n = vertices.count()
    firsts = candidates.groupBy("vertex").agg(F.min("center_rank").alias("rank")).groupBy("rank").agg(F.count("*").alias("n"))
    running = Window.orderBy("center_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    centers = candidates.filter("vertex = center").select("center_rank")  # one row for each center, fewer than k
    progress = centers.join(firsts, centers.center_rank == firsts["rank"], "left").select("center_rank", (n - F.sum(F.coalesce("n", F.lit(0))).over(running)).alias("uncovered"))
    done = progress.filter(F.col("center_rank") + F.col("uncovered") <= allowed).agg(F.min("center_rank")).first()[0]
    used = candidates if done is None else candidates.filter(F.col("center_rank") <= done)
    found = vertices.select("vertex").join(best_covers(used), "vertex", "left")
    if done is not None:
        alone = F.col("center").isNull()
        found = found.select("vertex", F.coalesce("center", "vertex").alias("center"), (F.coalesce("is_center", F.lit(True))).alias("is_center"), F.when(alone, 1.0).otherwise(F.col("probability")).alias("probability"))
        return kept(found, "clustering"), 0
    found = kept(found.withColumn("is_center", F.coalesce("is_center", F.lit(False))), "clustering")
    return found, found.filter("center is null").count()
