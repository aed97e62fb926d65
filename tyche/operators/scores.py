"""Quality scores of a clustering ``vertex, center, is_center, probability`` over sampled worlds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept
from .reliability import set_reliability
from .worlds import Worlds


def basic_scores(clustering: DataFrame) -> DataFrame:
    """``p_min`` (1 at most), the sum and mean of probabilities, and the number of clusters."""
    return clustering.agg(
        F.least(F.lit(1.0), F.min("probability")).alias("p_min"),
        F.sum("probability").alias("probabilities_sum"),
        F.try_divide(F.sum("probability"), F.count("*")).alias("average_probability"),
        F.count_if("is_center").alias("num_clusters"),
    )


def average_cluster_reliability(members: DataFrame, comps: DataFrame, r: int) -> DataFrame:
    """``acr``: the size-weighted mean of the clusters' reliabilities; ``members`` is ``center, vertex``, overlaps allowed."""
    sets = set_reliability(comps, members.select(F.col("center").alias("set_id"), "vertex"), r)
    return sets.agg(F.try_divide(F.sum(F.col("size") * F.col("reliability")), F.sum("size")).alias("acr"))


def vertex_pair_reliability(members: DataFrame, comps: DataFrame, r: int, n: int) -> DataFrame:
    """``inner_avpr`` and ``outer_avpr``: mean connection probability within clusters and across their borders.

    Pairs are counted by groups, never listed: x members of a cluster in a component make x(x-1)/2 inner pairs.
    Null where there are no such pairs.
    """
    met = comps.join(members.select("vertex", "center"), "vertex").groupBy("world", "center", "comp").agg(F.count("*").alias("x"))
    whole = comps.groupBy("world", "comp").agg(F.count("*").alias("s"))
    counted = met.join(whole, ["world", "comp"]).agg(
        F.sum(F.col("x") * (F.col("x") - 1) / 2).alias("inner"), F.sum(F.col("x") * (F.col("s") - F.col("x"))).alias("outer")
    )
    sizes = members.groupBy("center").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("inner_pairs"), F.sum(F.col("c") * (n - F.col("c"))).alias("outer_pairs"))
    both = counted.crossJoin(sizes)  # one row each
    return both.select(F.try_divide(F.col("inner") / r, F.col("inner_pairs")).alias("inner_avpr"), F.try_divide(F.col("outer") / r, F.col("outer_pairs")).alias("outer_avpr"))


def vertex_pair_reliability_by_pairs(members: DataFrame, comps: DataFrame, r: int) -> DataFrame:
    """``inner_avpr`` as the share of a cluster's pairs that meet in a world; the pairs are counted by groups, never listed."""
    m = comps.join(members.select("vertex", "center"), "vertex").groupBy("world", "comp", "center").agg(F.count("*").alias("x"))
    met = m.agg(F.coalesce(F.sum(F.expr("x * (x - 1) div 2")), F.lit(0)).alias("met"))
    pairs = members.groupBy("center").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs"))
    return met.crossJoin(pairs).select(F.try_divide(2 * F.col("met") / r, F.col("pairs")).alias("inner_avpr"))  # one row each


def scores(worlds: Worlds, clustering: DataFrame, acr: bool = False, avpr: bool = False, p_floor: float = 0.01) -> DataFrame:
    """One row of all scores; ACR and AVPR, if asked for, over the worlds that the smallest probability needs."""
    basic = kept(basic_scores(clustering), "scores")
    if not (acr or avpr):
        return basic
    r = worlds.reach(max(p_floor, basic.first().p_min or p_floor))
    comps, n = worlds.components(r), worlds.vertices.count()
    members = clustering.select("vertex", "center")
    out = basic
    if acr:
        out = out.crossJoin(average_cluster_reliability(members, comps, r))
    if avpr:
        out = out.crossJoin(vertex_pair_reliability(members, comps, r, n))
    return out


def missing_scores(existing: DataFrame, computed: DataFrame) -> DataFrame:
    """One row: what ``existing`` has, and from ``computed`` only what it lacks."""
    old = existing.select(*(F.col(c).alias(f"old_{c}") for c in existing.columns)).limit(1)
    both = computed.crossJoin(old)
    names = [*existing.columns, *(c for c in computed.columns if c not in existing.columns)]
    value = lambda c: F.coalesce(*(F.col(x) for x in (f"old_{c}", c) if x in both.columns))
    return both.select(*(value(c).alias(c) for c in names))


def needs_scores(existing_columns: list[str]) -> bool:
    return not {"p_min", "acr", "inner-avpr", "outer-avpr"} <= set(existing_columns)
