"""Relational reports over the results of many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes of input files, the names of algorithms and measures in reports, the k shown of the large input, and the measures of each figure.
INPUTS = (("collins", "Collins"), ("krogan", "Krogan"), ("gavin", "Gavin"), ("dblp", "DBLP"))
ALGORITHMS = {"gmm": r"\textsc{gmm}", "mcl": r"\textsc{mcl}", "k-center": r"\textsc{mcp}", "k-median": r"\textsc{acp}", "k-median-2": r"\textsc{acp}"}
LARGE_KS = (1818, 5274, 15576)
MEASURES = {"p_min": "$p_{min}$", "average probability": "$p_{avg}$", "inner-avpr": "inner-AVPR", "outer-avpr": "outer-AVPR", "time": "time (ms)"}
FIGURES = {"figure-1": ("p_min", "average probability"), "figure-2": ("inner-avpr", "outer-avpr"), "figure-3": ("time",)}


def scores_with_times(scores: DataFrame, times: DataFrame, key: str = "date") -> DataFrame:
    """All score rows, with the time of their run where there is one."""
    return scores.join(times.select(key, "time"), key, "left")


def input_name(path: Column, prefixes: tuple[tuple[str, str], ...] = INPUTS) -> Column:
    """The report's name of an input file, by its base name's prefix; else the base name up to its first dot."""
    base = F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)
    named = F.lit(None).cast("string")
    for prefix, name in reversed(prefixes):
        named = F.when(base.startswith(prefix), F.lit(name)).otherwise(named)
    return F.coalesce(named, base)


def renamed_values(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    return df.replace(names, subset=[column])


def unpivoted(df: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    """Long form: ``*ids, measure, value``."""
    return df.unpivot(ids, measures, "measure", "value")


def group_means(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in measures))


def highest_means(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """One row: the largest group mean of each measure, an axis' height."""
    return group_means(df, keys, measures).agg(*(F.max(m).alias(m) for m in measures))


def pivoted(df: DataFrame, rows: str, columns: str, value: str, names: list | None = None) -> DataFrame:
    return df.groupBy(rows).pivot(columns, names).agg(F.first(value))


def union_by_name(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def wanted_rows(df: DataFrame, large: str = "DBLP", large_k: tuple[int, ...] = LARGE_KS, least_k: int = 3) -> DataFrame:
    """Rows with ``k`` over ``least_k``, and of the large input only some ``k``."""
    return df.filter((F.col("k") > least_k) & ((F.col("input") != large) | F.col("k").isin(*large_k)))


def scalability(df: DataFrame, input_: str) -> DataFrame:
    """Mean time by k and algorithm on one input."""
    return group_means(df.filter(F.col("input") == input_), ["k", "algorithm"], ["time"])


def figure_inputs(runs: DataFrame, figures: dict[str, tuple[str, ...]] = FIGURES) -> dict[str, DataFrame]:
    """By figure, ``input, k, algorithm, measure, value``: the means that it shows of ``runs``, by the names of reports.

    ``runs`` has input, k, algorithm and a column for each measure; measures it lacks are left out.
    """
    rows = renamed_values(runs.withColumn("input", input_name(F.col("input"))), "algorithm", ALGORITHMS)
    rows, keys = wanted_rows(rows), ["input", "k", "algorithm"]
    shown = {name: [m for m in measures if m in runs.columns] for name, measures in figures.items()}
    means = {name: unpivoted(rows.groupBy(*keys).agg(*(F.avg(f"`{m}`").alias(m) for m in measures)), keys, measures) for name, measures in shown.items() if measures}
    return {name: renamed_values(df, "measure", MEASURES) for name, df in means.items()}


def prediction_tables(ours: DataFrame, baselines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean ``tpr`` and ``fpr``: of each baseline algorithm, and of ours by depth with a pair of columns for each algorithm."""
    ours = renamed_values(ours, "algorithm", {"k-center": "mcp", "k-median-2": "acp"})
    rates = [F.avg("tpr").alias("tpr"), F.avg("fpr").alias("fpr")]
    return ours.groupBy("depth").pivot("algorithm", ["acp", "mcp"]).agg(*rates), baselines.groupBy("algorithm").agg(*rates)
