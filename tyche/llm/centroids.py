"""Plain Lloyd clustering of vectors in whole numbers: every step is exact, whatever the order of rows and tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept

#: Whole components below this number leave squared distances within 64 bits; a sum beyond that is Spark's error.
LARGEST = 1 << 24


def whole_vectors(rows: DataFrame, scale: int, dims: int | None = None, vector_col: str = "embedding") -> DataFrame:
    """``rows`` with ``v array<int>``, the components ``floor(scale * x)``, in place of the vectors.

    Rows whose vector is null, holds a null or a non-finite component, or has not ``dims`` components (if given) are
    left out. Components that scale to ``LARGEST`` or more are an error.
    """
    x = F.col(vector_col)
    usable = x.isNotNull() & ~F.exists(x, unusable)
    if dims is not None:
        usable &= F.size(x) == dims
    return rows.filter(usable).withColumn("v", F.transform(x, lambda c: scaled(c, scale))).drop(vector_col)


def unusable(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def scaled(c: Column, scale: int) -> Column:
    whole = F.floor(c.cast("double") * scale)
    return F.when(F.abs(c.cast("double") * scale) < LARGEST, whole.cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int"))


def first_centroids(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors (all, if fewer) with the smallest hash of seed and id; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    drawn = vectors.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([r.v for r in drawn], "i8")


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector the number of the nearest centroid, the lowest of equal ones, and the squared distance."""
    squared = np.stack([np.square(vectors - c).sum(axis=1) for c in centroids], axis=1)
    cluster = squared.argmin(axis=1)
    return cluster, squared[np.arange(len(vectors)), cluster]


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floors of the means; one that no vector is nearest to stays.

    A task hands on one row for each centroid: how many vectors it has, and their sums.
    """
    k, dims = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(k, "i8"), np.zeros((k, dims), "i8")
        for batch in batches:
            v = np.stack(batch["v"].to_numpy()).astype("i8") if len(batch) else np.zeros((0, dims), "i8")
            cluster, _ = nearest(v, shared.value)
            count += np.bincount(cluster, minlength=k)
            for c in range(k):
                total[c] += v[cluster == c].sum(axis=0)
        used = count.nonzero()[0]
        yield pd.DataFrame({"cluster": used, "n": count[used], **{f"s{d}": total[used, d] for d in range(dims)}})

    names = [f"s{d}" for d in range(dims)]
    parts = vectors.select("v").mapInPandas(run, ", ".join(["cluster long", "n long", *(f"{s} long" for s in names)]))
    after = centroids.copy()
    for row in parts.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in ["n", *names])).collect():  # k rows at most
        after[row.cluster] = [row[s] // row.n for s in names]
    return after


def lloyd(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster int, distance long`` of every row of ``vectors(vec_id, v array<int>)``, and the final centroids.

    All ``v`` have the same length. Every row takes part and is returned: rows that repeat count each, a null id stays
    null and its vector is drawn as a first centroid only when ids run out. With fewer rows than ``k`` there are as
    many centroids as rows; equal first centroids leave all but the lowest empty. Empty tables give empty results.
    """
    vectors = kept(vectors.select("vec_id", "v"), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select(F.col("vec_id").cast("long"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cluster, distance = nearest(np.stack(batch["v"].to_numpy()).astype("i8"), shared.value)
                yield pd.DataFrame({"id": batch["id"], "missing": batch["missing"], "cluster": cluster, "distance": distance})

    # A column of whole numbers with nulls would reach pandas as doubles.
    filled = vectors.select(F.coalesce("vec_id", F.lit(0)).cast("long").alias("id"), F.col("vec_id").isNull().alias("missing"), "v")
    found = filled.mapInPandas(run, "id long, missing boolean, cluster int, distance long")
    return kept(found.select(F.when(~F.col("missing"), F.col("id")).alias("vec_id"), "cluster", "distance"), "clusters"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with ``cluster_inertia``, ``inertia`` and the final ``centroid array<int>`` of each row's cluster."""
    spark = found.sparkSession
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    table = [(r.cluster, r.cluster_inertia, sum(x.cluster_inertia for x in sums), [int(x) for x in centroids[r.cluster]]) for r in sums]
    stats = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    return found.join(F.broadcast(stats), "cluster")
