"""Agreement of clusterings with a ground truth, by pairs of members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.clusters import read_clusters
from ..sources.edges import pairs_within

#: Sets of clusters of one member up to which pairs are counted by sets of clusters.
SETS = 4096


def many(df: DataFrame) -> int:
    """The session's number of shuffle partitions: how many tasks pairs are dealt to, however small the table they come from."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def same_cluster_pairs(clusters: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct ``*keys, a, b`` with ``a < b`` that share a cluster of ``clusters(*keys, cluster_id, member)``.

    The pairs are the result and are not shuffled: each is made once, under the smallest cluster that both are in,
    and those of a large cluster by many tasks.
    """
    placed = clusters.filter("member is not null and cluster_id is not null")
    each = member_classes(placed, keys).select(*keys, "member", "ids", F.explode("ids").alias("cluster_id"))
    pairs = pairs_within(each, [*keys, "cluster_id"], "member", tasks=many(clusters))
    once = (F.size("l.ids") == 1) | (F.size("r.ids") == 1) | (F.col("cluster_id") == F.array_min(F.array_intersect("l.ids", "r.ids")))
    return pairs.filter(once).select(*keys, F.least("l.member", "r.member").alias("a"), F.greatest("l.member", "r.member").alias("b"))


def made_pairs(sizes: DataFrame, *keys: str) -> DataFrame:
    """The pairs that groups of ``size`` members make, by ``keys``."""
    return sizes.groupBy(*keys).agg(F.coalesce(F.sum(F.col("size") * (F.col("size") - 1) / 2), F.lit(0)).cast("long").alias("made"))


def overlapping(clusters: DataFrame, keys: tuple[str, ...] = ()) -> bool:
    """Whether a member is in more than one cluster."""
    return not clusters.groupBy(*keys, "member").agg(F.count_distinct("cluster_id").alias("n")).filter("n > 1").isEmpty()


def member_classes(clusters: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``*keys, member, ids``: the clusters of each member, in order."""
    return clusters.groupBy(*keys, "member").agg(F.array_sort(F.collect_set("cluster_id")).alias("ids"))


def overlapping_pairs(classes: DataFrame, keys: tuple[str, ...] = (), also: str | None = None) -> DataFrame:
    """``*keys, made``: the pairs of members that share a cluster, each once.

    ``classes`` is ``*keys, ids, n``: how many members are in just the clusters ``ids``. With ``also``, the name of a
    further column of ids, members of a pair must also share one of these. No pair is listed: by inclusion and exclusion
    it is the pairs of those that share a set of clusters, over all sets that a member has, those of an even number of
    clusters taken off. Where a member is in so many clusters that it has over ``SETS`` sets, pairs of classes are counted.
    """
    shared = ["ids", *([also] if also else [])]
    some = classes.select(*keys, *shared, "n").filter(" and ".join(f"size({c}) > 0" for c in shared))
    most = some.agg(F.max(sum((F.size(c) for c in shared), F.lit(0)))).first()[0] or 0
    if 1 << most > SETS:
        return pairs_of_classes(some, keys, also)
    sets = some
    for c in shared:
        sets = sets.withColumn(c, F.explode(subsets(c)))
    sizes = sets.groupBy(*keys, *shared).agg(F.sum("n").alias("n"))
    odd = F.when((sum((F.size(c) - 1 for c in shared), F.lit(0))) % 2 == 0, 1).otherwise(-1)
    return sizes.groupBy(*keys).agg(F.coalesce(F.sum(odd * F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("made"))


def subsets(ids: str) -> Column:
    """All sets of one or more of the ``ids``, in their order."""
    sets = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(ids)) - 1)
    return F.transform(sets, lambda s: F.filter(ids, lambda _, place: F.call_function("shiftright", s, place) % 2 == 1))


def pairs_of_classes(some: DataFrame, keys: tuple[str, ...], also: str | None) -> DataFrame:
    """:func:`overlapping_pairs` from pairs of classes, each under the smallest cluster that both are in."""
    shared = ["ids", *([also] if also else [])]
    within = some.select(*keys, F.expr("n * (n - 1) div 2").alias("made"))
    row = F.struct(*shared)
    each = some.select(*keys, F.explode("ids").alias("cluster"), row.alias("class"), "n")
    pairs = pairs_within(each, [*keys, "cluster"], "class", tasks=many(some)).filter(F.col("cluster") == F.array_min(F.array_intersect("l.class.ids", "r.class.ids")))
    if also:
        pairs = pairs.filter(F.arrays_overlap(f"l.class.{also}", f"r.class.{also}"))
    across = pairs.select(*keys, (F.col("l.n") * F.col("r.n")).alias("made"))
    return within.unionByName(across).groupBy(*keys).agg(F.coalesce(F.sum("made"), F.lit(0)).cast("long").alias("made"))


def confusion_matrix(actual: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``*keys, tp, fp, fn, tn, tpr, fpr, fnr, tnr`` of each clustering in ``actual`` against one ``truth``.

    Only pairs of names that the truth knows count; its names include those of single-member clusters. Pairs are
    counted by the sizes of clusters and of what they share, or, where clusters overlap, by the members of the same clusters.
    """
    names = truth.select("member").distinct()
    own = actual.join(names, "member", "left_semi").select(*keys, "cluster_id", "member").distinct()
    if overlapping(own, keys) or overlapping(truth):
        truly = member_classes(truth).withColumnRenamed("ids", "truly")
        both = member_classes(own, keys).join(truly, "member").groupBy(*keys, "ids", "truly").agg(F.count("*").alias("n"))
        hits = overlapping_pairs(both, keys, "truly").withColumnRenamed("made", "tp")
        found = overlapping_pairs(both.groupBy(*keys, "ids").agg(F.sum("n").alias("n")), keys).withColumnRenamed("made", "found")
        pairs = overlapping_pairs(truly.groupBy(F.col("truly").alias("ids")).agg(F.count("*").alias("n"))).withColumnRenamed("made", "pairs")
    else:
        truly = truth.select(F.col("cluster_id").alias("true_id"), "member").distinct()
        shared = own.join(truly, "member").groupBy(*keys, "cluster_id", "true_id").agg(F.count("*").alias("size"))
        sizes = own.groupBy(*keys, "cluster_id").agg(F.count("*").alias("size"))
        hits, found = made_pairs(shared, *keys).withColumnRenamed("made", "tp"), made_pairs(sizes, *keys).withColumnRenamed("made", "found")
        pairs = made_pairs(truly.groupBy("true_id").agg(F.count("*").alias("size"))).withColumnRenamed("made", "pairs")
    counts = found.join(hits, list(keys), "left").fillna(0, "tp") if keys else hits.crossJoin(found)  # one row each
    counts = counts.withColumn("fp", F.col("found") - F.col("tp")).drop("found")
    if keys:
        every = actual.select(*keys).distinct()
        counts = every.join(counts, list(keys), "left").select(*keys, F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"))
    totals = pairs.crossJoin(names.agg(F.count("*").alias("n")))  # one row each
    full = counts.crossJoin(totals).withColumn("fn", F.col("pairs") - F.col("tp"))
    full = full.withColumn("tn", (F.col("n") * (F.col("n") - 1) / 2).cast("long") - F.col("pairs") - F.col("fp"))
    share = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b)).alias(f"{a}r")
    return full.select(*keys, "tp", "fp", "fn", "tn", share("tp", "fn"), share("fp", "tn"), share("fn", "tp"), share("tn", "fp"))


def confusion_matrix_of_files(spark: SparkSession, actual: str, truth: str) -> DataFrame:
    """The confusion matrix of a clustering's file against that of a ground truth."""
    return confusion_matrix(read_clusters(spark, actual), read_clusters(spark, truth))


def write_confusion(matrix: DataFrame, path: str) -> None:
    """One JSON object per row."""
    matrix.coalesce(1).write.json(path)


def pair_counts(clusters: DataFrame) -> DataFrame:
    """``distinct_pairs, summed_pairs``: pairs that share a cluster, each once, and the sum of what the clusters make."""
    sizes = clusters.groupBy("cluster_id").agg(F.count_distinct("member").alias("size"))
    summed = made_pairs(sizes).withColumnRenamed("made", "summed_pairs")
    if not overlapping(clusters):
        return summed.select(F.col("summed_pairs").alias("distinct_pairs"), "summed_pairs")
    classes = member_classes(clusters).groupBy("ids").agg(F.count("*").alias("n"))
    return overlapping_pairs(classes).withColumnRenamed("made", "distinct_pairs").crossJoin(summed)  # one row each


def cluster_members(clustering: DataFrame) -> DataFrame:
    return clustering.groupBy("center").agg(F.count("*").alias("size"), F.min("vertex").alias("first_vertex"), F.max("vertex").alias("last_vertex"))


def size_statistics(clusters: DataFrame) -> DataFrame:
    """Smallest, median, mean and largest number of distinct members, and the pairs they would make."""
    sizes = clusters.groupBy("cluster_id").agg(F.count_distinct("member").alias("size"))
    return sizes.agg(
        F.count("*").alias("clusters"), F.min("size").alias("min_size"), F.percentile("size", 0.5).alias("median_size"), F.avg("size").alias("mean_size"),
        F.max("size").alias("max_size"), F.sum(F.col("size") * (F.col("size") - 1) / 2).cast("long").alias("pairs"),
    )


def distinct_members(clusters: DataFrame) -> int:
    return clusters.select("member").distinct().count()
