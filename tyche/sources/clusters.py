"""Clusterings, ground truths and complexes: text, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .edges import read_lines


def clusters_from_lines(lines: DataFrame) -> DataFrame:
    """``cluster_id, member``: one cluster per line, or one pair per line if every line has two names."""
    tokens = lines.filter(F.trim("value") != "").select(F.col("line_no").alias("cluster_id"), F.split(F.trim("value"), r"\s+").alias("members"))
    return tokens.select("cluster_id", F.explode("members").alias("member")).distinct()


def clusters_from_document(document: DataFrame) -> DataFrame:
    """``cluster_id, member`` of the table ``clustering`` of a result document: labels by center label."""
    rows = document.select(F.explode("tables.clustering").alias("row"))
    return rows.select(F.col("row")["center label"].alias("cluster_id"), F.col("row.label").alias("member")).distinct()


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Text or JSON, told apart by the first character; gzip and bzip2 by extension."""
    lines = read_lines(spark, path)
    head = lines.filter(F.trim("value") != "").orderBy("line_no").limit(1).collect()
    if head and head[0].value.lstrip().startswith("{"):
        return clusters_from_document(spark.read.option("multiLine", True).json(path))
    return clusters_from_lines(lines)


def write_clusters(clusters: DataFrame, path: str) -> None:
    """One cluster per line, the largest first."""
    lines = clusters.groupBy("cluster_id").agg(F.sort_array(F.collect_set(F.col("member").cast("string"))).alias("members"))
    lines.orderBy(F.size("members").desc(), "cluster_id").select(F.concat_ws(" ", "members")).write.text(path)


def complexes_from_rows(rows: DataFrame, member: str, complex_: str) -> DataFrame:
    """``cluster_id, member`` with upper-cased members, from (member, complex) rows."""
    return rows.select(F.col(complex_).alias("cluster_id"), F.upper(member).alias("member")).distinct()


def read_complexes(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated ``protein|complex|...`` lines."""
    rows = spark.read.option("sep", "|").csv(path)
    return complexes_from_rows(rows, rows.columns[0], rows.columns[1])


def annotation_clusters(rows: DataFrame, member: str, annotation: str) -> DataFrame:
    """``cluster_id, member`` from comma-separated annotations; ``NOVEL`` names no complex."""
    each = rows.select(F.col(member).alias("member"), F.explode(F.split(annotation, ",")).alias("cluster_id")).withColumn("cluster_id", F.trim("cluster_id"))
    return each.filter(~F.col("cluster_id").isin("NOVEL", "")).select("cluster_id", "member").distinct()


def read_annotations(spark: SparkSession, path: str, member: str = "ORF", annotation: str = "MIPS complex annotation") -> DataFrame:
    """``cluster_id, member`` from a CSV file with a header."""
    return annotation_clusters(spark.read.option("header", True).csv(path), f"`{member}`", f"`{annotation}`")


def known_members(clusters: DataFrame, known: DataFrame) -> DataFrame:
    """``clusters`` reduced to the members in ``known(member)``; complexes without any vanish."""
    return clusters.join(known.select("member").distinct(), "member", "left_semi").select("cluster_id", "member")


def known_complexes(spark: SparkSession, complexes: str, interactions: str) -> DataFrame:
    """The complexes of one file, reduced to the proteins of an interaction list, as a ground truth."""
    return known_members(read_complexes(spark, complexes), read_proteins(spark, interactions))


def read_proteins(spark: SparkSession, path: str) -> DataFrame:
    """``member``: the upper-cased names of an interaction list ``u v probability``."""
    tokens = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t")).filter(F.size("t") == 3)
    return tokens.select(F.explode(F.slice("t", 1, 2)).alias("member")).select(F.upper("member").alias("member")).distinct()
