"""Edge lists: text in and out, the vertex dictionary, and graphs from co-occurrence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chance import cooccurrence_probability
from ..storage import fresh_path, kept

#: Rows of a group that are paired in one task; larger groups are cut into parts.
PART_ROWS = 1000
#: Records that one task parses, at most, after a compressed dump has been cut at their ends.
CHUNK_RECORDS = 50_000


@dataclass(frozen=True)
class Graph:
    """``vertices(vertex, label)`` and ``edges(edge_id, src, dst, probability)``; each unordered pair once."""

    vertices: DataFrame
    edges: DataFrame


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with dense numbers from 0 in ``order``: ranges are sorted apart and start where the last one ended.

    Only one count per range goes through a single task.
    """
    ranged = df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id())
    ranged = kept(ranged, "ranged")
    counts = ranged.groupBy("range_no").agg(F.count("*").alias("n"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("range_no").orderBy(*order)) - 1
    return ranged.withColumn("within", within).join(F.broadcast(starts), "range_no").withColumn(name, F.col("start") + F.col("within")).drop("range_no", "within", "start")


def parse_edge_lines(lines: DataFrame, check: bool = True) -> DataFrame:
    """``line_no, src_label, dst_label, probability`` of ``lines(line_no, value)``.

    Blank lines and those that start with ``#`` are skipped; white space separates; a missing probability is 1, and
    probabilities are read as 32-bit floats. A line of one token, or a probability outside 0..1 if ``check``, is an error.
    """
    used = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    tokens = used.select("line_no", F.split(F.trim(F.translate("value", "\t\r", "  ")), r"\s+").alias("t"))
    p = F.coalesce(F.get("t", F.lit(2)).cast("float"), F.lit(1.0)).cast("double")
    parsed = tokens.select("line_no", F.col("t")[0].alias("src_label"), F.get("t", F.lit(1)).alias("dst_label"), p.alias("probability"))
    if check:
        wrong = F.col("dst_label").isNull() | ~F.col("probability").between(0, 1)
        complaint = F.raise_error(F.concat(F.lit("malformed edge line "), F.col("line_no").cast("string")))
        parsed = parsed.withColumn("dst_label", F.when(wrong, complaint.cast("string")).otherwise(F.col("dst_label")))
    return parsed


def first_of_pairs(parsed: DataFrame, a: str = "src_label", b: str = "dst_label", order: str = "line_no") -> DataFrame:
    """The first row of each unordered pair; self-loops stay."""
    row = F.struct(order, *(c for c in parsed.columns if c != order))
    best = parsed.groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(F.min(row).alias("row"))
    return best.select("row.*")


def vertex_dictionary(parsed: DataFrame) -> DataFrame:
    """``vertex, label``: labels numbered in the order in which they first appear."""
    ends = parsed.select("line_no", F.posexplode(F.array("src_label", "dst_label")).alias("pos", "label"))
    first = ends.groupBy("label").agg(F.min(F.struct("line_no", "pos")).alias("at"))
    return numbered(first.select("label", "at.line_no", "at.pos"), ["line_no", "pos"], "vertex").select("vertex", "label")


def graph_from_lines(lines: DataFrame) -> Graph:
    parsed = parse_edge_lines(lines)
    vertices = vertex_dictionary(parsed)
    edges = numbered(first_of_pairs(parsed), ["line_no"], "edge_id")
    src, dst = vertices.select(F.col("label").alias("src_label"), F.col("vertex").alias("src")), vertices.select(F.col("label").alias("dst_label"), F.col("vertex").alias("dst"))
    return Graph(vertices, edges.join(src, "src_label").join(dst, "dst_label").select("edge_id", "src", "dst", "probability"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` of a text file (or several, in order of their names); compression by extension.

    Spark reads parts of files in any order, so lines are ordered by file, then part, then place within the part.
    """
    places = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    return numbered(spark.read.text(path).select("value", *places), ["file", "block", "at"], "line_no").select("line_no", "value")


def vertex_of(graph: Graph, label: str) -> int:
    """The number of a label; an unknown one is an error."""
    found = graph.vertices.filter(F.col("label") == label).first()
    if found is None:
        raise KeyError(label)
    return found.vertex


def read_edge_list(spark: SparkSession, path: str) -> Graph:
    return graph_from_lines(read_lines(spark, path))


def write_edge_list(graph: Graph, path: str) -> None:
    """``label label probability`` lines."""
    a, b = graph.vertices.toDF("src", "a"), graph.vertices.toDF("dst", "b")
    graph.edges.join(a, "src").join(b, "dst").select(F.concat_ws(" ", "a", "b", F.col("probability").cast("string"))).write.text(path)


def pairs_within(rows: DataFrame, group: list[str], key: str, most: int = PART_ROWS, *, tasks: int | None = None) -> DataFrame:
    """``*group, l, r``: every two rows of a group once, as structs of the other columns; ``key`` names a row of a group.

    A group of over ``most`` rows is cut into parts by the hash of ``key``, and each two parts, or a part with itself,
    are joined under a key of their own: the pairs of a large group are dealt to as many tasks as it has pairs of parts.
    Small tables of few groups may still be broadcast or coalesced into one task; ``tasks`` deals the keys to that many.
    """
    large = rows.groupBy(*group).agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).filter("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    row = F.struct(*(c for c in rows.columns if c not in group))
    placed = rows.join(large, group, "left").select(*group, row.alias("row"), parts.alias("parts"), F.pmod(F.xxhash64(key), parts).cast("int").alias("part"))
    left = placed.select(*group, F.col("part").alias("p"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("q"), F.col("row").alias("l"))
    left = left.repartition(tasks, *group, "p", "q") if tasks else left
    right = placed.select(*group, F.explode(F.sequence(F.lit(0), F.col("part"))).alias("p"), F.col("part").alias("q"), F.col("row").alias("r"))
    return left.join(right, [*group, "p", "q"]).filter((F.col("p") < F.col("q")) | (F.col("l")[key] < F.col("r")[key])).select(*group, "l", "r")


def cooccurrence_edges(items: DataFrame, group: str, member: str) -> DataFrame:
    """``src, dst, cnt, probability`` for members that share groups, each pair once with ``src < dst``."""
    distinct = items.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    pairs = pairs_within(distinct, ["g"], "m").select(F.least("l.m", "r.m").alias("src"), F.greatest("l.m", "r.m").alias("dst"))
    counts = pairs.groupBy("src", "dst").agg(F.count("*").alias("cnt"))
    return counts.withColumn("probability", cooccurrence_probability(F.col("cnt")))


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()


def valid_article(year: Column, authors: Column, key: Column, informal: Column, last_year: int = 2012, types: tuple[str, ...] | None = None) -> Column:
    """Two authors or more, dated up to ``last_year``, formally published, of a wanted type (the key's first part)."""
    wanted = F.lit(True) if types is None else F.split(key, "/")[0].isin(*types)
    return (F.size(authors) > 1) & year.isNotNull() & (year <= last_year) & ~informal & wanted


def read_xml_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The records of an XML dump, one row for each element ``tag``."""
    return spark.read.format("xml").option("rowTag", tag).load(path)


def read_packed_xml_records(spark: SparkSession, path: str, tag: str, records: int = CHUNK_RECORDS) -> DataFrame:
    """The records of a dump that is one compressed stream, as :func:`read_xml_records` gives them, parsed by many tasks.

    A stream has to be read from its start, so one task cuts it at the ends of records into rows of one record and its
    position; these are written as files of about ``records`` lines, in order of position, which are then parsed apart.
    Line ends within a record are written as references, so that a record is a line.
    """
    end = f"</{tag}>"
    rows = spark.read.option("lineSep", end).text(path).select(F.monotonically_increasing_id().alias("position"), "value")
    record = F.concat(F.regexp_extract("value", rf"(?s)<{tag}[\s>].*\z", 0), F.lit(end))
    cut = kept(rows.select("position", F.replace(F.replace(record, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("&#10;")).alias("value")).filter(F.col("value") != end), "records")
    files, folder = max(1, -(-cut.count() // records)), fresh_path(spark, "xml")
    cut.repartitionByRange(files, "position").sortWithinPartitions("position").select("value").write.text(folder)
    return spark.read.format("xml").option("rowTag", tag).option("multiLine", False).load(folder)


def person_name(author: Column) -> Column:
    return F.replace(author, F.lit(" "), F.lit("_"))
