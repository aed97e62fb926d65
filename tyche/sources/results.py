"""Result documents: date, tags and tables of one run, as JSON files."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import fresh_path, kept, removed


def finite(df: DataFrame, name: str) -> Column:
    """A column with null for numbers that JSON cannot hold."""
    c = F.col(f"`{name}`")
    kind = dict(df.dtypes)[name]
    return (F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c) if kind in ("double", "float") else c).alias(name)


def save_run(folder: str, tags: dict[str, object], tables: dict[str, DataFrame], date: str | None = None) -> str:
    """Writes one document ``{date, tags, tables: {name: [row, ...]}}`` into ``folder`` and returns its path.

    The file is named ``<date>-<nonce>.json.bz2`` (the date without ``:``, which file systems refuse). Rows keep their
    order; numbers that are not finite become null.
    """
    date = date or datetime.now(timezone.utc).isoformat(timespec="seconds")
    path = f"{folder.rstrip('/')}/{date.replace(':', '')}-{uuid.uuid4().hex[:8]}.json.bz2"
    write_document(path, json.dumps(date), json.dumps(tags), tables)
    return path


def write_document(path: str, date: str, tags: str, tables: dict[str, DataFrame]) -> None:
    """One JSON document at ``path`` from the JSON of its date and tags and the rows of its tables.

    Every task compresses the lines of its own rows; a bzip2 file may consist of several such parts, so the file
    system's streams append them to each other, and no task or driver holds more than a buffer of them.
    """
    spark = next(iter(tables.values())).sparkSession
    root, number = fresh_path(spark, "document"), 0

    def put(lines: DataFrame) -> None:
        nonlocal number
        lines.write.option("compression", "bzip2").text(f"{root}/{number:04d}")
        number += 1

    text = lambda line: spark.createDataFrame([(line,)], "value string").coalesce(1)
    put(text(f'{{"date": {date}, "tags": {tags}, "tables": {{'))
    for nth, (name, df) in enumerate(tables.items()):
        put(text(f"{',' if nth else ''}{json.dumps(name)}: ["))
        row = F.to_json(F.struct(*(finite(df, c) for c in df.columns)), {"ignoreNullFields": "false"})
        rows = kept(df.select(F.monotonically_increasing_id().alias("at"), row.alias("row")), "rows")
        first = rows.agg(F.min("at")).first()[0]
        comma = F.when(F.col("at") == first, "").otherwise(",")
        put(rows.repartitionByRange("at").sortWithinPartitions("at").select(F.concat(comma, "row").alias("value")))
        put(text("]"))
    put(text("}}"))
    append_files(spark, root, path)


def append_files(spark: SparkSession, root: str, path: str) -> None:
    """The files in the folders under ``root``, in order of their names, as one file at ``path``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    source, target = place(root).getFileSystem(conf), place(path).getFileSystem(conf)
    files = sorted(str(x.getPath()) for x in source.globStatus(place(f"{root}/*/part-*")))
    unfinished = place(f"{root}-whole")
    unfinished_fs = unfinished.getFileSystem(conf)
    out = unfinished_fs.create(unfinished, False)
    for file in files:
        stream = source.open(place(file))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
        stream.close()
    out.close()
    target.mkdirs(place(path).getParent())
    jvm.org.apache.hadoop.fs.FileUtil.copy(unfinished_fs, unfinished, target, place(path), True, False, conf)
    removed(spark, root)


def with_tables(spark: SparkSession, path: str, out: str, tables: dict[str, DataFrame]) -> str:
    """The document at ``path`` with ``tables`` added (or put in place of its own), written to the folder ``out`` under its name.

    Returns the new path; ``path`` stays.
    """
    doc = kept(spark.read.option("multiLine", True).json(path).withColumn("file", F.input_file_name()), "document")
    known = [c for c in doc.select("tables.*").columns if c not in tables]
    old = {name: doc.select(F.explode(F.col("tables")[name]).alias("row")) for name in known}
    old = {name: rows.select("row.*") if isinstance(rows.schema["row"].dataType, StructType) else rows for name, rows in old.items()}  # else it has no rows
    found = doc.select("file", F.to_json("tags").alias("tags"), F.col("date").cast("string").alias("date")).first()
    target = f"{out.rstrip('/')}/{found.file.rsplit('/', 1)[-1].removesuffix('.bz2')}.bz2"
    write_document(target, json.dumps(found.date), found.tags, old | tables)
    return target


def load_table(spark: SparkSession, paths: str | list[str], name: str) -> DataFrame:
    """The rows of table ``name`` of all documents under ``paths`` (one JSON value per file; gzip or bzip2 by extension)."""
    return flatten(spark.read.option("multiLine", True).json(paths), name)


def flatten(docs: DataFrame, name: str) -> DataFrame:
    """The rows of table ``name`` of ``docs``, with their date and tags.

    Tags override row columns of the same name; documents without the table are skipped; no rows at all is an error.
    """
    if "tables" not in docs.columns or name not in docs.select("tables.*").columns:
        raise ValueError(f"no document has a table {name!r}")
    rows = docs.filter(F.col("tables")[name].isNotNull()).select("date", "tags", F.explode(F.col("tables")[name]).alias("row"))
    tags = rows.select("tags.*").columns
    own = [c for c in rows.select("row.*").columns if c not in (*tags, "date")]
    flat = rows.select(F.to_timestamp("date").alias("date"), *(F.col("row")[c].alias(c) for c in own), *(F.col("tags")[t].alias(t) for t in tags))
    if flat.isEmpty():
        raise ValueError(f"table {name!r} has no rows")
    return flat


def load_json_lines(spark: SparkSession, path: str, algorithm: str) -> DataFrame:
    """Results of a baseline, one JSON object per line, named ``algorithm``."""
    return spark.read.json(path).withColumn("algorithm", F.lit(algorithm))


def graph_path(document: DataFrame, argument: str | None = None) -> str:
    """The graph that a clustering document names: the argument, else ``tags.input``, else ``tags.graph``."""
    tags = document.select("tags.*").columns
    found = [argument, *(document.select(f"tags.{t}").first()[0] for t in ("input", "graph") if t in tags)]
    path = next((p for p in found if p), None)
    if not path:
        raise ValueError("neither an argument nor the document's tags name a graph")
    return path


def clustering_rows(clustering: DataFrame, vertices: DataFrame) -> DataFrame:
    """``id, center, label, center label, probability``; an uncovered vertex is an error."""
    covered = F.when(F.col("center").isNull(), F.raise_error(F.lit("a vertex is not covered")).cast("long")).otherwise(F.col("center"))
    labels = vertices.select(F.col("vertex").alias("center"), F.col("label").alias("center label"))
    return clustering.withColumn("center", covered).join(vertices, "vertex").join(labels, "center").select(F.col("vertex").alias("id"), "center", "label", "center label", "probability")


def cached_table(build, path: str, inputs: DataFrame):
    """``build()`` kept as Parquet in the folder ``path`` and built again once any input file is newer.

    A new table is written beside the old one and takes its place by renaming, so readers never see half of it.
    """
    spark = inputs.sparkSession
    newest = inputs.select(F.max("_metadata.file_modification_time")).first()[0]
    try:
        stored = spark.read.parquet(path)
        oldest = stored.select(F.min("_metadata.file_modification_time")).first()[0]
        if newest is None or oldest is not None and oldest >= newest:
            return stored
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    fresh = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    build().write.parquet(fresh)
    place, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh))
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(place, True)
    if not files.rename(new, place):
        raise OSError(f"{fresh} could not be renamed to {path}")
    return spark.read.parquet(path)
