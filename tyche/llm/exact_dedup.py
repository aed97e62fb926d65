"""Exact deduplication with an extendible-hash index.

The hash of a normalised text names a slot of a directory of ``2 ** depth`` entries. The directory is doubled level
by level: a bucket splits while it holds more rows than ``capacity``. A bucket that no doubling can split (copies of
one text) is chained over several pages. Owner tasks each process the pages of some buckets and compare texts byte
by byte; what they find is written to the shared folder, where the pages of chained buckets are merged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept

#: The directory has at most ``2 ** MAX_DEPTH`` entries, so it may be broadcast.
MAX_DEPTH = 16


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]+", " ")


def directory(keys: DataFrame, rows: int, capacity: int) -> tuple[DataFrame, int]:
    """``slot, bucket, pages`` for each used slot, and the directory's depth; ``bucket`` encodes depth and prefix."""
    capacity = max(capacity, math.ceil(4 * rows / 2**MAX_DEPTH))
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, rows / capacity)))) + 2)
    counts = keys.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("slot")).agg(F.count("*").alias("n"))
    levels = counts.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")).withColumn(
        "bucket", F.expr(f"shiftright(slot, {depth} - level) + shiftleft(1L, level)")
    )
    sizes = levels.groupBy("bucket").agg(F.sum("n").alias("size"))
    fit = levels.join(sizes, "bucket").filter((F.col("size") <= capacity) | (F.col("level") == depth))
    leaf = fit.groupBy("slot").agg(F.min(F.struct("level", "bucket", "size")).alias("leaf"))
    return leaf.select("slot", F.col("leaf.bucket").alias("bucket"), F.ceil(F.col("leaf.size") / capacity).cast("int").alias("pages")), depth


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``.

    Texts are equal when identical after replacing each run of ASCII white space by one space; null counts as empty.
    The row with the smallest id of a group stays. A null id never wins against another; a group of null ids only
    keeps all of them (``keep_id`` null). Repeated rows with one id share its decision and each count in
    ``group_size``. Other columns are not read; an empty table gives an empty result.
    """
    text = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    entries = kept(text.select("id", F.xxhash64("text").alias("key"), F.unhex(F.sha2("text", 256)).alias("digest")), "dedup-entries")
    rows = entries.count()
    slots, depth = directory(entries, rows, capacity)
    owned = (
        text.withColumn("key", F.xxhash64("text"))
        .withColumn("slot", F.shiftrightunsigned("key", 64 - depth))
        .join(F.broadcast(slots), "slot")
        .withColumn("page", F.pmod(F.xxhash64("id"), F.col("pages")))
        .repartition("bucket", "page")
    )
    pages = owned.groupBy("bucket", "page", "pages", "key", "text").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    chain = F.when(F.col("pages") > 1, F.col("text"))  # only chained buckets are compared again
    found = kept(pages.select("key", F.unhex(F.sha2("text", 256)).alias("digest"), chain.alias("chain"), "first_id", "n"), "dedup-pages")
    index = kept(found.groupBy("key", "digest", "chain").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("group_size")).drop("chain"), "dedup-index")

    # At most 1000 groups hold a thousandth of the rows each: they are broadcast, so that no task gets such a group.
    hot = index.filter(F.col("group_size") * 1000 > rows)
    common = entries.join(F.broadcast(hot), ["key", "digest"])
    rest = entries.join(F.broadcast(hot.select("key", "digest")), ["key", "digest"], "left_anti")
    rest = rest.join(index.filter(F.col("group_size") * 1000 <= rows), ["key", "digest"])
    return common.unionByName(rest).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
