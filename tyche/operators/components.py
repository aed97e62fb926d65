"""Connected components of many graphs at once."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..storage import fresh_path, kept, removed, written

#: Labels up to this number (about 50 bytes each) are broadcast, and edges up to it end in one task; more are joined by shuffles.
BROADCAST_ROWS = 100_000
#: Edges that a task joins at a time, and the most edges of a graph that one task takes whole.
CHUNK, WHOLE = 1 << 19, 2_000_000


def components(edges: DataFrame, keys: list[str] | None = None, src: str = "src", dst: str = "dst", most: int | None = None) -> DataFrame:
    """``*keys, vertex, comp`` for every vertex that has an edge; ``comp`` is the smallest vertex of its component.

    Each combination of ``keys`` (a possible world, say) is a graph of its own, of at most ``most`` edges (counted if
    not given). Keyed graphs of at most ``WHOLE`` edges are dealt to tasks whole. Of others every task first joins the edges
    that it happens to have and hands on each vertex with the smallest one it found it joined with; a vertex that
    several tasks have seen links what they found. Only these links are left to join: by one task if they are few,
    else by :func:`by_rounds`. So a hub's edges end where they were read, and its name is not a key of any shuffle.
    """
    keys = keys or []
    used = edges.select(*keys, F.col(src).alias("src"), F.col(dst).alias("dst"))
    if not isinstance(used.schema["src"].dataType, IntegralType):
        return by_rounds(used, keys)
    if keys and most is None:
        most = used.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if keys and most <= WHOLE:
        return joined(used.repartition(*keys).sortWithinPartitions(*keys), keys, True)
    on = [*keys, "vertex"]
    seen = kept(joined(used, keys), "joined")
    tops = seen.groupBy(*on).agg(F.min("comp").alias("top"), F.collect_set("comp").alias("found"))  # no more than there are tasks
    rows, path = Observation(), fresh_path(edges.sparkSession, "tops")
    tops.select(*on, "top", F.filter("found", lambda c: c != F.col("top")).alias("others")).observe(rows, F.sum(F.size("others")).alias("links")).write.parquet(path)
    tops = edges.sparkSession.read.parquet(path)
    links = tops.select(*keys, F.col("top").alias("src"), F.explode("others").alias("dst"))
    left = rows.get["links"] or 0
    if not left:
        return tops.select(*on, F.col("top").alias("comp"))
    few = left <= BROADCAST_ROWS
    labels = joined(links.repartition(1), keys) if few else by_rounds(kept(links.distinct(), "links"), keys)
    labels = labels.filter("vertex != comp").select(*keys, F.col("vertex").alias("top"), "comp")
    return tops.join(F.broadcast(labels) if few else labels, [*keys, "top"], "left").select(*on, F.coalesce("comp", "top").alias("comp"))


def smallest_joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest one that the pairs ``a, b`` join it with."""
    label = np.arange(n)
    while len(a):
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (further := label[label]).tobytes() != label.tobytes():
            label = further
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def contracted(edges: pa.Table) -> pa.Table:
    """Of rows of keys and two ends, each vertex of each key with the smallest vertex it is joined with."""
    *keys, _, _ = edges.column_names
    ends = np.concatenate([edges.column(c).to_numpy() for c in edges.column_names[-2:]])
    names, node = np.unique(ends, return_inverse=True)
    for key in keys:
        code = edges.column(key).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        node = np.unique(np.tile(code, 2) * np.int64(len(ends)) + node, return_inverse=True)[1]  # in order of vertices within a key
    _, first, node = np.unique(node, return_index=True, return_inverse=True)
    label = smallest_joined(*np.split(node, 2), len(first))
    rows = pa.array(first % max(1, edges.num_rows))
    return pa.table([*(edges.column(k).take(rows) for k in keys), *(pa.array(x, edges.schema.field(len(keys)).type) for x in (ends[first], ends[first][label]))], [*keys, *edges.column_names[-2:]])


def same(column: pa.ChunkedArray, value: pa.Scalar) -> pa.ChunkedArray:
    """Where ``column`` has ``value``, null included."""
    return pc.fill_null(pc.equal(column, value), False) if value.is_valid else pc.is_null(column)


def joined(edges: DataFrame, keys: list[str], in_order: bool = False) -> DataFrame:
    """``*keys, vertex, comp`` of the edges of each task on their own; a task keeps its vertices, not its edges.

    With ``in_order`` the edges of a task come by their keys; then a graph leaves it when the next begins, and only the
    vertices of one are held.
    """
    names = [*keys, "src", "dst"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, most = [], 0, CHUNK
        for batch in batches:
            held.append(pa.RecordBatch.from_arrays(batch.columns, names))  # whatever it says of nulls
            rows += batch.num_rows
            if rows >= most:
                table = contracted(pa.Table.from_batches(held))
                if in_order:
                    open_ = functools.reduce(pc.and_, (same(table.column(k), batch.column(n)[-1]) for n, k in enumerate(keys)))
                    yield from named(table.filter(pc.invert(open_)))
                    table = table.filter(open_)
                held = table.combine_chunks().to_batches()
                rows = table.num_rows
                most = max(CHUNK, 2 * rows)
        if held:
            yield from named(contracted(pa.Table.from_batches(held)))

    def named(table: pa.Table) -> list[pa.RecordBatch]:
        return table.rename_columns([*keys, "vertex", "comp"]).to_batches(max_chunksize=CHUNK)

    usable = edges.filter("src is not null and dst is not null")
    return usable.mapInArrow(run, usable.withColumnsRenamed({"src": "vertex", "dst": "comp"}).schema)


def by_rounds(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The same as :func:`components`, for graphs of any size, in rounds of joins.

    All graphs advance together. A round takes the smallest label among the neighbours, passes it on to the vertex that
    the old label names, and follows labels twice as far (pointer jumping). Each round writes its labels to the shared
    folder and drops those before, so neither a plan nor the folder grows over the rounds. They end when no label changes.
    """
    spark = edges.sparkSession
    both = edges.select(*keys, F.col("src").alias("vertex"), F.col("dst").alias("other"))
    both = kept(both.unionByName(edges.select(*keys, F.col("dst").alias("vertex"), F.col("src").alias("other"))).distinct(), "edges")
    on = [*keys, "vertex"]
    first, rows = both.groupBy(*on).agg(F.least(F.min("other"), F.first("vertex")).alias("comp")), Observation()
    schema, path = first.schema, written(first.observe(rows, F.count("*").alias("n")), "labels")
    few = F.broadcast if rows.get["n"] <= BROADCAST_ROWS else lambda df: df
    while True:
        labels = spark.read.schema(schema).parquet(path)
        other = labels.select(*keys, F.col("vertex").alias("other"), F.col("comp").alias("near"))
        nearest = both.join(few(other), [*keys, "other"]).groupBy(*on).agg(F.min("near").alias("near"))
        lowered = nearest.join(few(labels), on).select(*on, F.least("comp", "near").alias("low"), "comp")
        passed = lowered.select(*on, "low", F.col("comp").alias("old")).unionByName(lowered.select(*keys, F.col("comp").alias("vertex"), "low", F.lit(None).alias("old")))
        hooked = passed.groupBy(*on).agg(F.min("low").alias("low"), F.max("old").alias("old"))
        root = hooked.select(*keys, F.col("vertex").alias("low"), F.col("low").alias("comp"))
        jumped = hooked.join(few(root), [*keys, "low"]).select(*on, "comp", "old")
        rows = Observation()
        following = written(jumped.observe(rows, F.count_if(F.col("comp") != F.col("old")).alias("changed")).drop("old"), "labels")
        removed(spark, path)
        path = following
        if not rows.get["changed"]:
            return spark.read.schema(schema).parquet(path)
