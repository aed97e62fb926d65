"""Pairs counted without listing them, large groups, documents written by many tasks, compressed dumps."""

from __future__ import annotations

import bz2
import glob
import gzip
import itertools
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tyche.operators import evaluate
from tyche.sources import edges as es
from tyche.sources import results


def pairs_of(rows):
    groups: dict = {}
    for c, m in rows:
        groups.setdefault(c, set()).add(m)
    return {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}


@pytest.mark.parametrize("most", [1000, 3])
def test_overlapping_clusterings(spark, monkeypatch, most):
    monkeypatch.setattr(es.pairs_within, "__defaults__", (most,))
    rng = random.Random(1)
    truth = [(c, m) for c in range(5) for m in rng.sample(range(40), 12)] + [(9, 55)]
    actual = [(key, c, m) for key in "ab" for c in range(6) for m in rng.sample(range(45), 9)]
    actual += [("c", c, 100 + c) for c in range(3)]  # knows nothing that the truth knows
    names = {m for _, m in truth}
    found = evaluate.confusion_matrix(spark.createDataFrame(actual, "key string, cluster_id int, member int"), spark.createDataFrame(truth, "cluster_id int, member int"), ("key",))
    got = {r.key: (r.tp, r.fp, r.fn, r.tn) for r in found.collect()}
    wanted, all_ = pairs_of(truth), len(names) * (len(names) - 1) // 2
    for key in "abc":
        own = pairs_of([(c, m) for k, c, m in actual if k == key and m in names])
        tp, fp = len(own & wanted), len(own - wanted)
        assert got[key] == (tp, fp, len(wanted) - tp, all_ - len(wanted) - fp)
    one = evaluate.pair_counts(spark.createDataFrame([x[1:] for x in actual if x[0] == "a"], "cluster_id int, member int")).first()
    assert one.distinct_pairs == len(pairs_of([x[1:] for x in actual if x[0] == "a"])) < one.summed_pairs


def test_members_of_the_same_clusters_are_counted_together(spark):
    """Two clusters of 100,000 members that share half: three classes, three pairs of them."""
    rows = spark.range(150_000).select(F.explode(F.when(F.col("id") < 50_000, F.array(F.lit(1))).when(F.col("id") < 100_000, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))).alias("cluster_id"), F.col("id").alias("member"))
    n = 100_000
    assert evaluate.pair_counts(rows).first().distinct_pairs == 2 * (n * (n - 1) // 2) - 50_000 * 49_999 // 2


def test_a_large_group_is_dealt_to_many_tasks(spark):
    n, most = 3000, 250
    items = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("m")).unionByName(spark.createDataFrame([(2, 5), (2, 7), (3, 9), (None, 1)], "g int, m long"))
    pairs = es.pairs_within(items, ["g"], "m", most)
    assert pairs.filter("g = 1").select(F.least("l.m", "r.m"), F.greatest("l.m", "r.m")).distinct().count() == pairs.filter("g = 1").count() == n * (n - 1) // 2
    assert [(r.l.m, r.r.m) for r in pairs.filter("g = 2").collect()] == [(5, 7)] and pairs.filter("g = 3 or g is null").isEmpty()
    keys = es.pairs_within(items.filter("g = 1"), ["g"], "m", most).groupBy(F.pmod(F.xxhash64("l.m"), F.lit(12)), F.pmod(F.xxhash64("r.m"), F.lit(12))).count()
    assert keys.agg(F.max("count")).first()[0] < 2 * most * most


def test_a_document_by_many_tasks(spark, tmp_path):
    n = 100_000
    rows = spark.range(0, n, 1, 7).select("id", (F.col("id") % 11).alias("center"), F.format_string('v"%d', "id").alias("center label"), F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.col("id") / 4).alias("probability"))
    path = results.save_run(str(tmp_path / "runs"), {"algorithm": "mcp", "k": 3}, {"clustering": rows, "empty": rows.limit(0), "scores": rows.limit(1)}, date="2017-05-01T10:00:00")
    assert re.fullmatch(r".*/2017-05-01T100000-[0-9a-f]{8}\.json\.bz2", path) and os.listdir(tmp_path / "runs") == [os.path.basename(path), f".{os.path.basename(path)}.crc"][: len(os.listdir(tmp_path / "runs"))] or os.path.exists(path)
    doc = json.loads(bz2.decompress(open(path, "rb").read()))
    assert doc["date"] == "2017-05-01T10:00:00" and doc["tags"] == {"algorithm": "mcp", "k": 3} and doc["tables"]["empty"] == [] and len(doc["tables"]["scores"]) == 1
    assert doc["tables"]["clustering"] == [{"id": k, "center": k % 11, "center label": f'v"{k}', "probability": None if k % 3 == 0 else k / 4} for k in range(n)]
    assert results.load_table(spark, path, "clustering").agg(F.sum("id")).first()[0] == n * (n - 1) // 2
    again = results.with_tables(spark, path, str(tmp_path / "scored"), {"scores": spark.createDataFrame([(0.5, float("inf"))], "acr double, avpr double")})
    new = json.loads(bz2.decompress(open(again, "rb").read()))
    assert os.path.basename(again) == os.path.basename(path) and new["tables"]["scores"] == [{"acr": 0.5, "avpr": None}]
    assert new["tags"] == doc["tags"] and len(new["tables"]["clustering"]) == n


def test_a_packed_dump_is_parsed_by_many_tasks(spark, tmp_path):
    record = lambda k: f"<article key='journals/{k}'><author>A {k}</author>\n<author>B</author><year>{1990 + k % 30}</year></article>\n<www key='w{k}'><author>C</author></www>"
    text = "<?xml version='1.0'?>\n<dblp>\n" + "\n".join(map(record, range(300))) + "\n</dblp>\n"
    (tmp_path / "plain.xml").write_text(text)
    (tmp_path / "packed.xml.gz").write_bytes(gzip.compress(text.encode()))
    plain = es.read_xml_records(spark, str(tmp_path / "plain.xml"), "article")
    packed = es.read_packed_xml_records(spark, str(tmp_path / "packed.xml.gz"), "article", records=40)
    assert plain.schema == packed.schema and sorted(map(str, plain.collect())) == sorted(map(str, packed.collect())) and plain.count() == 300
    assert len(packed.inputFiles()) >= 6
    assert es.read_packed_xml_records(spark, str(tmp_path / "packed.xml.gz"), "www").count() == 300


def test_a_cached_table_is_replaced_whole(spark, tmp_path):
    source, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    spark.range(3).write.parquet(source)
    build = lambda: spark.read.parquet(source)
    assert results.cached_table(build, cache, spark.read.parquet(source)).count() == 3
    spark.range(5).write.mode("append").parquet(source)
    for file in glob.glob(f"{source}/part-*"):
        os.utime(file, (2**31, 2**31))
    assert results.cached_table(build, cache, spark.read.parquet(source)).count() == 8
    assert sorted(os.listdir(tmp_path)) == ["cache", "in"]
