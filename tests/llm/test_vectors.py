"""Hard negatives and centroids against brute force: ties, repeats, nulls, empty tables, several blocks."""

from __future__ import annotations

import hashlib
import math
import random

import pytest

from tyche.llm import hard_negatives
from tyche.llm.centroids import LARGEST, lloyd, whole_vectors, with_inertia
from tyche.llm.hard_negatives import mined

ROWS = "vec_id long, label int, embedding array<float>, window long, n int, v string, cluster int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """Rows with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, 2, "v", 3) for r in rows], ROWS)


def odd(dims):
    """Rows that take no part."""
    one = [0.5] * dims
    return [(700, None, one), (701, 1, None), (702, 1, [*one[1:], None]), (703, 2, [*one[1:], NAN]), (704, 3, [*one[1:], INF]), (None, 1, one), (705, 1, [])]


def brute_negatives(rows, every):
    used: dict = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            label = (label + 1) % 10 if i % 7 == 0 else label
            used[i] = min(used.get(i, (99, [])), (label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (label, v) in used.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in used.items() if i != a and len(w) == len(v)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if used[i][0] == label][:5]:
            near = [i for i in order if used[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:10]
            out += [(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(near, 1)]
    return sorted(out)


def vectors(rng, n, dims, kinds):
    some = [[rng.choice([-1.25, -0.5, 0.0, 0.25, 0.75, 1.0]) for _ in range(dims)] for _ in range(kinds)]
    return [(k, rng.randrange(3), rng.choice(some)) for k in range(n)]


def test_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)  # several blocks of anchors
    rng = random.Random(3)
    rows = vectors(rng, 260, 4, 12) + [(9000 + k, 4, [1.0, 0.5]) for k in range(5)] + odd(4)
    rows += [(20, 1, [0.25, 0.25, 0.25, 0.25]), rows[40], rows[41], (-40, 2, [0.5, 0.5, 0.5, 0.5]), (1 << 62, 1, [0.5, 0.75, 0.5, 0.5])]
    wanted = brute_negatives(rows, 20)
    found = [tuple(r) for r in mined(table(spark, rows).repartition(5), every=20).collect()]
    assert sorted(found) == wanted and len({r[0] for r in wanted}) > 8


def test_equal_scores_are_told_apart_by_ids(spark):
    """A third of all rows are one vector: digits of the ids decide, over several rounds."""
    rng = random.Random(4)
    rows = vectors(rng, 300, 3, 200) + [(1000 + 3 * k, 1, [0.75, 0.25, 0.25]) for k in range(400)] + [(50_000 + k, 2, [0.75, 0.25, 0.0]) for k in range(400)]
    rows += [(100_000, 1, [1.0, 0.25, 0.25]), (200_000, 2, [1.0, 0.25, 0.25]), (-(1 << 62), 2, [0.0, 0.0, 0.0])]
    rng.shuffle(rows)
    found = [tuple(r) for r in mined(table(spark, rows).repartition(6), every=100).collect()]
    assert sorted(found) == brute_negatives(rows, 100)


def test_no_negatives(spark):
    assert mined(table(spark, [])).collect() == [] and mined(table(spark, [])).columns[0] == "anchor_id"
    assert mined(table(spark, odd(3))).count() == 0
    alone = [(100, 1, [1.0, 1.0]), (101, 1, [1.0, 1.0]), (102, 2, [-1.0, -1.0])]  # a positive, but no negative in its range
    assert mined(table(spark, alone)).count() == 0
    assert mined(table(spark, [(100, 1, [1.0]), (101, 2, [1.0])])).count() == 0
    with pytest.raises(Exception, match="too large"):
        mined(table(spark, [(100, 1, [3.0e38])]))


def brute_lloyd(rows, k, rounds, dims, scale=64):
    used = [(i, [math.floor(scale * x) for x in v]) for i, _, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(used, key=key)[:k]]

    def assigned():
        far = [[sum((x - y) ** 2 for x, y in zip(v, c)) for c in centroids] for _, v in used]
        return [(min(d), d.index(min(d))) for d in far]

    for _ in range(rounds):
        where = assigned()
        for c in range(len(centroids)):
            own = [v for (_, v), (_, at) in zip(used, where) if at == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    where = assigned()
    inertia = [sum(d for d, at in where if at == c) for c in range(len(centroids))]
    return sorted(((i, at, d, inertia[at], sum(inertia), centroids[at]) for (i, _), (d, at) in zip(used, where)), key=str)


@pytest.mark.parametrize("k", [1, 5, 400])
def test_lloyd(spark, k):
    rng = random.Random(k)
    rows = vectors(rng, 120, 3, 30) + [(500 + j, 0, [0.0, 0.25, 0.5]) for j in range(100)] + odd(3)
    rows += [rows[0], rows[0], (3, 1, [9.0, -9.0, 0.0]), (800, 1, [1.0, 2.0]), ((1 << 60) + 1, None, [0.5, 0.5, -7.0])]
    vecs = whole_vectors(table(spark, rows).select("vec_id", "embedding", "n"), 64, 3)
    found = with_inertia(*lloyd(vecs.repartition(5), k, 3))
    assert sorted((tuple(r) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid").collect()), key=str) == brute_lloyd(rows, k, 3, 3)


def test_no_vectors(spark):
    found = with_inertia(*lloyd(whole_vectors(table(spark, odd(3)), 64, 2)))
    assert found.count() == 0 and found.columns == ["cluster", "vec_id", "distance", "cluster_inertia", "inertia", "centroid"]
    with pytest.raises(Exception, match="too large"):
        whole_vectors(table(spark, [(1, 1, [float(LARGEST)])]), 64, 1).collect()
