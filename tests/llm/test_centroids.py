"""Centroid clustering against plain integer arithmetic."""

import hashlib
import math
import random

import pytest

from tagloom.llm import centroids


def brute(rows, dims, clusters, rounds, salt="2:"):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dims and all(a is not None and math.isfinite(a) for a in v):
            kept.append((key, [math.floor(256 * a) for a in v]))
    marks = sorted((hashlib.sha256(f"{salt}{k}".encode()).hexdigest(), x) for k, x in kept if k is not None)
    means = [x for _, x in marks[:clusters]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(means))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        for j, xs in groups.items():
            means[j] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    return sorted(((k is None, k or 0), *reversed(near(x))) for k, x in kept), means


@pytest.mark.parametrize("size", [1.0, 40.0, 9000.0])
def test_against_brute_force(spark, size):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-size, size) for _ in range(6)]) for i in range(150)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (900, None), (901, [1.0] * 5), (902, [1.0] * 5 + [None]),
             (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [])] + [(1000 + i, [0.25] * 6) for i in range(60)]
    table = spark.createDataFrame([(k, v, 7) for k, v in rows], "vec_id long, embedding array<double>, cluster int")
    found = centroids.cluster(centroids.integer_vectors(table, 6), 11, 3)
    want, means = brute(rows, 6, 11, 3)
    assert found.centroids == means
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance) for r in found.assigned.collect())
    assert got == want
    total = centroids.with_inertia(found).select("inertia").distinct().collect()
    assert [r.inertia for r in total] == [sum(w[2] for w in want)]


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    none = centroids.cluster(centroids.integer_vectors(spark.createDataFrame([(1, None)], schema), 2), 4, 2)
    assert centroids.with_inertia(none).count() == 0
    two = spark.createDataFrame([(1, [0.5, 0.5]), (2, [-0.5, 0.1])], schema)
    found = centroids.with_inertia(centroids.cluster(centroids.integer_vectors(two, 2), 40, 5)).collect()
    assert sorted(r.cluster for r in found) == [0, 1] and all(r.distance == 0 for r in found)


def test_far_components_raise(spark):
    far = spark.createDataFrame([(1, [3e9, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64-bit"):
        centroids.cluster(centroids.integer_vectors(far, 2), 2, 1)
