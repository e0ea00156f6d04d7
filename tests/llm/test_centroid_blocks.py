"""Clustering against plain Python integers, within and beyond what float64 holds exactly."""

import hashlib
import math
import random

import numpy as np
import pytest

from weftgraph.llm import centroid_blocks as cb


def plain(rows, length, k, rounds, scale, salt):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]

    def assign(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[0], []).append(v)
        centroids = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *assign(v)) for i, v in kept]
    per = {n: sum(d for _, m, d in found if m == n) for n in range(len(centroids))}
    every, small = sum(per.values()), lambda x: x if x < 1 << 63 else None
    return sorted(((i, n, small(d), small(per[n]), small(every), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in found), key=repr)


def clustered(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string").repartition(3)
    found = cb.cluster(df, **kw)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("reach", [1.0, 3e4, 1e9, 1e30])
def test_equals_plain_integers(spark, reach):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) * (reach if i % 3 == 0 else 1) for _ in range(4)]) for i in range(150)]
    rows += rows[:20] + [(None, rows[3][1]), (3, rows[4][1])]  # repeated rows, no id, an id of two vectors
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 2.0, 3.0]), (904, [1.0, float("nan"), 2.0, 3.0]), (905, [1.0, float("-inf"), 2.0, 3.0]), (906, [-0.0, 0.0, 0.0, 0.0])]
    kw = dict(length=4, k=7, rounds=3, scale=256, salt="2:")
    assert clustered(spark, rows, **kw) == plain(rows, **kw)


def test_ties_empty_centroids_and_few_vectors(spark):
    kw = dict(length=2, k=5, rounds=2, scale=1, salt="s")
    for rows in ([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, [1.0, 0.0])], [(i, [1.5, -1.5]) for i in range(9)], [(1, [3.0, 4.0])]):
        assert clustered(spark, rows, **kw) == plain(rows, **kw)
    assert clustered(spark, [], **kw) == [] == clustered(spark, [(None, [1.0, 2.0])], **kw)


def test_the_guard_parts_exact_from_inexact_rows():
    """Rows above the bound go by integers; a product that float64 rounds would choose the wrong one of two centroids."""
    far = (1 << 27) + 1
    x = np.array([[far, 0.0], [0.0, 0.0]])
    centroids = [[-far, 1], [-far, 0]]
    numbers, distances = cb.nearest(x, centroids)
    assert list(numbers) == [1, 1] and list(distances) == [(2 * far) ** 2, far**2]
    small, d = cb.nearest(np.array([[1.0, 0.0], [0.0, 2.0]]), [[0, 0], [0, 2]])
    assert list(small) == [0, 1] and list(d) == [1, 0] and d.dtype == np.int64


def test_seeds_beyond_the_vectors_of_a_task(spark):
    r = random.Random(8)
    rows = [(i, [r.random() for _ in range(3)]) for i in range(cb.BLOCK + 50)]
    kw = dict(length=3, k=4, rounds=1, scale=1 << 20, salt="2:")
    assert clustered(spark, rows, **kw) == plain(rows, **kw)
