"""Centroid clustering against brute force in Python's whole numbers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from strandlake.llm.centroids import cluster


def brute(rows, k, rounds, dims, scale, salt="2:"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    begin = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in begin]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(own, centroids)]
    return sorted(((i, c, d) for i, v in kept for d, c in [nearest(v)]), key=repr), centroids


def told(spark, rows, **how):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit("a"), "lead": F.lit(1), "rest": F.lit(2), "c": F.lit(3), "cluster": F.lit(4)})
    got, centroids = cluster(table, **how)
    found = got.collect()
    return sorted(((r.vec_id, r.cluster, r.distance) for r in found), key=repr), centroids, sum(r.compared for r in found)


def test_clusters_against_brute_force(spark):
    rng = random.Random(5)
    middle = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(middle)]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(500, 700)]  # a third of all rows are copies of one vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (900, None), (901, []), (902, [0.0] * 7), (903, [0.0] * 7 + [None]), (904, [math.nan] * 8), (905, [math.inf] + [0.0] * 7), (906, [0.0] * 8), (907, [-0.0] * 8)]
    how = dict(k=12, rounds=4, dims=8, scale=256)
    got, centroids, compared = told(spark, rows, leading=4, **how)
    assert (got, centroids) == brute(rows, **how)
    assert compared < 0.6 * 12 * len(got)
    # the filter decides nothing: as many leading coordinates as there are, or one
    assert told(spark, rows, leading=8, **how)[:2] == (got, centroids) == told(spark, rows, leading=1, **how)[:2]


def test_clusters_edges(spark):
    assert told(spark, [], dims=2) == ([], [], 0)
    rows = [(i, [float(i % 2), 0.0]) for i in range(6)]  # equal centroids: one of them stays empty, ties go to the smaller number
    how = dict(k=40, rounds=5, dims=2, scale=16)
    assert told(spark, rows, **how)[:2] == brute(rows, **how)
    far = [(i, [1e7 * i, -1e7 * i]) for i in range(9)]
    how = dict(k=3, rounds=2, dims=2, scale=7)
    assert told(spark, far, **how)[:2] == brute(far, **how)
    with pytest.raises(Exception, match="passes"):
        told(spark, [(1, [1e300, 0.0])], dims=2)
