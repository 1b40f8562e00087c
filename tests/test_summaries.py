"""Quantiles, resampling, discovery and nested logistic models against plain versions."""

import hashlib
import math
import random

import numpy as np

from strandlake.operators import summaries as M


def test_grouped_quantiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, float(rng.randrange(40)), -2.25])) for _ in range(4000)] + [("one", 7.0), ("none", None)]
    got = {r.k: (r.n, r.q1, r.q5, r.q9) for r in M.grouped_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q1": 0.1, "q5": 0.5, "q9": 0.97}).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, (n, *qs) in got.items():
        v = [x for g, x in rows if g == k and x is not None]
        assert n == len(v) and np.allclose(qs, np.quantile(v, [0.1, 0.5, 0.97]))
    assert M.grouped_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", {"q": 0.5}).count() == 0


def test_resamples_are_poisson_and_the_same_again(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.integers(0, 9)), float(rng.integers(5, 20))) for i in range(600)] + [(None, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "k long, t double, b double")

    def weight(k, draw):
        a = (int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) % M.PRIME * 48_271 + draw * 69_621 + 40_692) % M.PRIME
        u = ((a * a % M.PRIME * 16_807 + a) % M.PRIME + 0.5) / M.PRIME
        return sum(u > s for s in M.poisson_steps())

    got = M.ratio_interval(df, "k", "t", "b").first()
    rates = [sum(weight(k, d) * t for k, t, _ in rows[:600]) / sum(weight(k, d) * b for k, _, b in rows[:600]) for d in range(1, 201)]
    assert got.draws == 200 and np.allclose([got.low, got.high], np.quantile(rates, [0.025, 0.975]))
    w = np.array([[weight(k, d) for d in range(1, 201)] for k in range(600)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03
    assert got == M.ratio_interval(df.repartition(7), "k", "t", "b").first()


def plain_logit(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(80):
        mu = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.pinv(x.T @ (x * (mu * (1 - mu))[:, None])) @ (x.T @ (y - mu))
    eta = x @ b
    return b, float((y * eta - np.logaddexp(0, eta)).sum())


def test_nested_models(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t in ("u", "v"):
        for c in ("p", "q"):
            base, x = rng.normal(0, 1, (500, 3)), rng.normal(30, 12, 500)
            eta = 0.4 + base @ [1.2, -0.8, 0.1] + (0.05 * (x - 30) if c == "p" else 0)
            y = (rng.random(500) < 1 / (1 + np.exp(-eta))).astype(float)
            rows += [(t, c, float(y[i]), float(x[i]), [float(v) for v in base[i]]) for i in range(500)]
    rows += [("u", "p", None, 1.0, [0.0] * 3), ("u", "p", 1.0, None, [0.0] * 3), ("u", "p", 1.0, 1.0, [0.0, None, 0.0])] + [("few", "p", float(i % 2), float(i), [0.0] * 3) for i in range(50)] + [("flat", "p", float(i % 2), 3.0, [float(i % 5), 0.0, 1.0]) for i in range(400)]
    got = {(r.trait, r.candidate): r for r in M.covariate_screen(spark.createDataFrame(rows, "trait string, candidate string, y double, x double, base array<double>")).collect()}
    assert set(got) == {("u", "p"), ("u", "q"), ("v", "p"), ("v", "q"), ("flat", "p")}
    for k in got:
        mine = [r for r in rows if r[:2] == k and None not in (r[2], r[3]) and None not in r[4]]
        y, base, x = np.array([r[2] for r in mine]), np.array([r[4] for r in mine]), np.array([r[3] for r in mine])
        one = np.ones((len(y), 1))
        scaled = ((x - x.mean()) / (x.std() or 1))[:, None]
        want = 2 * (plain_logit(np.hstack([one, base, scaled]), y)[1] - plain_logit(np.hstack([one, base]), y)[1])
        assert got[k].n == len(y) and abs(got[k].lrt - want) < 1e-6 and abs(got[k].delta_aic - (want - 2)) < 1e-6
        assert abs(got[k].p - math.erfc(math.sqrt(max(want, 0) / 2))) < 1e-6
    assert got["u", "p"].p < 1e-3


def test_novelty_and_strata(spark):
    sites = spark.createDataFrame([("c", 1, "a", "DEL"), ("c", 2, "b", "DEL"), ("c", 3, "d", "INS"), ("c", 4, "e", "INS"), ("c", 5, "x", "INS"), ("c", 6, "x", "INS"), ("c", 7, "only", "DEL")], "chrom string, pos long, id string, svtype string")
    carriers = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("b", 90), ("d", 3), ("d", 3), ("e", 1), ("x", 1), ("only", 90), ("d", 77)], "id string, sample long")
    order = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 3, 1)], "sample long, rank long, block long")
    classes = M.novelty_classes(sites, carriers, order, spark.createDataFrame([(90,)], "sample long"), sites.where("id = 'e'"))
    assert {(r.id, r["class"], r.first, r.second) for r in classes.collect()} == {("a", "new_recurrent", 1, 3), ("b", "in_controls", 2, None), ("d", "new_singleton", 3, None), ("e", "in_phase1", 1, None)}
    got = {(r.n_participants, r.svtype, r["class"]): (r.block, r.cumulative) for r in M.novelty_curve(classes, order, 2).collect()}
    assert got[2, "DEL", "new_singleton"] == (0, 1) and got[3, "DEL", "new_singleton"] == (1, 0) and got[3, "DEL", "new_recurrent"] == (1, 1)
    assert got[2, "DEL", "in_controls"] == (0, 1) and got[3, "INS", "new_singleton"] == (1, 1) and got[2, "INS", "in_phase1"] == (0, 1) and len(got) == 16
    curve = M.discovery_curve(carriers.withColumnRenamed("id", "site"), order, sites.where("id <> 'x'").selectExpr("id site", "svtype"))
    assert sorted((r.rank, r.svtype, r.cumulative) for r in curve.collect()) == [(1, "DEL", 1), (1, "INS", 1), (2, "DEL", 2), (2, "INS", 1), (3, "DEL", 2), (3, "INS", 2)]


def test_strata_read_carriers_once(spark):
    """The curve by strata works out its carriers once, however often they are needed."""
    from strandlake.plans.cohort import curve_by_strata

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    carriers = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3)], "site long, sample long").mapInArrow(count, "site long, sample long")
    samples = spark.createDataFrame([(i, "eur", False) for i in (1, 2, 3)], "sample long, ancestry string, control boolean")
    sites = spark.createDataFrame([(i, "DEL") for i in (1, 2, 3)], "site long, svtype string")
    got = {(r["rank"], r.freq): r.cumulative for r in curve_by_strata(carriers, samples, sites).collect()}
    assert got == {(1, "rare"): 1, (2, "rare"): 1, (3, "rare"): 1, (1, "singleton"): 0, (2, "singleton"): 1, (3, "singleton"): 2}
    assert seen.value == 4


def test_models_start_without_sorting_their_rows(spark):
    from strandlake.operators.summaries import _start

    rows = spark.createDataFrame([("a", 1.0, [1.0, 2.0]), ("a", 0.0, [1.0, 3.0]), ("b", 1.0, [1.0])], "g string, y double, x array<double>")
    got = _start(rows, ["g"])
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.g, r.n, r.b) for r in got.collect()) == [("a", 2, [0.0, 0.0]), ("b", 1, [0.0])]
