"""Packed genotype blocks against dense algebra, with samples in several chunks; ranks and running sums against plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import genotypes as G
from strandlake.operators.ranks import row_numbers, running_sums


def made(seed, n, m, groups=3, gone=0.08):
    rng = np.random.default_rng(seed)
    f = rng.uniform(0.05, 0.95, (groups, m))
    g = rng.binomial(2, f[rng.integers(0, groups, n)]).astype(float)
    g[:, m // 2 :][:, ::2] = np.where(rng.random((n, len(range(m // 2, m, 2)))) < 0.8, g[:, : len(range(m // 2, m, 2))], g[:, m // 2 :][:, ::2])  # sites in LD
    g[rng.random((n, m)) < gone] = np.nan
    pos = np.sort(rng.integers(0, 40 * m, m))
    return g, pos


def table(spark, g, pos, absent):
    rows = []
    for i in range(g.shape[0]):
        for j in range(g.shape[1]):
            if np.isnan(g[i, j]):
                if absent == "reference":
                    rows.append(("chr1" if j % 3 else "chr2", int(pos[j]), j, 100 + i, None, 1))
            elif g[i, j] or absent == "missing":
                rows.append(("chr1" if j % 3 else "chr2", int(pos[j]), j, 100 + i, int(g[i, j] > 0), int(g[i, j] > 1)))
    rows.append(rows[-1])  # a genotype that stands twice
    return spark.createDataFrame(rows, "chrom string, pos long, site int, sample long, a1 int, a2 int").withColumns({"chunk": F.lit("x"), "slot": F.lit(1), "n": F.lit(2)})


def dense_r2(g, i, j):
    m = ~np.isnan(g[:, i]) & ~np.isnan(g[:, j])
    x, y = g[m, i], g[m, j]
    return m.sum(), (np.corrcoef(x, y)[0, 1] ** 2 if x.std() > 0 and y.std() > 0 else None)


@pytest.mark.parametrize("absent,chunk", [("missing", 64), ("reference", 16_384)])
def test_pairs_and_pruning(spark, absent, chunk):
    g, pos = made(1, 150, 60)
    packed = G.pack(table(spark, g, pos, absent), absent, chunk=chunk)
    assert packed.shape.chunks == (3 if chunk == 64 else 1)
    got = {(r.early, r.late): (r.n, r.r2) for r in G.site_pairs(packed, 300, 10, tile=7).collect()}
    order = sorted(range(60), key=lambda j: (pos[j], j))
    want, kept = {}, []
    for b, j in enumerate(order):
        stay = True
        for i in order[:b]:
            if bool(i % 3) == bool(j % 3) and pos[j] - pos[i] <= 300:
                want[i, j] = dense_r2(g, i, j)
                stay &= not (i in kept and want[i, j][1] is not None and want[i, j][1] > 0.05)
        if stay:
            kept.append(j)
    assert set(got) == set(want)
    for k, (n, r2) in want.items():
        assert got[k][0] == n and (got[k][1] is None) == (r2 is None) and (r2 is None or abs(got[k][1] - r2) < 1e-9)
    pruned = G.ld_prune(packed, 0.05, 300, 10).collect()
    assert len(pruned) == 60 and {r.site for r in pruned if r.kept} == set(kept) and len(kept) < 60


@pytest.mark.parametrize("chunk", [32, 16_384])
def test_thirty_two_components(spark, chunk):
    g, pos = made(2, 90, 240)
    packed = G.pack(table(spark, g, pos, "missing"), chunk=chunk)
    p = np.nanmean(g, 0) / 2
    use = (p > 0) & (p < 1)
    z = np.nan_to_num((g - 2 * p) / np.sqrt(2 * p * (1 - p)))[:, use] / np.sqrt(use.sum())
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    scores, loadings, singular = G.pca(packed, 32, rounds=6, slab=50)
    assert np.allclose(singular[:2], s[:2], rtol=1e-6) and np.allclose(singular, s[:32], rtol=2e-2)  # all but two are noise, close to one another
    mine = np.array([r.pcs for r in scores.orderBy("sample").collect()])
    assert mine.shape == (90, 32) and loadings.count() == use.sum()
    # the leading subspace, and what 32 components leave of the matrix
    q, _ = np.linalg.qr(mine[:, :2])
    assert np.linalg.norm(u[:, :2] - q @ (q.T @ u[:, :2])) < 1e-2
    q, _ = np.linalg.qr(mine)
    assert np.linalg.norm(z - q @ (q.T @ z)) < 1.01 * np.sqrt((s[32:] ** 2).sum())
    few = G.pack(table(spark, g[:3, :5], pos[:5], "missing"))
    assert len(G.pca(few, 32)[0].first().pcs) <= 3


def test_relatedness_blocks(spark):
    g, pos = made(3, 70, 80)
    packed = G.pack(table(spark, g, pos, "missing"), chunk=32)
    p = np.nanmean(g, 0) / 2
    use = (p > 0) & (p < 1)
    z, known = np.nan_to_num((g - 2 * p) / np.sqrt(2 * p * (1 - p)))[:, use], ~np.isnan(g[:, use])
    n = known.astype(float) @ known.T
    k = z @ z.T / n
    got = {(r["sample"] - 100, r["sample2"] - 100): (r.n, r.k) for r in G.relatedness(packed, 0.05, block=16, slab=20).collect()}
    want = {(i, j): (n[i, j], 1.0 if i == j else k[i, j]) for i in range(70) for j in range(i, 70) if i == j or k[i, j] >= 0.05}
    assert set(got) == set(want) and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-9 for x in want)


def rare(seed, n, m, absent):
    """Few carriers a site, some related, some missing; dosages of all samples, where absent ones are 0 or missing."""
    rng = np.random.default_rng(seed)
    g = np.zeros((n, m)) if absent == "reference" else np.full((n, m), np.nan)
    for j in range(m):
        who = rng.choice(n // 8, 5, replace=False) + n // 8 * (j % 8)
        g[who, j] = rng.choice([1, 2] if absent == "reference" else [0, 1, 2], 5)
    if absent == "reference":
        g[(rng.random((n, m)) < 0.03) & (g > 0)] = np.nan
        g[rng.random((n, m)) < 0.002] = np.nan
    return g, np.sort(rng.integers(0, 40 * m, m))


@pytest.mark.parametrize("absent", ["reference", "missing"])
def test_few_carriers(spark, absent, monkeypatch):
    """Rows hold entries, not all samples; pairs of samples come from shared entries alone."""
    g, pos = rare(5, 400, 160, absent)
    rows = [("chr1", int(pos[j]), j, 100 + i, None if np.isnan(g[i, j]) else int(g[i, j] > 0), None if np.isnan(g[i, j]) else int(g[i, j] > 1)) for i in range(400) for j in range(160) if (g[i, j] != 0 if absent == "reference" else not np.isnan(g[i, j])) or j == 0]
    packed = G.pack(spark.createDataFrame(rows, "chrom string, pos long, site int, sample long, a1 int, a2 int"), absent)
    assert packed.sites.selectExpr("max(CASE WHEN site > 0 THEN octet_length(planes) END)").first()[0] <= 4 * 20  # planes of 400 samples take 112
    p = np.nanmean(g, 0) / 2
    use = (p > 0) & (p < 1)
    z, known = np.nan_to_num((g - 2 * p) / np.sqrt(2 * p * (1 - p)))[:, use], ~np.isnan(g[:, use])
    n = known.astype(float) @ known.T.astype(float)
    with np.errstate(invalid="ignore"):
        k = z @ z.T / n
    monkeypatch.setattr(G, "_by_blocks", None)
    got = {(r["sample"] - 100, r["sample2"] - 100): (r.n, r.k) for r in G.relatedness(packed, 0.05).collect()}
    want = {(i, j): (n[i, j], 1.0 if i == j else k[i, j]) for i in range(400) for j in range(i, 400) if i == j or n[i, j] > 0 and k[i, j] >= 0.05}
    assert len(want) > 500 and set(got) == set(want) and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-9 for x in want)
    monkeypatch.setattr(G, "PIECE", 96)
    _, loadings, singular = G.pca(packed, 20, rounds=12, slab=50)
    s = np.linalg.svd(z / np.sqrt(use.sum()), compute_uv=False)
    assert loadings.count() == use.sum() and np.allclose(singular[:5], s[:5], rtol=1e-2)


def test_pack_edges(spark):
    schema = "chrom string, pos long, site int, sample long, a1 int, a2 int"
    none = G.pack(spark.createDataFrame([], schema))
    assert G.site_pairs(none, 10).count() == 0 and G.ld_prune(none).count() == 0 and G.pca(none, 4)[0].count() == 0 and G.relatedness(none, 0.0).count() == 0
    with pytest.raises(Exception, match="dosage"):
        G.pack(spark.createDataFrame([("chr1", 1, 1, 1, 2, 1)], schema))
    one = G.pack(spark.createDataFrame([("chr1", 1, 1, 1, 0, 1), ("chr1", None, 2, 1, 1, 1), ("chr1", 5, 3, None, 1, 0)], schema))
    assert {(r.site, r.kept) for r in G.ld_prune(one).collect()} == {(1, True), (2, True)}


def test_ranks_and_running_sums(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i, rng.choice([None, 1, 2, 3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, x int, i int, v int")
    got = {r.i: r.n for r in row_numbers(df, "x", "i").collect()}
    assert [got[i] for _, i in sorted((x, i) for _, x, i, _ in rows)] == list(range(3000))
    sums = {r.i: (r.total, r.n) for r in running_sums(df, ["k"], ["x", "i"], {"total": F.col("v"), "n": F.lit(1)}).collect()}
    seen = {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        t, n = seen.get(k, (0, 0))
        seen[k] = (t + (v or 0), n + 1)
        assert sums[i] == seen[k]
