"""Hand-checkable cases of the domain operators."""

import itertools
import math
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import stats as S
from strandlake.operators import association as A
from strandlake.operators import cohort as C
from strandlake.operators import dossier as D
from strandlake.operators import loci as L
from strandlake.operators import intervals as I
from strandlake.operators import rows as R
from strandlake.sources import tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_covering_join(spark):
    markers = spark.createDataFrame([("chr22", 100, 2, 3), ("chr22", 200, 3, 3), ("chr22", 200, 9, 9)], "chrom string, pos long, an1 int, an2 int")
    targets = spark.createDataFrame([("chr22", p) for p in (50, 100, 150, 200, 250)] + [("chr1", 5)], "chrom string, pos long")
    for width in (40, 1_000_000):
        got = rows(I.covering_join(targets, markers, width), "chrom", "pos", "an1", "an2", "marker_pos", "exact")
        assert got == sorted([("chr22", 50, 2, 3, 100, False), ("chr22", 100, 2, 3, 100, True), ("chr22", 150, 3, 3, 200, False), ("chr22", 200, 3, 3, 200, True), ("chr22", 250, 3, 3, 200, False), ("chr1", 5, None, None, None, None)], key=lambda r: (r[0], r[1]))


def test_intervals_against_brute_force(spark):
    rng = np.random.default_rng(5)
    make = lambda n: [("chr" + str(rng.integers(3)), int(s), int(s + rng.integers(1, 400)), i) for i, s in enumerate(rng.integers(0, 5000, n))]
    a, b = make(120), make(90)
    left, right = spark.createDataFrame(a, "chrom string, start0 long, end0 long, i long"), spark.createDataFrame(b, "chrom string, start0 long, end0 long, i long")
    expected = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    for width in (50, 700, 100_000):
        assert rows(I.range_join(left, right, width=width), "i", "i_r") == expected
    covered = {(c, p) for c, s, e, _ in b for p in range(s, e)}
    for width in (64, 20_000):
        merged = rows(I.merge_intervals(right, width=width), "chrom", "start0", "end0")
        assert {(c, p) for c, s, e in merged for p in range(s, e)} == covered and all(x[0] != y[0] or x[2] < y[1] for x, y in zip(merged, merged[1:]))
    assert rows(I.covered_bases(left, right, "i"), "i", "covered") == sorted((i, sum((c, p) in covered for p in range(s, e))) for c, s, e, i in a)


def test_switches_flickers_tracts(spark):
    haps = spark.createDataFrame([("s", 1, "chr1", p, a) for p, a in ((100, 2), (200, 3), (300, None), (400, 2))] + [("s", 2, "chr1", p, 2) for p in (100, 200)] + [("s", 1, "chr2", 50, 4)], "sample string, hap int, chrom string, pos long, anc int")
    sw = C.switches(haps)
    assert rows(sw, "pos", "from_anc", "to_anc", "prev", "gap") == [(200, 2, 3, 100, 100), (400, 3, 2, 200, 200)]
    assert rows(C.mark_flickers(sw, 50_000), "pos", "flicker", "span") == [(200, True, 200), (400, True, 200)]
    tracts = rows(C.build_tracts(sw, haps, 0, 500), "chrom", "hap", "start", "end", "anc", "left_open", "right_open")
    assert tracts == [("chr1", 1, 0, 200, 2, True, False), ("chr1", 1, 200, 400, 3, False, False), ("chr1", 1, 400, 500, 2, False, True), ("chr1", 2, 0, 500, 2, True, True), ("chr2", 1, 0, 500, 4, True, True)]


@pytest.mark.parametrize(
    "ref, alts, svtype, svlen, end, pos, expected",
    [
        ("ACAG", ["A", "ACAGCAG"], None, None, None, 1, [0, -3, 3]),
        ("N", ["<DEL>"], "DEL", [-10], 1010, 1000, [0, -10]),
        ("N", ["<DEL>"], "DEL", None, 1010, 1000, [0, -10]),
        ("N", ["<DUP>"], None, [40], None, 1, [0, 40]),
        ("N", ["<INV>"], "INV", [500], None, 1, None),
        ("C", ["T"], None, None, None, 1, None),
        ("ACAG", ["A", "*"], None, None, None, 1, [0, -3, 0]),
    ],
)
def test_allele_bp(spark, ref, alts, svtype, svlen, end, pos, expected):
    df = spark.createDataFrame([(ref, alts, svtype, svlen, end, pos)], "ref string, alts array<string>, svtype string, svlen array<long>, `end` long, pos long")
    assert df.select(R.allele_bp("ref", "alts", "svtype", "svlen", "end", "pos").alias("x")).first().x == expected


def test_record_span_of_a_long_deletion(spark):
    df = spark.createDataFrame([(1000, "N", [0, -400], None)], "pos long, ref string, bp array<long>, `end` long")
    assert tuple(df.select(*R.record_span("pos", "ref", "bp", "end")).first()) == (999, 1399)


def test_rarefaction_by_enumeration(spark):
    counts = [3, 2, 1]
    alleles = spark.createDataFrame([("L", i, n) for i, n in enumerate(counts)] + [("M", 0, 6)], "locus string, dosage long, n long")
    pool = [i for i, n in enumerate(counts) for _ in range(n)]
    for n in (1, 2, 3, 5):
        exact = mean(len(set(c)) for c in itertools.combinations(pool, n))
        got = C.rarefaction(alleles.where("locus = 'L'"), (n,)).first()
        assert math.isclose(got["mean"], exact, rel_tol=1e-12)
        assert math.isclose(C.rarefaction(alleles.where("locus = 'M'"), (n,)).first()["mean"], 1.0)


def test_cauchy_combination(spark):
    df = spark.createDataFrame([(None, None, None), (0.0, 0.5, None), (1.0, 0.2, None), (0.5, 0.5, 0.5), (0.9, 1.0, 0.8), (1e-200, 0.5, 0.5)], "a double, b double, c double")
    got = [r[0] for r in df.select(S.cct("a", "b", "c")).collect()]
    assert got[0] is None and got[1] == 0 and math.isclose(got[2], 0.4) and math.isclose(got[3], 0.5) and got[4] == 1.0 and 0 < got[5] < 1e-198


def test_chi_square_tails_do_not_underflow():
    assert math.isclose(S.chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-12)
    assert math.isclose(S.chi2_tail(200.0, 2), math.exp(-100), rel_tol=1e-10)
    for df in (1, 2, 3, 5):
        for p in (0.9, 0.05, 1e-30):
            assert math.isclose(S.chi2_tail(S.chi2_quantile(p, df), df), p, rel_tol=1e-8)


def test_lambda_is_the_transform_of_the_median(spark):
    rng = np.random.default_rng(2)
    for n in (101, 100):
        p = rng.uniform(1e-6, 1, n)
        df = spark.createDataFrame([("x", float(v)) for v in p], "g string, p double")
        chi = np.array([S.chi2_quantile(float(v), 1) for v in p])
        assert math.isclose(S.lambda_gc(df, "p", ["g"]).first()["lambda"], float(np.median(chi) / S.CHI2_MEDIAN), rel_tol=1e-8)
    few = spark.createDataFrame([("x", 0.5)] * 9, "g string, p double")
    assert S.lambda_gc(few, "p", ["g"]).first()["lambda"] is None


def test_score_test_against_dense_algebra(spark):
    rng = np.random.default_rng(4)
    n, k = 50, 3
    g = rng.integers(0, 3, (n, k)).astype(float)
    r, w = rng.normal(size=n), rng.uniform(0.5, 1.5, n)
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    cov = np.linalg.inv(x.T @ (x * w[:, None]))
    dosage = spark.createDataFrame([("v", i, a, float(g[i, a])) for i in range(n) for a in range(k)] + [("u", i, 0, float(g[i, 0])) for i in range(n)], "variant string, sample long, anc int, ds double")
    null = spark.createDataFrame([(i, float(r[i]), float(w[i]), [float(v * w[i]) for v in x[i]]) for i in range(n)], "sample long, r double, w double, x array<double>")
    got = {t.variant: t for t in A.score_test(dosage, null, cov, k, 1.0).collect()}
    u = g.T @ r
    gx = g.T @ (x * w[:, None])
    v = g.T @ (g * w[:, None]) - gx @ cov @ gx.T
    chi = float(u @ np.linalg.solve(v, u))
    assert math.isclose(got["v"].chi2, chi, rel_tol=1e-9) and math.isclose(got["v"].p, S.chi2_tail(chi, 3), rel_tol=1e-9)
    assert np.allclose([got["v"][f"beta{i}"] for i in range(k)], np.linalg.solve(v, u))
    assert got["u"].included == "0" and got["u"].chi2 is None and math.isclose(got["u"].beta0, u[0] / v[0, 0], rel_tol=1e-9)


def test_locus_dosage_and_allele_table(spark):
    # rec, bp by haplotype, phased, sv
    records = [("L1", "S1", "r1", (3, 0), True, False), ("L1", "S1", "r2", (60, 0), True, True), ("L1", "S2", "r1", (None, 3), True, False), ("L1", "S2", "r2", (3, 3), False, False)]
    records += [("L2", "S1", "r3", (3, 0), False, False), ("L2", "S1", "r4", (3, 0), False, False), ("L2", "S2", "r3", (3, 0), False, False), ("L2", "S2", "r4", (3, 3), False, False)]
    flat = [(locus, s, h + 1, rec, bp[h], phased, sv) for locus, s, rec, bp, phased, sv in records for h in (0, 1)]
    got = C.locus_dosage(spark.createDataFrame(flat, "locus string, sample string, hap int, rec string, bp long, phased boolean, size_sv boolean"))
    # two unphased hets make the sample ambiguous on both haplotypes, even where they are alike; one does not
    assert rows(got.select("locus", "sample", "hap", F.coalesce("dosage", F.lit(-99)).alias("d"), "ambiguous", "duplicate"), "*") == [
        ("L1", "S1", 1, 63, False, True), ("L1", "S1", 2, 0, False, False), ("L1", "S2", 1, -99, False, False), ("L1", "S2", 2, 6, False, False),
        ("L2", "S1", 1, -99, True, False), ("L2", "S1", 2, -99, True, False), ("L2", "S2", 1, 6, False, False), ("L2", "S2", 2, 3, False, False),
    ]
    assert rows(C.allele_table(got).where("locus = 'L1'"), "dosage", "n_hap_allele", "n_hap", "n_hap_missing") == [(0, 1, 3, 1), (6, 1, 3, 1), (63, 1, 3, 1)]


def test_tiling_periods(spark):
    df = spark.createDataFrame([("CAGCAGCAG",), ("AAAA",), ("CAGT",), ("ACAC",), ("A",), ("",)], "s string")
    assert [r[0] for r in df.select(L.tiling_period("s")).collect()] == [3, 1, None, 2, None, None]


def test_spectrum_merges_sparse_bins(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 11, 25, 25, 25, 41)], "v int")
    assert L.bin_spectrum(df, "v", [0, 10, 20, 30, 40, 50], 3) == [(0, 10, 3), (10, 50, 5)]
    assert L.bin_spectrum(df, "v", [0, 10, 20, 30], 9) == [(0, 30, 7)] and L.bin_spectrum(df.limit(0), "v", [0, 10], 1) == []


def test_longest_pure_segment(spark):
    df = spark.createDataFrame([("TTCAGCAGCAGT",), ("AGCAGCA",), ("TTTT",), ("",)], "s string")
    assert [r[0] for r in df.select(R.lps_bp("s", "CAG")).collect()] == [9, 6, 0, 0]


def test_site_context(spark):
    sites = spark.createDataFrame([("del1", "chr1", 99, 200, "DEL"), ("ins1", "chr1", 499, 500, "INS"), ("dup1", "chr1", 999, 1200, "DUP"), ("big", "chr1", 10_000, 20_000, "DEL")], "id string, chrom string, start0 long, end0 long, svtype string")
    track = spark.createDataFrame([("rm", "chr1", 90, 250), ("rm", "chr1", 800, 950), ("sr", "chr1", 480, 520), ("sd", "chr1", 1100, 1300), ("sd", "chr1", 9000, 10_500), ("rm", "chr1", 10_400, 16_000)], "name string, chrom string, start0 long, end0 long")
    assert rows(C.context_label(sites, track), "id", "context") == [("big", "RM"), ("del1", "RM"), ("dup1", "SD"), ("ins1", "SR")]


def test_validated_join_refuses_double_keys(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="unique"):
        C.left_join_1to1(left, right, ["k"]).collect()
    assert rows(C.left_join_1to1(left, right.limit(1), ["k"]), "k") == [(1,), (2,)]


def test_generation_depth(spark):
    ped = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 1, 2), (4, 3, 0), (5, 4, 9)], "child long, father long, mother long")
    assert rows(C.generation_depth(ped), "child", "depth") == [(1, 0), (2, 0), (3, 1), (4, 2), (5, 3)]


def test_fisher(spark):
    df = spark.createDataFrame([(3, 1, 1, 3), (10, 0, 0, 10)], "a int, b int, c int, d int")
    got = [r[0] for r in df.select(S.fisher_two_sided("a", "b", "c", "d")).collect()]
    assert math.isclose(got[0], 0.4857142857142857, rel_tol=1e-9) and math.isclose(got[1], 2 / math.comb(20, 10), rel_tol=1e-9)


def test_vcf_and_typed_tables(spark, tmp_path):
    text = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\nchr1\t5\t.\tA\tC,G\t.\tPASS\tAC=1;DB;END=9\tGT:DP\t0|1:7\t./.\n"
    (tmp_path / "a.vcf").write_text(text)
    sites, calls = tables.read_vcf(spark, f"file://{tmp_path}/a.vcf")
    s = sites.first()
    assert (s.chrom, s.pos, s.id, s.alts, s.filter, s.info) == ("chr1", 5, None, ["C", "G"], "PASS", {"AC": "1", "DB": "", "END": "9"})
    assert rows(calls.select("sample", F.coalesce("a1", F.lit(-1)), F.coalesce("a2", F.lit(-1)), "phased", F.col("format")["DP"]), "*") == [("S1", 0, 1, True, "7"), ("S2", -1, -1, False, None)]
    (tmp_path / "t.tsv").write_text("id\tn\tx\tflag\na\t3.0\t.\tYes\nb\t\t2.5\tno\n")
    got = tables.read_typed(spark, f"file://{tmp_path}/t.tsv", {"id": "string", "n": "bigint", "x": "double", "flag": "boolean"})
    assert sorted(map(tuple, got.collect())) == [("a", 3, None, True), ("b", None, 2.5, False)]


def test_resumed_stage(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = f"file://{tmp_path}/stage"
    for params, runs in (({"a": 1}, 1), ({"a": 1}, 1), ({"a": 2}, 2)):
        assert tables.checkpointed(spark, path, params, make).count() == 3 and len(made) == runs


def test_split_by_sample_and_shards(spark, tmp_path):
    calls = spark.createDataFrame([("S1", "chr2", 5), ("S2", "chr10", 1), ("S1", "chr1", 9)], "sample string, chrom string, pos int")
    tables.write_by_sample(calls, f"file://{tmp_path}/by")
    assert spark.read.parquet(f"file://{tmp_path}/by/sample=S1").count() == 2
    assert [r.chrom for r in tables.concat_shards([calls, calls], 1).collect()] == ["chr1", "chr1", "chr2", "chr2", "chr10", "chr10"]
    with pytest.raises(ValueError):
        tables.concat_shards([calls, calls.drop("pos")])


def test_streaming_counts_equal_batch(spark, tmp_path):
    from strandlake.streaming.counters import site_counters

    calls = spark.createDataFrame([(i % 3, i % 2, (i + 1) % 2) for i in range(30)], "site long, a1 long, a2 long")
    calls.write.parquet(f"file://{tmp_path}/in")
    query = site_counters(spark.readStream.schema(calls.schema).parquet(f"file://{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("sites_seen").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("sites_seen"), "site", "ac", "an", "n_carriers") == rows(C.site_freq(calls), "site", "ac", "an", "n_carriers")


def test_ld_prune_is_the_pass_in_order(spark):
    import numpy as np

    from strandlake.operators import association as A

    rng = np.random.default_rng(5)
    sites = [("chr1" if i < 45 else "chr2", int(rng.integers(0, 3000)), i) for i in range(60)]
    base = rng.integers(0, 2, (6, 40, 2))
    g = np.array([np.where(rng.random((40, 2)) < 0.25, rng.integers(0, 2, (40, 2)), base[i % 6]) for i in range(60)])
    known = rng.random((60, 40)) < 0.8
    rows = [(c, p, i, k, *(map(int, g[i, k]) if known[i, k] else (None, None))) for c, p, i in sites for k in range(40)]
    calls = spark.createDataFrame(rows, "chrom string, pos long, site long, sample long, a1 int, a2 int")
    kept = []
    for c, p, i in sorted(sites):
        ok = True
        for c2, p2, j in kept:
            m = known[i] & known[j]
            if c == c2 and abs(p - p2) <= 700 and m.sum() >= 10:
                x, y = g[i, m].sum(1), g[j, m].sum(1)
                ok &= not (x.std() > 0 and y.std() > 0 and np.corrcoef(x, y)[0, 1] ** 2 > 0.1)
        if ok:
            kept.append((c, p, i))
    got = A.ld_prune(calls, 0.1, 700, 10).collect()
    assert len(got) == 60 and {r.site for r in got if r.kept} == {i for _, _, i in kept}
    assert len(kept) < 60


# --- models and matrices against dense algebra


def test_logistic_fits_by_group(spark):
    rng = np.random.default_rng(5)
    data = []
    for g, (a, b) in {"u": (0.3, 1.1), "v": (-1.0, -0.4)}.items():
        x = rng.normal(50, 20, 400)
        y = rng.random(400) < 1 / (1 + np.exp(-(a + b * (x - 50) / 20)))
        data += [(g, float(t), float(v)) for t, v in zip(y, x)]
    data += [("same", 1.0, float(i)) for i in range(9)]
    got = {r.g: r for r in D.logit_fits(spark.createDataFrame(data, "g string, y double, x double"), ["g"]).collect()}
    assert set(got) == {"u", "v"}
    for g in got:
        y, x = (np.array([r[i] for r in data if r[0] == g]) for i in (1, 2))
        m, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
        for _ in range(60):
            mu = 1 / (1 + np.exp(-m @ beta))
            h = m.T @ (m * (mu * (1 - mu))[:, None])
            beta = beta + np.linalg.solve(h, m.T @ (y - mu))
        assert np.allclose([got[g].b0, got[g].b1], beta) and math.isclose(got[g].se1, np.sqrt(np.linalg.inv(h)[1, 1]), rel_tol=1e-6)
        mu = 1 / (1 + np.exp(-m @ beta))
        assert math.isclose(got[g].ll, (y * np.log(mu) + (1 - y) * np.log(1 - mu)).sum(), rel_tol=1e-9)
    one = D.fit_null(spark.createDataFrame([(i, r[1], r[2], 1.0) for i, r in enumerate(data[:400])], "id long, y double, x double, c double"), "id", "y", ["x", "c"])
    r = {x.id: x.r for x in one[0].collect()}
    assert one[2] == ["x"] and abs(sum(r.values())) < 1e-6 and abs(sum(r[i] * data[i][2] for i in r)) < 1e-4


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    got = {r.p: r.q for r in D.benjamini_hochberg(spark.createDataFrame([("a", str(i), x) for i, x in enumerate(p)], "c string, t string, p double"), "p", ["c"], "t").collect()}
    assert np.allclose([got[x] for x in p], [0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_pca_and_relatedness(spark):
    rng = np.random.default_rng(6)
    group = rng.integers(0, 2, 40)
    f = rng.uniform(0.1, 0.9, (2, 120))
    g = rng.binomial(2, f[group])
    there = rng.random(g.shape) > 0.05
    calls = [(j, i, int(g[i, j] > 0), int(g[i, j] > 1)) if there[i, j] else (j, i, None, None) for i in range(40) for j in range(120)]
    df = spark.createDataFrame(calls, "site long, sample long, a1 long, a2 long")
    mean = np.where(there, g, 0).sum(0) / there.sum(0) / 2
    use = (mean > 0) & (mean < 1)
    z = np.where(there, (g - 2 * mean) / np.sqrt(2 * mean * (1 - mean)), 0)[:, use] / np.sqrt(use.sum())
    u, s, v = np.linalg.svd(z, full_matrices=False)
    scores, loadings, got = D.pca(df, 2, 12)
    assert math.isclose(got[0], s[0], rel_tol=1e-6)
    mine = np.array([r.pcs for r in scores.orderBy("sample").collect()])
    assert abs(np.corrcoef(mine[:, 0], u[:, 0])[0, 1]) > 0.9999 and math.isclose(np.abs(mine[:, 0]).sum(), np.abs(u[:, 0] * s[0]).sum(), rel_tol=1e-5)
    assert loadings.count() == use.sum() and max((r.loadings[0] for r in loadings.collect()), key=abs) > 0
    pairs = {(r["sample"], r["sample2"]): (r.n, r.k) for r in D.relatedness(df, -9.0, block=16, slab=50).collect()}
    assert len(pairs) == 40 * 39 // 2 + 40 and all(pairs[i, i] == (there[i, use].sum(), 1.0) for i in range(40))
    for i, j in ((0, 1), (3, 30), (17, 39)):
        both = there[i, use] & there[j, use]
        assert pairs[i, j][0] == both.sum() and math.isclose(pairs[i, j][1], (z[i] * z[j]).sum() * use.sum() / both.sum(), rel_tol=1e-9, abs_tol=1e-12)


def test_correlated_phenotypes_are_pruned_by_rank(spark):
    ranked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "code string, rank long")
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.95), ("a", "d", 0.5), ("c", "d", 0.8)], "a string, b string, r2 double")
    assert rows(D.prune_correlated(ranked, pairs, 0.7).select("code", F.coalesce("dropped_for", F.lit("-")).alias("d")), "*") == [("a", "-"), ("b", "a"), ("c", "-"), ("d", "c")]


def test_score_coherence_and_windows_of_alignments(spark):
    strata = spark.createDataFrame([("m", "anc1", 2.0, 0.0455, False), ("m", "anc2", 3.0, 1e-6, False), ("m", "anc3", 9.0, 0.5, True), ("n", "anc1", 1.0, 0.3, True)], "marker string, stratum string, z double, p double, spa boolean")
    got = {r.marker: r for r in D.score_p_coherence(strata, ["marker"]).collect()}
    assert (got["m"].worst_stratum, got["m"].n_spa, got["m"].n_plain) == ("anc2", 1, 2) and math.isclose(got["m"].max_log10_gap, abs(math.log10(1e-6 / 0.0026997960632601866)), rel_tol=1e-6)
    assert (got["n"].worst_stratum, got["n"].max_log10_gap, got["n"].n_spa) == (None, None, 1)
    ops = spark.createDataFrame([("c", 100, i, o, n) for i, (o, n) in enumerate([("S", 5), ("M", 10), ("I", 3), ("M", 10), ("D", 4), ("M", 6)])], "contig string, ref_start long, i long, op string, len long")
    windows = spark.createDataFrame([("c", 105, 115), ("c", 100, 130), ("c", 121, 123), ("c", 90, 110)], "contig string, start long, end long")
    assert rows(D.query_window(ops, windows), "start", "end", "query_start", "query_end") == [(100, 130, 5, 34), (105, 115, 10, 23)]


def test_labels_from_neighbours_and_centroids(spark):
    """Two tight clusters, a sample inside each without labels, one curated as other, one between them; blocks of any size give the same rows."""
    rng = np.random.default_rng(3)
    samples = [(i, [float(x) for x in rng.normal(0 if i % 2 else 50, 1, 2)], "eur" if i % 2 else "afr", "eur" if i % 2 else "afr", False) for i in range(40)]
    samples += [(100, [0.0, 0.0], None, None, False), (101, [50.0, 50.0], None, None, False), (102, [0.5, 0.0], "oth", "oth", False), (103, [0.5, 0.0], "oth", "oth", True), (104, None, None, None, False), (105, [25.0, 25.0], "oth", None, False)]
    df = spark.createDataFrame(samples, "id long, v array<double>, soft string, hard_label string, control boolean")
    got = {r.id: r for r in A.fill_labels(df, ["eur", "afr"], 2, 15, False).collect()}
    assert sorted(got) == [100, 101, 102, 105]
    assert [(got[i].method, got[i].after, got[i].soft_after, got[i].share) for i in (100, 101, 102)] == [("knn", "eur", "eur", 1.0), ("knn", "afr", "afr", 1.0), ("knn_hard", "eur", "oth", 1.0)]
    assert got[105].margin < 0.5 or got[105].confident
    v, label = np.array([s[1] for s in samples[:40]]), np.array([s[2] for s in samples[:40]])
    refs = df.where("id < 40").select("id", "v", F.col("soft").alias("label"))
    expected = sorted((i, int(j), label[j], r + 1) for i in range(40) for r, j in enumerate(sorted(range(40), key=lambda j: (float(((v[i] - v[j]) ** 2).sum()), j))[:5]))
    for block, chunk in ((7, 3), (1024, 4096)):
        assert rows(A.nearest(refs.select("id", "v"), refs, 5, block, chunk), "id", "ref", "label", "r") == expected


def test_mahalanobis_ranks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0, 0.1]])
    df = spark.createDataFrame([(i, "ab"[i % 2], *map(float, r)) for i, r in enumerate(x)] + [(90, "c", 1.0, 1.0, 1.0), (91, "a", None, 1.0, 1.0)], "i int, g string, x double, y double, z double")
    for group, members in ((None, [np.arange(60)]), ("g", [np.arange(0, 60, 2), np.arange(1, 60, 2)])):
        got = {r.i: r for r in A.mahalanobis(df.where("i <> 90") if group is None else df, "i", ["x", "y", "z"], group, 0.05).collect()}
        assert len(got) == 60
        for m in members:
            d = x[m] - x[m].mean(0)
            far = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(d, rowvar=False)), d))
            order = m[np.argsort(-far)]
            assert [got[i].rank for i in order] == list(range(1, len(m) + 1)) and [bool(got[i].far) for i in order] == [r < math.ceil(len(m) * 0.05) for r in range(len(m))]
            assert np.allclose([got[i].distance for i in m], far)
