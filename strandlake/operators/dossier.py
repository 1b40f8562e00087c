"""Review of association hits (flags, coherence, checks, context), models by sums, and genotype matrices in blocks."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import stats as S
from strandlake.operators import association as A
from strandlake.operators import genotypes
from strandlake.operators import intervals as I
from strandlake.sources.tables import stage

# --- review of hits


def flag_artifacts(assoc: DataFrame, p: str, threshold: float, variances: list[str], p_columns: list[str], af: str, spa: Column, least_ratio: float = 1e-3) -> DataFrame:
    """assoc with five flags, qc_flags (their names) and qc_n_flags; no row is dropped. Columns: beta, se; spa: where a correction was due and fell away.

    Flags of rows with p below the threshold: beta / se alone would not reach it; a stratum's variance is missing or far below the largest; the
    correction fell away. Of any row: a p of exactly 0; a negative frequency. What is unknown is no flag."""
    considered = F.coalesce(F.col(p) < threshold, F.lit(False))
    z2 = F.pow(F.try_divide("beta", "se"), 2)
    v = F.array(*variances)
    missing = F.size(F.filter(v, lambda x: x.isNull() | F.isnan(x)))
    ratio = F.try_divide(F.array_min(v), F.array_max(v))
    flags = {
        "effect_size_mismatch": considered & (z2 < S.chi2_quantile(threshold, 1)), "degenerate_covariance": considered & ((missing > 0) | (ratio < least_ratio)),
        "impossible_pvalue": F.exists(F.array(*p_columns), lambda x: x == 0), "negative_dosage_af": F.col(af) < 0, "spa_fallback": considered & spa,
    }
    out = assoc.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in flags.items()})
    names = F.array_compact(F.array(*(F.when(F.col(k), F.lit(k)) for k in flags)))
    return out.withColumns({"qc_flags": F.when(F.size(names) > 0, F.array_join(names, ",")).otherwise("."), "qc_n_flags": F.size(names).cast("bigint")})


def joint_coherence(hits: DataFrame, p_het: str, z: Column, k: int, most: float = 5.0) -> DataFrame:
    """hits with z2_sum, n_strata, implied_chi2 (of p_het with k degrees of freedom), ratio and coherent (null where either is unknown). z: array of the strata's z."""
    known = F.filter(z, lambda x: x.isNotNull() & ~F.isnan(x))
    inside = (F.col(p_het) > 0) & (F.col(p_het) < 1)
    # for two degrees of freedom the quantile has a closed form
    implied = F.when(inside, -2 * F.log(p_het) if k == 2 else S.chi2_isf(F.col(p_het), F.lit(k)))
    out = hits.withColumns({"n_strata": F.size(known).cast("bigint"), "z2_sum": F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x * x)), "implied_chi2": implied})
    out = out.withColumn("ratio", F.when(F.col("z2_sum") > 0, F.col("implied_chi2") / F.col("z2_sum")))
    return out.withColumn("coherent", F.col("ratio") <= most)


def score_p_coherence(strata: DataFrame, by: list[str]) -> DataFrame:
    """strata (by, stratum, z, p, spa): the widest gap in log10 between p and the normal tail of z over strata without correction, and how many there are of either."""
    good = strata.where(F.col("z").isNotNull() & (F.col("p") > 0)).withColumn("implied", F.greatest(S.chi2_sf(F.col("z") * F.col("z"), F.lit(1)), F.lit(1e-300)))
    plain = ~F.coalesce(F.col("spa"), F.lit(False))
    gap = F.when(plain, F.abs(F.log10(F.col("p") / F.col("implied"))))
    return good.withColumn("gap", gap).groupBy(*by).agg(F.max_by("stratum", F.struct("gap", "stratum")).alias("last"), F.max("gap").alias("max_log10_gap"), F.count_if(~plain).alias("n_spa"), F.count_if(plain).alias("n_plain")).select(*by, F.when(F.col("n_plain") > 0, F.col("last")).alias("worst_stratum"), "max_log10_gap", "n_spa", "n_plain")


def allelic_series(region: DataFrame, leads: DataFrame, orders: float = 3.0) -> DataFrame:
    """leads (locus, chrom, pos, marker, window) against region (chrom, pos, marker, p, delta): tests of one position, or with a window the tests
    inside it that change length; how many, the second best p, and how many but the lead come within so many orders of it."""
    spans = leads.select("locus", "chrom", F.col("marker").alias("lead"), F.col("pos").alias("at"), "window", (F.col("pos") - F.col("window")).alias("start0"), (F.col("pos") + F.col("window") + 1).alias("end0"))
    points = region.where(F.col("p") > 0).withColumns({"start0": F.col("pos"), "end0": F.col("pos") + 1})
    pairs = I.range_join(points, spans).where((F.col("window_r") == 0) | (F.coalesce("delta", F.lit(0)) != 0))
    w = W.partitionBy("locus_r").orderBy("p", "marker")
    ranked = pairs.withColumns({"r": F.row_number().over(w), "lead_p": F.max(F.when(F.col("marker") == F.col("lead_r"), F.col("p"))).over(W.partitionBy("locus_r"))})
    near = (F.col("marker") != F.col("lead_r")) & (F.log10("p") - F.log10("lead_p") <= orders)
    return ranked.groupBy(F.col("locus_r").alias("locus")).agg(F.count("*").alias("n_tests"), F.min(F.when(F.col("r") == 2, F.col("p"))).alias("second_p"), F.count_if(near).alias("n_within"))


def sweep(runs: DataFrame, threshold: float, passes: Column) -> DataFrame:
    """One row a run (phenotype, arm): tests, hits below the threshold, those that pass, and the best p, over all runs at once."""
    hit = F.coalesce(F.col("p") < threshold, F.lit(False))
    return runs.groupBy("phenotype", "arm").agg(F.count("*").alias("tests"), F.count_if(hit).alias("hits"), F.count_if(hit & passes).alias("retained"), F.min("p").alias("best"))


def is_structural(arm: str, change: str, in_repeat: str, least: int = 50) -> Column:
    return F.coalesce(F.abs(F.col(change)) >= least, F.lit(False)) | F.col(arm).isin("ru", "carrier") | F.coalesce(F.col(in_repeat), F.lit(False))


def locus_context(loci: DataFrame, duplications: DataFrame, repeats: DataFrame, genes: DataFrame) -> DataFrame:
    """loci (locus, chrom, start0, end0): share of bases in duplications, whether a repeat and a gene overlap, and the bases to the nearest gene (0 inside, null without)."""
    spans = loci.select("locus", "chrom", "start0", "end0")
    out = I.covered_bases(spans, duplications, "locus").withColumn("segdup", F.col("covered") / (F.col("end0") - F.col("start0"))).drop("covered")
    out = I.overlaps(I.overlaps(out, repeats, "locus", "in_repeat"), genes, "locus", "in_gene")
    before = I.previous_join(out.select("locus", "chrom", F.col("start0").alias("pos")), genes.select("chrom", F.col("end0").alias("pos"))).select("locus", (F.col("pos") - F.col("marker_pos")).alias("left"))
    after = I.covering_join(out.select("locus", "chrom", F.col("end0").alias("pos")), genes.select("chrom", F.col("start0").alias("pos"), F.lit(1).alias("one"))).select("locus", F.when(F.col("marker_pos") >= F.col("pos"), F.col("marker_pos") - F.col("pos")).alias("right"))
    near = out.join(before, "locus").join(after, "locus")
    return near.select("locus", "segdup", "in_repeat", "in_gene", F.when(F.col("in_gene"), 0).otherwise(F.least("left", "right")).cast("bigint").alias("gene_distance"))


def locus_checks(loci: DataFrame) -> DataFrame:
    """loci with checks array<struct<check, status>> and verdict. What is null is n/a, never a pass; verdict: fail, else warn, else incomplete, else pass.

    Columns: lam, het_frac, ctrl_f, ratio, n_strata, q_p, n_plain, n_spa, gap, call_gap, n_support, af, n_tests, n_within, segdup, in_repeat."""
    c = F.col
    status = lambda known, *cases: reduce_when(F.when(~F.coalesce(known, F.lit(False)), "n/a"), cases)
    checks = {
        "calibration": status(c("lam").isNotNull(), ("warn", (c("lam") < 0.9) | (c("lam") > 1.1))),
        "hardy_weinberg": status(c("ctrl_f").isNotNull(), ("fail", (c("het_frac") >= 0.9) | (c("ctrl_f") < -0.3)), ("warn", c("ctrl_f") > 0.3)),
        "joint_coherence": status(c("ratio").isNotNull(), ("fail", c("ratio") > 5)),
        "effect_consistency": status((c("n_strata") >= 2) & c("q_p").isNotNull(), ("warn", c("q_p") < 0.01)),
        "p_vs_score": status((c("n_plain") > 0) | (c("n_spa") > 0), ("warn", (c("n_plain") > 0) & (c("gap") > 1))),
        "call_rate": status(c("call_gap").isNotNull(), ("warn", c("call_gap") > 0.02)),
        "regional_support": status(c("n_support").isNotNull(), ("warn", (c("n_support") == 0) & (F.least(c("af"), 1 - c("af")) >= 0.05))),
        "allelic_series": status(c("n_tests") >= 2, ("warn", c("n_within") == 0)),
        "context": status(c("segdup").isNotNull(), ("warn", (c("segdup") > 0) | c("in_repeat"))),
    }
    listed = F.array(*(F.struct(F.lit(k).alias("check"), v.alias("status")) for k, v in checks.items()))
    some = lambda s: F.exists("checks", lambda x: x["status"] == s)
    return loci.withColumn("checks", listed).withColumn("verdict", F.when(some("fail"), "fail").when(some("warn"), "warn").when(some("n/a"), "incomplete").otherwise("pass"))


def review_loci(leads: DataFrame, assoc: DataFrame, strata: DataFrame, groups: DataFrame, calls: DataFrame, duplications: DataFrame, repeats: DataFrame, genes: DataFrame, k: int, reach: int = 100_000, flank: int = 500, orders: float = 3.0) -> DataFrame:
    """leads with every column that locus_checks needs, worked out from the tables, and its checks and verdict.

    leads: marker, phenotype, arm, chrom, pos, site, p, p_het (joint p of k strata), af, n_het, n_hom, n_ctrl (controls), tract (half width of the lead's
    repeat tract, 0 without); assoc: the runs' tests (phenotype, arm, chrom, pos, marker, p, delta: change of length); strata: marker, stratum, beta, se, z, p, spa of the
    leads; groups: sample, group (case or control); calls: the leads' sites before phasing; the rest: intervals."""
    from strandlake.operators.association import call_rate_by_group, effect_consistency, inbreeding, regional_support

    leads = stage(leads, "leads")
    own = strata.join(F.broadcast(leads.select("marker")), "marker")
    own = stage(own, "strata")
    lam = S.lambda_gc(assoc, "p", ["phenotype", "arm"]).select("phenotype", "arm", F.col("lambda").alias("lam"))
    z = own.where("z IS NOT NULL").groupBy("marker").agg(F.collect_list("z").alias("zs"))  # of k strata at most
    even = effect_consistency(own, ["marker"]).select("marker", (F.col("df") + 1).alias("n_strata"), S.chi2_sf("q", "df").alias("q_p"))
    score = score_p_coherence(own, ["marker"]).select("marker", "n_plain", "n_spa", F.col("max_log10_gap").alias("gap"))
    sites = leads.select("site").distinct()
    rates = call_rate_by_group(calls.join(F.broadcast(sites), "site"), groups).select("site", F.abs("call_rate_diff").alias("call_gap"))
    near = regional_support(assoc, leads.select(F.col("marker").alias("lead"), "chrom", "pos", "p"), reach, orders).select(F.col("lead").alias("marker"), F.col("support").alias("n_support"))
    series = allelic_series(assoc, leads.select(F.col("marker").alias("locus"), "chrom", "pos", "marker", F.col("tract").alias("window")), orders).select(F.col("locus").alias("marker"), "n_tests", "n_within")
    around = leads.select(F.col("marker").alias("locus"), "chrom", F.greatest(F.col("pos") - flank, F.lit(0)).alias("start0"), (F.col("pos") + flank).alias("end0"))
    context = locus_context(around, duplications, repeats, genes).select(F.col("locus").alias("marker"), "segdup", "in_repeat")
    wide = leads.join(lam, ["phenotype", "arm"], "left").join(rates, "site", "left")
    for part in (z, even, score, near, series, context):
        wide = wide.join(part, "marker", "left")
    wide = joint_coherence(wide.drop("n_strata"), "p_het", F.coalesce("zs", F.array().cast("array<double>")), k).drop("n_strata", "coherent").join(even.select("marker", "n_strata"), "marker", "left")
    wide = wide.withColumns({"het_frac": F.try_divide("n_het", "n_ctrl"), "ctrl_f": inbreeding("n_het", "n_hom", "n_ctrl")})
    return locus_checks(wide)


def reduce_when(start: Column, cases) -> Column:
    for name, condition in cases:
        start = start.when(F.coalesce(condition, F.lit(False)), name)
    return start.otherwise("pass")


def control_loci(assoc: DataFrame, named: DataFrame, threshold: float) -> DataFrame:
    """Rows in named intervals (window, chrom, start, end; ends included) by name and arm: tests, those below the threshold, best p."""
    return I.extract_windows(assoc, named).groupBy("window", "arm").agg(F.count("*").alias("n"), F.count_if(F.col("p") < threshold).alias("hits"), F.min("p").alias("best"))


def score_test_pooled(dosage: DataFrame, null: DataFrame, cov_inverse: np.ndarray, strata: int, ac_min: float = 0.0) -> DataFrame:
    """The tests of each stratum, the joint one (p_het, one degree of freedom a stratum), the pooled one on the sum over strata (p_hom), and their Cauchy combination."""
    split = A.score_test(dosage, null, cov_inverse, strata, ac_min).withColumnRenamed("p", "p_het").withColumnRenamed("chi2", "chi2_het")
    whole = dosage.groupBy("variant", "sample").agg(F.sum("ds").alias("ds")).withColumn("anc", F.lit(0).cast(dosage.schema["anc"].dataType))
    pooled = A.score_test(whole, null, cov_inverse, 1, ac_min).select("variant", F.col("beta0").alias("beta_hom"), F.col("se0").alias("se_hom"), F.col("p0").alias("p_hom"))
    return split.join(pooled, "variant", "left").withColumn("p_cct", S.cct("p_het", "p_hom"))


# --- models from sums


def logit_fits(rows: DataFrame, by: list[str], rounds: int = 25) -> DataFrame:
    """y ~ 1 + x of each group at once (y 0 or 1): b0, b1, se1, log likelihood with and without x, n. Newton steps on sums by group, so a group of
    any size is no single task; groups without both outcomes or without variation of x give nulls. x is centred and scaled first."""
    good = rows.where("y IS NOT NULL AND x IS NOT NULL").select(*by, F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    told = good.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.avg("y").alias("rate")).where("rate > 0 AND rate < 1 AND s > 0")
    coefs = stage(told.withColumns({"a": F.log(F.col("rate") / (1 - F.col("rate"))), "b": F.lit(0.0)}), "logit")
    scaled = good.join(coefs.select(*by, "m", "s"), by) if by else good.crossJoin(F.broadcast(coefs.select("m", "s")))
    scaled = stage(scaled.withColumn("x", (F.col("x") - F.col("m")) / F.col("s")).drop("m", "s"), "logit")
    with_coefs = lambda c: scaled.join(c, by) if by else scaled.crossJoin(F.broadcast(c))
    eta = F.col("a") + F.col("b") * F.col("x")
    mu = 1 / (1 + F.exp(-eta))
    sums = lambda c: with_coefs(c.select(*by, "a", "b")).withColumns({"mu": mu, "w": mu * (1 - mu), "eta": eta}).groupBy(*by).agg(F.sum(F.col("y") - F.col("mu")).alias("u0"), F.sum((F.col("y") - F.col("mu")) * F.col("x")).alias("u1"), F.sum("w").alias("h00"), F.sum(F.col("w") * F.col("x")).alias("h01"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("h11"), F.sum(F.col("y") * F.col("eta") - F.log1p(F.exp(-F.abs("eta"))) - F.greatest("eta", F.lit(0.0))).alias("ll"))
    det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
    for _ in range(rounds):
        s = sums(coefs)
        joined = coefs.join(s, by) if by else coefs.crossJoin(s)
        step_a, step_b = (F.col("h11") * F.col("u0") - F.col("h01") * F.col("u1")) / det, (F.col("h00") * F.col("u1") - F.col("h01") * F.col("u0")) / det
        bound = lambda c: F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.coalesce(c, F.lit(0.0))))
        coefs = stage(joined.withColumns({"da": bound(step_a), "db": bound(step_b)}).withColumns({"a": F.col("a") + F.col("da"), "b": F.col("b") + F.col("db"), "moved": F.greatest(F.abs("da"), F.abs("db"))}).select(*by, "n", "m", "s", "rate", "a", "b", "moved"), "logit")
        if (coefs.agg(F.max("moved")).first()[0] or 0.0) < 1e-9:
            break
    s = sums(coefs)
    out = coefs.join(s, by) if by else coefs.crossJoin(s)
    empty = F.col("n") * (F.col("rate") * F.log("rate") + (1 - F.col("rate")) * F.log(1 - F.col("rate")))
    return out.select(*by, "n", (F.col("a") - F.col("b") * F.col("m") / F.col("s")).alias("b0"), (F.col("b") / F.col("s")).alias("b1"), (F.sqrt(F.col("h00") / det) / F.col("s")).alias("se1"), "ll", empty.alias("ll0"))


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], tie: str) -> DataFrame:
    up = W.partitionBy(*by).orderBy(p, tie)
    m = F.count(p).over(W.partitionBy(*by))
    raw = df.withColumn("_raw", F.col(p) * m / F.row_number().over(up))
    return raw.withColumn("q", F.least(F.min("_raw").over(up.rowsBetween(0, W.unboundedFollowing)), F.lit(1.0))).drop("_raw")


def ols_r2(df: DataFrame, y: str, xs: list[str]) -> float:
    """R2 of y on xs and a constant over rows without nulls, from their covariances (one aggregate; only these reach the driver)."""
    names = [y, *xs]
    whole = df.select(*(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names))).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = whole.agg(*(F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    c = np.zeros((len(names), len(names)))
    for i, j in pairs:
        c[i, j] = c[j, i] = got[f"c{i}_{j}"] or 0.0
    return float(c[0, 1:] @ np.linalg.pinv(c[1:, 1:]) @ c[0, 1:] / c[0, 0]) if xs and c[0, 0] > 0 else 0.0


def r2_decomposition(df: DataFrame, y: str, steps: dict[str, list[str]]) -> DataFrame:
    """R2 with the columns of each step added in turn, and what the step gains."""
    rows, xs, last = [], [], 0.0
    for i, (name, more) in enumerate(steps.items()):
        xs = xs + more
        r2 = ols_r2(df, y, xs)
        rows.append((i, name, r2, r2 - last))
        last = r2
    return df.sparkSession.createDataFrame(rows, "step long, name string, r2 double, gain double")


def fit_null(df: DataFrame, key: str, y: str, xs: list[str], rounds: int = 25) -> tuple[DataFrame, np.ndarray, list[str]]:
    """Logistic null model of y on a constant and xs over rows with a y: (key, r: y - mu, w: mu (1 - mu), x: covariates times w), the inverse of X'WX, and the names kept.

    Constant covariates are left out; a missing covariate counts as its mean. Newton steps on sums of p x p numbers."""
    have = df.where(F.col(y).isNotNull())
    told = have.agg(*(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(xs)), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(xs))).first()
    kept = [c for i, c in enumerate(xs) if told[f"s{i}"]]
    mean = {c: told[f"m{i}"] for i, c in enumerate(xs)}
    x = F.array(F.lit(1.0), *(F.coalesce(F.col(c).cast("double"), F.lit(mean[c])) for c in kept))
    rows = stage(have.select(key, F.col(y).cast("double").alias("y"), x.alias("x")), "null")
    p, b = len(kept) + 1, np.zeros(len(kept) + 1)
    for _ in range(rounds):
        eta = sum((float(b[i]) * F.col("x")[i] for i in range(p)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-eta))
        seen = rows.withColumns({"mu": mu, "w": mu * (1 - mu)})
        got = seen.agg(*(F.sum((F.col("y") - F.col("mu")) * F.col("x")[i]).alias(f"u{i}") for i in range(p)), *(F.sum(F.col("w") * F.col("x")[i] * F.col("x")[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p))).first()
        h = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
        step = np.linalg.pinv(h) @ np.array([got[f"u{i}"] for i in range(p)], float)
        if float(np.abs(step).max()) < 1e-9:
            break
        b = b + step
    return seen.select(key, (F.col("y") - F.col("mu")).alias("r"), "w", F.transform("x", lambda v: v * F.col("w")).alias("x")), np.linalg.pinv(h), kept


# --- genotype matrices


def pca_filters(calls: DataFrame, sites: DataFrame, low: float = 0.01, call_rate: float = 0.98, absent: str = "missing") -> DataFrame:
    """calls at autosomal single-letter sites that pass (or have no filter), with a frequency in [low, 1 - low] and call rates of sites and samples; samples are judged before sites.

    Rates are over the rows that there are, or with absent="reference" over all sites and samples, a missing row being a call of 0."""
    called = F.col("a1").isNotNull() & F.col("a2").isNotNull()
    sparse = absent == "reference"
    n_sites = calls.select("site").distinct().count() if sparse else 0
    rate = lambda whole: 1 - F.count_if(~called) / F.lit(whole) if sparse else F.avg(called.cast("double"))
    good = stage(calls.groupBy("sample").agg(rate(n_sites).alias("rate")).where(F.col("rate") >= call_rate).select("sample"), "samples")
    snv = sites.where((F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("ref") != F.col("alt")) & (F.col("filter").isNull() | (F.col("filter") == "PASS")) & F.regexp_replace("chrom", "^chr", "").try_cast("int").isNotNull()).select("site")
    kept = calls.join(good, "sample", "left_semi").join(snv, "site", "left_semi")
    n = good.count() if sparse else 0
    known = F.lit(n) - F.count_if(~called) if sparse else F.count_if(called)
    told = kept.groupBy("site").agg(rate(n).alias("rate"), (F.sum(F.when(called, F.col("a1") + F.col("a2"))) / (2 * known)).alias("af"))
    return kept.join(told.where((F.col("rate") >= call_rate) & F.col("af").between(low, 1 - low)).select("site"), "site", "left_semi")


def relatedness(calls: DataFrame, least: float, block: int = 2048, slab: int = 256, absent: str = "missing") -> DataFrame:
    """sample, sample2, n, k of pairs that reach `least`, and of each sample with itself (see genotypes)."""
    return genotypes.relatedness(genotypes.pack(calls, absent), least, block, slab)


def relatedness_bands(pairs: DataFrame, close: float = 0.2, width: float = 0.025) -> DataFrame:
    """Pairs of two samples by band of relatedness, with how many are close."""
    return pairs.where("sample <> sample2").groupBy((F.floor(F.col("k") / width) * width).alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("k") >= close).alias("close"))


def pca(calls: DataFrame, k: int = 32, rounds: int = 3, seed: int = 1, absent: str = "missing") -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(scores: sample, pcs; loadings: site, loadings; singular values) of the standardised matrix (see genotypes)."""
    return genotypes.pca(genotypes.pack(calls, absent), k, rounds, seed)


def pca_by_label(calls: DataFrame, sites: DataFrame, labels: DataFrame, least: int, k: int = 32, r2: float = 0.1, window: int = 500_000, common: int = 10, absent: str = "missing", **filters) -> DataFrame:
    """label, sample, pcs, n_sites: filters, LD pruning and analysis anew for each label (few) with at least so many samples; chrom and pos come from sites.

    Where the filters leave a label nothing, it has no rows."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy("label").collect()
    place = sites.select("site", "chrom", "pos")
    out = None
    for row in sizes:
        mine = calls.drop("chrom", "pos").join(labels.where(F.col("label") == row.label).select("sample"), "sample", "left_semi")
        good = stage(pca_filters(mine, sites, absent=absent, **filters).join(place, "site"), "filtered")
        packed = genotypes.pack(good, absent)
        kept = stage(genotypes.ld_prune(packed, r2, window, common).where("kept").select("site"), "pruned")
        whole = replace(packed, sites=packed.sites.join(kept, "site", "left_semi"))
        got = genotypes.pca(whole, k)[0].withColumns({"label": F.lit(row.label), "n_sites": F.lit(kept.count())})
        out = got if out is None else out.unionByName(got)
    return out.select("label", "sample", "pcs", "n_sites") if out is not None else labels.select("label", "sample", F.array().cast("array<double>").alias("pcs"), F.lit(0).cast("long").alias("n_sites")).limit(0)


# --- phenotypes and alignments


def select_phenotypes(pheno: DataFrame, people: DataFrame, needs: Column, least: int) -> DataFrame:
    """code, cases, controls, smaller, rank of the codes to test: people of the needed sex only, at least so many in the smaller arm, and no code that
    has a longer code below it among these; ranked by smaller arm, cases, controls and name, all descending."""
    told = pheno.withColumn("needs", needs).join(people, "person").where("needs IS NULL OR sex = needs")
    n = told.groupBy("code").agg(F.count_if(F.col("value") == 1).alias("cases"), F.count_if(F.col("value") == 0).alias("controls")).withColumn("smaller", F.least("cases", "controls")).where(F.col("smaller") >= least)
    below = n.where(F.col("code").rlike(r"\.[0-9]$")).select(F.regexp_replace("code", r"\.[0-9]$", "").alias("up")).distinct()
    leaves = n.join(below, n["code"] == below["up"], "left_anti")
    return leaves.withColumn("rank", F.row_number().over(W.orderBy(F.desc("smaller"), F.desc("cases"), F.desc("controls"), F.desc("code"))).cast("bigint"))


def phenotype_r2(pheno: DataFrame, least: int = 50) -> DataFrame:
    """a, b, n, r2 of pairs of codes over the people with both (pairwise complete), at least so many; null without variation."""
    v = pheno.where("value IS NOT NULL").select("person", "code", F.col("value").cast("double").alias("x"))
    pairs = v.select("person", F.col("code").alias("a"), "x").join(v.select("person", F.col("code").alias("b"), F.col("x").alias("y")), "person").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.pow(F.corr("x", "y"), 2).alias("r2")).where(F.col("n") >= least)


def prune_correlated(ranked: DataFrame, pairs: DataFrame, most: float) -> DataFrame:
    """ranked (code, rank) with dropped_for, r2: the kept code of highest r2 (of these the first by rank), where that reaches `most`; codes are taken by rank.

    Pairs that reach it stream by in order of their later code; what the task remembers are the codes that are gone. Nothing reaches the driver."""
    at = lambda c: ranked.select(F.col("code").alias(c), F.col("rank").cast("long").alias(f"{c}_rank"))
    both = pairs.where(F.col("r2") >= most).select("a", "b", "r2").join(at("a"), "a").join(at("b"), "b")
    first = F.col("a_rank") < F.col("b_rank")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    links = both.select(pick("a", "b", "early"), pick("a_rank", "b_rank", "early_rank"), pick("b", "a", "code"), pick("b_rank", "a_rank", "late_rank"), "r2")

    def walk(batches):
        gone, code, best = set(), None, None
        for df in batches:
            out = []
            for early, early_rank, late, r2 in zip(df["early"], df["early_rank"], df["code"], df["r2"]):
                if late != code:
                    if best is not None:
                        gone.add(code)
                        out.append((code, best[2], best[0]))
                    code, best = late, None
                if early not in gone and (best is None or (r2, -early_rank) > best[:2]):
                    best = (r2, -early_rank, early)
            yield pd.DataFrame(out, columns=["code", "dropped_for", "r2"])
        if best is not None:
            yield pd.DataFrame([(code, best[2], best[0])], columns=["code", "dropped_for", "r2"])

    dropped = links.coalesce(1).sortWithinPartitions("late_rank", "code", "early_rank").mapInPandas(walk, "code string, dropped_for string, r2 double")
    return ranked.join(dropped, "code", "left")


def query_window(ops: DataFrame, windows: DataFrame) -> DataFrame:
    """ops (contig, ref_start, i, op, len: a contig's CIGAR) and windows (contig, start, end, half-open): the first and last query place (end exclusive)
    aligned inside the window; contigs that don't cover the whole window drop out."""
    on_ref, on_query = F.when(F.col("op").isin("M", "D", "=", "X"), F.col("len")).otherwise(0), F.when(F.col("op").isin("M", "I", "=", "X", "S"), F.col("len")).otherwise(0)
    past = W.partitionBy("contig").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    at = ops.withColumns({"r0": F.col("ref_start") + F.coalesce(F.sum(on_ref).over(past), F.lit(0)), "q0": F.coalesce(F.sum(on_query).over(past), F.lit(0)), "r": on_ref})
    both = at.where(F.col("op").isin("M", "=", "X")).join(windows, "contig").where((F.col("r0") < F.col("end")) & (F.col("start") < F.col("r0") + F.col("r")))
    first, last = F.greatest("r0", "start"), F.least(F.col("r0") + F.col("r"), F.col("end"))
    span = at.groupBy("contig").agg(F.min("r0").alias("low"), F.max(F.col("r0") + F.col("r")).alias("high"))
    got = both.groupBy("contig", "start", "end").agg(F.min(F.col("q0") + first - F.col("r0")).alias("query_start"), F.max(F.col("q0") + last - F.col("r0")).alias("query_end"))
    return got.join(span, "contig").where("low <= start AND high >= end").drop("low", "high")
