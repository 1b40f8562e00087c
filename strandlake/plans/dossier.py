"""Queries for hit review, models and genotype matrices (operators/dossier)."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from strandlake.operators import cohort as C
from strandlake.operators import dossier as D
from strandlake.operators import summaries as M
from strandlake.plans.loci import r6
from strandlake.plans import sqlmath as Q
from strandlake.plans.views import Plans
from strandlake.sources.tables import shared_dir

plans = Plans()
add = plans.add

flagged = lambda a: D.flag_artifacts(a.select("marker", "p", "p2", "spa", F.col("beta1").alias("beta"), F.col("se1").alias("se"), F.when(F.col("n_hom") % 5 != 0, F.col("se1")).alias("v1"), (F.col("se2") * F.when(F.col("n_hom") == 1, 1e-5).otherwise(1.0)).alias("v2"), (F.col("n_het") / 50.0 - 0.1).alias("af")), "p", 0.05, ["v1", "v2"], ["p", "p2"], "af", ~F.col("spa") & (F.abs("beta") > 0.3))
add(
    "g19_artifact_flags", "assoc", lambda a: flagged(a).select("marker", "qc_flags", "qc_n_flags"),
    """WITH f AS (SELECT marker, p < 0.05 AND pow(beta1 / se1, 2) < 3.841458820694124 AS a, p < 0.05 AND (n_hom % 5 = 0 OR least(se1, se2 * CASE WHEN n_hom = 1 THEN 1e-5 ELSE 1 END) / greatest(se1, se2 * CASE WHEN n_hom = 1 THEN 1e-5 ELSE 1 END) < 1e-3) AS b, p = 0 OR p2 = 0 AS c, n_het / 50.0e0 - 0.1e0 < 0 AS d, p < 0.05 AND NOT spa AND abs(beta1) > 0.3 AS e FROM {assoc})
       SELECT marker, coalesce(nullif(concat_ws(',', CASE WHEN a THEN 'effect_size_mismatch' END, CASE WHEN b THEN 'degenerate_covariance' END, CASE WHEN c THEN 'impossible_pvalue' END, CASE WHEN d THEN 'negative_dosage_af' END, CASE WHEN e THEN 'spa_fallback' END), ''), '.') AS qc_flags, CAST(a::INT + b::INT + c::INT + d::INT + e::INT AS BIGINT) AS qc_n_flags FROM f""",
)
add(
    "g22_sweep", "assoc", lambda a: r6(D.sweep(stored(a), 0.01, F.col("n_het") >= 10), "best"),
    "SELECT phenotype, arm, count(*) AS tests, count(*) FILTER (WHERE p < 0.01) AS hits, count(*) FILTER (WHERE p < 0.01 AND n_het >= 10) AS retained, round(min(p), 6) AS best FROM {assoc} GROUP BY 1, 2",
)


def stored(a):
    """The runs as one table partitioned by phenotype."""
    at = f"{shared_dir(a.sparkSession)}/stores/runs-{uuid.uuid4().hex}"
    a.select("phenotype", "arm", "p", "n_het").write.partitionBy("phenotype").parquet(at)
    return a.sparkSession.read.parquet(at)


add(
    "g23_joint_coherence", "assoc", lambda a: r6(D.joint_coherence(a, "p", F.array(F.col("beta1") / F.col("se1"), F.when(F.col("n_hom") > 0, F.col("beta2") / F.col("se2"))), 2), "z2_sum", "implied_chi2", "ratio").select("marker", "n_strata", "z2_sum", "implied_chi2", "coherent"),
    """WITH z AS (SELECT marker, p, CASE WHEN n_hom > 0 THEN 2 ELSE 1 END AS k, pow(beta1 / se1, 2) + CASE WHEN n_hom > 0 THEN pow(beta2 / se2, 2) ELSE 0 END AS z2 FROM {assoc})
       SELECT marker, CAST(k AS BIGINT) AS n_strata, round(z2, 6) AS z2_sum, round(-2 * ln(p), 6) AS implied_chi2, CASE WHEN z2 > 0 THEN -2 * ln(p) / z2 <= 5 END AS coherent FROM z""",
)
strata = lambda a: a.select("marker", F.explode(F.array(F.struct(F.lit("anc1").alias("stratum"), (F.col("beta1") / F.col("se1")).alias("z"), F.col("p").alias("p"), F.col("spa").alias("spa")), F.struct(F.lit("anc2").alias("stratum"), (F.col("beta2") / F.col("se2")).alias("z"), F.col("p2").alias("p"), F.lit(False).alias("spa")))).alias("s")).select("marker", "s.*")
add(
    "g24_score_coherence", "assoc", lambda a: r6(D.score_p_coherence(strata(a), ["marker"]), "max_log10_gap"),
    f"""WITH s AS (SELECT marker, 'anc1' AS stratum, beta1 / se1 AS z, p, spa FROM {{assoc}} UNION ALL SELECT marker, 'anc2', beta2 / se2, p2, FALSE FROM {{assoc}}), g AS (SELECT *, CASE WHEN NOT spa THEN abs(log10(p / greatest({Q.tail("z")}, 1e-300))) END AS gap FROM s)
       SELECT marker, CASE WHEN count(gap) > 0 THEN arg_max(stratum, struct_pack(g := gap, s := stratum)) FILTER (WHERE gap IS NOT NULL) END AS worst_stratum, round(max(gap), 6) AS max_log10_gap, count(*) FILTER (WHERE spa) AS n_spa, count(*) FILTER (WHERE NOT spa) AS n_plain FROM g GROUP BY 1""",
)
add(
    "e19_allelic_series", "assoc",
    lambda a: (lambda r: D.allelic_series(r, r.where("p < 0.002").select(F.col("marker").alias("locus"), "chrom", "pos", "marker", F.when(F.col("n_hom") > 4, 500).otherwise(0).alias("window"))).withColumn("second_p", F.round("second_p", 9)))(a.select("chrom", "pos", "marker", "p", "n_hom", (F.col("n_het") % 3).alias("delta"))),
    """WITH r AS (SELECT chrom, pos, marker, p, n_hom, n_het % 3 AS delta FROM {assoc}), l AS (SELECT marker AS locus, chrom, pos, p, CASE WHEN n_hom > 4 THEN 500 ELSE 0 END AS w FROM r WHERE p < 0.002),
       j AS (SELECT l.locus, r.marker, r.p, row_number() OVER (PARTITION BY l.locus ORDER BY r.p, r.marker) AS k, max(CASE WHEN r.marker = l.locus THEN r.p END) OVER (PARTITION BY l.locus) AS lead_p FROM l JOIN r ON r.chrom = l.chrom AND abs(r.pos - l.pos) <= w AND (w = 0 OR delta <> 0))
       SELECT locus, count(*) AS n_tests, round(min(CASE WHEN k = 2 THEN p END), 9) AS second_p, count(*) FILTER (WHERE marker <> locus AND log10(p) - log10(lead_p) <= 3) AS n_within FROM j GROUP BY 1""",
)
LOCI = "SELECT marker, CASE WHEN n_hom = 0 THEN NULL ELSE 0.85e0 + n_hom * 0.05e0 END AS lam, n_het / 52.0e0 AS het_frac, CASE WHEN n_hom = 1 THEN NULL ELSE beta1 END AS ctrl_f, CASE WHEN n_hom = 2 THEN NULL ELSE se1 * 30 END AS ratio, n_hom AS n_strata, p2 AS q_p, n_hom % 3 AS n_plain, n_hom % 2 AS n_spa, se2 * 5 AS gap, CASE WHEN n_hom = 3 THEN NULL ELSE se1 / 6 END AS call_gap, CASE WHEN n_hom = 4 THEN NULL ELSE n_het % 4 END AS n_support, p2 AS af, n_het % 5 AS n_tests, n_het % 2 AS n_within, CASE WHEN n_hom = 5 THEN NULL ELSE (n_het % 6) / 6.0e0 END AS segdup, n_het % 7 = 0 AS in_repeat FROM {assoc}"
add(
    "g29_locus_checks", "assoc", lambda a: D.locus_checks(a.sparkSession.sql(LOCI, assoc=a)).select("marker", F.array_join(F.transform("checks", lambda c: c["status"]), ",").alias("statuses"), "verdict"),
    f"""WITH l AS ({LOCI}), c AS (SELECT marker, [CASE WHEN lam IS NULL THEN 'n/a' WHEN lam < 0.9 OR lam > 1.1 THEN 'warn' ELSE 'pass' END, CASE WHEN ctrl_f IS NULL THEN 'n/a' WHEN het_frac >= 0.9 OR ctrl_f < -0.3 THEN 'fail' WHEN ctrl_f > 0.3 THEN 'warn' ELSE 'pass' END, CASE WHEN ratio IS NULL THEN 'n/a' WHEN ratio > 5 THEN 'fail' ELSE 'pass' END,
       CASE WHEN n_strata < 2 OR q_p IS NULL THEN 'n/a' WHEN q_p < 0.01 THEN 'warn' ELSE 'pass' END, CASE WHEN n_plain = 0 AND n_spa = 0 THEN 'n/a' WHEN n_plain > 0 AND gap > 1 THEN 'warn' ELSE 'pass' END, CASE WHEN call_gap IS NULL THEN 'n/a' WHEN call_gap > 0.02 THEN 'warn' ELSE 'pass' END, CASE WHEN n_support IS NULL THEN 'n/a' WHEN n_support = 0 AND least(af, 1 - af) >= 0.05 THEN 'warn' ELSE 'pass' END,
       CASE WHEN n_tests < 2 THEN 'n/a' WHEN n_within = 0 THEN 'warn' ELSE 'pass' END, CASE WHEN segdup IS NULL THEN 'n/a' WHEN segdup > 0 OR in_repeat THEN 'warn' ELSE 'pass' END] AS s FROM l)
       SELECT marker, array_to_string(s, ',') AS statuses, CASE WHEN list_contains(s, 'fail') THEN 'fail' WHEN list_contains(s, 'warn') THEN 'warn' WHEN list_contains(s, 'n/a') THEN 'incomplete' ELSE 'pass' END AS verdict FROM c""",
)
def reviewed(a, c, s, t):
    a = a.withColumns({"delta": F.col("n_het") % 3, "site": ((F.col("pos") - 1) / 37).cast("bigint")})
    leads = a.where("p < 3e-4").select("marker", "phenotype", "arm", "chrom", "pos", "site", "p", F.col("p").alias("p_het"), F.col("p2").alias("af"), "n_het", "n_hom", "n_ctrl", F.when(F.col("n_hom") > 4, 500).otherwise(0).alias("tract"))
    each = lambda i, p, spa: F.struct(F.lit(f"anc{i}").alias("stratum"), F.col(f"beta{i}").alias("beta"), F.col(f"se{i}").alias("se"), (F.col(f"beta{i}") / F.col(f"se{i}")).alias("z"), F.col(p).alias("p"), spa.alias("spa"))
    own = a.select("marker", F.inline(F.array(each(1, "p", F.col("spa")), each(2, "p2", F.lit(False)))))
    track = lambda n: t.where(F.col("name") == n)
    got = D.review_loci(leads, a, own, s.select("sample", F.when(F.col("control"), "control").otherwise("case").alias("group")), c, track("sd"), track("sr"), track("rm"), 2, 3000)
    return got.select("marker", F.array_join(F.transform("checks", lambda x: x["status"]), ",").alias("statuses"), "verdict")


add(
    "g29_review", "assoc calls samples track", reviewed,
    f"""WITH l AS (SELECT *, (pos - 1) // 37 AS site, CASE WHEN n_hom > 4 THEN 500 ELSE 0 END AS tract FROM {{assoc}} WHERE p < 3e-4), lam AS ({Q.lambdas("{assoc}", "phenotype, arm", "p")}),
       x AS (SELECT *, beta1 / se1 AS z1, beta2 / se2 AS z2, 1 / (se1 * se1) AS w1, 1 / (se2 * se2) AS w2, (2 * n_hom + n_het) / (2.0e0 * n_ctrl) AS q FROM l), y AS (SELECT *, (w1 * beta1 + w2 * beta2) / (w1 + w2) AS mean FROM x),
       z AS (SELECT *, w1 * pow(beta1 - mean, 2) + w2 * pow(beta2 - mean, 2) AS cochran, CASE WHEN 2 * n_hom + n_het > 0 THEN 1 - (n_het / CAST(n_ctrl AS DOUBLE)) / (2 * q * (1 - q)) END AS f, greatest(CASE WHEN NOT spa THEN abs(log10(p / greatest({Q.tail("z1")}, 1e-300))) END, abs(log10(p2 / greatest({Q.tail("z2")}, 1e-300)))) AS gap FROM y),
       g AS (SELECT site, control, avg(CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END) AS rate FROM {{calls}} JOIN {{samples}} USING (sample) GROUP BY 1, 2), r AS (SELECT site, abs(max(rate) FILTER (WHERE NOT control) - max(rate) FILTER (WHERE control)) AS call_gap FROM g GROUP BY 1),
       n AS (SELECT l.marker, count(*) AS n_support FROM l JOIN {{assoc}} a ON a.chrom = l.chrom AND abs(a.pos - l.pos) <= 3000 AND a.pos <> l.pos AND a.p <= greatest(l.p * 1000, 5e-8) GROUP BY 1),
       e AS (SELECT l.marker, count(*) AS n_tests, count(*) FILTER (WHERE a.marker <> l.marker AND log10(a.p) - log10(CASE WHEN l.tract = 0 OR l.n_het % 3 <> 0 THEN l.p END) <= 3) AS n_within FROM l JOIN {{assoc}} a ON a.chrom = l.chrom AND abs(a.pos - l.pos) <= l.tract AND (l.tract = 0 OR a.n_het % 3 <> 0) GROUP BY 1),
       c AS (SELECT l.marker, max(t.name = 'sd') AS dup, max(t.name = 'sr') AS rep FROM l LEFT JOIN {{track}} t ON t.chrom = l.chrom AND t.start0 < l.pos + 500 AND greatest(l.pos - 500, 0) < t.end0 GROUP BY 1),
       s AS (SELECT z.marker, [CASE WHEN lam IS NULL THEN 'n/a' WHEN lam < 0.9 OR lam > 1.1 THEN 'warn' ELSE 'pass' END, CASE WHEN f IS NULL THEN 'n/a' WHEN n_het / CAST(n_ctrl AS DOUBLE) >= 0.9 OR f < -0.3 THEN 'fail' WHEN f > 0.3 THEN 'warn' ELSE 'pass' END,
         CASE WHEN z1 * z1 + z2 * z2 > 0 THEN CASE WHEN -2 * ln(p) / (z1 * z1 + z2 * z2) > 5 THEN 'fail' ELSE 'pass' END ELSE 'n/a' END, CASE WHEN cochran > 6.6348966010212145 THEN 'warn' ELSE 'pass' END, CASE WHEN gap > 1 THEN 'warn' ELSE 'pass' END, CASE WHEN call_gap IS NULL THEN 'n/a' WHEN call_gap > 0.02 THEN 'warn' ELSE 'pass' END,
         CASE WHEN n_support IS NULL AND least(p2, 1 - p2) >= 0.05 THEN 'warn' ELSE 'pass' END, CASE WHEN coalesce(n_tests, 0) < 2 THEN 'n/a' WHEN n_within = 0 THEN 'warn' ELSE 'pass' END, CASE WHEN coalesce(dup, FALSE) OR coalesce(rep, FALSE) THEN 'warn' ELSE 'pass' END] AS s
         FROM z LEFT JOIN lam USING (phenotype, arm) LEFT JOIN r USING (site) LEFT JOIN n ON n.marker = z.marker LEFT JOIN e ON e.marker = z.marker LEFT JOIN c ON c.marker = z.marker)
       SELECT marker, array_to_string(s, ',') AS statuses, CASE WHEN list_contains(s, 'fail') THEN 'fail' WHEN list_contains(s, 'warn') THEN 'warn' WHEN list_contains(s, 'n/a') THEN 'incomplete' ELSE 'pass' END AS verdict FROM s""",
)
add(
    "g30_structural", "assoc", lambda a: a.select("marker", "arm", (F.col("n_het") * F.when(F.col("n_hom") % 2 == 0, -1).otherwise(1)).alias("change"), F.when(F.col("n_hom") > 0, F.col("n_hom") == 7).alias("in_repeat")).select("marker", D.is_structural("arm", "change", "in_repeat", 40).alias("structural")),
    "SELECT marker, n_het >= 40 OR arm IN ('ru', 'carrier') OR n_hom = 7 AS structural FROM {assoc}",
)
add(
    "g31_locus_context", "catalog track", lambda c, t: r6(D.locus_context(c, t.where("name = 'sd'"), t.where("name = 'sr'"), t.where("name = 'rm'")), "segdup"),
    """WITH p AS (SELECT DISTINCT c.locus, b FROM (SELECT locus, chrom, start0, end0, unnest(range(start0, end0)) AS b FROM {catalog}) c JOIN {track} t ON t.name = 'sd' AND t.chrom = c.chrom AND t.start0 <= b AND b < t.end0), n AS (SELECT locus, count(*) AS n FROM p GROUP BY 1),
       d AS (SELECT c.*, EXISTS (SELECT 1 FROM {track} t WHERE t.name = 'sr' AND t.chrom = c.chrom AND t.start0 < c.end0 AND c.start0 < t.end0) AS in_repeat, EXISTS (SELECT 1 FROM {track} t WHERE t.name = 'rm' AND t.chrom = c.chrom AND t.start0 < c.end0 AND c.start0 < t.end0) AS in_gene,
         start0 - (SELECT max(end0) FROM {track} t WHERE t.name = 'rm' AND t.chrom = c.chrom AND t.end0 <= c.start0) AS l, (SELECT min(start0) FROM {track} t WHERE t.name = 'rm' AND t.chrom = c.chrom AND t.start0 >= c.end0) - end0 AS r FROM {catalog} c)
       SELECT locus, round(CAST(coalesce(n, 0) AS DOUBLE) / (end0 - start0), 6) AS segdup, in_repeat, in_gene, CAST(CASE WHEN in_gene THEN 0 ELSE least(l, r) END AS BIGINT) AS gene_distance FROM d LEFT JOIN n USING (locus)""",
)
add(
    "g37_control_loci", "assoc supplier", lambda a, s: r6(D.control_loci(a.select("chrom", "pos", "arm", "p"), s.select(F.col("s_name").alias("window"), F.concat(F.lit("chr"), F.col("s_suppkey") % 22 + 1).alias("chrom"), (F.col("s_suppkey") * 31).alias("start"), (F.col("s_suppkey") * 31 + 4000).alias("end")), 0.01), "best"),
    "SELECT s_name AS \"window\", arm, count(*) AS n, count(*) FILTER (WHERE p < 0.01) AS hits, round(min(p), 6) AS best FROM {assoc} JOIN {supplier} ON chrom = 'chr' || CAST(s_suppkey % 22 + 1 AS VARCHAR) AND pos BETWEEN s_suppkey * 31 AND s_suppkey * 31 + 4000 GROUP BY 1, 2",
)
null = lambda s: s.select("sample", (F.col("balance") / 10_000).alias("r"), F.lit(1.0).alias("w"), F.array(F.lit(1.0), F.col("sex").cast("double")).alias("x"))
add("g2_score_test_pooled", "haps samples", lambda h, s: (lambda t: t.select("variant", *(F.round(c, 6).alias(c) for c in ("p_het", "p_hom", "beta_hom", "p_cct"))))(D.score_test_pooled(C.split_dosage(h, 3).select(F.col("site").alias("variant"), "sample", "anc", F.col("ds").cast("double").alias("ds")), null(s), np.diag([1e-3, 2e-3]), 3, 0.5)))

# --- models
add("g32_logit_fit", "samples", lambda s: r6(D.logit_fits(s.select("ancestry", F.col("sex").alias("y"), F.col("balance").alias("x")), ["ancestry"]), "ll", "ll0").select("ancestry", "n", F.round("b0", 4).alias("b0"), F.round("b1", 8).alias("b1"), F.round("se1", 8).alias("se1")))
add(
    "g32_ols_r2", "samples", lambda s: s.sparkSession.createDataFrame([(round(D.ols_r2(s, "balance", ["sex", "sample"]), 6),)], "r2 double"),
    "WITH c AS (SELECT corr(balance, sex) AS a, corr(balance, sample) AS b, corr(sex, sample) AS c FROM {samples}) SELECT round((a * a + b * b - 2 * a * b * c) / (1 - c * c), 6) AS r2 FROM c",
)
add("g33_null_model", "samples", lambda s: r6(D.fit_null(s.withColumn("one", F.lit(1.0)), "sample", "sex", ["balance", "one"])[0].select("sample", "r", "w"), "r", "w"))
add("g34_covariate_screen", "samples", lambda s: r6(M.covariate_screen(candidates(s), 5), "lrt", "delta_aic", "p", "q"))
add(
    "g35_r2_decomposition", "samples", lambda s: r6(D.r2_decomposition(s.withColumns({f"is_{a}": (F.col("ancestry") == a).cast("double") for a in ("afr", "amr")}), "balance", {"sex": ["sex"], "population": ["is_afr"]}), "r2", "gain"),
    """WITH c AS (SELECT corr(balance, sex) AS a, corr(balance, f) AS b, corr(sex, f) AS c FROM (SELECT balance, sex, CASE WHEN ancestry = 'afr' THEN 1 ELSE 0 END AS f FROM {samples})), r AS (SELECT a * a AS r1, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS r2 FROM c)
       SELECT CAST(0 AS BIGINT) AS step, 'sex' AS name, round(r1, 6) AS r2, round(r1, 6) AS gain FROM r UNION ALL SELECT 1, 'population', round(r2, 6), round(r2 - r1, 6) FROM r""",
)


def candidates(s):
    """Long rows (trait, candidate, y, x, base) of two traits and two candidates; the base are groups and a scaled balance."""
    pair = lambda name, c, as_: F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias(as_))
    base = F.array(*((F.col("ancestry") == a).cast("double") for a in ("afr", "amr", "eas", "eur")), F.col("balance") / 10_000)
    traits = s.withColumns({"odd": F.col("sample") % 7, "base": base}).select("odd", "sample", "base", F.explode(F.array(pair("sex", "sex", "y"), pair("control", "control", "y"))).alias("t"))
    both = traits.select("t", "base", F.explode(F.array(pair("odd", "odd", "x"), pair("sample", "sample", "x"))).alias("c"))
    return both.select(F.col("t.name").alias("trait"), F.col("c.name").alias("candidate"), "t.y", "c.x", "base")


# --- genotype matrices
# in these sites a one-letter REF is A and a one-letter ALT too, so for the matrices the letters are taken from the places
snps = lambda s: s.withColumns({"ref": F.substring("ref", 1, 1), "alt": F.when(F.col("site") % 5 == 0, "A").otherwise("G")})
#: A genotype without a row is 0, so rates are over all sites and samples that the panel has.
SNPS = """s AS (SELECT sample FROM {panel} GROUP BY 1 HAVING 1 - count(*) FILTER (WHERE a1 IS NULL OR a2 IS NULL) / CAST((SELECT count(DISTINCT site) FROM {panel}) AS DOUBLE) >= 0.98), v AS (SELECT site FROM {sites} WHERE site % 5 <> 0 AND filter = 'PASS'),
       k AS (SELECT * FROM {panel} WHERE sample IN (SELECT sample FROM s) AND site IN (SELECT site FROM v)), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM s),
       t AS (SELECT site FROM k, n GROUP BY site, n HAVING 1 - count(*) FILTER (WHERE a1 IS NULL OR a2 IS NULL) / n >= 0.98 AND sum(a1 + a2) / (2 * (n - count(*) FILTER (WHERE a1 IS NULL OR a2 IS NULL))) BETWEEN 0.01 AND 0.99)"""
add("h1_pca_filters", "panel sites", lambda c, s: D.pca_filters(c, snps(s), absent="reference").select("site", "sample"), f"WITH {SNPS} SELECT site, sample FROM k WHERE site IN (SELECT site FROM t)")
add("h3_pca", "panel", lambda c: D.pca(c, 32, absent="reference")[0].select("sample", F.transform("pcs", lambda x: F.round(x, 4)).alias("pcs")))
population = lambda c: c.select("sample", (F.col("sample") % 4).cast("string").alias("label")).distinct()
add("h4_pca_by_label", "panel sites", lambda c, s: D.pca_by_label(c, snps(s), population(c), 2, 32, window=20_000, absent="reference", call_rate=0.9).select("label", "sample", "n_sites", F.transform("pcs", lambda x: F.round(x, 4)).alias("pcs")))
GRM = """WITH who AS (SELECT DISTINCT sample FROM {panel}), spots AS (SELECT DISTINCT site FROM {panel}), d AS (SELECT site, sample, CASE WHEN p.site IS NULL THEN 0 ELSE p.a1 + p.a2 END AS g FROM (SELECT * FROM spots CROSS JOIN who) LEFT JOIN {panel} p USING (site, sample)),
       f AS (SELECT site, avg(g) / 2 AS p FROM d GROUP BY 1 HAVING avg(g) / 2 > 0 AND avg(g) / 2 < 1), z AS MATERIALIZED (SELECT site, sample, (g - 2 * p) / sqrt(2 * p * (1 - p)) AS z FROM d JOIN f USING (site) WHERE g IS NOT NULL),
       k AS MATERIALIZED (SELECT a.sample, b.sample AS sample2, count(*) AS n, CASE WHEN a.sample = b.sample THEN 1.0e0 ELSE avg(a.z * b.z) END AS k FROM z a JOIN z b ON a.site = b.site AND a.sample <= b.sample GROUP BY 1, 2 HAVING a.sample = b.sample OR avg(a.z * b.z) >= 0.05)"""
add("h5_relatedness", "panel", lambda c: r6(D.relatedness(c, 0.05, absent="reference"), "k"), f"{GRM} SELECT sample, sample2, n, round(k, 6) AS k FROM k")
add("h5_relatedness_bands", "panel", lambda c: r6(D.relatedness_bands(D.relatedness(c, 0.05, absent="reference")), "band"), f"{GRM} SELECT round(floor(k / 0.025e0) * 0.025e0, 6) AS band, count(*) AS n, count(*) FILTER (WHERE k >= 0.2) AS close FROM k WHERE sample <> sample2 GROUP BY 1")

# --- phenotypes and alignments
PHENO = "n AS (SELECT code, count(*) FILTER (WHERE value = 1) AS cases, count(*) FILTER (WHERE value = 0) AS controls FROM {pheno} JOIN {samples} ON sample = person WHERE code NOT LIKE '%01.1' OR sex = 1 GROUP BY 1 HAVING least(count(*) FILTER (WHERE value = 1), count(*) FILTER (WHERE value = 0)) >= 5), l AS (SELECT *, least(cases, controls) AS smaller FROM n WHERE code NOT IN (SELECT regexp_replace(code, '\\.[0-9]$', '') FROM n WHERE code LIKE '%.%'))"
chosen = lambda p, s: D.select_phenotypes(p, s.select(F.col("sample").alias("person"), "sex"), F.when(F.col("code").endswith("01.1"), 1), 5)
add("h8_select_phenotypes", "pheno samples", chosen, f"WITH {PHENO} SELECT *, row_number() OVER (ORDER BY smaller DESC, cases DESC, controls DESC, code DESC) AS rank FROM l")
add(
    "h9_prune_correlated", "pheno samples", lambda p, s: r6(D.prune_correlated(chosen(p, s).select("code", "rank"), D.phenotype_r2(p, 5), 0.0003), "r2"),
    # one code a step: it goes for the kept one of highest r2
    f"""WITH RECURSIVE {PHENO}, o AS MATERIALIZED (SELECT code, row_number() OVER (ORDER BY smaller DESC, cases DESC, controls DESC, code DESC) AS rank FROM l),
       v AS MATERIALIZED (SELECT a.code AS a, b.code AS b, pow(corr(CAST(a.value AS DOUBLE), CAST(b.value AS DOUBLE)), 2) AS r2 FROM {{pheno}} a JOIN {{pheno}} b ON a.person = b.person AND a.code <> b.code WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5),
       e AS MATERIALIZED (SELECT x.code AS early, x.rank AS er, y.rank AS lr, r2 FROM v JOIN o x ON x.code = v.a JOIN o y ON y.code = v.b WHERE x.rank < y.rank AND r2 >= 0.0003 AND NOT isnan(r2)),
       w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone, CAST(NULL AS STRUCT(r2 DOUBLE, er BIGINT, early VARCHAR)) AS best
         UNION ALL SELECT i, CASE WHEN best IS NULL THEN gone ELSE list_append(gone, i) END, best FROM (SELECT w.i + 1 AS i, w.gone, (SELECT max(struct_pack(r2 := e.r2, er := -e.er, early := e.early)) FROM e WHERE e.lr = w.i + 1 AND NOT list_contains(w.gone, e.er)) AS best FROM w WHERE w.i < (SELECT max(rank) FROM o)))
       SELECT o.code, o.rank, w.best.early AS dropped_for, round(w.best.r2, 6) AS r2 FROM o JOIN w ON w.i = o.rank""",
)
OPS = "o AS (SELECT l_orderkey AS contig, l_orderkey * 10 AS ref_start, l_linenumber * 100000000000000 + l_partkey * 10000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS i, CASE l_suppkey % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'D' ELSE 'M' END AS op, CAST(l_quantity AS BIGINT) AS len FROM {lineitem}), w AS (SELECT DISTINCT contig, ref_start + 10 AS s, ref_start + 50 AS e FROM o)"
ops = lambda l: l.select(F.col("l_orderkey").alias("contig"), (F.col("l_orderkey") * 10).alias("ref_start"), F.expr("l_linenumber * 100000000000000L + l_partkey * 10000000L + l_suppkey * 100L + CAST(l_quantity AS BIGINT)").alias("i"), F.when(F.col("l_suppkey") % 4 == 0, "I").when(F.col("l_suppkey") % 4 == 1, "D").otherwise("M").alias("op"), F.col("l_quantity").cast("bigint").alias("len"))
add(
    "h12_query_window", "lineitem", lambda l: D.query_window(ops(l), ops(l).select("contig", (F.col("ref_start") + 10).alias("start"), (F.col("ref_start") + 50).alias("end")).distinct()),
    f"""WITH {OPS}, a AS (SELECT *, CASE WHEN op IN ('M', 'D') THEN len ELSE 0 END AS r, CASE WHEN op IN ('M', 'I') THEN len ELSE 0 END AS q FROM o), b AS (SELECT contig, op, r, ref_start + coalesce(sum(r) OVER x, 0) AS r0, coalesce(sum(q) OVER x, 0) AS q0 FROM a WINDOW x AS (PARTITION BY contig ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
       p AS (SELECT contig, min(r0) AS low, max(r0 + r) AS high FROM b GROUP BY 1) SELECT contig, s AS start, e AS "end", CAST(min(q0 + greatest(r0, s) - r0) AS BIGINT) AS query_start, CAST(max(q0 + least(r0 + r, e) - r0) AS BIGINT) AS query_end FROM b JOIN w USING (contig) JOIN p USING (contig) WHERE op = 'M' AND r0 < e AND s < r0 + r AND low <= s AND high >= e GROUP BY 1, 2, 3""",
)
