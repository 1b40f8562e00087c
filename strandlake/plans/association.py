"""Queries for statistics on association results (G), their loci (E) and genotype matrices (H)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import stats as S
from strandlake.operators import association as A
from strandlake.operators import cohort as C
from strandlake.operators import intervals as I
from strandlake.plans import sqlmath as Q
from strandlake.plans.views import Plans

plans = Plans()
add = plans.add
CUT = 2e-3


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})



def hits(a):
    return a.where(F.col("p") < CUT)


add(
    "g3_cct", "assoc", lambda a: a.select("marker", F.round(S.cct("p", "p2", "p3"), 6).alias("p")),
    """SELECT marker, round(0.5e0 - atan((tan((0.5e0 - p) * pi()) + tan((0.5e0 - p2) * pi()) + CASE WHEN p3 IS NULL THEN 0 WHEN p3 < 1e-16 THEN 0 ELSE tan((0.5e0 - p3) * pi()) END) / CASE WHEN p3 IS NULL THEN 2 ELSE 3 END) / pi(), 6) * CASE WHEN p3 <= 0 THEN 0 ELSE 1 END AS p FROM {assoc}""",
)
add("g4_chi2", "assoc", lambda a: a.select("marker", F.round(S.chi2_sf(S.chi2_isf(F.col("p"), F.lit(3)), F.lit(3)), 9).alias("back"), (F.abs(S.chi2_sf(S.chi2_isf(F.col("p"), F.lit(1)), F.lit(1)) - F.col("p")) < 1e-9).alias("same")), "SELECT marker, round(p, 9) AS back, true AS same FROM {assoc}")
add("g5_lambda_gc", "assoc", lambda a: S.lambda_gc(a, "p", ["phenotype", "arm"]).select("phenotype", "arm", "n", F.round("lambda", 6).alias("lambda")), f"SELECT phenotype, arm, n, round(lam, 6) AS \"lambda\" FROM ({Q.lambdas('{assoc}', 'phenotype, arm', 'p')})")
add(
    "g6_qq_points", "assoc", lambda a: S.qq_points(a, "p", ["phenotype"], 1e-2, 500).select("phenotype", "rank", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected")),
    """WITH r AS (SELECT phenotype, p, row_number() OVER (PARTITION BY phenotype ORDER BY p) AS rank, count(*) OVER (PARTITION BY phenotype) AS n FROM {assoc})
       SELECT phenotype, rank, round(-log10(p), 6) AS observed, round(-log10((rank - 0.5e0) / n), 6) AS expected FROM r WHERE p < 0.01 OR rank % greatest(CAST(floor(n / 500.0e0) AS BIGINT), 1) = 0""",
)
add(
    "g7_run_summary", "assoc pheno", lambda a, p: r6(A.run_summary(a, ["phenotype"], "p", ["p2", "p3"], CUT, 3), "best", "lambda_all", "lambda_pass", "lambda_p2", "lambda_p3"),
    f"""WITH k AS (SELECT * FROM {{assoc}} WHERE include), n AS (SELECT phenotype, count(*) AS n, count(*) FILTER (WHERE include) AS n_pass, count(p) AS n_tested, count(*) FILTER (WHERE include AND p < {CUT}) AS n_hits, round(min(p), 6) AS best FROM {{assoc}} GROUP BY 1),
       t AS (SELECT phenotype, string_agg(marker, ',' ORDER BY p, marker) AS top FROM (SELECT phenotype, marker, p FROM k QUALIFY row_number() OVER (PARTITION BY phenotype ORDER BY p, marker) <= 3) GROUP BY 1)
       SELECT n.*, t.top, round(a.lam, 6) AS lambda_all, round(b.lam, 6) AS lambda_pass, round(c.lam, 6) AS lambda_p2, round(d.lam, 6) AS lambda_p3 FROM n LEFT JOIN t USING (phenotype) LEFT JOIN ({Q.lambdas('{assoc}', 'phenotype', 'p')}) a USING (phenotype)
         LEFT JOIN ({Q.lambdas('k', 'phenotype', 'p')}) b USING (phenotype) LEFT JOIN ({Q.lambdas('k', 'phenotype', 'p2')}) c USING (phenotype) LEFT JOIN ({Q.lambdas('k', 'phenotype', 'p3')}) d USING (phenotype)""",
)
add(
    "g9_calibration", "assoc", lambda a: A.calibration_models(S.lambda_gc(a, "p", ["phenotype", "arm"]), "main", 0.3),
    f"""WITH l AS ({Q.lambdas('{assoc}', 'phenotype, arm', 'p')}), m AS (SELECT phenotype, n AS base_n, lam AS base FROM l WHERE arm = 'main')
       SELECT l.phenotype, l.arm, round(l.lam, 6) AS "lambda", round(l.lam - base, 6) AS gain, CASE WHEN abs(l.n - base_n) > 0.3e0 * base_n THEN 'tests_differ' END AS not_comparable FROM l LEFT JOIN m USING (phenotype)""",
)
add(
    "g10_compare_runs", "assoc", lambda a: A.compare_runs(a.where("n_ctrl % 7 <> 0"), a.where("n_ctrl % 5 <> 0").withColumn("p", F.when(F.col("n_ctrl") == 511, F.col("p") + 0.1).otherwise(F.col("p"))), ["marker"], ["p", "p2"], 5),
    """SELECT count(*) FILTER (WHERE n_ctrl % 5 = 0 AND n_ctrl % 7 <> 0) AS only_a, count(*) FILTER (WHERE n_ctrl % 7 = 0 AND n_ctrl % 5 <> 0) AS only_b, count(*) FILTER (WHERE n_ctrl = 511 AND n_ctrl % 7 <> 0) AS p_differs, CAST(0 AS BIGINT) AS p2_differs FROM {assoc}""",
)
CLUSTERS = f"""h AS (SELECT * FROM {{assoc}} WHERE p < {CUT}), l AS (SELECT *, lag(pos) OVER (PARTITION BY KEYS ORDER BY pos) AS prev FROM h), g AS (SELECT *, sum(CASE WHEN prev IS NULL OR pos - prev > WINDOW_ THEN 1 ELSE 0 END) OVER (PARTITION BY KEYS ORDER BY pos RANGE UNBOUNDED PRECEDING) AS k FROM l),
       c AS (SELECT *, min(pos) OVER (PARTITION BY KEYS, k) AS cluster FROM g)"""


def clusters(keys: str, window: int) -> str:
    return CLUSTERS.replace("KEYS", keys).replace("WINDOW_", str(window))


add("e9_cluster_positions", "assoc", lambda a: I.cluster_positions(hits(a).select("chrom", "pos", "marker"), 1500), f"WITH {clusters('chrom', 1500)} SELECT chrom, pos, marker, cluster FROM c")
add(
    "e10_dossier_loci", "assoc", lambda a: A.dossier_loci(hits(a), 2000, 250).withColumn("p", F.round("p", 9)),
    f"""WITH {clusters('phenotype, chrom', 2000)} SELECT phenotype, chrom, cluster, count(*) AS n, arg_min(marker, struct_pack(p := p, m := marker)) AS lead, round(min(p), 9) AS p, arg_min(pos, struct_pack(p := p, m := marker)) AS pos, string_agg(DISTINCT arm, ',' ORDER BY arm) AS arms,
       greatest(arg_min(pos, struct_pack(p := p, m := marker)) - 250, 0) AS low, arg_min(pos, struct_pack(p := p, m := marker)) + 250 AS high FROM c GROUP BY 1, 2, 3""",
)
add(
    "e11_region_plan", "assoc", lambda a: I.merge_intervals(hits(a).select("phenotype", "chrom", F.greatest(F.col("pos") - 900, F.lit(0)).alias("start0"), (F.col("pos") + 900).alias("end0")), ("phenotype", "chrom")),
    f"WITH {clusters('phenotype, chrom', 1800)} SELECT phenotype, chrom, greatest(min(pos) - 900, 0) AS start0, max(pos) + 900 AS end0 FROM c GROUP BY phenotype, chrom, cluster",
)
add(
    "e12_recurrence", "assoc", lambda a: A.recurrence(hits(a).withColumn("verdict", F.when(F.col("n_hom") < 3, "excluded").otherwise("kept")), 1500, 2).withColumn("best", F.round("best", 9)),
    f"WITH {clusters('chrom', 1500)} SELECT chrom, cluster, count(DISTINCT phenotype) AS phenotypes, count(*) AS n, string_agg(DISTINCT arm, ',' ORDER BY arm) AS arms, string_agg(DISTINCT phenotype, ',' ORDER BY phenotype) AS names, count(*) FILTER (WHERE n_hom >= 3) AS kept, count(*) FILTER (WHERE n_hom < 3) AS excluded, round(min(p), 9) AS best FROM c GROUP BY 1, 2 HAVING count(DISTINCT phenotype) >= 2",
)
add(
    "e13_corroborated", "assoc", lambda a: A.corroborated(a.where(F.col("p") < 0.05), 100_000),
    f"WITH {clusters('phenotype, chrom', 100_000).replace(f'p < {CUT}', 'p < 0.05')} SELECT phenotype, chrom, cluster, count(DISTINCT arm) AS arms, count(*) AS n FROM c GROUP BY 1, 2, 3 HAVING count(DISTINCT arm) >= 2",
)
add(
    "g11_phewas_matrix", "assoc", lambda a: A.phewas_matrix(hits(a), 1500).withColumn("strength", F.round("strength", 6)),
    f"WITH {clusters('chrom', 1500)} SELECT phenotype, chrom || ':' || CAST(cluster AS STRING) AS locus, round(max(-log10(p)), 6) AS strength FROM c GROUP BY 1, 2",
)


def far_sql(by: str) -> str:
    """Distance, rank and the far tenth of two components, for all rows or by label."""
    return f"""WITH e AS (SELECT vec_id, {by} AS label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM {{embeddings}}), m AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM e GROUP BY 1 HAVING count(*) >= 2),
       d AS (SELECT vec_id, label, n, sqrt((b * (x - mx) * (x - mx) - 2 * c * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * b - c * c)) AS distance FROM e JOIN m USING (label))
       SELECT vec_id, {"label, " if by == "label" else ""}round(distance, 5) AS distance, rank() OVER (PARTITION BY label ORDER BY distance DESC) AS rank, row_number() OVER (PARTITION BY label ORDER BY distance DESC, vec_id) <= greatest(ceil(n * 0.1), 1) AS far FROM d"""


def two_components(e):
    return e.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(2)))


add("e14_mahalanobis", "embeddings", lambda e: A.mahalanobis(two_components(e), "vec_id", ["c0", "c1"], "label", 0.1).withColumn("distance", F.round("distance", 5)), far_sql("label"))
add("e14_mahalanobis_global", "embeddings", lambda e: A.mahalanobis(two_components(e), "vec_id", ["c0", "c1"], None, 0.1).withColumn("distance", F.round("distance", 5)), far_sql("1"))
add(
    "e15_top_overlap", "assoc", lambda a: A.top_overlap(a.withColumn("gene", F.col("pos") % 211), "phenotype", "gene", "p", 40).withColumn("jaccard", F.round("jaccard", 6)),
    """WITH b AS (SELECT phenotype, pos % 211 AS gene, min(p) AS p FROM {assoc} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY phenotype ORDER BY p, gene) AS r FROM b), t AS (SELECT * FROM r WHERE r <= 40), n AS (SELECT phenotype, count(*) AS n FROM t GROUP BY 1)
       SELECT x.phenotype AS a, y.phenotype AS b, (SELECT count(*) FROM t JOIN t u USING (gene) WHERE t.phenotype = x.phenotype AND u.phenotype = y.phenotype) AS shared,
       round((SELECT count(*) FROM t JOIN t u USING (gene) WHERE t.phenotype = x.phenotype AND u.phenotype = y.phenotype) / CAST(x.n + y.n - (SELECT count(*) FROM t JOIN t u USING (gene) WHERE t.phenotype = x.phenotype AND u.phenotype = y.phenotype) AS DOUBLE), 6) AS jaccard FROM n x JOIN n y ON x.phenotype < y.phenotype""",
)
add(
    "e16_best_p", "assoc", lambda a: A.best_p(a, ["phenotype", "arm"], "p", F.col("include") & (F.col("n_het") > 49)).withColumn("p", F.round("p", 9)),
    "SELECT phenotype, arm, round(coalesce(min(p) FILTER (WHERE include AND n_het > 49), max(p)), 9) AS p, arg_min(marker, struct_pack(p := p, m := marker)) FILTER (WHERE include AND n_het > 49) AS marker, count(*) FILTER (WHERE include AND n_het > 49) = 0 AS censored FROM {assoc} GROUP BY 1, 2",
)
add(
    "e18_regional_support", "assoc",
    lambda a: A.regional_support(a, a.where("p < 1e-4").select(F.col("marker").alias("lead"), "chrom", "pos", "p"), 3000, 1.0).withColumn("best_p", F.round("best_p", 9)),
    """WITH l AS (SELECT marker AS m, chrom, pos, p FROM {assoc} WHERE p < 1e-4), n AS (SELECT l.m, l.pos AS lead_pos, a.pos, a.p, a.p <= greatest(l.p * 10, 5e-8) AS good FROM l JOIN {assoc} a ON a.chrom = l.chrom AND a.pos BETWEEN l.pos - 3000 AND l.pos + 3000 AND a.pos <> l.pos)
       SELECT m AS "lead", count(n.pos) AS neighbours, count(*) FILTER (WHERE good) AS support, count(*) FILTER (WHERE n.p < 5e-8) AS significant, min(abs(n.pos - lead_pos)) FILTER (WHERE good) AS nearest, round(min(n.p) FILTER (WHERE good), 9) AS best_p, arg_min(abs(n.pos - lead_pos), struct_pack(p := n.p, d := abs(n.pos - lead_pos))) FILTER (WHERE good) AS best_bp FROM l LEFT JOIN n USING (m) GROUP BY 1""",
)
add("f2_top_hits", "assoc", lambda a: a.where("include").orderBy("p", "marker").limit(50).select("marker", F.round("p", 9).alias("p")), "SELECT marker, round(p, 9) AS p FROM {assoc} WHERE include ORDER BY {assoc}.p, marker LIMIT 50")
FIVE = [("pooled_carrier", "la_carrier"), ("pooled_ru", "la_ru"), ("pooled_carrier", "pooled_ru"), ("la_carrier", "la_ru"), ("pooled_carrier", "la_ru")]
# the pooled test is p, the local-ancestry one the smaller of the ancestries' p2 and p3
contrasted = lambda a: a.where("arm <> 'main'").groupBy("chrom", "pos").agg(*(F.min(F.when(F.col("arm") == k, F.col("p"))).alias(f"pooled_{k}") for k in ("ru", "carrier")), *(F.min(F.when(F.col("arm") == k, F.least("p2", "p3"))).alias(f"la_{k}") for k in ("ru", "carrier")), *(F.max(F.when(F.col("arm") == k, 1)).alias(f"in_{k}") for k in ("ru", "carrier"))).where("in_ru = 1 AND in_carrier = 1")
add(
    "g13_arm_contrasts", "assoc", lambda a: A.arm_contrasts(contrasted(a), FIVE, 0.3),
    """WITH w AS (SELECT min(p) FILTER (WHERE arm = 'ru') AS pooled_ru, min(p) FILTER (WHERE arm = 'carrier') AS pooled_carrier, min(least(p2, p3)) FILTER (WHERE arm = 'ru') AS la_ru, min(least(p2, p3)) FILTER (WHERE arm = 'carrier') AS la_carrier FROM {assoc} GROUP BY chrom, pos HAVING count(*) FILTER (WHERE arm = 'ru') > 0 AND count(*) FILTER (WHERE arm = 'carrier') > 0)
       """ + " UNION ALL ".join(f"SELECT '{a}->{b}' AS contrast, count(*) FILTER (WHERE NOT coalesce({a} < 0.3, FALSE) AND coalesce({b} < 0.3, FALSE)) AS gained, count(*) FILTER (WHERE coalesce({a} < 0.3, FALSE) AND NOT coalesce({b} < 0.3, FALSE)) AS lost, count(*) FILTER (WHERE {a} < 0.3 AND {b} < 0.3) AS both, count(*) FILTER (WHERE NOT coalesce({a} < 0.3, FALSE) AND NOT coalesce({b} < 0.3, FALSE)) AS neither FROM w" for a, b in FIVE),
)
STRATA = [{"spa": "spa", "t": "beta1", "var": "se1"}, {"tc": "beta2", "var_c": "se2", "t": "beta1", "p": "p", "pc": "p2"}]
add(
    "g14_spa_fallback", "assoc", lambda a: a.groupBy("arm", A.spa_fallback(STRATA, 0.8, 1.0).alias("flag")).agg(F.count("*").alias("n")),
    "SELECT arm, coalesce(NOT spa AND abs(beta1) / sqrt(se1) > 0.8, false) OR coalesce(abs(beta2) / sqrt(se2) > 0.8 AND beta2 <> beta1 AND log10(p) - log10(p2) > 1, false) AS flag, count(*) AS n FROM {assoc} GROUP BY 1, 2",
)
add(
    "g16_excess_het", "assoc", lambda a: a.select("marker", A.case_carriers().cast("bigint").alias("carriers"), F.round(A.inbreeding("n_het", "n_hom", "n_ctrl"), 6).alias("f")),
    "SELECT marker, n_het + n_hom AS carriers, round(CASE WHEN 2 * n_hom + n_het > 0 THEN 1 - (n_het / CAST(n_ctrl AS DOUBLE)) / (2 * ((2 * n_hom + n_het) / (2.0e0 * n_ctrl)) * (1 - (2 * n_hom + n_het) / (2.0e0 * n_ctrl))) END, 6) AS f FROM {assoc}",
)
add(
    "g17_hwe", "assoc", lambda a: a.select("marker", S.hwe_chi2(F.col("n_ctrl") - F.col("n_het") - F.col("n_hom"), F.col("n_het"), F.col("n_hom")).alias("x")).select("marker", F.round("x", 5).alias("chi2"), F.round(S.chi2_sf("x", F.lit(1)), 6).alias("p")),
    "WITH q AS (SELECT marker, n_ctrl - n_het - n_hom AS a, n_het AS b, n_hom AS c, CAST(n_ctrl AS DOUBLE) AS n, (2 * n_hom + n_het) / (2.0e0 * n_ctrl) AS q FROM {assoc}), x AS (SELECT marker, CASE WHEN q > 0 AND q < 1 THEN pow(a - n * (1 - q) * (1 - q), 2) / (n * (1 - q) * (1 - q)) + pow(b - 2 * n * q * (1 - q), 2) / (2 * n * q * (1 - q)) + pow(c - n * q * q, 2) / (n * q * q) END AS x FROM q) SELECT marker, round(x, 5) AS chi2, round(" + Q.tail("sqrt(x)") + ", 6) AS p FROM x",
)
add(
    "g18_hit_report", "assoc",
    lambda a: A.hit_report(a, "p", CUT, {"spa_fallback": A.spa_fallback(STRATA[:1], 0.8), "no_case_carriers": A.case_carriers() < 5, "impossible_p": F.col("p") <= 0, "excess_het": A.inbreeding("n_het", "n_hom", "n_ctrl") < -0.04}).select("marker", "reasons", "verdict"),
    f"""WITH h AS (SELECT marker, concat_ws(',', CASE WHEN NOT spa AND abs(beta1) / sqrt(se1) > 0.8 THEN 'spa_fallback' END, CASE WHEN n_het + n_hom < 5 THEN 'no_case_carriers' END,
       CASE WHEN 2 * n_hom + n_het > 0 AND 1 - (n_het / CAST(n_ctrl AS DOUBLE)) / (2 * ((2 * n_hom + n_het) / (2.0e0 * n_ctrl)) * (1 - (2 * n_hom + n_het) / (2.0e0 * n_ctrl))) < -0.04 THEN 'excess_het' END) AS reasons FROM {{assoc}} WHERE p < {CUT})
       SELECT marker, reasons, CASE WHEN reasons = '' THEN 'kept' ELSE 'excluded' END AS verdict FROM h""",
)
add(
    "g21_calibration_report", "pheno", lambda p: p.groupBy("code").agg(F.count("value").alias("n"), F.avg("value").alias("phi")).select("code", "n", F.round(4 * F.col("n") * F.col("phi") * (1 - F.col("phi")), 6).alias("n_eff")),
    "SELECT code, count(value) AS n, round(4 * count(value) * avg(value) * (1 - avg(value)), 6) AS n_eff FROM {pheno} GROUP BY 1",
)
add(
    "g25_effect_consistency", "assoc",
    lambda a: A.effect_consistency(a.select("marker", F.explode(F.array(F.struct(F.col("beta1").alias("beta"), F.col("se1").alias("se")), F.struct(F.col("beta2").alias("beta"), F.col("se2").alias("se")))).alias("s")).select("marker", "s.*"), ["marker"]).select("marker", F.round("mean", 6).alias("mean"), F.round("q", 5).alias("q"), "df", "one_sign"),
    """WITH w AS (SELECT marker, beta1, beta2, 1 / (se1 * se1) AS w1, 1 / (se2 * se2) AS w2 FROM {assoc}), m AS (SELECT *, (w1 * beta1 + w2 * beta2) / (w1 + w2) AS mean FROM w)
       SELECT marker, round(mean, 6) AS mean, round(greatest(w1 * beta1 * beta1 + w2 * beta2 * beta2 - mean * (w1 * beta1 + w2 * beta2), 0), 5) AS q, CAST(1 AS BIGINT) AS df, sign(beta1) = sign(beta2) AS one_sign FROM m""",
)
add(
    "g26_call_rate", "calls samples",
    lambda c, s: (lambda g: g.select("site", *(c for c in g.columns if c.startswith("n_")), *(F.round(c, 6).alias(c) for c in g.columns if c != "site" and not c.startswith("n_"))))(A.call_rate_by_group(c, s.select("sample", F.when(F.col("control"), "control").otherwise("case").alias("group")))),
    f"""WITH g AS (SELECT c.*, CASE WHEN control THEN 'control' ELSE 'case' END AS grp, a1 IS NOT NULL AND a2 IS NOT NULL AS called FROM {{calls}} c JOIN {{samples}} USING (sample)),
       n AS (SELECT site, {", ".join(f"count(*) FILTER (WHERE grp = '{k}') AS n_{k}, count(*) FILTER (WHERE grp = '{k}' AND NOT called) AS n_{k}_nocall, quantile_cont(dp, 0.5) FILTER (WHERE grp = '{k}') AS median_dp_{k}, quantile_cont(gq, 0.5) FILTER (WHERE grp = '{k}') AS median_gq_{k}" for k in ("case", "control"))} FROM g GROUP BY 1),
       r AS (SELECT *, CASE WHEN n_case > 0 THEN (n_case - n_case_nocall) / CAST(n_case AS DOUBLE) END AS call_rate_case, CASE WHEN n_control > 0 THEN (n_control - n_control_nocall) / CAST(n_control AS DOUBLE) END AS call_rate_control FROM n)
       SELECT site, n_case, n_case_nocall, n_control, n_control_nocall, round(call_rate_case, 6) AS call_rate_case, round(call_rate_control, 6) AS call_rate_control, round(call_rate_case - call_rate_control, 6) AS call_rate_diff, round({Q.fisher("(n_case - n_case_nocall)", "n_case_nocall", "(n_control - n_control_nocall)", "n_control_nocall")}, 6) AS fisher_p,
         round(median_dp_case, 6) AS median_dp_case, round(median_gq_case, 6) AS median_gq_case, round(median_dp_control, 6) AS median_dp_control, round(median_gq_control, 6) AS median_gq_control FROM r""",
)
add(
    "g1_score_test", "haps samples",
    lambda h, s: A.score_test(C.split_dosage(h, 3).select(F.col("site").alias("variant"), "sample", "anc", F.col("ds").cast("double").alias("ds")), s.select("sample", (F.col("balance") / 10_000).alias("r"), F.lit(1.0).alias("w"), F.array(F.lit(1.0), F.col("sex").cast("double")).alias("x")), np.diag([1e-3, 2e-3]), 3, 0.5).select("variant", "included", *(F.round(c, 6).alias(c) for c in ("chi2", "p", "beta0", "se0", "p0"))),
)
#: The panel as a whole grid: a genotype without a row is 0.
GRID = """WITH RECURSIVE who AS (SELECT DISTINCT sample FROM {panel}), spots AS (SELECT DISTINCT chrom, pos, site FROM {panel}),
       d AS MATERIALIZED (SELECT chrom, pos, site, sample, CAST(CASE WHEN p.site IS NULL THEN 0 ELSE p.a1 + p.a2 END AS DOUBLE) AS g FROM (SELECT * FROM spots CROSS JOIN who) LEFT JOIN {panel} p USING (chrom, pos, site, sample)),
       known AS MATERIALIZED (SELECT * FROM d WHERE g IS NOT NULL)"""
PAIRS = """t AS MATERIALIZED (SELECT a.chrom, a.pos, a.site, b.pos AS pos2, b.site AS site2, count(*) AS n, sum(a.g) AS x, sum(b.g) AS y, sum(a.g * a.g) AS xx, sum(b.g * b.g) AS yy, sum(a.g * b.g) AS xy
         FROM known a JOIN known b ON a.chrom = b.chrom AND a.sample = b.sample WHERE a.pos < b.pos AND b.pos - a.pos <= 20000 GROUP BY ALL HAVING count(*) >= 10),
       r AS MATERIALIZED (SELECT chrom, pos, site, pos2, site2, n, CASE WHEN (n * xx - x * x) * (n * yy - y * y) > 0 THEN pow(n * xy - x * y, 2) / ((n * xx - x * x) * (n * yy - y * y)) END AS r2 FROM t)"""
add(
    "h2_ld_pairs", "panel", lambda c: A.ld_pairs(c, 20_000, 10, "reference").withColumn("r2", F.round("r2", 6)),
    f"{GRID}, {PAIRS} SELECT site, site2, n, round(r2, 6) AS r2 FROM r",
)
add(
    "h2_ld_prune", "panel", lambda c: A.ld_prune(c, 0.1, 20_000, 10, "reference"),
    # one site a step in each chromosome: it stays unless one that stays is in LD with it
    f"""{GRID}, {PAIRS}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos, site) AS i FROM spots), e AS MATERIALIZED (SELECT site2 AS late, list(site) AS early FROM r WHERE r2 > 0.1 GROUP BY 1),
       w AS (SELECT DISTINCT chrom, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS stay FROM o
         UNION ALL SELECT w.chrom, o.i, CASE WHEN e.early IS NULL OR NOT list_has_any(w.stay, e.early) THEN list_append(w.stay, o.site) ELSE w.stay END FROM w JOIN o ON o.chrom = w.chrom AND o.i = w.i + 1 LEFT JOIN e ON e.late = o.site),
       f AS (SELECT chrom, stay FROM w QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY i DESC) = 1)
       SELECT o.chrom, o.pos, o.site, list_contains(f.stay, o.site) AS kept FROM o JOIN f ON o.chrom = f.chrom""",
)
DIMS, HARD = 10, [f"a{i}" for i in range(8)]
SAMPLES_SQL = """SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding[1:10]] AS v, CASE WHEN vec_id % 200 = 0 THEN NULL WHEN vec_id % 100 = 0 OR label >= 8 THEN 'oth' ELSE 'a' || CAST(label AS STRING) END AS soft, label >= 8 AND vec_id % 100 <> 0 AS control FROM {embeddings}"""


def labelled(e):
    """Samples of embeddings: every hundredth has no hard label (of these half no soft one either); labels of 8 and more are curated as other."""
    asked, other = F.col("vec_id") % 100 == 0, F.col("label") >= 8
    soft = F.when(F.col("vec_id") % 200 == 0, F.lit(None)).when(asked | other, "oth").otherwise(F.concat(F.lit("a"), F.col("label").cast("string")))
    return e.select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, DIMS), lambda x: x.cast("double")).alias("v"), soft.alias("soft"), soft.alias("hard_label"), (other & ~asked).alias("control"))


def infer_sql(name: str, queries: str, refs: str) -> str:
    """CTEs that end in {name}: votes of 15 scaled references and the nearest centroid for each query."""
    n, each = name, range(1, DIMS + 1)
    z = "[" + ", ".join(f"(v[{i}] - m{i}) / s{i}" for i in each) + "]"
    told = ", ".join(f"avg(v[{i}]) AS m{i}, CASE WHEN stddev_pop(v[{i}]) = 0 THEN 1 ELSE stddev_pop(v[{i}]) END AS s{i}" for i in each)
    return f"""{n}s AS (SELECT {told} FROM {refs}), {n}r AS (SELECT id, label, {z} AS z FROM {refs}, {n}s), {n}q AS (SELECT id, {z} AS z FROM {queries}, {n}s),
       {n}p AS (SELECT q.id, r.label, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.z, r.z), r.id) AS r FROM {n}q q, {n}r r), {n}n AS (SELECT id, label, count(*) AS n FROM {n}p WHERE r <= 15 GROUP BY 1, 2),
       {n}k AS (SELECT id, label, n / 15.0e0 AS share, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM {n}n), {n}c AS (SELECT label, [{", ".join(f"avg(z[{i}])" for i in each)}] AS z FROM {n}r GROUP BY 1),
       {n}d AS (SELECT q.id, c.label, list_distance(q.z, c.z) AS d, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.z, c.z), c.label) AS r FROM {n}q q, {n}c c),
       {n}m AS (SELECT id, max(CASE WHEN r = 1 THEN label END) AS centroid, max(CASE WHEN r = 2 THEN d END) - min(d) AS margin FROM {n}d WHERE r <= 2 GROUP BY 1),
       {n} AS (SELECT id, label, centroid, share, margin, label = centroid AND (share >= 0.8e0 OR margin >= 0.5e0) AS confident FROM {n}k JOIN {n}m USING (id) WHERE r = 1)"""


def rounded(df):
    return df.withColumns({"share": F.round("share", 6), "margin": F.round("margin", 5)})


add(
    "h6_infer_labels", "embeddings",
    lambda e: rounded((lambda v: A.infer_labels(v.where("id % 100 = 0"), v.where("id % 100 <> 0"), DIMS))(labelled(e).select("id", "v", F.col("soft").alias("label")))),
    f"WITH e AS ({SAMPLES_SQL}), refs AS (SELECT id, v, soft AS label FROM e WHERE id % 100 <> 0), asked AS (SELECT id, v FROM e WHERE id % 100 = 0), {infer_sql('told', 'asked', 'refs')} SELECT id, label, centroid, round(share, 6) AS share, round(margin, 5) AS margin, confident FROM told",
)
add(
    "h6_fill_labels", "embeddings", lambda e: rounded(A.fill_labels(labelled(e), HARD, DIMS)),
    f"""WITH e AS ({SAMPLES_SQL}), asked AS (SELECT id, v FROM e WHERE soft IS NULL), refs AS (SELECT id, v, soft AS label FROM e WHERE soft <> 'oth'), softs AS (SELECT id, v, soft AS label FROM e WHERE soft IS NOT NULL), {infer_sql("h", "asked", "refs")}, {infer_sql("f", "asked", "softs")},
       refs2 AS (SELECT * FROM refs UNION ALL SELECT id, v, h.label FROM h JOIN e USING (id)), open2 AS (SELECT id, v, soft FROM e WHERE NOT control AND soft = 'oth'), {infer_sql("g", "open2", "refs2")}
       SELECT h.id, 'knn' AS method, CAST(NULL AS STRING) AS before, h.label AS suggested, h.centroid, round(h.share, 6) AS share, round(h.margin, 5) AS margin, h.confident, h.label AS after, f.label AS soft_after, f.confident AS soft_confident FROM h JOIN f USING (id)
       UNION ALL SELECT g.id, 'knn_hard', soft, label, centroid, round(share, 6), round(margin, 5), confident, label, soft, NULL FROM g JOIN open2 USING (id)""",
)
add(
    "e17_lambda_context", "assoc",
    lambda a: (lambda l: l.join(F.broadcast(l.groupBy("arm").agg(F.percentile("lambda", 0.5).alias("median"), F.count("*").alias("runs"))), "arm"))(S.lambda_gc(a, "p", ["phenotype", "arm"])).select("phenotype", "arm", "runs", F.round("median", 6).alias("median"), F.round(F.cume_dist().over(W.partitionBy("arm").orderBy("lambda")), 6).alias("share")),
    f"WITH l AS ({Q.lambdas('{assoc}', 'phenotype, arm', 'p')}) SELECT phenotype, arm, count(*) OVER (PARTITION BY arm) AS runs, round(quantile_cont(lam, 0.5) OVER (PARTITION BY arm), 6) AS median, round(cume_dist() OVER (PARTITION BY arm ORDER BY lam), 6) AS share FROM l",
)
