"""Queries for merges, matches, audits and reports (operators/review)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import stats as S
from strandlake.operators import review as V
from strandlake.operators import rows as R
from strandlake.plans import sqlmath as Q
from strandlake.plans.views import Plans

plans = Plans()
add = plans.add
CUT = 2e-3
MD5 = "md5('{seed}' || CAST({key} AS STRING))"


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def longs(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


add(
    "b17_ru_test", "sites", lambda s: s.select("id", V.is_ru_test(R.parse_info(F.expr("CASE site % 4 WHEN 0 THEN 'RU_TEST' WHEN 1 THEN 'RU_TEST=0' WHEN 2 THEN 'RU_TEST=1;X=2' ELSE '.' END"))).alias("ru_test")),
    "SELECT id, site % 4 IN (0, 2) AS ru_test FROM {sites}",
)
add(
    "b19_apply_coding", "calls", lambda c: c.select("site", "sample", F.aggregate(F.array_compact(V.apply_coding(F.array(F.col("a1") * 3, F.col("a2") * -2), "carrier")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("dosage")),
    "SELECT site, sample, CAST(CASE WHEN a1 <> 0 THEN 1 ELSE 0 END + CASE WHEN a2 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS dosage FROM {calls}",
)
add(
    "b21_encode_text", "sites", lambda s: longs(s.select("id", R.encode_binary(F.expr("CASE site % 3 WHEN 0 THEN ' Yes' WHEN 1 THEN '0' ELSE '?' END")).alias("status"), R.encode_sex(F.expr("CASE site % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'M' ELSE NULL END")).alias("sex")), "status", "sex"),
    "SELECT id, CAST(CASE site % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS BIGINT) AS status, CAST(CASE site % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS BIGINT) AS sex FROM {sites}",
)

nulled = lambda s: s.selectExpr("sample", "CASE WHEN sample % 3 = 0 THEN NULL ELSE ancestry END AS ancestry", "CASE WHEN sample % 4 = 0 THEN NULL ELSE segment END AS segment")
add("b32_soft_fill", "samples", lambda s: V.soft_fill(nulled(s), s.where("sample % 5 <> 0").select("sample", "ancestry", "segment"), "sample", ["ancestry", "segment"])[0],
    "SELECT sample, CASE WHEN sample % 3 = 0 AND sample % 5 = 0 THEN NULL ELSE ancestry END AS ancestry, CASE WHEN sample % 4 = 0 AND sample % 5 = 0 THEN NULL ELSE segment END AS segment FROM {samples}")
add("b32_soft_fill_audit", "samples", lambda s: V.soft_fill(nulled(s), s.where("sample % 5 <> 0").select("sample", "ancestry", "segment"), "sample", ["ancestry", "segment"])[1],
    "SELECT sample, 'ancestry' AS field, ancestry AS value FROM {samples} WHERE sample % 3 = 0 AND sample % 5 <> 0 UNION ALL SELECT sample, 'segment', segment FROM {samples} WHERE sample % 4 = 0 AND sample % 5 <> 0")
add("c2_union_samples", "samples orders", lambda s, o: V.union_samples(s.where("sample % 2 = 0").selectExpr("1L AS list", "sample AS place", "sample").unionByName(o.selectExpr("2L AS list", "o_orderkey AS place", "o_custkey AS sample"))),
    "SELECT sample, CAST(min(list) AS BIGINT) AS list, min_by(place, list * 1000000000000 + place) AS place FROM (SELECT 1 AS list, sample AS place, sample FROM {samples} WHERE sample % 2 = 0 UNION ALL SELECT 2, o_orderkey, o_custkey FROM {orders}) GROUP BY sample")
add("c5_match_alleles", "sites", lambda s: V.match_alleles(s, s.where("site % 3 <> 1").selectExpr("chrom", "pos", "ref", "alt || ',G' AS alt", "site").unionByName(s.where("site % 2 = 0").selectExpr("chrom", "pos", "ref", "alt", "site + 100000000 AS site")), "id", "site"),
    "SELECT id, site % 2 = 0 AS exact, CASE WHEN site % 2 = 0 THEN site + 100000000 ELSE site END AS right_order, CASE WHEN site % 2 = 0 THEN alt ELSE alt || ',G' END AS right_alt FROM {sites} WHERE site % 2 = 0 OR site % 3 <> 1")
add("c20_match_sites", "sites", lambda s: V.match_sites(s.selectExpr("site", "chrom", "pos", "CASE WHEN site % 2 = 0 THEN ref END AS ref", "CASE WHEN site % 3 = 0 THEN 'T' END AS alt"), s).select("site", "site_id"),
    "SELECT site, id AS site_id FROM {sites} WHERE site % 3 <> 0 OR alt = 'T'")
add("c22_analysis_samples", "samples pheno carriers", lambda s, p, c: V.analysis_samples(s.selectExpr("sample", "balance AS place"), p.selectExpr("person AS sample"), c),
    "SELECT sample, balance AS place FROM {samples} WHERE sample IN (SELECT person FROM {pheno}) AND sample IN (SELECT sample FROM {carriers})")
add("c23_compare_arms", "assoc", lambda a: (lambda best: V.compare_arms(best("ru"), best("carrier"), ["phenotype", "chrom", "pos"]))(lambda arm: a.where(F.col("arm") == arm).groupBy("phenotype", "chrom", "pos").agg(F.min("p").alias("p"))),
    """WITH g AS (SELECT phenotype, chrom, pos, min(CASE WHEN arm = 'ru' THEN p END) AS pa, min(CASE WHEN arm = 'carrier' THEN p END) AS pb FROM {assoc} WHERE arm <> 'main' GROUP BY 1, 2, 3)
       SELECT count(*) FILTER (WHERE pa IS NOT NULL AND pb IS NOT NULL) AS n_both, count(*) FILTER (WHERE pb IS NULL) AS n_first, count(*) FILTER (WHERE pa IS NULL) AS n_second, count(*) FILTER (WHERE pb < pa) AS n_better FROM g""")  # fmt: skip
add("d5_merge_phases", "alleles", lambda a: V.merge_phases(a.where("n % 2 = 0").groupBy("locus").agg(F.sum("n").alias("n")), a.where("n % 2 = 1").groupBy("locus").agg(F.sum("n").alias("n")), ["locus"]),
    "SELECT locus, CAST(sum(CASE WHEN n % 2 = 0 THEN n ELSE 0 END) AS BIGINT) AS n_1, CAST(sum(CASE WHEN n % 2 = 1 THEN n ELSE 0 END) AS BIGINT) AS n_2 FROM {alleles} GROUP BY locus")
add("d7_merge_counts", "alleles", lambda a: V.merge_counts([a.where(f"period = {k}").groupBy("dosage").agg(F.sum("n").alias("n")) for k in range(1, 7)], ["dosage"]), "SELECT dosage, CAST(sum(n) AS BIGINT) AS n FROM {alleles} GROUP BY dosage")
add("d18_novel_alleles", "alleles", lambda a: V.novel_alleles(a.where("(dosage + period) % 3 <> 0"), a),
    "SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' ELSE '6+' END AS carriers, count(*) AS n_alleles, count(*) FILTER (WHERE (dosage + period) % 3 <> 0) AS n_seen FROM {alleles} GROUP BY 1")
add("d19_encoding_stats", "alleles", lambda a: V.encoding_stats(a, 4),
    """WITH g AS (SELECT locus, count(*) AS k, sum(n) AS c, max(n) AS m, count(*) FILTER (WHERE n < 4) AS kl, sum(CASE WHEN n < 4 THEN n ELSE 0 END) AS cl FROM {alleles} WHERE dosage <> 0 GROUP BY locus)
       SELECT CAST(sum(k) AS BIGINT) AS n_alleles, CAST(sum(kl) AS BIGINT) AS n_alleles_low, CAST(sum(c) AS BIGINT) AS n_carriers, CAST(sum(cl) AS BIGINT) AS n_carriers_low, count(*) FILTER (WHERE m < 4 AND c >= 4) AS n_dosage_only FROM g""")  # fmt: skip
add("d22_catalog_totals", "sites", lambda s: V.catalog_totals(s.withColumn("alt", F.when(F.col("site") % 9 == 0, F.concat("alt", F.lit(",T"))).otherwise(F.col("alt"))), "source"),
    """WITH k AS (SELECT source, site % 9 = 0 AS multi, length(ref) = length(alt) AS even, abs(length(ref) - length(alt)) AS d, translate(ref, 'AGCT', 'RRYY') = translate(alt, 'AGCT', 'RRYY') AS same,
         CASE WHEN substr(ref, 1, 1) <> substr(alt, 1, 1) THEN 1 ELSE 0 END + CASE WHEN substr(ref, 2, 1) <> substr(alt, 2, 1) THEN 1 ELSE 0 END + CASE WHEN substr(ref, 3, 1) <> substr(alt, 3, 1) THEN 1 ELSE 0 END AS wrong FROM {sites})
       SELECT source, count(*) AS n_records, count(*) FILTER (WHERE multi) AS n_multiallelic, count(*) FILTER (WHERE NOT multi AND even AND wrong = 1) AS n_snv, count(*) FILTER (WHERE NOT multi AND even AND wrong > 1) AS n_mnp, count(*) FILTER (WHERE NOT multi AND NOT even AND d <= 2) AS n_indel_short,
         count(*) FILTER (WHERE NOT multi AND d > 2) AS n_indel_long, count(*) FILTER (WHERE NOT multi AND even AND wrong = 1 AND same) AS n_ti, count(*) FILTER (WHERE NOT multi AND even AND wrong = 1 AND NOT same) AS n_tv FROM k GROUP BY source""")  # fmt: skip
PANEL_SQL = """SELECT c.id, c.pos, s.ancestry AS panel, sum(CASE WHEN a1 > 0 THEN 1 ELSE 0 END + CASE WHEN a2 > 0 THEN 1 ELSE 0 END) AS ac, sum(CASE WHEN a1 IS NULL THEN 0 ELSE 1 END + CASE WHEN a2 IS NULL THEN 0 ELSE 1 END) AS an
         FROM {calls} c JOIN {samples} s ON c.sample = s.sample GROUP BY 1, 2, 3"""
add("d29_af_panel", "calls samples", lambda c, s: longs(V.af_panel(c, s.selectExpr("sample", "ancestry AS panel"), 3, 100), "ac", "an"),
    f"""WITH p AS ({PANEL_SQL}), t AS (SELECT id, pos, CAST(sum(ac) AS BIGINT) AS ac, CAST(sum(an) AS BIGINT) AS an, count(*) AS n_panels, round(max(ac * 1.0e0 / an) - min(ac * 1.0e0 / an), 9) AS range FROM p WHERE an > 0 GROUP BY id, pos)
       SELECT * FROM t WHERE n_panels >= 2 AND least(ac, an - ac) >= 3 ORDER BY range DESC, pos, id LIMIT 100""")  # fmt: skip


def mixture(c, s):
    g = R.gt_stats("a1", "a2")
    af = c.join(s, "sample").groupBy("id", F.col("ancestry").alias("panel")).agg(F.try_divide(F.sum(g["ac"]), F.sum(g["an"])).alias("af"))
    weights = s.groupBy(F.col("ancestry").alias("panel")).agg(F.count("*").alias("w"))
    return r6(V.mixture_af(af, weights), "af")


add("d37_mixture_af", "calls samples", mixture,
    f"""WITH p AS ({PANEL_SQL}), w AS (SELECT ancestry AS panel, count(*) AS w FROM {{samples}} GROUP BY 1)
       SELECT id, round(sum(w * (ac * 1.0e0 / an)) / sum(w), 6) AS af FROM p JOIN w ON p.panel = w.panel WHERE an > 0 GROUP BY id""")  # fmt: skip
add("d50_split_samples", "samples", lambda s: V.split_samples(s, ["ancestry", "segment"], F.col("sample") % 13 == 0, 50).select("sample", "reason"),
    """WITH e AS (SELECT *, CASE WHEN control THEN 'control' WHEN sample % 13 = 0 THEN 'dropped' END AS early FROM {samples}), g AS (SELECT ancestry, segment, count(*) AS n FROM e WHERE early IS NULL GROUP BY 1, 2)
       SELECT sample, coalesce(early, CASE WHEN n < 50 THEN 'small_group' ELSE 'kept' END) AS reason FROM e LEFT JOIN g ON e.ancestry = g.ancestry AND e.segment = g.segment""")  # fmt: skip
add("d57_testable_matrix", "pheno samples", lambda p, s: V.testable_matrix(p.where("value = 1").join(s.withColumnRenamed("sample", "person"), "person").groupBy(F.substring("code", 1, 4).alias("chapter"), F.col("ancestry").alias("group"), "code").agg(F.count("*").alias("n")), ["afr", "amr", "eas", "eur", "sas"], 5),
    """WITH c AS (SELECT substr(code, 1, 4) AS chapter, ancestry, code, count(*) AS n FROM {pheno} JOIN {samples} ON person = sample WHERE value = 1 GROUP BY 1, 2, 3)
       SELECT chapter, count(*) FILTER (WHERE ancestry = 'afr' AND n >= 5) AS afr, count(*) FILTER (WHERE ancestry = 'amr' AND n >= 5) AS amr, count(*) FILTER (WHERE ancestry = 'eas' AND n >= 5) AS eas,
         count(*) FILTER (WHERE ancestry = 'eur' AND n >= 5) AS eur, count(*) FILTER (WHERE ancestry = 'sas' AND n >= 5) AS sas FROM c GROUP BY chapter""")  # fmt: skip
add("d64_outlier_rates", "samples", lambda s: r6(V.outlier_rates(s, "segment", F.abs(F.col("balance") - 4500) > 4000), "rate"), "SELECT segment, count(*) AS n, round(avg(CASE WHEN abs(balance - 4500) > 4000 THEN 1.0e0 ELSE 0.0e0 END), 6) AS rate FROM {samples} GROUP BY segment")
add("d72_shard_coverage", "assoc", lambda a: V.shard_coverage(a.groupBy("phenotype", "chrom", F.col("n_hom").alias("run")).agg(F.count("*").alias("rows")), 22),
    """WITH s AS (SELECT phenotype, chrom, n_hom, count(*) AS c FROM {assoc} GROUP BY 1, 2, 3), l AS (SELECT phenotype, chrom, max_by(c, n_hom) AS c FROM s GROUP BY 1, 2)
       SELECT phenotype, count(*) AS n_chroms, CAST(sum(c) AS BIGINT) AS rows, count(*) >= 22 AS complete FROM l GROUP BY phenotype""")  # fmt: skip
add("d73_separation_audit", "samples", lambda s: V.separation_audit(s.withColumns({"one": F.lit("1"), "y": (F.col("control") & (F.col("ancestry") != "eur")).cast("int")}), ["ancestry", "segment", "one"], "y"),
    """WITH y AS (SELECT *, CASE WHEN control AND ancestry <> 'eur' THEN 1 ELSE 0 END AS y FROM {samples}),
         l AS (SELECT 'ancestry' AS covariate, ancestry AS level, y FROM y UNION ALL SELECT 'segment', segment, y FROM y UNION ALL SELECT 'one', '1', y FROM y),
         g AS (SELECT covariate, level, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_cases FROM l GROUP BY 1, 2)
       SELECT *, count(*) OVER (PARTITION BY covariate) = 1 AS constant, n_cases = 0 OR n_cases = n AS separated FROM g""")  # fmt: skip
add("d74_missingness_cost", "calls", lambda c: V.missingness_cost(c, ["gq", "dp", "a1", "an2"]),
    "WITH t AS (SELECT count(*) AS n, count(gq) AS gq, count(dp) AS dp, count(a1) AS a1, count(an2) AS an2 FROM {calls}) SELECT n, 'gq' AS candidate, n - gq AS n_lost FROM t UNION ALL SELECT n, 'dp', n - dp FROM t UNION ALL SELECT n, 'a1', n - a1 FROM t UNION ALL SELECT n, 'an2', n - an2 FROM t")
add("f1_chrom_order", "cpg", lambda c: longs(c.groupBy("chrom").agg(F.count("*").alias("n")).withColumn("place", V.chrom_order("chrom")), "place").orderBy("place"),
    "SELECT chrom, count(*) AS n, CAST(CASE chrom WHEN 'chrX' THEN 23 WHEN 'chrY' THEN 24 ELSE CAST(substr(chrom, 4) AS INT) END AS BIGINT) AS place FROM {cpg} GROUP BY chrom")
add("f3_thin", "assoc", lambda a: V.thin(a.select("marker", "p"), "marker", CUT, 500, "thin"),
    f"SELECT marker, p FROM {{assoc}} WHERE p < {CUT} UNION ALL SELECT marker, p FROM (SELECT marker, p FROM {{assoc}} WHERE p >= {CUT} ORDER BY {MD5.format(seed='thin', key='marker')}, marker LIMIT 500)")
add("f4_hit_stack", "assoc", lambda a: a.where(F.col("p") < CUT).select("phenotype", "arm", "marker", "p"), f"SELECT phenotype, arm, marker, p FROM {{assoc}} WHERE p < {CUT}")
add("f8_reorder_samples", "samples orders", lambda s, o: V.reorder_samples(s, o.groupBy(F.col("o_custkey").alias("sample")).agg(F.min("o_orderkey").alias("place"))).select("sample", "place", "ancestry"),
    "SELECT s.sample, min(o.o_orderkey) AS place, any_value(s.ancestry) AS ancestry FROM {orders} o JOIN {samples} s ON o.o_custkey = s.sample GROUP BY s.sample")
add("g8_ac_pass", "assoc", lambda a: a.select("marker", V.ac_pass(a, "p3", ["include", "include_2"]).alias("by_mask"), V.ac_pass(a, "p3", ["include_2"]).alias("by_p")), "SELECT marker, include AS by_mask, p3 IS NOT NULL AS by_p FROM {assoc}")
add("g12_compare_encodings", "assoc", lambda a: r6(S.lambda_gc(a, "p", ["arm"]), "lambda").join(a.groupBy("arm").agg(F.count_if(F.col("p") < CUT).alias("n_hits")), "arm"),
    f"SELECT arm, n, round(lam, 6) AS \"lambda\", n_hits FROM ({Q.lambdas('{assoc}', 'arm', 'p')}) JOIN (SELECT arm, count(*) FILTER (WHERE p < {CUT}) AS n_hits FROM {{assoc}} GROUP BY 1) USING (arm)")
add("g15_case_carriers", "assoc", lambda a: longs(a.select("marker", V.case_carriers(F.when(F.col("pos") % 3 > 0, F.col("n_het")), "n_hom").alias("n")), "n"), "SELECT marker, CAST(CASE WHEN pos % 3 > 0 THEN n_het ELSE 0 END + n_hom AS BIGINT) AS n FROM {assoc}")
add("g20_coverage_note", "assoc", lambda a: V.coverage_note(a, a.where("p < 1e-3"), CUT),
    f"SELECT phenotype, count(*) FILTER (WHERE p < {CUT}) AS n_significant, count(*) FILTER (WHERE p < 1e-3) AS n_kept, count(*) FILTER (WHERE p < 1e-3) >= count(*) FILTER (WHERE p < {CUT}) AS covered FROM {{assoc}} GROUP BY phenotype")
add("g27_imputed_fraction", "calls samples", lambda c, s: r6(V.imputed_fraction(c, c.withColumn("a1", F.coalesce("a1", F.when(F.col("site") % 2 == 0, F.lit(0)))).join(s.select("sample", "ancestry"), "sample"), ["site", "sample"], "ancestry"), "imputed"),
    "SELECT ancestry, count(*) AS n, round(avg(CASE WHEN a1 IS NULL AND a2 IS NOT NULL AND site % 2 = 0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS imputed FROM {calls} c JOIN {samples} s ON c.sample = s.sample GROUP BY ancestry")
add("g28_case_control_map", "pheno samples", lambda p, s: V.case_control_map(p, s.where("NOT control").selectExpr("sample AS person")).select("person", "code", "status"),
    "SELECT person, code, CASE value WHEN 1 THEN 'case' ELSE 'control' END AS status FROM {pheno} WHERE value IS NOT NULL AND person IN (SELECT sample FROM {samples} WHERE NOT control)")
add("g36_lambda_pair", "assoc", lambda a: r6(S.lambda_gc(a, "p", ["phenotype"]).select("phenotype", F.col("lambda").alias("lambda_1")).join(S.lambda_gc(a, "p2", ["phenotype"]).select("phenotype", F.col("lambda").alias("lambda_2")), "phenotype"), "lambda_1", "lambda_2"),
    f"SELECT phenotype, round(a.lam, 6) AS lambda_1, round(b.lam, 6) AS lambda_2 FROM ({Q.lambdas('{assoc}', 'phenotype', 'p')}) a JOIN ({Q.lambdas('{assoc}', 'phenotype', 'p2')}) b USING (phenotype)")
add("h7_fill_labels", "samples", lambda s: V.fill_labels(s.selectExpr("sample", "CASE WHEN sample % 2 = 0 THEN ancestry END AS own", "CASE WHEN sample % 3 = 0 THEN segment END AS near"), ["own", "near"]).select("sample", "label", "label_from"),
    "SELECT sample, CASE WHEN sample % 2 = 0 THEN ancestry WHEN sample % 3 = 0 THEN segment END AS label, CASE WHEN sample % 2 = 0 THEN 'own' WHEN sample % 3 = 0 THEN 'near' END AS label_from FROM {samples}")
add("h10_restrict_to_sex", "pheno samples", lambda p, s: V.restrict_to_sex(p, s, F.col("code").startswith("CV_1"), 0).groupBy("code").agg(F.count("value").alias("n")),
    "SELECT code, count(CASE WHEN code LIKE 'CV\\_1%' ESCAPE '\\' AND sex <> 0 THEN NULL ELSE value END) AS n FROM {pheno} LEFT JOIN {samples} ON person = sample GROUP BY code")
add("h13_trace_summary", "events", lambda e: r6(V.trace_summary(e, ["user_id", "event_type"], "value"), "mean", "p95", "peak"),
    "SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS peak FROM {events} GROUP BY 1, 2")
