"""Queries for the row-level rules (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import intervals
from strandlake.operators import rows as R
from strandlake.plans.views import Plans

plans = Plans()
add = plans.add


def bigint(**columns):
    return [F.col(c).cast("bigint").alias(n) if isinstance(c, str) else c.cast("bigint").alias(n) for n, c in columns.items()]


add(
    "b1_gt_stats", "calls",
    lambda c: (lambda g: c.select("site", "sample", *bigint(ac=g["ac"], an=g["an"]), g["carrier"].alias("carrier")))(R.gt_stats("a1", "a2")),
    """SELECT site, sample, CAST(CASE WHEN a1 > 0 THEN 1 ELSE 0 END + CASE WHEN a2 > 0 THEN 1 ELSE 0 END AS BIGINT) AS ac,
       CAST(CASE WHEN a1 IS NULL THEN 0 ELSE 1 END + CASE WHEN a2 IS NULL THEN 0 ELSE 1 END AS BIGINT) AS an, (coalesce(a1, 0) > 0 OR coalesce(a2, 0) > 0) AS carrier FROM {calls}""",
)
CLASS_SQL = "CASE WHEN a1 IS NULL OR a2 IS NULL THEN 'missing' WHEN a1 = 0 AND a2 = 0 THEN 'hom_ref' WHEN a1 = 0 OR a2 = 0 THEN 'het' WHEN a1 = a2 THEN 'hom_alt' ELSE 'other' END"
add("b2_gt_class", "calls", lambda c: c.groupBy(R.gt_class("a1", "a2").alias("gt")).agg(F.count("*").alias("n")), f"SELECT {CLASS_SQL} AS gt, count(*) AS n FROM {{calls}} GROUP BY 1")
add(
    "b3_norm_gt", "calls", lambda c: c.select("site", "sample", R.norm_gt("a1", "a2").alias("gt")),
    "SELECT site, sample, CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN CAST(least(a1, a2) AS STRING) || '/' || CAST(greatest(a1, a2) AS STRING) END AS gt FROM {calls}",
)
add(
    "b4_sentinel", "calls", lambda c: c.withColumn("gt", R.gt_class("a1", "a2")).withColumn("s", R.is_sentinel("gt", "gq", "dp")).groupBy("gt").agg(F.count_if("s").alias("n_sentinel"), F.count("*").alias("n")),
    f"SELECT gt, count(*) FILTER (WHERE s) AS n_sentinel, count(*) AS n FROM (SELECT {CLASS_SQL} AS gt, ({CLASS_SQL} = 'hom_ref' AND coalesce(dp, 0) = 0 AND coalesce(gq < 20, false)) AS s FROM {{calls}}) GROUP BY 1",
)
add(
    "b5_svtype", "sites", lambda s: s.select("id", R.infer_svtype("ref", "alt", F.when(F.col("site") % 3 == 0, F.concat("svtype", F.lit(":ME"))), "source").alias("type")),
    """SELECT id, CASE WHEN source = 'bnd' THEN CASE WHEN site % 3 = 0 THEN svtype ELSE 'BND' END WHEN site % 3 = 0 THEN svtype
       WHEN length(alt) > length(ref) THEN 'INS' WHEN length(alt) < length(ref) THEN 'DEL' ELSE 'OTHER' END AS type FROM {sites}""",
)
add(
    "b6_svlen", "sites", lambda s: s.select("id", R.infer_svlen("ref", "alt", F.when(F.col("site") % 3 == 0, F.concat(F.col("svlen").cast("string"), F.lit(",7")))).alias("len")),
    "SELECT id, CASE WHEN site % 3 = 0 AND svlen IS NOT NULL THEN svlen ELSE CAST(length(alt) - length(ref) AS BIGINT) END AS len FROM {sites}",
)
add(
    "b7_size_flags", "sites", lambda s: s.select("id", *(c.alias(n) for n, c in R.size_flags("svlen", "svtype").items())),
    "SELECT id, coalesce(svtype <> 'BND' AND abs(svlen) >= 20, false) AS ge20, coalesce(svtype <> 'BND' AND abs(svlen) >= 50, false) AS ge50 FROM {sites}",
)
FREQ_SQL = "CASE WHEN n_carriers >= 9 THEN 'shared' WHEN ac <= 1 THEN 'singleton' WHEN an > 0 AND CAST(ac AS DOUBLE) / an >= 0.5 THEN 'major' ELSE 'polymorphic' END"
add(
    "b8_freq_class", "calls",
    lambda c: (lambda g: c.groupBy("site").agg(F.sum(g["ac"]).alias("ac"), F.sum(g["an"]).alias("an"), F.count_if(g["carrier"]).alias("n_carriers")).groupBy(R.freq_class("ac", "an", "n_carriers", F.lit(9)).alias("class")).agg(F.count("*").alias("n")))(R.gt_stats("a1", "a2")),
    f"""SELECT {FREQ_SQL} AS class, count(*) AS n FROM (SELECT site, sum(coalesce(a1, 0) + coalesce(a2, 0)) AS ac, count(a1) + count(a2) AS an,
        count(*) FILTER (WHERE coalesce(a1, 0) + coalesce(a2, 0) > 0) AS n_carriers FROM {{calls}} GROUP BY site) GROUP BY 1""",
)
add(
    "b9_score_bin", "assoc", lambda a: a.groupBy(R.score_bin(F.col("p3") * 30).alias("bin")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN p3 IS NULL THEN 'unscored' WHEN p3 * 30 < 10 THEN 'low' WHEN p3 * 30 < 20 THEN 'mid' ELSE 'high' END AS bin, count(*) AS n FROM {assoc} GROUP BY 1",
)
add(
    "b10_small_allele", "sites", lambda s: (lambda k: s.groupBy(k[0].alias("kind"), k[1].cast("bigint").alias("len")).agg(F.count("*").alias("n")))(R.small_allele("ref", "alt")),
    """SELECT CASE WHEN length(ref) <> length(alt) THEN 'indel' WHEN wrong = 0 THEN 'ref' WHEN wrong = 1 THEN 'snv' ELSE 'mnp' END AS kind, CAST(length(alt) - length(ref) AS BIGINT) AS len, count(*) AS n
       FROM (SELECT ref, alt, CASE WHEN substr(ref, 1, 1) <> substr(alt, 1, 1) THEN 1 ELSE 0 END + CASE WHEN substr(ref, 2, 1) <> substr(alt, 2, 1) THEN 1 ELSE 0 END + CASE WHEN substr(ref, 3, 1) <> substr(alt, 3, 1) THEN 1 ELSE 0 END AS wrong FROM {sites}) GROUP BY 1, 2""",
)
add(
    "b11_signed_length", "sites", lambda s: s.select("id", R.signed_sv_length("svtype", F.abs("svlen")).alias("len")),
    "SELECT id, CASE WHEN svtype = 'DEL' THEN -abs(svlen) ELSE abs(svlen) END AS len FROM {sites}",
)
add(
    "b12_allele_bp", "sites",
    lambda s: s.select("id", F.array_join(R.allele_bp("ref", F.array("alt", F.concat(F.lit("<"), "svtype", F.lit(">"))), "svtype", F.array("svlen"), "end0", "pos"), ",").alias("bp")),
    """SELECT id, CASE WHEN d <> 0 OR sym <> 0 THEN '0,' || CAST(d AS STRING) || ',' || CAST(sym AS STRING) END AS bp FROM (SELECT id, length(alt) - length(ref) AS d,
       CASE WHEN svtype = 'DEL' THEN -coalesce(abs(svlen), end0 - pos) WHEN svtype IN ('INS', 'DUP') THEN abs(svlen) ELSE 0 END AS sym FROM {sites})""",
)
add(
    "b13_record_span", "sites",
    lambda s: (lambda r: s.select("id", *bigint(start0=r[0], stop0=r[1])))(R.record_span("pos", "ref", F.when(F.col("svtype") == "DEL", F.array(F.lit(0).cast("long"), "svlen")), F.when(F.col("site") % 2 == 0, F.col("end0")))),
    """SELECT id, pos - 1 AS start0, greatest(pos - 1 + length(ref), pos - 1 + CASE WHEN svtype = 'DEL' THEN abs(svlen) ELSE 0 END, CASE WHEN site % 2 = 0 THEN end0 ELSE pos END) AS stop0 FROM {sites}""",
)
add(
    "b14_reference_interval", "sites",
    lambda s: (lambda r: s.select("id", *bigint(start0=r[0], stop0=r[1])))(R.reference_interval("svtype", "pos", F.when(F.col("svtype") == "INS", F.col("pos") + F.col("svlen")).otherwise(F.col("end0")), "svlen")),
    "SELECT id, pos - 1 AS start0, CASE WHEN svtype = 'INS' THEN pos ELSE greatest(end0, pos) END AS stop0 FROM {sites}",
)
add(
    "b15_bnd_events", "sites",
    lambda s: R.bnd_events(s.withColumn("alt", F.concat(F.lit("N["), "chrom", F.lit(":"), F.when(F.col("site") % 4 < 2, F.col("pos") + 37 * 22).otherwise(F.abs(F.col("pos") - 37 * 22)).cast("string"), F.lit("[")))).select("id", "mate_chrom", "mate_pos"),
    """WITH b AS (SELECT id, chrom, pos, CASE WHEN site % 4 < 2 THEN pos + 37 * 22 ELSE abs(pos - 37 * 22) END AS mate FROM {sites})
       SELECT id, chrom AS mate_chrom, mate AS mate_pos FROM b WHERE NOT (pos > mate AND EXISTS (SELECT 1 FROM b x WHERE x.chrom = b.chrom AND x.pos = b.mate AND x.mate = b.pos))""",
)
add(
    "b20_sample_fails", "calls", lambda c: c.groupBy(R.sample_fails("gq", "dp", "rnc").alias("fails")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN rnc LIKE '%I%' THEN true WHEN gq IS NULL AND dp IS NULL THEN NULL ELSE coalesce(gq < 20, false) OR coalesce(dp < 10, false) END AS fails, count(*) AS n FROM {calls} GROUP BY 1",
)
add(
    "b22_phecode", "pheno", lambda p: p.select(R.phecode_of(F.regexp_replace("code", r"\.", "_")).alias("code")).distinct().withColumn("parent", R.phecode_parent("code")),
    "SELECT DISTINCT code, CASE WHEN code LIKE '%.%' THEN split_part(code, '.', 1) END AS parent FROM {pheno}",
)
add(
    "b23_rounding", "assoc", lambda a: a.select("marker", R.round_digits("p", 5).alias("r5"), F.round(R.signif_digits("p", 3), 9).alias("s3")),
    "SELECT marker, round(p, 5) AS r5, round(round(p * pow(10.0, 2 - floor(log10(p)))) / pow(10.0, 2 - floor(log10(p))), 9) AS s3 FROM {assoc}",
)
add("b25_motif_group", "part", lambda p: p.groupBy(R.motif_group("p_size").alias("g")).agg(F.count("*").alias("n")), "SELECT CASE WHEN p_size <= 6 THEN CAST(p_size AS STRING) WHEN p_size <= 12 THEN '7-12' WHEN p_size <= 24 THEN '13-24' ELSE '25+' END AS g, count(*) AS n FROM {part} GROUP BY 1")
add(
    "b26_size_class", "sites", lambda s: s.where("svlen IS NOT NULL").groupBy(R.size_class("svlen").alias("c")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN svlen = 0 THEN '0' WHEN abs(svlen) < 20 THEN '1-19' WHEN abs(svlen) < 50 THEN '20-49' ELSE '>=50' END AS c, count(*) AS n FROM {sites} WHERE svlen IS NOT NULL GROUP BY 1",
)
add(
    "b28_ancestry_rank", "samples", lambda s: s.select("sample", R.ancestry_rank("ancestry").cast("bigint").alias("rank")),
    "SELECT sample, CAST(CASE ancestry WHEN 'eur' THEN 0 WHEN 'eas' THEN 1 WHEN 'sas' THEN 2 WHEN 'amr' THEN 3 ELSE 5 END AS BIGINT) AS rank FROM {samples}",
)
add(
    "b29_indel_flanks", "sites", lambda s: R.indel_flanks(s, 50).select("chrom", *bigint(start0="start0", end0="end0")),
    "SELECT chrom, greatest(pos - 51, 0) AS start0, pos - 1 + greatest(length(ref), length(alt)) + 50 AS end0 FROM {sites} WHERE length(ref) <> length(alt)",
)
add(
    "b30_one_hot", "samples", lambda s: (lambda o: o.select("sample", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) if c in o.columns else F.lit(0).cast("bigint").alias(c) for c in (f"ancestry_{a}" for a in ("afr", "amr", "eas", "eur", "sas"))]))(R.one_hot(s, "ancestry")),
    """WITH l AS (SELECT ancestry FROM {samples} GROUP BY 1 ORDER BY count(*) DESC, ancestry LIMIT 1)
       SELECT sample, """ + ", ".join(f"CAST(ancestry = '{a}' AND '{a}' NOT IN (SELECT ancestry FROM l) AS BIGINT) AS ancestry_{a}" for a in ("afr", "amr", "eas", "eur", "sas")) + " FROM {samples}",
)
add(
    "b31_standardize", "samples", lambda s: R.standardize(s, "balance").select("sample", F.round("balance_z", 6).alias("z")),
    "SELECT sample, round((balance - (SELECT avg(balance) FROM {samples})) / (SELECT stddev_pop(balance) FROM {samples}), 6) AS z FROM {samples}",
)
add(
    "b33_cpg_sites", "cpg", lambda c: c.where("chrom = 'chr5' AND begin0 BETWEEN 5 AND 35 AND cov >= 10").groupBy("begin0").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score")),
    "SELECT begin0, count(*) AS n, round(avg(score), 6) AS score FROM {cpg} WHERE chrom = 'chr5' AND begin0 BETWEEN 5 AND 35 AND cov >= 10 GROUP BY begin0",
)

add("a5_in_region", "sites", lambda s: intervals.in_region(s, "chr7:1000-20000").select("id", "pos"), "SELECT id, pos FROM {sites} WHERE chrom = 'chr7' AND pos BETWEEN 1000 AND 20000")
