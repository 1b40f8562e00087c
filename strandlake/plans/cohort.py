"""Queries for joins (C), aggregates (D) and ordered analytics (E, F) over the domain views."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import cohort as C
from strandlake.operators import intervals as I
from strandlake.operators import loci as L
from strandlake.operators import rows as R
from strandlake.operators import summaries as M
from strandlake.operators.ranks import row_numbers
from strandlake.plans.views import Plans
from strandlake.sources.tables import stage

plans = Plans()
add = plans.add


def integers(df, *names):
    return df.select(*(F.col(c).cast("bigint").alias(c) if c in names else F.col(c) for c in df.columns))


def spans(s):
    """Sites as half-open spans."""
    return s.withColumns({"start0": F.col("pos") - 1, "end0": F.greatest(F.col("end0"), F.col("pos"))})


SPANS = "SELECT *, pos - 1 AS s0, greatest(end0, pos) AS e0 FROM {sites}"

# --- intervals
add(
    "a11_merge_intervals", "track", lambda t: I.merge_intervals(t, ("name", "chrom")),
    """WITH r AS (SELECT *, max(end0) OVER (PARTITION BY name, chrom ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {track}),
       g AS (SELECT *, sum(CASE WHEN reached IS NULL OR start0 > reached THEN 1 ELSE 0 END) OVER (PARTITION BY name, chrom ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS k FROM r)
       SELECT name, chrom, min(start0) AS start0, max(end0) AS end0 FROM g GROUP BY name, chrom, k""",
)
add(
    "a7_extract_windows", "assoc supplier",
    lambda a, s: I.extract_windows(a.select("chrom", "pos", "marker"), s.select(F.col("s_suppkey").alias("window"), F.concat(F.lit("chr"), F.col("s_suppkey") % 22 + 1).alias("chrom"), (F.col("s_suppkey") * 31).alias("start"), (F.col("s_suppkey") * 31 + 4000).alias("end"))).groupBy("window").agg(F.count("*").alias("n"), F.min("pos").alias("low")),
    """SELECT s_suppkey AS "window", count(*) AS n, min(pos) AS low FROM {assoc} JOIN {supplier} ON chrom = 'chr' || CAST(s_suppkey % 22 + 1 AS STRING) AND pos BETWEEN s_suppkey * 31 AND s_suppkey * 31 + 4000 GROUP BY 1""",
)
add(
    "c4_covering_join", "sites markers", lambda s, m: integers(I.covering_join(s.select("id", "chrom", "pos"), m).drop("exact"), "an1", "an2"),
    """WITH m AS (SELECT chrom, pos, min(struct_pack(a := an1, b := an2)) AS v FROM {markers} GROUP BY chrom, pos),
       n AS (SELECT s.id, s.chrom, s.pos, coalesce((SELECT min(pos) FROM m WHERE m.chrom = s.chrom AND m.pos >= s.pos), (SELECT max(pos) FROM m WHERE m.chrom = s.chrom)) AS marker_pos FROM {sites} s)
       SELECT n.id, n.chrom, n.pos, CAST(m.v.a AS BIGINT) AS an1, CAST(m.v.b AS BIGINT) AS an2, n.marker_pos FROM n LEFT JOIN m ON m.chrom = n.chrom AND m.pos = n.marker_pos""",
)
add(
    "c27_flank_agree", "sites markers",
    lambda s, m: (lambda after: I.previous_join(after, m).withColumnRenamed("marker_pos", "before").join(m.groupBy("chrom", F.col("pos").alias("before")).agg(F.min("an1").alias("b1")), ["chrom", "before"], "left").select("id", F.when((F.col("marker_at") >= F.col("pos")) & (F.col("b1") == F.col("a1")), F.col("a1").cast("bigint")).alias("anc")))(I.covering_join(s.select("id", "chrom", "pos"), m.groupBy("chrom", "pos").agg(F.min("an1").alias("a1"))).select("id", "chrom", "pos", "a1", F.col("marker_pos").alias("marker_at"))),
    """WITH m AS (SELECT chrom, pos, min(an1) AS a FROM {markers} GROUP BY chrom, pos),
       n AS (SELECT s.id, (SELECT arg_min(a, pos) FROM m WHERE m.chrom = s.chrom AND m.pos >= s.pos) AS x, (SELECT arg_max(a, pos) FROM m WHERE m.chrom = s.chrom AND m.pos <= s.pos) AS y FROM {sites} s)
       SELECT id, CASE WHEN x = y THEN CAST(x AS BIGINT) END AS anc FROM n""",
)
add(
    "c6_point_in_interval", "sites track", lambda s, t: I.contains_point(s.select("id", "chrom", "pos"), t).select("id", "hit"),
    "SELECT id, EXISTS (SELECT 1 FROM {track} t WHERE t.chrom = s.chrom AND t.start0 <= s.pos AND s.pos < t.end0) AS hit FROM {sites} s",
)
add(
    "c7_covered_bases", "sites track", lambda s, t: I.covered_bases(spans(s).select("id", "chrom", "start0", "end0"), t.where("name = 'rm'"), "id").select("id", "covered"),
    f"""WITH r AS (SELECT *, max(end0) OVER (PARTITION BY chrom ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {{track}} WHERE name = 'rm'),
       g AS (SELECT *, sum(CASE WHEN reached IS NULL OR start0 > reached THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS k FROM r),
       m AS (SELECT chrom, min(start0) AS x, max(end0) AS y FROM g GROUP BY chrom, k), s AS ({SPANS})
       SELECT s.id, CAST(coalesce(sum(CASE WHEN x IS NOT NULL THEN least(e0, y) - greatest(s0, x) END), 0) AS BIGINT) AS covered FROM s LEFT JOIN m ON m.chrom = s.chrom AND s0 < y AND x < e0 GROUP BY s.id""",
)
add(
    "c8_overlaps", "sites track", lambda s, t: I.overlaps(spans(s).select("id", "chrom", "start0", "end0"), t, "id").groupBy("hit").agg(F.count("*").alias("n")),
    f"SELECT hit, count(*) AS n FROM (SELECT EXISTS (SELECT 1 FROM {{track}} t WHERE t.chrom = s.chrom AND s0 < t.end0 AND t.start0 < e0) AS hit FROM ({SPANS}) s) GROUP BY 1",
)
add(
    "c9_assign_locus", "sites catalog", lambda s, c: C.assign_locus(spans(s).select("id", "chrom", "start0", F.least("end0", F.col("start0") + 3000).alias("end0")), c, 50),
    f"""WITH p AS (SELECT s.id, s0, e0, c.*, row_number() OVER (PARTITION BY s.id ORDER BY c.start0 DESC, c.locus) AS near FROM (SELECT id, chrom, s0, least(e0, s0 + 3000) AS e0 FROM ({SPANS})) s JOIN {{catalog}} c ON c.chrom = s.chrom AND s0 - 50 < c.end0 AND c.start0 < e0 + 50),
       q AS (SELECT id, locus, greatest(least(e0, end0) - greatest(s0, start0), 0) AS overlap, greatest(greatest(s0, start0) - least(e0, end0), 0) AS distance, end0 - start0 AS len, start0 FROM p WHERE near <= 8),
       k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, distance, len, start0 DESC, locus) AS r FROM q)
       SELECT id, locus, overlap, distance FROM k WHERE r = 1""",
)

# --- equi joins
add(
    "c1_merge_sources", "sites",
    lambda s: C.merge_sources({"snv": s.where("site % 2 = 0").select("chrom", "pos", "svlen", "filter"), "sv": s.where("site % 3 = 0").select("chrom", "pos", F.lit("PASS").alias("filter"), F.col("size").alias("svlen")), "lai": s.where("site % 5 = 0").select("chrom", "pos", "svtype")}, ["chrom", "pos"], ["svlen", "filter", "svtype"]),
    """SELECT chrom, pos, CASE WHEN site % 2 = 0 THEN coalesce(svlen, CASE WHEN site % 3 = 0 THEN size END) ELSE CASE WHEN site % 3 = 0 THEN size END END AS svlen, CASE WHEN site % 2 = 0 THEN filter WHEN site % 3 = 0 THEN 'PASS' END AS filter,
       CASE WHEN site % 5 = 0 THEN svtype END AS svtype, concat_ws(',', CASE WHEN site % 2 = 0 THEN 'snv' END, CASE WHEN site % 3 = 0 THEN 'sv' END, CASE WHEN site % 5 = 0 THEN 'lai' END) AS src FROM {sites} WHERE site % 2 = 0 OR site % 3 = 0 OR site % 5 = 0""",
)
add(
    "c3_match_stats", "sites markers", lambda s, m: C.match_stats(s, m, ["chrom", "pos"]).withColumn("match_rate", F.round("match_rate", 6)),
    "SELECT count(*) AS n_base, count(m.pos) AS n_matched, round(CAST(count(m.pos) AS DOUBLE) / count(*), 6) AS match_rate FROM (SELECT DISTINCT chrom, pos FROM {sites}) s LEFT JOIN (SELECT DISTINCT chrom, pos FROM {markers}) m ON s.chrom = m.chrom AND s.pos = m.pos",
)
add(
    "c12_attach_scores", "sites", lambda s: C.attach_scores(s.select("id", "chrom", "pos", "svtype", "site"), s.where("site % 3 = 0").select("chrom", "pos", "svtype", (F.col("size") * 1.0).alias("score")), s.where("site % 2 = 0").select("id", (F.col("site") * 0.5).alias("score"))).select("id", "score"),
    "SELECT id, CASE WHEN site % 3 = 0 THEN size * 1.0e0 WHEN site % 2 = 0 THEN site * 0.5e0 END AS score FROM {sites}",
)
add(
    "c13_integrate_partitions", "sites", lambda s: C.integrate_partitions(s.where("source = 'main'"), s.where("source = 'bnd'"), s.where("source = 'large' OR site % 11 = 0").withColumn("source", F.lit("large")), ["chrom", "pos", "ref", "alt"]).groupBy("source").agg(F.count("*").alias("n")),
    "SELECT source, count(*) AS n FROM (SELECT 'main' AS source FROM {sites} WHERE source = 'main' AND site % 11 <> 0 UNION ALL SELECT 'bnd' FROM {sites} WHERE source = 'bnd' UNION ALL SELECT 'large' FROM {sites} WHERE source = 'large' OR site % 11 = 0) GROUP BY 1",
)
add(
    "c14_concordant_sites", "calls", lambda c: C.concordant_sites(c, c.withColumn("a2", F.when(F.col("sample") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("a2"))), 0.9, 1),
    """SELECT site, count(*) AS n, count(*) FILTER (WHERE least(a1, a2) = least(a1, b2) AND greatest(a1, a2) = greatest(a1, b2)) AS same FROM (SELECT site, a1, a2, CASE WHEN sample % 3 = 0 THEN 0 ELSE a2 END AS b2 FROM {calls})
       WHERE a1 IS NOT NULL AND a2 IS NOT NULL AND b2 IS NOT NULL GROUP BY site HAVING count(*) FILTER (WHERE least(a1, a2) = least(a1, b2) AND greatest(a1, a2) = greatest(a1, b2)) >= 0.9 * count(*)""",
)
add(
    "c15_group_mean_pairs", "cpg",
    lambda c: c.groupBy("chrom", "begin0").agg(F.count_if(F.col("sample") % 2 == 0).alias("n0"), F.count_if(F.col("sample") % 2 == 1).alias("n1"), F.round(F.avg(F.when(F.col("sample") % 2 == 0, F.col("score"))), 6).alias("m0"), F.round(F.avg(F.when(F.col("sample") % 2 == 1, F.col("score"))), 6).alias("m1")).where("n0 >= 1 AND n1 >= 1"),
    """SELECT chrom, begin0, count(*) FILTER (WHERE sample % 2 = 0) AS n0, count(*) FILTER (WHERE sample % 2 = 1) AS n1, round(avg(score) FILTER (WHERE sample % 2 = 0), 6) AS m0, round(avg(score) FILTER (WHERE sample % 2 = 1), 6) AS m1
       FROM {cpg} GROUP BY chrom, begin0 HAVING count(*) FILTER (WHERE sample % 2 = 0) >= 1 AND count(*) FILTER (WHERE sample % 2 = 1) >= 1""",
)
add(
    "c16_paired_concordance", "cpg", lambda c: C.paired_concordance(c.where("track = 'hap1'"), c.where("track = 'hap2'"), ["begin0"], 5).select("n", F.round("share", 6).alias("share"), F.round("r", 6).alias("r")),
    """WITH x AS (SELECT begin0, avg(score) AS x FROM {cpg} WHERE track = 'hap1' AND cov >= 5 GROUP BY 1), y AS (SELECT begin0, avg(score) AS y FROM {cpg} WHERE track = 'hap2' AND cov >= 5 GROUP BY 1)
       SELECT count(*) AS n, round(avg(CASE WHEN abs(x - y) < 10 THEN 1.0e0 ELSE 0.0e0 END), 6) AS share, round(corr(x, y), 6) AS r FROM x JOIN y USING (begin0)""",
)
add(
    "c17_left_join_1to1", "samples customer", lambda s, c: C.left_join_1to1(s, c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("sample"), "c_name"), ["sample"]).groupBy("ancestry").agg(F.count("*").alias("n"), F.count("c_name").alias("joined")),
    "SELECT ancestry, count(*) AS n, count(c_name) AS joined FROM {samples} LEFT JOIN {customer} ON c_custkey = sample AND c_custkey % 3 = 0 GROUP BY 1",
)
add(
    "c18_membership", "samples carriers", lambda s, c: C.membership(s, c.select("sample"), "sample", "in_set").groupBy("ancestry", "in_set").agg(F.count("*").alias("n")),
    "SELECT ancestry, EXISTS (SELECT 1 FROM {carriers} c WHERE c.sample = s.sample) AS in_set, count(*) AS n FROM {samples} s GROUP BY 1, 2",
)
add(
    "c24_choose_one", "cpg", lambda c: R.top_per(c.select("sample", "track", "cov", "begin0", "chrom"), ["sample"], F.asc("track"), F.desc("cov"), F.asc("begin0"), F.asc("chrom")),
    "SELECT sample, track, cov, begin0, chrom FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY track, cov DESC, begin0, chrom) AS r FROM {cpg}) WHERE r = 1",
)
add(
    "c26_concept_join", "ehr nation region",
    lambda e, n, r: L.concept_persons(e.select("person", (F.col("event_id") % 25).alias("concept")), n.select(F.col("n_nationkey").alias("concept"), F.col("n_name").alias("name")), n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("concept"), F.col("r_name").alias("ancestor")).unionByName(n.select(F.col("n_nationkey").alias("concept"), F.col("n_name").alias("ancestor")))),
    """WITH h AS (SELECT n_nationkey AS concept, r_name AS ancestor FROM {nation} JOIN {region} ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, n_name FROM {nation})
       SELECT ancestor, count(DISTINCT person) AS persons, count(*) AS n, count(DISTINCT concept) AS concepts FROM (SELECT person, event_id % 25 AS concept FROM {ehr}) JOIN h USING (concept) GROUP BY 1""",
)
add(
    "c28_phase_frame", "calls",
    lambda c: (lambda j: j.agg(F.count("*").alias("n"), F.round(F.avg(((F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))).cast("double")), 6).alias("same"), F.round(F.avg(F.when(F.col("a1") != F.col("a2"), ((F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))).cast("double"))), 6).alias("same_het")))(c.where("a1 IS NOT NULL AND a2 IS NOT NULL").join(c.select("site", "sample", F.when(F.col("site") % 6 == 0, F.col("a2")).otherwise(F.col("a1")).alias("b1"), F.when(F.col("site") % 6 == 0, F.col("a1")).otherwise(F.col("a2")).alias("b2")), ["site", "sample"])),
    "SELECT count(*) AS n, round(avg(CASE WHEN site % 6 <> 0 OR a1 = a2 THEN 1.0e0 ELSE 0.0e0 END), 6) AS same, round(avg(CASE WHEN a1 <> a2 THEN CASE WHEN site % 6 <> 0 THEN 1.0e0 ELSE 0.0e0 END END), 6) AS same_het FROM {calls} WHERE a1 IS NOT NULL AND a2 IS NOT NULL",
)
add(
    "c30_fuzzy_match", "sites", lambda s: C.match_sites_fuzzy(s.where("site % 2 = 0"), s.where("site % 2 = 1").withColumn("chrom", F.concat(F.lit("chr"), (F.col("site") - 1) % 22 + 1)), 800),
    """WITH b AS (SELECT chrom, pos, id, svtype, abs(svlen) AS len FROM {sites} WHERE site % 2 = 0 AND abs(svlen) BETWEEN 50 AND 10000),
       c AS (SELECT 'chr' || CAST((site - 1) % 22 + 1 AS STRING) AS chrom, pos, id, svtype, abs(svlen) AS len FROM {sites} WHERE site % 2 = 1 AND abs(svlen) BETWEEN 50 AND 10000),
       p AS (SELECT b.id, c.id AS id_r, abs(b.pos - c.pos) AS d FROM b JOIN c ON b.chrom = c.chrom AND b.svtype = c.svtype AND abs(b.pos - c.pos) <= 800 AND least(b.len, c.len) >= 0.7 * greatest(b.len, c.len)),
       r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, id_r) AS x, row_number() OVER (PARTITION BY id_r ORDER BY d, id) AS y FROM p)
       SELECT id, id_r, d FROM r WHERE x = 1 AND y = 1""",
)
add(
    "c32_participant_sites", "carriers samples", lambda c, s: c.join(s.where("NOT control").select("sample"), "sample").select("site").distinct(),
    "SELECT DISTINCT site FROM {carriers} JOIN {samples} USING (sample) WHERE NOT control",
)

# --- site aggregates
add(
    "d1_site_freq", "calls", lambda c: C.site_freq(c).withColumn("af", F.round("af", 6)).transform(lambda d: integers(d, "ac", "an")),
    """SELECT site, CAST(ac AS BIGINT) AS ac, an, n_carriers, round(CASE WHEN an = 0 THEN 0.0e0 ELSE CAST(ac AS DOUBLE) / an END, 6) AS af FROM (SELECT site, sum(coalesce(a1, 0) + coalesce(a2, 0)) AS ac, count(a1) + count(a2) AS an,
       count(*) FILTER (WHERE coalesce(a1, 0) + coalesce(a2, 0) > 0) AS n_carriers FROM {calls} GROUP BY site)""",
)
add(
    "d1_carrier_lists", "calls", lambda c: C.carrier_lists(c),
    "SELECT site, string_agg(CAST(sample AS STRING), ',' ORDER BY sample) AS carriers, count(*) AS n_carriers FROM {calls} WHERE coalesce(a1, 0) + coalesce(a2, 0) > 0 GROUP BY site",
)
MERGED = """r AS (SELECT *, max(end0) OVER (PARTITION BY name, chrom ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {track}),
       g AS (SELECT *, sum(CASE WHEN reached IS NULL OR start0 > reached THEN 1 ELSE 0 END) OVER (PARTITION BY name, chrom ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS k FROM r),
       m AS (SELECT name, chrom, min(start0) AS x, max(end0) AS y FROM g GROUP BY name, chrom, k)"""
HIT = "(CASE WHEN svtype IN ('DEL', 'DUP', 'CNV') AND e0 - s0 > 5000 THEN coalesce((SELECT sum(least(e0, y) - greatest(s0, x)) FROM m WHERE m.name = '{0}' AND m.chrom = s.chrom AND s0 < y AND x < e0), 0) > 0.5 * (e0 - s0) ELSE EXISTS (SELECT 1 FROM m WHERE m.name = '{0}' AND m.chrom = s.chrom AND (x <= s0 AND s0 < y OR x <= e0 - 1 AND e0 - 1 < y)) END)"
LABELLED = f"""{MERGED}, s AS ({SPANS}), h AS (SELECT s.*, {HIT.replace('{0}', 'sr')} AS sr, {HIT.replace('{0}', 'sd')} AS sd, {HIT.replace('{0}', 'rm')} AS rm FROM s),
       lab AS (SELECT *, CASE WHEN sr THEN 'SR' WHEN sd THEN 'SD' WHEN rm THEN 'RM' ELSE 'US' END AS context FROM h)"""
label = lambda s, t: C.context_label(spans(s), t)
add("d2_context_label", "sites track", lambda s, t: label(s, t).select("id", "context"), f"WITH {LABELLED} SELECT id, context FROM lab")
COUNTS = "SELECT source, svtype, c AS context, count(*) FILTER (WHERE svtype = 'BND' OR abs(svlen) >= 50) AS n50, count(*) FILTER (WHERE svtype = 'BND' OR abs(svlen) >= 20) AS n20 FROM (SELECT source, svtype, svlen, context AS c FROM lab UNION ALL SELECT source, svtype, svlen, 'all' FROM lab) GROUP BY 1, 2, 3"
add("d3_site_counts", "sites track", lambda s, t: C.site_counts(label(s, t)), f"WITH {LABELLED} {COUNTS}")
add(
    "d4_context_pct", "sites track", lambda s, t: C.context_pct(C.site_counts(label(s, t))),
    f"WITH {LABELLED}, n AS ({COUNTS}) SELECT a.source, a.svtype, a.context, round(CASE WHEN b.n50 > 0 THEN 100.0e0 * a.n50 / b.n50 END, 1) AS pct FROM n a JOIN n b ON a.source = b.source AND a.svtype = b.svtype AND b.context = 'all' WHERE a.context <> 'all'",
)
add(
    "d6_length_spectrum", "sites track", lambda s, t: C.length_spectrum(label(s, t)),
    f"""WITH {LABELLED}, p AS (SELECT CASE WHEN source = 'bnd' THEN 'bnd' WHEN source = 'large' THEN 'ultralong' WHEN abs(svlen) < 20 THEN 'small' WHEN svtype IN ('DEL', 'INS') THEN 'sv' END AS part,
       CASE WHEN source = 'bnd' THEN 0 ELSE svlen END AS len, context FROM lab) SELECT part, CAST(len AS BIGINT) AS len, context, count(*) AS n FROM p WHERE part IS NOT NULL AND len IS NOT NULL GROUP BY 1, 2, 3""",
)
add(
    "d66_chao1", "calls", lambda c: C.chao1(C.site_freq(c), "n_carriers").withColumn("chao1", F.round("chao1", 6)),
    "SELECT n, f1, f2, round(n + f1 * (f1 - 1) / (2.0e0 * (f2 + 1)), 6) AS chao1 FROM (SELECT count(*) AS n, count(*) FILTER (WHERE k = 1) AS f1, count(*) FILTER (WHERE k = 2) AS f2 FROM (SELECT site, count(*) AS k FROM {calls} WHERE coalesce(a1, 0) + coalesce(a2, 0) > 0 GROUP BY site))",
)

# --- repeat loci
add(
    "d9_locus_dosage", "haps",
    lambda h: C.locus_dosage(h.select((F.col("site") % 97).alias("locus"), "sample", "hap", F.col("site").alias("rec"), ((F.col("allele") * 3) * (F.col("site") % 5 - 2)).alias("bp"), (F.col("site") % 4 != 0).alias("phased"), (F.col("site") % 2 == 0).alias("size_sv"))).transform(lambda d: integers(d, "dosage", "changes")),
    """WITH r AS (SELECT site % 97 AS locus, sample, hap, site AS rec, allele * 3 * (site % 5 - 2) AS bp, site % 4 <> 0 AS phased, site % 2 = 0 AS v FROM {haps}),
       u AS (SELECT locus, sample FROM (SELECT locus, sample, rec FROM r WHERE NOT phased GROUP BY 1, 2, 3 HAVING count(bp) = 2 AND min(bp) <> max(bp)) GROUP BY 1, 2 HAVING count(*) >= 2),
       a AS (SELECT locus, sample, hap, sum(bp) AS total, count(*) = count(bp) AS called, count(*) FILTER (WHERE bp <> 0) AS changes,
         (count(*) FILTER (WHERE v AND bp > 0) > 0 AND count(*) FILTER (WHERE NOT v AND bp > 0) > 0) OR (count(*) FILTER (WHERE v AND bp < 0) > 0 AND count(*) FILTER (WHERE NOT v AND bp < 0) > 0) AS twice FROM r GROUP BY 1, 2, 3)
       SELECT a.locus, a.sample, hap, CASE WHEN called AND u.locus IS NULL THEN CAST(total AS BIGINT) END AS dosage, changes, u.locus IS NOT NULL AS ambiguous, called AND twice AS duplicate FROM a LEFT JOIN u ON u.locus = a.locus AND u.sample = a.sample""",
)
add(
    "d10_allele_table", "haps", lambda h: C.allele_table(h.select((F.col("site") % 97).alias("locus"), F.col("allele").alias("dosage"))),
    "WITH d AS (SELECT site % 97 AS locus, allele AS dosage FROM {haps}), t AS (SELECT locus, count(dosage) AS n_hap, count(*) - count(dosage) AS n_hap_missing FROM d GROUP BY 1) SELECT d.locus, dosage, count(*) AS n_hap_allele, n_hap, n_hap_missing FROM d JOIN t USING (locus) WHERE dosage IS NOT NULL GROUP BY d.locus, dosage, n_hap, n_hap_missing",
)
add(
    "d13_polymorphism", "calls", lambda c: integers(C.polymorphism(c), "low", "high", "s", "ss"),
    """WITH h AS (SELECT site, a1 AS x FROM {calls} UNION ALL SELECT site, a2 FROM {calls}), a AS (SELECT site, count(*) FILTER (WHERE a1 IS NOT NULL AND a2 IS NOT NULL) AS n_called, count(*) FILTER (WHERE a1 <> a2) AS n_het FROM {calls} GROUP BY site)
       SELECT site, n_called, n_het, min(x) AS low, max(x) AS high, CAST(sum(x) AS BIGINT) AS s, CAST(sum(x * x) AS BIGINT) AS ss, count(DISTINCT x) AS n_alleles FROM h JOIN a USING (site) GROUP BY site, n_called, n_het""",
)
add(
    "d14_polymorphism_summary", "calls", lambda c: C.polymorphism_summary(C.polymorphism(c)),
    """WITH h AS (SELECT site, a1 AS x FROM {calls} UNION ALL SELECT site, a2 FROM {calls}), n AS (SELECT site, count(DISTINCT x) AS k FROM h GROUP BY site), a AS (SELECT site, count(*) FILTER (WHERE a1 IS NOT NULL AND a2 IS NOT NULL) AS c, count(*) FILTER (WHERE a1 <> a2) AS e FROM {calls} GROUP BY site)
       SELECT count(*) FILTER (WHERE k <= 1) AS monomorphic, count(*) FILTER (WHERE k > 1) AS polymorphic, count(*) FILTER (WHERE c > 0 AND CAST(e AS DOUBLE) / c >= 0.01) AS het_1, count(*) FILTER (WHERE c > 0 AND CAST(e AS DOUBLE) / c >= 0.1) AS het_10, count(*) FILTER (WHERE c > 0 AND CAST(e AS DOUBLE) / c >= 0.3) AS het_30 FROM n JOIN a USING (site)""",
)
PLVI = "SELECT locus, period, CAST(sum(n) AS BIGINT) AS n, sum(n * dosage) / CAST(sum(n) AS DOUBLE) AS mean, sqrt(greatest(sum(n * dosage * dosage) / CAST(sum(n) AS DOUBLE) - pow(sum(n * dosage) / CAST(sum(n) AS DOUBLE), 2), 0.0e0)) AS plvi FROM {alleles} GROUP BY 1, 2"
add(
    "d15_variability", "alleles", lambda a: C.variability(a).select("locus", "period", "n", F.round("mean", 6).alias("mean"), F.round("plvi", 6).alias("plvi")),
    f"WITH v AS ({PLVI}) SELECT locus, period, n, round(mean, 6) AS mean, round(plvi, 6) AS plvi FROM v WHERE n >= (SELECT ceil(0.5 * max(n)) FROM v)",
)
add(
    "d16_rarefaction", "alleles", lambda a: C.rarefaction(a, (1, 2, 5, 10)).select("k", "loci", *(F.round(c, 6).alias(c) for c in ("mean", "q1", "q3"))),
    """WITH t AS (SELECT locus, sum(n) AS total FROM {alleles} GROUP BY 1), k AS (SELECT unnest([1, 2, 5, 10]) AS k),
       e AS (SELECT a.locus, k.k, sum(1 - CASE WHEN total - n < k.k THEN 0 ELSE exp(lgamma(total - n + 1) + lgamma(total - k.k + 1) - lgamma(total - n - k.k + 1) - lgamma(total + 1)) END) AS x FROM {alleles} a JOIN t USING (locus) JOIN k ON k.k <= total GROUP BY 1, 2)
       SELECT CAST(k AS BIGINT) AS k, count(*) AS loci, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q3 FROM e GROUP BY 1""",
)
add(
    "d67_coding_corr2", "alleles", lambda a: C.coding_corr2(a).select("locus", "n", F.round("f", 6).alias("f"), F.round("corr2", 6).alias("corr2")),
    """WITH m AS (SELECT locus, CAST(sum(n) AS BIGINT) AS n, sum(n * dosage) / CAST(sum(n) AS DOUBLE) AS m, sum(n * dosage * dosage) / CAST(sum(n) AS DOUBLE) AS q, coalesce(sum(n) FILTER (WHERE dosage <> 0), 0) / CAST(sum(n) AS DOUBLE) AS f FROM {alleles} GROUP BY 1)
       SELECT locus, n, round(f, 6) AS f, round(CASE WHEN (q - m * m) * f * (1 - f) > 1e-12 THEN pow(m * (1 - f), 2) / ((q - m * m) * f * (1 - f)) END, 6) AS corr2 FROM m""",
)
add(
    "e8_percentile_rank", "alleles", lambda a: C.variability(a, 0.0).select("locus", F.round(100 * F.cume_dist().over(W.partitionBy("period").orderBy(F.round("plvi", 9))), 6).alias("pct")),
    f"WITH v AS ({PLVI}) SELECT locus, round(100 * cume_dist() OVER (PARTITION BY period ORDER BY round(plvi, 9)), 6) AS pct FROM v",
)

# --- sample QC and methylation
add(
    "d24_cpg_summary", "cpg",
    lambda c: c.groupBy("sample", "track").agg(F.count("*").alias("n"), F.sum("cov").alias("cov_sum"), F.round(F.avg("score"), 6).alias("score_mean"), F.count_if(F.col("chrom") == "chrX").alias("n_x"), F.count_if(F.col("chrom") == "chrY").alias("n_y"), *(F.count_if(F.col("cov") >= k).alias(f"n_{k}") for k in (1, 5, 10, 15, 20))),
    """SELECT sample, track, count(*) AS n, CAST(sum(cov) AS BIGINT) AS cov_sum, round(avg(score), 6) AS score_mean, count(*) FILTER (WHERE chrom = 'chrX') AS n_x, count(*) FILTER (WHERE chrom = 'chrY') AS n_y, count(*) FILTER (WHERE cov >= 1) AS n_1,
       count(*) FILTER (WHERE cov >= 5) AS n_5, count(*) FILTER (WHERE cov >= 10) AS n_10, count(*) FILTER (WHERE cov >= 15) AS n_15, count(*) FILTER (WHERE cov >= 20) AS n_20 FROM {cpg} GROUP BY 1, 2""",
)
add(
    "d25_cpg_combine", "cpg", lambda c: C.combine_haplotypes(c, 5),
    """SELECT sample, round(CASE WHEN c > 0 THEN h / (2.0e0 * c) END, 6) AS fraction, round(CASE WHEN c5 > 0 THEN h5 / (2.0e0 * c5) END, 6) AS fraction_covered, h > 0 AS resolved FROM (SELECT sample, count(*) FILTER (WHERE track <> 'combined') AS h, count(*) FILTER (WHERE track = 'combined') AS c,
       count(*) FILTER (WHERE track <> 'combined' AND cov >= 5) AS h5, count(*) FILTER (WHERE track = 'combined' AND cov >= 5) AS c5 FROM {cpg} GROUP BY 1)""",
)
add(
    "d26_cohort_numbers", "cpg", lambda c: c.groupBy("sample", "caller").agg(F.avg("cov").alias("m")).groupBy("caller").agg(F.count("*").alias("n"), *(F.round(F.percentile("m", q), 6).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75))),
    "SELECT caller, count(*) AS n, round(quantile_cont(m, 0.25), 6) AS q25, round(quantile_cont(m, 0.5), 6) AS q50, round(quantile_cont(m, 0.75), 6) AS q75 FROM (SELECT sample, caller, avg(cov) AS m FROM {cpg} GROUP BY 1, 2) GROUP BY 1",
)
add(
    "d27_pick_samples", "cpg", lambda c: R.top_per(c.groupBy("sample", "caller").agg(F.sum("cov").alias("cov")), ["caller"], F.desc("cov"), F.asc("sample"), n=3),
    "SELECT sample, caller, CAST(cov AS BIGINT) AS cov FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY cov DESC, sample) AS r FROM (SELECT sample, caller, sum(cov) AS cov FROM {cpg} GROUP BY 1, 2)) WHERE r <= 3",
)
add(
    "d28_call_qc_sites", "calls",
    lambda c: c.withColumn("f", R.sample_fails("gq", "dp", "rnc")).groupBy("site").agg(F.count("f").alias("n_qcable"), F.count_if("f").alias("n_fail")).withColumn("fraction", F.round(F.coalesce(F.try_divide("n_fail", "n_qcable"), F.lit(1.0)), 6)).withColumn("keep", (F.col("n_qcable") > 0) & (F.col("n_fail") <= 0.5 * F.col("n_qcable"))),
    """WITH f AS (SELECT site, CASE WHEN rnc LIKE '%I%' THEN true WHEN gq IS NULL AND dp IS NULL THEN NULL ELSE coalesce(gq < 20, false) OR coalesce(dp < 10, false) END AS f FROM {calls}), n AS (SELECT site, count(f) AS n_qcable, count(*) FILTER (WHERE f) AS n_fail FROM f GROUP BY 1)
       SELECT *, round(CASE WHEN n_qcable = 0 THEN 1.0e0 ELSE CAST(n_fail AS DOUBLE) / n_qcable END, 6) AS fraction, n_qcable > 0 AND n_fail <= 0.5 * n_qcable AS keep FROM n""",
)
# every ninth site gets a second allele
add(
    "d30_site_class", "sites", lambda s: C.site_classes(s.withColumn("alt", F.when(F.col("site") % 9 == 0, F.concat("alt", F.lit(",T"))).otherwise(F.col("alt")))).withColumn("fraction", F.round("fraction", 6)),
    "WITH c AS (SELECT CASE WHEN site % 9 = 0 THEN 'multiallelic' WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snv' WHEN length(ref) <> length(alt) THEN 'indel' ELSE 'other' END AS class FROM {sites}) SELECT class, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM c) AS DOUBLE), 6) AS fraction FROM c GROUP BY 1",
)

# --- local ancestry
add(
    "d31_global_props", "haps", lambda h: C.global_props(h).withColumn("share", F.round("share", 6)),
    "SELECT sample, anc, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY sample), 6) AS share FROM {haps} WHERE anc IS NOT NULL GROUP BY sample, anc",
)
add(
    "d32_switch_expectation", "haps", lambda h: C.switch_expectation(C.global_props(h), 1.2, 8.0).select("sample", F.round("het", 6).alias("het"), F.round("expected", 6).alias("expected")),
    "WITH p AS (SELECT sample, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY sample) AS s FROM {haps} WHERE anc IS NOT NULL GROUP BY sample, anc) SELECT sample, round(1 - sum(s * s), 6) AS het, round(0.096e0 * (1 - sum(s * s)), 6) AS expected FROM p GROUP BY 1",
)
SW = """k AS (SELECT DISTINCT sample, hap, chrom, pos, anc FROM {haps} WHERE anc IS NOT NULL), l AS (SELECT sample, hap, chrom, pos, anc AS to_anc, lag(anc) OVER w AS from_anc, lag(pos) OVER w AS prev FROM k WINDOW w AS (PARTITION BY sample, hap, chrom ORDER BY pos)),
       sw AS (SELECT *, pos - prev AS gap FROM l WHERE from_anc <> to_anc)"""
add("e1_switches", "haps", lambda h: C.switches(h), f"WITH {SW} SELECT * FROM sw")
add(
    "e2_flickers", "haps", lambda h: C.mark_flickers(C.switches(h), 50_000).groupBy("flicker").agg(F.count("*").alias("n"), F.sum("span").alias("bp")),
    f"""WITH {SW}, f AS (SELECT *, CASE WHEN lag(from_anc) OVER w = to_anc AND lag(to_anc) OVER w = from_anc AND pos - lag(pos) OVER w BETWEEN 1 AND 50000 THEN pos - lag(pos) OVER w END AS s1,
       CASE WHEN lead(from_anc) OVER w = to_anc AND lead(to_anc) OVER w = from_anc AND lead(pos) OVER w - pos BETWEEN 1 AND 50000 THEN lead(pos) OVER w - pos END AS s2 FROM sw WINDOW w AS (PARTITION BY sample, hap, chrom ORDER BY pos))
       SELECT coalesce(s2, s1) IS NOT NULL AS flicker, count(*) AS n, CAST(sum(coalesce(s2, s1)) AS BIGINT) AS bp FROM f GROUP BY 1""",
)
TRACTS = f"""WITH {SW}, e AS (SELECT sample, hap, chrom, CAST(0 AS BIGINT) AS start, arg_min(anc, pos) AS anc FROM k GROUP BY 1, 2, 3 UNION ALL SELECT sample, hap, chrom, pos, to_anc FROM sw WHERE pos BETWEEN 1 AND 99999),
       t AS (SELECT *, lead(start) OVER (PARTITION BY sample, hap, chrom ORDER BY start) AS nxt FROM e)"""
add(
    "e4_tracts", "haps", lambda h: C.build_tracts(C.switches(h), h, 0, 100_000).withColumnRenamed("end", "stop"),
    f"""{TRACTS} SELECT sample, hap, chrom, start, coalesce(nxt, 100000) AS stop, anc, start = 0 AS left_open, nxt IS NULL AS right_open FROM t""",
)
add(
    "d33_tract_stats", "haps", lambda h: C.tract_stats(C.build_tracts(C.switches(h), h, 0, 100_000)).withColumn("median", F.round("median", 6)),
    f"{TRACTS} SELECT anc, count(*) AS n, count(*) FILTER (WHERE start <> 0 AND nxt IS NOT NULL) AS n_complete, round(quantile_cont(coalesce(nxt, 100000) - start, 0.5), 6) AS median, CAST(sum(coalesce(nxt, 100000) - start) AS BIGINT) AS bp FROM t GROUP BY 1",
)
def tract_rows(h):
    h = stage(h.select("sample", "hap", "chrom", "pos", "anc"), "haplotypes")
    sw = stage(C.switches(h), "switches")
    n = h.select("sample").distinct().count()
    out = M.tract_summary(C.build_tracts(sw, h, 0, 100_000), C.mark_flickers(sw, 50_000), 2 * n, 100_000, 1.2)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("bigint") for c, t in out.dtypes))


add(
    "d33_tract_summary", "haps", tract_rows,
    f"""{TRACTS}, n AS (SELECT 2 * count(DISTINCT sample) AS haps, 2 * count(DISTINCT sample) * 0.1e0 AS mb FROM {{haps}}),
       fl AS (SELECT *, coalesce(CASE WHEN lead(from_anc) OVER w = to_anc AND lead(to_anc) OVER w = from_anc AND lead(pos) OVER w - pos BETWEEN 1 AND 50000 THEN lead(pos) OVER w - pos END, CASE WHEN lag(from_anc) OVER w = to_anc AND lag(to_anc) OVER w = from_anc AND pos - lag(pos) OVER w BETWEEN 1 AND 50000 THEN pos - lag(pos) OVER w END) AS span FROM sw WINDOW w AS (PARTITION BY sample, hap, chrom ORDER BY pos)),
       s AS (SELECT count(DISTINCT (sample, hap)) AS n_haps_with_switch, count(*) AS n_switches, count(span) AS n_flicker, quantile_cont(span, 0.5) AS median_flicker FROM fl),
       q AS (SELECT count(*) AS n_tracts, count(*) FILTER (WHERE start <> 0 AND nxt IS NOT NULL) AS n_complete, quantile_cont(coalesce(nxt, 100000) - start, 0.1) AS p10, quantile_cont(coalesce(nxt, 100000) - start, 0.5) AS median, quantile_cont(coalesce(nxt, 100000) - start, 0.9) AS p90, quantile_cont(CASE WHEN start <> 0 AND nxt IS NOT NULL THEN nxt - start END, 0.5) AS median_complete FROM t WHERE coalesce(nxt, 100000) > start)
       SELECT n_tracts, n_complete, n_haps_with_switch, round(n_haps_with_switch / haps, 6) AS frac_haps, n_switches, round(n_switches / mb, 6) AS rate, round(n_flicker / n_switches, 6) AS flicker_frac, round(n_flicker / mb, 6) AS flicker_rate, round(n_switches / mb * 100 / 1.2e0, 6) AS implied_t, round(p10, 6) AS p10, round(median, 6) AS median, round(p90, 6) AS p90, round(median_complete, 6) AS median_complete, round(median_flicker, 6) AS median_flicker FROM q, s, n""",
)
add(
    "d39_split_dosage", "haps", lambda h: C.split_dosage(h, 4),
    "SELECT site, sample, anc, count(*) FILTER (WHERE allele = 1) AS ds, count(*) AS n_hap FROM {haps} WHERE anc BETWEEN 0 AND 3 GROUP BY 1, 2, 3",
)
add(
    "d42_admixed_dosage", "haps", lambda h: C.admixed_dosage(h, 0.5).withColumn("ds", F.round("ds", 6)),
    """WITH t AS (SELECT site, avg(CASE WHEN allele IS NULL THEN 1.0e0 ELSE 0.0e0 END) AS gone, max(abs(allele * 3 - 1)) AS top FROM {haps} GROUP BY 1)
       SELECT site, sample, anc, round(sum(allele * 3 - 1) / CAST(top AS DOUBLE), 6) AS ds, count(*) AS n_hap FROM {haps} JOIN t USING (site) WHERE allele IS NOT NULL AND anc IS NOT NULL AND gone <= 0.5 AND top > 0 GROUP BY site, sample, anc, top""",
)
add(
    "d61_generation_depth", "ped", lambda p: integers(C.generation_depth(p), "depth"),
    """WITH RECURSIVE up AS (SELECT child, child AS anc, 0 AS d FROM {ped} UNION ALL SELECT u.child, x.parent, u.d + 1 FROM up u JOIN (SELECT child, father AS parent FROM {ped} WHERE father <> 0 UNION ALL SELECT child, mother FROM {ped} WHERE mother <> 0) x ON x.child = u.anc JOIN {ped} p ON p.child = x.parent)
       SELECT child, CAST(max(d) AS BIGINT) AS depth FROM up GROUP BY 1""",
)
add("d51_derange", "samples", lambda s: C.derange(s, "sample", "ancestry").agg(F.count("*").alias("n"), F.count_if(F.col("sample") == F.col("donor")).alias("fixed"), F.count_distinct("donor").alias("donors")), "SELECT count(*) AS n, CAST(0 AS BIGINT) AS fixed, count(*) AS donors FROM {samples}")

# --- discovery
ORDER = "SELECT sample, row_number() OVER (ORDER BY CASE ancestry WHEN 'eur' THEN 0 WHEN 'eas' THEN 1 WHEN 'sas' THEN 2 WHEN 'amr' THEN 3 ELSE 5 END, sample) AS rank FROM {samples} WHERE NOT control"
def order(s):
    """sample, rank (from 1) and block, without a single task for all samples."""
    people = s.where("NOT control").select("sample", R.ancestry_rank("ancestry").alias("block"))
    return row_numbers(people, "block", "sample", name="rank").select("sample", (F.col("rank") + 1).alias("rank"), F.col("block").cast("bigint").alias("block"))


add("e7_discovery_order", "samples", lambda s: order(s).drop("block"), ORDER)
add(
    "e5_discovery_curve", "carriers samples", lambda c, s: M.discovery_curve(c, order(s)),
    f"WITH o AS ({ORDER}), f AS (SELECT site, min(rank) AS rank FROM {{carriers}} JOIN o USING (sample) GROUP BY 1) SELECT rank, CAST(sum(CASE WHEN n IS NULL THEN 0 ELSE n END) OVER (ORDER BY rank) AS BIGINT) AS cumulative FROM o LEFT JOIN (SELECT rank, count(*) AS n FROM f GROUP BY 1) USING (rank)",
)
frequency = lambda c: c.groupBy("site").agg(F.count_distinct("sample").alias("k")).select("site", F.when(F.col("k") == 1, "singleton").when(F.col("k") <= 5, "rare").otherwise("common").alias("freq"))
def curve_by_strata(c, s, t):
    """Carriers and strata are written once, as the curve, the frequencies and the kinds of strata all read them."""
    c = stage(c.select("site", "sample"), "carriers")
    return M.discovery_curve(c, order(s), stage(frequency(c).join(t.select("site", "svtype"), "site"), "strata"))


add(
    "e5_discovery_strata", "carriers samples sites", curve_by_strata,
    f"""WITH o AS ({ORDER}), k AS (SELECT site, svtype, CASE WHEN n = 1 THEN 'singleton' WHEN n <= 5 THEN 'rare' ELSE 'common' END AS freq FROM (SELECT site, count(DISTINCT sample) AS n FROM {{carriers}} GROUP BY 1) JOIN {{sites}} USING (site)),
       f AS (SELECT site, min(rank) AS rank FROM {{carriers}} JOIN o USING (sample) GROUP BY 1), n AS (SELECT rank, svtype, freq, count(*) AS n FROM f JOIN k USING (site) GROUP BY ALL), g AS (SELECT o.rank, d.* FROM o CROSS JOIN (SELECT DISTINCT svtype, freq FROM k) d)
       SELECT g.rank, g.svtype, g.freq, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g.svtype, g.freq ORDER BY g.rank) AS BIGINT) AS cumulative FROM g LEFT JOIN n USING (rank, svtype, freq)""",
)
# deletions and insertions of 50 to 10,000; places with a multiple of 7 are matched to phase 1; some ids stand twice
novel = lambda t: t.where("source = 'main' AND svtype IN ('DEL', 'INS') AND abs(svlen) BETWEEN 50 AND 10000").select("chrom", "pos", F.when(F.col("site") % 91 == 0, "twice").otherwise(F.col("id")).alias("id"), "svtype")
add(
    "e6_novelty_curve", "carriers samples sites",
    lambda c, s, t: M.novelty_curve(M.novelty_classes(novel(t), c, order(s), s.where("control").select("sample"), novel(t).where("pos % 7 = 0")), order(s), 25),
    f"""WITH o AS (SELECT s.sample, s.rank, CASE ancestry WHEN 'eur' THEN 0 WHEN 'eas' THEN 1 WHEN 'sas' THEN 2 WHEN 'amr' THEN 3 ELSE 5 END AS block FROM ({ORDER}) s JOIN {{samples}} USING (sample)),
       t AS (SELECT chrom, pos, CASE WHEN site % 91 = 0 THEN 'twice' ELSE id END AS id, svtype FROM {{sites}} WHERE source = 'main' AND svtype IN ('DEL', 'INS') AND abs(svlen) BETWEEN 50 AND 10000), u AS (SELECT * FROM t QUALIFY count(*) OVER (PARTITION BY id) = 1),
       r AS (SELECT id, rank, row_number() OVER (PARTITION BY id ORDER BY rank) AS i, count(*) OVER (PARTITION BY id) AS n FROM {{carriers}} JOIN o USING (sample)), h AS (SELECT DISTINCT id FROM {{carriers}} JOIN {{samples}} USING (sample) WHERE control),
       k AS (SELECT u.id, svtype, min(rank) AS first, min(CASE WHEN i = 2 THEN rank END) AS second, CASE WHEN u.id IN (SELECT id FROM h) THEN 'in_controls' WHEN u.pos % 7 = 0 THEN 'in_phase1' ELSE 'new' END AS kind FROM u JOIN r USING (id) GROUP BY u.id, svtype, u.pos),
       e AS (SELECT svtype, kind AS class, first AS rank, 1 AS k FROM k WHERE kind <> 'new' UNION ALL SELECT svtype, 'new_singleton', first, 1 FROM k WHERE kind = 'new' UNION ALL SELECT svtype, 'new_singleton', second, -1 FROM k WHERE kind = 'new' AND second IS NOT NULL UNION ALL SELECT svtype, 'new_recurrent', second, 1 FROM k WHERE kind = 'new' AND second IS NOT NULL)
       SELECT o.rank AS n_participants, CAST(o.block AS BIGINT) AS block, s.svtype, c.class, CAST((SELECT coalesce(sum(k), 0) FROM e WHERE e.svtype = s.svtype AND e.class = c.class AND e.rank <= o.rank) AS BIGINT) AS cumulative
       FROM o, (SELECT DISTINCT svtype FROM k) s, (SELECT unnest(['in_controls', 'in_phase1', 'new_recurrent', 'new_singleton']) AS class) c WHERE o.rank % 25 = 0 OR o.rank = (SELECT max(rank) FROM o)""",
)

# --- cohort and phenotypes
add(
    "d52_trait_inventory", "ehr",
    lambda e: e.groupBy("concept").agg(F.count_distinct("person").alias("persons")).where("persons >= 5").join(M.grouped_quantiles(e, ["concept"], "value", {"q5": 0.05, "q50": 0.5, "q95": 0.95}), "concept").select("concept", "persons", "n", *(F.round(q, 6).alias(q) for q in ("q5", "q50", "q95"))),
    "SELECT concept, count(DISTINCT person) AS persons, count(value) AS n, round(quantile_cont(value, 0.05), 6) AS q5, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM {ehr} GROUP BY 1 HAVING count(DISTINCT person) >= 5",
)
add(
    "d53_inventory_combine", "pheno samples",
    lambda p, s: C.combine_inventory(p, s.count(), 20).select("code", "cases", "controls", "smaller", *(F.round(c, 6).alias(c) for c in ("prevalence", "coverage", "n_eff")), "testable"),
    "SELECT code, cases, controls, least(cases, controls) AS smaller, round(CAST(cases AS DOUBLE) / (cases + controls), 6) AS prevalence, round((cases + controls) / CAST((SELECT count(*) FROM {samples}) AS DOUBLE), 6) AS coverage, round(4 * cases * (1 - CAST(cases AS DOUBLE) / (cases + controls)), 6) AS n_eff, least(cases, controls) >= 20 AS testable FROM (SELECT code, count(*) FILTER (WHERE value = 1) AS cases, count(*) FILTER (WHERE value = 0) AS controls FROM {pheno} GROUP BY 1)",
)
add(
    "d54_cutoff_curve", "pheno", lambda p: C.cutoff_curve(p.groupBy("person").agg(F.count("*").alias("k")), "k", 50),
    "SELECT t.t AS threshold, (SELECT count(*) FROM (SELECT person, count(*) AS k FROM {pheno} GROUP BY 1) WHERE k >= t.t) AS n FROM (SELECT unnest(range(1, 51)) AS t) t",
)
add(
    "d55_age_sex_counts", "orders",
    lambda o: o.select(F.least(F.floor(F.datediff(F.lit("2020-01-01").cast("date"), F.col("o_orderdate").cast("date")) / 365.25), F.lit(90)).cast("bigint").alias("age"), (F.col("o_custkey") % 2).alias("sex")).groupBy("age", "sex").agg(F.count("*").alias("n")).where("n >= 20"),
    "SELECT CAST(least(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '2020-01-01') / 365.25e0), 90) AS BIGINT) AS age, o_custkey % 2 AS sex, count(*) AS n FROM {orders} GROUP BY 1, 2 HAVING count(*) >= 20",
)
add(
    "d58_category_prevalence", "pheno samples",
    lambda p, s: p.groupBy("person", F.substring("code", 1, 4).alias("category")).agg(F.max("value").alias("v")).join(s.withColumnRenamed("sample", "person"), "person").groupBy("ancestry", "category").agg(F.count("*").alias("n"), F.round(100 * F.avg(F.coalesce("v", F.lit(0)).cast("double")), 6).alias("pct")),
    "SELECT ancestry, category, count(*) AS n, round(100 * avg(CAST(coalesce(v, 0) AS DOUBLE)), 6) AS pct FROM (SELECT person, substr(code, 1, 4) AS category, max(value) AS v FROM {pheno} GROUP BY 1, 2) JOIN {samples} ON sample = person GROUP BY 1, 2",
)
add(
    "d59_cohort_table", "samples", lambda s: s.groupBy("ancestry").agg(F.count("*").alias("n"), F.round(F.avg("balance"), 4).alias("mean"), F.round(F.stddev_samp("balance"), 4).alias("sd"), F.count_if("control").alias("controls")),
    "SELECT ancestry, count(*) AS n, round(avg(balance), 4) AS mean, round(stddev_samp(balance), 4) AS sd, count(*) FILTER (WHERE control) AS controls FROM {samples} GROUP BY 1",
)
add(
    "d62_status_rollup", "cpg", lambda c: c.groupBy("sample").agg(F.bool_or(F.col("cov") == 0).alias("any_zero"), F.array_join(F.sort_array(F.collect_set("caller")), ",").alias("callers")),
    "SELECT sample, bool_or(cov = 0) AS any_zero, string_agg(DISTINCT caller, ',' ORDER BY caller) AS callers FROM {cpg} GROUP BY 1",
)
add(
    "d63_unanimous", "cpg", lambda c: c.groupBy("sample").agg(C.unanimous("caller").alias("caller")),
    "SELECT sample, CASE WHEN count(DISTINCT caller) = 1 THEN max(caller) END AS caller FROM {cpg} GROUP BY 1",
)
add(
    "d69_completeness", "calls", lambda c: C.completeness(c.withColumns({"stratum": F.col("sample") % 4, "low": F.col("gq") < 20}), "stratum", ["a1", "gq", "dp", "low"], ["low"]).select("stratum", "column", *(F.round(x, 6).alias(x) for x in ("share", "true_rate", "range"))),
    "WITH c AS (SELECT *, gq < 20 AS low, sample % 4 AS stratum FROM {calls}), s AS (" + " UNION ALL ".join(f"SELECT stratum, '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 0.0e0 ELSE 1.0e0 END) AS share, {'avg(CASE WHEN low THEN 1.0e0 WHEN NOT low THEN 0.0e0 END)' if c == 'low' else 'CAST(NULL AS DOUBLE)'} AS true_rate FROM c GROUP BY 1" for c in ("a1", "gq", "dp", "low"))
    + ') SELECT stratum, "column", round(share, 6) AS share, round(true_rate, 6) AS true_rate, round(max(share) OVER (PARTITION BY "column") - min(share) OVER (PARTITION BY "column"), 6) AS range FROM s',
)
add(
    "d70_crosstab_redacted", "samples", lambda s: C.crosstab_redacted(s, "ancestry", "segment", 20),
    "SELECT ancestry, segment, CASE WHEN count(*) >= 20 THEN count(*) END AS n FROM {samples} GROUP BY 1, 2",
)
add(
    "f6_random_sample", "samples", lambda s: s.orderBy(F.md5(F.concat(F.lit("7:"), F.col("sample").cast("string")))).limit(25).select("sample"),
    "SELECT sample FROM {samples} ORDER BY md5('7:' || CAST(sample AS STRING)) LIMIT 25",
)
add(
    "f7_batches", "samples", lambda s: L.batches(s, "sample", 40),
    "SELECT sample, ntile(CAST(ceil((SELECT count(*) FROM {samples}) / 40.0e0) AS BIGINT)) OVER (ORDER BY sample) AS batch FROM {samples}",
)
