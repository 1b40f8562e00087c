"""Queries for sources and sinks, repeat loci, samples, families and local ancestry (operators/loci, sources/tables)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import cohort as C
from strandlake.operators import intervals as I
from strandlake.operators import loci as L
from strandlake.operators import rows as R
from strandlake.operators import summaries as M
from strandlake.plans.cohort import SW
from strandlake.plans.views import Plans
from strandlake.sources import tables as T

plans = Plans()
add = plans.add


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def longs(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def place(df, label):
    """A new folder for what a query writes and reads again."""
    return f"{T.shared_dir(df.sparkSession)}/stores/{label}-{uuid.uuid4().hex}"


# --- sources and sinks: each writes a given table, and reads it back through the reader or layout in question


def typed(s):
    at = place(s, "typed")
    text = s.select("id", F.coalesce(F.col("svlen").cast("string"), F.lit(".")).alias("svlen"), F.when(F.col("size") % 4 == 0, "TRUE").when(F.col("size") % 4 == 1, "no").otherwise("").alias("flag"), F.concat(F.col("size").cast("string"), F.lit(".0")).alias("size"))
    T.write_table(text, at, ["id", "svlen", "flag", "size"])
    return T.read_typed(s.sparkSession, at, {"id": "string", "svlen": "bigint", "flag": "boolean", "size": "bigint"})


add("a1_read_typed", "sites", typed, "SELECT id, svlen, CASE size % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag, size FROM {sites}")


def vcf(s, c):
    at = place(s, "vcf")
    names = [f"n{i}" for i in range(3)]
    gt = lambda a, b: F.concat(F.coalesce(a.cast("string"), F.lit(".")), F.lit("|"), F.coalesce(b.cast("string"), F.lit(".")))
    cells = [F.concat(gt(F.max(F.when(F.col("sample") % 3 == i, F.col("a1"))), F.max(F.when(F.col("sample") % 3 == i, F.col("a2")))), F.lit(":"), F.coalesce(F.max(F.when(F.col("sample") % 3 == i, F.col("dp"))).cast("string"), F.lit("."))) for i in range(3)]
    wide = c.groupBy("site").agg(*(x.alias(n) for x, n in zip(cells, names)))
    info = F.concat_ws(";", F.concat(F.lit("SVTYPE="), "svtype"), F.when(F.col("size") % 2 == 0, "FLAG"), F.concat(F.lit("SIZE="), F.col("size").cast("string")))
    body = s.join(wide, "site")
    # two sets of files, each with its own order of samples in its header
    for i, order in enumerate((names, names[::-1])):
        lines = body.where(F.col("site") % 2 == i).select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", F.lit("."), "filter", info, F.lit("GT:DP"), *order).alias("value"))
        T.write_lines(lines, f"{at}/{i}", ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *order])])
    return T.read_vcf(s.sparkSession, [f"{at}/0", f"{at}/1"])


GENOTYPES = "g AS (SELECT site, max(CASE WHEN sample % 3 = {i} THEN a1 END) AS a1, max(CASE WHEN sample % 3 = {i} THEN a2 END) AS a2, max(CASE WHEN sample % 3 = {i} THEN dp END) AS dp FROM {calls} GROUP BY site)".replace("{i}", "1")
add("a2_vcf_calls", "sites calls", lambda s, c: longs(vcf(s, c)[1].where("sample = 'n1'").select("id", "a1", "a2", "phased"), "a1", "a2"), f"WITH {GENOTYPES} SELECT id, a1, a2, TRUE AS phased FROM {{sites}} JOIN g USING (site)")
add(
    "a3_info_map", "sites calls", lambda s, c: vcf(s, c)[0].select("id", F.col("info")["SVTYPE"].alias("svtype"), F.map_contains_key("info", "FLAG").alias("flag"), F.col("info")["SIZE"].cast("bigint").alias("size")),
    "SELECT id, svtype, size % 2 = 0 AS flag, size FROM {sites} WHERE site IN (SELECT site FROM {calls})",
)
add("a4_format_columns", "sites calls", lambda s, c: vcf(s, c)[1].where("sample = 'n1'").select("id", F.col("format")["DP"].cast("bigint").alias("dp")), f"WITH {GENOTYPES} SELECT id, CAST(dp AS BIGINT) AS dp FROM {{sites}} JOIN g USING (site)")
add("a6_contig_alias", "sites", lambda s: I.in_region(s, I.resolve_contig(s, "7:1-50000")).select("id", "chrom", "pos"), "SELECT id, chrom, pos FROM {sites} WHERE chrom = 'chr7' AND pos BETWEEN 1 AND 50000")


def shards(s):
    one = T.concat_shards([s.where("source = 'main'").select("id", "chrom", "pos"), s.where("source <> 'main'").select("id", "chrom", "pos")])
    at = place(s, "shards")
    one.write.parquet(at)
    return s.sparkSession.read.parquet(at)


add("a8_concat_shards", "sites", shards, "SELECT id, chrom, pos FROM {sites}")


def checked_shards(s):
    """Two text shards with one header, read with their headers checked."""
    at = place(s, "text-shards")
    for name, part in (("main", F.col("source") == "main"), ("rest", F.col("source") != "main")):
        T.write_table(s.where(part), f"{at}/{name}", ["chrom", "pos", "id"])
    return longs(T.read_shards(s.sparkSession, [f"{at}/main", f"{at}/rest"], ["chrom", "pos", "id"]), "pos")


add("a8_read_shards", "sites", checked_shards, "SELECT chrom, pos, id FROM {sites}")
WINDOW = "'chr' || CAST(s_suppkey % 22 + 1 AS VARCHAR)"
asked = lambda s: s.select(F.col("s_suppkey").alias("window"), F.concat(F.lit("chr"), F.col("s_suppkey") % 22 + 1).alias("chrom"), (F.col("s_suppkey") * 31).alias("start"), (F.col("s_suppkey") * 31 + 4000).alias("end"))


def positioned(a, s):
    at = place(a, "positions")
    T.write_positioned(a.select("phenotype", "arm", "chrom", "pos", "marker", "p"), at, ("phenotype",), 40_000)
    return T.read_windows(a.sparkSession, at, asked(s), 40_000).groupBy("phenotype", "arm", "window").agg(F.count("*").alias("n"), F.round(F.min("p"), 6).alias("p"))


add(
    "a10_position_layout", "assoc supplier", positioned,
    f"SELECT phenotype, arm, s_suppkey AS \"window\", count(*) AS n, round(min(p), 6) AS p FROM {{assoc}} JOIN {{supplier}} ON chrom = {WINDOW} AND pos BETWEEN s_suppkey * 31 AND s_suppkey * 31 + 4000 GROUP BY 1, 2, 3",
)


def tables_written(a, s):
    """The site, the allele and the association table, each in its columns' order with its own text for null, read back as text."""
    out = None
    for name, df, columns, null in (
        ("sites", s.select("chrom", "pos", "id", "svtype", F.col("svlen").cast("string").alias("svlen")), ["chrom", "pos", "id", "svtype", "svlen"], "NA"),
        ("alleles", s.select("id", "ref", "alt"), ["id", "ref", "alt"], "."),
        ("assoc", a.select("phenotype", "marker", F.round("p", 6).alias("p"), F.round("p3", 6).alias("p3")), ["phenotype", "marker", "p", "p3"], ""),
    ):
        at = place(a, name)
        T.write_table(df, at, columns, null)
        read = T.read_shards(a.sparkSession, at, columns)
        last = F.col(columns[-1])
        told = read.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_if(last == null if null else last.isNull()).alias("gone"))
        out = told if out is None else out.unionByName(told)
    return out


add(
    "a10_write_tables", "assoc sites", tables_written,
    "SELECT 'sites' AS name, count(*) AS n, count(*) FILTER (WHERE svlen IS NULL) AS gone FROM {sites} UNION ALL SELECT 'alleles', count(*), 0 FROM {sites} UNION ALL SELECT 'assoc', count(*), count(*) FILTER (WHERE p3 IS NULL) FROM {assoc}",
)


def by_sample(c):
    at = place(c, "by-sample")
    T.write_by_sample(c.where("sample < 40").select("sample", "chrom", "pos", "a1", "a2"), at)
    return c.sparkSession.read.parquet(at).groupBy(F.col("sample").cast("bigint").alias("sample")).agg(F.count("*").alias("n"), F.sum("pos").alias("pos"))


add("a9_by_sample", "calls", by_sample, "SELECT sample, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos FROM {calls} WHERE sample < 40 GROUP BY 1")


def hit_store(a):
    at = place(a, "hits")
    a.where("p < 0.2").select("phenotype", "marker", "pos", "p").write.partitionBy("phenotype").parquet(at)
    return T.read_hits(a.sparkSession, at, "NO").groupBy("phenotype").agg(F.count("*").alias("n"), F.round(F.min("p"), 6).alias("p"))


add("a10_hit_store", "assoc", hit_store, "SELECT phenotype, count(*) AS n, round(min(p), 6) AS p FROM {assoc} WHERE p < 0.2 AND phenotype = 'NO' GROUP BY 1")


def resumed(s):
    at, made = place(s, "stage"), []

    def make():
        made.append(1)
        return s.groupBy("svtype").agg(F.count("*").alias("n"))

    for params in ({"v": 1}, {"v": 1}, {"v": 2}):
        got = T.checkpointed(s.sparkSession, at, params, make)
    return got.withColumn("made", F.lit(len(made)).cast("bigint"))


add("a12_resume", "sites", resumed, "SELECT svtype, count(*) AS n, CAST(2 AS BIGINT) AS made FROM {sites} GROUP BY 1")

# --- repeat units
SPANS = "SELECT id, chrom, pos - 1 AS start0, greatest(end0, pos) AS end0, svtype, svlen AS change, '' AS seq FROM {sites}"
spans = lambda s: s.select("id", "chrom", (F.col("pos") - 1).alias("start0"), F.greatest("end0", "pos").alias("end0"), "svtype", F.col("svlen").alias("change"), F.lit("").alias("seq"))
add(
    "b16_repeat_units", "sites catalog", lambda s, c: L.annotate_repeat_units(spans(s), c).select("id", "period", "units"),
    f"""WITH s AS ({SPANS}), p AS (SELECT s.id, period, row_number() OVER (PARTITION BY s.id ORDER BY least(s.end0, c.end0) - greatest(s.start0, c.start0) DESC, period) AS r FROM s JOIN {{catalog}} c ON c.chrom = s.chrom AND c.start0 < s.end0 AND s.start0 < c.end0
       WHERE svtype IN ('INS', 'DEL', 'DUP') AND change <> 0 AND change % period = 0) SELECT s.id, period, CAST(sign(change) * (abs(change) // period) AS BIGINT) AS units FROM s LEFT JOIN p ON p.id = s.id AND r = 1""",
)
add(
    "b18_allele_units", "sites", lambda s: s.select("id", L.allele_units(F.lit(10), F.array(F.col("size"), F.lit(10).cast("bigint")), "svtype", F.array(F.lit(3).cast("bigint"), F.col("size"))).alias("u")).select("id", F.col("u")[0].alias("u0"), F.col("u")[1].alias("u1"), F.col("u")[2].alias("u2")),
    "SELECT id, CAST(0 AS BIGINT) AS u0, CAST(3 * CASE WHEN size > 10 THEN 1 WHEN size < 10 THEN -1 WHEN svtype = 'DEL' THEN -1 WHEN svtype IN ('INS', 'DUP') THEN 1 ELSE 0 END AS BIGINT) AS u1, CAST(size * CASE WHEN svtype = 'DEL' THEN -1 WHEN svtype IN ('INS', 'DUP') THEN 1 ELSE 0 END AS BIGINT) AS u2 FROM {sites}",
)
add(
    "b24_longest_pure", "sites", lambda s: s.select("id", R.lps_bp(F.concat(F.repeat(F.lit("CAG"), F.col("size").cast("int")), F.lit("T"), F.repeat(F.lit("AGC"), F.lit(3)), "alt"), "CAG").cast("bigint").alias("bp")),
    "SELECT id, CAST(list_max(list_transform(regexp_extract_all(x, '(?:CAG)+') || regexp_extract_all(x, '(?:AGC)+') || regexp_extract_all(x, '(?:GCA)+'), lambda t: length(t))) AS BIGINT) AS bp FROM (SELECT id, repeat('CAG', CAST(size AS INT)) || 'T' || repeat('AGC', 3) || alt AS x FROM {sites})",
)
add(
    "b27_repeat_definitions", "catalog", lambda c: L.repeat_definitions(c.select("chrom", (F.col("start0") - F.col("period") % 2).alias("pos"), F.col("end0").alias("end"), "locus", F.repeat(F.lit("CAG"), F.col("period").cast("int")).alias("motifs")), c),
    "SELECT locus, chrom || chr(9) || CAST(start0 - period % 2 AS VARCHAR) || chr(9) || CAST(end0 AS VARCHAR) || chr(9) || 'ID=' || locus || ';MOTIFS=' || repeat('CAG', CAST(period AS INT)) || ';STRUC=(' || repeat('CAG', CAST(period AS INT)) || ')n' AS row, period % 2 = 0 AS agrees FROM {catalog}",
)

# --- reads and loci
add(
    "c10_lookup_locus", "sites catalog", lambda s, c: L.lookup_locus(spans(s), c),
    f"""WITH s AS ({SPANS}) SELECT id, locus, overlap, n > 1 AS ambiguous FROM (SELECT s.id, c.locus, least(s.end0, c.end0) - greatest(s.start0, c.start0) AS overlap, count(*) OVER (PARTITION BY s.id) AS n,
       row_number() OVER (PARTITION BY s.id ORDER BY least(s.end0, c.end0) - greatest(s.start0, c.start0) DESC, locus) AS r FROM s JOIN {{catalog}} c ON c.chrom = s.chrom AND c.start0 < s.end0 AND s.start0 < c.end0) WHERE r = 1""",
)
READS = """reads AS (SELECT l_orderkey * 10 + l_linenumber AS read, l_partkey % 40 AS locus, CASE WHEN l_suppkey % 5 = 4 THEN NULL ELSE l_suppkey % 2 END AS slot FROM {lineitem}),
       tags AS (SELECT l_orderkey * 10 + l_linenumber AS read, CASE WHEN l_quantity % 7 = 0 THEN NULL ELSE CASE WHEN l_quantity % 5 = 0 THEN 2 - l_suppkey % 2 ELSE 1 + l_suppkey % 2 END END AS hap FROM {lineitem} WHERE l_quantity % 11 <> 0)"""
VOTES = """votes AS (SELECT locus, CASE WHEN reason = 'vote' THEN slot END AS slot, CASE WHEN reason = 'vote' THEN hap END AS hap, reason, count(*) AS n FROM (SELECT r.*, t.hap, CASE WHEN t.n IS NULL THEN 'not tagged' WHEN t.n > 1 OR r.n > 1 THEN 'several' WHEN t.hap IS NULL THEN 'no haplotype' WHEN slot IS NULL THEN 'no slot' ELSE 'vote' END AS reason
       FROM (SELECT *, count(*) OVER (PARTITION BY read, locus) AS n FROM reads) r LEFT JOIN (SELECT read, min(hap) AS hap, count(*) AS n FROM tags GROUP BY 1) t USING (read)) GROUP BY ALL)"""


def votes(l):
    read = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read")
    reads = l.select(read, (F.col("l_partkey") % 40).alias("locus"), F.when(F.col("l_suppkey") % 5 != 4, F.col("l_suppkey") % 2).alias("slot"))
    hap = F.when(F.col("l_quantity") % 5 == 0, 2 - F.col("l_suppkey") % 2).otherwise(1 + F.col("l_suppkey") % 2)
    return L.collect_votes(reads, l.where("l_quantity % 11 <> 0").select(read, F.when(F.col("l_quantity") % 7 != 0, hap).alias("hap")))


add("c11_read_votes", "lineitem", votes, f"WITH {READS}, {VOTES} SELECT * FROM votes")
add(
    "h11_slot_assignment", "lineitem", lambda l: L.assign_slots(votes(l).where("reason = 'vote'"), 3, 0.7),
    f"""WITH {READS}, {VOTES}, m AS (SELECT locus, slot, CASE WHEN sum(n) >= 3 AND max(n) >= 0.7 * sum(n) THEN arg_max(hap, n * 10 - hap) END AS hap FROM votes WHERE reason = 'vote' GROUP BY 1, 2), w AS (SELECT locus, max(CASE WHEN slot = 0 THEN hap END) AS hap0, max(CASE WHEN slot = 1 THEN hap END) AS hap1 FROM m GROUP BY 1)
       SELECT locus, hap0, hap1, coalesce(hap0 <> hap1, FALSE) AS phased FROM w""",
)

# --- locus tables
DOSE = "d AS (SELECT l_partkey % 50 AS locus, o_custkey AS sample, CAST(sum(CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_suppkey % 7 - 3 END) AS BIGINT) AS dosage, l_returnflag AS run FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2, 4)"
dose = lambda l, o: l.join(o, l["l_orderkey"] == o["o_orderkey"]).groupBy((F.col("l_partkey") % 50).alias("locus"), F.col("o_custkey").alias("sample"), F.col("l_returnflag").alias("run")).agg(F.sum(F.when(F.col("l_suppkey") % 11 != 0, F.col("l_suppkey") % 7 - 3)).alias("dosage"))
add(
    "c21_compare_locus_dosage", "lineitem orders", lambda l, o: L.dosage_agreement(L.compare_locus_dosage(dose(l, o).where("run = 'R'"), dose(l, o).where("run = 'N'").drop("run"))),
    f"""WITH {DOSE}, a AS (SELECT * FROM d WHERE run = 'R'), b AS (SELECT * FROM d WHERE run = 'N' AND dosage IS NOT NULL), j AS (SELECT b.locus, b.dosage, a.locus IS NULL AS absent, coalesce(a.dosage, 0) AS other FROM b LEFT JOIN a ON a.locus = b.locus AND a.sample = b.sample WHERE a.locus IS NULL OR a.dosage IS NOT NULL)
       SELECT locus, count(*) AS n, count(*) FILTER (WHERE dosage = other) AS equal, count(*) FILTER (WHERE absent) AS absent, CAST(sum(abs(dosage - other)) AS BIGINT) AS apart FROM j GROUP BY 1""",
)
add(
    "c29_pair_agreement", "lineitem orders", lambda l, o: L.pair_agreement(*(dose(l, o).where(f"run = '{r}'").select("locus", "sample", (F.col("dosage") * 7).alias("x"), (F.col("dosage") * F.lit(y)).alias("y")) for r, y in (("R", 0), ("N", 0)))),
    f"""WITH {DOSE}, j AS (SELECT a.dosage * 7 AS x, b.dosage * 7 AS x2 FROM d a JOIN d b USING (locus, sample) WHERE a.run = 'R' AND b.run = 'N' AND a.dosage IS NOT NULL AND b.dosage IS NOT NULL),
       c AS (SELECT CASE WHEN greatest(abs(x), abs(x2)) = 0 THEN '0' WHEN greatest(abs(x), abs(x2)) < 20 THEN '1-19' WHEN greatest(abs(x), abs(x2)) < 50 THEN '20-49' ELSE '>=50' END AS size, x = x2 AS same FROM j) SELECT size, count(*) AS n, count(*) FILTER (WHERE same) AS equal FROM c GROUP BY 1""",
)
add(
    "c25_submission_sites", "orders customer", lambda o, c: r6(L.submission_sites(o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("group"), F.col("o_custkey").alias("person"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("c_mktsegment")).alias("site")), 0.2), "share").select("group", "site", "n", "share"),
    """WITH v AS (SELECT c_nationkey AS g, o_custkey AS person, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority ELSE c_mktsegment END AS site FROM {orders} JOIN {customer} ON o_custkey = c_custkey), c AS (SELECT g, person, min(site) AS site FROM v GROUP BY 1, 2 HAVING count(DISTINCT site) = 1),
       n AS (SELECT g, site, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY g) AS share, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, site) AS r FROM c GROUP BY 1, 2) SELECT g AS "group", site, n, round(share, 6) AS share FROM n WHERE r = 1 AND share >= 0.2""",
)
add(
    "c25_choose_uri", "orders", lambda o: L.choose_uri(o.select(F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("site"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("uri")), ["3-MEDIUM", "1-URGENT"]),
    "SELECT person, site, uri FROM (SELECT o_custkey AS person, o_orderpriority AS site, 'u' || CAST(o_orderkey AS VARCHAR) AS uri, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, 'u' || CAST(o_orderkey AS VARCHAR)) AS r FROM {orders}) WHERE r = 1",
)
add(
    "c31_enrich_ids", "customer orders", lambda c, o: c.select(F.col("c_custkey").alias("id")).join(L.first_rows(o.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("batch"), F.when(F.col("o_orderkey") % 2 == 0, "XX").otherwise("XY").alias("karyotype")), "id"), "id", "left").select("id", "batch", F.when(F.col("karyotype") == "XX", "F").when(F.col("karyotype") == "XY", "M").alias("sex")),
    "SELECT c_custkey AS id, batch, CASE k WHEN 'XX' THEN 'F' WHEN 'XY' THEN 'M' END AS sex FROM {customer} LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch, k) AS r FROM (SELECT o_custkey AS id, o_orderpriority AS batch, CASE WHEN o_orderkey % 2 = 0 THEN 'XX' ELSE 'XY' END AS k FROM {orders})) ON id = c_custkey AND r = 1",
)
add(
    "c19_merge_pcs", "samples embeddings supplier",
    lambda s, e, p: L.merge_pcs(s.where("NOT control").select("sample", "ancestry"), e.where("embedding IS NOT NULL").groupBy(F.col("vec_id").alias("sample")).agg(F.round(F.min(F.col("embedding")[0].cast("double")), 4).alias("pc1")), p.select((F.col("s_suppkey") + 1_000_000).alias("sample"), F.lit("eur").alias("ancestry")), "sample"),
    """WITH b AS (SELECT sample, ancestry, FALSE AS is_reference_control FROM {samples} WHERE NOT control UNION ALL SELECT s_suppkey + 1000000, 'eur', TRUE FROM {supplier}), p AS (SELECT vec_id, round(min(CAST(embedding[1] AS DOUBLE)), 4) AS pc1 FROM {embeddings} WHERE embedding IS NOT NULL GROUP BY 1)
       SELECT sample, ancestry, pc1, vec_id IS NOT NULL AS has_lr_pcs, is_reference_control FROM b LEFT JOIN p ON vec_id = sample""",
)
EDGES = [0, 50, 100, 500, 1000, 2000, 5000, 10_000, 20_000, 100_000]


def spectrum(s):
    got = L.bin_spectrum(s.select(F.abs("svlen").alias("n")), "n", EDGES, 40)
    return s.sparkSession.createDataFrame([(float(a), float(b), int(n)) for a, b, n in got], "low double, high double, n long")


add("d8_binned_spectrum", "sites", spectrum)
add(
    "d11_locus_qc", "haps", lambda h: C.locus_qc(C.locus_dosage(h.select((F.col("site") % 97).alias("locus"), "sample", "hap", F.col("site").alias("rec"), ((F.col("allele") * 3) * (F.col("site") % 5 - 2)).alias("bp"), (F.col("site") % 4 != 0).alias("phased"), (F.col("site") % 2 == 0).alias("size_sv")))),
    """WITH r AS (SELECT site % 97 AS locus, sample, hap, site AS rec, allele * 3 * (site % 5 - 2) AS bp, site % 4 <> 0 AS phased, site % 2 = 0 AS v FROM {haps}), u AS (SELECT locus, sample FROM (SELECT locus, sample, rec FROM r WHERE NOT phased GROUP BY 1, 2, 3 HAVING count(bp) = 2 AND min(bp) <> max(bp)) GROUP BY 1, 2 HAVING count(*) >= 2),
       h AS (SELECT locus, sample, count(*) FILTER (WHERE bp <> 0) AS changes, count(*) = count(bp) AND ((count(*) FILTER (WHERE v AND bp > 0) > 0 AND count(*) FILTER (WHERE NOT v AND bp > 0) > 0) OR (count(*) FILTER (WHERE v AND bp < 0) > 0 AND count(*) FILTER (WHERE NOT v AND bp < 0) > 0)) AS duplicate FROM r GROUP BY locus, sample, hap)
       SELECT h.locus, count(*) FILTER (WHERE changes > 1) AS n_multi_record, count(*) FILTER (WHERE duplicate) AS n_duplicate, count(*) FILTER (WHERE u.locus IS NOT NULL) AS n_ambiguous, count(*) AS n_hap FROM h LEFT JOIN u ON u.locus = h.locus AND u.sample = h.sample GROUP BY 1""",
)
CALLS2 = "c AS (SELECT 'L' || CAST(site AS VARCHAR) AS locus, sample % 20 AS sample, site * 100 + sample AS pos, CASE WHEN a1 IS NULL THEN NULL ELSE a1 * 3 END AS d1, a2 * 2 AS d2 FROM {calls} WHERE a1 IS NOT NULL OR a2 IS NULL)"
add(
    "d12_allele_counts", "calls catalog samples",
    lambda c, k, s: L.allele_counts(c.where("a1 IS NOT NULL OR a2 IS NULL").select(F.concat(F.lit("L"), F.col("site").cast("string")).alias("locus"), (F.col("sample") % 20).alias("sample"), (F.col("site") * 100 + F.col("sample")).alias("pos"), (F.col("a1") * 3).alias("d1"), (F.col("a2") * 2).alias("d2")), k, s.select((F.col("sample") % 20).alias("sample"))),
    f"""WITH {CALLS2}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY locus, sample ORDER BY pos, d1 NULLS LAST, d2 NULLS LAST) AS r FROM c) WHERE r = 1), h AS (SELECT locus, d1 AS dosage FROM o UNION ALL SELECT locus, d2 FROM o WHERE d2 IS NOT NULL OR d1 IS NULL), n AS (SELECT locus, dosage, count(*) AS n FROM h GROUP BY 1, 2),
       x AS (SELECT k.locus, NULL AS dosage, 2 * ((SELECT count(DISTINCT sample % 20) FROM {{samples}}) - count(o.sample)) AS n FROM {{catalog}} k LEFT JOIN o USING (locus) GROUP BY 1) SELECT locus, dosage, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM n UNION ALL SELECT * FROM x WHERE n > 0) GROUP BY 1, 2""",
)
add(
    "d17_select_examples", "catalog", lambda c: L.select_examples(c.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.desc(F.col("end0") - F.col("start0")), "locus")).cast("bigint")), (F.col("end0") - F.col("start0") >= 18) & (F.col("period") <= 5), "period", 4).select("locus", "period", "rank"),
    "SELECT locus, period, rank FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY rank) AS r FROM (SELECT *, row_number() OVER (ORDER BY end0 - start0 DESC, locus) AS rank FROM {catalog}) WHERE end0 - start0 >= 18 AND period <= 5) WHERE r = 1 ORDER BY rank LIMIT 4",
)
add(
    "d65_repeat_qc_report", "haps", lambda h: r6(L.repeat_qc_report(h.groupBy("chrom", "site").agg(F.count("*").alias("n_hap"), F.count_if(F.expr("allele IS NULL")).alias("missing"), F.count_if(F.expr("anc IS NULL")).alias("inconsistent"), F.count_if(F.expr("allele = 1 AND hap = 1")).alias("duplicate"))), "missing_share", "duplicate_share", "inconsistent_share"),
    "SELECT chrom, count(*) AS n_hap, round(CAST(count(*) FILTER (WHERE allele IS NULL) AS DOUBLE) / count(*), 6) AS missing_share, round(CAST(count(*) FILTER (WHERE allele = 1 AND hap = 1) AS DOUBLE) / count(*), 6) AS duplicate_share, round(CAST(count(*) FILTER (WHERE anc IS NULL) AS DOUBLE) / count(*), 6) AS inconsistent_share FROM {haps} GROUP BY 1",
)
add(
    "d68_corr2_crosstab", "assoc", lambda a: L.corr2_crosstab(a.select(F.col("p").alias("freq"), F.col("p2").alias("r2")), [0.1, 0.5], [0.2, 0.8]),
    "SELECT freq_class, r2_class, count(*) AS n FROM (SELECT CAST((p >= 0.1)::INT + (p >= 0.5)::INT AS BIGINT) AS freq_class, CAST((p2 >= 0.2)::INT + (p2 >= 0.8)::INT AS BIGINT) AS r2_class FROM {assoc}) GROUP BY CUBE (freq_class, r2_class)",
)

# --- samples
TS = "length(ref) = 1 AND length(alt) = 1 AND ref <> alt AND (coalesce(a1, 0) > 0 OR coalesce(a2, 0) > 0)"
COUNT = f"""sample, count(*) FILTER (WHERE a1 <> a2) AS n_het, count(*) FILTER (WHERE a1 = a2 AND a1 > 0) AS n_hom, count(*) FILTER (WHERE a1 IS NULL OR a2 IS NULL) AS n_missing, count(*) FILTER (WHERE {TS} AND least(ref, alt) || greatest(ref, alt) IN ('AG', 'CT')) AS ts,
       count(*) FILTER (WHERE {TS} AND least(ref, alt) || greatest(ref, alt) NOT IN ('AG', 'CT')) AS tv FROM {{calls}} c JOIN (SELECT site, ref, alt FROM {{sites}}) s USING (site)"""
add("d21_sample_counters", "calls sites", L.sample_counters, f"SELECT {COUNT} GROUP BY 1")
add(
    "d20_sample_qc", "calls sites", lambda c, s: r6(L.sample_qc(c.join(s.select("site", "ref", "alt"), "site").groupBy("sample", "chrom").agg(F.count_if(F.expr("a1 <> a2")).alias("n_het"), F.count_if(F.expr("a1 = a2 AND a1 > 0")).alias("n_hom"), F.count_if(F.expr("ref = 'A' AND alt = 'A'")).alias("ts"), F.count_if(F.expr("a1 > 0")).alias("tv"))), "auto_titv", "auto_het_hom", "all_titv", "all_het_hom"),
    """WITH c AS (SELECT sample, count(*) FILTER (WHERE a1 <> a2) AS h, count(*) FILTER (WHERE a1 = a2 AND a1 > 0) AS o, count(*) FILTER (WHERE ref = 'A' AND alt = 'A') AS s, count(*) FILTER (WHERE a1 > 0) AS v FROM {calls} JOIN (SELECT site, ref, alt FROM {sites}) x USING (site) GROUP BY 1), r AS (SELECT sample, h + o AS n, round(CAST(s AS DOUBLE) / nullif(v, 0), 6) AS t, round(CAST(h AS DOUBLE) / nullif(o, 0), 6) AS z FROM c)
       SELECT sample, n AS auto_variants, t AS auto_titv, z AS auto_het_hom, n AS all_variants, t AS all_titv, z AS all_het_hom FROM r""",
)
add(
    "d23_sample_strata", "samples", lambda s: r6(L.sample_strata(s, "balance", {"all": F.lit(True), "case": ~F.col("control"), "afr": F.col("ancestry") == "afr"}), "mean", "sd"),
    "SELECT stratum, count(balance) AS n, round(avg(balance), 6) AS mean, round(stddev_samp(balance), 6) AS sd FROM (SELECT balance, 'all' AS stratum FROM {samples} UNION ALL SELECT balance, 'case' FROM {samples} WHERE NOT control UNION ALL SELECT balance, 'afr' FROM {samples} WHERE ancestry = 'afr') GROUP BY 1",
)

# --- families
MEMBERS = "m AS (SELECT CAST((child - child % 4) / 4 AS BIGINT) AS family, child AS member, CAST((CASE WHEN father > 0 AND child % 4 >= 2 THEN 1 ELSE 0 END) + (CASE WHEN mother > 0 AND child % 4 >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS parents, CASE WHEN child % 12 = 3 THEN 2 ELSE child % 2 END AS depth FROM {ped} WHERE child % 20 <> 7)"
members = lambda p: p.where("child % 20 <> 7").select(((F.col("child") - F.col("child") % 4) / 4).cast("bigint").alias("family"), F.col("child").alias("member"), ((F.col("father") > 0).cast("bigint") * (F.col("child") % 4 >= 2).cast("bigint") + (F.col("mother") > 0).cast("bigint") * (F.col("child") % 4 >= 2).cast("bigint")).alias("parents"), F.when(F.col("child") % 12 == 3, 2).otherwise(F.col("child") % 2).alias("depth"))
add(
    "d60_family_class", "ped", lambda p: L.classify_families(members(p).drop("depth"), members(p).select("member", "depth")),
    f"WITH {MEMBERS}, t AS (SELECT family, count(*) AS n, count(*) FILTER (WHERE parents = 2) AS children, max(depth) AS deep FROM m GROUP BY 1) SELECT family, n, children, CASE WHEN children = 0 THEN 'incomplete' WHEN deep > 1 THEN 'multi-generational' WHEN n = 3 AND children = 1 THEN 'trio' WHEN n = 4 AND children = 2 THEN 'quartet' ELSE 'other' END AS kind FROM t",
)
add(
    "d44_complete_families", "ped samples", lambda p, s: L.complete_families(members(p).select("family", "member"), s.where("NOT control").select(F.col("sample").alias("member"))),
    f"WITH {MEMBERS}, o AS (SELECT sample FROM {{samples}} WHERE NOT control), t AS (SELECT family, count(*) AS size, count(o.sample) AS n FROM m LEFT JOIN o ON o.sample = m.member GROUP BY 1) SELECT family, member, size FROM m JOIN t USING (family) WHERE size = n",
)
SIX = """w AS MATERIALIZED (SELECT chrom, pos, sample, max(anc) FILTER (WHERE hap = 1) AS x, max(anc) FILTER (WHERE hap = 2) AS y FROM {lai} WHERE anc IS NOT NULL GROUP BY 1, 2, 3 HAVING x IS NOT NULL AND y IS NOT NULL),
       c AS MATERIALIZED (SELECT p.child, p.father, p.mother, c.chrom, c.pos, c.x AS c1, c.y AS c2 FROM {ped} p JOIN w c ON c.sample = p.child WHERE p.father <> 0 AND p.mother <> 0),
       cf AS MATERIALIZED (SELECT c.*, f.x AS f1, f.y AS f2 FROM c JOIN w f ON f.sample = c.father AND f.chrom = c.chrom AND f.pos = c.pos),
       s AS MATERIALIZED (SELECT cf.child, cf.chrom, cf.pos, c1 IN (f1, f2) AND c2 IN (m.x, m.y) AS one, c2 IN (f1, f2) AND c1 IN (m.x, m.y) AS two FROM cf JOIN w m ON m.sample = cf.mother AND m.chrom = cf.chrom AND m.pos = cf.pos),
       q AS (SELECT *, CASE WHEN one AND NOT two THEN 1 WHEN two AND NOT one THEN 2 END AS forced, (one OR two) AND count(*) FILTER (WHERE one OR two) OVER (PARTITION BY child, chrom ORDER BY pos) = 1 AS lead FROM s),
       z AS (SELECT *, coalesce(forced <> last_value(coalesce(forced, CASE WHEN lead THEN 1 END) IGNORE NULLS) OVER (PARTITION BY child, chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS flip FROM q),
       scored AS (SELECT child, count(*) AS loci, count(*) FILTER (WHERE NOT one AND NOT two) AS violations, count(*) FILTER (WHERE flip) AS flips FROM z GROUP BY 1)"""
add("d43_mendelian_score", "lai ped", C.mendelian_score, f"WITH {SIX} SELECT * FROM scored")
def interval_sql(rows: str, key: str, top: str, bottom: str) -> str:
    """SELECT of ratio, draws, low and high over 200 resamples with the operator's own weights."""
    return f"""d AS (SELECT draw, sum(w * t) / sum(w * b) AS r FROM (SELECT draw, {top} AS t, {bottom} AS b, {M.weights_sql(key, "draw")} AS w FROM {rows}, range(1, 201) AS x(draw)) GROUP BY draw HAVING sum(w * b) > 0)
       SELECT round((SELECT sum({top}) / sum({bottom}) FROM {rows}), 6) AS ratio, count(*) AS draws, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM d"""


add("d46_trio_ratio", "lai ped", lambda h, p: r6(M.ratio_interval(C.mendelian_score(h, p), "child", "violations", "loci"), "ratio", "low", "high"), f"WITH {SIX}, f AS MATERIALIZED (SELECT child, CAST(violations AS DOUBLE) AS v, CAST(loci AS DOUBLE) AS n FROM scored), {interval_sql('f', 'child', 'v', 'n')}")
add("d47_mean_interval", "samples", lambda s: r6(M.ratio_interval(s, "sample", "balance", None), "ratio", "low", "high"), f"WITH f AS MATERIALIZED (SELECT sample, balance, 1.0e0 AS one FROM {{samples}} WHERE balance IS NOT NULL), {interval_sql('f', 'sample', 'balance', 'one')}")
GENETIC = "SELECT DISTINCT chrom, pos, CAST(pos AS DOUBLE) * pos / 1.0e8 AS cm FROM {markers}"
add(
    "d45_expected_crossovers", "catalog markers", lambda c, m: r6(L.expected_crossovers(c.select(F.col("locus").alias("id"), "chrom", "start0", "end0"), m.select("chrom", "pos", (F.col("pos").cast("double") * F.col("pos") / 1e8).alias("cm")).distinct(), 2), "crossovers"),
    f"""WITH g AS ({GENETIC}), e AS (SELECT locus AS id, chrom, 0 AS side, start0 AS pos FROM {{catalog}} UNION ALL SELECT locus, chrom, 1, end0 FROM {{catalog}}), b AS (SELECT e.*, (SELECT max(pos) FROM g WHERE g.chrom = e.chrom AND g.pos <= e.pos) AS p0, (SELECT min(pos) FROM g WHERE g.chrom = e.chrom AND g.pos >= e.pos) AS p1, (SELECT max(pos) FROM g WHERE g.chrom = e.chrom) AS top FROM e),
       a AS (SELECT id, side, CASE WHEN p1 IS NULL THEN CAST(top AS DOUBLE) * top / 1.0e8 WHEN p0 IS NULL OR p0 = p1 THEN CAST(p1 AS DOUBLE) * p1 / 1.0e8 ELSE CAST(p0 AS DOUBLE) * p0 / 1.0e8 + (CAST(p1 AS DOUBLE) * p1 - CAST(p0 AS DOUBLE) * p0) / 1.0e8 * (pos - p0) / (p1 - p0) END AS cm FROM b)
       SELECT id, round((max(cm) FILTER (WHERE side = 1) - max(cm) FILTER (WHERE side = 0)) / 100 * 2, 6) AS crossovers FROM a GROUP BY 1""",
)
MODELS = "SELECT l_returnflag AS g, l_linestatus || CAST(l_linenumber AS VARCHAR) AS model, 0.8e0 + avg(l_discount) * 6 AS lam, 0.79e0 + avg(l_discount) * 6 AS low, 0.81e0 + avg(l_discount) * 6 AS high, -sum(l_quantity) AS loglik FROM {lineitem} GROUP BY 1, 2"
add(
    "d48_pick_winner", "lineitem", lambda l: L.pick_winner(l.groupBy(F.col("l_returnflag").alias("group"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("model")).agg((0.8 + F.avg("l_discount") * 6).alias("lam"), (-F.sum("l_quantity")).alias("loglik")).withColumns({"low": F.col("lam") - 0.01, "high": F.col("lam") + 0.01})).select("group", "model", F.round("lam", 6).alias("lam")),
    f"""WITH m AS ({MODELS}), t AS (SELECT g, arg_min(low, (abs(lam - 1), model)) AS l0, arg_min(high, (abs(lam - 1), model)) AS h0 FROM m GROUP BY 1) SELECT g AS "group", model, round(lam, 6) AS lam FROM (SELECT m.*, row_number() OVER (PARTITION BY m.g ORDER BY loglik DESC, model) AS r FROM m JOIN t ON t.g = m.g WHERE low <= h0 AND l0 <= high) WHERE r = 1""",
)
add(
    "d49_models_table", "haps samples", lambda h, s: r6(L.models_table([C.global_props(h.join(s.where(f"ancestry = '{a}'").select("sample"), "sample")).groupBy("anc").agg(F.avg("share").alias("share")).withColumn("population", F.lit(a)) for a in ("afr", "amr", "eas", "eur", "sas")]), "share"),
    "WITH p AS (SELECT sample, anc, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY sample) AS share FROM {haps} WHERE anc IS NOT NULL GROUP BY 1, 2) SELECT anc, round(avg(share), 6) AS share, ancestry AS population FROM p JOIN {samples} USING (sample) GROUP BY 1, 3",
)

# --- local ancestry
add(
    "e3_nearest_het", "haps calls", lambda h, c: L.nearest_het(longs(C.switches(h), "hap"), c.select("sample", "chrom", "pos", F.coalesce(F.col("a1") != F.col("a2"), F.lit(False)).alias("het"))),
    f"""WITH {SW}, c AS (SELECT DISTINCT sample, chrom, pos FROM {{calls}} WHERE a1 <> a2), n AS (SELECT sw.sample, sw.hap, sw.chrom, sw.pos, max(c.pos) FILTER (WHERE c.pos <= sw.pos) AS x, min(c.pos) FILTER (WHERE c.pos >= sw.pos) AS y FROM sw LEFT JOIN c ON c.sample = sw.sample AND c.chrom = sw.chrom GROUP BY 1, 2, 3, 4)
       SELECT sample, hap, chrom, pos, CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x WHEN pos - x <= y - pos THEN x ELSE y END AS het_pos FROM n""",
)
add(
    "d34_switch_quality", "haps calls", lambda h, c: r6(L.switch_quality(c, C.switches(h)), "gq", "gq_low", "dp", "sentinel"),
    f"""WITH {SW}, a AS (SELECT DISTINCT sample, chrom, pos FROM sw), j AS (SELECT c.*, a.pos IS NOT NULL AS is_switch, CASE WHEN a1 IS NULL OR a2 IS NULL THEN 'missing' WHEN a1 <> a2 THEN 'het' WHEN a1 = 0 THEN 'hom_ref' ELSE 'hom_alt' END AS gt_class FROM {{calls}} c LEFT JOIN a ON a.sample = c.sample AND a.chrom = c.chrom AND a.pos = c.pos)
       SELECT is_switch, gt_class, count(*) AS n, round(avg(gq), 6) AS gq, round(CAST(count(*) FILTER (WHERE gq < 20) AS DOUBLE) / nullif(count(gq), 0), 6) AS gq_low, round(avg(dp), 6) AS dp, round(avg(CASE WHEN rnc = 'I.' THEN 1.0e0 ELSE 0.0e0 END), 6) AS sentinel FROM j GROUP BY 1, 2""",
)
LSW = SW.replace("{haps}", "{lai}")
add(
    "d35_complementary_flips", "lai", lambda h: L.complementary_flips(C.switches(h)),
    f"""WITH {LSW}, w AS (SELECT sample, chrom, pos, max(from_anc) FILTER (WHERE hap = 1) AS f1, max(to_anc) FILTER (WHERE hap = 1) AS t1, max(from_anc) FILTER (WHERE hap = 2) AS f2, max(to_anc) FILTER (WHERE hap = 2) AS t2 FROM sw GROUP BY 1, 2, 3)
       SELECT sample, count(*) AS "both", count(*) FILTER (WHERE f1 = t2 AND f2 = t1) AS swapped FROM w WHERE t1 IS NOT NULL AND t2 IS NOT NULL GROUP BY 1""",
)
add(
    "d71_switch_density", "haps samples", lambda h, s: r6(L.switch_density(C.switches(h), s, 3.0), "rate"),
    f"WITH {SW}, n AS (SELECT sample, count(*) AS n FROM sw GROUP BY 1) SELECT ancestry, count(*) AS samples, CAST(sum(coalesce(n, 0)) AS BIGINT) AS switches, round(CAST(sum(coalesce(n, 0)) AS DOUBLE) / (count(*) * 6.0e0), 6) AS rate FROM {{samples}} LEFT JOIN n USING (sample) GROUP BY 1",
)
PANEL = "SELECT DISTINCT chrom, pos, k AS anc, CAST((pos + k * 37) % 11 AS DOUBLE) / 10 AS af FROM {lai} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) x"
add(
    "d36_allele_ancestry", "lai", lambda h: r6(L.allele_ancestry_score(h, h.select("chrom", "pos").distinct().select("chrom", "pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("anc")).withColumn("af", ((F.col("pos") + F.col("anc") * 37) % 11).cast("double") / 10)), "loglik", "brier"),
    f"""WITH p AS ({PANEL}), j AS (SELECT h.anc, h.allele, least(greatest(af, 1e-6), 1 - 1e-6) AS f FROM {{lai}} h JOIN p ON p.chrom = h.chrom AND p.pos = h.pos AND p.anc = h.anc WHERE h.allele IS NOT NULL) SELECT anc, count(*) AS n, round(avg(CASE WHEN allele > 0 THEN ln(f) ELSE ln(1 - f) END), 6) AS loglik, round(avg(pow(CASE WHEN allele > 0 THEN 1.0e0 ELSE 0.0e0 END - f, 2)), 6) AS brier FROM j GROUP BY 1""",
)
PROPS = "p AS (SELECT sample, anc, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY sample) AS share FROM {haps} WHERE anc IS NOT NULL GROUP BY 1, 2)"
add("d38_repeat_exposure", "haps", lambda h: r6(L.repeat_exposure(C.global_props(h), 0.3, 711), "exposure"), f"WITH {PROPS} SELECT sample, round((1 - sum(share * share)) * 0.3e0 * 711, 6) AS exposure FROM p GROUP BY 1")
add("d38_exposure_by_ancestry", "haps", lambda h: r6(L.exposure_by_ancestry(C.global_props(h)), "haplotypes"), f"WITH {PROPS} SELECT anc, round(2 * sum(share), 6) AS haplotypes, count(*) FILTER (WHERE share > 0) AS carriers FROM p GROUP BY 1")
add(
    "d40_split_gt", "haps", lambda h: L.split_gt(h, 3),
    """WITH w AS (SELECT site, sample, max(allele) FILTER (WHERE hap = 1) AS a1, max(anc) FILTER (WHERE hap = 1) AS n1, max(allele) FILTER (WHERE hap = 2) AS a2, max(anc) FILTER (WHERE hap = 2) AS n2 FROM {haps} GROUP BY 1, 2)
       SELECT site, sample, CAST(k AS BIGINT) AS anc, coalesce(CASE WHEN n1 = k THEN CAST(a1 AS VARCHAR) END, '.') || '|' || coalesce(CASE WHEN n2 = k THEN CAST(a2 AS VARCHAR) END, '.') AS gt FROM w CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)""",
)
UNITS = "u AS (SELECT site, CAST(1 AS BIGINT) AS allele, site % 7 - 3 AS units FROM {sites})"
ru = lambda encoding: lambda h, s: L.split_ru_dosage(h, s.select("site", F.lit(1).cast("bigint").alias("allele"), (F.col("site") % 7 - 3).alias("units")), 4, encoding)
add("d41_ru_dosage", "haps sites", ru("sum"), f"WITH {UNITS} SELECT h.site, sample, anc, CAST(sum(coalesce(units, 0)) AS BIGINT) AS dosage, count(*) AS n_hap FROM {{haps}} h LEFT JOIN u ON u.site = h.site AND u.allele = h.allele WHERE anc BETWEEN 0 AND 3 GROUP BY 1, 2, 3")
add("d41_any_alt_dosage", "haps sites", ru("any"), "SELECT site, sample, anc, count(*) FILTER (WHERE allele > 0) AS dosage, count(*) AS n_hap FROM {haps} WHERE anc BETWEEN 0 AND 3 GROUP BY 1, 2, 3")
add("d41_allele_dosage", "haps sites", ru("by_allele"), "WITH n AS (SELECT site, sample, anc, count(*) AS n_hap FROM {haps} WHERE anc BETWEEN 0 AND 3 GROUP BY 1, 2, 3) SELECT site, sample, anc, allele, count(*) AS dosage, n_hap FROM {haps} JOIN n USING (site, sample, anc) WHERE allele > 0 GROUP BY 1, 2, 3, 4, 6")
add(
    "d56_case_counts", "pheno samples haps",
    lambda p, s, h: r6(L.case_counts(p, s.select(F.col("sample").alias("person"), "sex", F.col("ancestry").alias("group")), C.global_props(h).withColumnRenamed("sample", "person"), F.when(F.col("code").endswith("01.1"), 1).when(F.col("code").endswith("01.3"), 0)), "haplotypes"),
    f"""WITH {PROPS}, c AS (SELECT code, person, ancestry AS g FROM {{pheno}} JOIN {{samples}} ON sample = person WHERE value = 1 AND (code NOT LIKE '%01.1' OR sex = 1) AND (code NOT LIKE '%01.3' OR sex = 0)), n AS (SELECT code, g, count(*) AS cases FROM c GROUP BY 1, 2), x AS (SELECT code, g, anc, 2 * sum(share) AS haplotypes FROM c JOIN p ON p.sample = c.person GROUP BY 1, 2, 3)
       SELECT n.code, n.g AS "group", cases, anc, round(haplotypes, 6) AS haplotypes FROM n LEFT JOIN x ON x.code = n.code AND x.g = n.g""",
)
add(
    "f5_site_filter", "sites track", lambda s, t: L.site_filter(s.select("id", "chrom", "pos"), [t.where("name = 'rm'"), t.where("name = 'sr'")], [t.where("name = 'sd'")]).select("id"),
    "SELECT id FROM {sites} s WHERE EXISTS (SELECT 1 FROM {track} t WHERE t.chrom = s.chrom AND t.start0 <= s.pos AND s.pos < t.end0 AND name IN ('rm', 'sr')) AND NOT EXISTS (SELECT 1 FROM {track} t WHERE t.chrom = s.chrom AND t.start0 <= s.pos AND s.pos < t.end0 AND name = 'sd')",
)
