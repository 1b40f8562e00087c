"""Joins and aggregates over sites, calls, haplotypes, samples and loci."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import rows as R
from strandlake.operators.intervals import contains_point, covered_bases, range_join

SITE = ["chrom", "pos", "ref", "alt"]


# --- joins


def merge_sources(sources: dict[str, DataFrame], keys: list[str], fields: list[str]) -> DataFrame:
    """All sites of the sources (keys unique in each), each field from the first source in order that has it, and src, the sources' names joined."""
    out = None
    for name, df in sources.items():
        part = df.select(*keys, *(F.col(f).alias(f"{f}__{name}") for f in fields if f in df.columns), F.lit(name).alias(f"src__{name}"))
        out = part if out is None else out.join(part, keys, "full_outer")
    pick = lambda f: F.coalesce(*(F.col(f"{f}__{n}") for n, df in sources.items() if f in df.columns)).alias(f)
    return out.select(*keys, *map(pick, fields), F.array_join(F.array_compact(F.array(*(f"src__{n}" for n in sources))), ",").alias("src"))


def match_stats(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """n_base, n_matched, match_rate of base's distinct keys."""
    b, o = base.select(*keys).distinct(), other.select(*keys).distinct().withColumn("_m", F.lit(1))
    return b.join(o, keys, "left").agg(F.count("*").alias("n_base"), F.count("_m").alias("n_matched"), F.try_divide(F.count("_m"), F.count("*")).alias("match_rate"))


def match_alleles(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (chrom, pos, ref, alts, id) with the right record of its position and REF: exact ALTs first, else a shared ALT, first in order (n)."""
    r = right.select("chrom", "pos", "ref", F.col("alts").alias("alts_r"), F.col("n").alias("n_r"))
    pairs = left.join(r, ["chrom", "pos", "ref"]).where(F.arrays_overlap("alts", "alts_r"))
    pairs = pairs.withColumn("exact", F.col("alts") == F.col("alts_r"))
    return R.top_per(pairs, ["id"], F.desc("exact"), F.asc("n_r"))


def attach_scores(sites: DataFrame, by_place: DataFrame, by_id: DataFrame) -> DataFrame:
    """score by place and type, else by id; of several scores of one key the largest."""
    p = by_place.groupBy("chrom", "pos", "svtype").agg(F.max("score").alias("s1"))
    i = by_id.groupBy("id").agg(F.max("score").alias("s2"))
    return sites.join(p, ["chrom", "pos", "svtype"], "left").join(i, "id", "left").withColumn("score", F.coalesce("s1", "s2")).drop("s1", "s2")


def integrate_partitions(main: DataFrame, bnd: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """main without the keys that large has, then bnd and large."""
    return main.join(large.select(*keys).distinct(), keys, "left_anti").unionByName(bnd).unionByName(large)


def concordant_sites(a: DataFrame, b: DataFrame, least_rate: float, least_pairs: int) -> DataFrame:
    """Sites of both call sets with n pairs that both can call and the rate of equal unordered genotypes, at both minima."""
    gt = lambda df, n: df.select("site", "sample", R.norm_gt("a1", "a2").alias(n)).where(f"{n} IS NOT NULL")
    each = gt(a, "g").join(gt(b, "h"), ["site", "sample"]).groupBy("site").agg(F.count("*").alias("n"), F.count_if(F.col("g") == F.col("h")).alias("same"))
    return each.where((F.col("n") >= least_pairs) & (F.col("same") >= least_rate * F.col("n")))


def paired_concordance(a: DataFrame, b: DataFrame, keys: list[str], least_cov: int, close: float = 10) -> DataFrame:
    """n sites at which both reach the coverage, share within `close`, Pearson correlation (null under 3 sites)."""
    pick = lambda df, n: df.where(F.col("cov") >= least_cov).groupBy(*keys).agg(F.avg("score").alias(n))
    got = pick(a, "x").join(pick(b, "y"), keys)
    r = F.corr("x", "y")
    return got.agg(F.count("*").alias("n"), F.avg((F.abs(F.col("x") - F.col("y")) < close).cast("double")).alias("share"), F.when((F.count("*") >= 3) & ~F.isnan(r), r).alias("r"))


def left_join_1to1(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join that fails if a key stands twice in right; the row count can't change then."""
    checked = right.withColumn("_k", F.count("*").over(W.partitionBy(*on))).withColumn("_ok", F.assert_true(F.col("_k") == 1, "the right side's key isn't unique"))
    return left.join(checked.where(F.col("_ok").isNull()).drop("_k", "_ok"), on, "left")


def membership(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    return df.join(ids.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def match_sites_fuzzy(base: DataFrame, comp: DataFrame, distance: int = 500, ratio: float = 0.7, sizes: tuple[int, int] = (50, 10_000)) -> DataFrame:
    """One-to-one matches: base id, comp id_r. Same type, positions within `distance`, size ratio, both the other's best (nearest, then id)."""
    fit = lambda df: df.where(F.abs("svlen").between(*sizes)).select("chrom", "pos", "id", "svtype", F.abs("svlen").alias("len"))
    b = fit(base).withColumns({"start0": F.col("pos") - distance, "end0": F.col("pos") + distance + 1})
    c = fit(comp).withColumns({"start0": F.col("pos"), "end0": F.col("pos") + 1})
    pairs = range_join(b, c).where((F.col("svtype") == F.col("svtype_r")) & (F.least("len", "len_r") >= ratio * F.greatest("len", "len_r")))
    pairs = pairs.withColumn("d", F.abs(F.col("pos") - F.col("pos_r")))
    one = F.row_number().over(W.partitionBy("id").orderBy("d", "id_r"))
    two = F.row_number().over(W.partitionBy("id_r").orderBy("d", "id"))
    return pairs.withColumns({"_1": one, "_2": two}).where("_1 = 1 AND _2 = 1").select("id", "id_r", "d")


def assign_locus(records: DataFrame, catalog: DataFrame, flank: int, lookback: int = 8) -> DataFrame:
    """records (id, chrom, start0, end0) with their best locus: among the `lookback` nearest starts not beyond the padded record, by most
    overlap, then least distance, then shortest locus, then the larger start."""
    padded = records.select("id", "chrom", (F.col("start0") - flank).alias("start0"), (F.col("end0") + flank).alias("end0"))
    pairs = range_join(padded, catalog.select("chrom", "start0", "end0", "locus"))
    pairs = pairs.withColumn("near", F.row_number().over(W.partitionBy("id").orderBy(F.desc("start0_r"), "locus_r"))).where(F.col("near") <= lookback)
    s, e = F.col("start0") + flank, F.col("end0") - flank
    pairs = pairs.withColumn("overlap", F.greatest(F.least(e, F.col("end0_r")) - F.greatest(s, F.col("start0_r")), F.lit(0)))
    pairs = pairs.withColumn("distance", F.greatest(F.greatest(s, F.col("start0_r")) - F.least(e, F.col("end0_r")), F.lit(0)))
    best = R.top_per(pairs, ["id"], F.desc("overlap"), F.asc("distance"), F.asc(F.col("end0_r") - F.col("start0_r")), F.desc("start0_r"), F.asc("locus_r"))
    return best.select("id", F.col("locus_r").alias("locus"), "overlap", "distance")


# --- aggregates over sites


def site_freq(calls: DataFrame) -> DataFrame:
    """site, ac, an, af (0 when nothing is called), n_carriers."""
    g = R.gt_stats("a1", "a2")
    out = calls.groupBy("site").agg(F.sum(g["ac"]).alias("ac"), F.sum(g["an"]).alias("an"), F.count_if(g["carrier"]).alias("n_carriers"))
    return out.withColumn("af", F.coalesce(F.try_divide("ac", "an"), F.lit(0.0)))


def carrier_lists(calls: DataFrame) -> DataFrame:
    """site and its carriers in sample order, joined by commas."""
    g = R.gt_stats("a1", "a2")
    return calls.where(g["carrier"]).groupBy("site").agg(F.array_join(F.transform(F.sort_array(F.collect_list("sample")), lambda s: s.cast("string")), ",").alias("carriers"), F.count("*").alias("n_carriers"))


def context_label(sites: DataFrame, track: DataFrame, names: tuple[str, ...] = ("rm", "sd", "sr"), long: int = 5000) -> DataFrame:
    """sites (id, chrom, start0, end0, svtype) with hit_<name> and context: the last of RM, SD, SR that hits, else US.

    A track hits where it holds either end; for DEL, DUP and CNV beyond `long` bp, where it covers more than half the body."""
    out = sites
    for n in names:
        t = track.where(F.col("name") == n).select("chrom", "start0", "end0")
        ends = sites.select("id", "chrom", F.explode(F.array_distinct(F.array("start0", F.col("end0") - 1))).alias("pos"))
        at_end = contains_point(ends, t, "_p").groupBy("id").agg(F.bool_or("_p").alias("_p"))
        large = sites.where(F.col("svtype").isin("DEL", "DUP", "CNV") & (F.col("end0") - F.col("start0") > long))
        body = covered_bases(large.select("id", "chrom", "start0", "end0"), t, "id").select("id", (F.col("covered") > 0.5 * (F.col("end0") - F.col("start0"))).alias("_c"))
        out = out.join(at_end, "id", "left").join(body, "id", "left").withColumn(f"hit_{n}", F.coalesce("_c", "_p", F.lit(False))).drop("_p", "_c")
    label = F.when(F.col("hit_sr"), "SR").when(F.col("hit_sd"), "SD").when(F.col("hit_rm"), "RM").otherwise("US")
    return out.withColumn("context", label)


def site_counts(sites: DataFrame) -> DataFrame:
    """source, svtype, context ('all' for the total), n50 and n20: sites of at least 50 and 20 bp; breakends count without a length."""
    flags = R.size_flags("svlen", "svtype")
    counted = sites.withColumns(flags).withColumns({"ge50": F.col("ge50") | (F.col("svtype") == "BND"), "ge20": F.col("ge20") | (F.col("svtype") == "BND")})
    both = counted.select("source", "svtype", "ge50", "ge20", F.explode(F.array("context", F.lit("all"))).alias("context"))
    return both.groupBy("source", "svtype", "context").agg(F.count_if("ge50").alias("n50"), F.count_if("ge20").alias("n20"))


def context_pct(counts: DataFrame) -> DataFrame:
    """Percent of the type's total in each context, one decimal; an empty total gives null."""
    total = counts.where("context = 'all'").select("source", "svtype", F.col("n50").alias("total"))
    return counts.where("context <> 'all'").join(total, ["source", "svtype"]).select("source", "svtype", "context", F.round(F.try_divide(100.0 * F.col("n50"), F.col("total")), 1).alias("pct"))


def length_spectrum(sites: DataFrame) -> DataFrame:
    """Counts by partition, signed length and context: small below 20 bp, sv for DEL and INS from 20, ultralong all, breakends at length 0."""
    n = R.signed_sv_length("svtype", "svlen")
    part = (
        F.when(F.col("source") == "bnd", "bnd")
        .when(F.col("source") == "large", "ultralong")
        .when(F.abs(n) < 20, "small")
        .when(F.col("svtype").isin("DEL", "INS"), "sv")
    )
    out = sites.select(part.alias("part"), F.when(part == "bnd", F.lit(0)).otherwise(n).cast("bigint").alias("len"), "context").where("part IS NOT NULL AND len IS NOT NULL")
    return out.groupBy("part", "len", "context").agg(F.count("*").alias("n"))


def chao1(n_carriers: DataFrame, column: str) -> DataFrame:
    """Richness from singletons and doubletons: n + f1 (f1 - 1) / (2 (f2 + 1))."""
    f1, f2 = F.count_if(F.col(column) == 1), F.count_if(F.col(column) == 2)
    return n_carriers.where(F.col(column) > 0).agg(F.count("*").alias("n"), f1.alias("f1"), f2.alias("f2"), (F.count("*") + f1 * (f1 - 1) / (2 * (f2 + 1))).alias("chao1"))


# --- repeat loci


def locus_dosage(records: DataFrame) -> DataFrame:
    """locus, sample, hap, dosage and flags from records (locus, sample, hap, bp (null: missing), phased, size_sv), a row each haplotype of a record (rec).

    A haplotype is missing if any of its records is. A sample is ambiguous at a locus, on both haplotypes, where two records or more are unphased and
    heterozygous with alleles of different length. duplicate: a small and an sv change of one sign on one haplotype."""
    bits = F.when(F.col("bp").isNull() | (F.col("bp") == 0), 0).otherwise(F.when(F.col("size_sv"), F.when(F.col("bp") > 0, 1).otherwise(2)).otherwise(F.when(F.col("bp") > 0, 4).otherwise(8)))
    hets = records.where("NOT phased").groupBy("locus", "sample", "rec").agg(F.min("bp").alias("low"), F.max("bp").alias("high"), F.count("bp").alias("n")).where("n = 2 AND low <> high")
    unsure = hets.groupBy("locus", "sample").agg(F.count("*").alias("n_unphased"))
    out = records.withColumn("_k", bits).groupBy("locus", "sample", "hap").agg(F.sum("bp").alias("total"), F.count_if(F.col("bp").isNull()).alias("missing"), F.count_if(F.col("bp") != 0).alias("changes"), F.bit_or("_k").alias("bits"))
    out = out.join(unsure, ["locus", "sample"], "left")
    called = F.col("missing") == 0
    ambiguous = F.coalesce(F.col("n_unphased") >= 2, F.lit(False))
    return out.select("locus", "sample", "hap", F.when(called & ~ambiguous, F.col("total")).alias("dosage"), "changes", ambiguous.alias("ambiguous"), (called & ((F.col("bits").bitwiseAND(5) == 5) | (F.col("bits").bitwiseAND(10) == 10))).alias("duplicate"))


def allele_table(dosage: DataFrame) -> DataFrame:
    """One row per locus and distinct dosage: n_hap_allele, with the locus's called and missing haplotypes."""
    each = dosage.where("dosage IS NOT NULL").groupBy("locus", "dosage").agg(F.count("*").alias("n_hap_allele"))
    told = dosage.groupBy("locus").agg(F.count("dosage").alias("n_hap"), F.count_if(F.col("dosage").isNull()).alias("n_hap_missing"))
    return each.join(told, "locus")


def locus_qc(dosage: DataFrame) -> DataFrame:
    return dosage.groupBy("locus").agg(F.count_if(F.col("changes") > 1).alias("n_multi_record"), F.count_if("duplicate").alias("n_duplicate"), F.count_if("ambiguous").alias("n_ambiguous"), F.count("*").alias("n_hap"))


def polymorphism(calls: DataFrame) -> DataFrame:
    """site: n_called, n_het and min, max, sum, sum of squares of the allele over called haplotypes."""
    both = F.col("a1").isNotNull() & F.col("a2").isNotNull()
    haps = calls.select("site", both.alias("both"), (both & (F.col("a1") != F.col("a2"))).alias("het"), F.posexplode(F.array("a1", "a2")).alias("h", "x"))
    return haps.groupBy("site").agg(F.count_if(F.col("both") & (F.col("h") == 0)).alias("n_called"), F.count_if(F.col("het") & (F.col("h") == 0)).alias("n_het"), F.min("x").alias("low"), F.max("x").alias("high"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.count_distinct("x").alias("n_alleles"))


def polymorphism_summary(per_site: DataFrame, rates: tuple[float, ...] = (0.01, 0.1, 0.3)) -> DataFrame:
    het = F.try_divide("n_het", "n_called")
    return per_site.agg(F.count_if(F.col("n_alleles") <= 1).alias("monomorphic"), F.count_if(F.col("n_alleles") > 1).alias("polymorphic"), *(F.count_if(het >= r).alias(f"het_{int(100 * r)}") for r in rates))


def variability(alleles: DataFrame, least_rate: float = 0.5) -> DataFrame:
    """locus, n, mean and population deviation of dosage from allele counts; loci with enough haplotypes (rate of the largest count)."""
    each = alleles.groupBy("locus", "period").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("dosage")).alias("s"), F.sum(F.col("n") * F.col("dosage") * F.col("dosage")).alias("ss"))
    most = each.agg(F.ceil(F.lit(least_rate) * F.max("n")).alias("least"))
    mean = F.col("s") / F.col("n")
    return each.join(F.broadcast(most), F.col("n") >= F.col("least")).select("locus", "period", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("plvi"))


def rarefaction(alleles: DataFrame, grid: tuple[int, ...]) -> DataFrame:
    """n, loci, mean and quartiles of the expected distinct alleles in n haplotypes drawn from each locus (loci with fewer are left out).

    The chance that an allele is absent is a product of n ratios, so no factorials: prod over i < n of (N - Ni - i) / (N - i)."""
    total = alleles.groupBy("locus").agg(F.sum("n").alias("total"))
    a = alleles.join(total, "locus").withColumn("k", F.explode(F.array(*map(F.lit, grid)))).where(F.col("k") <= F.col("total"))
    absent = F.when(F.col("total") - F.col("n") < F.col("k"), 0.0).otherwise(F.exp(F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), F.lit(0.0), lambda x, i: x + F.log((F.col("total") - F.col("n") - i) / (F.col("total") - i)))))
    per = a.withColumn("seen", 1.0 - absent).groupBy("locus", "k").agg(F.sum("seen").alias("expected"))
    return per.groupBy(F.col("k").cast("bigint").alias("k")).agg(F.count("*").alias("loci"), F.avg("expected").alias("mean"), F.percentile("expected", 0.25).alias("q1"), F.percentile("expected", 0.75).alias("q3"))


def coding_corr2(alleles: DataFrame) -> DataFrame:
    """locus: squared correlation of dosage with carrying any change, from allele counts (n counts called haplotypes only)."""
    n = F.sum("n")
    mean, square = F.sum(F.col("n") * F.col("dosage")) / n, F.sum(F.col("n") * F.col("dosage") * F.col("dosage")) / n
    f = F.sum(F.when(F.col("dosage") != 0, F.col("n")).otherwise(0)) / n
    m = alleles.groupBy("locus").agg(n.alias("n"), mean.alias("m"), square.alias("q"), f.alias("f"))
    var = (F.col("q") - F.col("m") * F.col("m")) * F.col("f") * (1 - F.col("f"))
    return m.select("locus", "n", "f", F.when(var > 1e-12, F.pow(F.col("m") * (1 - F.col("f")), F.lit(2)) / var).alias("corr2"))


# --- local ancestry


def global_props(haps: DataFrame) -> DataFrame:
    n = haps.where("anc IS NOT NULL").groupBy("sample", "anc").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("sample")))


def switch_expectation(props: DataFrame, rec: float, generations: float) -> DataFrame:
    """sample: chance of different ancestry 1 - sum p^2, and the switches that it lets expect."""
    het = props.groupBy("sample").agg((1 - F.sum(F.col("share") * F.col("share"))).alias("het"))
    return het.withColumn("expected", F.lit(rec / 100 * generations) * F.col("het"))


def switches(haps: DataFrame) -> DataFrame:
    """Places where a haplotype's ancestry differs from its last known one: sample, hap, chrom, pos, from_anc, to_anc, previous pos, gap."""
    w = W.partitionBy("sample", "hap", "chrom").orderBy("pos")
    out = haps.where("anc IS NOT NULL").select("sample", "hap", "chrom", "pos", F.col("anc").alias("to_anc"), F.lag("anc").over(w).alias("from_anc"), F.lag("pos").over(w).alias("prev"))
    return out.where("from_anc <> to_anc").withColumn("gap", F.col("pos") - F.col("prev"))


def mark_flickers(sw: DataFrame, most: int) -> DataFrame:
    """sw with flicker and span: a switch A to B and the next one B to A, 0 < span <= most; a later pair's span stays."""
    w = W.partitionBy("sample", "hap", "chrom").orderBy("pos")
    back = (F.lag("from_anc").over(w) == F.col("to_anc")) & (F.lag("to_anc").over(w) == F.col("from_anc"))
    ahead = (F.lead("from_anc").over(w) == F.col("to_anc")) & (F.lead("to_anc").over(w) == F.col("from_anc"))
    d1, d2 = F.col("pos") - F.lag("pos").over(w), F.lead("pos").over(w) - F.col("pos")
    s1, s2 = F.when(back & d1.between(1, most), d1), F.when(ahead & d2.between(1, most), d2)
    return sw.withColumn("span", F.coalesce(s2, s1)).withColumn("flicker", F.col("span").isNotNull())


def build_tracts(sw: DataFrame, haps: DataFrame, low: int, high: int) -> DataFrame:
    """Tracts between switches inside [low, high): sample, hap, chrom, start, end, anc, left_open, right_open; a haplotype without a switch is one tract."""
    keys = ["sample", "hap", "chrom"]
    inside = sw.where(F.col("pos").between(low + 1, high - 1))
    first = haps.where("anc IS NOT NULL").groupBy(*keys).agg(F.min_by("anc", "pos").alias("anc"))
    edges = first.select(*keys, F.lit(low).cast("bigint").alias("start"), "anc").unionByName(inside.select(*keys, F.col("pos").alias("start"), F.col("to_anc").alias("anc")))
    end = F.lead("start").over(W.partitionBy(*keys).orderBy("start"))
    return edges.select(*keys, "start", F.coalesce(end, F.lit(high).cast("bigint")).alias("end"), "anc", (F.col("start") == low).alias("left_open"), end.isNull().alias("right_open"))


def tract_stats(tracts: DataFrame) -> DataFrame:
    n = F.col("end") - F.col("start")
    whole = ~F.col("left_open") & ~F.col("right_open")
    return tracts.groupBy("anc").agg(F.count("*").alias("n"), F.count_if(whole).alias("n_complete"), F.percentile(n, 0.5).alias("median"), F.sum(n).alias("bp"))


def split_dosage(haps: DataFrame, k: int) -> DataFrame:
    """site, sample, anc: ds (alleles equal to 1) and n_hap, for ancestries 0 to k - 1; others are ignored."""
    return haps.where(F.col("anc").between(0, k - 1)).groupBy("site", "sample", "anc").agg(F.count_if(F.col("allele") == 1).alias("ds"), F.count("*").alias("n_hap"))


def admixed_dosage(haps: DataFrame, most_missing: float = 1.0) -> DataFrame:
    """site, sample, anc: DS scaled by the site's largest absolute dosage, n_hap; missing alleles and ancestries count in neither; sites beyond the missing share go."""
    told = haps.groupBy("site").agg(F.avg(F.col("allele").isNull().cast("double")).alias("gone"), F.max(F.abs(F.col("allele") * 3 - 1)).alias("top"))
    good = haps.where("allele IS NOT NULL AND anc IS NOT NULL").groupBy("site", "sample", "anc").agg(F.sum(F.col("allele") * 3 - 1).alias("x"), F.count("*").alias("n_hap"))
    return good.join(told.where((F.col("gone") <= most_missing) & (F.col("top") > 0)), "site").select("site", "sample", "anc", (F.col("x") / F.col("top")).alias("ds"), "n_hap")


def mendelian_score(haps: DataFrame, trios: DataFrame) -> DataFrame:
    """By child: loci with all six ancestries, hard violations, and flips of the only possible parent assignment along a chromosome."""
    wide = haps.where("anc IS NOT NULL").groupBy("chrom", "pos", "sample").agg(F.max(F.when(F.col("hap") == 1, F.col("anc"))).alias("x"), F.max(F.when(F.col("hap") == 2, F.col("anc"))).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    of = lambda who, p: wide.select("chrom", "pos", F.col("sample").alias(who), F.col("x").alias(f"{p}1"), F.col("y").alias(f"{p}2"))
    six = of("child", "c").join(trios.where("father <> 0 AND mother <> 0"), "child").join(of("father", "f"), ["chrom", "pos", "father"]).join(of("mother", "m"), ["chrom", "pos", "mother"])
    inside = lambda c, p: (F.col(c) == F.col(f"{p}1")) | (F.col(c) == F.col(f"{p}2"))
    one, two = inside("c1", "f") & inside("c2", "m"), inside("c2", "f") & inside("c1", "m")
    state = F.when(one & ~two, 1).when(two & ~one, 2)
    w = W.partitionBy("child", "chrom").orderBy("pos")
    six = six.withColumns({"bad": ~one & ~two, "forced": state})
    # before anything is forced: father first, where that is possible at the first compatible place
    first = ~F.col("bad") & (F.count_if(~F.col("bad")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1)
    six = six.withColumn("state", F.coalesce("forced", F.when(first, 1)))
    last = F.last("state", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    flips = six.withColumn("flip", F.coalesce((F.col("forced") != last), F.lit(False)))
    return flips.groupBy("child").agg(F.count("*").alias("loci"), F.count_if("bad").alias("violations"), F.count_if("flip").alias("flips"))


def derange(samples: DataFrame, key: str, group: str, seed: int = 1) -> DataFrame:
    """key and donor: within each group everyone gets another's label (a cyclic shift in seeded order); groups of one stay out."""
    w = W.partitionBy(group).orderBy(F.xxhash64(key, F.lit(seed)), key)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = samples.withColumn("donor", F.coalesce(F.lead(key).over(w), F.first(key).over(whole)))
    return out.where(F.col("donor") != F.col(key)).select(key, group, "donor")


# --- discovery


def generation_depth(ped: DataFrame, most: int = 64) -> DataFrame:
    """child, depth: founders 0, else one more than the deepest known parent; iterated until nothing changes, a stage each round."""
    from strandlake.sources.tables import stage

    parents = stage(ped.select("child", F.explode(F.array("father", "mother")).alias("parent")).where("parent <> 0").join(ped.select(F.col("child").alias("parent")), "parent"), "parents")
    depth = stage(ped.select("child", F.lit(0).alias("depth")), "depth")
    for _ in range(most):
        deepest = parents.join(depth.select(F.col("child").alias("parent"), (F.col("depth") + 1).alias("d")), "parent").groupBy("child").agg(F.max("d").alias("d"))
        new = stage(depth.join(deepest, "child", "left").select("child", F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth"), (F.coalesce("d", F.lit(0)) > F.col("depth")).alias("grew")), "depth")
        depth = new.select("child", "depth")
        if not new.where("grew").limit(1).count():
            return depth
    raise ValueError("the pedigree has a cycle or is deeper than the limit")


def cutoff_curve(values: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """threshold 1..most and the number of rows at or above it, from counts by value."""
    counts = values.where(F.col(column) >= 1).groupBy(F.least(F.col(column).cast("bigint"), F.lit(most).cast("bigint")).alias("threshold")).agg(F.count("*").alias("k"))
    grid = values.sparkSession.range(1, most + 1).withColumnRenamed("id", "threshold")
    return grid.join(counts, "threshold", "left").select("threshold", F.sum(F.coalesce("k", F.lit(0))).over(W.orderBy(F.desc("threshold"))).alias("n"))


def completeness(df: DataFrame, by: str, columns: list[str], flags: list[str] = ()) -> DataFrame:
    """stratum, column, the share of rows that are present (not null and not blank), of flags the share of known ones that are true, and the range of
    shares over the strata."""
    present = lambda c: F.avg((F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).cast("double"))
    rate = lambda c: F.avg(F.col(c).cast("double")) if c in flags else F.lit(None).cast("double")
    wide = df.groupBy(by).agg(F.array(*(F.struct(F.lit(c).alias("column"), present(c).alias("share"), rate(c).alias("true_rate")) for c in columns)).alias("c"))
    over = W.partitionBy("column")
    return wide.select(by, F.inline("c")).withColumn("range", F.max("share").over(over) - F.min("share").over(over))


def combine_haplotypes(cpg: DataFrame, least_cov: int) -> DataFrame:
    """By sample: haplotype sites over twice the combined ones, of all and of covered ones, and whether haplotypes were told apart at all."""
    hap, covered = F.col("track") != "combined", F.col("cov") >= least_cov
    n = cpg.groupBy("sample").agg(F.count_if(hap).alias("h"), F.count_if(~hap).alias("c"), F.count_if(hap & covered).alias("h5"), F.count_if(~hap & covered).alias("c5"))
    return n.select("sample", F.round(F.try_divide("h", 2 * F.col("c")), 6).alias("fraction"), F.round(F.try_divide("h5", 2 * F.col("c5")), 6).alias("fraction_covered"), (F.col("h") > 0).alias("resolved"))


def site_classes(sites: DataFrame) -> DataFrame:
    """class (multiallelic, snv, indel, other), sites and their share of all; a site of several alleles is multiallelic whatever they are."""
    several = F.contains("alt", F.lit(","))
    kind = F.when(several, "multiallelic").when((F.length("ref") == 1) & (F.length("alt") == 1), "snv").when(F.length("ref") != F.length("alt"), "indel").otherwise("other")
    n = sites.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))  # four rows
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy()))


def combine_inventory(pheno: DataFrame, people: int, least: int) -> DataFrame:
    """By code: cases, controls, the smaller arm, prevalence, coverage (of all people), effective size and whether both arms are large enough."""
    n = pheno.groupBy("code").agg(F.count_if(F.col("value") == 1).alias("cases"), F.count_if(F.col("value") == 0).alias("controls"))
    known, phi = F.col("cases") + F.col("controls"), F.try_divide("cases", F.col("cases") + F.col("controls"))
    return n.withColumns({"smaller": F.least("cases", "controls"), "prevalence": phi, "coverage": F.try_divide(known, F.lit(people)), "n_eff": 4 * F.col("cases") * (1 - phi), "testable": F.least("cases", "controls") >= least})


def crosstab_redacted(df: DataFrame, a: str, b: str, least: int) -> DataFrame:
    """Counts by both columns; counts between 0 and `least` become null."""
    return df.groupBy(a, b).agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("n") >= least, F.col("n")))


def unanimous(value: str) -> Column:
    return F.when(F.count_distinct(value) == 1, F.max(value))
