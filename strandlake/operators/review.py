"""Merges, matches, audits and reports over sites, samples and association results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators.rows import col, gt_stats, small_allele


def is_ru_test(info: Column, flag: str = "RU_TEST") -> Column:
    """The flag is in the INFO map and its value is not 0 or False."""
    value = F.try_element_at(info, F.lit(flag))
    return F.coalesce(~F.lower(value).isin("0", "false"), F.lit(False))


def apply_coding(units, coding: str) -> Column:
    """unit: as it is; carrier: non-zero becomes 1. Null stays null."""
    if coding not in ("unit", "carrier"):
        raise ValueError(f"unknown coding {coding}")
    return col(units) if coding == "unit" else F.transform(col(units), lambda u: (u != 0).cast("long"))


def soft_fill(df: DataFrame, other: DataFrame, key: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df with null fields taken from other, audit rows of what was filled: key, field, value). Nothing is overwritten."""
    second = other.select(key, *(F.col(n).alias(f"_{n}") for n in names))
    joined = df.join(second, key, "left")
    filled = joined.select(*(F.coalesce(n, f"_{n}").alias(n) if n in names else F.col(n) for n in df.columns))
    entry = lambda n: F.when(F.col(n).isNull() & F.col(f"_{n}").isNotNull(), F.struct(F.lit(n).alias("field"), F.col(f"_{n}").cast("string").alias("value")))
    audit = joined.select(key, F.explode(F.array_compact(F.array(*map(entry, names)))).alias("e")).select(key, "e.field", "e.value")
    return filled, audit


def union_samples(lists: DataFrame) -> DataFrame:
    """lists (list, place, sample): each sample once, with where it was first seen."""
    return lists.groupBy("sample").agg(F.min(F.struct("list", "place")).alias("f")).select("sample", "f.list", "f.place")


def match_alleles(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Left rows (key, chrom, pos, ref, alt) with the right row of the same place and REF: the same ALT first, else a shared ALT, first by `order`."""
    r = right.select("chrom", "pos", "ref", F.col("alt").alias("right_alt"), F.col(order).alias("right_order"))
    exact = F.col("alt") == F.col("right_alt")
    both = left.join(r, ["chrom", "pos", "ref"]).where(exact | F.arrays_overlap(F.split("alt", ","), F.split("right_alt", ",")))
    best = F.min(F.struct((~exact).alias("loose"), "right_order", "right_alt")).alias("m")
    return both.groupBy(key).agg(best).select(key, (~F.col("m.loose")).alias("exact"), "m.right_order", "m.right_alt")


def match_sites(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Pairs of the same chrom and pos; ref and alt must agree only where the row gives them."""
    s = sites.select("chrom", "pos", F.col("ref").alias("_ref"), F.col("alt").alias("_alt"), F.col("id").alias("site_id"))
    agrees = lambda c: F.col(c).isNull() | (F.col(c) == F.col(f"_{c}"))
    return rows.join(s, ["chrom", "pos"]).where(agrees("ref") & agrees("alt")).drop("_ref", "_alt")


def analysis_samples(samples: DataFrame, *tables: DataFrame) -> DataFrame:
    """Rows of samples whose id is in every table; the order column stays."""
    return reduce(lambda d, t: d.join(t.select("sample"), "sample", "left_semi"), tables, samples)


def compare_arms(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_both, n_first, n_second, n_better (p of the second arm is smaller). Both arms have one row per key."""
    both = a.select(*keys, F.col("p").alias("pa")).join(b.select(*keys, F.col("p").alias("pb")), keys, "full")
    return both.agg(F.count_if(F.expr("pa IS NOT NULL AND pb IS NOT NULL")).alias("n_both"), F.count_if(F.expr("pb IS NULL")).alias("n_first"), F.count_if(F.expr("pa IS NULL")).alias("n_second"), F.count_if(F.expr("pb < pa")).alias("n_better"))


def merge_phases(a: DataFrame, b: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Counts of two phases side by side; a key that a phase lacks has 0 there."""
    return a.withColumnRenamed(n, "n_1").join(b.withColumnRenamed(n, "n_2"), keys, "full").select(*keys, F.coalesce("n_1", F.lit(0)).alias("n_1"), F.coalesce("n_2", F.lit(0)).alias("n_2"))


def merge_counts(tables: list[DataFrame], keys: list[str], n: str = "n") -> DataFrame:
    """Counts of shards, equal keys summed."""
    return reduce(DataFrame.unionByName, tables).groupBy(*keys).agg(F.sum(n).alias(n))


def novel_alleles(first: DataFrame, second: DataFrame) -> DataFrame:
    """By carrier bin (1, 2-5, 6+): alleles (locus, dosage, n) of the second phase, and how many of them the first has."""
    seen = first.select("locus", "dosage").distinct().withColumn("seen", F.lit(1))
    bins = F.when(F.col("n") <= 1, "1").when(F.col("n") <= 5, "2-5").otherwise("6+")
    return second.join(seen, ["locus", "dosage"], "left").groupBy(bins.alias("carriers")).agg(F.count("*").alias("n_alleles"), F.count("seen").alias("n_seen"))


def encoding_stats(alleles: DataFrame, mac: int) -> DataFrame:
    """One row: changed alleles and carriers, those under mac, and loci that only a dosage can test (no allele reaches mac, their sum does)."""
    per = alleles.where("dosage <> 0").groupBy("locus").agg(
        F.count("*").alias("k"), F.sum("n").alias("c"), F.max("n").alias("m"), F.count_if(F.col("n") < mac).alias("kl"), F.sum(F.when(F.col("n") < mac, F.col("n")).otherwise(0)).alias("cl")
    )
    return per.agg(F.sum("k").alias("n_alleles"), F.sum("kl").alias("n_alleles_low"), F.sum("c").alias("n_carriers"), F.sum("cl").alias("n_carriers_low"), F.count_if((F.col("m") < mac) & (F.col("c") >= mac)).alias("n_dosage_only"))


def catalog_totals(sites: DataFrame, by: str) -> DataFrame:
    """By set: records, multiallelic ones (several ALTs), and of the others SNVs, MNPs, short (1-2 bp) and longer indels, transitions and transversions."""
    kind, size = small_allele("ref", "alt")
    ring = lambda c: F.translate(c, "AGCT", "RRYY")
    multi = F.contains("alt", F.lit(","))
    at = sites.select(by, multi.alias("multi"), F.when(~multi, kind).alias("k"), F.abs(size).alias("d"), (ring("ref") == ring("alt")).alias("same"))
    told = {"n_multiallelic": "multi", "n_snv": "k = 'snv'", "n_mnp": "k = 'mnp'", "n_indel_short": "k = 'indel' AND d <= 2", "n_indel_long": "k = 'indel' AND d > 2", "n_ti": "k = 'snv' AND same", "n_tv": "k = 'snv' AND NOT same"}
    return at.groupBy(by).agg(F.count("*").alias("n_records"), *(F.count_if(F.expr(e)).alias(n) for n, e in told.items()))


def af_panel(calls: DataFrame, panels: DataFrame, min_mac: int, n: int) -> DataFrame:
    """The n sites whose frequency differs most between panels (sample, panel): by range, then pos, then id; two panels with calls and min_mac at least."""
    g = gt_stats("a1", "a2")
    per = calls.join(panels, "sample").groupBy("id", "pos", "panel").agg(F.sum(g["ac"]).alias("ac"), F.sum(g["an"]).alias("an"))
    site = per.where("an > 0").withColumn("af", F.col("ac") / F.col("an")).groupBy("id", "pos").agg(F.sum("ac").alias("ac"), F.sum("an").alias("an"), F.count("*").alias("n_panels"), (F.max("af") - F.min("af")).alias("range"))
    site = site.where((F.col("n_panels") >= 2) & (F.least("ac", F.col("an") - F.col("ac")) >= min_mac)).withColumn("range", F.round("range", 9))
    return site.orderBy(F.desc("range"), "pos", "id").limit(n)


def mixture_af(af: DataFrame, weights: DataFrame) -> DataFrame:
    """af (id, panel, af) under weights (panel, w): missing frequencies drop out and the other weights count in full."""
    return af.where("af IS NOT NULL").join(weights, "panel").groupBy("id").agg(F.try_divide(F.sum(F.col("w") * F.col("af")), F.sum("w")).alias("af"))


def split_samples(samples: DataFrame, groups: list[str], drop: Column, least: int) -> DataFrame:
    """reason of each sample: control, dropped, small_group (fewer than `least` others are left in its group) or kept."""
    early = F.when(F.col("control"), "control").when(drop, "dropped")
    sizes = samples.where(early.isNull()).groupBy(*groups).agg(F.count("*").alias("_n"))
    return samples.join(sizes, groups, "left").withColumn("reason", F.coalesce(early, F.when(F.col("_n") < least, "small_group").otherwise("kept"))).drop("_n")


def testable_matrix(cases: DataFrame, groups: list[str], floor: int) -> DataFrame:
    """cases (chapter, group, code, n): by chapter the codes with n of at least floor, a column for each group."""
    return cases.groupBy("chapter").pivot("group", groups).agg(F.count_if(F.col("n") >= floor)).na.fill(0)


def outlier_rates(df: DataFrame, category: str, flag: Column) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("rate"))


def shard_coverage(shards: DataFrame, complete: int) -> DataFrame:
    """shards (phenotype, chrom, run, rows): the last run of a shard counts; a phenotype is complete with so many chromosomes."""
    last = shards.groupBy("phenotype", "chrom").agg(F.max_by("rows", "run").alias("rows"))
    return last.groupBy("phenotype").agg(F.count("*").alias("n_chroms"), F.sum("rows").alias("rows")).withColumn("complete", F.col("n_chroms") >= complete)


def separation_audit(df: DataFrame, covariates: list[str], case: str) -> DataFrame:
    """Each level of the covariates: n, n_cases, separated (no case, or only cases), constant (its covariate has one level)."""
    levels = df.select(case, F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(c).cast("string").alias("level")) for c in covariates))).alias("x"))
    per = levels.groupBy("x.covariate", "x.level").agg(F.count(case).alias("n"), F.count_if(F.col(case) == 1).alias("n_cases"))
    size = per.groupBy("covariate").agg((F.count("*") == 1).alias("constant"))
    return per.join(size, "covariate").withColumn("separated", (F.col("n_cases") == 0) | (F.col("n_cases") == F.col("n")))


def missingness_cost(df: DataFrame, candidates: list[str]) -> DataFrame:
    """Rows lost by requiring each candidate."""
    lost = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in candidates))
    return lost.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("candidate"), F.col(c).alias("n_lost")) for c in candidates))).alias("x")).select("n", "x.candidate", "x.n_lost")


def chrom_order(chrom) -> Column:
    """1 to 22, then X, Y, M; others last."""
    x = F.regexp_replace(col(chrom), "^chr", "")
    return F.when(x == "X", 23).when(x == "Y", 24).when(x.isin("M", "MT"), 25).otherwise(F.coalesce(x.try_cast("int"), F.lit(99)))


def seeded(key, seed: str) -> Column:
    """A fixed order that looks random."""
    return F.md5(F.concat(F.lit(seed), col(key).cast("string")).cast("binary"))


def thin(df: DataFrame, key: str, cut: float, budget: int, seed: str) -> DataFrame:
    """Every row with p below cut, and `budget` of the others by a seeded order."""
    rest = df.where(F.col("p") >= cut).orderBy(seeded(key, seed), key).limit(budget)
    return df.where(F.col("p") < cut).unionByName(rest)


def reorder_samples(df: DataFrame, order: DataFrame) -> DataFrame:
    """Rows of df for order (sample, place); a listed sample that df lacks is an error."""
    joined = order.join(df.withColumn("_found", F.lit(True)), "sample", "left")
    return joined.where(F.assert_true(F.col("_found").isNotNull(), "a listed sample is missing").isNull()).drop("_found")


def ac_pass(df: DataFrame, p: str, includes: list[str]) -> Column:
    """Any include column that df has is true; without one, p is known."""
    known = [F.coalesce(F.col(c), F.lit(False)) for c in includes if c in df.columns]
    return reduce(lambda x, y: x | y, known) if known else F.col(p).isNotNull()


def case_carriers(het, hom) -> Column:
    return F.coalesce(col(het), F.lit(0)) + F.coalesce(col(hom), F.lit(0))


def coverage_note(assoc: DataFrame, kept: DataFrame, cut: float) -> DataFrame:
    """By phenotype: significant rows, rows of the kept table, and whether the kept table can hold all significant ones."""
    found = assoc.groupBy("phenotype").agg(F.count_if(F.col("p") < cut).alias("n_significant"))
    have = kept.groupBy("phenotype").agg(F.count("*").alias("n_kept"))
    return found.join(have, "phenotype", "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0))).withColumn("covered", F.col("n_kept") >= F.col("n_significant"))


def imputed_fraction(before: DataFrame, after: DataFrame, keys: list[str], group: str) -> DataFrame:
    """By group: the share of calls (a1, a2) that were missing before and are called after."""
    called = F.col("a1").isNotNull() & F.col("a2").isNotNull()
    both = before.select(*keys, called.alias("_b")).join(after.select(*keys, group, called.alias("_a")), keys)
    return both.groupBy(group).agg(F.count("*").alias("n"), F.avg((~F.col("_b") & F.col("_a")).cast("double")).alias("imputed"))


def case_control_map(pheno: DataFrame, keep: DataFrame) -> DataFrame:
    """1: case, 0: control, others go; only listed samples."""
    status = F.when(F.col("value") == 1, "case").when(F.col("value") == 0, "control")
    return pheno.join(keep, "person", "left_semi").withColumn("status", status).where("status IS NOT NULL")


def fill_labels(df: DataFrame, sources: list[str]) -> DataFrame:
    """label from the first source that has one, and label_from; nothing is overwritten."""
    taken = F.coalesce(*(F.when(F.col(s).isNotNull(), F.struct(F.col(s).alias("label"), F.lit(s).alias("label_from"))) for s in sources))
    return df.withColumn("_t", taken).select(*df.columns, "_t.label", "_t.label_from")


def restrict_to_sex(pheno: DataFrame, people: DataFrame, code: Column, sex: int) -> DataFrame:
    """Values of the codes are null for whoever is not of the sex."""
    joined = pheno.join(people.select(F.col("sample").alias("person"), "sex"), "person", "left")
    return joined.withColumn("value", F.when(~code | (F.col("sex") == sex), F.col("value"))).drop("sex")


def trace_summary(trace: DataFrame, keys: list[str], busy: str) -> DataFrame:
    """By task: samples, mean, 95th percentile and peak of the busy column."""
    return trace.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(busy).alias("mean"), F.percentile(busy, 0.95).alias("p95"), F.max(busy).alias("peak"))
