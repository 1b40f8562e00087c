"""Repeat loci, allele units, reads and families: joins, tallies and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import intervals as I
from strandlake.operators import rows as R

# --- repeat units


def tiling_period(seq) -> Column:
    """The smallest period p, at most half the length, whose first p letters tile the whole sequence; null where there is none."""
    x = R.col(seq)
    half = F.floor(F.length(x) / 2).cast("int")
    tiles = lambda p: (F.length(x) % p == 0) & (x == F.repeat(F.substring(x, F.lit(1), p), (F.length(x) / p).cast("int")))
    return F.when(half >= 1, F.get(F.filter(F.sequence(F.lit(1), half), tiles), F.lit(0)))


def annotate_repeat_units(sites: DataFrame, arrays: DataFrame) -> DataFrame:
    """sites (id, chrom, start0, end0, svtype, change, seq) with period and units.

    An insertion, deletion or duplication takes the array of most overlap, then of the smaller period, among those that it overlaps and whose
    period divides its change of length; where none does, the smallest period that tiles seq. units: change / period, signed."""
    changed = sites.where("svtype IN ('INS', 'DEL', 'DUP') AND change <> 0")
    pairs = I.range_join(changed.select("id", "chrom", "start0", "end0", "change"), arrays.select("chrom", "start0", "end0", "period")).where("change % period_r = 0")
    shared = F.least("end0", "end0_r") - F.greatest("start0", "start0_r")
    best = R.top_per(pairs.withColumn("shared", shared), ["id"], F.desc("shared"), F.asc("period_r")).select("id", F.col("period_r").alias("array"))
    own = F.when(F.length("seq") == F.abs("change"), tiling_period("seq"))
    out = sites.join(best, "id", "left").withColumn("period", F.coalesce("array", F.when(F.col("svtype").isin("INS", "DEL", "DUP") & (F.col("change") != 0), own)).cast("bigint"))
    return out.select(*sites.columns, "period", F.expr("change div period").alias("units"))


def allele_units(ref_length, alt_lengths, svtype, units, signed=None) -> Column:
    """Units by allele index, REF first with 0: the signed value where it is given, else units with the sign of the change of length, or where the
    lengths are equal that of the type. As many units as ALTs, or an error."""
    sign = lambda n: F.when(n != R.col(ref_length), F.signum(n - R.col(ref_length))).when(R.col(svtype) == "DEL", -1).when(R.col(svtype).isin("INS", "DUP"), 1).otherwise(0)
    each = F.zip_with(R.col(alt_lengths), R.col(units), lambda n, u: (sign(n) * F.abs(u)).cast("bigint"))
    if signed is not None:
        each = F.coalesce(R.col(signed), each)
    right = F.assert_true(F.size(R.col(alt_lengths)) == F.size(R.col(units)), "units and ALTs differ in number").isNull()
    return F.when(right, F.concat(F.array(F.lit(0).cast("bigint")), each))


def repeat_definitions(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """calls (chrom, pos, end, locus, motifs) as definition rows, pos as it stands, with whether the catalog has the locus at these coordinates."""
    text = F.format_string("%s\t%d\t%d\tID=%s;MOTIFS=%s;STRUC=(%s)n", "chrom", "pos", "end", "locus", "motifs", "motifs")
    known = catalog.select("locus", F.col("chrom").alias("c"), F.col("start0").alias("s"), F.col("end0").alias("e"))
    out = calls.join(known, "locus", "left")
    return out.select("locus", text.alias("row"), F.coalesce((F.col("chrom") == F.col("c")) & (F.col("pos") == F.col("s")) & (F.col("end") == F.col("e")), F.lit(False)).alias("agrees"))


def lookup_locus(reads: DataFrame, loci: DataFrame) -> DataFrame:
    """reads (id, chrom, start0, end0) with the locus of largest overlap (ties: the smaller name), the overlap, and whether several overlap."""
    shared = F.least("end0", "end0_r") - F.greatest("start0", "start0_r")
    pairs = I.range_join(reads.select("id", "chrom", "start0", "end0"), loci.select("chrom", "start0", "end0", "locus")).withColumn("overlap", shared)
    n = F.count("*").over(W.partitionBy("id"))
    return R.top_per(pairs.withColumn("ambiguous", n > 1), ["id"], F.desc("overlap"), F.asc("locus_r")).select("id", F.col("locus_r").alias("locus"), "overlap", "ambiguous")


def collect_votes(reads: DataFrame, haps: DataFrame) -> DataFrame:
    """reads (read, locus, slot) joined by name with haps (read, hap): (locus, slot, hap, n) of the votes, and why the others are none, as reason.

    A read that stands twice on either side, one without haplotype, one that haps lack, and one without slot are no vote."""
    told = haps.groupBy("read").agg(F.min("hap").alias("hap"), F.count("*").alias("n_hap"))
    mine = reads.withColumn("n_read", F.count("*").over(W.partitionBy("read", "locus")))
    why = F.when(F.col("n_hap").isNull(), "not tagged").when((F.col("n_hap") > 1) | (F.col("n_read") > 1), "several").when(F.col("hap").isNull(), "no haplotype").when(F.col("slot").isNull(), "no slot").otherwise("vote")
    out = mine.join(told, "read", "left").withColumn("reason", why)
    vote = F.col("reason") == "vote"
    return out.groupBy("locus", F.when(vote, F.col("slot")).alias("slot"), F.when(vote, F.col("hap")).alias("hap"), "reason").agg(F.count("*").alias("n"))


def assign_slots(votes: DataFrame, least: int = 3, purity: float = 0.8) -> DataFrame:
    """votes (locus, slot, hap, n) to (locus, hap0, hap1, phased): the majority haplotype of each slot (ties: the smaller), with enough reads and
    purity, and only where both slots have one and they differ."""
    told = votes.groupBy("locus", "slot").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("hap", F.struct("n", -F.col("hap"))).alias("hap"))
    sure = told.withColumn("hap", F.when((F.col("n") >= least) & (F.col("top") >= purity * F.col("n")), F.col("hap")))
    wide = sure.groupBy("locus").agg(*(F.max(F.when(F.col("slot") == s, F.col("hap"))).alias(f"hap{s}") for s in (0, 1)))
    return wide.withColumn("phased", F.coalesce(F.col("hap0") != F.col("hap1"), F.lit(False)))


# --- locus tables


def compare_locus_dosage(a: DataFrame, b: DataFrame) -> DataFrame:
    """b's calls (locus, sample, dosage) against a's: a locus that a lacks is reference length (0), a missing call on either side drops out."""
    mine = a.select("locus", "sample", F.col("dosage").alias("other"), F.lit(True).alias("there"))
    both = b.where("dosage IS NOT NULL").join(mine, ["locus", "sample"], "left").where("there IS NULL OR other IS NOT NULL")
    return both.select("locus", "sample", "dosage", F.coalesce("other", F.lit(0).cast("bigint")).alias("other"), F.col("there").isNull().alias("absent"))


def dosage_agreement(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("locus").agg(F.count("*").alias("n"), F.count_if(F.col("dosage") == F.col("other")).alias("equal"), F.count_if("absent").alias("absent"), F.sum(F.abs(F.col("dosage") - F.col("other"))).alias("apart"))


def submission_sites(votes: DataFrame, purity: float) -> DataFrame:
    """votes (group, person, site): the majority site of each group, from people who name one site only, where its share reaches the purity."""
    clear = votes.groupBy("group", "person").agg(F.min("site").alias("site"), F.count_distinct("site").alias("kinds")).where("kinds = 1")
    n = clear.groupBy("group", "site").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("group")))
    return R.top_per(n, ["group"], F.desc("n"), F.asc("site")).where(F.col("share") >= purity)


def choose_uri(files: DataFrame, preferred: list[str]) -> DataFrame:
    """files (person, site, uri): the one of the earliest preferred site, else the first uri."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preferred)), F.col("site")), F.lit(0)), F.lit(len(preferred) + 1))
    return R.top_per(files.withColumn("place", place), ["person"], F.asc("place"), F.asc("uri")).drop("place")


def pair_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Calls (locus, sample, x, y: changes of length) of two runs: unordered pairs that are equal, by the class of the largest change."""
    other = b.select("locus", "sample", F.col("x").alias("x2"), F.col("y").alias("y2"))
    both = a.join(other, ["locus", "sample"]).where("x IS NOT NULL AND y IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")
    equal = (F.least("x", "y") == F.least("x2", "y2")) & (F.greatest("x", "y") == F.greatest("x2", "y2"))
    largest = F.greatest(*(F.abs(c) for c in ("x", "y", "x2", "y2")))
    return both.groupBy(R.size_class(largest).alias("size")).agg(F.count("*").alias("n"), F.count_if(equal).alias("equal"))


def first_rows(df: DataFrame, key: str) -> DataFrame:
    """One row a key: the smallest by its columns as text in byte order, null as empty text."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    return R.top_per(df.withColumn("_line", line), [key], F.asc("_line")).drop("_line")


def merge_pcs(cov: DataFrame, pcs: DataFrame, controls: DataFrame, key: str) -> DataFrame:
    """cov with pcs' columns and has_lr_pcs, and below it the control rows that cov lacks, as is_reference_control."""
    with_pcs = lambda df: df.join(pcs.withColumn("_has", F.lit(True)), key, "left").withColumn("has_lr_pcs", F.coalesce("_has", F.lit(False))).drop("_has")
    extra = controls.join(cov, key, "left_anti")
    return with_pcs(cov).withColumn("is_reference_control", F.lit(False)).unionByName(with_pcs(extra).withColumn("is_reference_control", F.lit(True)), allowMissingColumns=True)


def bin_spectrum(values: DataFrame, column: str, edges: list[float], least: int) -> list[tuple[float, float, int]]:
    """(low, high, n) over the edges; neighbours are merged from the left until each holds `least` (a remainder joins the last)."""
    place = sum(((F.col(column) >= e).cast("int") for e in edges), F.lit(0))
    n = {r.b: r.n for r in values.where(F.col(column).isNotNull()).groupBy(place.alias("b")).agg(F.count("*").alias("n")).collect()}  # as many rows as edges
    out, low, total = [], edges[0], 0
    for i in range(1, len(edges)):
        total += n.get(i, 0)
        if total >= least:
            out.append((low, edges[i], total))
            low, total = edges[i], 0
    if total and out:
        out[-1] = (out[-1][0], edges[-1], out[-1][2] + total)
    elif total:
        out.append((low, edges[-1], total))
    return out


def allele_counts(calls: DataFrame, catalog: DataFrame, samples: DataFrame) -> DataFrame:
    """calls (locus, sample, pos, d1, d2): haplotypes by locus and dosage, and the missing ones as a null dosage.

    Of several rows of a locus in a sample the first (smallest pos) counts; one with d2 null and d1 given is hemizygous and has one haplotype; a locus of the
    catalog that a sample lacks is missing twice."""
    one = R.top_per(calls, ["locus", "sample"], F.asc("pos"), F.asc_nulls_last("d1"), F.asc_nulls_last("d2"))
    present = one.select("locus", F.explode(F.when(F.col("d1").isNull() & F.col("d2").isNull(), F.array("d1", "d2")).otherwise(F.array_compact(F.array("d1", "d2")))).alias("dosage"))
    n = present.groupBy("locus", "dosage").agg(F.count("*").alias("n"))
    total = samples.agg(F.count_distinct("sample").alias("n_samples"))
    seen = catalog.select("locus").distinct().join(one.groupBy("locus").agg(F.count("*").alias("seen")), "locus", "left")
    absent = seen.crossJoin(F.broadcast(total)).select("locus", F.lit(None).cast("bigint").alias("dosage"), (2 * (F.col("n_samples") - F.coalesce("seen", F.lit(0)))).alias("n")).where("n > 0")
    return n.unionByName(absent).groupBy("locus", "dosage").agg(F.sum("n").alias("n"))


def select_examples(ranked: DataFrame, passes: Column, per_group: str | None, most: int) -> DataFrame:
    """The best `most` rows by rank that pass, at most one of each group where a group is named."""
    good = ranked.where(passes)
    if per_group:
        good = R.top_per(good, [per_group], F.asc("rank"))
    return good.orderBy("rank").limit(most)


def repeat_qc_report(qc: DataFrame) -> DataFrame:
    """By chromosome: shares of missing haplotypes, possible duplicates and inconsistent ancestry; null without haplotypes."""
    return qc.groupBy("chrom").agg(F.sum("n_hap").alias("n_hap"), *(F.try_divide(F.sum(c), F.sum("n_hap")).alias(f"{c}_share") for c in ("missing", "duplicate", "inconsistent")))


def corr2_crosstab(loci: DataFrame, freq_edges: list[float], r2_edges: list[float]) -> DataFrame:
    """Counts of loci (freq, r2) by frequency and squared correlation class, with totals as null."""
    place = lambda c, edges: sum(((F.col(c) >= e).cast("int") for e in edges), F.lit(0)).cast("bigint")
    classed = loci.select(place("freq", freq_edges).alias("freq_class"), place("r2", r2_edges).alias("r2_class"))
    return classed.cube("freq_class", "r2_class").agg(F.count("*").alias("n"))


# --- samples


def sample_counters(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """By sample, from the genotypes: n_het, n_hom, n_missing, transitions and transversions of single-letter alternates that it carries."""
    snv = (F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("ref") != F.col("alt"))
    pair = F.concat(F.least("ref", "alt"), F.greatest("ref", "alt"))
    carried = (F.coalesce("a1", F.lit(0)) > 0) | (F.coalesce("a2", F.lit(0)) > 0)
    c = calls.join(sites.select("site", "ref", "alt"), "site")
    called = F.col("a1").isNotNull() & F.col("a2").isNotNull()
    return c.groupBy("sample").agg(
        F.count_if(called & (F.col("a1") != F.col("a2"))).alias("n_het"), F.count_if(called & (F.col("a1") == F.col("a2")) & (F.col("a1") > 0)).alias("n_hom"), F.count_if(~called).alias("n_missing"),
        F.count_if(carried & snv & pair.isin("AG", "CT")).alias("ts"), F.count_if(carried & snv & ~pair.isin("AG", "CT")).alias("tv"),
    )


def sample_qc(counters: DataFrame) -> DataFrame:
    """counters by (sample, chrom) rolled up over the autosomes and over all, with het + hom and ratios (null on zero)."""
    def over(rows: DataFrame, name: str) -> DataFrame:
        s = {c: F.sum(c) for c in ("n_het", "n_hom", "ts", "tv")}
        return rows.groupBy("sample").agg((s["n_het"] + s["n_hom"]).alias(f"{name}_variants"), F.try_divide(s["ts"], s["tv"]).alias(f"{name}_titv"), F.try_divide(s["n_het"], s["n_hom"]).alias(f"{name}_het_hom"))

    return over(counters.where(F.regexp_replace("chrom", "^chr", "").try_cast("int").isNotNull()), "auto").join(over(counters, "all"), "sample", "full")


def sample_strata(values: DataFrame, column: str, strata: dict[str, Column]) -> DataFrame:
    """Mean and sample deviation in strata that may overlap."""
    labels = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in strata.items())))
    return values.select(column, F.explode(labels).alias("stratum")).groupBy("stratum").agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))


# --- families


def classify_families(members: DataFrame, depth: DataFrame) -> DataFrame:
    """By family (family, member, parents: number of its parents in the family): incomplete, multi-generational, trio, quartet or other."""
    told = members.join(depth, "member", "left").groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.col("parents") == 2).alias("children"), F.max(F.coalesce("depth", F.lit(0))).alias("deep"))
    kind = F.when(F.col("children") == 0, "incomplete").when(F.col("deep") > 1, "multi-generational").when((F.col("n") == 3) & (F.col("children") == 1), "trio").when((F.col("n") == 4) & (F.col("children") == 2), "quartet").otherwise("other")
    return told.select("family", "n", "children", kind.alias("kind"))


def complete_families(members: DataFrame, observed: DataFrame, key: str = "member") -> DataFrame:
    """Members of families all of whose recorded members are observed."""
    seen = members.join(observed.select(F.col(key).alias("member")).distinct().withColumn("there", F.lit(True)), "member", "left")
    whole = seen.groupBy("family").agg(F.count("*").alias("size"), F.count("there").alias("n")).where("size = n").select("family", "size")
    return members.join(whole, "family")


def expected_crossovers(spans: DataFrame, genetic: DataFrame, meioses: int) -> DataFrame:
    """spans (id, chrom, start0, end0) with expected crossovers: the map (chrom, pos, cm) interpolated at both ends, as Morgans times meioses.

    Beyond the map's ends its end value counts; a chromosome without a map gives null."""
    ends = spans.select("id", "chrom", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start0").alias("pos")), F.struct(F.lit(1).alias("side"), F.col("end0").alias("pos")))).alias("e")).select("id", "chrom", "e.side", "e.pos")
    after = I.covering_join(ends, genetic.select("chrom", "pos", "cm")).withColumnRenamed("cm", "cm1").withColumnRenamed("marker_pos", "pos1").drop("exact")
    both = I.previous_join(after, genetic).withColumnRenamed("marker_pos", "pos0")
    low = genetic.groupBy("chrom", "pos").agg(F.min("cm").alias("cm0")).select("chrom", F.col("pos").alias("pos0"), "cm0")
    both = both.join(low, ["chrom", "pos0"], "left")
    at = F.when(F.col("pos1") <= F.col("pos"), F.col("cm1")).when(F.col("pos0").isNull(), F.col("cm1")).when(F.col("pos1") == F.col("pos0"), F.col("cm1")).otherwise(F.col("cm0") + (F.col("cm1") - F.col("cm0")) * (F.col("pos") - F.col("pos0")) / (F.col("pos1") - F.col("pos0")))
    return both.withColumn("at", at).groupBy("id").agg(((F.max(F.when(F.col("side") == 1, F.col("at"))) - F.max(F.when(F.col("side") == 0, F.col("at")))) / 100 * meioses).alias("crossovers"))


# --- local ancestry


def nearest_het(sw: DataFrame, calls: DataFrame) -> DataFrame:
    """Each switch (sample, hap, chrom, pos) with het_pos: its own place if the call there is heterozygous, else the closer flanking het call (the
    one before on ties), else null. calls: sample, chrom, pos, het."""
    marks = calls.where("het").select("sample", "chrom", "pos", F.col("pos").alias("h"))
    wanted = sw.select("sample", "hap", "chrom", "pos", F.lit(None).cast("long").alias("h"), F.lit(True).alias("_t"))
    both = wanted.unionByName(marks.withColumns({"hap": F.lit(None).cast("long"), "_t": F.lit(False)}))
    w = W.partitionBy("sample", "chrom").orderBy("pos")
    near = both.withColumns({"before": F.last("h", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, 0)), "after": F.first("h", ignorenulls=True).over(w.rangeBetween(0, W.unboundedFollowing))}).where("_t")
    pick = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull(), F.col("before")).when(F.col("pos") - F.col("before") <= F.col("after") - F.col("pos"), F.col("before")).otherwise(F.col("after"))
    return near.select("sample", "hap", "chrom", "pos", pick.alias("het_pos"))


def switch_quality(calls: DataFrame, sw: DataFrame, low: int = 20) -> DataFrame:
    """Calls (sample, chrom, pos, a1, a2, gq, dp, rnc) by whether an ancestry switch stands there and by genotype class: how many, mean and low GQ, mean DP, share of imputed."""
    at = sw.select("sample", "chrom", "pos").distinct().withColumn("s", F.lit(True))
    kind = F.when(F.col("a1").isNull() | F.col("a2").isNull(), "missing").when(F.col("a1") != F.col("a2"), "het").when(F.col("a1") == 0, "hom_ref").otherwise("hom_alt")
    out = calls.join(at, ["sample", "chrom", "pos"], "left").withColumns({"is_switch": F.coalesce("s", F.lit(False)), "gt_class": kind})
    return out.groupBy("is_switch", "gt_class").agg(F.count("*").alias("n"), F.avg("gq").alias("gq"), F.try_divide(F.count_if(F.col("gq") < low), F.count("gq")).alias("gq_low"), F.avg("dp").alias("dp"), F.avg((F.col("rnc") == "I.").cast("double")).alias("sentinel"))


def complementary_flips(sw: DataFrame) -> DataFrame:
    """By sample: places where both haplotypes switch, and those where they swap labels."""
    of = lambda h, c: F.max(F.when(F.col("hap") == h, F.col(c)))
    wide = sw.groupBy("sample", "chrom", "pos").agg(of(1, "from_anc").alias("f1"), of(1, "to_anc").alias("t1"), of(2, "from_anc").alias("f2"), of(2, "to_anc").alias("t2"))
    both = wide.where("t1 IS NOT NULL AND t2 IS NOT NULL")
    return both.groupBy("sample").agg(F.count("*").alias("both"), F.count_if((F.col("f1") == F.col("t2")) & (F.col("f2") == F.col("t1"))).alias("swapped"))


def switch_density(sw: DataFrame, samples: DataFrame, mb: float) -> DataFrame:
    """By ancestry: samples, switches, and switches a haplotype and Mb; samples without switches count."""
    n = sw.groupBy("sample").agg(F.count("*").alias("n"))
    return samples.join(n, "sample", "left").groupBy("ancestry").agg(F.count("*").alias("samples"), F.sum(F.coalesce("n", F.lit(0))).alias("switches"), (F.sum(F.coalesce("n", F.lit(0))) / (F.count("*") * 2 * mb)).alias("rate"))


def allele_ancestry_score(haps: DataFrame, af: DataFrame, least: float = 1e-6) -> DataFrame:
    """By ancestry: haplotypes, mean log likelihood of their alleles under the panel's frequency (clipped), and the Brier score. af: chrom, pos, anc, af."""
    p = F.least(F.greatest("af", F.lit(least)), F.lit(1 - least))
    out = haps.where("allele IS NOT NULL AND anc IS NOT NULL").join(af, ["chrom", "pos", "anc"])
    return out.groupBy("anc").agg(F.count("*").alias("n"), F.avg(F.when(F.col("allele") > 0, F.log(p)).otherwise(F.log(1 - p))).alias("loglik"), F.avg(F.pow((F.col("allele") > 0).cast("double") - p, 2)).alias("brier"))


def repeat_exposure(props: DataFrame, rate: float, loci: int) -> DataFrame:
    """props (sample, anc, share): by sample the chance of two ancestries, 1 - sum p^2, times het rate and loci."""
    return props.groupBy("sample").agg(((1 - F.sum(F.col("share") * F.col("share"))) * rate * loci).alias("exposure"))


def exposure_by_ancestry(props: DataFrame) -> DataFrame:
    """Expected haplotypes (2 a sample, by share) and samples that carry any, by ancestry."""
    return props.groupBy("anc").agg((2 * F.sum("share")).alias("haplotypes"), F.count_if(F.col("share") > 0).alias("carriers"))


def split_gt(haps: DataFrame, k: int) -> DataFrame:
    """site, sample, anc, gt: the phased genotype with haplotypes of another ancestry, and missing alleles, as a point."""
    side = lambda h: F.max(F.when(F.col("hap") == h, F.struct("allele", "anc")))
    wide = haps.groupBy("site", "sample").agg(side(1).alias("one"), side(2).alias("two"))
    each = wide.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    text = lambda c: F.when((F.col(f"{c}.anc") == F.col("k")) & F.col(f"{c}.allele").isNotNull(), F.col(f"{c}.allele").cast("string")).otherwise(".")
    return each.select("site", "sample", F.col("k").cast("bigint").alias("anc"), F.concat(text("one"), F.lit("|"), text("two")).alias("gt"))


def split_ru_dosage(haps: DataFrame, units: DataFrame, k: int, encoding: str) -> DataFrame:
    """site, sample, anc (and allele, for 'by_allele'): dosage over haplotypes of the ancestry, and n_hap, which counts haplotypes with a missing allele too.

    'sum': repeat units of the alleles; 'any': alternate alleles; 'by_allele': copies of each alternate. units: site, allele, units."""
    h = haps.where(F.col("anc").between(0, k - 1)).join(units, ["site", "allele"], "left")
    if encoding == "by_allele":
        each = h.groupBy("site", "sample", "anc").agg(F.count("*").alias("n_hap"))
        n = h.where("allele > 0").groupBy("site", "sample", "anc", "allele").agg(F.count("*").alias("dosage"))
        return n.join(each, ["site", "sample", "anc"])
    value = F.coalesce("units", F.lit(0)) if encoding == "sum" else (F.coalesce("allele", F.lit(0)) > 0).cast("bigint")
    return h.groupBy("site", "sample", "anc").agg(F.sum(value).alias("dosage"), F.count("*").alias("n_hap"))


# --- resampling and choice


def pick_winner(models: DataFrame) -> DataFrame:
    """models (group, model, lam, low, high, loglik): by group the smallest |lam - 1|; among those whose interval overlaps its own, the highest loglik, then the first name."""
    w = W.partitionBy("group").orderBy(F.abs(F.col("lam") - 1), "model").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near = models.withColumns({"l0": F.first("low").over(w), "h0": F.first("high").over(w)}).where("low <= h0 AND l0 <= high")
    return R.top_per(near, ["group"], F.desc("loglik"), F.asc("model")).drop("l0", "h0")


def models_table(parts: list[DataFrame]) -> DataFrame:
    """One table of per-population parts with equal columns; other columns are an error."""
    if len({tuple(p.columns) for p in parts}) != 1:
        raise ValueError("the parts' columns differ")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def case_counts(pheno: DataFrame, people: DataFrame, props: DataFrame, sex_of: Column) -> DataFrame:
    """By code and group: cases, and by ancestry the haplotypes to expect among them, 2 * sum of normalised shares.

    A code of one sex counts people of that sex only; sex_of: the sex that a code needs, or null."""
    cases = pheno.where("value = 1").withColumn("needs", sex_of).join(people, "person").where("needs IS NULL OR sex = needs")
    n = cases.groupBy("code", "group").agg(F.count("*").alias("cases"))
    norm = props.withColumn("share", F.try_divide("share", F.sum("share").over(W.partitionBy("person"))))
    hap = cases.join(norm, "person").groupBy("code", "group", "anc").agg((2 * F.sum("share")).alias("haplotypes"))
    return n.join(hap, ["code", "group"], "left")


def site_filter(sites: DataFrame, include: list[DataFrame], exclude: list[DataFrame]) -> DataFrame:
    """Sites (chrom, pos, id) in the union of the included tracks and outside the union of the excluded ones."""
    def union(tracks: list[DataFrame]) -> DataFrame:
        out = tracks[0].select("chrom", "start0", "end0")
        for t in tracks[1:]:
            out = out.unionByName(t.select("chrom", "start0", "end0"))
        return I.merge_intervals(out)

    out = sites
    if include:
        out = I.contains_point(out, union(include), "_in").where("_in").drop("_in")
    return I.contains_point(out, union(exclude), "_out").where("NOT _out").drop("_out") if exclude else out


def concept_persons(events: DataFrame, names: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """events (person, concept) by ancestor class: distinct persons and events. names: concept, name; hierarchy: concept, ancestor (each concept its own too)."""
    return events.join(names, "concept").join(hierarchy, "concept").groupBy("ancestor").agg(F.count_distinct("person").alias("persons"), F.count("*").alias("n"), F.count_distinct("name").alias("concepts"))


def batches(samples: DataFrame, key: str, most: int) -> DataFrame:
    """key and batch: the fewest batches of at most `most`, as even as possible, in the order of the key.

    Ranks come from range partitions: counts by partition are added up, so the order is no single task."""
    n = samples.count()
    parts = samples.select(key).repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id())
    w = W.partitionBy("_p").orderBy(key)
    told = parts.groupBy("_p").agg(F.count("*").alias("n"), F.min(key).alias("low"))
    ahead = told.select("_p", (F.sum("n").over(W.orderBy("low")) - F.col("n")).alias("ahead"))
    rank = parts.withColumn("r", F.row_number().over(w)).join(F.broadcast(ahead), "_p").withColumn("rank", F.col("ahead") + F.col("r") - 1)
    k = max(1, -(-n // most))
    small, more = n // k, n % k  # the first `more` batches hold one more
    batch = F.when(F.col("rank") < more * (small + 1), F.floor(F.col("rank") / (small + 1))).otherwise(more + F.floor((F.col("rank") - more * (small + 1)) / max(small, 1)))
    return rank.select(key, (batch + 1).cast("bigint").alias("batch"))
