"""Row-level rules as column expressions: genotypes, site types and lengths, classes, codes and rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_present(df: DataFrame, *names: str) -> str:
    """The first of the names that df has as a column."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {names} is a column")


def gt_stats(a1, a2) -> dict[str, Column]:
    """Alternate count, allele number, carrier flag; a missing allele counts in neither."""
    a1, a2 = col(a1), col(a2)
    alt = sum((F.coalesce((a > 0).cast("int"), F.lit(0)) for a in (a1, a2)), F.lit(0))
    return {"ac": alt, "an": a1.isNotNull().cast("int") + a2.isNotNull().cast("int"), "carrier": alt > 0}


def gt_class(a1, a2) -> Column:
    """hom_ref, het, hom_alt; any missing allele: missing; two different alternates: other."""
    a1, a2 = col(a1), col(a2)
    return (
        F.when(a1.isNull() | a2.isNull(), "missing")
        .when((a1 == 0) & (a2 == 0), "hom_ref")
        .when((a1 == 0) != (a2 == 0), "het")
        .when(a1 == a2, "hom_alt")
        .otherwise("other")
    )


def norm_gt(a1, a2) -> Column:
    """Alleles in order, phase dropped; null if any is missing."""
    a1, a2 = col(a1), col(a2)
    return F.when(a1.isNotNull() & a2.isNotNull(), F.concat_ws("/", F.least(a1, a2), F.greatest(a1, a2)))


def is_sentinel(gt, gq, dp, low_gq: int = 20) -> Column:
    """A hom_ref call with no or zero depth and low quality only holds a place."""
    return (col(gt) == "hom_ref") & (F.coalesce(col(dp), F.lit(0)) == 0) & F.coalesce(col(gq) < low_gq, F.lit(False))


def infer_svtype(ref, alt, info_type, source) -> Column:
    """Source bnd: its INFO type or BND; else the INFO type before a colon, the symbolic ALT, a bracket (BND), else by the sign of the length."""
    ref, alt, info_type = col(ref), col(alt), F.nullif(F.split_part(col(info_type), F.lit(":"), F.lit(1)), F.lit(""))
    symbol = F.nullif(F.split_part(F.regexp_extract(alt, "^<([^>]+)>$", 1), F.lit(":"), F.lit(1)), F.lit(""))
    size = F.length(F.split_part(alt, F.lit(","), F.lit(1))) - F.length(ref)
    by_size = F.when(size > 0, "INS").when(size < 0, "DEL").otherwise("OTHER")
    return F.when(col(source) == "bnd", F.coalesce(info_type, F.lit("BND"))).otherwise(F.coalesce(info_type, symbol, F.when(alt.rlike(r"[\[\]]"), "BND"), by_size))


def infer_svlen(ref, alt, info_len) -> Column:
    """First INFO length; symbolic: null; else first ALT minus REF."""
    alt = col(alt)
    return F.coalesce(F.expr("1") * F.try_to_number(F.split_part(F.coalesce(col(info_len).cast("string"), F.lit("")), F.lit(","), F.lit(1)), F.lit("S9999999999")).cast("long"), F.when(~alt.rlike(r"[<\[\]]"), (F.length(F.split_part(alt, F.lit(","), F.lit(1))) - F.length(col(ref))).cast("long")))


def size_flags(svlen, svtype) -> dict[str, Column]:
    """At least 20 and at least 50 by absolute length; BND or null: neither."""
    known = F.coalesce((col(svtype) != "BND"), F.lit(False)) & col(svlen).isNotNull()
    return {f"ge{n}": F.coalesce(known & (F.abs(col(svlen)) >= n), F.lit(False)) for n in (20, 50)}


def freq_class(ac, an, n_carriers, n_samples) -> Column:
    """In this order: all samples carry it: shared; one allele or none: singleton; half the alleles or more: major; else polymorphic."""
    af = F.try_divide(col(ac), col(an))
    return F.when(col(n_carriers) >= n_samples, "shared").when(col(ac) <= 1, "singleton").when(af >= 0.5, "major").otherwise("polymorphic")


def score_bin(phred) -> Column:
    x = col(phred)
    return F.when(x.isNull() | F.isnan(x), "unscored").when(x < 10, "low").when(x < 20, "mid").otherwise("high")


def small_allele(ref, alt) -> tuple[Column, Column]:
    """(class, signed length) of a short variant; of equal lengths exactly one mismatch is a snv, more are mnp, none ref."""
    ref, alt = col(ref), col(alt)
    d = F.length(alt) - F.length(ref)
    wrong = F.aggregate(F.sequence(F.lit(1), F.length(ref)), F.lit(0), lambda a, i: a + (F.substring(ref, i, F.lit(1)) != F.substring(alt, i, F.lit(1))).cast("int"))
    plain = ref.rlike("^[ACGTN]+$") & alt.rlike("^[ACGTN]+$")
    kind = F.when(~plain, "other").when(d != 0, "indel").when(wrong == 0, "ref").when(wrong == 1, "snv").otherwise("mnp")
    return kind, F.when(plain, d)


def signed_sv_length(svtype, svlen) -> Column:
    x = col(svlen)
    return F.when(col(svtype) == "DEL", -F.abs(x)).when(col(svtype).isin("INS", "DUP"), F.abs(x)).otherwise(x)


def allele_bp(ref, alts, svtype, svlen, end, pos) -> Column:
    """Signed bp by allele index, REF first (0); null where no allele changes length.

    Sequence ALT: length difference; symbolic: its SVLEN (one for each ALT, or one for all), signed by type, or END for a deletion; else 0."""
    ref, alts, svlen = col(ref), col(alts), col(svlen)
    kind = lambda a: F.coalesce(F.nullif(F.regexp_extract(a, "^<([A-Za-z]+)", 1), F.lit("")), col(svtype))
    own = lambda i: F.coalesce(F.get(svlen, i), F.when(F.size(svlen) == 1, F.get(svlen, F.lit(0))))

    def one(a: Column, i: Column) -> Column:
        k, n = kind(a), F.abs(own(i))
        symbolic = F.when(k == "DEL", -F.coalesce(n, col(end) - col(pos))).when(k.isin("INS", "DUP"), n).otherwise(F.lit(0))
        sequence = (F.length(a) - F.length(ref)).cast("long")
        return F.coalesce(F.when(a.startswith("<"), symbolic.cast("long")).when(a.rlike("^[ACGTNacgtn]+$"), sequence).otherwise(F.lit(0).cast("long")), F.lit(0).cast("long"))

    each = F.transform(alts, one)
    return F.when(F.exists(each, lambda x: x != 0), F.concat(F.array(F.lit(0).cast("long")), each))


def record_span(pos, ref, bp, end) -> tuple[Column, Column]:
    """Half-open span: from pos - 1 over REF, the longest deletion and END."""
    start = col(pos) - 1
    longest = F.coalesce(-F.array_min(col(bp)), F.lit(0))
    return start, F.greatest(start + F.length(col(ref)), start + longest, F.coalesce(col(end), start + 1))


def reference_interval(svtype, pos, end, svlen) -> tuple[Column, Column]:
    """Half-open context interval: an insertion whose end came from its length is its 1 bp anchor; swapped if reversed; 1 bp at least."""
    start, stop = col(pos) - 1, F.coalesce(col(end), col(pos))
    from_length = (col(svtype) == "INS") & (stop == col(pos) + F.abs(col(svlen)))
    stop = F.when(F.coalesce(from_length, F.lit(False)), col(pos)).otherwise(stop)
    low, high = F.least(start, stop), F.greatest(start, stop)
    return low, F.greatest(high, low + 1)


def sample_fails(gq, dp, rnc, min_gq: int = 20, min_dp: int = 10) -> Column:
    """True when quality or depth is low or the no-call reason holds I; null when neither is known and no I speaks."""
    bad = F.coalesce(col(rnc).contains("I"), F.lit(False))
    low = F.coalesce(col(gq) < min_gq, F.lit(False)) | F.coalesce(col(dp) < min_dp, F.lit(False))
    return F.when(bad, True).when(col(gq).isNull() & col(dp).isNull(), F.lit(None).cast("boolean")).otherwise(low)


def encode_binary(text) -> Column:
    x = F.lower(F.trim(col(text)))
    return F.when(x.isin("1", "1.0", "true", "t", "yes", "y", "case"), 1).when(x.isin("0", "0.0", "false", "f", "no", "n", "control"), 0)


def encode_sex(text) -> Column:
    x = F.lower(F.trim(col(text)))
    return F.when(x.isin("female", "f"), 0).when(x.isin("male", "m"), 1)


def phecode_of(name) -> Column:
    """CV_401_1 and CV_401.1 are one code; PH_ and PHECODE_ mark classic ones, which lose the mark."""
    x = F.upper(F.trim(col(name)))
    x = F.regexp_replace(x, "^(PHECODE_|PH_)", "")
    return F.regexp_replace(x, "([0-9])_([0-9])", "$1.$2")


def phecode_parent(code) -> Column:
    """One decimal digit less; a code without decimals has no parent."""
    x = col(code)
    return F.when(x.rlike(r"\.[0-9]{2,}$"), F.regexp_replace(x, "[0-9]$", "")).when(x.rlike(r"\.[0-9]$"), F.regexp_replace(x, r"\.[0-9]$", ""))


def round_digits(x, n: int = 5) -> Column:
    return F.round(col(x), n)


def signif_digits(x, n: int = 5) -> Column:
    """n significant digits; zero, null and what isn't finite pass through."""
    v = col(x)
    f = F.pow(F.lit(10.0), F.lit(n - 1) - F.floor(F.log10(F.abs(v))))
    return F.when(v.isNull() | (v == 0) | F.isnan(v) | (F.abs(v) == float("inf")), v).otherwise(F.round(v * f) / f)


def lps_bp(seq, motif: str, long_motif: int = 30) -> Column:
    """Length of the longest run of whole motif copies over all rotations of the motif; a long motif only as written."""
    turns = [motif] if len(motif) > long_motif else list(dict.fromkeys(motif[i:] + motif[:i] for i in range(len(motif))))
    runs = F.flatten(F.array(*(F.regexp_extract_all(col(seq), F.lit(f"((?:{m})+)"), F.lit(1)) for m in turns)))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def motif_group(k) -> Column:
    x = col(k)
    return F.when(x <= 6, x.cast("int").cast("string")).when(x <= 12, "7-12").when(x <= 24, "13-24").otherwise("25+")


def size_class(bp) -> Column:
    x = F.abs(col(bp))
    return F.when(x == 0, "0").when(x < 20, "1-19").when(x < 50, "20-49").otherwise(">=50")


def ancestry_rank(label, order: tuple[str, ...] = ("eur", "eas", "sas", "amr", "afr")) -> Column:
    """Place in the fixed order, unknown labels between the others and the African one, which is last."""
    x = F.lower(col(label))
    return reduce(lambda c, i: c.when(x == order[i], i), range(len(order) - 1), F.when(x == order[-1], len(order))).otherwise(len(order) - 1)


def indel_flanks(sites: DataFrame, flank: int) -> DataFrame:
    """chrom, start0, end0 round the REF span of each indel, wide enough for its longest allele, not below 0."""
    span = F.greatest(F.length("ref"), F.length("alt"))
    return sites.where(F.length("ref") != F.length("alt")).select("chrom", F.greatest(F.col("pos") - 1 - flank, F.lit(0)).alias("start0"), (F.col("pos") - 1 + span + flank).alias("end0"))


def one_hot(df: DataFrame, name: str) -> DataFrame:
    """A 0/1 column for each level but the most common (ties: the first by name); null stays null. A category has as many levels as the result columns."""
    levels = [r[0] for r in df.where(F.col(name).isNotNull()).groupBy(name).count().orderBy(F.desc("count"), name).collect()]
    return df.withColumns({f"{name}_{v}": F.when(F.col(name).isNotNull(), (F.col(name) == v).cast("int")) for v in sorted(levels[1:])})


def standardize(df: DataFrame, name: str) -> DataFrame:
    """name_z by the population deviation; no variance is an error."""
    told = df.agg(F.avg(name).alias("m"), F.stddev_pop(name).alias("s"))
    return df.crossJoin(F.broadcast(told)).withColumn(f"{name}_z", F.when(F.assert_true(F.col("s") > 0, f"{name} has no variance").isNull(), (F.col(name) - F.col("m")) / F.col("s"))).drop("m", "s")


def bnd_events(bnd: DataFrame) -> DataFrame:
    """Breakends (chrom, pos, alt) with mate_chrom and mate_pos from the ALT's brackets; of a reciprocal pair the one that is not beyond its mate stays."""
    at = bnd.withColumns({"mate_chrom": F.regexp_extract("alt", r"[\[\]]([^:\[\]]+):([0-9]+)[\[\]]", 1), "mate_pos": F.regexp_extract("alt", r"[\[\]]([^:\[\]]+):([0-9]+)[\[\]]", 2).try_cast("long")})
    other = at.select(F.col("chrom").alias("c"), F.col("pos").alias("p"), F.col("mate_chrom").alias("mc"), F.col("mate_pos").alias("mp")).distinct()
    beyond = F.struct("chrom", "pos") > F.struct("mate_chrom", "mate_pos")
    twin = (F.col("chrom") == F.col("mc")) & (F.col("pos") == F.col("mp")) & (F.col("mate_chrom") == F.col("c")) & (F.col("mate_pos") == F.col("p")) & beyond
    return at.join(other, twin, "left_anti")


def top_per(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def parse_info(info) -> Column:
    """k=v;flag to a map; a flag gets an empty value; '.' is an empty map."""
    parts = F.filter(F.split(col(info), ";"), lambda p: ~p.isin("", "."))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(parts, lambda p: F.split_part(p, F.lit("="), F.lit(1)))), lambda k: F.struct(k, F.element_at(F.filter(F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.regexp_replace(p, "^[^=]*=?", "").alias("v"))), lambda s: s["k"] == k), -1)["v"])))


def parse_format(fmt, cell) -> Column:
    """FORMAT keys to the values of a cell; a short cell is padded with null, '.' is null."""
    keys, values = F.split(col(fmt), ":"), F.split(col(cell), ":")
    return F.map_from_entries(F.transform(keys, lambda k, i: F.struct(k, F.nullif(F.get(values, i), F.lit(".")))))
