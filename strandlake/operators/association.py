"""Review of association results: screens, hits, loci, contrasts; score tests from sparse dosages."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions.stats import chi2_tail
from strandlake.operators import genotypes
from strandlake.operators.intervals import cluster_positions
from strandlake.sources.tables import stage

GENOME_WIDE = 5e-8


def ac_pass(df: DataFrame, include: str = "include", p: str = "p") -> Column:
    """Any include flag where there is one, else a known p."""
    return F.coalesce(F.col(include), F.col(p).isNotNull()) if include in df.columns else F.col(p).isNotNull()


def spa_fallback(strata: list[dict[str, str]], z: float = 2.0, orders: float = 1.0) -> Column:
    """Whether some stratum's normal approximation stood in where it should not.

    A stratum names spa, t, var; or the conditioned statistic tc, var_c, pc with its unconditioned p: SPA not used and |t| / sqrt(var) > z;
    or a conditioned one beyond z that conditioning changed, more than `orders` ahead of the unconditioned p. Null counts as no."""
    parts = []
    for s in strata:
        if "spa" in s:
            parts.append(~F.col(s["spa"]) & (F.abs(F.col(s["t"])) / F.sqrt(F.col(s["var"])) > z))
        if "tc" in s:
            parts.append((F.abs(F.col(s["tc"])) / F.sqrt(F.col(s["var_c"])) > z) & (F.col(s["tc"]) != F.col(s["t"])) & (F.log10(F.col(s["p"])) - F.log10(F.col(s["pc"])) > orders))
    return reduce(lambda a, b: a | b, (F.coalesce(x, F.lit(False)) for x in parts), F.lit(False))


def case_carriers(het: str = "n_het", hom: str = "n_hom") -> Column:
    return F.coalesce(F.col(het), F.lit(0)) + F.coalesce(F.col(hom), F.lit(0))


def inbreeding(het: str, hom: str, n: str) -> Column:
    """F = 1 - observed over expected heterozygosity from control counts; null where an allele is absent."""
    p = (2 * F.col(hom) + F.col(het)) / (2 * F.col(n))
    return F.when((F.col(n) > 0) & (p > 0) & (p < 1), 1 - (F.col(het) / F.col(n)) / (2 * p * (1 - p)))


def hit_report(assoc: DataFrame, p: str, threshold: float, reasons: dict[str, Column]) -> DataFrame:
    """Rows below the threshold with the names of the screens that speak against them and a verdict."""
    named = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items())))
    out = assoc.where(F.col(p) < threshold).withColumn("reasons", F.array_join(named, ","))
    return out.withColumn("verdict", F.when(F.col("reasons") == "", "kept").otherwise("excluded"))


def dossier_loci(hits: DataFrame, gap: int = 500_000, flank: int = 250_000) -> DataFrame:
    """By phenotype and chromosome: hits within `gap` of the one before form a locus; its lead (smallest p, then marker), arms and window."""
    c = cluster_positions(hits, gap, ("phenotype", "chrom"))
    lead = F.min(F.struct("p", "marker", "pos"))
    out = c.groupBy("phenotype", "chrom", "cluster").agg(F.count("*").alias("n"), lead.alias("lead"), F.array_join(F.sort_array(F.collect_set("arm")), ",").alias("arms"))
    return out.select("phenotype", "chrom", "cluster", "n", F.col("lead.marker").alias("lead"), F.col("lead.p").alias("p"), F.col("lead.pos").alias("pos"), "arms", F.greatest(F.col("lead.pos") - flank, F.lit(0)).alias("low"), (F.col("lead.pos") + flank).alias("high"))


def recurrence(hits: DataFrame, window: int, least: int) -> DataFrame:
    """Loci (chromosome, first position) that hits of at least `least` phenotypes share: phenotypes and their names, hits, arms, hits by verdict
    (kept, excluded), best p. A locus of many unrelated phenotypes is more often a fault of the place than a finding."""
    c = cluster_positions(hits, window)
    names = lambda x: F.array_join(F.sort_array(F.collect_set(x)), ",")  # noqa: E731  of few values
    out = c.groupBy("chrom", "cluster").agg(F.count_distinct("phenotype").alias("phenotypes"), F.count("*").alias("n"), names("arm").alias("arms"), names("phenotype").alias("names"), F.count_if(F.col("verdict") == "kept").alias("kept"), F.count_if(F.col("verdict") == "excluded").alias("excluded"), F.min("p").alias("best"))
    return out.where(F.col("phenotypes") >= least)


def calibration_models(lambdas: DataFrame, base: str, most_apart: float) -> DataFrame:
    """phenotype, arm, lambda, gain over the base arm's, not_comparable: why the two cannot be compared (the base is missing, or the numbers of tests
    differ by more than a share of the base's), else null."""
    ref = lambdas.where(F.col("arm") == base).select("phenotype", F.col("n").alias("base_n"), F.col("lambda").alias("base"))
    out = lambdas.join(ref, "phenotype", "left")
    why = F.when(F.col("base_n").isNull(), "no_base").when(F.abs(F.col("n") - F.col("base_n")) > most_apart * F.col("base_n"), "tests_differ")
    return out.select("phenotype", "arm", F.round("lambda", 6).alias("lambda"), F.round(F.col("lambda") - F.col("base"), 6).alias("gain"), why.alias("not_comparable"))


def call_rate_by_group(calls: DataFrame, groups: DataFrame) -> DataFrame:
    """By site, for samples that groups (sample, group: case or control) names: numbers, no-calls, call rates and their difference, Fisher's p, and
    exact medians of dp and gq."""
    from strandlake.functions.stats import fisher_two_sided

    mine = calls.join(groups.where("group IN ('case', 'control')"), "sample").select("site", "group", (F.col("a1").isNull() | F.col("a2").isNull()).alias("gone"), "dp", "gq")
    is_ = lambda k: F.col("group") == k
    counted = (x for k in ("case", "control") for x in (F.count_if(is_(k)).alias(f"n_{k}"), F.count_if(is_(k) & F.col("gone")).alias(f"n_{k}_nocall")))
    medians = [F.percentile(F.when(is_(k), F.col(tag)), 0.5).alias(f"median_{tag}_{k}") for tag in ("dp", "gq") for k in ("case", "control")]
    # rows move once, as they are: a site's rows stream through counts, and what is held of them are their different depths and qualities
    n = mine.repartition("site").groupBy("site").agg(*counted, *medians)
    rate = lambda k: F.try_divide(F.col(f"n_{k}") - F.col(f"n_{k}_nocall"), F.col(f"n_{k}"))
    out = n.withColumns({"call_rate_case": rate("case"), "call_rate_control": rate("control")}).withColumn("call_rate_diff", F.col("call_rate_case") - F.col("call_rate_control"))
    out = out.withColumn("fisher_p", fisher_two_sided(F.col("n_case") - F.col("n_case_nocall"), F.col("n_case_nocall"), F.col("n_control") - F.col("n_control_nocall"), F.col("n_control_nocall")))
    last = [f"median_{tag}_{k}" for tag in ("dp", "gq") for k in ("case", "control")]
    return out.select(*(c for c in out.columns if c not in last), *last)


def run_summary(assoc: DataFrame, by: list[str], p: str, extra: list[str], threshold: float, top: int) -> DataFrame:
    """By run: tests, those that pass, those with p, hits that pass, best p, lambda of all, of those that pass, and of passing ones' extra columns, and the
    markers of the best `top` passing tests."""
    from strandlake.functions.stats import lambda_gc

    ok = F.coalesce(ac_pass(assoc), F.lit(False))
    out = assoc.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_pass"), F.count(p).alias("n_tested"), F.count_if(ok & (F.col(p) < threshold)).alias("n_hits"), F.min(p).alias("best"))
    passing = assoc.where(ok)
    first = passing.where(F.col(p).isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(p, "marker"))).where(F.col("_r") <= top)
    out = out.join(first.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "marker"))), lambda x: x["marker"]), ",").alias("top")), by, "left")
    for name, rows, column in (("all", assoc, p), ("pass", passing, p), *((c, passing, c) for c in extra)):
        out = out.join(lambda_gc(rows, column, by).select(*by, F.col("lambda").alias(f"lambda_{name}")), by, "left")
    return out


def corroborated(hits: DataFrame, window: int) -> DataFrame:
    """Loci of one phenotype with hits in two arms or more."""
    c = cluster_positions(hits, window, ("phenotype", "chrom"))
    return c.groupBy("phenotype", "chrom", "cluster").agg(F.count_distinct("arm").alias("arms"), F.count("*").alias("n")).where("arms >= 2")


def top_overlap(assoc: DataFrame, group: str, key: str, p: str, k: int) -> DataFrame:
    """For each pair of groups: how many of their k best keys they share, and the Jaccard index."""
    best = assoc.groupBy(group, key).agg(F.min(p).alias("p")).withColumn("r", F.row_number().over(W.partitionBy(group).orderBy("p", key))).where(F.col("r") <= k)
    size = best.groupBy(group).agg(F.count("*").alias("n"))
    pairs = best.select(F.col(group).alias("a"), key).join(best.select(F.col(group).alias("b"), key), key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    grid = size.select(F.col(group).alias("a"), F.col("n").alias("na")).join(size.select(F.col(group).alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    out = grid.join(pairs, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def best_p(assoc: DataFrame, by: list[str], p: str, passes: Column) -> DataFrame:
    """Smallest p among the rows that pass, with its marker; groups where none does are censored at their largest p."""
    out = assoc.withColumn("_ok", passes).groupBy(*by).agg(F.min(F.when(F.col("_ok"), F.struct(F.col(p).alias("p"), "marker"))).alias("b"), F.max(p).alias("top"))
    return out.select(*by, F.coalesce("b.p", "top").alias("p"), F.col("b.marker").alias("marker"), F.col("b").isNull().alias("censored"))


def arm_contrasts(loci: DataFrame, pairs: list[tuple[str, str]], threshold: float) -> DataFrame:
    """contrast, gained, lost, both, neither for pairs of p columns of loci, all in one aggregate; a missing p is not significant."""
    good = lambda c: F.coalesce(F.col(c) < threshold, F.lit(False))
    kinds = lambda a, b: (F.count_if(~good(a) & good(b)).alias("gained"), F.count_if(good(a) & ~good(b)).alias("lost"), F.count_if(good(a) & good(b)).alias("both"), F.count_if(~good(a) & ~good(b)).alias("neither"))
    one = loci.agg(F.array(*(F.struct(F.lit(f"{a}->{b}").alias("contrast"), *kinds(a, b)) for a, b in pairs)).alias("c"))
    return one.select(F.inline("c"))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], numbers: list[str], digits: int) -> DataFrame:
    """Rows on one side only, and by column the cells that differ after rounding."""
    x, y = a.select(*keys, *(F.round(c, digits).alias(f"{c}_a") for c in numbers), F.lit(1).alias("_a")), b.select(*keys, *(F.round(c, digits).alias(f"{c}_b") for c in numbers), F.lit(1).alias("_b"))
    j = x.join(y, keys, "full_outer")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), *(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).alias(f"{c}_differs") for c in numbers))


def phewas_matrix(hits: DataFrame, window: int) -> DataFrame:
    """phenotype, locus (chromosome and first position), largest -log10 p."""
    c = cluster_positions(hits, window)
    return c.groupBy("phenotype", F.concat_ws(":", "chrom", "cluster").alias("locus")).agg(F.max(-F.log10("p")).alias("strength"))


def effect_consistency(strata: DataFrame, by: list[str]) -> DataFrame:
    """Inverse-variance mean, Cochran's Q, its df and whether all effects have one sign, from rows (by, beta, se)."""
    s = strata.where("beta IS NOT NULL AND se > 0").withColumn("w", 1 / (F.col("se") * F.col("se")))
    out = s.groupBy(*by).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("beta")).alias("wb"), F.sum(F.col("w") * F.col("beta") * F.col("beta")).alias("wbb"), F.count("*").alias("k"), (F.min(F.signum("beta")) == F.max(F.signum("beta"))).alias("one_sign"))
    mean = F.col("wb") / F.col("w")
    return out.select(*by, mean.alias("mean"), F.greatest(F.col("wbb") - mean * F.col("wb"), F.lit(0.0)).alias("q"), (F.col("k") - 1).alias("df"), "one_sign")


def regional_support(assoc: DataFrame, leads: DataFrame, reach: int = 100_000, orders: float = 3.0) -> DataFrame:
    """By lead (lead, chrom, pos, p): neighbours within reach, those with p <= max(lead's p * 10^orders, 5e-8), those below 5e-8, the nearest supporting one's distance, and the best one's p and distance."""
    from strandlake.operators.intervals import range_join

    spans = leads.select("chrom", "lead", F.col("pos").alias("at"), "p", (F.col("pos") - reach).alias("start0"), (F.col("pos") + reach + 1).alias("end0"))
    points = assoc.select("chrom", "pos", "p").withColumns({"start0": F.col("pos"), "end0": F.col("pos") + 1})
    near = range_join(spans, points).where(F.col("pos_r") != F.col("at"))
    good = F.col("p_r") <= F.greatest(F.col("p") * 10**orders, F.lit(GENOME_WIDE))
    bp = F.abs(F.col("pos_r") - F.col("at"))
    best = F.min(F.when(good, F.struct(F.col("p_r").alias("p"), bp.alias("bp"))))
    got = near.groupBy("lead").agg(F.count("*").alias("neighbours"), F.count_if(good).alias("support"), F.count_if(F.col("p_r") < GENOME_WIDE).alias("significant"), F.min(F.when(good, bp)).alias("nearest"), best.alias("best"))
    return leads.select("lead").join(got, "lead", "left").na.fill(0, ["neighbours", "support", "significant"]).select("lead", "neighbours", "support", "significant", "nearest", F.col("best.p").alias("best_p"), F.col("best.bp").alias("best_bp"))


def mahalanobis(df: DataFrame, key: str, columns: list[str], group: str | None = None, top: float = 0.05, least: int = 2) -> DataFrame:
    """key, group, the distance to the group's mean under its covariance (pseudo-inverse where it is singular), rank and whether it is far out.

    Without a group all rows are one. Ranks fall with the distance, equal ones share the smallest; ceil(top * n) rows of a group, at least one,
    are far (ties by key). Groups of fewer than `least` rows and rows with a null component take no part. Covariances are sums by group; only
    their small inverses pass the driver, one for each group. Ranks come from counts by range bucket, so no group is one sort."""
    by = group or "_all"
    good = df.dropna(subset=columns).withColumn(by, F.col(group) if group else F.lit(1))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    told = good.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in columns), *(F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs)).where(F.col("n") >= least).toPandas()
    rows = []
    for r in told.to_dict("records"):
        cov = np.array([[r[f"c_{a}_{b}"] if (a, b) in pairs else r[f"c_{b}_{a}"] for b in columns] for a in columns], float)
        inverse = np.linalg.pinv(np.nan_to_num(cov))
        rows.append((r[by], [float(r[f"m_{c}"]) for c in columns], [float(x) for x in inverse.ravel()]))
    small = F.broadcast(df.sparkSession.createDataFrame(rows, f"{by} {good.schema[by].dataType.simpleString()}, m array<double>, s array<double>"))
    k = len(columns)
    d = F.zip_with(F.array(*columns), F.col("m"), lambda a, b: a - b)
    square = F.aggregate(F.sequence(F.lit(0), F.lit(k * k - 1)), F.lit(0.0), lambda acc, i: acc + F.get(F.col("d"), (i / k).cast("int")) * F.get(F.col("s"), i) * F.get(F.col("d"), (i % k).cast("int")))
    far = good.join(small, by).withColumn("d", d).select(key, by, F.sqrt(F.greatest(square, F.lit(0.0))).alias("distance"))
    far = far.withColumn("b", F.when(F.col("distance") > 0, F.greatest(F.floor(F.log2("distance") * 64), F.lit(-4096))).otherwise(-4097))
    sizes = far.groupBy(by, "b").agg(F.count("*").alias("k"))
    ahead = sizes.select(by, "b", (F.sum("k").over(W.partitionBy(by).orderBy(F.desc("b"))) - F.col("k")).alias("ahead"), F.sum("k").over(W.partitionBy(by)).alias("n"))
    inside = W.partitionBy(by, "b").orderBy(F.desc("distance"))
    ranked = far.join(ahead, [by, "b"]).withColumn("rank", F.col("ahead") + F.rank().over(inside))
    place = F.col("ahead") + F.row_number().over(W.partitionBy(by, "b").orderBy(F.desc("distance"), key))
    out = ranked.withColumn("far", place <= F.greatest(F.ceil(F.col("n") * F.lit(top)), F.lit(1)))
    return out.select(key, *([group] if group else []), "distance", "rank", "far")


def nearest(queries: DataFrame, refs: DataFrame, k: int, pivots: int = 128, block: int = 1024, chunk: int = 4096) -> DataFrame:
    """id, ref, label, d, r, compared: the k nearest references (id, label, v) of each query (id, v), Euclidean, ties by the reference's id.

    References lie in cells round pivots, the references of smallest hash (at most `pivots`, about the root of their number). Of each cell its
    radius and the k distances nearest its pivot are known everywhere: with a query's distances to the pivots they bound its k-th distance from above, and cells that
    lie beyond the bound never meet it. Inside a cell a reference is measured only where |d(query, pivot) - d(reference, pivot)| leaves a
    chance; `compared` counts those of a query. Large cells are dealt over chunks and a cell's queries over blocks, by hash; what is broadcast are pivots."""
    n = refs.count()
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"id {kind(queries, 'id')}, ref {kind(refs, 'id')}, label {kind(refs, 'label')}, d double, n long"
    if not n:
        return queries.sparkSession.createDataFrame([], f"id {kind(queries, 'id')}, ref {kind(refs, 'id')}, label {kind(refs, 'label')}, d double, r int, compared long")
    count = min(pivots, max(1, int(n**0.5)))
    centre = np.array([r.v for r in refs.orderBy(F.xxhash64("id"), "id").limit(count).select("v").collect()], float)

    def apart(v) -> np.ndarray:
        x = np.asarray([*v], float).reshape(len(v), -1)
        d = np.zeros((len(x), len(centre)))
        for j in range(x.shape[1]):
            d += (x[:, j : j + 1] - centre[:, j]) ** 2
        return np.sqrt(d)

    def settle(batches):
        for df in batches:
            if len(df):
                d = apart(df["v"])
                own = d.argmin(1)
                yield df.assign(cell=own.astype(np.int32), away=d[np.arange(len(d)), own])

    settled = stage(refs.select("id", "label", "v").mapInPandas(settle, f"id {kind(refs, 'id')}, label {kind(refs, 'label')}, v array<double>, cell int, away double"), "cells")
    near = W.partitionBy("cell").orderBy("away")
    told = settled.groupBy("cell").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    inner = settled.select("cell", "away", F.row_number().over(near).alias("i")).where(F.col("i") <= k).groupBy("cell").agg(F.collect_list("away").alias("inner"))
    cells = told.join(inner, "cell").collect()  # a row a pivot
    radius, chunks = np.full(len(centre), -1.0), np.zeros(len(centre), int)
    which, reach = [], []
    for r in cells:
        radius[r.cell], chunks[r.cell] = r.radius, r.chunks
        which += [r.cell] * len(r.inner)
        reach += r.inner
    which, reach = np.array(which), np.array(reach)

    def send(batches):
        for df in (whole.iloc[at : at + 512] for whole in batches for at in range(0, len(whole), 512)):  # a bound looks at k distances a pivot
            d = apart(df["v"])
            upper = d[:, which] + reach
            bound = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(d), np.inf)
            bound = bound * (1 + 1e-9) + 1e-9
            i, j = np.nonzero((radius >= 0) & (d - radius <= bound[:, None]))
            yield pd.DataFrame({"id": df["id"].to_numpy()[i], "v": df["v"].to_numpy()[i], "cell": j.astype(np.int32), "away": d[i, j], "bound": bound[i], "chunks": chunks[j].astype(np.int32)})

    sent = queries.select("id", "v").mapInPandas(send, f"id {kind(queries, 'id')}, v array<double>, cell int, away double, bound double, chunks int")
    sent = stage(sent, "sent")
    blocks = sent.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))

    def pack(df: DataFrame, keys: list, name: str, *columns: str) -> DataFrame:
        g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("id", "v", *columns))).alias("x"))
        return g.select(*keys, *(F.col(f"x.{c}").alias(f"{name}{c}") for c in ("id", *columns)), F.flatten(F.col("x.v")).alias(f"{name}v"))

    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    q = pack(sent.join(F.broadcast(blocks), "cell").withColumn("block", part(F.col("blocks"))), ["cell", "block", "chunks"], "q", "away", "bound")
    q = q.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    r = pack(settled.join(F.broadcast(told.select("cell", "chunks")), "cell").withColumn("chunk", part(F.col("chunks"))), ["cell", "chunk"], "r", "label", "away")

    def measure(batches):
        for df in batches:
            for qid, qv, qa, qb, rid, label, rv, ra in zip(*(df[c] for c in ("qid", "qv", "qaway", "qbound", "rid", "rlabel", "rv", "raway"))):
                x, y = np.asarray(qv, float).reshape(len(qid), -1), np.asarray(rv, float).reshape(len(rid), -1)
                for at in range(0, len(qid), 64):  # pairs of so many queries at once
                    i, j = np.nonzero(np.abs(np.asarray(qa[at : at + 64])[:, None] - np.asarray(ra)) <= np.asarray(qb[at : at + 64])[:, None])
                    i = i + at
                    d = np.zeros(len(i))
                    for c in range(x.shape[1]):
                        d += (x[i, c] - y[j, c]) ** 2
                    order = np.lexsort((j, d, i))  # references of a chunk are in order of id
                    i, j, d = i[order], j[order], d[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    times = np.bincount(i, minlength=len(qid))
                    keep = place < k
                    i, j, d, first = i[keep], j[keep], d[keep], place[keep] == 0
                    yield pd.DataFrame({"id": np.asarray(qid)[i], "ref": np.asarray(rid)[j], "label": np.asarray(label)[j], "d": np.sqrt(d), "n": np.where(first, times[i], 0)})

    # merged, as packed vectors of few different values shrink so much in a shuffle that Spark would broadcast them
    found = q.join(r.hint("merge"), ["cell", "chunk"]).mapInPandas(measure, schema)
    ranked = found.withColumns({"r": F.row_number().over(W.partitionBy("id").orderBy("d", "ref")), "compared": F.sum("n").over(W.partitionBy("id"))})
    return ranked.where(F.col("r") <= k).drop("n")


def infer_labels(queries: DataFrame, refs: DataFrame, dims: int, k: int = 15, least_share: float = 0.8, least_margin: float = 0.5) -> DataFrame:
    """id, label, centroid, share, margin, confident for each query (id, v): the majority label of the k nearest references and the nearest centroid.

    Components are scaled by mean and deviation (population) of the references (id, v, label); one that doesn't vary isn't divided. margin is how
    much farther the second centroid is (infinite where there is one label). Confident: both labels agree, and the share of votes or the margin
    is large enough. Ties go to the smaller label."""
    told = refs.agg(*(F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(dims)), *(F.stddev_pop(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dims))).first()
    scaled = F.array(*((F.get("v", F.lit(i)) - F.lit(told[f"m{i}"] or 0.0)) / F.lit(told[f"s{i}"] or 1.0) for i in range(dims)))
    q, r = queries.select("id", scaled.alias("v")), stage(refs.select("id", "label", scaled.alias("v")), "scaled")
    votes = nearest(q, r, k).groupBy("id", "label").agg(F.count("*").alias("n"))
    vote = votes.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), "label"))).where("r = 1").select("id", "label", (F.col("n") / k).alias("share"))
    centres = r.groupBy("label").agg(F.array(*(F.avg(F.get("v", F.lit(i))) for i in range(dims))).alias("v")).select(F.col("label").alias("id"), "label", "v")
    two = nearest(q, centres, 2).groupBy("id").agg(F.min_by("label", "r").alias("centroid"), (F.max(F.when(F.col("r") == 2, F.col("d"))) - F.min("d")).alias("margin"))
    both = vote.join(two.withColumn("margin", F.coalesce("margin", F.lit(float("inf")))), "id")
    sure = (F.col("label") == F.col("centroid")) & ((F.col("share") >= least_share) | (F.col("margin") >= least_margin))
    return both.select("id", "label", "centroid", "share", "margin", sure.alias("confident"))


def fill_labels(samples: DataFrame, hard: list[str], dims: int, k: int = 15, fill_low: bool = True) -> DataFrame:
    """Audit rows of labels filled from the nearest labelled samples: id, method, before, suggested, centroid, share, margin, confident, after, soft_after, soft_confident.

    samples: id, v (components, null without any), soft and hard_label (strings, null if missing), control. A sample without both labels gets
    a hard one from neighbours with a label in `hard` and a soft one from neighbours of any label (`knn`). Then others, but controls, whose
    hard label is missing or not in `hard` get theirs (`knn_hard`), with the first ones as references too. Unsure ones are filled only with
    fill_low; else after is null and the method ends in `_skipped`."""
    have = samples.where("v IS NOT NULL").select("id", "v", "soft", "control", F.col("hard_label").alias("was"), F.when(F.col("hard_label").isin(hard), F.col("hard_label")).otherwise(F.when(F.col("soft").isin(hard), F.col("soft"))).alias("label"))
    gap = F.col("was").isNull() & F.col("soft").isNull()
    refs = have.where("label IS NOT NULL").select("id", "v", "label")
    first = infer_labels(have.where(gap), refs, dims, k).withColumnsRenamed({"label": "suggested"})
    soft = infer_labels(have.where(gap), have.where("soft IS NOT NULL").select("id", "v", F.col("soft").alias("label")), dims, k).select("id", F.col("label").alias("soft_after"), F.col("confident").alias("soft_confident"))
    kept = lambda c: F.when(F.col("confident") | F.lit(fill_low), F.col(c))
    named = lambda name: F.concat(F.lit(name), F.when(kept("suggested").isNull(), F.lit("_skipped")).otherwise(F.lit("")))
    own = ("id", "method", "before", "suggested", "centroid", "share", "margin", "confident", "after", "soft_after", "soft_confident")
    one = stage(first.join(soft, "id").withColumns({"before": F.lit(None).cast("string"), "method": named("knn"), "after": kept("suggested"), "soft_after": kept("soft_after"), "soft_confident": kept("soft_confident")}).select(*own), "filled")
    filled = one.where("after IS NOT NULL").select("id", "after")
    open_ = have.where(~F.coalesce("control", F.lit(False)) & (F.col("was").isNull() | ~F.col("was").isin(hard))).join(filled, "id", "left_anti")
    more = refs.unionByName(have.join(filled, "id").select("id", "v", F.col("after").alias("label")))
    two = infer_labels(open_, more, dims, k).withColumnsRenamed({"label": "suggested"}).join(open_.select("id", F.col("was").alias("before"), F.col("soft").alias("soft_after")), "id")
    return one.unionByName(two.withColumns({"method": named("knn_hard"), "after": kept("suggested"), "soft_confident": F.lit(None).cast("boolean")}).select(*own))


def score_test(dosage: DataFrame, null: DataFrame, cov_inverse: np.ndarray, strata: int, ac_min: float = 0.0, variance_ratio: float = 1.0) -> DataFrame:
    """variant, included strata, joint chi-square and p, and by stratum beta, se, p, from sparse long dosages (variant, sample, anc, ds).

    null has a row per sample: r (residual), w (its weight, the diagonal of the inverse covariance) and x array<double> (covariates times w).
    U = G'r; V = ratio * (G'WG - (G'WX) C (G'WX)'). All sums are groupings over non-zero dosages; what is left for each variant is algebra of
    `strata` rows, done in Arrow batches. The joint test needs every stratum above ac_min."""
    p = cov_inverse.shape[0]
    g = dosage.where("ds <> 0").join(null, "sample")
    first = g.groupBy("variant", "anc").agg(F.sum("ds").alias("ac"), F.sum(F.col("ds") * F.col("r")).alias("u"), *(F.sum(F.col("ds") * F.col("x")[i]).alias(f"x{i}") for i in range(p)))
    cross = g.select("variant", "sample", "anc", "ds", "w").alias("a").join(g.select("variant", "sample", F.col("anc").alias("anc2"), F.col("ds").alias("ds2")).alias("b"), ["variant", "sample"]).groupBy("variant", "anc", "anc2").agg(F.sum(F.col("ds") * F.col("w") * F.col("ds2")).alias("v"))
    rows = first.groupBy("variant").agg(F.collect_list(F.struct("anc", "ac", "u", F.array(*(f"x{i}" for i in range(p))).alias("x"))).alias("f"))
    parts = cross.groupBy("variant").agg(F.collect_list(F.struct("anc", "anc2", "v")).alias("c"))
    inverse = np.asarray(cov_inverse, float)
    schema = f"variant {dosage.schema['variant'].dataType.simpleString()}, included string, chi2 double, p double, " + ", ".join(f"beta{i} double, se{i} double, p{i} double" for i in range(strata))

    def finish(batches):
        for df in batches:
            out = []
            for variant, f, c in zip(df["variant"], df["f"], df["c"]):
                u, ac, x, v = np.zeros(strata), np.zeros(strata), np.zeros((strata, p)), np.zeros((strata, strata))
                for s in f:
                    if 0 <= s["anc"] < strata:
                        u[s["anc"]], ac[s["anc"]], x[s["anc"]] = s["u"], s["ac"], s["x"]
                for s in c:
                    if 0 <= s["anc"] < strata and 0 <= s["anc2"] < strata:
                        v[s["anc"], s["anc2"]] = s["v"]
                v = variance_ratio * (v - x @ inverse @ x.T)
                keep = [i for i in range(strata) if ac[i] > ac_min]
                row = [variant, ",".join(map(str, keep)), None, None, *[None] * (3 * strata)]
                sub = v[np.ix_(keep, keep)]
                if keep and np.linalg.matrix_rank(sub) == len(keep):
                    solved, own = np.linalg.solve(sub, u[keep]), np.sqrt(np.maximum(np.diag(np.linalg.inv(sub)), 0))
                    if len(keep) == strata:
                        row[2] = float(u @ solved)
                        row[3] = chi2_tail(row[2], strata)
                    for j, i in enumerate(keep):
                        row[4 + 3 * i : 7 + 3 * i] = [float(solved[j]), float(own[j]), chi2_tail(float((solved[j] / own[j]) ** 2), 1) if own[j] > 0 else None]
                out.append(row)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return rows.join(parts, "variant").mapInPandas(finish, schema)


def ld_pairs(calls: DataFrame, window: int, least: int = 10, absent: str = "missing") -> DataFrame:
    """site, site2 (the larger), n, r2 of pairs of sites of one chromosome within the window, from dosages known in both (see genotypes)."""
    pairs = genotypes.site_pairs(genotypes.pack(calls, absent), window, least)
    return pairs.select(F.least("early", "late").alias("site"), F.greatest("early", "late").alias("site2"), "n", "r2")


def ld_prune(calls: DataFrame, r2: float = 0.1, window: int = 500_000, least: int = 10, absent: str = "missing") -> DataFrame:
    """chrom, pos, site, kept (see genotypes)."""
    return genotypes.ld_prune(genotypes.pack(calls, absent), r2, window, least)
