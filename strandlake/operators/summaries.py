"""Exact grouped quantiles, resampling intervals, running discovery curves and nested logistic models: each in passes that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import stats as S
from strandlake.operators.ranks import running_sums
from strandlake.sources.tables import stage

# --- quantiles


def grouped_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, n and the named quantiles of the known values, linear between neighbours; groups without values have no row.

    Equal values are counted first; their counts add up along ranges of (group, value), so neither a group nor its values are ever in one place."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_k"))
    run = stage(running_sums(counts, by, ["_x"], {"_upto": F.col("_k")}), "quantiles")
    total = run.groupBy(*by).agg(F.sum("_k").alias("n"))
    on = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"_t_{b}")) for b in by), F.lit(True))
    placed = run.join(total.select(*(F.col(b).alias(f"_t_{b}") for b in by), "n"), on) if by else run.join(F.broadcast(total))
    inside = lambda i: F.max(F.when((F.col("_upto") - F.col("_k") <= i) & (i < F.col("_upto")), F.col("_x")))
    place = {name: F.lit(q) * (F.col("n") - 1) for name, q in shares.items()}
    got = placed.groupBy(*by, "n").agg(*(inside(F.floor(p)).alias(f"_lo_{n}") for n, p in place.items()), *(inside(F.ceil(p)).alias(f"_hi_{n}") for n, p in place.items()))
    return got.select(*by, "n", *((F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (p - F.floor(p))).alias(n) for n, p in place.items()))


# --- resampling

PRIME = 2_147_483_647


def poisson_steps() -> list[float]:
    """P(at most i) of a Poisson of mean 1, for i from 0 to 7."""
    steps, total, term = [], 0.0, 0.36787944117144233
    for i in range(8):
        total += term
        steps.append(total)
        term /= i + 1
    return steps


def resampled_sums(df: DataFrame, key: str, columns: dict[str, Column], draws: int = 200, seed: int = 1) -> DataFrame:
    """draw (from 1) and the weighted sums of the columns over all rows; a row's weight in a draw is Poisson of mean 1.

    Weights follow from the md5 of the key, the draw and the seed by whole numbers alone, so other engines can draw the same. All draws are added up
    as the rows stream by: a task gives a row a draw."""
    names, steps = list(columns), np.array(poisson_steps())
    start = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % PRIME
    rows = df.select(start.alias("_k"), *(c.cast("double").alias(f"_c{i}") for i, c in enumerate(columns.values()))).where("_k IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, which = np.zeros((draws, len(names))), np.arange(1, draws + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                a = (part.column(0).to_numpy()[:, None] * 48_271 + which * 69_621 + seed * 40_692) % PRIME
                b = (a * a) % PRIME
                u = ((b * 16_807 + a) % PRIME + 0.5) / PRIME
                w = np.searchsorted(steps, u, side="left").astype(np.float64)
                x = np.column_stack([np.nan_to_num(part.column(i + 1).to_numpy(zero_copy_only=False).astype(np.float64)) for i in range(len(names))])
                total += w.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(which), *(pa.array(total[:, i]) for i in range(len(names)))], names=["draw", *names])

    return rows.mapInArrow(run, "draw long, " + ", ".join(f"`{n}` double" for n in names)).groupBy("draw").agg(*(F.sum(n).alias(n) for n in names))


def weights_sql(key: str, draw: str, seed: int = 1) -> str:
    """The weight of a row in a draw, in SQL."""
    k = f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 15) AS BIGINT) % {PRIME})"
    a = f"(({k} * 48271 + {draw} * 69621 + {seed * 40_692}) % {PRIME})"
    u = f"(((({a} * {a}) % {PRIME}) * 16807 + {a}) % {PRIME} + 0.5e0) / {PRIME}"
    return f"(SELECT count(*) FILTER (WHERE {u} > s) FROM (SELECT unnest({poisson_steps()}) AS s))"


def ratio_interval(df: DataFrame, key: str, top: str, bottom: str | None, draws: int = 200, seed: int = 1, level: float = 0.95) -> DataFrame:
    """ratio of sums (bottom None: the mean of the known values) with the percentile interval low, high over resamples, and how many draws have a ratio."""
    low_sum = F.col(top).isNotNull().cast("double") if bottom is None else F.col(bottom)
    sums = resampled_sums(df, key, {"t": F.coalesce(F.col(top), F.lit(0)), "b": F.coalesce(low_sum, F.lit(0))}, draws, seed)
    rates = sums.select(F.try_divide("t", "b").alias("r")).where("r IS NOT NULL")
    tail = (1 - level) / 2
    ci = rates.agg(F.count("*").alias("draws"), F.percentile("r", tail).alias("low"), F.percentile("r", 1 - tail).alias("high"))  # a row a draw
    whole = df.agg(F.try_divide(F.sum(top), F.sum(low_sum)).alias("ratio"))
    return whole.join(F.broadcast(ci))


# --- discovery


def discovery_curve(carriers: DataFrame, order: DataFrame, strata: DataFrame | None = None) -> DataFrame:
    """rank and cumulative number of sites that samples have brought in up to it, zero-filled over all ranks; with strata (site, and columns of few
    values) by their columns too. carriers: site, sample; order: sample, rank. A site enters at its smallest carrier's rank."""
    by = [] if strata is None else [c for c in strata.columns if c != "site"]
    first = carriers.join(order, "sample").groupBy("site").agg(F.min("rank").alias("rank"))
    if strata is None:
        grid = order.select("rank")
    else:
        first = first.join(strata, "site")
        kinds = strata.select(*by).distinct().limit(1001).collect()
        if len(kinds) > 1000:
            raise ValueError("over 1,000 strata")
        each = F.array(*(F.struct(*(F.lit(v).cast(strata.schema[c].dataType).alias(c) for c, v in zip(by, r))) for r in kinds))
        grid = order.select("rank", F.inline(each)) if kinds else order.limit(0).select("rank", *(F.lit(None).cast(strata.schema[c].dataType).alias(c) for c in by))
    new = first.groupBy("rank", *by).agg(F.count("*").alias("new"))
    both = grid.join(new, ["rank", *by], "left")
    return running_sums(both, by, ["rank"], {"cumulative": F.coalesce("new", F.lit(0))}).select("rank", *by, "cumulative")


NOVELTY = ("in_controls", "in_phase1", "new_recurrent", "new_singleton")


def novelty_classes(sites: DataFrame, carriers: DataFrame, order: DataFrame, controls: DataFrame, matched: DataFrame) -> DataFrame:
    """id, svtype, class, first, second: sites with a carrier among the ordered samples by what they match first: a control carrier, phase 1 (matched:
    chrom, pos, id), else new, and then seen in one sample or in more. An id that stands more than once in sites is ambiguous and drops out."""
    once = sites.groupBy("id").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("chrom", "pos", "svtype"))).where("times = 1").drop("times")
    seen = carriers.select("id", "sample").distinct()
    ranked = seen.join(order, "sample").groupBy("id").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    later = seen.join(order, "sample").join(ranked.where("n > 1").select("id", "first"), "id").where("rank > first").groupBy("id").agg(F.min("rank").alias("second"))
    held = seen.join(controls, "sample", "left_semi").select("id").distinct().withColumn("control", F.lit(True))
    out = once.join(ranked, "id").join(later, "id", "left").join(held, "id", "left").join(matched.select("chrom", "pos", "id").distinct().withColumn("known", F.lit(True)), ["chrom", "pos", "id"], "left")
    kind = F.when(F.col("control"), "in_controls").when(F.col("known"), "in_phase1").when(F.col("n") == 1, "new_singleton").otherwise("new_recurrent")
    return out.select("id", "svtype", kind.alias("class"), "first", "second")


def novelty_curve(classes: DataFrame, order: DataFrame, step: int) -> DataFrame:
    """n_participants (every `step` and all), block, svtype, class, cumulative: a new site is a singleton until its second carrier's rank, then recurrent."""
    n = order.agg(F.max("rank")).first()[0] or 0
    one = lambda kind, rank, k: F.struct(F.lit(kind).alias("class"), F.col(rank).alias("rank"), F.lit(k).alias("k"))
    known = F.array(F.struct(F.col("class"), F.col("first").alias("rank"), F.lit(1).alias("k")))
    events = F.when(F.col("class").startswith("new"), F.array(one("new_singleton", "first", 1), one("new_singleton", "second", -1), one("new_recurrent", "second", 1))).otherwise(known)
    moved = classes.select("svtype", F.inline(events)).where("rank IS NOT NULL")
    told = moved.withColumn("n_participants", F.least(F.ceil(F.col("rank") / step) * step, F.lit(n))).groupBy("svtype", "class", "n_participants").agg(F.sum("k").alias("k"))
    at = order.where((F.col("rank") % step == 0) | (F.col("rank") == n)).select(F.col("rank").alias("n_participants"), "block")
    types = [r[0] for r in classes.select("svtype").distinct().limit(1000).collect()]
    each = F.array(*(F.struct(F.lit(t).alias("svtype"), F.lit(c).alias("class")) for t in types for c in NOVELTY))
    grid = at.select("n_participants", "block", F.inline(each)) if types else at.limit(0).select("n_participants", "block", F.lit("").alias("svtype"), F.lit("").alias("class"))
    both = grid.join(told, ["n_participants", "svtype", "class"], "left")
    return running_sums(both, ["svtype", "class"], ["n_participants"], {"cumulative": F.coalesce("k", F.lit(0))}).drop("k")


# --- nested logistic models


def logistic_models(rows: DataFrame, by: list[str], rounds: int = 50) -> DataFrame:
    """by, n, ll and b of y ~ x for each group at once; rows: by, y (0 or 1), x (array<double> with the constant; of one length in a group).

    Newton steps on sums by group: a task adds up its rows' gradients and p x p matrices, these are added by group, and solved where they meet; steps
    that gain nothing are halved. A group may have any number of rows. Directions without information stay at 0."""
    types = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)
    # dealt out by number: a small file is read by one task, and rows of a group may all be equal
    data = stage(rows.select(*by, F.col("y").cast("double").alias("y"), "x", F.monotonically_increasing_id().alias("_i")).repartition("_i").drop("_i"), "rows")
    state = stage(_start(data, by), "state")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in by)))
            y, x, b = batch.column("y").to_numpy(), batch.column("x"), batch.column("b")
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                groups.setdefault(k, []).append(i)
            for k, at in groups.items():
                beta = np.array(b[at[0]].as_py(), float)
                m = x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                eta = m @ beta
                mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                ll = float((y[at] * eta - np.logaddexp(0, eta)).sum())
                got = np.concatenate(([ll], m.T @ (y[at] - mu), (m.T @ (m * (mu * (1 - mu))[:, None])).ravel()))
                total[k] = total[k] + got if k in total else got
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in total], batch_type[i]) for i in range(len(by))), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=[*by, "s"])

    batch_type = [pa.int64() if rows.schema[b].dataType.simpleString() in ("bigint",) else pa.int32() if rows.schema[b].dataType.simpleString() == "int" else pa.string() for b in by]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (*by, "s", "n", "b", "step", "ll")]
            for row in zip(*cols):
                k, s = row[: len(by)], np.array(row[len(by)])
                if k in total:
                    total[k][0] = total[k][0] + s
                else:
                    total[k] = [s, *row[len(by) + 1 :]]
        out = []
        for k, (s, n, b, step, last) in total.items():
            b, p = np.array(b), len(b)
            ll, u, h = float(s[0]), s[1 : 1 + p], s[1 + p :].reshape(p, p)
            if step is not None and ll < last - 1e-12 * abs(last):  # worse: half of the last step back
                half = np.array(step) / 2
                out.append((*k, n, (b - half).tolist(), half.tolist(), last, bool(np.abs(half).max() < 1e-10)))
                continue
            move = np.linalg.pinv(h, rcond=1e-12, hermitian=True) @ u
            settled = bool(np.abs(move).max() < 1e-8) or (step is not None and abs(ll - last) <= 1e-12 * (1 + abs(ll)))
            out.append((*k, n, (b if settled else b + move).tolist(), move.tolist(), ll, settled))
        c = list(zip(*out)) if out else [()] * (len(by) + 5)
        floats = pa.list_(pa.float64())
        kinds = [*batch_type, pa.int64(), floats, floats, pa.float64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, kinds)], names=[*by, "n", "b", "step", "ll", "done"])

    done = None
    for _ in range(rounds):
        part = data.join(_spread(state.select(*by, "b")), by).mapInArrow(sums, f"{types}, s array<double>")
        met = part.join(state.drop("done"), by).repartition(*by)
        state = stage(met.mapInArrow(solve, f"{types}, n long, b array<double>, step array<double>, ll double, done boolean"), "state")
        ended = state.where("done").select(*by, "n", "ll", "b")
        done = ended if done is None else done.unionByName(ended)
        state = state.where("NOT done")
        if not state.limit(1).count():
            return done
    return done.unionByName(state.select(*by, "n", "ll", "b"))


def _start(data: DataFrame, by: list[str]) -> DataFrame:
    """The state before the first step. Its sums are plain numbers, which are added up by hash; an array among them would sort a task's rows."""
    sizes = data.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p"))
    return sizes.select(*by, "n", F.expr("array_repeat(0.0D, p)").alias("b"), F.lit(None).cast("array<double>").alias("step"), F.lit(None).cast("double").alias("ll"), F.lit(False).alias("done"))


def _spread(groups: DataFrame, most: int = 100_000) -> DataFrame:
    """A stage with a row a group: where they are few, rows meet it where they lie, as a shuffle by few keys gives all rows to few tasks."""
    return F.broadcast(groups) if groups.count() <= most else groups


def covariate_screen(rows: DataFrame, least: int = 100) -> DataFrame:
    """rows (trait, candidate, y, x, base array<double>): logistic models on base, and on base and x, over the rows that know all of these: n, lrt, its p,
    delta_aic (gained by x), and q (Benjamini and Hochberg) by candidate. Pairs with fewer than `least` rows of either outcome have no row."""
    from strandlake.operators.dossier import benjamini_hochberg

    known = F.col("y").isNotNull() & F.col("x").isNotNull() & F.forall("base", lambda b: b.isNotNull() & ~F.isnan(b))
    good = rows.where(known).select("trait", "candidate", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.transform("base", lambda b: b.cast("double")).alias("base"))
    told = good.groupBy("trait", "candidate").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count_if(F.col("y") == 1).alias("cases"), F.count_if(F.col("y") == 0).alias("controls"))
    told = stage(told.where((F.col("cases") >= least) & (F.col("controls") >= least)), "pairs")
    fit = good.join(_spread(told), ["trait", "candidate"])
    one = F.array(F.lit(1.0))
    x = F.when(F.col("s") > 0, (F.col("x") - F.col("m")) / F.col("s")).otherwise(0.0)
    both = fit.select("trait", "candidate", "y", F.explode(F.array(F.struct(F.lit(0).alias("model"), F.concat(one, "base").alias("x")), F.struct(F.lit(1).alias("model"), F.concat(one, "base", F.array(x)).alias("x")))).alias("m")).select("trait", "candidate", "m.model", "y", "m.x")
    ll = logistic_models(both, ["trait", "candidate", "model"]).groupBy("trait", "candidate").agg(F.max("n").alias("n"), F.max(F.when(F.col("model") == 1, F.col("ll"))).alias("ll1"), F.max(F.when(F.col("model") == 0, F.col("ll"))).alias("ll0"))
    lrt = F.greatest(2 * (F.col("ll1") - F.col("ll0")), F.lit(0.0))
    out = ll.select("trait", "candidate", "n", lrt.alias("lrt"), (lrt - 2).alias("delta_aic")).withColumn("p", S.chi2_sf(F.col("lrt"), F.lit(1)))
    return benjamini_hochberg(out, "p", ["candidate"], "trait")


# --- tracts


def tract_summary(tracts: DataFrame, switches: DataFrame, n_haps: int, span_bp: int, rec_cm_per_mb: float) -> DataFrame:
    """One row: tracts and complete ones, haplotypes with a switch, rates of switches and flickers per haplotype and Mb (null without a span), the share
    of flickers, implied generations at full heterozygosity, and exact quantiles of lengths. switches: sample, hap, flicker, span."""
    length = (F.col("end") - F.col("start")).cast("double")
    whole = ~F.col("left_open") & ~F.col("right_open")
    tracts = stage(tracts.select("start", "end", "left_open", "right_open"), "tracts")
    switches = stage(switches.select("sample", "hap", "flicker", "span"), "flickers")
    t = tracts.select(F.lit(1).alias("one"), F.when(length > 0, length).alias("len"), F.when((length > 0) & whole, length).alias("whole"))
    counts = tracts.agg(F.count("*").alias("n_tracts"), F.count_if(whole).alias("n_complete"))
    sw = switches.groupBy("sample", "hap").agg(F.count("*").alias("n"), F.count_if("flicker").alias("f")).agg(F.count("*").alias("n_haps_with_switch"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_switches"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_flicker"))
    mb = F.lit(float(n_haps) * span_bp / 1e6)
    rate = F.when(mb > 0, F.col("n_switches") / mb)
    lens = grouped_quantiles(t, ["one"], "len", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    complete = grouped_quantiles(t, ["one"], "whole", {"median_complete": 0.5}).drop("n")
    flick = grouped_quantiles(switches.select(F.lit(1).alias("one"), "span"), ["one"], "span", {"median_flicker": 0.5}).drop("n")
    out = counts.join(F.broadcast(sw)).withColumn("one", F.lit(1))
    for q in (lens.drop("n"), complete, flick):
        out = out.join(F.broadcast(q), "one", "left")
    return out.select("n_tracts", "n_complete", "n_haps_with_switch", F.try_divide(F.col("n_haps_with_switch"), F.lit(n_haps)).alias("frac_haps"), "n_switches", rate.alias("rate"), F.try_divide("n_flicker", "n_switches").alias("flicker_frac"), F.when(mb > 0, F.col("n_flicker") / mb).alias("flicker_rate"), F.when(rate > 0, rate * 100 / rec_cm_per_mb).alias("implied_t"), "p10", "median", "p90", "median_complete", "median_flicker")
