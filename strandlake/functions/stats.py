"""Statistical functions: Cauchy combination, chi-square tails, genomic control, tests on counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Median of the chi-square distribution with one degree of freedom.
CHI2_MEDIAN = 0.4549364231195724


def cct(*names: str) -> Column:
    """Cauchy combination of p-values with equal weights.

    Null and NaN are left out (none left: null); any 0 gives 0; any 1 gives the smaller of 1 and count * smallest; a tiny p
    counts as 1 / (p * pi), and a huge statistic t gives 1 / (t * pi)."""
    ps = F.filter(F.array(*(F.col(n).cast("double") for n in names)), lambda p: p.isNotNull() & ~F.isnan(p))
    n = F.size(ps)
    pi = math.pi
    terms = F.transform(ps, lambda p: F.when(p < 1e-16, 1.0 / (p * pi)).otherwise(F.tan((F.lit(0.5) - p) * pi)))
    t = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / n
    tail = F.when(t > 1e15, 1.0 / (t * pi)).otherwise(F.lit(0.5) - F.atan(t) / pi)
    return F.when(n == 0, F.lit(None).cast("double")).when(F.exists(ps, lambda p: p <= 0), 0.0).when(F.exists(ps, lambda p: p >= 1), F.least(n * F.array_min(ps), F.lit(1.0))).otherwise(tail)


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above, so small tails don't vanish."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 1000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - scale * total)
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 1000):
        n = -k * (k - a)
        b += 2
        d = n * d + b or tiny
        c = b + n / c or tiny
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def chi2_tail(x: float, df: int) -> float:
    if x is None or math.isnan(x) or df < 1:
        return math.nan
    return math.erfc(math.sqrt(max(x, 0) / 2)) if df == 1 else _upper_gamma(df / 2, x / 2)


def chi2_quantile(p: float, df: int) -> float:
    """The value whose upper tail is p, by bisection on the logarithm of the tail."""
    if p is None or math.isnan(p) or not 0 < p <= 1:
        return math.nan
    if p == 1:
        return 0.0
    low, high = 0.0, 1.0
    while chi2_tail(high, df) > p:
        low, high = high, high * 2
        if high > 1e5:
            return high
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, df) > p else (low, mid)
        if high - low < 1e-13 * max(high, 1):
            break
    return (low + high) / 2


def _whole_tails(x: np.ndarray, df: int) -> np.ndarray:
    """Upper tails at x > 0 for a whole number of degrees: the tail of 1 or 2 degrees and a term for each further 2, all of them positive."""
    v = np.minimum(x, 1e300) / 2
    if df % 2:
        total, a = np.fromiter(map(math.erfc, np.sqrt(v).tolist()), float, len(v)), 0.5
    else:
        total, a = np.exp(-v), 1.0
    term = np.exp(-v + a * np.log(v) - math.lgamma(a + 1)) if df > 2 else None
    while 2 * a < df:
        total = total + term
        a += 1
        term = term * v / a
    return np.minimum(total, 1.0)


def chi2_tails(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tails of a batch at once: in closed form for up to 40 whole degrees, else by series."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    out = np.empty(len(x))
    other = np.ones(len(x), bool)
    for d in np.unique(df[(df >= 1) & (df <= 40) & (df == np.floor(df))]):
        mine = (df == d) & ~np.isnan(x) & ((x < 1400) | (d <= 2))  # beyond, the first term is 0 before the sum is
        other &= ~mine
        at = np.flatnonzero(mine & (x > 0))
        out[mine] = 1.0
        out[at] = _whole_tails(x[at], int(d))
    if other.any():
        out[other] = _series_tails(x[other], df[other])
    return out


def _series_tails(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The regularised incomplete gamma, by its series below df / 2 + 1 and by its continued fraction above."""
    x, df = np.asarray(x, float), np.asarray(df, float)
    out = np.where(np.isnan(x) | ~(df >= 1), np.nan, 1.0)
    at = np.flatnonzero((x > 0) & (df >= 1))
    if not len(at):
        return out
    a, v = df[at] / 2, np.minimum(x[at], 1e300) / 2
    half, where = np.unique(a, return_inverse=True)
    log_gamma = np.array([math.lgamma(h) for h in half])[where]
    scale = np.exp(-v + a * np.log(v) - log_gamma)
    got = np.empty(len(at))
    low = v < a + 1
    if low.any():
        a_, v_ = a[low], v[low]
        term = total = 1 / a_
        for k in range(1, 1000):
            term = term * v_ / (a_ + k)
            total = total + term
            if (term < total * 1e-16).all():
                break
        got[low] = np.maximum(0, 1 - scale[low] * total)
    if not low.all():
        a_, v_, tiny = a[~low], v[~low], 1e-300
        b = v_ + 1 - a_
        c, d = np.full(len(a_), 1 / tiny), 1 / b
        h = d.copy()
        for k in range(1, 1000):
            n = -k * (k - a_)
            b = b + 2
            d = n * d + b
            d = 1 / np.where(d == 0, tiny, d)
            c = b + n / c
            c = np.where(c == 0, tiny, c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-16).all():
                break
        got[~low] = scale[~low] * h
    out[at] = got
    return out


def chi2_quantiles(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The values whose upper tails are p, of a batch at once: Newton steps on the logarithm of the tail from Wilson and Hilferty's guess (for small
    values from the density's first term), inside bounds that narrow; a step beyond them goes to the middle."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    good = (p > 0) & (p <= 1) & (df >= 1)
    out = np.full(len(p), np.nan)
    out[good & (p == 1)] = 0.0
    where = np.flatnonzero(good & (p < 1))
    p, df = p[where], df[where]
    half, of = np.unique(df / 2, return_inverse=True)
    gamma = np.array([math.lgamma(h) for h in half])[of]
    tail = np.where(df == 1, p / 2, p)
    t = np.sqrt(-2 * np.log(np.minimum(tail, np.maximum(1 - tail, 1e-300))))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    z = np.where(tail > 0.5, -z, z)
    x = np.where(df == 1, z * z, df * np.maximum(1 - 2 / (9 * df) + z * np.sqrt(2 / (9 * df)), 0) ** 3)
    small = 2 * np.exp((np.log1p(-p) + gamma + np.log(df / 2)) * 2 / df)  # 1 - p is about (x / 2)^(df / 2) / gamma(df / 2 + 1)
    x = np.maximum(np.where((p > 0.9) | (x <= 0), small, x), 1e-300)
    low, high, log_p = np.zeros(len(p)), np.full(len(p), np.inf), np.log(p)
    at = np.arange(len(p))
    for _ in range(100):
        v, a = x[at] / 2, df[at] / 2
        q = chi2_tails(x[at], df[at])
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            off = np.log(q) - log_p[at]
            step = off * q * 2 / np.exp((a - 1) * np.log(v) - v - gamma[at])
        low[at], high[at] = np.where(off > 0, x[at], low[at]), np.where(off < 0, x[at], high[at])
        new = x[at] + step
        middle = np.where(np.isinf(high[at]), 2 * x[at] + 1, (low[at] + high[at]) / 2)
        new = np.where((new > low[at]) & (new < high[at]), new, middle)  # also where it is no number
        new = np.where(off == 0, x[at], new)
        on = (np.abs(new - x[at]) > 1e-14 * x[at]) & (high[at] - low[at] > 1e-15 * x[at])
        x[at] = new
        at = at[on]
        if not len(at):
            break
    out[where] = x
    return out


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution (no built-in has it), for a whole Arrow batch at once."""
    return pd.Series(chi2_tails(x.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)))


@F.pandas_udf(DoubleType())
def chi2_isf(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_quantiles(p.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)))


@F.pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher test of a 2 x 2 table: all tables that are no likelier than the one seen. Each table of a batch is worked out once."""
    cells = np.column_stack([v.to_numpy(float, na_value=np.nan) for v in (a, b, c, d)])
    known = ~np.isnan(cells).any(1)
    out = np.full(len(cells), np.nan)
    if known.any():
        tables, which = np.unique(cells[known].astype(np.int64), axis=0, return_inverse=True)
        logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, tables.sum(1).max() + 1)))))  # of factorials
        choose = lambda x, y: logs[x] - logs[y] - logs[x - y]
        p = np.empty(len(tables))
        for i, (w, x, y, z) in enumerate(tables):
            row, column, n = w + x, w + y, w + x + y + z
            k = np.arange(max(0, column - (n - row)), min(row, column) + 1)
            chance = choose(row, k) + choose(n - row, column - k)
            chance = np.exp(chance - chance.max())
            p[i] = min(1.0, chance[chance <= chance[w - k[0]] * (1 + 1e-7)].sum() / chance.sum())
        out[known] = p[which.ravel()]
    return pd.Series(out)


def lambda_gc(assoc: DataFrame, p: str, by: list[str], least: int = 10) -> DataFrame:
    """Genomic control by group: by, n, lambda (null under `least` values of p in (0, 1]).

    The chi-square transform is monotone, so only the one or two middle p-values of a group are transformed."""
    good = assoc.where(F.col(p).between(0.0, 1.0) & (F.col(p) > 0))
    middle = good.groupBy(*by).agg(F.count("*").alias("n"), F.expr(f"sort_array(array(percentile_disc(0.5) WITHIN GROUP (ORDER BY {p}), percentile_disc(0.5) WITHIN GROUP (ORDER BY {p} DESC)))").alias("m"))
    chi = F.when(F.col("n") % 2 == 0, (chi2_isf(F.col("m")[0], F.lit(1)) + chi2_isf(F.col("m")[1], F.lit(1))) / 2).otherwise(chi2_isf(F.col("m")[0], F.lit(1)))
    return middle.select(*by, "n", F.when(F.col("n") >= least, chi / CHI2_MEDIAN).alias("lambda"))


def qq_points(assoc: DataFrame, p: str, by: list[str], keep_below: float = 1e-3, budget: int = 2000) -> DataFrame:
    """by, rank, observed and expected -log10 p: all points below keep_below, and about `budget` of the others of each group.

    Ranks come from counts by range bucket of p and a window inside a bucket, so no group is one sort."""
    good = assoc.where((F.col(p) > 0) & (F.col(p) <= 1)).select(*by, F.col(p).alias("p")).withColumn("b", F.least(F.floor(-F.log10("p") * 64), F.lit(4096)))
    sizes = good.groupBy(*by, "b").agg(F.count("*").alias("k"))
    w = W.partitionBy(*by).orderBy(F.desc("b"))
    sizes = sizes.select(*by, "b", (F.sum("k").over(w) - F.col("k")).alias("ahead"), F.sum("k").over(W.partitionBy(*by)).alias("n"))
    ranked = good.join(sizes, [*by, "b"]).withColumn("rank", F.col("ahead") + F.row_number().over(W.partitionBy(*by, "b").orderBy("p")))
    step = F.greatest(F.floor(F.col("n") / budget), F.lit(1))
    kept = ranked.where((F.col("p") < keep_below) | (F.col("rank") % step == 0))
    return kept.select(*by, "rank", (-F.log10("p")).alias("observed"), (-F.log10((F.col("rank") - 0.5) / F.col("n"))).alias("expected"))


def hwe_chi2(n_ref: Column, n_het: Column, n_hom: Column) -> Column:
    """One-df goodness-of-fit statistic of genotype counts (samples); null where an allele is absent."""
    n = n_ref + n_het + n_hom
    p = (2 * n_hom + n_het) / (2 * n)
    e = (n * (1 - p) * (1 - p), 2 * n * p * (1 - p), n * p * p)
    good = (n > 0) & (p > 0) & (p < 1)
    return F.when(good, sum(((o - x) * (o - x) / x for o, x in zip((n_ref, n_het, n_hom), e)), F.lit(0.0)))


def register(spark) -> None:
    """chi2_sf, chi2_isf and fisher_two_sided as SQL functions."""
    for name, f in (("chi2_sf", chi2_sf), ("chi2_isf", chi2_isf), ("fisher_two_sided", fisher_two_sided)):
        spark.udf.register(name, f)
