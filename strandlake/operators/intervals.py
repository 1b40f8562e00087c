"""Joins and merges of half-open intervals, and as-of joins, all keyed by chromosome and position bin.

Bins keep the work of one chromosome on many tasks; nothing is gathered by chromosome alone except one row for each bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIN = 20_000


def _bin(x: Column, width: int) -> Column:
    return F.floor(x / F.lit(width))


def range_join(left: DataFrame, right: DataFrame, how: str = "inner", start: str = "start0", end: str = "end0", width: int = BIN) -> DataFrame:
    """Pairs of one chromosome whose half-open intervals overlap; right's columns get the suffix _r.

    Either side is copied to each bin that it touches; a pair is kept in the bin where the later of the two starts, so once.
    how: inner, left_semi or left_anti (then left needs to hold rows that are told apart by all their columns)."""
    spread = lambda df: df.withColumn("_bin", F.explode(F.sequence(_bin(F.col(start), width), _bin(F.greatest(F.col(end) - 1, F.col(start)), width))))
    r = right.select(*(F.col(c).alias(f"{c}_r") for c in right.columns), F.explode(F.sequence(_bin(F.col(start), width), _bin(F.greatest(F.col(end) - 1, F.col(start)), width))).alias("_bin_r"))
    meets = (F.col("chrom") == F.col("chrom_r")) & (F.col("_bin") == F.col("_bin_r")) & (F.col(start) < F.col(f"{end}_r")) & (F.col(f"{start}_r") < F.col(end))
    here = F.col("_bin") == F.greatest(_bin(F.col(start), width), _bin(F.col(f"{start}_r"), width))
    if how == "inner":
        return spread(left).join(r, meets & here).drop("_bin", "_bin_r", "chrom_r")
    hit = spread(left).join(r, meets, "left_semi").drop("_bin").distinct()
    if how == "left_semi":
        return hit
    return left.join(hit, [left[c].eqNullSafe(hit[c]) for c in left.columns], "left_anti")


def merge_intervals(track: DataFrame, by: tuple[str, ...] = ("chrom",), width: int = BIN) -> DataFrame:
    """Unions of overlapping or touching half-open intervals: by, start0, end0.

    Islands are found inside bins first; what reaches an island from an earlier bin comes from one row a bin (its farthest end),
    so a long chromosome isn't one sort."""
    t = track.select(*by, "start0", "end0", _bin(F.col("start0"), width).alias("b"))
    ends = t.groupBy(*by, "b").agg(F.max("end0").alias("far"))
    before = ends.select(*by, "b", F.max("far").over(W.partitionBy(*by).orderBy("b").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    w = W.partitionBy(*by, "b").orderBy("start0", "end0")
    t = t.join(before, [*by, "b"]).withColumn("reached", F.greatest(F.max("end0").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("carried")))
    t = t.withColumn("new", F.when(F.col("reached").isNull() | (F.col("start0") > F.col("reached")), 1).otherwise(0))
    # island numbers: new ones in earlier bins, then in this bin
    fresh = t.groupBy(*by, "b").agg(F.sum("new").alias("k"))
    offset = fresh.select(*by, "b", (F.sum("k").over(W.partitionBy(*by).orderBy("b")) - F.col("k")).alias("offset"))
    t = t.withColumn("inner", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).join(offset, [*by, "b"])
    return t.groupBy(*by, (F.col("offset") + F.col("inner")).alias("island")).agg(F.min("start0").alias("start0"), F.max("end0").alias("end0")).drop("island")


def covering_join(targets: DataFrame, markers: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Each target (chrom, pos, ...) with the columns of the marker of smallest pos >= its own, else the chromosome's last marker.

    Of markers at one position the first by all their columns stays; a chromosome without markers gives nulls. Adds marker_pos and exact."""
    values = [c for c in markers.columns if c not in ("chrom", "pos")]
    m = markers.groupBy("chrom", "pos").agg(F.min(F.struct(*values)).alias("v")).select("chrom", "pos", F.struct(F.col("pos").alias("pos"), "v").alias("m"))
    both = targets.withColumn("m", F.lit(None).cast(m.schema["m"].dataType)).withColumn("_t", F.lit(True)).unionByName(m.withColumn("_t", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("b", _bin(F.col("pos"), width))
    # the next marker inside the bin: positions from high to low, markers before targets of their own position
    w = W.partitionBy("chrom", "b").orderBy(F.desc("pos"), "_t").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("near", F.last("m", ignorenulls=True).over(w)).where("_t")
    # and of later bins, from one row for each bin
    bins = both.groupBy("chrom", "b").agg(F.min_by("m", F.when(F.col("m").isNotNull(), F.col("pos"))).alias("first"), F.max_by("m", F.when(F.col("m").isNotNull(), F.col("pos"))).alias("last"))
    later = W.partitionBy("chrom").orderBy(F.desc("b"))
    bins = bins.select("chrom", "b", F.last("first", ignorenulls=True).over(later.rowsBetween(W.unboundedPreceding, -1)).alias("later"), F.first("last", ignorenulls=True).over(later.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("end"))
    out = seen.join(bins, ["chrom", "b"]).withColumn("got", F.coalesce("near", "later", "end"))
    return out.select(*targets.columns, *(F.col(f"got.v.{c}").alias(c) for c in values), F.col("got.pos").alias("marker_pos"), (F.col("got.pos") == F.col("pos")).alias("exact"))


def previous_join(targets: DataFrame, markers: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Each target with marker_pos, the largest marker pos <= its own, or null (backward as-of)."""
    m = markers.select("chrom", F.col("pos").alias("m"), "pos").distinct()
    both = targets.withColumns({"m": F.lit(None).cast("long"), "_t": F.lit(True)}).unionByName(m.withColumn("_t", F.lit(False)), allowMissingColumns=True).withColumn("b", _bin(F.col("pos"), width))
    w = W.partitionBy("chrom", "b").orderBy("pos", "_t").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("near", F.last("m", ignorenulls=True).over(w)).where("_t")
    bins = both.groupBy("chrom", "b").agg(F.max("m").alias("top"))
    bins = bins.select("chrom", "b", F.max("top").over(W.partitionBy("chrom").orderBy("b").rowsBetween(W.unboundedPreceding, -1)).alias("earlier"))
    return seen.join(bins, ["chrom", "b"]).select(*targets.columns, F.coalesce("near", "earlier").alias("marker_pos"))


def contains_point(points: DataFrame, track: DataFrame, name: str = "hit") -> DataFrame:
    """points with a flag: whether some interval of the track holds pos (0-based, half-open: start0 <= pos < end0)."""
    p = points.select("chrom", "pos").distinct().withColumns({"start0": F.col("pos"), "end0": F.col("pos") + 1})
    inside = range_join(p, track.select("chrom", "start0", "end0"), "left_semi").select("chrom", "pos", F.lit(True).alias(name))
    return points.join(inside, ["chrom", "pos"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def covered_bases(spans: DataFrame, track: DataFrame, key: str) -> DataFrame:
    """spans (chrom, start0, end0, key unique) with the number of bases that the merged track covers."""
    merged = merge_intervals(track)
    shared = F.least("end0", "end0_r") - F.greatest("start0", "start0_r")
    got = range_join(spans.select("chrom", "start0", "end0", key), merged).groupBy(key).agg(F.sum(shared).alias("covered"))
    return spans.join(got, key, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def overlaps(spans: DataFrame, track: DataFrame, key: str, name: str = "hit") -> DataFrame:
    hit = range_join(spans.select("chrom", "start0", "end0", key), track.select("chrom", "start0", "end0"), "left_semi").select(key, F.lit(True).alias(name))
    return spans.join(hit, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def in_region(df: DataFrame, spec: str) -> DataFrame:
    """Rows of `chr` or `chr:start-end`, ends included."""
    chrom, _, span = spec.partition(":")
    out = df.where(F.col("chrom") == chrom)
    if not span:
        return out
    low, _, high = span.replace(",", "").partition("-")
    return out.where(F.col("pos").between(int(low), int(high or low)))


def resolve_contig(df: DataFrame, spec: str) -> str:
    """spec with the chromosome named as df names it (chr22 or 22)."""
    chrom, colon, span = spec.partition(":")
    bare = chrom.removeprefix("chr")
    names = {r.chrom for r in df.where(F.col("chrom").isin(bare, f"chr{bare}")).select("chrom").distinct().collect()}
    for name in (chrom, bare, f"chr{bare}"):
        if name in names:
            return name + colon + span
    raise ValueError(f"no chromosome {chrom}")


def extract_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows (chrom, pos) in each window (window, chrom, start, end; ends included); a row may stand in several."""
    spans = windows.select("window", "chrom", F.col("start").alias("start0"), (F.col("end") + 1).alias("end0"))
    points = rows.withColumns({"start0": F.col("pos"), "end0": F.col("pos") + 1})
    return range_join(points, spans).select(F.col("window_r").alias("window"), *rows.columns)


def cluster_positions(hits: DataFrame, window: int, by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """hits with cluster: a gap above `window` to the position before starts a new one; its label is its first position."""
    spans = hits.select(*by, F.col("pos").alias("start0"), (F.col("pos") + window).alias("end0")).distinct()
    merged = merge_intervals(spans, by, max(BIN, 4 * window)).withColumnRenamed("start0", "cluster")
    width = max(BIN, 4 * window)
    m = merged.withColumn("_bin", F.explode(F.sequence(_bin(F.col("cluster"), width), _bin(F.col("end0"), width))))
    h = hits.withColumn("_bin", _bin(F.col("pos"), width))
    return h.join(m, [*by, "_bin"]).where(F.col("pos").between(F.col("cluster"), F.col("end0"))).select(*hits.columns, "cluster")
