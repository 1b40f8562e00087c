"""Append-only counters as Structured Streaming aggregations: an extension beside the batch operators, with the same column rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import rows as R


def cpg_counters(stream: DataFrame, time: str = "ts", late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """Sites, coverage sum and deep sites by sample in tumbling windows; rows later than `late` are left out.

    stream: sample, cov and an event time. In append mode a window comes out once, after the watermark has passed its end."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, every), "sample")
        .agg(F.count("*").alias("n"), F.sum("cov").alias("cov_sum"), F.count_if(F.col("cov") >= 10).alias("n_10"))
        .select(F.col("window.start").alias("start"), "sample", "n", "cov_sum", "n_10")
    )


def site_counters(stream: DataFrame) -> DataFrame:
    """Allele count, allele number and carriers by site of an unbounded table of calls (update or complete mode)."""
    g = R.gt_stats("a1", "a2")
    return stream.groupBy("site").agg(F.sum(g["ac"]).alias("ac"), F.sum(g["an"]).alias("an"), F.count_if(g["carrier"]).alias("n_carriers"))


def merged_counts(stream: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Sums of shard counts with equal keys."""
    return stream.groupBy(*keys).agg(F.sum(count).alias(count))
