"""Ranks and running sums of a whole table without one task for all rows: ranges of the order, with what lies before each carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.sources.tables import stage


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with _part and _place: rows of a lower _part, then _place, come first. Written, so that both stay as they are."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the running number has the task in its upper bits and the row in its lower 33
    numbered = sorted_.withColumn("_id", F.monotonically_increasing_id())
    told = numbered.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    return stage(told, "ranges")


def row_numbers(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """df with its row number from 0 in the given order. What is added up in one task is a row a range."""
    parts = in_ranges(df, *order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    ahead = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_ahead"))
    return parts.join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + F.col("_place")).drop("_part", "_place", "_ahead")


def running_sums(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """df with the sums of each group up to and with each row, in the given order (which must tell rows apart, or rows that tie are taken as they come)."""
    parts = in_ranges(df.withColumns({f"_v_{k}": v for k, v in sums.items()}), *by, *order)
    inside = W.partitionBy("_part", *by).orderBy("_place")
    sizes = parts.groupBy("_part", *by).agg(*(F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # a group lies in few ranges, so this has little more than a row a group
    ahead = sizes.select(F.col("_part").alias("_p"), *(F.col(b).alias(f"_b_{b}") for b in by), *(F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_a_{k}") for k in sums))
    on = F.col("_part") == F.col("_p")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    met = parts.withColumns({f"_w_{k}": F.sum(f"_v_{k}").over(inside) for k in sums}).join(ahead, on)
    return met.withColumns({k: F.col(f"_a_{k}") + F.coalesce(f"_w_{k}", F.lit(0)) for k in sums}).select(*df.columns, *sums)
