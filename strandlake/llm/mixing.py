"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every document is queued `epochs` times in its source, in shuffled order. Its virtual finish time is the source's cumulative
words, it included, divided by the source's target; the queue of all sources is ordered by that time (two levels of range buckets
of equal width, sorted in the bucket where the budget ends) and cut at the total budget. So each source is served in proportion to its target.

Cumulative sums have two levels: sums by (source, bucket of the shuffling hash), their running totals, and a window inside one
bucket; so a source that holds a third of all rows is spread over as many tasks as its share.

Null text: size 0. Null source: a source of its own, last. Documents of size 0 are taken 0 words. Repeated rows count as
documents of their own; equal rows are interchangeable. Ties in time: by source, hash, doc_id. An empty table gives no rows. Very long
texts count whole. Other columns pass whatever their names; own ones named like the added columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_BITS = 12


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def named(source: Column) -> Column:
    """A source name that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def shuffle_key(epoch: int, seed: str = "mix") -> Column:
    """15 hex digits of an md5 as a number: evenly spread, and the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}{epoch}"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) with a target each: weights repeat over the sources by code point, null last.

    The budget is share * all sizes. A source's target stops at most * its size, and what it leaves goes to the others by weight
    until none is above: sources ordered by (cap / weight) fill up one by one; those before the first that doesn't are at their cap."""
    ranked = sizes.withColumn("i", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    w = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.col("i") - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "i")
    past, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = w.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(rest))
    w = w.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(past), F.lit(0.0))) / (F.sum("weight").over(rest) - F.coalesce(F.sum("weight").over(past), F.lit(0.0))))
    w = w.withColumn("above", F.col("cap") > F.col("level") * F.col("weight"))
    level = F.first(F.when(F.col("above"), F.col("level")), ignorenulls=True).over(rest)
    return w.select("source", "source_size", F.when(F.coalesce(F.col("cap") / F.col("weight") <= level, F.lit(True)), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """docs' rows with size, source_size, target and copies (0 to epochs: how often the mix takes the row), taken = copies * size."""
    others = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    # the given columns travel in one struct, so that no name of theirs can clash
    key = [named(F.col("source")).alias("_s"), F.col("doc_id").cast("long").alias("_d"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_t")]
    slim = docs.select(*key, words(F.col("text")).alias("size"), *(shuffle_key(e, seed).alias(f"h{e}") for e in range(epochs)), "source")
    slim = stage(slim, "sizes")
    goals = stage(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, float(epochs)).withColumn("_s", named(F.col("source"))).drop("source"), "targets")
    goals = F.broadcast(goals) if goals.count() <= 10_000 else goals
    shift = 60 - BUCKET_BITS
    queue = slim.select("_s", "_d", "_t", "size", F.posexplode(F.array(*(f"h{e}" for e in range(epochs)))).alias("epoch", "h")).where("size > 0")
    queue = queue.withColumn("bucket", F.col("epoch") * (1 << BUCKET_BITS) + F.shiftright("h", shift).cast("int"))
    sums = queue.groupBy("_s", "bucket").agg(F.sum("size").alias("n"))
    ahead = sums.select("_s", "bucket", (F.sum("n").over(W.partitionBy("_s").orderBy("bucket")) - F.col("n")).alias("ahead"))
    inside = F.sum("size").over(W.partitionBy("_s", "bucket").orderBy("h", "_d", "_t").rowsBetween(W.unboundedPreceding, 0))
    timed = queue.withColumn("inside", inside).join(ahead, ["_s", "bucket"]).join(goals.select("_s", "target"), "_s")
    timed = timed.withColumn("finish", (F.col("ahead") + F.col("inside")) / F.col("target"))
    timed = stage(timed.select("_s", "_d", "_t", "size", "h", "finish"), "queue")
    # the global order by ranges of the finish time: whole ranges before the budget's end, then the ranges of the one where it lies, then its rows
    budget, ahead_, chosen, left, wide = goals.agg(F.sum("target")).first()[0] or 0.0, 0, None, timed, 4.0
    low = 0.0
    for _ in range(2):
        step = wide / (1 << (BUCKET_BITS + 2))
        slot = F.greatest(F.lit(0), F.least(F.floor((F.col("finish") - low) / step), F.lit((1 << (BUCKET_BITS + 2)) - 1))).cast("int")
        slots = left.groupBy(slot.alias("slot")).agg(F.sum("size").alias("n")).withColumn("upto", F.lit(ahead_) + F.sum("n").over(W.orderBy("slot")))
        first = slots.where(F.col("upto") > budget).orderBy("slot").first()
        before = left if first is None else left.where(slot < first.slot)
        chosen = before if chosen is None else chosen.unionByName(before)
        if first is None:
            break
        left, ahead_, low, wide = left.where(slot == first.slot), first.upto - first.n, low + first.slot * step, step
    else:
        order = W.orderBy("finish", "_s", "h", "_d", "_t").rowsBetween(W.unboundedPreceding, 0)
        chosen = chosen.unionByName(left.withColumn("upto", F.lit(ahead_) + F.sum("size").over(order)).where(F.col("upto") <= budget).drop("upto"))
    copies = chosen.groupBy("_s", "_d", "_t").agg(F.count("*").alias("picked"))
    same = slim.groupBy("_s", "_d", "_t").agg(F.count("*").alias("same"), F.first("size").alias("size"))
    on = lambda a, b: (a["_s"] == b["_s"]) & a["_d"].eqNullSafe(b["_d"]) & (a["_t"] == b["_t"])
    got = same.join(copies, on(same, copies), "left").select(same["_s"], same["_d"], same["_t"], "same", "size", F.coalesce("picked", F.lit(0)).alias("picked"))
    got = stage(got, "picked")
    rows = docs.select(F.struct(*others).alias("_row"), *key)
    out = rows.join(got, on(rows, got)).select(rows["_row"], rows["_s"], rows["_d"], rows["_t"], "same", "size", "picked")
    if got.where("same > 1").limit(1).count():  # equal rows are interchangeable: they get their copies in turn
        one = out.where("same = 1").withColumn("place", F.lit(1))
        out = one.unionByName(out.where("same > 1").withColumn("place", F.row_number().over(W.partitionBy("_s", "_d", "_t").orderBy("size"))))
    else:
        out = out.withColumn("place", F.lit(1))
    each = F.floor(F.col("picked") / F.col("same")) + F.when(F.col("place") <= F.col("picked") % F.col("same"), 1).otherwise(0)
    out = out.withColumn("copies", each.cast("long")).join(goals, "_s")
    return out.select("_row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
