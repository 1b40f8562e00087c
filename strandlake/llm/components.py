"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import drop_stages, stage, staged


def join_heavy(rows: DataFrame, right: DataFrame, on: list[str], times: str, total: int) -> DataFrame:
    """rows joined with right (one row a key; its column `times` says how many rows have the key, or more; total: their sum, or more).

    A key with more than a 4,096th of all rows (and over 1,000) is heavy: there are at most 4,096 of these, so they are broadcast and their rows
    stay where they are; all other keys are shuffled. `times` is dropped."""
    cut = max(1000, -(-total // 4096))
    heavy = right.where(F.col(times) > cut)
    if not heavy.limit(1).count():
        return rows.join(right.drop(times), on)
    hot = rows.join(F.broadcast(heavy.drop(times)), on)
    cold = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(right.where(F.col(times) <= cut).drop(times), on)
    return hot.unionByName(cold)


def join_left_heavy(rows: DataFrame, right: DataFrame, on: list[str], times: str, total: int) -> DataFrame:
    """join_heavy as a left join: heavy keys are broadcast, the rows of others are shuffled."""
    cut = max(1000, -(-total // 4096))
    heavy = right.where(F.col(times) > cut)
    if not heavy.limit(1).count():
        return rows.join(right.drop(times), on, "left")
    hot = rows.join(F.broadcast(heavy.drop(times)), on)
    cold = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(right.where(F.col(times) <= cut).drop(times), on, "left")
    return hot.unionByName(cold)


def join_salted(left: DataFrame, right: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """left joined with right, for rows too large to broadcast or several a key. A key with many rows on the left (over a 4,096th of such keys'
    rows, and over 1,000: at most 4,096 keys) is dealt over as many tasks as it needs by a hash of the columns `by`, its right rows copied to each."""
    crowded = stage(left.groupBy(*on).agg(F.count("*").alias("_times")).where("_times > 1000"), "crowded")
    total = crowded.agg(F.sum("_times")).first()[0] or 0
    if not total:
        return left.join(right, on)
    cut = max(1000, -(-total // 4096))
    heavy = F.broadcast(crowded.where(F.col("_times") > cut).select(*on, F.ceil(F.col("_times") / cut).cast("int").alias("_lanes")))
    dealt = left.join(heavy, on, "left").withColumn("_lane", F.pmod(F.xxhash64(*by), F.coalesce("_lanes", F.lit(1))).cast("int")).drop("_lanes")
    copied = right.join(heavy, on, "left").withColumn("_lane", F.explode(F.sequence(F.lit(0), F.coalesce("_lanes", F.lit(1)) - 1))).drop("_lanes")
    return dealt.join(copied, [*on, "_lane"]).drop("_lane")


def group_links(entries: DataFrame, viable, verified) -> DataFrame:
    """Links (a, b) that connect all that the links among members of common groups would connect.

    entries (s, key, o): key is in group s, repeats allowed; viable(o1, o2) gives a condition on the names of two o columns; verified(pairs) keeps
    the pairs that are links. First each group's members are compared with its member of smallest o; then only members that are still in
    different components, so a large group of alike members gives as many pairs as it has members, not its square."""
    before = staged()
    pivots = entries.groupBy("s").agg(F.min("key").alias("k1"), F.max("key").alias("k2"), F.min_by("key", "o").alias("pivot"), F.min("o").alias("po"), F.count("*").alias("rows")).where("k1 <> k2").drop("k1", "k2")
    pivots = stage(pivots, "pivots")
    shared = stage(join_heavy(entries, pivots, ["s"], "rows", pivots.agg(F.sum("rows")).first()[0] or 0), "shared")
    star = shared.where("key <> pivot").where(viable("o", "po")).selectExpr("least(key, pivot) a", "greatest(key, pivot) b").distinct()
    star = stage(star, "star")
    links = stage(verified(star), "links")
    comp = stage(connected_components(links), "comp")
    part = shared.join(comp.select(F.col("node").alias("key"), "component"), "key", "left").select("s", "key", "o", F.coalesce("component", "key").alias("c"))
    part = stage(part, "part")
    mixed = part.groupBy("s").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("rows")).where("c1 <> c2").select("s", "rows")
    mixed = stage(mixed, "mixed")
    part = stage(join_heavy(part, mixed, ["s"], "rows", mixed.agg(F.sum("rows")).first()[0] or 0).distinct(), "part")
    other = part.select("s", F.col("key").alias("key_2"), F.col("o").alias("o_2"), F.col("c").alias("c_2"))
    cross = join_salted(part, other, ["s"], ["key"]).where("c < c_2").where(viable("o", "o_2")).selectExpr("least(key, key_2) a", "greatest(key, key_2) b").distinct()
    cross = stage(cross.join(star, ["a", "b"], "left_anti"), "cross")
    links = stage(links.unionByName(verified(cross)), "links")
    drop_stages(before, but_last=1)
    return links


def kept_by_bits(rows: DataFrame, hash_column: str, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose hash isn't among wanted's: a bitmap of 2**23 bits, so the broadcast has at most 2**17 rows."""
    word, bit = lambda c: F.shiftrightunsigned(c, 6).bitwiseAND(F.lit((1 << 17) - 1)), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))
    bits = wanted.select(word(F.col(hash_column)).alias("_w"), bit(F.col(hash_column)).alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits"))
    return rows.withColumn("_w", word(F.col(hash_column))).join(F.broadcast(bits), "_w").where(F.col("_bits").bitwiseAND(bit(F.col(hash_column))) != 0).drop("_w", "_bits")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of an edge, the smallest node that it reaches.

    Alternates the large-star and small-star steps until nothing changes; either step is one grouping whose aggregate (a
    minimum) combines before the shuffle, and one join back, in which nodes of high degree are broadcast (see join_heavy), so that
    a node's edges are never gathered in one row or one task.
    Each round is written to the shared folder, and the one before goes. Nulls and loops make no edge; no edges give no rows."""
    before = staged()
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct()
    e = stage(e, "edges")
    last, n = None, e.count()
    while True:  # each round ties nodes to smaller ones only, so it ends
        both = e.unionByName(e.selectExpr("v u", "u v"))
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree")), "low")
        # large star: every larger neighbour of u is tied to the smallest of u's neighbourhood
        e = join_heavy(both.where("v > u"), low, ["u"], "degree", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them; a node has few of these now
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        tied = e.join(low, "u")
        e = tied.where("v <> m").selectExpr("v u", "m v").unionByName(low.selectExpr("u", "m v")).where("u <> v").distinct()
        e = stage(e, "edges")
        drop_stages(before, but_last=1)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last, n = now, now[0]
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.selectExpr("v node", "v component").distinct())
