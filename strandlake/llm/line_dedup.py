"""Line dedup: lines that stand in many documents go from all but one of them.

A text is cut at every line feed (null or empty: one empty line). A line's key is the line without ASCII white space at its ends, with
A-Z in lower case. Keys are told apart by 128 bits of hash, and only hashes, ids and places are shuffled by key. A key of at least
`least_chars` code points that stands in at least `least_docs` documents loses all its lines except those of the largest doc_id
that holds it; how often it stands in one document does not matter. The lines that stay are joined again in their order.

Documents are told apart by doc_id. Rows with one doc_id are one document, and so are all rows with null doc_id, which is smaller than
any other; every row of docs gives a row. Texts of any length are cut whole. An empty table gives no rows; other columns of docs are
not looked at, whatever their names.

Scale: distinct documents are counted in two groupings that both combine before the shuffle, so a line that stands everywhere is a row
of each task. Repeated keys meet the lines that hold them with heavy keys broadcast (join_heavy: at most 4,096), and a text moves
once, and only where one of its lines goes may it meet anything but itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import drop_stages, stage, staged
from strandlake.llm.components import join_heavy, join_left_heavy

WHITE, UPPER, LOWER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY, ROW = ["h1", "h2"], ["doc_id", "t1", "t2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashes(x: Column, *names: str) -> list[Column]:
    """128 bits of hash as two columns."""
    return [F.xxhash64(x).alias(names[0]), F.xxhash64(F.lit(1), x).alias(names[1])]


def drop_repeated_lines(docs: DataFrame, least_docs: int = 5, least_chars: int = 40) -> DataFrame:
    """doc_id, text (the lines that stay, joined by line feeds), n_lines (before), n_dropped: a row for each row of docs."""
    before = staged()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = texts.where(F.length("text") >= least_chars).select("doc_id", "text", *hashes(F.col("text"), "t1", "t2"))
    # the text's own hashes come first: what is selected beside an explode is worked out for each line
    rows = hashed.select(*ROW, F.posexplode(lines_of(F.translate("text", UPPER, LOWER))).alias("at", "line"))
    held = rows.withColumn("line", F.btrim("line", F.lit(WHITE))).where(F.length("line") >= least_chars).select(*ROW, "at", *hashes(F.col("line"), *KEY))

    each = held.groupBy(*KEY, "doc_id").agg(F.count("*").alias("lines"))
    keys = each.groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"), F.sum("lines").alias("lines")).where(F.col("docs") >= least_docs)
    keys = stage(keys.select(*KEY, "last", "lines"), "keys")
    total = keys.agg(F.sum("lines")).first()[0] or 0

    gone = join_heavy(held, keys, KEY, "lines", total).where(F.coalesce(F.col("doc_id") < F.col("last"), F.col("last").isNotNull()))
    # rows of one doc_id and text lose the same lines, so a set of places does for all of them
    gone = stage(gone.groupBy(*ROW).agg(F.collect_set("at").alias("gone"), F.count("*").alias("n")), "gone")
    # a row repeated n times has the places of each line n times
    times = gone.withColumn("times", F.expr("n div size(gone)")).drop("n")
    hit = times.agg(F.sum("times")).first()[0] or 0

    named = lambda df: df.withColumn("none", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    on = ["none", *ROW]
    met = join_left_heavy(named(hashed), named(times), on, "times", hit)
    met = met.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "text", "gone")
    short = texts.where(F.coalesce(F.length("text"), F.lit(-1)) < least_chars).select("doc_id", "text", F.lit(None).cast("array<int>").alias("gone"))
    lines = met.unionByName(short).withColumn("lines", lines_of(F.col("text")))
    # array_except looks places up by hash, so texts of very many lines stay linear
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    cut = lines.withColumn("left", left)
    text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
    drop_stages(before, but_last=1)
    return cut.select("doc_id", text.alias("text"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"))
