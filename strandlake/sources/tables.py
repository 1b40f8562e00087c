"""Readers and writers: typed delimited tables, variant call text, shards, stages that can be resumed."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import rows as R

TRUE = ("1", "true", "t", "yes")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, as in tests, a new temporary one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all its machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-strandlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/steps/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def checkpointed(spark: SparkSession, path: str, params: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The stored stage at path if it is complete and was made with the same params, else make() stored there.

    The params are written after the data, so a stage that was broken off is made again."""
    told = json.dumps(params, sort_keys=True)
    done, fs = _files(spark, f"{path}/_SUCCESS")
    kept, _ = _files(spark, f"{path}.params")
    if fs.exists(done) and fs.exists(kept) and spark.read.text(f"{path}.params").first()[0] == told:
        return spark.read.parquet(path)
    make().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.params")
    return spark.read.parquet(path)


def read_typed(spark: SparkSession, path: str, schema: dict[str, str], sep: str = "\t") -> DataFrame:
    """A delimited table with a header: empty and '.' are null, booleans by text, integers through double, what doesn't parse is null."""
    raw = spark.read.csv(path, sep=sep, header=True, nullValue=".", emptyValue="")

    def typed(name: str, kind: str):
        x = F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
        if kind == "boolean":
            return F.when(x.isNotNull(), F.lower(x).isin(*TRUE))
        if kind in ("int", "bigint"):
            return x.try_cast("double").try_cast(kind)
        return x if kind == "string" else x.try_cast(kind)

    return raw.select(*(typed(n, k).alias(n) for n, k in schema.items()))


def read_vcf(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(sites, calls) from variant call text. Every file has its own sample list, its #CHROM line's, so files may order samples differently.

    sites: chrom, pos, id, ref, alts, filter, info (map); calls: chrom, pos, id, ref, alt, sample, a1, a2, phased, format (map). A file with
    records and without such a line, one with two different ones, and a record with more or fewer cells than its file has samples are errors."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    heads = lines.where(F.col("value").startswith("#CHROM")).groupBy("file").agg(F.min("value").alias("head"), F.max("value").alias("other"))
    heads = stage(heads.where(F.when(F.col("head") == F.col("other"), True).otherwise(F.raise_error(F.concat(F.lit("two sample lists in "), "file")))).select("file", F.slice(F.split("head", "\t"), 10, 1 << 30).alias("samples"), F.xxhash64("head").alias("list")), "headers")
    # most files of a call have one and the same list: files know its hash, and each list is kept once
    lists = heads.groupBy("list").agg(F.first("samples").alias("samples"))
    told = heads.agg(F.sum(F.length("file") + 8), F.lit(0)).first()[0] or 0
    size = lists.agg(F.sum(F.aggregate("samples", F.lit(0).cast("long"), lambda n, x: n + F.length(x) + 16))).first()[0] or 0
    small = lambda df, n: F.broadcast(df) if n <= 64 << 20 else df
    f = F.split(F.col("value"), "\t")
    body = lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).select(f.alias("f"), "file")
    body = body.join(small(heads.select("file", "list"), told), "file", "left")
    body = body.withColumn("list", F.coalesce("list", F.raise_error(F.concat(F.lit("no #CHROM line in "), "file")).cast("long")))
    key = [F.col("f")[0].alias("chrom"), F.col("f")[1].cast("int").alias("pos"), F.nullif(F.col("f")[2], F.lit(".")).alias("id"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt")]
    sites = body.select(*key[:4], F.split(F.col("f")[4], ",").alias("alts"), F.nullif(F.col("f")[6], F.lit(".")).alias("filter"), R.parse_info(F.col("f")[7]).alias("info"))
    named = body.join(small(lists, size), "list").where(F.size("samples") > 0)
    named = named.where(F.when(F.size("f") == F.size("samples") + 9, True).otherwise(F.raise_error(F.concat(F.lit("a record's cells differ from the sample list of "), "file"))))
    cells = named.select(*key, F.col("f")[8].alias("fmt"), F.explode(F.arrays_zip("samples", F.slice("f", 10, 1 << 30).alias("cell"))).alias("c")).select(*("chrom", "pos", "id", "ref", "alt", "fmt"), F.col("c.samples").alias("sample"), F.col("c.cell").alias("cell"))
    cells = cells.withColumn("format", R.parse_format("fmt", "cell")).withColumn("gt", F.try_element_at("format", F.lit("GT")))
    allele = lambda n: F.get(F.split("gt", r"[/|]"), n).try_cast("int")
    return sites, cells.select("chrom", "pos", "id", "ref", "alt", "sample", allele(0).alias("a1"), allele(1).alias("a2"), F.col("gt").contains("|").alias("phased"), "format")


def read_shards(spark: SparkSession, paths: str | list[str], columns: list[str], sep: str = "\t") -> DataFrame:
    """Delimited shards as text columns; each file's header must be these columns in this order, else reading fails."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(paths, sep=sep, header=True, enforceSchema=False, nullValue="", emptyValue="")


# --- tables laid out by position


BIN = 1_000_000


def write_positioned(df: DataFrame, path: str, by: tuple[str, ...] = (), width: int = BIN, spread: int = 1, folders: int = 4096) -> None:
    """df (chrom, pos, ...) in folders by `by`, chrom and position bin, sorted by pos in each file, so that a window opens its bins' folders and in
    them the row groups that reach into it. width: so wide that a bin fills some row groups; spread: how many tasks write a bin.

    Where the table reaches over more bins than make about so many folders, all of which the driver lists, a folder has several bins; beside the
    table stands how wide its folders are."""
    keys = [*by, "chrom", "bin"]
    spans = df.groupBy(*by, "chrom").agg(F.min("pos").alias("low"), F.max("pos").alias("high")).agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    bins = spans.high // width - spans.low // width + 1 if spans.high is not None else 1
    width = int(width * max(1, -(-spans.n * bins // folders)))
    df.sparkSession.createDataFrame([(str(width),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.width")
    placed = df.withColumn("bin", F.floor(F.col("pos") / width).cast("long"))
    dealt = placed.repartition(*keys, F.pmod(F.xxhash64("pos"), F.lit(spread)))
    dealt.sortWithinPartitions(*keys, "pos").write.mode("overwrite").partitionBy(*keys).option("parquet.block.size", 16 << 20).parquet(path)


def read_windows(spark: SparkSession, path: str, windows: DataFrame, width: int = BIN, most: int = 2000, **only) -> DataFrame:
    """Rows in each window (window, chrom, start, end; ends included), a row in several where windows overlap; only: values of partition columns.

    Windows are merged first. What reaches the driver are the bins that they touch (no more than the table has folders) and, of at most `most` merged windows, the
    bounds, which prune row groups; with more windows only folders are pruned."""
    from strandlake.operators import intervals as I

    told, fs = _files(spark, f"{path}.width")
    if fs.exists(told):
        width = int(spark.read.text(f"{path}.width").first()[0])
    merged = stage(I.merge_intervals(windows.select("chrom", F.col("start").alias("start0"), (F.col("end") + 1).alias("end0")), ("chrom",)), "windows")
    bins = merged.select("chrom", F.explode(F.sequence(F.floor(F.col("start0") / width).cast("long"), F.floor((F.col("end0") - 1) / width).cast("long"))).alias("bin")).groupBy("chrom").agg(F.sort_array(F.collect_set("bin")).alias("bins")).collect()
    df = spark.read.parquet(path)
    for column, value in only.items():
        df = df.where(F.col(column) == value)
    few = merged.limit(most + 1).collect()
    wanted = F.lit(False)
    for r in bins:
        part = (F.col("chrom") == r.chrom) & F.col("bin").isin(r.bins)
        if len(few) <= most:
            mine = [x for x in few if x.chrom == r.chrom]
            inside = F.lit(False)
            for x in mine:
                inside = inside | F.col("pos").between(x.start0, x.end0 - 1)
            part = part & inside & F.col("pos").between(min(x.start0 for x in mine), max(x.end0 for x in mine) - 1)
        wanted = wanted | part
    if len(few) <= most and few:  # said of all chromosomes at once, so that it reaches the files
        wanted = wanted & F.col("pos").between(min(x.start0 for x in few), max(x.end0 for x in few) - 1)
    wanted = wanted & F.col("chrom").isin([r.chrom for r in bins]) & F.col("bin").isin(sorted({b for r in bins for b in r.bins}))
    return I.extract_windows(df.where(wanted).drop("bin"), windows)


def chrom_order(chrom="chrom"):
    """1 to 22, X, Y, M, then others."""
    bare = F.regexp_replace(F.col(chrom), "^chr", "")
    return F.coalesce(bare.try_cast("int"), F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25), F.lit(26))


def concat_shards(shards: list[DataFrame], parts: int | None = None) -> DataFrame:
    """One table of shards with equal columns, range-partitioned and sorted by chromosome and position."""
    if len({tuple(d.columns) for d in shards}) != 1:
        raise ValueError("the shards' columns differ")
    out = shards[0]
    for d in shards[1:]:
        out = out.unionByName(d)
    by = [chrom_order(), F.col("pos")]
    return (out.repartitionByRange(parts, *by) if parts else out.repartitionByRange(*by)).sortWithinPartitions(*by)


def write_by_sample(calls: DataFrame, path: str) -> None:
    """A folder for each sample; rows of a sample meet in few files, a crowded one in several (by chromosome)."""
    calls.repartition(F.col("sample"), F.col("chrom")).write.mode("overwrite").partitionBy("sample").parquet(path)


def write_table(df: DataFrame, path: str, columns: list[str], null: str = "", sep: str = "\t") -> None:
    """Columns in the given order, with the table's own text for null."""
    df.select(*columns).write.mode("overwrite").csv(path, sep=sep, header=True, nullValue=null, emptyValue="")


def write_lines(lines: DataFrame, path: str, head: list[str]) -> None:
    """lines (value) as text; each file begins with the lines of head."""

    def headed(batches):
        yield pa.RecordBatch.from_pydict({"value": pa.array(head, pa.string())})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    lines.select("value").mapInArrow(headed, "value string").write.mode("overwrite").text(path)


def read_hits(spark: SparkSession, path: str, phenotype: str | None = None) -> DataFrame:
    """A table partitioned by phenotype, pruned to one of them."""
    df = spark.read.parquet(path)
    return df if phenotype is None else df.where(F.col("phenotype") == phenotype)


def site_order(df: DataFrame) -> DataFrame:
    return df.orderBy(chrom_order(), "pos")
