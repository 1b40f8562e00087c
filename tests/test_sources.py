"""Files with their own headers, and a layout by position whose windows prune."""

import pytest
from pyspark.sql import functions as F

from strandlake.operators import association as A
from strandlake.sources import tables as T

HEAD = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")


def test_each_file_has_its_own_samples(spark, tmp_path):
    write(tmp_path / "a.vcf", "##x", f"{HEAD}\tann\tbob", "chr1\t5\ta\tA\tG\t.\tPASS\t.\tGT\t0|1\t1|1")
    write(tmp_path / "b.vcf", f"{HEAD}\tbob\tcleo\tann", "chr1\t9\tb\tA\tG\t.\tPASS\t.\tGT\t0|0\t.\t1|0")
    write(tmp_path / "c.vcf", HEAD.removesuffix("\tFORMAT"), "chr2\t1\tc\tA\tG\t.\tPASS\tX=1")
    sites, calls = T.read_vcf(spark, f"file://{tmp_path}")
    assert {(r.id, r["sample"], r.a1, r.a2) for r in calls.collect()} == {("a", "ann", 0, 1), ("a", "bob", 1, 1), ("b", "bob", 0, 0), ("b", "cleo", None, None), ("b", "ann", 1, 0)}
    assert {r.id for r in sites.collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("lines,said", [(["chr1\t5\ta\tA\tG\t.\tPASS\t.\tGT\t0|1"], "no #CHROM line"), ([f"{HEAD}\tx\ty", "chr1\t5\ta\tA\tG\t.\tPASS\t.\tGT\t0|1"], "cells differ"), ([f"{HEAD}\tx", f"{HEAD}\ty"], "two sample lists")])
def test_headers_that_do_not_fit(spark, tmp_path, lines, said):
    write(tmp_path / "a.vcf", f"{HEAD}\tann", "chr1\t7\ta\tA\tG\t.\tPASS\t.\tGT\t0|1")
    write(tmp_path / "b.vcf", *lines)
    with pytest.raises(Exception, match=said):
        T.read_vcf(spark, f"file://{tmp_path}")[1].collect()


def test_shards_with_another_header_fail(spark, tmp_path):
    write(tmp_path / "a.tsv", "chrom\tpos", "chr1\t5")
    assert [tuple(r) for r in T.read_shards(spark, f"file://{tmp_path}", ["chrom", "pos"]).collect()] == [("chr1", "5")]
    write(tmp_path / "b.tsv", "pos\tchrom", "9\tchr1")
    with pytest.raises(Exception, match="(?i)header"):
        T.read_shards(spark, f"file://{tmp_path}", ["chrom", "pos"]).collect()


def test_windows_prune_folders_and_row_groups(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("concat('chr', id % 3 + 1) chrom", "id * 7 % 50000 pos", "id marker", "if(id % 2 = 0, 'a', 'b') phenotype")
    at = f"file://{tmp_path}/t"
    T.write_positioned(rows, at, ("phenotype",), 1000)
    windows = spark.createDataFrame([("w", "chr1", 2500, 3100), ("v", "chr1", 3000, 3400), ("u", "chr3", 44_000, 44_010), ("none", "chrX", 1, 9)], "window string, chrom string, start long, end long")
    want = sorted((w, c, r.marker) for w, c, a, z in map(tuple, windows.collect()) for r in rows.where((F.col("chrom") == c) & F.col("pos").between(a, z)).collect())
    for most in (2000, 1):
        got = T.read_windows(spark, at, windows, 1000, most)
        assert sorted((r.window, r.chrom, r.marker) for r in got.collect()) == want
    assert {r.phenotype for r in T.read_windows(spark, at, windows, 1000, phenotype="b").collect()} == {"b"}
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # the plan's text is cut short else
    plan = T.read_windows(spark, at, windows, 1000)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    told = next(x for x in plan.split("\n") if "FileScan" in x)
    assert "PartitionFilters: [" in told and "bin" in told.split("PartitionFilters")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(pos,2500)" in told
    read = T.read_windows(spark, at, windows, 1000).select(F.input_file_name().alias("f")).distinct().collect()
    assert 0 < len(read) <= 2 * 4  # of two phenotypes four bins, a file each
    assert T.read_windows(spark, at, windows.limit(0), 1000).count() == 0


def test_positions_in_few_folders(spark, tmp_path):
    """A table that reaches over many bins has no folder for each of them."""
    rows = spark.range(6000).selectExpr("concat('chr', id % 2 + 1) chrom", "id * 1000 pos", "id marker")
    at = f"file://{tmp_path}/t"
    T.write_positioned(rows, at, (), 1000, folders=50)
    assert len(list((tmp_path / "t").glob("chrom=*/bin=*"))) <= 52
    windows = spark.createDataFrame([("w", "chr1", 2_500_000, 2_600_000), ("v", "chr2", 5_990_000, 9_000_000)], "window string, chrom string, start long, end long")
    got = {(r.window, r.marker) for r in T.read_windows(spark, at, windows, 1000).collect()}
    assert got == {("w", i) for i in range(2500, 2601) if i % 2 == 0} | {("v", i) for i in range(5990, 6000) if i % 2}


def test_nearest_measures_few(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    middle = rng.uniform(-9, 9, (12, 4))
    v = middle[rng.integers(0, 12, 3000)] + rng.normal(0, 0.3, (3000, 4))
    v[500:1500] = v[0]  # a third of all are one and the same
    df = spark.createDataFrame([(i, str(i % 3), [float(x) for x in v[i]]) for i in range(3000)], "id long, label string, v array<double>")
    asked = df.where("id % 100 = 7")
    got = {}
    for r in A.nearest(asked.select("id", "v"), df, 5, block=8, chunk=200).collect():
        got.setdefault(r.id, []).append((r.r, r.ref, round(r.d, 9), r.compared))
    for i in range(7, 3000, 100):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        order = np.lexsort((np.arange(3000), d))[:5]
        assert [(r, ref) for r, ref, _, _ in sorted(got[i])] == [(n + 1, int(j)) for n, j in enumerate(order)]
    assert np.mean([x[0][3] for x in got.values()]) < 0.35 * 3000
    assert A.nearest(asked.select("id", "v"), df.limit(0), 5).count() == 0
    assert A.nearest(asked.select("id", "v"), df.limit(3), 5).count() == 3 * asked.count()
