"""Domain views over the given tables.

Each view is one SELECT that Spark and DuckDB read alike (integer arithmetic, no dialect functions), so a query and its SQL see
the same rows. `{name}` stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # variant sites: symbolic structural types by size, and short sequences in `ref` and `alt`
    "sites": """
        SELECT 'chr' || CAST(p_partkey % 22 + 1 AS STRING) AS chrom, CAST(p_partkey * 37 + 1 AS BIGINT) AS pos, 's' || CAST(p_partkey AS STRING) AS id, p_partkey AS site,
          CASE p_size % 5 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INS' WHEN 2 THEN 'DUP' WHEN 3 THEN 'INV' ELSE 'BND' END AS svtype,
          CASE WHEN p_size % 5 = 4 THEN NULL WHEN p_size % 5 = 0 THEN -CAST(p_size * (1 + p_partkey % 400) AS BIGINT) ELSE CAST(p_size * (1 + p_partkey % 400) AS BIGINT) END AS svlen,
          CASE WHEN p_partkey % 10 < 7 THEN 'main' WHEN p_partkey % 10 < 9 THEN 'large' ELSE 'bnd' END AS source,
          CASE WHEN p_partkey % 13 = 0 THEN 'LowQual' ELSE 'PASS' END AS filter,
          CASE WHEN p_size % 5 IN (0, 2, 3) THEN CAST(p_partkey * 37 + 1 + p_size * (1 + p_partkey % 400) AS BIGINT) ELSE CAST(p_partkey * 37 + 1 AS BIGINT) END AS end0,
          substr('ACGTACGTAC', 1, CAST(1 + p_size % 3 AS INT)) AS ref, substr('ATTTGCAGTC', 1, CAST(1 + p_partkey % 4 AS INT)) AS alt,
          CAST(p_size AS BIGINT) AS size
        FROM {part}""",
    # a haplotype of a sample at a site
    "haps": """
        SELECT s.chrom, s.pos, s.id, s.site, o.o_custkey AS sample, l.l_linenumber % 2 + 1 AS hap,
          max(CASE WHEN l.l_suppkey % 11 = 0 THEN NULL ELSE l.l_suppkey % 2 END) AS allele, max(CASE WHEN l.l_suppkey % 17 = 0 THEN NULL ELSE l.l_suppkey % 5 END) AS anc
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {sites} s ON s.site = l.l_partkey
        GROUP BY s.chrom, s.pos, s.id, s.site, o.o_custkey, l.l_linenumber % 2 + 1""",
    # haplotypes of every sample at the same few places
    "lai": """
        SELECT o.o_custkey AS sample, 'chr' || CAST(l.l_partkey % 3 + 1 AS STRING) AS chrom, (l.l_partkey % 7) * 1000 + 500 AS pos, l.l_linenumber % 2 + 1 AS hap,
          max(CASE WHEN l.l_suppkey % 17 = 0 THEN NULL ELSE l.l_suppkey % 3 END) AS anc, max(CASE WHEN l.l_suppkey % 11 = 0 THEN NULL ELSE l.l_suppkey % 2 END) AS allele
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2, 3, 4""",
    "calls": """
        SELECT chrom, pos, id, site, sample, max(CASE WHEN hap = 1 THEN allele END) AS a1, max(CASE WHEN hap = 2 THEN allele END) AS a2,
          max(CASE WHEN hap = 1 THEN anc END) AS an1, max(CASE WHEN hap = 2 THEN anc END) AS an2,
          CASE WHEN (site + sample) % 9 = 0 THEN NULL ELSE (site * 7 + sample * 3) % 60 END AS gq, CASE WHEN (site + sample) % 7 = 0 THEN NULL ELSE (site * 5 + sample) % 40 END AS dp,
          CASE WHEN (site + sample) % 23 = 0 THEN 'I.' ELSE '..' END AS rnc
        FROM {haps} GROUP BY chrom, pos, id, site, sample""",
    # carriers of a small panel (suppliers are its samples) at all sites; a genotype without a row is 0. Alleles follow the sample's group of four
    "panel": """
        SELECT s.chrom, s.pos, s.site, l.l_suppkey AS sample, max(CASE WHEN l.l_orderkey % 61 = 0 THEN NULL WHEN (s.site * 31 + (l.l_suppkey % 4) * 17 + s.site % 3 * l.l_linenumber) % 5 < 3 THEN 1 ELSE 0 END) AS a1,
          max(CASE WHEN l.l_orderkey % 61 = 0 THEN NULL WHEN (s.site + (l.l_suppkey % 4) * 3 + l.l_linenumber) % 3 < 2 THEN 1 ELSE 0 END) AS a2
        FROM {lineitem} l JOIN {sites} s ON s.site = l.l_partkey GROUP BY s.chrom, s.pos, s.site, l.l_suppkey""",
    "carriers": "SELECT DISTINCT id, site, sample FROM {haps} WHERE allele > 0",
    "samples": """
        SELECT c.c_custkey AS sample, CASE n.n_regionkey WHEN 0 THEN 'afr' WHEN 1 THEN 'amr' WHEN 2 THEN 'eas' WHEN 3 THEN 'eur' ELSE 'sas' END AS ancestry,
          c.c_custkey % 50 = 0 AS control, c.c_acctbal AS balance, c.c_mktsegment AS segment, c.c_custkey % 2 AS sex
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "track": """
        SELECT 'chr' || CAST(o_orderkey % 22 + 1 AS STRING) AS chrom, (o_orderkey * 1009) % 80000 AS start0, (o_orderkey * 1009) % 80000 + 50 + o_orderkey % 400 AS end0,
          CASE o_orderkey % 3 WHEN 0 THEN 'rm' WHEN 1 THEN 'sr' ELSE 'sd' END AS name
        FROM {orders}""",
    "markers": "SELECT 'chr' || CAST(p_partkey % 22 + 1 AS STRING) AS chrom, CAST(p_partkey * 37 + 1 AS BIGINT) AS pos, p_partkey % 5 AS an1, p_size % 5 AS an2 FROM {part}",
    "catalog": """
        SELECT 'chr' || CAST(p_partkey % 22 + 1 AS STRING) AS chrom, CAST(p_partkey * 37 - 20 AS BIGINT) AS start0, CAST(p_partkey * 37 - 20 + p_size * 9 AS BIGINT) AS end0,
          'L' || CAST(p_partkey AS STRING) AS locus, CAST(p_size % 6 + 1 AS BIGINT) AS period
        FROM {part} WHERE p_size <= 10""",
    "assoc": """
        SELECT l_returnflag || l_linestatus AS phenotype, 'chr' || CAST(l_partkey % 22 + 1 AS STRING) AS chrom, l_partkey * 37 + 1 AS pos, CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING) || '_' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS marker,
          CASE l_linenumber % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'ru' ELSE 'carrier' END AS arm,
          ((l_orderkey * 7919 + l_linenumber * 104729) % 1000003 + 1) / 1000004.0e0 AS p, ((l_orderkey * 6007 + l_linenumber * 7877) % 1000003 + 1) / 1000004.0e0 AS p2,
          CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE ((l_orderkey * 31 + l_linenumber) % 1009) / 1009.0e0 END AS p3,
          l_discount * 10 - 0.5e0 AS beta1, l_tax * 10 - 0.4e0 AS beta2, 0.1e0 + l_discount AS se1, 0.2e0 + l_tax AS se2, l_linenumber % 2 = 0 AS spa,
          CAST(l_quantity AS BIGINT) AS n_het, l_suppkey % 9 AS n_hom, 500 + l_partkey % 100 AS n_ctrl, l_suppkey % 2 = 0 AS include
        FROM {lineitem}""",
    "cpg": """
        SELECT user_id AS sample, CASE event_id % 3 WHEN 0 THEN 'hap1' WHEN 1 THEN 'hap2' ELSE 'combined' END AS track, CASE event_id % 24 WHEN 22 THEN 'chrX' WHEN 23 THEN 'chrY' ELSE 'chr' || CAST(event_id % 22 + 1 AS STRING) END AS chrom,
          event_id % 40 AS begin0, event_id % 31 AS cov, CAST((event_id * 7) % 101 AS DOUBLE) AS score, event_type AS caller
        FROM {events}""",
    "ehr": "SELECT user_id AS person, event_type AS concept, value, event_id FROM {events}",
    "pheno": "SELECT o_custkey AS person, 'CV_' || substr(o_orderpriority, 1, 1) || CASE WHEN o_orderkey % 2 = 0 THEN '01' ELSE '01.' || CAST(o_orderkey % 4 AS STRING) END AS code, max(CASE WHEN o_orderkey % 5 < 2 THEN 1 WHEN o_orderkey % 17 = 0 THEN NULL ELSE 0 END) AS value FROM {orders} GROUP BY 1, 2",
    "ped": "SELECT c_custkey AS child, CASE WHEN c_custkey > 40 THEN CAST((c_custkey - c_custkey % 2) / 2 AS BIGINT) ELSE 0 END AS father, CASE WHEN c_custkey > 40 THEN CAST((c_custkey - c_custkey % 3) / 3 AS BIGINT) ELSE 0 END AS mother FROM {customer}",
    "alleles": """
        SELECT 'L' || CAST(l_partkey AS STRING) AS locus, CAST(l_partkey % 6 + 1 AS BIGINT) AS period, l_suppkey % 13 - 6 AS dosage, CAST(count(*) AS BIGINT) AS n
        FROM {lineitem} GROUP BY 1, 2, 3""",
}


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over the tables that it needs."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    given = {n: view(spark, sf_dir, n) for n in needs(sql)}
    return spark.sql(sql, **(dealt(spark, given, "lineitem", DEALT[name]) if name in DEALT else given))


#: Rows of the largest table that a task of a view joins and groups, at most about; each takes some 900 bytes of its memory.
PER_TASK = 500_000
#: By view, the keys by which its largest table meets others. The last one is among the columns that the view groups by, so groups lie in these parts too.
DEALT = {"haps": {"orders": "o_orderkey", "sites": "site"}}


def dealt(spark: SparkSession, given: dict[str, DataFrame], largest: str, keys: dict[str, str]) -> dict[str, DataFrame]:
    """given, its tables in more parts where the session's number of partitions would give a task over PER_TASK rows of the largest: a join follows its side with more parts."""
    parts = -(-given[largest].count() // PER_TASK)
    if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return given
    return given | {n: given[n].repartition(parts, key) for n, key in keys.items()}


def oracle(sql: str) -> str:
    """SQL over views, with the views that it needs put in front."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in needs(text):
            if n in VIEWS and n not in order:
                add(VIEWS[n])
                order.append(n)

    add(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    if not order:
        return plain(sql)
    ctes = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.IGNORECASE)
    if head:
        return f"WITH {head[1] or ''}{ctes}, {plain(sql[head.end():])}"
    return f"WITH {ctes} {plain(sql)}"


class Plans:
    """Registers queries with their SQL."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, views: str, run, sql: str | None = None) -> None:
        """run gets the views named (separated by blanks) as DataFrames."""
        names = views.split()
        self.queries[name] = lambda spark, sf_dir: run(*(view(spark, sf_dir, n) for n in names))
        if sql:
            self.sql[name] = oracle(sql)
