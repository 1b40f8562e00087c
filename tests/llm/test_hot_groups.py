"""A third of all rows in one class of copies, a third empty; stars around one text; joins that deal a crowded key over several lanes."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.llm import ngram_join, suffix_dedup
from strandlake.llm.common import shared_dir
from strandlake.llm.components import connected_components, join_left_heavy, join_salted

SCHEMA = "doc_id long, text string"


def test_joins_with_a_crowded_key(spark):
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, 7, if(id % 3 = 1, 8, id)) k", "id")
    right = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c"), (11, "d"), (999_999, "e")], "k long, v string")
    got = join_salted(rows, right, ["k"], ["id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(right, "k").collect()))
    # the crowded keys' rows lie in more tasks than one
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got.where("k = 7").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    one = right.where("v <> 'b'").join(rows.groupBy("k").agg(F.count("*").alias("times")), "k")
    got = join_left_heavy(rows, one, ["k"], "times", 9000)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.join(one.drop("times"), "k", "left").collect()))


def test_long_chain_settles(spark):
    """A path far longer than a small number of rounds could follow link by link."""
    edges = spark.range(3000).selectExpr("id a", "id + 1 b")
    assert connected_components(edges).groupBy("component").count().collect()[0][:] == (0, 3001)


def test_ngram_join_with_hot_class(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(60)]
    near = []
    for i in range(200):  # a star: each is near the base, two of them need not be near each other
        w = list(base)
        w[rng.randrange(len(w))] = word()
        near.append((10_000 + i, " ".join(w)))
    rows = [(i, " ".join(base)) for i in range(1500)] + [(5000 + i, None if i % 2 else " ") for i in range(1500)] + near + [(20_000 + i, " ".join(word() for _ in range(30))) for i in range(100)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == 0 for i in range(1500)) and all(got[d] == 0 for d, _ in near)
    assert all(got[d] == d for d, t in rows if d >= 20_000 or t is None or t == " ")


def test_suffix_dedup_with_hot_text(spark):
    text = "".join(random.Random(7).choice("abcdefgh ") for _ in range(700))
    rows = [(i, text) for i in range(1200)] + [(None, text)] * 2 + [(5000 + i, "") for i in range(1200)] + [(9000, text[:399]), (9001, "x" + text[100:510] + "y"), (9002, "plain")]
    got = {}
    for r in suffix_dedup.digest(spark.createDataFrame(rows, SCHEMA), 400).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans))
    assert all(got[i] == [(700, 700, 1)] for i in range(1200)) and got[None] == [(700, 700, 1)] * 2
    assert all(got[5000 + i] == [(0, 0, 0)] for i in range(1200))
    assert got[9000] == [(399, 0, 0)] and got[9001] == [(412, 410, 1)] and got[9002] == [(5, 0, 0)]


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
