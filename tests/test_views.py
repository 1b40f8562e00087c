"""Views over larger tables are worked out in more parts, with the same rows."""

from strandlake.plans import catalog, views

SF = "/root/testdata/sf0.001"


def test_parts_of_haplotypes_follow_the_rows(spark, monkeypatch):
    rows = lambda df: sorted(map(repr, df.collect()))
    plain = rows(views.view(spark, SF, "haps"))
    sites = rows(catalog.QUERIES["c32_participant_sites"](spark, SF))
    monkeypatch.setattr(views, "PER_TASK", 600)  # some 6,000 rows: about ten parts, the session has four
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = views.view(spark, SF, "haps")
        assert many.rdd.getNumPartitions() >= 10
        assert rows(many) == plain
        assert rows(catalog.QUERIES["c32_participant_sites"](spark, SF)) == sites
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
