from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.operators.skew import join_groups


def test_hot_and_cold_keys_are_joined_alike(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else str(i % 7), i % 2) for i in range(200)] + [(999, None, 1)], "i int, k string, b int")
    groups = rows.where("k is not null").groupBy("k", "b").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    plain = sorted(rows.join(groups, ["k", "b"]).select("i", "k", "b", "first").collect())
    for hot, most in ((10**9, 5), (20, 100), (1, 100), (1, 3)):
        got = join_groups(rows, groups, ["k", "b"], "n", hot, most).select("i", "k", "b", "first")
        assert sorted(got.collect()) == plain
    assert join_groups(rows.limit(0), groups.limit(0), ["k", "b"], "n").count() == 0


def test_scratch_removes_what_was_stored(spark, tmp_path):
    import os

    from weirflow.sources.tables import scratch, shared_dir, stored

    before = set(os.listdir(shared_dir(spark)))
    with scratch(spark):
        assert stored(spark.range(5), "few").count() == 5
        assert set(os.listdir(shared_dir(spark))) != before
    assert set(os.listdir(shared_dir(spark))) == before
