"""Lookups of values and ranks under skew, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddrows.operators import eda, joins


def skewed(n=4000):
    """Nine rows in ten share one value of ``a``; ``b`` has many values, ``c`` a few, some of them -0.0."""
    rng = np.random.default_rng(6)
    a = np.where(rng.random(n) < 0.9, 5.0, rng.integers(0, 900, n))
    return pd.DataFrame({"a": a, "b": rng.normal(size=n) + a / 300, "c": rng.integers(-1, 2, n) * 0.5 * np.where(rng.random(n) < 0.5, 1, -1)})


def test_ranks_of_all_columns_are_looked_up_at_once(spark):
    frame = skewed()
    df = spark.createDataFrame(frame).repartition(5)
    got = {(r["a"], r["b"]): r["spearman"] for r in eda.spearman_matrix(df, ["a", "b", "c"]).collect()}
    want = (frame + 0.0).corr(method="spearman")
    assert all(got[x, y] == pytest.approx(want.loc[x, y], abs=1e-9) for x in "abc" for y in "abc")


def test_rows_with_gaps_and_equal_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (None, 5.0, 1.0), (2.0, float("nan"), 1.0), (3.0, 1.0, 3.0), (4.0, 0.0, 3.0)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["spearman"] for r in eda.spearman_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(-1.0) and got["c", "c"] == 0.0 and got["a", "c"] == 0.0  # c is constant over complete rows


def test_a_hot_value_is_dealt_evenly(spark):
    """With 90 % of the rows in one value, the tasks after the shuffle still get about the same share."""
    n = 20_000
    df = spark.range(n).select("id", F.when(F.col("id") % 10 < 9, 7).otherwise(F.col("id")).alias("v"))
    values = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = joins.value_lookup(df, values, ["v"], "n", n)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert found.filter(F.col("n") != F.when(F.col("v") == 7, n * 9 // 10).otherwise(1)).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == n and len(sizes) == 8 and max(sizes) < 1.3 * n / 8


def test_counts_beside_rows(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["x", "y", "x", None, "x"])], "id long, v string")
    assert sorted(map(tuple, joins.value_counts_joined(df, F.col("v")).collect())) == [(0, "x", 3), (1, "y", 1), (2, "x", 3), (4, "x", 3)]
    assert joins.value_counts_joined(df.limit(0), F.col("v")).count() == 0


def test_report_makes_each_matrix_once(spark, monkeypatch):
    calls = []
    for name in ("pearson_matrix", "spearman_matrix"):
        real = getattr(eda, name)
        monkeypatch.setattr(eda, name, lambda *a, _r=real, _n=name, **k: (calls.append(_n), _r(*a, **k))[1])
    df = spark.createDataFrame(skewed(300)).withColumn("id", F.monotonically_increasing_id())
    report = eda.eda_report(df, ["id"])
    assert sorted(calls) == ["pearson_matrix", "spearman_matrix"] and report["top_correlations"].count() > 0


def test_constant_columns_have_no_correlation_and_raise_nothing(spark):
    from oddrows.operators.profile import analyze, pairwise_correlations

    df = spark.createDataFrame([(float(i), 4.0, float(-i), None if i % 2 else 1.0) for i in range(8)], "a double, b double, c double, d double")
    got = {(r["a"], r["b"]): r["r"] for r in pairwise_correlations(df, ["a", "b", "c", "d"]).collect()}
    assert got["a", "c"] == pytest.approx(-1.0) and all(not got[p] for p in got if p != ("a", "c"))
    assert {(r["a"], r["b"]): r["pearson"] for r in eda.pearson_matrix(df, ["a", "b", "c"]).collect()}["a", "b"] == 0.0
    assert analyze(df, ["a", "b", "c", "d"]).features == 4


def test_common_names_are_made_distinct_before_they_are_shuffled(spark):
    a = spark.range(20_000).selectExpr("if(id % 7 = 0, null, concat('d', id % 3)) AS dataset")
    b = spark.range(20_000).selectExpr("if(id % 5 = 0, null, concat('d', 1 + id % 3)) AS dataset")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for names too many to broadcast
    try:
        found = joins.common_datasets(a, b)
        assert sorted(r[0] or "" for r in found.collect()) == ["", "d1", "d2"]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan[plan.index("Join LeftSemi"):].count("Aggregate [dataset") == 2  # one on each side, below the join
