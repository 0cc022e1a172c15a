import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oddrows.operators import ordered, ranks, sampling
from oddrows.operators.ranks import order_statistics, quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")


@pytest.mark.parametrize("kind", ["spread", "hot", "two_values", "constant"])
def test_narrowed_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(1)
    values = {
        "spread": rng.normal(size=3000),
        "hot": np.where(rng.random(3000) < 0.4, 5.0, rng.normal(size=3000) * 10),  # one value holds 40% of the rows
        "two_values": rng.integers(0, 2, 3000).astype(float),
        "constant": np.full(500, 3.0),
    }[kind]
    got = quantiles(frame(spark, values).repartition(5), ["v"], PROBS, exact_agg_limit=1, inner_limit=20)["v"]
    assert np.allclose(got, np.quantile(values, PROBS), atol=1e-12)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60))
def test_order_statistics_match_sorting(spark, values):
    ranks = list(range(len(values)))
    got = order_statistics(frame(spark, values), {"v": (F.col("v"), ranks)}, inner_limit=3)["v"]
    assert [got[r] for r in ranks] == sorted(map(float, values))


@pytest.mark.parametrize("kind", ["spread", "hot", "ends"])
def test_drawn_cuts_leave_ranks_exact(spark, kind, monkeypatch):
    """Cuts come from a bounded draw of the rows; ranks are counted over all of them, whatever was drawn."""
    rng = np.random.default_rng(4)
    values = rng.normal(size=4000)
    if kind == "hot":
        values[rng.random(4000) < 0.6] = 0.25
    if kind == "ends":
        values[:300], values[300:700], values[700:900] = -np.inf, np.inf, np.nan
    monkeypatch.setattr(ranks, "DRAWN", 200)
    monkeypatch.setattr(ranks, "CUTS", 20)
    wanted = [0, 1, 299, 300, 2000, 3599, 3600, 3998, 3999]
    df = frame(spark, values).unionByName(spark.sql("SELECT id, CAST(NULL AS DOUBLE) AS v FROM range(50)")).repartition(5)
    sketched = []
    whole = ranks._members
    monkeypatch.setattr(ranks, "_members", lambda work, cells: sketched.append(work.count()) or whole(work, cells))
    got = order_statistics(df, {"v": (F.col("v"), wanted)}, inner_limit=50)["v"]
    assert np.array_equal([got[r] for r in wanted], np.sort(values)[wanted], equal_nan=True)
    assert 0 < sketched[0] < 600


def test_null_columns_have_null_quantiles(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS v FROM range(10)")
    assert quantiles(df, ["v"], [0.5])["v"] == [None]
    assert quantiles(df, ["v"], [0.5], exact_agg_limit=1)["v"] == [None]


@pytest.mark.parametrize("buckets", [1, 3, 16])
@pytest.mark.parametrize("partitions", [1, 7])
def test_ordered_results_do_not_depend_on_layout(spark, buckets, partitions, monkeypatch):
    monkeypatch.setattr(ordered, "bucket_count", lambda rows, parallelism: buckets)
    rng = np.random.default_rng(2)
    n = 700
    g = np.where(rng.random(n) < 0.4, 3, rng.integers(0, 9, n))  # a third of all rows share one order value
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": rng.integers(0, 3, n).astype(float)})
    df = spark.createDataFrame(pdf).repartition(partitions, "v")
    want = pdf.sort_values(["g", "id"]).reset_index(drop=True)

    index = ordered.with_row_index(df, ["g"], ["id"]).toPandas().sort_values("row_index")
    assert index["id"].tolist() == want["id"].tolist()
    assert index["row_index"].tolist() == list(range(n))

    near = ordered.shifted(df, ["v"], ["g"], ["id"]).toPandas().sort_values(["g", "id"])
    assert near["v__prev"].iloc[1:].tolist() == want["v"].iloc[:-1].tolist()
    assert near["v__next"].iloc[:-1].tolist() == want["v"].iloc[1:].tolist()

    mean = ordered.rolling_mean(df, "v", ["g"], ["id"]).toPandas().sort_values(["g", "id"])
    assert np.allclose(mean["rolling_mean"], want["v"].rolling(4, min_periods=1).mean())

    total = ordered.running_sum(df, {"t": F.col("v")}, ["g"], ["id"]).toPandas().sort_values(["g", "id"])
    assert np.allclose(total["t"], want["v"].cumsum())

    run, expected = 0, []
    for v in want["v"]:
        run = run + 1 if v > 0 else 0
        expected.append(run)
    streak = ordered.streak(df, F.col("v") > 0, ["g"], ["id"]).toPandas().sort_values(["g", "id"])
    assert streak["streak"].tolist() == expected

    ranks = ordered.average_ranks(df, {"v": F.col("v")}).toPandas().set_index("value")["avg_rank"].to_dict()
    assert ranks == pdf.assign(r=pdf["v"].rank()).groupby("v")["r"].first().to_dict()


def test_hot_order_value_is_split_by_key(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("g"))
    o = ordered.ordering(df, ["g"], ["id"], buckets=12)
    sizes = [r["count"] for r in o.df.groupBy(ordered.BUCKET).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1500


def test_string_order(spark):
    words = ["b", "aa", "", "abcdefgh", "abcdefga", "z", "é"] * 3
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, w string")
    got = ordered.with_row_index(df, ["w"], ["id"]).orderBy("row_index").select("w").toPandas()["w"].tolist()
    assert got == sorted(words, key=lambda w: w.encode())


def test_picks_are_seeded_and_exact(spark):
    df = spark.range(500)
    a = {r.id for r in sampling.seeded_pick(df, ["id"], 60, 1).collect()}
    assert a == {r.id for r in sampling.seeded_pick(df.repartition(9), ["id"], 60, 1).collect()}
    assert len(a) == 60 and a != {r.id for r in sampling.seeded_pick(df, ["id"], 60, 2).collect()}


def test_stratified_cap_and_split(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    cap = sampling.stratified_cap(df, ["id"], "y", 250)
    counts = {r["y"]: r["count"] for r in cap.groupBy("y").count().collect()}
    assert counts == {0: 225, 1: 25}
    split = sampling.stratified_split(df, ["id"], "y", 0.35)
    test = {r["y"]: r["count"] for r in split.filter("fold = 'test'").groupBy("y").count().collect()}
    assert test == {0: 315, 1: 35}
    assert sampling.stratified_split(df.limit(20), ["id"], "y", 0.35) is None


def test_blocks_are_contiguous_and_complete():
    for blocks in (1, 3, 7):
        ranges = sampling.block_ranges(100, 23, blocks, 5)
        rows = [i for a, b in ranges for i in range(a, b)]
        assert len(rows) == len(set(rows)) == 23 and max(rows) < 100 and len(ranges) == min(blocks, 23)


def test_no_single_partition_exchange_on_rows(spark, events):
    """The bucketed window keeps a partition key: rows never meet in one task."""
    o = ordered.ordering(events, ["ts"], ["event_id"], buckets=4)
    plan = o.df.withColumn("x", F.lag("value").over(o.window))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_three_passes_on_a_large_table(spark):
    """Many ranks of three columns, one of them mostly one value, over three million rows."""
    import time

    n = 3_000_000
    df = spark.range(n).select(
        F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("a"), F.when(F.col("id") % 10 < 9, 7.0).otherwise(F.col("id").cast("double")).alias("b"), (-F.col("id")).cast("double").alias("c")
    )
    probs = [p / 100 for p in range(50, 100)]
    begin = time.perf_counter()
    got = quantiles(df, ["a", "b", "c"], probs, rows=n)
    assert time.perf_counter() - begin < 120
    for p, b, c in zip(probs, got["b"], got["c"]):
        assert c == pytest.approx(-(n - 1) * (1 - p))
        assert b == 7.0 or p > 0.89
    exact = df.select("a").orderBy("a").offset(n // 2 - 1).limit(2).collect()
    assert got["a"][0] == (exact[0]["a"] + exact[1]["a"]) / 2


def test_order_by_strings_nulls_and_tied_columns(spark, monkeypatch):
    """Tuples are cut as the sort sees them: common prefixes, nulls, NaN and two tied columns."""
    from pyspark.sql import Window

    monkeypatch.setattr(ordered, "MIN_ROWS_PER_BUCKET", 500)
    rows = spark.range(8000).select(
        F.col("id"), F.format_string("Customer#%09d", (F.col("id") * 7919) % 8000).alias("name"), F.when(F.col("id") % 10 == 0, F.col("id") * 1.5).alias("sparse"),
        F.lit("same").alias("t1"), F.lit(3).alias("t2"), F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.col("id") % 50).alias("d"),
    )
    for order in (["name"], ["sparse"], ["t1", "t2"], ["d"], ["t1", "name"]):
        o = ordered.ordering(rows, order, ["id"], buckets=8)
        sizes = [r["count"] for r in o.df.groupBy(ordered.BUCKET).count().collect()]
        assert 6 <= len(sizes) <= 16 and max(sizes) < 8000 / 3
        got = ordered.with_row_index(rows, order, ["id"])
        want = rows.select("id", (F.row_number().over(Window.orderBy(*order, "id")) - 1).alias("want"))
        assert got.join(want, "id").where("row_index != want").count() == 0
