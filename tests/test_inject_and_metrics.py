import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oddrows.operators import ensemble, inject as inj, metrics, thresholds
from oddrows.operators.sampling import injected_row_count

KEY = ["event_id"]
RANDOM = ["spike_single", "joint_shift", "scale_burst", "sign_flip", "dead_sensor", "missing_value"]


@pytest.fixture(scope="module")
def base(events):
    return events.select("event_id", F.col("value").alias("a"), F.col("user_id").alias("b"), F.col("event_type").alias("kind")).cache()


def rows(df, label="y_true"):
    return {r.event_id for r in df.filter(F.col(label) == 1).select("event_id").collect()}


def test_scenarios_and_overrides():
    assert len(inj.list_scenarios()) == 8
    assert inj.merged_params("spike_single", {"contamination": 0.3})["contamination"] == 0.3
    assert inj.SCENARIO_DEFAULTS["spike_single"]["contamination"] == 0.1
    with pytest.raises(KeyError):
        inj.merged_params("nope")
    assert inj.parse_overrides(contamination=" ", columns="a, b,", block_count="2.0", mode="ZERO") == {"columns": ["a", "b"], "block_count": 2, "mode": "zero"}


def test_row_count_rule():
    assert [injected_row_count(*a) for a in ((1, 0.5), (10, 0.0), (10, 0.01), (10, 0.25), (4, 0.99))] == [0, 0, 1, 3, 3]


@pytest.mark.parametrize("scenario", RANDOM + ["temporal_block"])
def test_contract(spark, base, scenario):
    a = inj.inject(base, scenario, key=KEY, seed=1)
    picked = rows(a)
    assert a.count() == base.count()
    assert len(picked) == injected_row_count(base.count(), inj.SCENARIO_DEFAULTS[scenario]["contamination"])
    assert picked == rows(inj.inject(base.repartition(7), scenario, key=KEY, seed=1))
    assert picked != rows(inj.inject(base, scenario, key=KEY, seed=2))
    untouched = a.filter("y_true = 0").join(base.select("event_id", F.col("a").alias("a0"), F.col("kind").alias("k0")), "event_id")
    assert untouched.filter("a <> a0 OR kind <> k0").count() == 0
    changes = inj.cell_changes(base, a.drop("y_true"), KEY, limit=None)
    assert {r.event_id for r in changes.select("event_id").distinct().collect()} <= picked


def test_one_block_is_contiguous(base):
    ids = sorted(rows(inj.inject(base, "temporal_block", key=KEY)))
    assert ids[-1] - ids[0] + 1 == len(ids)


@pytest.mark.parametrize("inline", [1000, 2])
def test_swap_changes_every_value(base, inline, monkeypatch):
    monkeypatch.setattr(inj, "INLINE_CATEGORIES", inline)  # both the literal and the joined way
    a = inj.inject(base, "categorical_flip", key=KEY, seed=3)
    both = a.join(base.select("event_id", F.col("kind").alias("old")), "event_id")
    assert both.count() == base.count()
    assert both.filter("y_true = 1 AND kind = old").count() == 0 and both.filter("y_true = 0 AND kind <> old").count() == 0
    assert {r[0] for r in a.select("kind").distinct().collect()} == {r[0] for r in base.select("kind").distinct().collect()}


def test_bad_parameters(base):
    with pytest.raises(KeyError):
        inj.inject(base, "spike_single", key=KEY, params={"column": "nope"})
    with pytest.raises(ValueError):
        inj.inject(base, "spike_single", key=KEY, params={"column": "kind"})
    with pytest.raises(ValueError):
        inj.inject(base, "dead_sensor", key=KEY, params={"mode": "odd"})
    with pytest.raises(ValueError):
        inj.inject(base.select("event_id", "a"), "categorical_flip", key=KEY)


def test_noise(base):
    assert inj.add_feature_noise(base, key=KEY, noise_std=0.0) is base
    a, b = (inj.add_feature_noise(base, key=KEY, noise_std=0.1, seed=s).select((F.col("a")).alias("x"), "event_id") for s in (1, 2))
    diff = a.join(base.select("event_id", "a"), "event_id").select((F.col("x") - F.col("a")).alias("d")).agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("s")).first()
    std = base.agg(F.stddev_pop("a")).first()[0]
    assert abs(diff["s"] / std - 0.1) < 0.01 and abs(diff["m"]) < 0.01 * std
    assert a.join(b.withColumnRenamed("x", "z"), "event_id").filter("x <> z").count() == base.count()


def scored(spark, y, s):
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "id long, y int, s double")


def test_metric_edges(spark):
    one = metrics.ranking_metrics(scored(spark, [0, 0, 0], [1, 2, 3]), "y", ["s"]).first()
    assert (one["roc_auc"], one["pr_auc"]) == (0.0, 0.0)
    perfect = metrics.ranking_metrics(scored(spark, [0, 0, 1, 1], [1, 2, 3, 4]), "y", ["s"]).first()
    assert (perfect["roc_auc"], perfect["pr_auc"]) == (1.0, 1.0)
    none = metrics.confusion(scored(spark, [1, 0], [0, 0]).withColumn("p", F.lit(0)), "y", "p").first()
    assert (none["precision"], none["recall"], none["f1"], none["specificity"]) == (0.0, 0.0, 0.0, 1.0)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=4, max_size=50))
def test_auc_counts_pairs(spark, cells):
    y, s = np.array([c[0] for c in cells]), np.array([c[1] for c in cells], float)
    got = metrics.ranking_metrics(scored(spark, y, s), "y", ["s"]).first()
    if 0 < y.sum() < len(y):
        gap = s[y == 1][:, None] - s[y == 0][None, :]
        assert got["roc_auc"] == pytest.approx(((gap > 0) + 0.5 * (gap == 0)).mean())


def adaptive(s, p=95.0):
    s = np.sort(s)
    if len(s) < 4 or s[-1] - s[0] < 1e-8:
        return np.percentile(s, p)
    best, cut = -1.0, None
    for k in range(1, max(1, min(int(np.ceil(len(s) * 0.2)), len(s) - 1)) + 1):
        gap = (s[-k] - s[-k - 1]) / (s[-1] - s[0])
        if gap > best:
            best, cut = gap, (s[-k] + s[-k - 1]) / 2
    return cut if best >= 0.08 else np.percentile(s, p)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(0, 100, allow_nan=False).map(lambda v: round(v, 3)), min_size=2, max_size=60))
def test_adaptive_gap(spark, values):
    got = thresholds.threshold(scored(spark, [0] * len(values), values), "s")
    assert got == pytest.approx(adaptive(np.array(values)))


def test_threshold_strategies(spark):
    values = np.random.default_rng(0).normal(size=200)
    df = scored(spark, [0] * 200, values)
    assert (values > thresholds.threshold(df, "s", "top_k", top_k=17)).sum() == 17
    assert (values > thresholds.threshold(df, "s", "expected_contamination", expected_contamination=0.1)).sum() == 20
    assert thresholds.threshold(df, "s", "mean_std") == pytest.approx(values.mean() + 1.5 * values.std())
    assert thresholds.threshold(df, "s", "percentile", percentile=80) == pytest.approx(np.percentile(values, 80))


def test_normalised_scores_are_bounded(spark):
    values = [float("nan"), float("inf"), float("-inf"), *np.random.default_rng(0).normal(size=100) * 5]
    got = np.array([r.s__norm for r in ensemble.normalize(scored(spark, [0] * len(values), values), ["s"]).orderBy("id").collect()])
    assert got.min() == 0.0 and got.max() == 1.0 and got[1] == 1.0
    flat = ensemble.normalize(scored(spark, [0] * 5, [2.0] * 5), ["s"])
    assert {r.s__norm for r in flat.collect()} == {0.0}


def test_weights():
    w = ensemble.ensemble_weights({"iforest": 0.1, "flatline": 0.1})
    assert sum(w.values()) == pytest.approx(1) and w["flatline"] / w["iforest"] == pytest.approx(0.65 / (0.45 * 0.55))
    assert ensemble.ensemble_weights({"a": 0.0, "b": 0.0}, named=False) == {"a": 0.5, "b": 0.5}
    assert ensemble.ensemble_weights({"iforest": 0.1, "lof": 0.1}, calibrated={"lof": 0.0})["lof"] == 0.0
