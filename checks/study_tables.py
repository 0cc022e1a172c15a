"""Meta selection, studies, and the tables that summarise them."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import out, query, sql_hash, table
from checks.score import SCORES_SQL, SOURCES, scores
from oddrows.operators import joins
from oddrows.operators.profile import analyze
from oddrows.plans import meta, study

# Orders stand in for a table of study results.
RUNS_SQL = """(SELECT o_orderpriority AS dataset, CASE o_custkey % 3 WHEN 0 THEN 'spike_single' WHEN 1 THEN 'joint_shift' ELSE 'sign_flip' END AS scenario,
  CASE o_orderstatus WHEN 'F' THEN 'ensemble' WHEN 'O' THEN 'iforest' ELSE 'lof' END AS score_source, CAST(o_custkey % 5 AS BIGINT) AS seed,
  0.0::DOUBLE AS noise_std, o_orderkey AS rows, o_totalprice / 500000 AS f1, (o_custkey % 100) / 100.0::DOUBLE AS roc_auc, (o_custkey % 10) / 10.0::DOUBLE AS pr_auc,
  o_totalprice / 400000 AS best_f1, CAST(50 + o_orderkey % 50 AS DOUBLE) AS best_percentile, o_custkey % 7 AS positive_count,
  CASE o_custkey % 3 WHEN 0 THEN '{"magnitude_in_std": 2.5}' WHEN 1 THEN '{"magnitude_in_std": 4.0}' ELSE '{}' END AS params_effective FROM orders)"""


def runs(spark, d):
    m = F.col("o_custkey") % 3
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("dataset"), F.when(m == 0, "spike_single").when(m == 1, "joint_shift").otherwise("sign_flip").alias("scenario"),
        F.when(F.col("o_orderstatus") == "F", "ensemble").when(F.col("o_orderstatus") == "O", "iforest").otherwise("lof").alias("score_source"),
        (F.col("o_custkey") % 5).alias("seed"), F.lit(0.0).alias("noise_std"), F.col("o_orderkey").alias("rows"), (F.col("o_totalprice") / 500000).alias("f1"),
        ((F.col("o_custkey") % 100) / 100.0).alias("roc_auc"), ((F.col("o_custkey") % 10) / 10.0).alias("pr_auc"), (F.col("o_totalprice") / 400000).alias("best_f1"),
        (F.lit(50) + F.col("o_orderkey") % 50).cast("double").alias("best_percentile"), (F.col("o_custkey") % 7).alias("positive_count"),
        F.when(m == 0, '{"magnitude_in_std": 2.5}').when(m == 1, '{"magnitude_in_std": 4.0}').otherwise("{}").alias("params_effective"),
        F.lit("a,b").alias("models_used"), F.col("o_orderpriority").alias("params_signature"))


GROUPED_SQL = f"""SELECT dataset, scenario, score_source, noise_std, count(*)::BIGINT AS n_runs, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std,
  round(avg(roc_auc), 6) AS roc_auc_mean, round(stddev_pop(roc_auc), 6) AS roc_auc_std, round(avg(pr_auc), 6) AS pr_auc_mean, round(stddev_pop(pr_auc), 6) AS pr_auc_std,
  round(avg(best_f1), 6) AS best_f1_mean, round(stddev_pop(best_f1), 6) AS best_f1_std, round(median(best_percentile), 6) AS best_percentile_median,
  any_value(params_effective) AS params_effective FROM {RUNS_SQL} GROUP BY dataset, scenario, score_source, noise_std"""


@query("a25_seed_aggregation", GROUPED_SQL)
def _(spark, d):
    return study.aggregate_runs(runs(spark, d)).drop("rows", "models_used", "params_signature")


@query("w8_worst_case_per_source", f"""
SELECT score_source, f1_mean AS worst_f1_mean, f1_std AS worst_f1_std, dataset AS worst_dataset, scenario AS worst_scenario, noise_std AS worst_noise_std,
  params_effective AS worst_params_effective, n_runs FROM (SELECT *, row_number() OVER (PARTITION BY score_source ORDER BY f1_mean, dataset, scenario) AS r FROM ({GROUPED_SQL})) WHERE r = 1""")
def _(spark, d):
    return study.worst_case(study.aggregate_runs(runs(spark, d)))


@query("a26_model_comparison", f"""
WITH g AS (SELECT score_source, count(f1)::BIGINT AS runs, avg(f1) AS a, stddev_samp(f1) AS s, avg(roc_auc) AS ro, avg(pr_auc) AS pr, avg(best_f1) AS b, min(f1) AS w FROM {RUNS_SQL} GROUP BY 1)
SELECT score_source, runs, round(a, 6) AS avg_f1, round(s, 6) AS std_f1, round(ro, 6) AS avg_roc_auc, round(pr, 6) AS avg_pr_auc, round(b, 6) AS avg_best_f1,
  round(w, 6) AS worst_f1, (rank() OVER (ORDER BY a DESC))::INT AS rank_by_f1 FROM g""")
def _(spark, d):
    return study.model_comparison(runs(spark, d))


@query("a27_heatmap", f"""
SELECT dataset, noise_std, scenario, round(avg(f1_mean) FILTER (WHERE score_source = 'ensemble'), 6) AS ensemble, round(avg(f1_mean) FILTER (WHERE score_source = 'iforest'), 6) AS iforest,
  round(avg(f1_mean) FILTER (WHERE score_source = 'lof'), 6) AS lof FROM ({GROUPED_SQL}) GROUP BY 1, 2, 3""")
def _(spark, d):
    return out(study.heatmap(study.aggregate_runs(runs(spark, d)), sources=["ensemble", "iforest", "lof"]))


@query("a28_sweep_series", f"""
WITH x AS (SELECT *, TRY_CAST(json_extract_string(params_effective, '$.magnitude_in_std') AS DOUBLE) AS x, 'all' AS sc FROM ({GROUPED_SQL}))
SELECT dataset, noise_std, 'all' AS scenario, 'magnitude_in_std' AS parameter, score_source, x, round(avg(f1_mean), 6) AS y_mean FROM x WHERE x IS NOT NULL
  AND dataset IN (SELECT dataset FROM x GROUP BY 1 HAVING count(DISTINCT x) >= 2) GROUP BY 1, 2, 5, 6""")
def _(spark, d):
    merged = study.aggregate_runs(runs(spark, d)).withColumn("scenario", F.lit("all"))
    return out(study.sweep_series(merged))


@query("a29_leave_one_out_averages", f"SELECT round(avg(f1), 6) AS f1, round(avg(roc_auc), 6) AS roc_auc, round(avg(pr_auc), 6) AS pr_auc FROM {RUNS_SQL}")
def _(spark, d):
    return out(study.lodo_averages(runs(spark, d)))


@query("w7_best_source_per_dataset", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pr_auc DESC, roc_auc DESC, f1 DESC, score_source) AS r FROM {RUNS_SQL} WHERE rows > 0)
SELECT dataset, score_source AS selected_source, 'f1' AS selected_metric, round(f1, 6) AS selected_score, round(roc_auc, 6) AS source_roc_auc, round(pr_auc, 6) AS source_pr_auc,
  rows AS evaluated_rows, round(positive_count * 1.0 / greatest(rows, 1), 6) AS expected_contamination
FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC, roc_auc DESC, pr_auc DESC, score_source) AS k FROM {RUNS_SQL}) WHERE k = 1""")
def _(spark, d):
    return meta.best_sources(runs(spark, d), "f1", ["ensemble", "iforest", "lof"])


PAIR = "SELECT dataset, score_source, round(avg(roc_auc), 6) AS roc_auc, round(avg(pr_auc), 6) AS pr_auc FROM {t} WHERE seed {op} 2 GROUP BY 1, 2"
A_SQL, B_SQL = PAIR.format(t=RUNS_SQL, op="<"), PAIR.format(t=RUNS_SQL, op=">=")


def halves(spark, d):
    def half(cond):
        return runs(spark, d).filter(cond).groupBy("dataset", "score_source").agg(
            F.round(F.avg("roc_auc"), 6).alias("roc_auc"), F.round(F.avg("pr_auc"), 6).alias("pr_auc"))
    return half("seed < 2"), half("seed >= 2")


@query("j3_consistency_join", f"""
SELECT dataset, score_source, a.roc_auc AS real_roc_auc, b.roc_auc AS synthetic_roc_auc, round(b.roc_auc - a.roc_auc, 6) + 0.0 AS delta_roc_auc,
  a.pr_auc AS real_pr_auc, b.pr_auc AS synthetic_pr_auc, round(b.pr_auc - a.pr_auc, 6) + 0.0 AS delta_pr_auc FROM ({A_SQL}) a JOIN ({B_SQL}) b USING (dataset, score_source)""")
def _(spark, d):
    return out(joins.consistency(*halves(spark, d)))


@query("b7_ranking_agreement", f"""
WITH a AS (SELECT dataset, list(score_source ORDER BY roc_auc DESC, score_source) AS real_ranking FROM ({A_SQL}) GROUP BY 1),
b AS (SELECT dataset, list(score_source ORDER BY roc_auc DESC, score_source) AS synthetic_ranking FROM ({B_SQL}) GROUP BY 1)
SELECT dataset, real_ranking, synthetic_ranking, real_ranking[1] = synthetic_ranking[1] AS top_match FROM a JOIN b USING (dataset)""")
def _(spark, d):
    return study.ranking_agreement(*halves(spark, d))


@query("u2_union_of_results", f"SELECT dataset, score_source, f1 FROM {RUNS_SQL} UNION ALL SELECT dataset, score_source, f1 FROM {RUNS_SQL} WHERE seed = 0")
def _(spark, d):
    r = runs(spark, d).select("dataset", "score_source", "f1", "seed")
    return joins.union_all([r, r.filter("seed = 0")]).drop("seed")


@query("b1_unit_plan", """
WITH ds AS (SELECT o_orderstatus AS dataset, row_number() OVER (ORDER BY o_orderstatus) - 1 AS i FROM (SELECT DISTINCT o_orderstatus FROM orders)),
sc AS (SELECT * FROM (VALUES (0, 'spike_single', '{"contamination": 0.1, "magnitude_in_std": 2.0}'), (1, 'spike_single', '{"contamination": 0.1, "magnitude_in_std": 4.0}'), (2, 'sign_flip', '{}')) v(j, scenario, overrides)),
nz AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.1)) v(k, noise_std)), sd AS (SELECT * FROM (VALUES (0, 42), (1, 7)) v(l, seed))
SELECT CAST(i * 12 + j * 4 + k * 2 + l AS INT) AS unit_id, dataset, scenario, overrides, noise_std, seed FROM ds, sc, nz, sd""")
def _(spark, d):
    names = sorted(r[0] for r in table(spark, d, "orders").select("o_orderstatus").distinct().collect())
    return study.unit_frame(spark, {
        "datasets": [{"path": f"{n}.csv", "label": n} for n in names], "seeds": [42, 7], "noise_std": [0.0, 0.1],
        "scenarios": [{"id": "spike_single", "grid": {"contamination": [0.1], "magnitude_in_std": [2.0, 4.0]}}, "sign_flip"]})


@query("b4_single_study_layout", f"""
SELECT scenario, score_source, seed, rows, round(f1, 8) AS f1, roc_auc, pr_auc, best_percentile FROM {RUNS_SQL}""")
def _(spark, d):
    r = runs(spark, d)
    filled = r.withColumns({c: F.lit(0.0) for c in ("precision", "recall", "best_precision", "best_recall", "threshold")})
    filled = filled.withColumns({c: F.lit(0) for c in ("injected_count", "detected_count")})
    return out(study.single_layout(filled).select("scenario", "score_source", "seed", "rows", "f1", "roc_auc", "pr_auc", "best_percentile"), f1=8)


@query("b5_parameter_signature", """
SELECT DISTINCT o_orderstatus AS st, '{"noise_std": 0.1, "params": {"contamination": 0.2, "status": "' || o_orderstatus || '"}, "scenario": "sign_flip"}' AS signature FROM orders""")
def _(spark, d):
    found = [r[0] for r in table(spark, d, "orders").select("o_orderstatus").distinct().collect()]
    return spark.createDataFrame([(s, study.params_signature("sign_flip", {"status": s, "contamination": 0.2}, 0.1)) for s in found], "st string, signature string")


GAPS_SQL = f"(SELECT dataset, f1 AS train_f1, roc_auc AS test_f1, f1 - roc_auc AS f1_gap_train_minus_test FROM {RUNS_SQL})"
CLASS_SQL = """CASE WHEN {g} >= 0.20 THEN 'strong_overfitting_signal' WHEN {g} >= 0.10 THEN 'possible_overfitting_signal'
  WHEN {g} <= -0.10 THEN 'test_higher_than_train_check_split_variance' ELSE 'no_strong_overfitting_signal' END"""


def gaps(spark, d):
    return runs(spark, d).select("dataset", F.col("f1").alias("train_f1"), F.col("roc_auc").alias("test_f1"), (F.col("f1") - F.col("roc_auc")).alias("f1_gap_train_minus_test"))


@query("b9_gap_class", f"SELECT round(f1_gap_train_minus_test, 8) AS gap, {CLASS_SQL.format(g='f1_gap_train_minus_test')} AS interpretation FROM {GAPS_SQL}")
def _(spark, d):
    return out(gaps(spark, d).select(F.col("f1_gap_train_minus_test").alias("gap"), study.gap_class(F.col("f1_gap_train_minus_test")).alias("interpretation")), gap=8)


@query("b10_stability_summary", f"""
SELECT round(avg(train_f1), 6) AS train_f1_mean, round(avg(test_f1), 6) AS test_f1_mean, round(avg(f1_gap_train_minus_test), 6) AS f1_gap_mean,
  round(stddev_pop(f1_gap_train_minus_test), 6) AS f1_gap_std, {CLASS_SQL.format(g='avg(f1_gap_train_minus_test)')} AS overall_interpretation FROM {GAPS_SQL}""")
def _(spark, d):
    return study.stability_summary(gaps(spark, d))


@query("b11_threshold_risk", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'unknown' WHEN event_type = 'click' THEN 'synthetic' WHEN user_id % 3 = 0 THEN 'low' WHEN user_id % 3 = 1 THEN 'medium' ELSE 'unknown' END AS level FROM events""")
def _(spark, d):
    m = F.col("user_id") % 3
    method = F.when(m == 0, "holdout_validated_best_f1_on_labels").when(m == 1, "best_f1_on_labels").otherwise("fixed_percentile")
    origin = F.when(F.col("event_type") == "click", "synthetic_injection_for_unlabeled_upload").otherwise("label_column")
    return table(spark, d, "events").select("event_id", study.risk_level(method, origin, F.col("event_type") != "view").alias("level"))


@query("m1_profile_vector", """
SELECT 'rows' AS part, round(log10(count(*)), 6) AS value FROM part UNION ALL SELECT 'columns', round(log10(2), 6) UNION ALL SELECT 'missing', 0.0
UNION ALL SELECT 'zeros', 0.0 UNION ALL SELECT 'correlation', round(abs(corr(p_size, p_retailprice)), 6) FROM part UNION ALL SELECT 'high_pairs', 0.0""")
def _(spark, d):
    v = meta.profile_vector(analyze(table(spark, d, "part"), ["p_size", "p_retailprice"]))
    return out(spark.createDataFrame(list(zip(["rows", "columns", "missing", "zeros", "correlation", "high_pairs"], v)), "part string, value double"))


STATS = ", ".join(f"{p} AS {n}" for n, p in {
    "present": "1.0::DOUBLE", "mean": "round(any_value(m), 6)", "std": "round(any_value(sd), 6)", "p50": "round(any_value(q[2]), 6)", "p90": "round(any_value(q[4]), 6)",
    "p95": "round(any_value(q[5]), 6)", "p99": "round(any_value(q[6]), 6)", "max": "round(any_value(mx), 6)", "iqr": "round(any_value(q[3] - q[1]), 6)",
    "tail": "round(any_value(mx - q[6]), 6)", "top_gap": "round(avg(s) FILTER (WHERE r <= top) - avg(s) FILTER (WHERE r > top), 6)", "skew": "round(avg(pow(s - m, 3)) / pow(any_value(sd), 3), 6)"}.items())


@query("m2_score_statistics", f"WITH s AS (SELECT * FROM {SCORES_SQL}) " + " UNION ALL ".join(f"""
SELECT '{c}' AS score_source, {STATS} FROM (SELECT {c} AS s, row_number() OVER (ORDER BY {c} DESC) AS r, avg({c}) OVER () AS m, stddev_pop({c}) OVER () AS sd, max({c}) OVER () AS mx,
  ceil(count(*) OVER () * 0.01) AS top, (SELECT quantile_cont({c}, [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) FROM s) AS q FROM s)""" for c in SOURCES))
def _(spark, d):
    stats = meta.score_statistics(scores(spark, d), SOURCES)
    schema = "score_source string, " + ", ".join(f"{n} double" for n in meta.STAT_NAMES)
    return out(spark.createDataFrame([(s, *map(float, v)) for s, v in stats.items()], schema))


def priority_profiles(spark, d):
    """One profile per order priority, taken from its orders."""
    o = table(spark, d, "orders")
    rows = o.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("o_custkey") % 2).cast("double")).alias("z"), F.min_by("o_orderstatus", "o_totalprice").alias("s")).collect()
    source = {"F": "ensemble", "O": "iforest", "P": "lof"}
    return [{"dataset": r[0], "sample_count": r[1], "feature_count": 3, "missing_rate": 0.0, "sparsity_zero_rate": r[2], "correlation_abs_mean": 0.1,
             "high_corr_pair_count": 0, "selected_source": source[r[3]], "expected_contamination": 0.05} for r in sorted(rows)]


@query("m4_nearest_profile_choice", """
WITH o AS (SELECT o_orderpriority AS p, log10(count(*)) AS n, avg(o_custkey % 2) AS z, CASE arg_min(o_orderstatus, o_totalprice) WHEN 'F' THEN 'ensemble' WHEN 'O' THEN 'iforest' ELSE 'lof' END AS s FROM orders GROUP BY 1),
me AS (SELECT log10(count(*)) AS n FROM customer), d AS (SELECT p, s, sqrt(pow(o.n - me.n, 2) + pow(log10(3) - log10(2), 2) + pow(z - 0.25, 2) + pow(0.1 - 0.2, 2)) AS dist FROM o, me)
SELECT s AS selected_source, p AS matched_dataset, round(dist, 6) AS distance FROM d ORDER BY dist, p LIMIT 1""")
def _(spark, d):
    own = {"samples": table(spark, d, "customer").count(), "features": 2, "missing_rate": 0.0, "sparsity_zero_rate": 0.25, "correlation_abs_mean": 0.2, "high_corr_pair_count": 0}
    c = meta.nearest_choice(own, priority_profiles(spark, d), ["ensemble", "iforest", "lof"])
    return out(spark.createDataFrame([(c["selected_source"], c["matched_dataset"], float(c["distance"]))], "selected_source string, matched_dataset string, distance double"))


def learned_profiles(spark, d):
    """Profiles whose vectors come from the orders of each priority."""
    out_rows = []
    for p in priority_profiles(spark, d):
        own = table(spark, d, "orders").filter(F.col("o_orderpriority") == p["dataset"]).select((F.col("o_totalprice") / 500000).alias("ensemble"), ((F.col("o_custkey") % 100) / 100).alias("iforest"))
        stats = meta.score_statistics(own, ["ensemble", "iforest"])
        allowed = ["ensemble", "iforest", "lof"]
        out_rows.append({**p, "allowed_sources": allowed, "feature_vector": meta.feature_vector(p, stats, allowed)})
    return out_rows


@query("m3_feature_vector")
def _(spark, d):
    rows = [(p["dataset"], p["feature_vector"]) for p in learned_profiles(spark, d)]
    return spark.createDataFrame(rows, "dataset string, feature_vector array<double>")


@query("m5_learned_choice")
def _(spark, d):
    profiles = learned_profiles(spark, d)
    own = analyze(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"])
    stats = meta.score_statistics(scores(spark, d).withColumnRenamed("iforest", "ensemble"), ["ensemble"])
    c = meta.learned_choice(spark, own, stats, profiles, ["ensemble", "iforest", "lof"])
    return spark.createDataFrame([(c["selected_source"], c.get("matched_dataset"), str(c.get("selector_mode")))], "selected_source string, matched_dataset string, mode string")


@query("k7_class_ranking")
def _(spark, d):
    profiles = learned_profiles(spark, d)
    ranking = meta.class_ranking(spark, profiles, profiles[0]["feature_vector"])
    return out(spark.createDataFrame(ranking, "score_source string, probability double"))


@query("m8_weight_search")
def _(spark, d):
    s = scores(spark, d).join(table(spark, d, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("y")), "event_id")
    from oddrows.operators.ensemble import normalize
    n = normalize(s, SOURCES, suffix="")
    weights, best = meta.search_weights(n, "y", SOURCES)
    return out(spark.createDataFrame([(k, v, best) for k, v in weights.items()], "score_source string, weight double, roc_auc double"))


# Whole runs. Given parameters keep the search out of the studies; the search itself runs in t13.
GIVEN = {"iforest": {"n_estimators": 60, "max_samples": 0.8}, "ocsvm": {"nu": 0.1}, "lof": {"k": 15}, "knn_distance": {"k": 10}}


def customers(spark, d):
    """Customers with a few numeric features and a derived label of about 8%."""
    c = table(spark, d, "customer")
    return c.select(
        "c_custkey", "c_acctbal", (F.col("c_acctbal") * F.col("c_acctbal") / 1000 + F.col("c_nationkey")).alias("c_power"), F.col("c_nationkey").cast("double").alias("c_place"),
        (F.col("c_acctbal") > 9100).cast("int").alias("ground_truth"))


@query("t13_full_detection", "SELECT count(*)::BIGINT AS total_samples FROM customer")
def _(spark, d):
    from oddrows.plans.detect import detect
    found = detect(customers(spark, d), ["c_custkey"], label="ground_truth")
    return found.report().select("total_samples")


@query("t12_run_report")
def _(spark, d):
    from oddrows.plans.detect import detect
    found = detect(customers(spark, d), ["c_custkey"], label="ground_truth", detectors=["iforest", "ocsvm"], params=GIVEN, threshold_strategy="top_k", top_k=30)
    return out(found.report())


@query("p16_result_columns")
def _(spark, d):
    from oddrows.plans.detect import detect
    df = customers(spark, d).withColumnRenamed("ground_truth", "is_anomaly")
    found = detect(df, ["c_custkey"], label="is_anomaly", detectors=["iforest"], params=GIVEN)
    return out(found.result)


@query("t11_source_choice_on_labels", f"""
WITH sc AS (SELECT *, iforest / 500 AS ensemble, CAST(iforest + temporal_change > 230 AS INT) AS y FROM {SCORES_SQL}),
c AS (SELECT y, count(*) AS m, sum(count(*)) OVER () AS n FROM sc GROUP BY y),
e AS (SELECT *, ceil(n * 0.35) AS total, m * ceil(n * 0.35) / n AS exact FROM c),
f AS (SELECT *, floor(exact) AS low, row_number() OVER (ORDER BY floor(exact) - exact, CAST(y AS VARCHAR)) AS r, sum(floor(exact)) OVER () AS given FROM e),
t AS (SELECT y, least(greatest(1, low + CASE WHEN r <= total - given THEN 1 ELSE 0 END), m - 1) AS take FROM f),
split AS (SELECT sc.*, row_number() OVER (PARTITION BY sc.y ORDER BY {sql_hash(42, 'event_id')}) <= take AS test FROM sc JOIN t USING (y)),
long AS ({" UNION ALL ".join(f"SELECT {i} AS place, '{s}' AS src, {s} AS s, y, test FROM split" for i, s in enumerate(["ensemble", *SOURCES]))}),
cuts AS (SELECT test, src, unnest(list_append(range(70, 91), 95)) AS p, unnest(q) AS cut FROM (
  SELECT test, src, quantile_cont(s, {[p / 100 for p in (*range(70, 91), 95)]}) AS q FROM long GROUP BY ALL)),
tally AS (SELECT test, place, src, p, count(*) FILTER (s > cut AND y = 1) AS tp, count(*) FILTER (s > cut AND y = 0) AS fp, count(*) FILTER (s <= cut AND y = 1) AS fn
  FROM long JOIN cuts USING (test, src) GROUP BY ALL),
scored AS (SELECT *, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM tally),
calibrated AS (SELECT src, coalesce(arg_min(p, (-f1, p)) FILTER (f1 > 0 AND p < 95), 95) AS p FROM scored WHERE NOT test GROUP BY src)
SELECT src AS source, 'holdout_validated_best_f1_on_labels' AS method, CAST(p AS DOUBLE) AS percentile, round(f1, 6) AS f1
FROM scored JOIN calibrated USING (src, p) WHERE test ORDER BY scored.f1 DESC, place LIMIT 1""")
def _(spark, d):
    from oddrows.operators.ensemble import normalize
    from oddrows.plans.detect import choose_on_labels
    s = scores(spark, d).withColumn("ensemble", F.col("iforest") / 500).withColumn("y", (F.col("iforest") + F.col("temporal_change") > 230).cast("int"))
    n = normalize(s, ["ensemble", *SOURCES])
    best, entry = choose_on_labels(n, ["event_id"], "y", ["ensemble", *SOURCES], n.count())
    return out(spark.createDataFrame([(best, entry["method"], float(entry["percentile"]), float(entry["f1"]))], "source string, method string, percentile double, f1 double"))


@query("t14_scoring_request")
def _(spark, d):
    from oddrows.plans.detect import analyze_table
    _, evaluation, _ = analyze_table(customers(spark, d), ["c_custkey"], detectors=["iforest", "lof", "knn_distance"], params=GIVEN)
    return out(evaluation)


@query("b2_unit_run")
def _(spark, d):
    spec = study.DatasetSpec("customer", None, ("c_custkey",))
    df = customers(spark, d).drop("ground_truth")
    unit = study.Unit(spec, "joint_shift", {"contamination": 0.05}, 0.05, 7)
    rows = study.run_unit(spark, unit, df, ["c_custkey"], ["c_custkey"], detectors=["iforest", "ocsvm"], params=GIVEN)
    return spark.createDataFrame(rows, study.RUN_SCHEMA)


@query("b3_study_run")
def _(spark, d):
    config = {"datasets": [{"source": customers(spark, d), "label": "customer", "key": ["c_custkey"], "drop_columns": ["ground_truth"]}],
              "seeds": [42], "scenarios": ["spike_single", "dead_sensor"]}
    return study.run_study(spark, config, detectors=["iforest"], params=GIVEN)["aggregated"]


@query("b6_labelled_study")
def _(spark, d):
    spec = study.DatasetSpec("customer", customers(spark, d), ("c_custkey",), label_column="ground_truth")
    return study.run_labelled_study(spark, [spec], scenario="joint_shift", detectors=["iforest"], params=GIVEN)["consistency"]


@query("b8_stability_study")
def _(spark, d):
    return study.run_stability(spark, customers(spark, d), ["c_custkey"], "ground_truth", dataset="customer", detectors=["iforest"], params=GIVEN)["splits"]


def lodo_inputs(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"), (F.col("p_size") > 47).cast("int").alias("ground_truth"))
    specs = [
        study.DatasetSpec("customer", customers(spark, d), ("c_custkey",)),
        study.DatasetSpec("part", part, ("p_partkey",)),
        study.DatasetSpec("supplier", table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("n"), (F.col("s_acctbal") > 9000).cast("int").alias("ground_truth")), ("s_suppkey",)),
    ]
    return specs


@query("m7_leave_one_dataset_out")
def _(spark, d):
    """Winners come from the runs on the other data sets."""
    return study.leave_one_out(spark, lodo_inputs(spark, d), detectors=["iforest", "lof"], params=GIVEN)


@query("m6_profile_builder")
def _(spark, d):
    from oddrows.plans.detect import detect
    found = {s.label: detect(s.source, list(s.key), label="ground_truth", detectors=["iforest", "ocsvm"], params=GIVEN) for s in lodo_inputs(spark, d)}
    made = study.dataset_profiles(spark, found, study.measured_summary(spark, found))
    return spark.createDataFrame([(p["dataset"], p["sample_count"], p["feature_count"], p["selected_source"], p["feature_vector"]) for p in made],
                                 "dataset string, sample_count long, feature_count int, selected_source string, feature_vector array<double>")
