"""Preprocessing, domain detectors, ensemble, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import out, query, stacked, table
from checks.explore import HOLES_SQL, holes
from oddrows.detectors import domain
from oddrows.operators import ensemble, preprocess, sampling, thresholds
from oddrows.operators.ranks import quantiles

PART = ["p_size", "p_retailprice"]


@query("r1_median_imputation", f"""
SELECT event_id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM {HOLES_SQL})), 6) AS v,
  round(coalesce(u, (SELECT quantile_cont(u, 0.5) FROM {HOLES_SQL})), 6) AS u FROM {HOLES_SQL}""")
def _(spark, d):
    return out(preprocess.imputed(holes(spark, d), ["v", "u"]))


def scaled_sql(center: str, spread: str) -> str:
    cols = ", ".join(
        f"round(({c} - {center.format(c=c)}) / (SELECT CASE WHEN {spread.format(c=c)} = 0 THEN 1 ELSE {spread.format(c=c)} END FROM part), 6) + 0.0 AS {c}"
        for c in PART
    )
    return f"SELECT p_partkey, {cols} FROM part"


@query("r2_robust_scaling", scaled_sql("(SELECT quantile_cont({c}, 0.5) FROM part)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def _(spark, d):
    return out(preprocess.scaled(table(spark, d, "part").select("p_partkey", *PART), PART, "robust"))


@query("r3_standard_scaling", scaled_sql("(SELECT avg({c}) FROM part)", "stddev_pop({c})"))
def _(spark, d):
    return out(preprocess.scaled(table(spark, d, "part").select("p_partkey", *PART), PART, "standard"))


def vectors(spark, d, size: int = 64):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(size)])


@query("r4_pca_95_percent")
def _(spark, d):
    p = preprocess.preprocess(vectors(spark, d), ["vec_id"], pca_policy="auto")
    return out(p.df)


@query("r5_preprocess_record", """
SELECT 'robust' AS scaler_policy, 'auto' AS pca_policy, false AS pca_used, 'p_size,p_retailprice' AS feature_columns, count(*)::BIGINT AS rows FROM part""")
def _(spark, d):
    p = preprocess.preprocess(table(spark, d, "part"), ["p_partkey"])
    i = p.info
    return p.df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(i["scaler_policy"]).alias("scaler_policy"), F.lit(i["pca_policy"]).alias("pca_policy"), F.lit(i["pca_used"]).alias("pca_used"),
        F.lit(",".join(i["feature_columns"])).alias("feature_columns"), "rows")


@query("r6_domain_matrix", """
WITH x AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE ELSE value END AS v FROM events)
SELECT event_id, round(CASE WHEN v IS NULL OR isinf(v) THEN (SELECT quantile_cont(v, 0.5) FROM x WHERE NOT isinf(v)) ELSE v END, 6) AS v FROM x""")
def _(spark, d):
    e = table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("v"))
    x = preprocess.domain_matrix(e, ["v"])
    return out(e.select("event_id", x["v"].alias("v")))


# Events with two numeric columns in time order.
EV_SQL = "(SELECT event_id, ts, value AS a, CAST(user_id AS DOUBLE) AS b FROM events)"


def ev(spark, d):
    return table(spark, d, "events").select("event_id", "ts", F.col("value").alias("a"), F.col("user_id").cast("double").alias("b"))


def robust_sql(name: str, source: str, cols: list[str]) -> str:
    """SQL: <name>_c(column, med, scale) by median, MAD and deviation."""
    parts = stacked(source, cols)
    return f"""{name}_u AS ({parts}), {name}_m AS (SELECT "column", quantile_cont(v, 0.5) AS med, stddev_pop(v) AS sd FROM {name}_u GROUP BY 1),
{name}_d AS (SELECT "column", quantile_cont(abs(v - med), 0.5) AS mad FROM {name}_u JOIN {name}_m USING ("column") GROUP BY 1),
{name}_c AS (SELECT "column", med, CASE WHEN mad > 1e-8 THEN 1.4826 * mad WHEN sd > 1e-8 THEN sd ELSE 1 END AS scale FROM {name}_m JOIN {name}_d USING ("column"))"""


FLAT_SQL = f"""
WITH e AS (SELECT * FROM {EV_SQL}), {robust_sql('f', 'e', ['a', 'b'])},
x AS (SELECT event_id, 'a' AS "column", a AS v, count(*) OVER (PARTITION BY round(a, 10)) AS n FROM e UNION ALL
  SELECT event_id, 'b', b, count(*) OVER (PARTITION BY round(b, 10)) FROM e),
z AS (SELECT event_id, abs((v - med) / scale) AS z, (n - 1) * 1.0 / ((SELECT count(*) FROM e) - 1) AS rep FROM x JOIN f_c USING ("column")),
flat AS (SELECT event_id, 0.65 * avg(exp(-6 * z)) + 0.25 * avg(CASE WHEN z <= 0.08 THEN 1.0 ELSE 0.0 END) + 0.10 * avg(rep) AS flatline FROM z GROUP BY 1)"""

CHANGE_SQL = f"""
c AS (SELECT event_id, greatest(coalesce(abs(a - lag(a) OVER w), 0), coalesce(abs(lead(a) OVER w - a), 0)) AS a,
  greatest(coalesce(abs(b - lag(b) OVER w), 0), coalesce(abs(lead(b) OVER w - b), 0)) AS b FROM e WINDOW w AS (ORDER BY ts, event_id)),
{robust_sql('t', 'c', ['a', 'b'])},
change AS (SELECT event_id, (a / (SELECT scale FROM t_c WHERE "column" = 'a') + b / (SELECT scale FROM t_c WHERE "column" = 'b')) / 2 AS temporal_change FROM c)"""


def freeze_sql(source: str, cols: list[str]) -> str:
    per = []
    for c in cols:
        per.append(f"""SELECT event_id, '{c}' AS "column", abs({c} - lag({c}) OVER (ORDER BY ts, event_id)) AS d, ts FROM {source}""")
    return f"""
fd AS ({' UNION ALL '.join(per)}),
fs AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, stddev_pop({c}) AS sd FROM {source}" for c in cols)}),
fe AS (SELECT "column", greatest(CASE WHEN quantile_cont(d, 0.5) > 1e-8 THEN quantile_cont(d, 0.5) * 0.05 ELSE any_value(sd) * 0.01 END, 1e-8) AS eps
  FROM fd JOIN fs ON fs.col = fd."column" GROUP BY 1),
ff AS (SELECT event_id, ts, "column", CASE WHEN d <= eps THEN 1.0 ELSE 0.0 END AS f FROM fd JOIN fe USING ("column")),
fi AS (SELECT *, sum(1 - f) OVER (PARTITION BY "column" ORDER BY ts, event_id) AS island,
  avg(f) OVER (PARTITION BY "column" ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS roll FROM ff),
fr AS (SELECT *, sum(f) OVER (PARTITION BY "column", island ORDER BY ts, event_id) AS streak FROM fi),
freezing AS (SELECT event_id, 0.45 * avg(roll) + 0.35 * least(max(streak) / 4.0, 1) + 0.20 * avg(CASE WHEN roll >= 0.75 THEN 1.0 ELSE 0.0 END) AS fz FROM fr GROUP BY 1)"""


@query("d7_flatline", FLAT_SQL + " SELECT event_id, round(flatline, 6) AS flatline FROM flat")
def _(spark, d):
    return out(domain.flatline(ev(spark, d), ["a", "b"]).select("event_id", "flatline"))


@query("d8_temporal_change", f"WITH e AS (SELECT * FROM {EV_SQL}), {CHANGE_SQL} SELECT event_id, round(temporal_change, 6) AS temporal_change FROM change")
def _(spark, d):
    return out(domain.temporal_change(ev(spark, d), ["a", "b"], ["ts"], ["event_id"]).select("event_id", "temporal_change"))


# Slow steps so that runs of nearly equal values occur.
STEP_SQL = "(SELECT event_id, ts, floor(event_id / 6) * 3.0 + CASE WHEN event_id % 17 = 0 THEN 5 ELSE 0 END AS a, round(value / 40) AS b FROM events)"


def steps(spark, d):
    return table(spark, d, "events").select(
        "event_id", "ts", (F.floor(F.col("event_id") / 6) * 3.0 + F.when(F.col("event_id") % 17 == 0, 5).otherwise(0)).alias("a"),
        F.round(F.col("value") / 40).alias("b"))


@query("d9_freeze", f"WITH e AS (SELECT * FROM {STEP_SQL}), {freeze_sql('e', ['a', 'b'])} SELECT event_id, round(fz, 6) AS \"freeze\" FROM freezing")
def _(spark, d):
    return out(domain.freeze(steps(spark, d), ["a", "b"], ["ts"], ["event_id"]).select("event_id", "freeze"))


@query("d10_domain_scores", f"""{FLAT_SQL}, {CHANGE_SQL}, {freeze_sql('e', ['a', 'b'])}
SELECT event_id, round(flatline, 6) AS flatline, round(temporal_change, 6) AS temporal_change, round(fz, 6) AS "freeze"
FROM flat JOIN change USING (event_id) JOIN freezing USING (event_id)""")
def _(spark, d):
    return out(domain.domain_scores(ev(spark, d), ["a", "b"], ["ts"], ["event_id"]).select("event_id", "flatline", "temporal_change", "freeze"))


NORM_SQL = """CASE WHEN {hi} - {lo} < 1e-8 THEN 0 ELSE (least(greatest({v}, {lo}), {hi}) - {lo}) / ({hi} - {lo}) END"""


def norm_sql(name: str, source: str, col: str, key: str) -> str:
    """SQL: <name>(key, n) normalised score."""
    return f"""{name}_q AS (SELECT quantile_cont({col}, 0.01) AS p1, quantile_cont({col}, 0.99) AS p99, min({col}) AS mn, max({col}) AS mx FROM {source}),
{name} AS (SELECT {key}, {NORM_SQL.format(v=col, lo='(CASE WHEN p99 > p1 THEN p1 ELSE mn END)', hi='(CASE WHEN p99 > p1 THEN p99 ELSE mx END)')} AS n FROM {source}, {name}_q)"""


@query("t1_score_normalisation", f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 101 = 0 THEN 0 WHEN event_id % 97 = 0 THEN (SELECT max(value) FROM events WHERE event_id % 101 <> 0 AND event_id % 97 <> 0) ELSE value END AS v FROM events),
{norm_sql('a', 'e', 'v', 'event_id')} SELECT event_id, round(n, 6) AS score FROM a""")
def _(spark, d):
    e = table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 101 == 0, F.lit(float("nan"))).when(F.col("event_id") % 97 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("v"))
    return out(ensemble.normalize(e, ["v"]).select("event_id", F.col("v__norm").alias("score")))


SOURCES = ["iforest", "lof", "flatline", "temporal_change"]
SCORES_SQL = "(SELECT event_id, value AS iforest, ln(1 + value) AS lof, exp(-value / 50) AS flatline, CAST(user_id AS DOUBLE) AS temporal_change FROM events)"


def scores(spark, d):
    """Stand-in score columns derived from the events."""
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", v.alias("iforest"), F.log(1 + v).alias("lof"), F.exp(-v / 50).alias("flatline"), F.col("user_id").cast("double").alias("temporal_change"))


BASE = {"iforest": 0.45, "lof": 0.45, "flatline": 0.65, "temporal_change": 0.06}
WEIGHT_SQL = f"""WITH s AS (SELECT * FROM {SCORES_SQL}), {', '.join(norm_sql(c, 's', c, 'event_id') for c in SOURCES)},
w AS ({' UNION ALL '.join(f"SELECT '{c}' AS src, {BASE[c]} * greatest(0.05, var_pop(n)) * {1.0 if c == 'flatline' else 0.55} AS w FROM {c}" for c in SOURCES)})"""


@query("t2_ensemble_weights", WEIGHT_SQL + " SELECT src AS score_source, round(w / (SELECT sum(w) FROM w), 6) AS weight FROM w")
def _(spark, d):
    _, w = ensemble.combine(scores(spark, d), SOURCES)
    return out(spark.createDataFrame(list(w.items()), "score_source string, weight double"))


@query("t3_weighted_combination", WEIGHT_SQL + f""", v AS (SELECT src, w / (SELECT sum(w) FROM w) AS w FROM w)
SELECT event_id, round({' + '.join(f"{c}.n * (SELECT w FROM v WHERE src = '{c}')" for c in SOURCES)}, 6) AS ensemble FROM iforest
{' '.join(f'JOIN {c} USING (event_id)' for c in SOURCES[1:])}""")
def _(spark, d):
    df, _ = ensemble.combine(scores(spark, d), SOURCES)
    return out(df.select("event_id", "ensemble"))


@query("t4_ensemble_gates", f"""
WITH s AS (SELECT flatline, temporal_change, iforest / 400 AS fz FROM {SCORES_SQL})
SELECT 'flatline' AS gate, (SELECT list_sort(list(flatline), 'DESC')[2] FROM s) >= 0.80 AS open
UNION ALL SELECT 'temporal_change', (SELECT count(*) FROM s) >= 12 UNION ALL SELECT 'freeze', (SELECT quantile_cont(fz, 0.95) FROM s) >= 0.35""")
def _(spark, d):
    s = scores(spark, d).withColumn("freeze", F.col("iforest") / 400)
    opened = ensemble.open_gates(s, s.count())
    return spark.createDataFrame([(g, g in opened) for g in ("flatline", "temporal_change", "freeze")], "gate string, open boolean")


def cut_frame(spark, rows):
    return out(spark.createDataFrame(rows, "strategy string, threshold double"))


@query("t5_threshold_percentile_and_deviation", """
SELECT 'percentile' AS strategy, round(quantile_cont(value, 0.95), 6) AS threshold FROM events UNION ALL
SELECT 'mean_std', round(avg(value) + 2 * stddev_pop(value), 6) FROM events UNION ALL SELECT 'other', round(avg(value) + 1.5 * stddev_pop(value), 6) FROM events""")
def _(spark, d):
    e = table(spark, d, "events")
    return cut_frame(spark, [
        ("percentile", thresholds.threshold(e, "value", "percentile")),
        ("mean_std", thresholds.threshold(e, "value", "mean_std", std_multiplier=2.0)),
        ("other", thresholds.threshold(e, "value", "other"))])


@query("t6_threshold_contamination_and_top_k", """
SELECT event_id, CAST(value >= (SELECT quantile_cont(value, 0.97) FROM events) AS INT) AS by_share,
  CAST(value >= (SELECT min(value) FROM (SELECT value FROM events ORDER BY value DESC LIMIT 25)) AS INT) AS by_count FROM events""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    share = thresholds.threshold(e, "value", "expected_contamination", expected_contamination=0.03)
    count = thresholds.threshold(e, "value", "top_k", top_k=25)
    return thresholds.flag(thresholds.flag(e, "value", share, "by_share"), "value", count, "by_count").drop("value")


GAP_SQL = """
SELECT '{name}' AS strategy, round((SELECT CASE WHEN max(gap) >= 0.08 THEN arg_max(mid, gap) ELSE (SELECT quantile_cont(s, 0.95) FROM {t}) END FROM (
  SELECT (s - prev) / (mx - mn) AS gap, (s + prev) / 2 AS mid FROM (SELECT s, lag(s) OVER (ORDER BY s) AS prev, row_number() OVER (ORDER BY s DESC) AS above,
  (SELECT count(*) FROM {t}) AS n, (SELECT max(s) FROM {t}) AS mx, (SELECT min(s) FROM {t}) AS mn FROM {t})
  WHERE above <= greatest(1, least(ceil(n * 0.20), n - 1)))), 6) AS threshold"""


@query("t7_threshold_adaptive_gap", f"""
WITH a AS (SELECT value AS s FROM events), b AS (SELECT CASE WHEN value > 200 THEN value + 300 ELSE value END AS s FROM events)
{GAP_SQL.format(name='no_gap', t='a')} UNION ALL {GAP_SQL.format(name='gap', t='b')}""")
def _(spark, d):
    e = table(spark, d, "events").select("value", F.when(F.col("value") > 200, F.col("value") + 300).otherwise(F.col("value")).alias("apart"))
    return cut_frame(spark, [("no_gap", thresholds.threshold(e, "value")), ("gap", thresholds.threshold(e, "apart"))])


@query("t8_flagging", "SELECT event_id, CAST(value > 120.5 AS INT) AS is_anomaly FROM events")
def _(spark, d):
    return thresholds.flag(table(spark, d, "events").select("event_id", "value"), "value", 120.5).drop("value")


MINIMUM_SQL = f"""WITH e AS (SELECT event_id, ts, value AS a FROM events),
c AS (SELECT event_id, greatest(coalesce(abs(a - lag(a) OVER w), 0), coalesce(abs(lead(a) OVER w - a), 0)) AS a FROM e WINDOW w AS (ORDER BY ts, event_id)),
{robust_sql('t', 'c', ['a'])}, change AS (SELECT event_id, a / (SELECT scale FROM t_c) AS s FROM c),
{norm_sql('z', 'change', 's', 'event_id')}"""


@query("flagship_time_anomalies", MINIMUM_SQL + """
SELECT event_id, round(n, 6) AS anomaly_score, CAST(n > (SELECT quantile_cont(n, 0.95) FROM z) AS INT) AS is_anomaly FROM z""")
def time_anomalies(spark, d):
    """Which events are anomalous in time? Change score, normalised, cut at the 95th percentile."""
    e = table(spark, d, "events").select("event_id", "ts", "value")
    s = domain.temporal_change(e, ["value"], ["ts"], ["event_id"])
    s = ensemble.normalize(s, ["temporal_change"]).select("event_id", F.col("temporal_change__norm").alias("anomaly_score"))
    flagged = thresholds.flag(s, "anomaly_score", quantiles(s, ["anomaly_score"], [0.95])["anomaly_score"][0])
    return out(flagged)


@query("flagship_top_time_anomalies", MINIMUM_SQL + """
SELECT event_id, round(s, 6) AS temporal_change, (row_number() OVER (ORDER BY s DESC, event_id))::INT AS rank FROM change ORDER BY s DESC, event_id LIMIT 10""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "value")
    s = domain.temporal_change(e, ["value"], ["ts"], ["event_id"]).select("event_id", "temporal_change")
    return out(sampling.top_rows(s, "temporal_change", ["event_id"], 10))
