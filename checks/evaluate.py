"""Metrics, best percentiles and evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import out, query, table
from oddrows.operators import metrics

# Labels that depend on the score with noise: expensive urgent orders are positive.
Y_SQL = """(SELECT o_orderkey, o_totalprice AS s, round(o_totalprice, -4) AS coarse,
  CAST(o_totalprice + (o_custkey % 97) * 2000 > 420000 AS INT) AS y, CAST(o_totalprice > 400000 AS INT) AS p, o_orderstatus AS src FROM orders)"""


def labelled(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", price.alias("s"), F.round(price, -4).alias("coarse"),
        (price + (F.col("o_custkey") % 97) * 2000 > 420000).cast("int").alias("y"),
        (price > 400000).cast("int").alias("p"), F.col("o_orderstatus").alias("src"))


COUNTS_SQL = f"""c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
  count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn FROM {Y_SQL}),
m AS (SELECT *, tp * 1.0 / (tp + fp) AS precision, tp * 1.0 / (tp + fn) AS recall FROM c)"""


@query("e1_confusion_counts", f"WITH {COUNTS_SQL} SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn FROM c")
def _(spark, d):
    return metrics.confusion(labelled(spark, d), "y", "p").select("tp", "fp", "tn", "fn")


@query("e2_precision_recall_f1", f"""WITH {COUNTS_SQL}
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM m""")
def _(spark, d):
    return out(metrics.confusion(labelled(spark, d), "y", "p").select("precision", "recall", "f1"))


@query("e3_accuracy_specificity", f"""WITH {COUNTS_SQL}
SELECT round((tp + tn) * 1.0 / (tp + fp + tn + fn), 6) AS accuracy, round(tn * 1.0 / (tn + fp), 6) AS specificity FROM m""")
def _(spark, d):
    return out(metrics.confusion(labelled(spark, d), "y", "p").select("accuracy", "specificity"))


AUC_SQL = """SELECT '{c}' AS score_source, round((sum(CASE WHEN y = 1 THEN r END) - p * (p + 1) / 2.0) / (p * n), 6) AS roc_auc FROM (
  SELECT y, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r, sum(y) OVER () AS p, sum(1 - y) OVER () AS n FROM {t}) GROUP BY p, n"""

AP_SQL = """SELECT '{c}' AS score_source, round(sum(pos * 1.0 / p * tp / (tp + fp)), 6) AS pr_auc FROM (
  SELECT pos, sum(pos) OVER (ORDER BY {c} DESC) AS tp, sum(neg) OVER (ORDER BY {c} DESC) AS fp, sum(pos) OVER () AS p FROM (
    SELECT {c}, sum(y) AS pos, sum(1 - y) AS neg FROM {t} GROUP BY 1))"""


@query("e4_roc_auc", " UNION ALL ".join(AUC_SQL.format(c=c, t=Y_SQL) for c in ("s", "coarse")))
def _(spark, d):
    return out(metrics.ranking_metrics(labelled(spark, d), "y", ["s", "coarse"]).select("score_source", "roc_auc"))


@query("e5_average_precision", " UNION ALL ".join(AP_SQL.format(c=c, t=Y_SQL) for c in ("s", "coarse")))
def _(spark, d):
    return out(metrics.ranking_metrics(labelled(spark, d), "y", ["s", "coarse"]).select("score_source", "pr_auc"))


@query("e6_evaluation_report", f"""WITH {COUNTS_SQL}, a AS ({AUC_SQL.format(c='s', t=Y_SQL)}), b AS ({AP_SQL.format(c='s', t=Y_SQL)})
SELECT true AS available, (tp + fn)::BIGINT AS positive_label_count, (tn + fp)::BIGINT AS negative_label_count, (tp + fp)::BIGINT AS predicted_positive_count,
  tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(2 * precision * recall / (precision + recall), 6) AS f1, round((tp + tn) * 1.0 / (tp + fp + tn + fn), 6) AS accuracy,
  round(tn * 1.0 / (tn + fp), 6) AS specificity, roc_auc, pr_auc, 'label' AS label_provenance FROM m, a, b""")
def _(spark, d):
    return out(metrics.evaluation_report(labelled(spark, d), "y", "p", "s"))


def best_sql(score: str, low: int, high: int) -> str:
    """SQL: best percentile of one score by f1, the first of equals."""
    probs = ", ".join(str(p / 100.0) for p in range(low, high + 1))
    return f"""SELECT '{score}' AS score_source, CAST(p AS DOUBLE) AS percentile, round(t, 6) AS threshold, round(pr, 6) AS precision, round(rc, 6) AS recall,
  round(f1, 6) AS f1 FROM (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM (
    SELECT p, t, tp, CASE WHEN flagged > 0 THEN tp * 1.0 / flagged ELSE 0 END AS pr, tp * 1.0 / (SELECT sum(y) FROM {Y_SQL}) AS rc FROM (
      SELECT p, t, (SELECT count(*) FROM {Y_SQL} x WHERE x.{score} > q.t) AS flagged, (SELECT count(*) FROM {Y_SQL} x WHERE x.{score} > q.t AND y = 1) AS tp
      FROM (SELECT unnest(quantile_cont({score}, [{probs}])) AS t, unnest(range({low}, {high + 1})) AS p FROM {Y_SQL}) q))) ORDER BY f1 DESC, p LIMIT 1"""


@query("t9_best_percentile", f"SELECT * FROM ({best_sql('s', 50, 99)}) UNION ALL SELECT * FROM ({best_sql('coarse', 50, 99)})")
def _(spark, d):
    return out(metrics.best_percentile_frame(labelled(spark, d), "y", ["s", "coarse"]))


@query("e7_best_percentile_benchmark", f"SELECT score_source, percentile, f1 FROM ({best_sql('s', 50, 99)})")
def _(spark, d):
    return out(metrics.best_percentile_frame(labelled(spark, d), "y", ["s"], range(50, 100)).select("score_source", "percentile", "f1"))


@query("e8_best_percentile_diagnostic", f"SELECT score_source, percentile FROM ({best_sql('s', 70, 99)})")
def _(spark, d):
    return metrics.best_percentile_frame(labelled(spark, d), "y", ["s"], range(70, 100), start_f1=-1.0, digits=6).select("score_source", "percentile")


@query("t10_metrics_at_percentile", f"""
WITH q AS (SELECT quantile_cont(s, 0.85) AS t FROM {Y_SQL}), c AS (SELECT t, count(*) FILTER (WHERE s > t AND y = 1) AS tp, count(*) FILTER (WHERE s > t AND y = 0) AS fp,
  count(*) FILTER (WHERE s <= t AND y = 1) AS fn FROM {Y_SQL}, q GROUP BY t), m AS (SELECT t, tp * 1.0 / (tp + fp) AS pr, tp * 1.0 / (tp + fn) AS rc FROM c)
SELECT 85.0::DOUBLE AS percentile, round(t, 6) AS threshold, round(pr, 6) AS precision, round(rc, 6) AS recall, round(2 * pr * rc / (pr + rc), 6) AS f1 FROM m""")
def _(spark, d):
    m = metrics.percentile_metrics(labelled(spark, d), "y", "s", 85.0)
    names = ["percentile", "threshold", "precision", "recall", "f1"]
    return out(spark.createDataFrame([tuple(m[k] for k in names)], names))
