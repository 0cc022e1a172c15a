"""Ordered operators, joins, picks and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import block_sql, out, query, sql_hash, table
from oddrows.functions.hashing import hash52
from oddrows.operators import joins, ordered, sampling

TS = ["ts"]
ID = ["event_id"]


@query("w1_lag_lead_difference", """
SELECT event_id, round(coalesce(abs(value - lag(value) OVER w), 0), 6) AS change_prev, round(coalesce(abs(lead(value) OVER w - value), 0), 6) AS change_next
FROM events WINDOW w AS (ORDER BY ts, event_id)""")
def _(spark, d):
    s = ordered.shifted(table(spark, d, "events").select("event_id", "ts", "value"), ["value"], TS, ID)
    zero = F.lit(0.0)
    return out(s.select(
        "event_id", F.coalesce(F.abs(F.col("value") - F.col("value__prev")), zero).alias("change_prev"),
        F.coalesce(F.abs(F.col("value__next") - F.col("value")), zero).alias("change_next"),
    ))


@query("w1_lag_with_tied_order", """
SELECT event_id, round(lag(value) OVER (ORDER BY user_id % 3, event_id), 6) AS previous FROM events""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("g"), "value")
    return out(ordered.shifted(e, ["value"], ["g"], ID).select("event_id", F.col("value__prev").alias("previous")))


@query("w2_rolling_mean", """
SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM events""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "value")
    return out(ordered.rolling_mean(e, "value", TS, ID).select("event_id", "rolling_mean"))


@query("w3_streak_length", """
WITH x AS (SELECT event_id, ts, CASE WHEN value > 20 THEN 1 ELSE 0 END AS f FROM events),
y AS (SELECT *, sum(1 - f) OVER (ORDER BY ts, event_id) AS island FROM x)
SELECT event_id, (sum(f) OVER (PARTITION BY island ORDER BY ts, event_id))::BIGINT AS streak FROM y""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "value")
    return ordered.streak(e, F.col("value") > 20, TS, ID).select("event_id", "streak")


@query("w6_average_rank", """
SELECT DISTINCT o_totalprice AS value, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS avg_rank FROM orders""")
def _(spark, d):
    r = ordered.average_ranks(table(spark, d, "orders"), {"p": F.col("o_totalprice")})
    return r.select("value", F.col("avg_rank").cast("double").alias("avg_rank"))


@query("w9_seeded_pick", f"""
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {sql_hash(42, 'o_orderkey')}) AS r FROM orders)
WHERE r <= (SELECT ceil(count(*) * 0.1) FROM orders)""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return sampling.seeded_pick(o, ["o_orderkey"], sampling.injected_row_count(o.count(), 0.1), 42)


@query("w10_contiguous_blocks", f"""
SELECT event_id, ts, true AS picked FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) x
JOIN {block_sql('(SELECT count(*) FROM events)', '100', 3, 42)} r ON i >= b AND i < e""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return sampling.contiguous_blocks(e, TS, ID, 100, 3, 42).filter("picked")


@query("running_row_index", "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1)::BIGINT AS row_index FROM events")
def _(spark, d):
    return ordered.with_row_index(table(spark, d, "events").select("event_id", "ts"), TS, ID).select("event_id", "row_index")


@query("running_total", """
SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey), 2) AS total FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return out(ordered.running_sum(o, {"total": F.col("o_totalprice")}, ["o_orderdate"], ["o_orderkey"]).select("o_orderkey", "total"), 2)


@query("j1_value_count_lookup", """
SELECT event_id, (count(*) OVER (PARTITION BY round(value, 1)))::BIGINT AS value_count FROM events""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return joins.value_counts_joined(e, F.round("value", 1)).select("event_id", "value_count")


@query("j2_rows_in_rare_classes", """
SELECT p_partkey, p_size FROM part WHERE p_size IN (SELECT p_size FROM part GROUP BY 1 HAVING count(*) <= (
  SELECT quantile_cont(c, 0.25) FROM (SELECT count(*) AS c FROM part GROUP BY p_size)))""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    counts = p.groupBy("p_size").count()
    cut = counts.agg(F.percentile("count", F.lit(0.25)).alias("c")).first()["c"]
    return joins.rows_in_classes(p, "p_size", counts.filter(F.col("count") <= cut)).select("p_partkey", "p_size")


@query("j4_parameter_grid", """
SELECT m.m AS magnitude_in_std, c.c AS contamination, s.s AS seed FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus = 'F') f,
(VALUES (2.5::DOUBLE), (4.0)) m(m), (VALUES (0.05::DOUBLE), (0.1), (0.2)) c(c), (SELECT DISTINCT CAST(o_custkey % 5 AS INT) AS s FROM orders) s""")
def _(spark, d):
    seeds = [r[0] for r in table(spark, d, "orders").select((F.col("o_custkey") % 5).cast("int")).distinct().collect()]
    return joins.parameter_grid(spark, {"magnitude_in_std": [2.5, 4.0], "contamination": [0.05, 0.1, 0.2], "seed": seeds})


CUTS = ", ".join(str(p / 100.0) for p in range(50, 100))


@query("j5_thresholds_against_scores", f"""
WITH q AS (SELECT unnest(quantile_cont(value, [{CUTS}])) AS t, unnest(range(50, 100)) AS p FROM events)
SELECT CAST(p AS DOUBLE) AS percentile, round(t, 6) AS threshold, (SELECT count(*) FROM events e WHERE e.value > q.t)::BIGINT AS rows_above FROM q""")
def _(spark, d):
    return out(joins.rows_above_percentiles(table(spark, d, "events"), "value", list(range(50, 100))))


@query("j6_nearest_profile", """
WITH p AS (SELECT n_name AS matched, avg(c_acctbal) / 1000 AS a, CAST(count(*) AS DOUBLE) / 10 AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
s AS (SELECT s_suppkey, s_acctbal / 1000 AS a, CAST(s_nationkey AS DOUBLE) AS b FROM supplier),
x AS (SELECT s_suppkey, matched, sqrt((s.a - p.a) * (s.a - p.a) + (s.b - p.b) * (s.b - p.b)) AS distance FROM s, p)
SELECT s_suppkey, matched, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, matched) AS r FROM x) WHERE r = 1""")
def _(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    profiles = c.groupBy("n_name").agg((F.avg("c_acctbal") / 1000).alias("a"), (F.count(F.lit(1)) / 10).alias("b"))
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    return out(joins.nearest_profile(s, ["a", "b"], profiles, "n_name").select("s_suppkey", "matched", "distance"))


@query("j8_not_sampled", f"""
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY {sql_hash(7, 'o_orderkey')} LIMIT 500)""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return sampling.not_sampled(o, sampling.seeded_pick(o, ["o_orderkey"], 500, 7), ["o_orderkey"])


@query("k1_top_rows", """
SELECT event_id, value, (row_number() OVER (ORDER BY value DESC, event_id))::INT AS rank FROM events ORDER BY value DESC, event_id LIMIT 10""")
def _(spark, d):
    return sampling.top_rows(table(spark, d, "events"), "value", ["event_id"], 10)


@query("k2_preview_head", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 20")
def _(spark, d):
    return sampling.preview_head(table(spark, d, "events").select("event_id", "ts", "value"), ["ts", "event_id"], 20).select("event_id", "value")


STRATA = """
WITH x AS (SELECT o_orderkey, o_orderpriority AS y, {h} AS h, {h2} AS h2 FROM orders),
n AS (SELECT y, count(*) AS m, (SELECT count(*) FROM x) AS n FROM x GROUP BY 1),
r AS (SELECT x.*, m, n.n AS n, row_number() OVER (PARTITION BY x.y ORDER BY h) AS r FROM x JOIN n USING (y)),
c AS (SELECT *, r <= greatest(1, round_even({cap} * m * 1.0 / n, 0)) AS first FROM r),
t AS (SELECT count(*) FILTER (WHERE first) AS got FROM c),
z AS (SELECT c.*, row_number() OVER (PARTITION BY first ORDER BY h2) AS r2, got FROM c, t)
SELECT o_orderkey, y FROM z WHERE CASE WHEN got >= {cap} THEN first AND r2 <= {cap} ELSE first OR r2 <= {cap} - got END"""


@query("k3_stratified_cap", STRATA.format(h=sql_hash(42, "o_orderkey"), h2=sql_hash(43, "o_orderkey"), cap=1003))
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("y"))
    return sampling.stratified_cap(o, ["o_orderkey"], "y", 1003, 42)


@query("k4_stratified_sample", STRATA.format(h=sql_hash(5, "o_orderkey"), h2=sql_hash(6, "o_orderkey"), cap=450))
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("y"))
    return sampling.stratified_cap(o, ["o_orderkey"], "y", 450, 5)


@query("k5_stratified_split", f"""
WITH o AS (SELECT o_orderkey, CAST(o_totalprice > 400000 AS INT) AS y FROM orders),
c AS (SELECT y, count(*) AS m, sum(count(*)) OVER () AS n FROM o GROUP BY y),
e AS (SELECT *, ceil(n * 0.35) AS total, m * ceil(n * 0.35) / n AS exact FROM c),
f AS (SELECT *, floor(exact) AS low, row_number() OVER (ORDER BY floor(exact) - exact, CAST(y AS VARCHAR)) AS r, sum(floor(exact)) OVER () AS given FROM e),
t AS (SELECT y, least(greatest(1, low + CASE WHEN r <= total - given THEN 1 ELSE 0 END), m - 1) AS take FROM f)
SELECT o_orderkey, o.y, CASE WHEN row_number() OVER (PARTITION BY o.y ORDER BY {sql_hash(42, 'o_orderkey')}) <= take THEN 'test' ELSE 'train' END AS fold FROM o JOIN t USING (y)""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 400000).cast("int").alias("y"))
    return sampling.stratified_split(o, ["o_orderkey"], "y", 0.35, 42)


@query("k6_random_split", f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {sql_hash(42, 'o_orderkey')}) <= round_even((SELECT count(*) FROM orders) * 0.6, 0)
  THEN 'train' ELSE 'test' END AS fold FROM orders""")
def _(spark, d):
    return sampling.random_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.4, 42)


@query("u3_common_datasets", """
SELECT DISTINCT o_orderpriority AS dataset FROM orders WHERE o_totalprice > 100000 INTERSECT SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'F'""")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("dataset", F.col("o_orderpriority"))
    return joins.common_datasets(o.filter("o_totalprice > 100000"), o.filter("o_orderstatus = 'F'"))


@query("u4_either_label", """
SELECT o_orderkey, greatest(CAST(o_totalprice > 400000 AS INT), CAST(o_orderstatus = 'P' AS INT)) AS y_combined FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") > 400000).cast("int").alias("a"), (F.col("o_orderstatus") == "P").cast("int").alias("b"))
    return joins.either_label(o, "a", "b").select("o_orderkey", "y_combined")


@query("seeded_hash", f"SELECT o_orderkey, {sql_hash('9:tag', 'o_orderkey')} AS h FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hash52(9, ["o_orderkey"], "tag").alias("h"))
