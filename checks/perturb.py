"""Injection scenarios, noise, before/after compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import block_sql, out, query, rounded, sql_hash, table
from oddrows.operators import inject as inj
from oddrows.operators import sampling

KEY = ["event_id"]
BASE_SQL = "(SELECT event_id, ts, value AS a, user_id AS b, event_type FROM events)"


def base(spark, d):
    return table(spark, d, "events").select("event_id", "ts", F.col("value").alias("a"), F.col("user_id").alias("b"), "event_type")


def hit_sql(share: float, seed: int = 42) -> str:
    """SQL: x(.., y_true) with the seeded rows marked."""
    return f"""n AS (SELECT least(count(*) - 1, greatest(1, ceil(count(*) * {share}))) AS k FROM events),
x AS (SELECT *, CAST(row_number() OVER (ORDER BY {sql_hash(seed, 'event_id')}) <= (SELECT k FROM n) AS INT) AS y_true FROM {BASE_SQL}),
s AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb, quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM {BASE_SQL})"""


def inject_sql(share: float, a: str = "a", b: str = "b", kind: str = "event_type") -> str:
    return f"""WITH {hit_sql(share)} SELECT event_id, y_true, round(CASE WHEN y_true = 1 THEN {a} ELSE a END, 6) AS a,
  round(CAST(CASE WHEN y_true = 1 THEN {b} ELSE b END AS DOUBLE), 6) AS b, CASE WHEN y_true = 1 THEN {kind} ELSE event_type END AS event_type FROM x, s"""


def run(spark, d, scenario, **params):
    df = inj.inject(base(spark, d), scenario, key=KEY, seed=42, params=params, order_by=["ts"])
    return out(df.select("event_id", "y_true", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), "event_type"))


@query("i0_injected_row_count", """
SELECT o_orderstatus AS grp, CAST(least(count(*) - 1, greatest(1, ceil(count(*) * 0.07))) AS BIGINT) AS k FROM orders GROUP BY 1""")
def _(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderstatus").count().collect()
    return spark.createDataFrame([(r[0], sampling.injected_row_count(r[1], 0.07)) for r in counts], "grp string, k long")


@query("i1_spike_single", inject_sql(0.1, a="a + 5 * sa"))
def _(spark, d):
    return run(spark, d, "spike_single")


@query("i2_joint_shift", inject_sql(0.1, a="a + 4 * sa", b="b + 4 * sb"))
def _(spark, d):
    return run(spark, d, "joint_shift")


@query("i3_scale_burst", inject_sql(0.08, a="a * 3", b="b * 3"))
def _(spark, d):
    return run(spark, d, "scale_burst")


@query("i4_dead_sensor_median", inject_sql(0.08, a="ma", b="mb"))
def _(spark, d):
    return run(spark, d, "dead_sensor")


@query("i4_dead_sensor_zero", inject_sql(0.08, a="0", b="0"))
def _(spark, d):
    return run(spark, d, "dead_sensor", mode="zero")


@query("i4_dead_sensor_constant", inject_sql(0.08, a="7.5", b="7.5"))
def _(spark, d):
    return run(spark, d, "dead_sensor", constant=7.5)


@query("i4_dead_sensor_previous", f"""WITH {hit_sql(0.08)}, p AS (SELECT *, coalesce(lag(a) OVER (ORDER BY ts, event_id), a) AS pa,
  coalesce(lag(b) OVER (ORDER BY ts, event_id), b) AS pb FROM x)
SELECT event_id, y_true, round(CASE WHEN y_true = 1 THEN pa ELSE a END, 6) AS a, round(CAST(CASE WHEN y_true = 1 THEN pb ELSE b END AS DOUBLE), 6) AS b, event_type FROM p""")
def _(spark, d):
    return run(spark, d, "dead_sensor", mode="previous")


RANDOM_CONSTANT = "(SELECT quantile_cont({c}, 0.1) + (quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1)) * (CAST('0x' || substr(md5('42:{c}:0'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 FROM " + BASE_SQL + ")"


@query("i4_dead_sensor_random_constant", inject_sql(0.08, a=RANDOM_CONSTANT.format(c="a"), b=RANDOM_CONSTANT.format(c="b")))
def _(spark, d):
    return run(spark, d, "dead_sensor", mode="random_constant")


@query("i5_sign_flip", inject_sql(0.05, a="-a", b="-b"))
def _(spark, d):
    return run(spark, d, "sign_flip")


@query("i6_temporal_block", f"""WITH {hit_sql(0.1)}, y AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM {BASE_SQL}),
z AS (SELECT y.*, CAST(r.b IS NOT NULL AS INT) AS hit FROM y LEFT JOIN {block_sql('(SELECT count(*) FROM events)', '(SELECT CAST(k AS BIGINT) FROM n)', 3, 42)} r ON i >= r.b AND i < r.e)
SELECT event_id, hit AS y_true, round(a + hit * 4 * sa, 6) AS a, round(b + hit * 4 * sb, 6) AS b, event_type FROM z, s""")
def _(spark, d):
    return run(spark, d, "temporal_block", block_count=3)


KINDS_SQL = "(SELECT list_sort(list(DISTINCT event_type)) FROM events)"
DRAW_SQL = sql_hash("42:event_type", "event_id").replace("AS DOUBLE)", "AS DOUBLE)")


@query("i7_categorical_flip_swap", f"""WITH {hit_sql(0.1)}, k AS (SELECT {KINDS_SQL} AS kinds),
z AS (SELECT x.*, kinds, list_position(kinds, event_type) - 1 AS place, CAST({DRAW_SQL} AS BIGINT) % (len(kinds) - 1) AS other FROM x, k)
SELECT event_id, y_true, round(a, 6) AS a, round(CAST(b AS DOUBLE), 6) AS b,
  CASE WHEN y_true = 1 THEN kinds[CAST(other + CASE WHEN other >= place THEN 1 ELSE 0 END + 1 AS BIGINT)] ELSE event_type END AS event_type FROM z""")
def _(spark, d):
    return run(spark, d, "categorical_flip", column="event_type")


@query("i7_categorical_flip_sentinel", inject_sql(0.1, kind="'__UNKNOWN__'"))
def _(spark, d):
    return run(spark, d, "categorical_flip", column="event_type", mode="sentinel")


@query("i8_missing_value", inject_sql(0.08, a="NULL", b="NULL", kind="NULL"))
def _(spark, d):
    return run(spark, d, "missing_value")


@query("i9_scenario_list", """
SELECT x AS scenario, CAST(least(n - 1, greatest(1, ceil(n * c))) AS BIGINT) AS rows_to_inject FROM (SELECT count(*) AS n FROM events), (VALUES ('spike_single', 0.1), ('joint_shift', 0.1),
  ('scale_burst', 0.08), ('dead_sensor', 0.08), ('sign_flip', 0.05), ('temporal_block', 0.1), ('categorical_flip', 0.1), ('missing_value', 0.08)) v(x, c)""")
def _(spark, d):
    rows = base(spark, d).count()
    return spark.createDataFrame([(s, sampling.injected_row_count(rows, inj.merged_params(s)["contamination"])) for s in inj.list_scenarios()], "scenario string, rows_to_inject long")


@query("i10_gaussian_noise", f"""
WITH s AS (SELECT stddev_pop(a) AS sa FROM {BASE_SQL}),
u AS (SELECT event_id, a, (CAST(('0x' || substr(md5('7:a:' || CAST(event_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u1,
  (CAST(('0x' || substr(md5('7:a:' || CAST(event_id AS VARCHAR)), 14, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u2 FROM {BASE_SQL})
SELECT event_id, round(a + sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) * 0.1 * sa, 5) AS a FROM u, s""")
def _(spark, d):
    noisy = inj.add_feature_noise(base(spark, d), key=KEY, noise_std=0.1, columns=["a"], seed=7)
    return out(noisy.select("event_id", "a"), 5)


CHANGE = inject_sql(0.1, a="a + 5 * sa")


@query("j9_cell_changes", f"""WITH after AS ({CHANGE}), d AS (SELECT b.event_id, b.a AS before, x.a AS after FROM {BASE_SQL} b JOIN after x USING (event_id) WHERE abs(b.a - x.a) > 1e-9)
SELECT event_id, 1::INT AS position, 'a' AS "column", round(before, 4) AS before, round(after, 4) AS after FROM d ORDER BY event_id LIMIT 48""")
def _(spark, d):
    before = base(spark, d)
    after = inj.inject(before, "spike_single", key=KEY, seed=42).drop("y_true")
    c = inj.cell_changes(before, after, KEY)
    return c.select("event_id", "position", "column", rounded(F.col("before").cast("double"), 4).alias("before"), rounded(F.col("after").cast("double"), 4).alias("after"))


@query("i11_injection_preview", f"""WITH {hit_sql(0.1)}, c AS (SELECT count(*) AS n, sum(y_true) AS k FROM x)
SELECT event_id, n::BIGINT AS row_count, k::BIGINT AS injected_row_count FROM x, c WHERE y_true = 1""")
def _(spark, d):
    preview = inj.injection_preview(base(spark, d), "spike_single", key=KEY)
    counts = preview["counts"].first()
    return preview["injected_rows"].select("event_id", F.lit(counts["row_count"]).alias("row_count"), F.lit(counts["injected_row_count"]).alias("injected_row_count"))


def noise_sql(column: str) -> str:
    """SQL: the standard normal draw of a copy's cell."""
    text = f"md5('10000:{column}:' || c || ':' || event_id)"
    u = [f"((CAST('0x' || substr({text}, {start}, 13) AS BIGINT) + 0.5) / 4503599627370496.0)" for start in (1, 14)]
    return f"sqrt(-2 * ln({u[0]})) * cos(2 * pi() * {u[1]})"


@query("u1_union_of_noisy_copies", f"""
WITH s AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM {BASE_SQL})
SELECT c::INT AS copy, event_id, round(a + {noise_sql('a')} * 0.03 * sa, 5) AS a, round(b + {noise_sql('b')} * 0.03 * sb, 5) AS b FROM {BASE_SQL}, range(0, 5) r(c), s""")
def _(spark, d):
    return out(inj.repeat_with_noise(base(spark, d), key=KEY, copies=5, noise_std=0.03).select("copy", "event_id", "a", "b"), 5)


@query("p17_parameter_overrides", f"""WITH {hit_sql(0.02)} SELECT event_id, round(a + 2.5 * sa, 6) AS a FROM x, s WHERE y_true = 1""")
def _(spark, d):
    params = inj.parse_overrides(contamination=" 0.02 ", magnitude_in_std="2.5", column="a", columns="", mode=None)
    return out(inj.inject(base(spark, d), "spike_single", key=KEY, params=params).filter("y_true = 1").select("event_id", "a"))
