"""Profile and exploratory report."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import out, query, rounded, stacked, table
from oddrows.operators import eda, profile

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PARTS = ["p_partkey", "p_size", "p_retailprice"]
HOLES_SQL = """(SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v,
  CASE WHEN event_id % 11 <> 0 THEN CAST(user_id AS DOUBLE) END AS u FROM events)"""


def holes(spark, d):
    """Events with known gaps in two numeric columns."""
    return table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"),
        F.when(F.col("event_id") % 11 != 0, F.col("user_id").cast("double")).alias("u"),
    )


@query("a1_row_and_feature_count", "SELECT count(*)::BIGINT AS samples, 4::BIGINT AS features FROM lineitem")
def _(spark, d):
    p = profile.analyze(table(spark, d, "lineitem").select("l_orderkey", *LINE[:3]))
    return p.frame(spark).select("samples", "features")


@query("a2_missing_rate", f"""
SELECT round((avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN u IS NULL THEN 1.0 ELSE 0.0 END)) / 2, 6) AS missing_rate
FROM {HOLES_SQL}""")
def _(spark, d):
    return out(profile.analyze(holes(spark, d), ["v", "u"]).frame(spark).select("missing_rate"))


@query("a3_population_variance", f"""
SELECT "column", round(var_pop(v), 3) AS variance FROM ({stacked('lineitem', LINE)}) GROUP BY 1""")
def _(spark, d):
    p = profile.analyze(table(spark, d, "lineitem"), LINE)
    return out(p.column_frame(spark).select("column", "variance"), variance=3)


@query("a4_sample_skewness", f"""
SELECT "column", round(skewness(v), 6) AS skewness FROM ({stacked('lineitem', LINE)} UNION ALL {stacked(HOLES_SQL, ['v', 'u'])}) GROUP BY 1""")
def _(spark, d):
    a = profile.analyze(table(spark, d, "lineitem"), LINE).column_frame(spark)
    b = profile.analyze(holes(spark, d), ["v", "u"]).column_frame(spark)
    return out(a.unionByName(b).select("column", "skewness"))


@query("a5_sample_kurtosis", f"""
SELECT "column", round(kurtosis(v), 6) AS kurtosis FROM ({stacked('lineitem', LINE)} UNION ALL {stacked(HOLES_SQL, ['v', 'u'])}) GROUP BY 1""")
def _(spark, d):
    a = profile.analyze(table(spark, d, "lineitem"), LINE).column_frame(spark)
    b = profile.analyze(holes(spark, d), ["v", "u"]).column_frame(spark)
    return out(a.unionByName(b).select("column", "kurtosis"))


@query("a6_zero_rate", f"""
SELECT "column", round(avg(CASE WHEN coalesce(v, 0) = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate
FROM ({stacked('lineitem', LINE)} UNION ALL {stacked(HOLES_SQL, ['v', 'u'])}) GROUP BY 1""")
def _(spark, d):
    a = profile.analyze(table(spark, d, "lineitem"), LINE).column_frame(spark)
    b = profile.analyze(holes(spark, d), ["v", "u"]).column_frame(spark)
    return out(a.unionByName(b).select("column", "zero_rate"))


def pair_sql(source: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(
                f"SELECT '{a}' AS a, '{b}' AS b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r "
                f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
            )
    return " UNION ALL ".join(parts)


@query("a7_pairwise_correlation", f"SELECT a, b, round(r, 6) + 0.0 AS r FROM ({pair_sql('lineitem', LINE)} UNION ALL {pair_sql(HOLES_SQL, ['v', 'u'])})")
def _(spark, d):
    a = profile.pairwise_correlations(table(spark, d, "lineitem"), LINE)
    return out(a.unionByName(profile.pairwise_correlations(holes(spark, d), ["v", "u"])))


@query("a7_pairwise_correlation_wide", f"SELECT a, b, round(r, 6) + 0.0 AS r FROM ({pair_sql('lineitem', LINE)} UNION ALL {pair_sql(HOLES_SQL, ['v', 'u'])})")
def _(spark, d):
    a = profile.pairwise_correlations(table(spark, d, "lineitem"), LINE, wide_limit=1)
    return out(a.unionByName(profile.pairwise_correlations(holes(spark, d), ["v", "u"], wide_limit=1)))


ENTROPY_SQL = """
WITH s AS (SELECT "column", count(v) AS n, min(v) AS mn, max(v) AS mx,
    least(10, greatest(2, CAST(floor(sqrt(count(v))) AS INT))) AS bins FROM u GROUP BY 1),
b AS (SELECT u."column", n, len(list_filter(range(1, bins), lambda i: v > mn + i * ((mx - mn) / bins))) AS bin
  FROM u JOIN s USING ("column") WHERE v IS NOT NULL),
c AS (SELECT "column", bin, count(*) * 1.0 / any_value(n) AS p FROM b GROUP BY 1, 2)
SELECT "column", round(-sum(p * log2(p)), 6) AS entropy FROM c GROUP BY 1"""


@query("a8_binned_entropy", f"WITH u AS ({stacked('lineitem', LINE)} UNION ALL {stacked(HOLES_SQL, ['v', 'u'])}), x AS (SELECT 1) " + ENTROPY_SQL.replace("WITH s AS", ", s AS", 1).lstrip())
def _(spark, d):
    a = profile.analyze(table(spark, d, "lineitem"), LINE).column_frame(spark)
    b = profile.analyze(holes(spark, d), ["v", "u"]).column_frame(spark)
    return out(a.unionByName(b).select("column", "entropy"))


@query("a9_dataset_profile", f"""
WITH u AS ({stacked('part', PARTS)}), c AS ({pair_sql('part', PARTS)}),
s AS (SELECT "column", var_pop(v) AS vp, skewness(v) AS sk, kurtosis(v) AS ku,
  avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS ms, avg(CASE WHEN coalesce(v, 0) = 0 THEN 1.0 ELSE 0.0 END) AS zr FROM u GROUP BY 1)
SELECT (SELECT count(*) FROM part)::BIGINT AS samples, 3::BIGINT AS features, round(avg(ms), 6) AS missing_rate,
  round(avg(vp), 2) AS variance_mean, round(avg(abs(sk)), 6) AS skewness_mean_abs, round(avg(abs(ku)), 6) AS kurtosis_mean_abs,
  round(avg(zr), 6) AS sparsity_zero_rate, (SELECT round(avg(abs(r)), 6) FROM c) AS correlation_abs_mean,
  (SELECT count(*) FROM c WHERE abs(r) >= 0.85)::BIGINT AS high_corr_pair_count FROM s""")
def _(spark, d):
    return out(profile.analyze(table(spark, d, "part")).frame(spark), variance_mean=2)


META = ["event_id", "v", "u"]


@query("a10_column_metadata", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {i}::INT AS position, '{c}' AS \"column\", '{t}' AS dtype, true AS is_numeric, "
    f"(count(*) - count({c}))::BIGINT AS missing_count, round((count(*) - count({c})) * 100.0 / count(*), 3) AS missing_pct, "
    f"count(DISTINCT {c})::BIGINT AS nunique FROM {HOLES_SQL}"
    for i, (c, t) in enumerate(zip(META, ["bigint", "double", "double"]))
) + ")")
def _(spark, d):
    return eda.column_metadata(holes(spark, d))


DUPES = "(SELECT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem)"


@query("a11_duplicate_rows", f"""
SELECT sum(c - 1)::BIGINT AS duplicate_row_count, round(sum(c - 1) * 100.0 / sum(c), 3) AS duplicate_row_pct
FROM (SELECT count(*) AS c FROM {DUPES} GROUP BY l_quantity, l_discount, l_tax, l_returnflag)""")
def _(spark, d):
    return eda.duplicate_rows(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag"))


SUMMARY_SQL = f"""
WITH u AS ({stacked('lineitem', LINE)} UNION ALL {stacked(HOLES_SQL, ['v', 'u'])}),
s AS (SELECT "column", count(v) AS count, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, quantile_cont(v, 0.25) AS p25,
  quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75, max(v) AS max, skewness(v) AS skew, kurtosis(v) AS kurtosis
  FROM u GROUP BY 1),
o AS (SELECT u."column", count(*) FILTER (WHERE v < p25 - 1.5 * (p75 - p25) OR v > p75 + 1.5 * (p75 - p25))::BIGINT AS tukey_outlier_count,
  count(*) FILTER (WHERE abs((v - mean) / std) > 3)::BIGINT AS z_outlier_count FROM u JOIN s USING ("column") GROUP BY 1)
"""


@query("a12_numeric_summary", SUMMARY_SQL + """
SELECT "column", count::BIGINT AS count, round(mean, 4) AS mean, round(std, 4) AS std, round(min, 6) AS min, round(p25, 6) AS p25,
  round(median, 6) AS median, round(p75, 6) AS p75, round(max, 6) AS max, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis FROM s""")
def _(spark, d):
    a = eda.numeric_summary(table(spark, d, "lineitem"), LINE).unionByName(eda.numeric_summary(holes(spark, d), ["v", "u"]))
    return out(a.drop("tukey_outlier_count", "z_outlier_count"), mean=4, std=4)


@query("a13_tukey_outliers", SUMMARY_SQL + 'SELECT "column", tukey_outlier_count FROM o')
def _(spark, d):
    a = eda.numeric_summary(table(spark, d, "lineitem"), LINE).unionByName(eda.numeric_summary(holes(spark, d), ["v", "u"]))
    return a.select("column", "tukey_outlier_count")


@query("a14_z_outliers", SUMMARY_SQL + 'SELECT "column", z_outlier_count FROM o')
def _(spark, d):
    a = eda.numeric_summary(table(spark, d, "lineitem"), LINE).unionByName(eda.numeric_summary(holes(spark, d), ["v", "u"]))
    return a.select("column", "z_outlier_count")


CATS = ["o_orderstatus", "o_orderpriority", "o_day"]
CAT_SQL = """
WITH x AS (SELECT o_orderstatus, o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_day FROM orders),
u AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM x UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM x
  UNION ALL SELECT 'o_day', o_day FROM x),
c AS (SELECT "column", value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY 1, 2)
"""


def orders_text(spark, d):
    return table(spark, d, "orders").select(
        "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_day")
    )


@query("a15_categorical_summary", CAT_SQL + """
SELECT "column", count(*)::BIGINT AS nunique, count(*) FILTER (WHERE n * 1.0 / (SELECT count(*) FROM orders) < 0.01)::BIGINT AS rare_count
FROM c GROUP BY 1""")
def _(spark, d):
    return eda.categorical_summary(orders_text(spark, d))


@query("a15_categorical_top", CAT_SQL + """
SELECT "column", value, n::BIGINT AS count, rank, round(n * 100.0 / (SELECT count(*) FROM orders), 3) AS pct FROM
(SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 10""")
def _(spark, d):
    return eda.categorical_top(orders_text(spark, d))


@query("a16_datetime_columns", """
SELECT 'o_day' AS "column", 100.0::DOUBLE AS parsed_pct, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS min,
  CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS max,
  CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS DOUBLE) AS range_days FROM orders
UNION ALL
SELECT 'stamp', round(count(*) FILTER (WHERE o_orderkey % 10 <> 0) * 100.0 / count(*), 2),
  CAST(min(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderkey % 10 <> 0) AS VARCHAR),
  CAST(max(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderkey % 10 <> 0) AS VARCHAR),
  CAST(date_diff('day', min(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderkey % 10 <> 0),
    max(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderkey % 10 <> 0)) AS DOUBLE) FROM orders""")
def _(spark, d):
    text = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_day"),
        F.when(F.col("o_orderkey") % 10 != 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.lit("?")).alias("stamp"),
        "o_orderstatus",
    )
    found = eda.datetime_columns(text)
    return found.select(
        "column", "parsed_pct", F.date_format("min", "yyyy-MM-dd").alias("min"), F.date_format("max", "yyyy-MM-dd").alias("max"), "range_days"
    )


def matrix_sql(source: str, cols: list[str], label: str, expr) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round({'1.0' if a == b else f'corr({expr(a)}, {expr(b)})'}, 6) + 0.0 AS {label} FROM {source}"
        + (" LIMIT 1" if False else "") for a in cols for b in cols if a != b
    ) + "".join(f" UNION ALL SELECT '{a}', '{a}', 1.0" for a in cols)


@query("a17_pearson_matrix", matrix_sql("lineitem", LINE, "pearson", lambda c: c))
def _(spark, d):
    return out(eda.pearson_matrix(table(spark, d, "lineitem").select(*LINE), LINE))


RANKS_SQL = "(SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in LINE
) + " FROM lineitem)"


@query("a18_spearman_matrix", matrix_sql(RANKS_SQL, LINE, "spearman", lambda c: c))
def _(spark, d):
    return out(eda.spearman_matrix(table(spark, d, "lineitem").select(*LINE), LINE))


@query("a19_top_correlations", f"""
WITH p AS ({pair_sql('lineitem', LINE)}), s AS ({pair_sql(RANKS_SQL, LINE)})
SELECT p.a, p.b, round(p.r, 6) AS pearson, round(s.r, 6) AS spearman, round(abs(p.r), 6) AS abs_pearson
FROM p JOIN s USING (a, b) ORDER BY abs(p.r) DESC, p.a, p.b LIMIT 10""")
def _(spark, d):
    return out(eda.top_correlations(table(spark, d, "lineitem").select(*LINE), LINE))


@query("a20_scatter_sample", f"""
SELECT event_id, value AS x, CAST(user_id AS DOUBLE) AS y FROM events
ORDER BY CAST(('0x' || substr(md5('0:' || CAST(event_id AS VARCHAR)), 1, 13)) AS BIGINT) LIMIT 2800""")
def _(spark, d):
    return eda.scatter_sample(table(spark, d, "events"), ["event_id"], "value", "user_id")


@query("a21_boxplots", f"""
WITH u AS ({stacked('lineitem', LINE)}), s AS (SELECT "column", min(v) AS mn, max(v) AS mx, quantile_cont(v, 0.25) AS q1,
  quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM u GROUP BY 1)
SELECT "column", round(mn, 6) AS min, round(mx, 6) AS max, round(greatest(mn, q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(q1, 6) AS q1,
  round(med, 6) AS median, round(q3, 6) AS q3, round(least(mx, q3 + 1.5 * (q3 - q1)), 6) AS whisker_high FROM s""")
def _(spark, d):
    return out(eda.boxplots(table(spark, d, "lineitem").select(*LINE)))


@query("a22_histograms", f"""
WITH u AS ({stacked('lineitem', LINE)}), s AS (SELECT "column", min(v) AS mn, max(v) AS mx FROM u GROUP BY 1),
b AS (SELECT u."column", len(list_filter(range(1, 22), lambda i: v >= mn + i * ((mx - mn) / 22)))::INT AS bin FROM u JOIN s USING ("column")),
c AS (SELECT "column", bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT s."column", CAST(g.i AS INT) AS bin, round(mn + g.i * ((mx - mn) / 22), 6) AS "left", round(mn + (g.i + 1) * ((mx - mn) / 22), 6) AS "right",
  coalesce(c.n, 0)::BIGINT AS count FROM s CROSS JOIN range(0, 22) g(i) LEFT JOIN c ON c."column" = s."column" AND c.bin = g.i""")
def _(spark, d):
    return out(eda.histograms(table(spark, d, "lineitem").select(*LINE)))


@query("a23_quality_warnings", """
WITH x AS (SELECT CASE WHEN event_id % 2 = 0 THEN value END AS v, 1.0 AS flat, value * value * value AS heavy, event_type AS kind FROM events),
g AS (SELECT count(*) - 1 AS extra FROM x GROUP BY v, flat, heavy, kind)
SELECT 'missing' AS kind, 'v' AS "column", round(count(*) FILTER (WHERE v IS NULL) * 100.0 / count(*), 3) AS value FROM x
UNION ALL SELECT 'constant', 'flat', 0.0
UNION ALL SELECT 'skew', 'heavy', round(skewness(heavy), 4) FROM x WHERE 1 = 1 HAVING abs(skewness(heavy)) > 2
UNION ALL SELECT 'skew', 'v', round(skewness(v), 4) FROM x HAVING abs(skewness(v)) > 2
UNION ALL SELECT 'duplicates', NULL, CAST(sum(extra) AS DOUBLE) FROM g HAVING sum(extra) > 0""")
def _(spark, d):
    x = table(spark, d, "events").select(
        F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("v"), F.lit(1.0).alias("flat"),
        (F.col("value") * F.col("value") * F.col("value")).alias("heavy"), F.col("event_type").alias("kind"),
    )
    w = eda.quality_warnings(x)
    return w.select("kind", "column", F.when(F.col("kind") == "skew", rounded("value", 4)).otherwise(F.round("value", 3)).alias("value"))


@query("a24_eda_report")
def _(spark, d):
    report = eda.eda_report(table(spark, d, "orders"), ["o_orderkey"])
    parts = [f.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("part"), "rows") for n, f in report.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total
