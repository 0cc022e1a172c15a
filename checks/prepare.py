"""Sources, sinks, projections and label derivation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import out, query, sql_hash, table
from oddrows.functions import labels, schema
from oddrows.operators import joins
from oddrows.session import scratch_dir
from oddrows.sources import readers, write_table


def folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_csv_scan", """
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN round(value, 6) END AS value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, event_type FROM events""")
def _(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 10 != 0, F.col("value").cast("string")).otherwise(F.lit("NA")).alias("value"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "event_type")
    return out(readers.read_csv(spark, write_table(e, folder(spark, "csv"), format="csv")))


@query("s2_json_records", "SELECT event_id, value, event_type FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    docs = e.groupBy(F.floor(F.col("event_id") / 50).alias("g")).agg(F.collect_list(F.struct("event_id", "value", "event_type")).alias("data"))
    path = folder(spark, "json")
    docs.select(F.to_json(F.struct("data")).alias("value")).write.text(path)
    return readers.read_json_records(spark, path, multiline=False).select("event_id", "value", "event_type")


@query("s4_source_dispatch", "SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark, d):
    by_path = readers.load(spark, f"{d}/supplier.parquet").select("s_suppkey", "s_acctbal")
    by_frame = readers.load(spark, table(spark, d, "supplier")).select("s_suppkey", "s_acctbal")
    return by_path.unionByName(by_frame)


@query("s5_headerless_scan", "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size, p_retailprice AS price, p_brand AS brand FROM part")
def _(spark, d):
    path = folder(spark, "plain")
    table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand").write.csv(path, header=False)
    return readers.read_delimited(spark, path, "id long, size long, price double, brand string")


@query("s6_whitespace_scan", "SELECT p_brand AS sequence_name, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, p_type AS site FROM part")
def _(spark, d):
    path = folder(spark, "gaps")
    p = table(spark, d, "part")
    p.select(F.concat_ws("   ", "p_brand", F.concat(F.lit(" "), F.col("p_size")), "p_retailprice", "p_type").alias("value")).write.text(path)
    return readers.read_whitespace(spark, path, "sequence_name string, a double, b double, site string")


@query("s7_label_on_ingest", """
SELECT event_id, CAST(event_type <> 'view' AS INT) AS ground_truth, 'derived' AS how FROM events
UNION ALL SELECT doc_id, toxic, 'renamed' FROM labels""")
def _(spark, d):
    a = readers.label_not_equal(table(spark, d, "events").select("event_id", F.col("event_type").alias("labels")), normal="view")
    b = readers.rename_label(table(spark, d, "labels").select(F.col("doc_id").alias("event_id"), F.col("toxic").cast("int").alias("class")))
    return a.withColumn("how", F.lit("derived")).unionByName(b.withColumn("how", F.lit("renamed")))


@query("s8_table_sink", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = write_table(o, folder(spark, "sink"), format="csv")
    return readers.read_csv(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("s9_config_tables", "SELECT o_orderpriority AS score_source, round(avg(o_totalprice), 2) AS weight FROM orders GROUP BY 1")
def _(spark, d):
    from oddrows.sources import calibrated_weights
    w = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("w"))
    path = folder(spark, "weights")
    pairs = F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "w")))  # five rows: one per priority
    w.agg(F.to_json(F.struct(pairs.alias("weights"))).alias("value")).write.text(path)
    return out(spark.createDataFrame(list(calibrated_weights(spark, path).items()), "score_source string, weight double"), 2)


@query("s9_profile_file", """
SELECT o_orderpriority AS dataset, count(*)::BIGINT AS sample_count, round(avg(o_totalprice), 2) AS selected_score, min(o_orderstatus) AS selected_source, 2::INT AS allowed, 'learned_score_diagnostics' AS selector_mode
FROM orders GROUP BY 1""")
def _(spark, d):
    from oddrows.sources.config import profile_table, profiles_document
    found = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.round(F.avg("o_totalprice"), 2).alias("selected_score"), F.min("o_orderstatus").alias("selected_source"))
    path = folder(spark, "profiles")
    profiles_document(found, ["lof", "ensemble"], "f1").write.text(path)
    return out(profile_table(spark, path).select("dataset", "sample_count", "selected_score", "selected_source", F.size("allowed_sources").alias("allowed"), "selector_mode"), 2)


@query("p1_numeric_projection", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select(*schema.numeric_columns(o))


@query("p2_non_numeric_projection", "SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date")).withColumn("flag", F.lit(True))
    return o.select(*schema.categorical_columns(o))


@query("p3_feature_frame", "SELECT o_totalprice, o_custkey FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", " Row_ID ").withColumn("Label", F.lit(1))
    kept, _ = schema.feature_columns(o, ["o_missing"])
    return o.select(*kept)


@query("p4_column_resolver", "SELECT p_size, p_retailprice FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    return p.select(*schema.resolve_columns(p, ["p_size", "p_brand", "nope", "p_retailprice"], numeric_only=True))


@query("p5_integer_promotion", "SELECT p_partkey, CAST(p_size AS DOUBLE) / 4 AS p_size FROM part")
def _(spark, d):
    p = schema.promote_integers(table(spark, d, "part").select("p_partkey", "p_size"), ["p_size"])
    return p.withColumn("p_size", F.col("p_size") / 4)


WORDS_SQL = """(SELECT event_id, CASE event_id % 9 WHEN 0 THEN ' Yes' WHEN 1 THEN 'normal' WHEN 2 THEN '2.5' WHEN 3 THEN '-1' WHEN 4 THEN 'ATTACK' WHEN 5 THEN 'benign'
  WHEN 6 THEN '0' WHEN 7 THEN 'abnormal ' ELSE NULL END AS w FROM events)"""


def words(spark, d):
    m = F.col("event_id") % 9
    texts = [" Yes", "normal", "2.5", "-1", "ATTACK", "benign", "0", "abnormal "]
    w = F.when(m == 0, texts[0])
    for i, t in enumerate(texts[1:], 1):
        w = w.when(m == i, t)
    return table(spark, d, "events").select("event_id", w.alias("w"))


@query("p6_binary_label_finder", "SELECT 'label' AS found, count(*)::BIGINT AS rows FROM events")
def _(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_type").alias("target"), F.when(F.col("event_id") % 2 == 0, "normal").otherwise("Anomaly ").alias(" LABEL"),
        (F.col("event_id") % 2).alias("y_true")).withColumnRenamed(" LABEL", "label")
    return e.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(labels.find_binary_label(e)).alias("found"), "rows")


@query("p7_label_name_finder", "SELECT 'Ground_Truth' AS found, count(*)::BIGINT AS rows FROM labels")
def _(spark, d):
    df = table(spark, d, "labels").withColumnRenamed("toxic", "Ground_Truth")
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(labels.label_column(df)).alias("found"), "rows")


@query("p8_binary_label", f"""
SELECT event_id, CASE WHEN lower(trim(w)) IN ('1','true','yes','anomaly','abnormal') THEN 1 WHEN lower(trim(w)) IN ('0','false','no','normal') THEN 0
  ELSE coalesce(CAST(TRY_CAST(w AS DOUBLE) > 0 AS INT), 0) END AS y FROM {WORDS_SQL}""")
def _(spark, d):
    return words(spark, d).select("event_id", labels.binary_label(F.col("w")).alias("y"))


@query("p9_binary_label_extended", f"""
SELECT event_id, CASE WHEN lower(trim(w)) IN ('1','true','yes','anomaly','abnormal','attack') THEN 1 WHEN lower(trim(w)) IN ('0','false','no','normal','benign') THEN 0
  ELSE coalesce(CAST(TRY_CAST(w AS DOUBLE) > 0 AS INT), 0) END AS y FROM {WORDS_SQL}""")
def _(spark, d):
    return words(spark, d).select("event_id", labels.binary_label(F.col("w"), extended=True).alias("y"))


@query("p10_rare_class_label", """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT quantile_cont(n, 0.25) AS cut FROM c)
SELECT doc_id, CAST(lang IN (SELECT lang FROM c, q WHERE n <= cut) AS INT) AS ground_truth FROM documents""")
def _(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.col("lang").alias("class"))
    _, labelled = labels.find_class_label(df)
    return labelled.select("doc_id", "ground_truth")


@query("p11_label_from_values", "SELECT vec_id, CAST(label IN (2, 5) AS INT) AS ground_truth FROM embeddings")
def _(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", "label")
    return labels.label_from_values(df, "label", ["2", "5"]).select("vec_id", "ground_truth")


@query("p12_rarest_class_label", """
SELECT o_totalprice, CAST(o_orderpriority = (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*), 1 LIMIT 1) AS INT) AS ground_truth FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return labels.rarest_class_label(o, "o_orderpriority", drop=("o_orderkey", "absent"))


@query("p13_one_against_rest", """
SELECT event_id, CAST(upper(event_type) = 'ERROR' AS INT) AS ground_truth FROM events UNION ALL SELECT vec_id, CAST(label = 0 AS INT) FROM embeddings""")
def _(spark, d):
    a = labels.one_against_rest(table(spark, d, "events").select("event_id", "event_type"), "event_type", "Error")
    b = labels.one_against_rest(table(spark, d, "embeddings").select(F.col("vec_id").alias("event_id"), "label"), "label", 0)
    return a.unionByName(b)


@query("p14_drop_present_columns", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark, d):
    return schema.drop_present(table(spark, d, "supplier"), ["s_name", "s_nationkey", "not_there"])


@query("p15_synthetic_ground_truth", f"""
SELECT event_id, CAST(row_number() OVER (ORDER BY {sql_hash(42, 'event_id')}) <= ceil((SELECT count(*) FROM events) * 0.1) AS INT) AS synthetic_ground_truth FROM events""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("n"), F.col("value").alias("cpu_load"))
    return labels.synthetic_labels(e, ["event_id"]).select("event_id", "synthetic_ground_truth")


@query("p18_score_source_pick", """
SELECT event_id, value AS score, 'iforest' AS asked FROM events UNION ALL SELECT event_id, CAST(user_id AS DOUBLE), 'absent' FROM events""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("value").alias("iforest"), F.col("user_id").cast("double").alias("ensemble"))
    a = joins.pick_source(e, "iforest").select("event_id", "score", F.lit("iforest").alias("asked"))
    return a.unionByName(joins.pick_source(e, "absent").select("event_id", "score", F.lit("absent").alias("asked")))
