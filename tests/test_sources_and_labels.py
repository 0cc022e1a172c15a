import json

import pytest
from pyspark.sql import functions as F

from oddrows.functions import labels, schema
from oddrows.sources import calibrated_weights, load, meta_profiles, readers, write_table


def test_csv_types_and_missing_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,f,t,s,e,b\n1,1.5,2026-05-01T10:00,x,,True\n,NA,2026-05-01T11:00,null,,False\n3,2,2026-05-02T10:00,y,,True\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"n": "bigint", "f": "double", "t": "string", "s": "string", "e": "double", "b": "boolean"}
    assert [r.f for r in df.orderBy("t").collect()] == [1.5, None, 2.0] and df.filter("s IS NULL").count() == 1


def test_json_envelope(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (tmp_path / "wrapped.json").write_text(json.dumps({"data": [{"a": 1}, {"a": 2}], "page": 1}))
    for name in ("list.json", "wrapped.json"):
        assert sorted(r.a for r in load(spark, str(tmp_path / name)).collect()) == [1, 2]
    assert load(spark, {"type": "json", "path": str(tmp_path / "wrapped.json")}).columns == ["a"]


def test_delimited_and_whitespace(spark, tmp_path):
    (tmp_path / "p.txt").write_text(" 1, 2,a\n3,4,b\n")
    assert readers.read_delimited(spark, str(tmp_path / "p.txt"), "x long, y long, z string").agg(F.sum("y")).first()[0] == 6
    with pytest.raises(ValueError):
        readers.read_delimited(spark, str(tmp_path / "p.txt"), "x long, y long")
    (tmp_path / "w.txt").write_text("A1  0.5   0.25 cp\n\n  B2 1.0 2.0 im \n")
    rows = readers.read_whitespace(spark, str(tmp_path / "w.txt"), "n string, a double, b double, s string").orderBy("n").collect()
    assert [tuple(r) for r in rows] == [("A1", 0.5, 0.25, "cp"), ("B2", 1.0, 2.0, "im")]


def test_unsupported_source(spark):
    for bad in ("x.xml", {"type": "other"}, 3):
        with pytest.raises(ValueError):
            load(spark, bad)


def test_jdbc_options():
    o = readers.jdbc_options("jdbc:x", query="SELECT 1")
    assert o == {"url": "jdbc:x", "query": "SELECT 1"}
    o = readers.jdbc_options("jdbc:x", query="SELECT * FROM t", partition_column="id", lower=0, upper=9, partitions=3)
    assert o["dbtable"] == "(SELECT * FROM t) q" and o["numPartitions"] == "3" and "query" not in o
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x")


def test_sink_round_trip(spark, tmp_path):
    df = spark.range(20).withColumn("v", F.col("id") * 0.5)
    for kind in ("csv", "json", "parquet"):
        path = write_table(df, str(tmp_path / kind), format=kind)
        assert spark.read.format(kind).option("header", True).load(path).count() == 20
    empty = write_table(df.limit(0), str(tmp_path / "none"), format="csv")
    assert spark.read.csv(empty, header=True).count() == 0


def test_config_tables(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"weights": {"lof": 0.5, "note": "x"}}))
    (tmp_path / "m.json").write_text(json.dumps({"selector_mode": "m", "allowed_sources": ["lof"], "profiles": [{"dataset": "a"}]}))
    (tmp_path / "bad.json").write_text("{")
    assert calibrated_weights(spark, str(tmp_path / "w.json")) == {"lof": 0.5}
    assert meta_profiles(spark, str(tmp_path / "m.json")) == [{"dataset": "a", "allowed_sources": ["lof"], "selector_mode": "m"}]
    assert calibrated_weights(spark, str(tmp_path / "bad.json")) == {} and meta_profiles(spark, str(tmp_path / "gone.json")) == []


def test_label_finders(spark):
    df = spark.createDataFrame([("x", "normal", 1), ("y", " Anomaly", 0)], "target string, LABEL string, y_true int")
    assert labels.find_binary_label(df) == "LABEL"
    assert labels.find_binary_label(df.drop("LABEL")) == "y_true"
    assert labels.find_binary_label(df.select("target")) is None
    assert labels.label_column(df) == "LABEL" and labels.label_column(df, "target") == "target"


def test_rare_values():
    assert labels.rare_values({"a": 100, "b": 50, "c": 2}) == ["c"]
    assert labels.rare_values({"a": 5, "b": 5}) == ["a"]
    with pytest.raises(ValueError):
        labels.rare_values({"a": 1})


def test_class_labels(spark):
    df = spark.range(100).withColumn("type", F.when(F.col("id") < 3, "c").when(F.col("id") < 40, "b").otherwise("a"))
    name, labelled = labels.find_class_label(df)
    assert name == "type" and labelled.agg(F.sum("ground_truth")).first()[0] == 3
    assert labels.find_class_label(spark.range(100).withColumn("type", F.col("id"))) is None  # too many classes
    assert labels.find_class_label(df.withColumn("type", F.lit("a"))) is None
    with pytest.raises(ValueError):
        labels.label_from_values(df, "type", ["zzz"])


def test_spike_column_and_features(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3, True)], "id long, cpu_pct double, latency_ms double, label int, flag boolean")
    assert labels.spike_column(df) == "latency_ms" and labels.spike_column(df.drop("latency_ms")) == "cpu_pct"
    assert schema.feature_columns(df, ["CPU_PCT"]) == (["latency_ms"], ["id", "cpu_pct", "label"])
    assert schema.categorical_columns(df) == []
    with pytest.raises(ValueError):
        schema.feature_columns(df.select("id", "label"))
