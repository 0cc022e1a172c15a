"""Ensemble weights and meta profiles: JSON files read as tables.

A file that is missing or cannot be read gives an empty table. In a folder every file counts.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One profile; fields that a file leaves out are null.
PROFILE = (
    "dataset string, sample_count long, feature_count long, missing_rate double, sparsity_zero_rate double, correlation_abs_mean double, "
    "high_corr_pair_count long, threshold_strategy string, feature_vector array<double>, selected_source string, selected_metric string, "
    "selected_score double, source_roc_auc double, source_pr_auc double, evaluated_rows long, expected_contamination double, "
    "allowed_sources array<string>, selector_mode string"
)
#: A profile file: its own fields are the defaults of each profile's.
DOCUMENT = f"profiles array<struct<{PROFILE.replace(' ', ':').replace(',:', ',')}>>, allowed_sources array<string>, selector_mode string, metric string"


def _texts(spark: SparkSession, path: str | None) -> DataFrame:
    """(v): the whole text of each file."""
    if path:
        try:
            texts = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
            texts.count()  # unreadable files show here
            return texts
        except (PySparkException, Py4JJavaError):
            pass
    return spark.createDataFrame([], "v string")


def weight_table(spark: SparkSession, path: str | None) -> DataFrame:
    """(score_source, weight): the numbers of a ``weights`` object, or of the file's object where it has none."""
    text = _texts(spark, path).select("v", F.get_json_object("v", "$.weights").alias("own"))
    cells = text.select(F.explode(F.from_json(F.coalesce("own", "v"), "map<string,string>")).alias("score_source", "said"))
    number = F.col("said").try_cast("double")
    return cells.select("score_source", number.alias("weight")).where(F.col("weight").isNotNull())


def calibrated_weights(spark: SparkSession, path: str | None) -> dict[str, float]:
    """``weight_table`` as a dict: one entry for each kind of detector."""
    return {r["score_source"]: r["weight"] for r in weight_table(spark, path).collect()}


def profile_table(spark: SparkSession, path: str | None) -> DataFrame:
    """One row a profile, with the columns of ``PROFILE``; a document's fields fill what its profiles leave out."""
    text = _texts(spark, path)
    whole = text.select(F.from_json("v", DOCUMENT).alias("d")).select(F.explode("d.profiles").alias("p"), "d.allowed_sources", "d.selector_mode")
    plain = text.where(F.ltrim("v").startswith("[")).select(F.explode(F.from_json("v", f"array<struct<{PROFILE.replace(' ', ':').replace(',:', ',')}>>")).alias("p"), F.lit(None).cast("array<string>").alias("allowed_sources"), F.lit(None).cast("string").alias("selector_mode"))
    fields = [f.split()[0] for f in PROFILE.split(", ")]
    filled = {"allowed_sources": F.coalesce("allowed_sources", "p.allowed_sources"), "selector_mode": F.coalesce("selector_mode", "p.selector_mode")}
    rows = whole.where(F.col("p").isNotNull()).unionByName(plain)
    return rows.select(*[filled.get(f, F.col(f"p.{f}")).alias(f) for f in fields])


def meta_profiles(spark: SparkSession, path: str | None) -> list[dict]:
    """``profile_table`` as dicts without nulls; there is one profile for each studied data set."""
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in profile_table(spark, path).collect()]


def profiles_document(profiles: DataFrame, allowed: list[str], metric: str) -> DataFrame:
    """(value): the JSON text of a profile file, ready for ``write.text``."""
    return profiles.agg(F.collect_list(F.struct(*profiles.columns)).alias("profiles")).select(
        F.to_json(F.struct(F.lit("learned_score_diagnostics").alias("selector_mode"), F.lit(metric).alias("metric"), F.array(*[F.lit(a) for a in allowed]).alias("allowed_sources"), "profiles")).alias("value")
    )
