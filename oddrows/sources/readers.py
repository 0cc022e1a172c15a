"""Scans of the formats the library accepts; each returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.functions.schema import quoted

# Texts read as missing.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Column layouts of the public headerless files.
LAYOUTS: dict[str, str] = {
    "glass": "id long, ri double, na double, mg double, al double, si double, k double, ca double, ba double, fe double, glass_type long",
    "pendigits": ", ".join(f"f{i} long" for i in range(16)) + ", digit long",
    "ionosphere": ", ".join(f"f{i} double" for i in range(34)) + ", label string",
    "wdbc": "id long, diagnosis string, " + ", ".join(f"f{i} double" for i in range(30)),
    "wine": "wine_class long, " + ", ".join(f"f{i} double" for i in range(13)),
}
WHITESPACE_LAYOUTS: dict[str, str] = {
    "ecoli": "sequence_name string, mcg double, gvh double, lip double, chg double, aac double, alm1 double, alm2 double, site string",
    "yeast": "sequence_name string, mcg double, gvh double, alm double, mit double, erl double, pox double, vac double, nuc double, site string",
}


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header row; timestamps stay text.

    Without a schema every column is read as text once and a column becomes long or double
    when all its present values parse as such, so missing-value texts never force a column
    to text. Give a schema for large files: it saves that pass.
    """
    if schema is not None:
        return spark.read.csv(path, header=True, schema=schema)
    text = spark.read.csv(path, header=True)
    present = {c: F.when(~F.trim(quoted(c)).isin(*MISSING_TEXTS), quoted(c)) for c in text.columns}
    aggs = []
    for i, c in enumerate(text.columns):
        value = present[c]
        aggs += [
            F.count(value).alias(f"n{i}"), F.count(F.trim(value).try_cast("double")).alias(f"d{i}"),
            F.count(F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("long"))).alias(f"l{i}"),
            F.count_if(F.lower(F.trim(value)).isin("true", "false")).alias(f"b{i}"),
        ]
    row = text.agg(*aggs).first()

    def typed(i: int, c: str):
        n = row[f"n{i}"]
        if n and row[f"l{i}"] == n:
            return F.trim(present[c]).cast("long")
        if row[f"d{i}"] == n:
            return F.trim(present[c]).cast("double")
        if row[f"b{i}"] == n:
            return F.trim(present[c]).cast("boolean")
        return present[c]

    return text.select(*[typed(i, c).alias(c) for i, c in enumerate(text.columns)])


def read_json_records(spark: SparkSession, path: str, *, multiline: bool | None = None) -> DataFrame:
    """Records from JSON documents: a list of records, or ``{"data": [...]}`` unwrapped.

    Files of one document a line are split over tasks. A document over several lines needs ``multiline=True``, which reads
    a file in one task; without a choice it is taken only where lines are not documents.
    """
    df = spark.read.json(path, multiLine=bool(multiline))
    if multiline is None and "_corrupt_record" in df.columns:
        df = spark.read.json(path, multiLine=True)
    fields = {f.name: f.dataType for f in df.schema.fields}
    data = fields.get("data")
    if isinstance(data, T.ArrayType) and isinstance(data.elementType, T.StructType):
        return df.select(F.inline("data"))
    return df


def read_jdbc(
    spark: SparkSession, url: str, *, query: str | None = None, table: str | None = None, driver: str | None = None,
    partition_column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int | None = None,
    **options: str,
) -> DataFrame:
    """Rows of one SQL query, or of a table read in parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(**jdbc_options(
        url, query=query, table=table, driver=driver, partition_column=partition_column,
        lower=lower, upper=upper, partitions=partitions, **options))
    return reader.load()


def jdbc_options(
    url: str, *, query: str | None = None, table: str | None = None, driver: str | None = None,
    partition_column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int | None = None,
    **options: str,
) -> dict[str, str]:
    if (query is None) == (table is None):
        raise ValueError("give either query or table")
    out = {"url": url, **options}
    if driver:
        out["driver"] = driver
    if partition_column is None:
        out["query" if query else "dbtable"] = query or table
        return out
    # Spark partitions only the table form; a query becomes a derived table.
    out["dbtable"] = table if table else f"({query}) q"
    out.update(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions))
    return out


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Comma file without a header, under the caller's names; a wrong column count is an error."""
    wanted = len(T.StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields)
    found = len(spark.read.csv(path, header=False).columns)
    if found != wanted:
        raise ValueError(f"expected {wanted} columns, found {found}")
    return spark.read.csv(path, schema=schema, header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_whitespace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fields split by runs of whitespace; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    fields = T.StructType.fromDDL(schema).fields
    return parts.select(*[F.col("p").getItem(i).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def load(spark: SparkSession, source: DataFrame | str | dict) -> DataFrame:
    """A DataFrame as it is, a csv/json/parquet path, or a ``{"type": "json"|"jdbc", ...}`` description."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        lower = source.lower()
        if lower.endswith(".csv"):
            return read_csv(spark, source)
        if lower.endswith(".json"):
            return read_json_records(spark, source)
        if lower.endswith(".parquet"):
            return spark.read.parquet(source)
    if isinstance(source, dict):
        options: Sequence = {k: v for k, v in source.items() if k != "type"}
        if source.get("type") == "json":
            return read_json_records(spark, **options)
        if source.get("type") == "jdbc":
            return read_jdbc(spark, **options)
    raise ValueError("unsupported input source")


def rename_label(df: DataFrame, column: str = "class", name: str = "ground_truth") -> DataFrame:
    """Rename the label column on ingest when it is there."""
    return df.withColumnRenamed(column, name) if column in df.columns else df


def label_not_equal(df: DataFrame, column: str = "labels", normal: str = "normal.", name: str = "ground_truth") -> DataFrame:
    """1 where the text label is anything but the normal value; the text column is dropped."""
    if column not in df.columns:
        raise ValueError(f"expected a column {column!r}")
    return df.withColumn(name, F.coalesce(quoted(column) != normal, F.lit(True)).cast("int")).drop(column)
