"""Table sinks: a folder of part files, never one file through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, *, format: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """Write all rows as parquet, csv (with header) or json and return the folder."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer.option("header", True).csv(path)
    elif format == "json":
        writer.json(path)
    elif format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {format!r}")
    return path
