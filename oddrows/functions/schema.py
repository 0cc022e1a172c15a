"""Column roles decided from the schema alone: no data pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that are never features.
RESERVED_NAMES = (
    "id", "index", "row_id", "label", "target", "ground_truth", "y_true",
    "is_anomaly", "anomaly", "class", "digit", "glass_type",
)


def norm(name: str) -> str:
    return name.strip().lower()


def quoted(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    """Number-typed columns; booleans are not numbers here."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Columns that are neither numbers nor booleans nor nested."""
    nested = (T.NumericType, T.BooleanType, T.ArrayType, T.MapType, T.StructType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def feature_columns(df: DataFrame, exclude: list[str] | None = None) -> tuple[list[str], list[str]]:
    """(kept, ignored) numeric columns after dropping reserved and excluded names."""
    banned = set(RESERVED_NAMES) | {norm(c) for c in exclude or []}
    numeric = numeric_columns(df)
    kept = [c for c in numeric if norm(c) not in banned]
    if not kept:
        raise ValueError("no numeric feature column is left after excluding label and id columns")
    return kept, [c for c in numeric if norm(c) in banned]


def resolve_columns(df: DataFrame, requested: list[str] | None, numeric_only: bool) -> list[str]:
    """Requested columns that exist (and are numeric when asked), else all of them."""
    pool = numeric_columns(df) if numeric_only else df.columns
    return [c for c in (requested or pool) if c in pool]


def find_by_name(df: DataFrame, names: list[str] | tuple[str, ...], explicit: str | None = None) -> str | None:
    """First column whose trimmed lower-case name is listed; an explicit existing name wins."""
    if explicit and explicit in df.columns:
        return explicit
    by_name = {norm(c): c for c in df.columns}
    return next((by_name[n] for n in names if n in by_name), None)


def promote_integers(df: DataFrame, cols: list[str]) -> DataFrame:
    """Integer and decimal columns become double so that real-valued updates fit."""
    types = {f.name: f.dataType for f in df.schema.fields}
    exact = (T.IntegralType, T.DecimalType)
    return df.withColumns({c: quoted(c).cast("double") for c in cols if isinstance(types[c], exact)})


def drop_present(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number(name: str) -> Column:
    """Numeric column as double with NaN turned into null."""
    value = f"CAST({_tick(name)} AS DOUBLE)"
    return F.expr(f"IF(isnan({value}), NULL, {value})")


def finite(name: str) -> Column:
    """Numeric column as double with NaN and infinities turned into null."""
    value = f"CAST({_tick(name)} AS DOUBLE)"
    return F.expr(f"IF(isnan({value}) OR abs({value}) = double('Infinity'), NULL, {value})")
