"""Which detectors run, and running them by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from oddrows.detectors.autoencoder import autoencoder
from oddrows.detectors.forest import isolation_forest
from oddrows.detectors.lstm import lstm_autoencoder
from oddrows.detectors.neighbours import knn_distance, lof
from oddrows.detectors.ocsvm import one_class_svm


class Entry(NamedTuple):
    """A detector's trainer, its needs, and the smallest table it suits."""

    run: Callable[..., DataFrame]
    needs_rows: bool
    needs_order: bool
    least_rows: int
    least_features: int


#: From how many rows and feature columns on a detector takes part.
REGISTRY = {
    "iforest": Entry(isolation_forest, True, False, 0, 0),
    "ocsvm": Entry(one_class_svm, True, False, 0, 0),
    "lof": Entry(lof, False, False, 10, 0),
    "knn_distance": Entry(knn_distance, False, False, 20, 2),
    "autoencoder": Entry(autoencoder, True, False, 51, 5),
    "lstm": Entry(lstm_autoencoder, True, True, 201, 3),
}
DETECTORS = tuple(REGISTRY)


def select_detectors(rows: int, features: int) -> list[str]:
    """Detectors suited to the table's size."""
    return [name for name, e in REGISTRY.items() if rows >= e.least_rows and features >= e.least_features]


def train(
    name: str, df: DataFrame, key: str, features: Sequence[str], rows: int, *, order_by: Sequence[str] | None = None, **params
) -> DataFrame:
    """Scores of one detector by name, in a column of that name beside the key."""
    if name not in REGISTRY:
        raise ValueError(f"unsupported detector {name!r}")
    e = REGISTRY[name]
    order = [order_by or [key]] if e.needs_order else []
    return e.run(df, key, features, *order, *([rows] if e.needs_rows else []), **params).select(key, name)
