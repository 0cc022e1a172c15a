"""Readers, writers and configuration tables."""

from oddrows.sources.config import calibrated_weights, meta_profiles
from oddrows.sources.readers import (
    load, read_csv, read_delimited, read_jdbc, read_json_records, read_whitespace,
)
from oddrows.sources.sinks import write_table

__all__ = [
    "calibrated_weights", "load", "meta_profiles", "read_csv", "read_delimited", "read_jdbc",
    "read_json_records", "read_whitespace", "write_table",
]
