"""Flatten nested study documents with a mapping sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.paths import value_from_paths


def flatten(studies: DataFrame, mapping: dict[str, str], keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """The whole mapping as one compiled projection (columns pruned by Catalyst)."""
    return studies.select(*keep, *[value_from_paths(studies.schema, p).alias(v) for v, p in mapping.items()])
