"""Attach per-key values of an aggregated table to the rows of its keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import join_null_safe


def with_per_key(rows: DataFrame, table: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """``rows`` with the other columns of the ``table`` row of their key (null if there is none).

    The table may have any number of keys. It is written first, so Spark knows
    its size: a short one is broadcast and no row moves; with a long one, a key
    that holds many rows is split, as both sides are plain reads. Null is a key
    like any other, and of repeated keys one row counts.
    """
    return join_null_safe(rows, materialize(table.dropDuplicates(list(key_cols)), "per-key"), key_cols, "left")


def per_key(table: DataFrame, key_cols: Sequence[str], value: str | Column) -> Column:
    """``value`` of the ``table`` row with this row's key, from one map in a scalar
    subquery; null if there is none. Null is a key like any other. Only for a
    handful of keys: each row searches the map. ``with_per_key`` takes any number."""
    key = F.struct(*key_cols)
    entry = F.struct(key.alias("k"), (F.col(value) if isinstance(value, str) else value).alias("v"))
    return F.try_element_at(table.agg(F.map_from_entries(F.collect_list(entry))).scalar(), key)
