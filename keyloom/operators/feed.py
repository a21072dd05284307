"""Change feed: keys that pushes touched in a range of versions, and shipping their absolute values to another table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .push import overwrite


def changed(log: DataFrame, table: DataFrame, keys: list[str], after: int, upto: int) -> DataFrame:
    """Current rows of the keys that the log (keys, version) has in (after, upto]; erased keys are not fed."""
    touched = log.where((F.col("version") > after) & (F.col("version") <= upto)).select(*keys).distinct()
    return table.join(touched, keys, "left_semi")


def apply(target: DataFrame, rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The target after taking the rows' values; taking them again changes nothing."""
    return overwrite(target, rows, keys, values)
