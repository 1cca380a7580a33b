"""Stacking, unpivoting and pivoting with fixed column sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def stack_rows(*frames: DataFrame) -> DataFrame:
    """Union by column name; absent columns are missing and numbers widen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One (name, value) row per metric; values widen to double."""
    return df.unpivot(list(ids), list(metrics), "name", "value")


def pivot_metrics(long: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Spread (name, value) rows into one column per listed name.

    One grouping with a conditional aggregate per name: no scan to discover the
    names, and the partial results combine map-side.  The same aggregate counts
    each cell's rows: a cell with several is an error that names it, when the
    result is computed, as there is no single value to put there
    (``duplicate_keys`` lists them).
    """

    def cell(name: str) -> Column:
        mine = F.col("name") == name
        several = F.concat_ws(" ", F.lit(f"several rows for {name} at"), *(F.col(i).cast("string") for i in ids))
        value = F.max(F.when(mine, F.col("value")))
        return F.when(F.count_if(mine) > 1, F.raise_error(several)).otherwise(value).alias(name)

    return long.groupBy(*ids).agg(*(cell(n) for n in names))
