"""Grouped reductions with explicit missing-value and tie rules.

All of them combine map-side, so a key that holds a large share of the rows
reaches the shuffle as a few partial results.  A minimum over text (``at_largest``)
is combined by sorting a task's rows first, as Spark hashes numbers only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seasonloom.functions.scalar import ratio


def strict_sum(name: str) -> Column:
    """Sum that is NULL as soon as one value is."""
    return F.when(F.count(name) == F.count(F.lit(1)), F.sum(name))


def at_largest(value: str, by: str) -> Column:
    """``value`` in the row with the largest ``by``.

    Missing ``by`` ranks last, yet still yields a row's value when nothing else
    is there.  Ties go to the smallest ``value``, missing last.  It is a plain
    minimum over an ordering key, so it needs no window and combines map-side.
    """
    key = F.struct(
        F.col(by).isNull().alias("no_by"),
        (-F.col(by)).alias("by"),
        F.col(value).isNull().alias("no_value"),
        F.col(value).alias("value"),
    )
    return F.min(key)["value"]


def group_count(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    """Rows per group; a missing key is a group of its own."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def missing_share(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.avg(value.isNull().cast("double"))


def flag_rate(df: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    """Counts per group with and without the flag, their total and the rate.

    A group that lacks one of the two sides has a missing, not a zero, count on
    that side, and so a missing total and rate.
    """
    counts = df.groupBy(*keys).agg(
        F.nullif(F.count_if(flag), F.lit(0)).alias("injured"),
        F.nullif(F.count_if(~flag), F.lit(0)).alias("uninjured"),
    )
    total = F.col("injured") + F.col("uninjured")
    return counts.withColumn("count", total).withColumn(
        "injury_rate", ratio(F.col("injured"), F.col("count"))
    )


def histogram(df: DataFrame, x: str, by: Sequence[str], bins: int) -> DataFrame:
    """Counts in equal bins, the first centred on the minimum and the last on the maximum.

    Bins are open on the left and closed on the right, and the range is that of
    the whole frame, not of each group.  Every group lists every bin.
    """
    groups = df.where(F.col(x).isNotNull())
    per_value = group_count(groups, *by, x)
    span = per_value.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    span = span.select(F.struct("lo", "hi")).scalar()
    binned = (
        per_value.withColumn("span", span)
        .withColumn("lo", F.col("span.lo"))
        .withColumn("range", F.col("span.hi") - F.col("lo"))
        .withColumn(
            "bin",
            F.coalesce(
                F.ceil(ratio((F.col(x) - F.col("lo")) * (bins - 1), F.col("range")) + 0.5) - 1,
                F.lit(0),
            ).cast("int"),
        )
    )
    every_bin = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    # One pass: each group carries an empty row for every bin into the sum.
    zero = binned.groupBy(*by).agg(F.max("lo").alias("lo"), F.max("range").alias("range"))
    zero = zero.select(*by, "lo", "range", every_bin.alias("bin"), F.lit(0).cast("bigint").alias("n"))
    rows = binned.select(*by, "lo", "range", "bin", "n").unionByName(zero)
    return rows.groupBy(*by, "bin").agg(
        F.max(F.col("lo") + F.col("range") * F.col("bin") / (bins - 1)).alias("center"),
        F.sum("n").alias("n"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Audit: keys that occur more than once, with their row counts."""
    return group_count(df, *keys).where("n > 1")
