"""Ordered operators: running index, fill-down, first-ranked row, running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from seasonloom.operators.joins import left_join

# Chunks per chunk of the next level of a running total, as a power of two.  Three
# levels of 2^22 hold all 64-bit positions.
CHUNK_BITS = 22


def running_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, ties: Sequence[str] = ()
) -> DataFrame:
    """Number the rows of each group from 1 in the given order, missing last.

    Rows that ``order`` leaves tied follow ``ties``; rows tied there too are
    numbered in any order.  The first order column holds whole numbers.  A
    window spans the rows of one group and one value of it, and the number of
    rows at smaller values is added (``running_totals``), so a group may be of
    any size.  The plan reads ``df`` twice and runs nothing by itself.
    """
    first = order[0]
    if not isinstance(df.schema[first].dataType, IntegralType):
        raise TypeError(f"the first order column {first!r} must have a whole-number type")
    numbered = _index_in_window(df, [*keys, first], [*order[1:], *ties], name)
    # Missing values come last: after every whole number.
    position = F.coalesce(F.col(first).cast("bigint"), F.lit(2**63 - 1)).alias("__position")
    counts = df.groupBy(*keys, first).agg(F.count(F.lit(1)).alias("__rows"))
    counts = counts.select("*", position)
    upto = running_totals(counts, keys, "__position", {"__upto": F.col("__rows")})
    before = upto.select(*keys, first, (F.col("__upto") - F.col("__rows")).alias("__before"))
    joined = left_join(numbered, before, [*keys, first])
    return joined.withColumn(name, F.col(name) + F.col("__before")).drop("__before")


def _ascending(order: Sequence[str]) -> list[Column]:
    return [F.asc_nulls_last(c) for c in order]


def _index_in_window(df: DataFrame, keys, order, name: str) -> DataFrame:
    within = Window.partitionBy(*keys).orderBy(*(_ascending(order) or [F.lit(1)]))
    return df.withColumn(name, F.row_number().over(within).cast("bigint"))


def fill_down(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, bits: int = CHUNK_BITS
) -> DataFrame:
    """Carry the last present value forward within each group, missing order last.

    A missing value takes the last one present at a smaller position; failing
    that, or before it, one present at its own position, of several the largest.
    ``order`` is one column of whole numbers.

    Groups may be of any size, and any number of rows may share a position.  Rows
    are first reduced to one value per position, map-side.  Positions are scanned
    in chunks of 2^bits, as in ``running_totals``, with "the last one present" in
    place of a sum: inside a chunk, and over the last values of the chunks before
    it, level by level.  No window spans more than 2^bits positions.
    """
    (order,) = order
    if not isinstance(df.schema[order].dataType, IntegralType):
        raise TypeError(f"the order column {order!r} must have a whole-number type")
    own = df.groupBy(*keys, order).agg(F.max(column).alias("__own"))
    position = F.coalesce(F.col(order).cast("bigint"), F.lit(2**63 - 1))
    levels = -(-64 // bits)
    chunks = [F.shiftright(position, bits * k).alias(f"__c{k}") for k in range(1, levels)]
    rows = own.select(*keys, order, "__own", position.alias("__position"), *chunks)

    carried = None
    for k in range(levels - 1, 0, -1):
        above = [f"__c{j}" for j in range(k + 1, levels)]
        present = F.when(F.col("__own").isNotNull(), F.struct("__position", "__own"))
        last = rows.groupBy(*keys, *above, f"__c{k}").agg(F.max(present)["__own"].alias("__last"))
        before = Window.partitionBy(*keys, *above).orderBy(f"__c{k}").rowsBetween(Window.unboundedPreceding, -1)
        level = last.withColumn("__before", F.last("__last", ignorenulls=True).over(before)).drop("__last")
        if carried is not None:
            outer = carried.withColumnRenamed("__before", "__outer")
            level = left_join(level, outer, [*keys, *above])
            level = level.withColumn("__before", F.coalesce("__before", "__outer")).drop("__outer")
        carried = level

    names = [f"__c{k}" for k in range(1, levels)]
    upto = Window.partitionBy(*keys, *names).orderBy("__position").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("__inside", F.last("__own", ignorenulls=True).over(upto))
    joined = left_join(inside, carried, [*keys, *names])
    known = joined.select(*keys, order, F.coalesce("__own", "__inside", "__before").alias("__known"))
    filled = left_join(df, known, [*keys, order])
    return filled.withColumn(column, F.coalesce(column, "__known")).drop("__known")


def fill_down_seasons(df: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """``fill_down`` for a frame that a grouping by (keys, order) made, in one window.

    A group then holds a row per season, a career at most.
    """
    upto = (
        Window.partitionBy(*keys)
        .orderBy(F.asc_nulls_last(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumn(column, F.last(column, ignorenulls=True).over(upto))


def first_ranked(df: DataFrame, keys: Sequence[str], size: str, value: str) -> DataFrame:
    """The ``value`` with the largest ``size`` in each group.

    Ties go to the smallest value, missing last.  A minimum over an ordering
    key needs no window, and combines map-side.
    """
    rank = F.struct(
        (-F.col(size)).alias("size"),
        F.col(value).isNull().alias("no_value"),
        F.col(value).alias("value"),
    )
    return df.groupBy(*keys).agg(F.min(rank)["value"].alias(value))


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    position: str,
    totals: dict[str, Column],
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Inclusive running sums over a whole-number position within each group.

    ``df`` holds each (group, position) once.  Positions are cut into chunks of
    2^bits, chunks into chunks of chunks, and so on up to the whole range of
    64-bit numbers.  Sums run inside a chunk; each level adds the sum of the
    chunks before it in its own chunk.  So no task sorts more than 2^bits rows
    of a group, dense or sparse, and one group needs no more than many.
    """
    names = list(totals)
    levels = -(-64 // bits)
    top = levels - 1
    chunk = lambda k: F.shiftright(F.col(position).cast("bigint"), bits * k)
    # A shift keeps the sign, so chunks are ordered like their positions.
    rows = df.select(
        "*", *(expr.alias(n) for n, expr in totals.items()), *(chunk(k).alias(f"__c{k}") for k in range(1, levels))
    )

    shifts = None
    for k in range(top, 0, -1):
        above = [f"__c{j}" for j in range(k + 1, levels)]
        sums = rows.groupBy(*by, *above, f"__c{k}").agg(*(F.sum(n).alias(n) for n in names))
        before = Window.partitionBy(*by, *above).orderBy(f"__c{k}").rowsBetween(Window.unboundedPreceding, -1)
        own = {f"__b_{n}": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in names}
        level = sums.withColumns(own).drop(*names)
        if shifts is not None:
            outer = shifts.withColumnsRenamed({f"__b_{n}": f"__o_{n}" for n in names})
            level = left_join(level, outer, [*by, *above])
            level = level.withColumns({f"__b_{n}": F.col(f"__b_{n}") + F.col(f"__o_{n}") for n in names})
            level = level.drop(*(f"__o_{n}" for n in names))
        shifts = level

    chunks = [f"__c{k}" for k in range(1, levels)]
    inside = (
        Window.partitionBy(*by, *chunks)
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.withColumns({n: F.sum(n).over(inside) for n in names})
    joined = left_join(local, shifts, [*by, *chunks])
    summed = {n: F.col(n) + F.col(f"__b_{n}") for n in names}
    return joined.withColumns(summed).drop(*chunks, *(f"__b_{n}" for n in names))
