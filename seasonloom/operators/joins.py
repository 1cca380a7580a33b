"""Equi-joins in which missing keys match each other.

Spark plans ``<=>`` on equi-keys as an ordinary hash or sort-merge join.  Name
collisions outside the keys get a suffix from each side, and key columns keep
the left side's names.  No broadcast is hinted: Spark picks one from measured
sizes below ``spark.sql.autoBroadcastJoinThreshold``, and adaptive execution
splits skewed partitions of the preserved side otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

Keys = Sequence[str | tuple[str, str]]

_RIGHT = "__right_"


def _pairs(on: Keys) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else k for k in on]


def _condition(pairs: list[tuple[str, str]]) -> Column:
    tests = [F.col(a).eqNullSafe(F.col(_RIGHT + b)) for a, b in pairs]
    return reduce(lambda x, y: x & y, tests)


def _prepare(left: DataFrame, right: DataFrame, on: Keys, suffixes: tuple[str, str]):
    """Rename collisions, and hide the right side's keys behind a prefix."""
    pairs = _pairs(on)
    left_keys = {a for a, _ in pairs}
    right_keys = {b for _, b in pairs}
    left_rest = [c for c in left.columns if c not in left_keys]
    right_rest = [c for c in right.columns if c not in right_keys]
    shared = set(left_rest) & set(right_rest)
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    renames = {c: c + suffixes[1] for c in shared | (set(right_rest) & left_keys)}
    renames |= {b: _RIGHT + b for b in right_keys}
    return left, right.withColumnsRenamed(renames), pairs


def _drop_right_keys(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.drop(*(_RIGHT + b for _, b in pairs))


def left_join(
    left: DataFrame, right: DataFrame, on: Keys, suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    left, right, pairs = _prepare(left, right, on, suffixes)
    return _drop_right_keys(left.join(right, _condition(pairs), "left"), pairs)


def inner_join(
    left: DataFrame, right: DataFrame, on: Keys, suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    left, right, pairs = _prepare(left, right, on, suffixes)
    return _drop_right_keys(left.join(right, _condition(pairs), "inner"), pairs)


def full_join(
    left: DataFrame,
    right: DataFrame,
    on: Keys,
    suffixes: tuple[str, str] = ("_x", "_y"),
    left_unique: bool = False,
) -> DataFrame:
    """Full outer join that stays parallel when one key holds very many rows.

    Adaptive execution never splits a skewed partition of a full outer join, so
    the rows come from two joins it can split, and each side is read twice: a
    left join gives the matched rows and the left rows without a partner, and an
    anti join against the left side's distinct keys gives the other rows of the
    right.  A key that the left side repeats is split there.  The plan is the
    same for every size and runs nothing before its result is asked for.

    ``left_unique`` says the left side holds each key once: then the left join
    runs from the right side, so that a key the right side repeats is split.
    """
    left, right, pairs = _prepare(left, right, on, suffixes)
    condition = _condition(pairs)
    left_keys = [a for a, _ in pairs]
    right_keys = [_RIGHT + b for _, b in pairs]
    rest = [c for c in left.columns if c not in left_keys]
    rest += [c for c in right.columns if c not in right_keys]

    as_left = [F.col(_RIGHT + b).alias(a) for a, b in pairs]
    if left_unique:
        left_only = left.join(right.select(*right_keys).distinct(), condition, "left_anti")
        from_right = right.join(left, condition, "left").select(*as_left, *rest)
        return from_right.unionByName(left_only, allowMissingColumns=True)
    from_left = left.join(right, condition, "left").select(*left_keys, *rest)
    right_only = right.join(left.select(*left_keys).distinct(), condition, "left_anti")
    right_only = right_only.select(*as_left, *(c for c in right_only.columns if c not in right_keys))
    return from_left.unionByName(right_only, allowMissingColumns=True)


def prior_year(df: DataFrame, key: str, columns: dict[str, str], year: str = "year") -> DataFrame:
    """Values keyed by the following season, ready to join as covariates.

    The join that follows meets strictly consecutive seasons; a gap year gives
    no match.  ``columns`` maps source names to covariate names.
    """
    values = [F.col(old).alias(new) for old, new in columns.items()]
    return df.select(key, (F.col(year) + 1).alias(year), *values)
