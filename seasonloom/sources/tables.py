"""Delimited-file sources and sinks."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from seasonloom.functions.scalar import year_prefix

_SCHEME = r"^([a-z][a-z0-9+.-]*):/+"


def _scan(spark: SparkSession, paths: str | list[str], nested: bool = False) -> DataFrame:
    """Text columns named by the header; ``NA`` and empty fields are missing.

    A quoted empty field stays an empty string.  ``enforceSchema`` is off, so a
    file whose header disagrees with the others is refused, never misread.
    """
    reader = spark.read.option("header", True).option("nullValue", "NA").option("enforceSchema", False)
    return reader.option("recursiveFileLookup", nested).csv(paths)


# Kinds of a value as bits; a column's kind is the union of its values' bits.
_WHOLE, _LONG, _DOUBLE, _DATE, _TEXT = (1 << k for k in range(5))
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _kind(name: str) -> Column:
    value = F.col(name)
    return (
        F.when(value.isNull(), 0)
        .when(value.rlike("^[+-]?[0-9]+$"), F.when(value.try_cast("int").isNotNull(), _WHOLE)
              .when(value.try_cast("bigint").isNotNull(), _LONG).otherwise(_DOUBLE))
        .when(value.rlike(_NUMBER), _DOUBLE)
        .when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & value.try_cast("date").isNotNull(), _DATE)
        .otherwise(_TEXT)
    )


def _type_of(kinds: int) -> str:
    """Smallest type that holds every value; a column without values, or of mixed kinds, is text."""
    if kinds in (0, _DATE):
        return "date" if kinds else "string"
    if kinds & (_DATE | _TEXT):
        return "string"
    return "double" if kinds & _DOUBLE else "bigint" if kinds & _LONG else "int"


def inferred_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Types of text columns from all their values, in one aggregate that combines map-side."""
    if not columns:
        return {}
    kinds = df.agg(*(F.bit_or(_kind(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(columns))).first()
    return {c: _type_of(k or 0) for c, k in zip(columns, kinds, strict=True)}


def _typed(
    df: DataFrame, schema: str, keep_extra: bool, strict: bool = False, infer_extra: bool = False
) -> DataFrame:
    """Cast the declared columns; unreadable text is missing, or fails the query if ``strict``."""
    fields = StructType.fromDDL(schema).fields if schema else []
    cast = (lambda c, kind: F.col(c).cast(kind)) if strict else (lambda c, kind: F.col(c).try_cast(kind))
    declared = [
        cast(f.name, f.dataType).alias(f.name)
        if f.name in df.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in fields
    ]
    known = {f.name for f in fields}
    extra = [c for c in df.columns if c not in known] if keep_extra or infer_extra else []
    types = inferred_types(df, extra) if infer_extra else {}
    return df.select(*declared, *(F.col(f"`{c}`").cast(types.get(c, "string")).alias(c) for c in extra))


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str,
    keep_extra: bool = False,
    strict: bool = False,
    infer_extra: bool = False,
) -> DataFrame:
    """Read a CSV file or folder, taking the declared columns by header name.

    Only the header is read when the plan is built.  Columns that are neither
    declared nor used are not parsed.  ``strict`` makes text that does not read
    as its declared type an error (under ANSI casts, Spark's default) and not a
    missing value; ``keep_extra`` keeps undeclared columns as text.
    ``infer_extra`` keeps them with the smallest type that holds all their
    values (whole number, long, double, date, else text), at the price of one
    pass over them when the plan is built.
    """
    return _typed(_scan(spark, path), schema, keep_extra, strict, infer_extra)


def _entry(path: str, base: str) -> Column:
    """First component of the file path in column ``path`` below the folder ``base``."""
    # One or three slashes may follow a scheme without a host.
    plain = F.regexp_replace(path, _SCHEME, "$1:/")
    below = F.substring(plain, len(re.sub(_SCHEME, r"\1:/", base)) + 2, 1 << 30)
    return F.substring_index(below, "/", 1)


def _resolved(spark: SparkSession, root: str) -> tuple[str, str]:
    """The folder as a path, and as the escaped address that file metadata show."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = system.makeQualified(path)
    return full.toString().rstrip("/"), full.toUri().toString().rstrip("/")


def _first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The address and first line of every file of ``paths``: one job, whatever their number.

    A task sends each file's first line on and drops the rest; files come in the order of
    their blocks, so the line that starts at byte 0 is the first seen of its block.
    """
    lines = spark.read.text(paths).select(
        "_metadata.file_path", "_metadata.file_block_start", F.col("value")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            rows = []
            for k, (path, start) in enumerate(keys):
                if start == 0 and path not in seen:
                    seen.add(path)
                    rows.append(k)
            picked = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(2)], ["address", "line"])

    return lines.mapInArrow(run, "address string, line string")


def read_by_year(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Read every entry of a folder; the year is the first four characters of its name.

    An entry is a file, or a folder of part files from one writer.  Entries are
    matched by column name: those that share a header are read in one scan, so
    there are as many scans as distinct headers.  The header of each entry's
    smallest file is read up front, all of them in one job; a part file that
    disagrees with its folder is refused.  A folder without files is an error.
    """
    base, address = _resolved(spark, root)
    # Only the listing is read: the content column is pruned away.
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    visible = listing.where(~F.substring_index("path", "/", -1).rlike("^[_.]") & (F.col("length") > 0))
    smallest = F.min(F.struct("length", "path"))["path"]
    samples = visible.groupBy(_entry("path", base).alias("entry")).agg(smallest.alias("path"))
    # One short row per entry, as is every list of paths that a scan is given.
    found = samples.collect()
    entry_of = {_resolved(spark, row.path)[1]: row.entry for row in found}
    if not entry_of:
        raise FileNotFoundError(f"no season files below {root}")
    by_header: dict[str, list[str]] = defaultdict(list)
    for row in _first_lines(spark, [row.path for row in found]).collect():
        by_header[row.line].append(f"{base}/{entry_of[row.address]}")
    frames = []
    for entries in map(sorted, by_header.values()):
        rows = _scan(spark, entries, nested=True)
        year = year_prefix(_entry("_metadata.file_path", address)).alias("year")
        body = [c for c in rows.columns if c != "year"]
        frames.append(_typed(rows.select(year, *body), f"year int, {schema}", keep_extra=True))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite ``path`` with CSV part files; missing values are written empty."""
    df.write.mode("overwrite").option("header", True).csv(path)


def season_export(downloaded: DataFrame) -> DataFrame:
    """The seven season-summary columns, under their stored names."""
    return downloaded.select(
        "year",
        "level",
        "league_id",
        "player_id",
        F.col("gamesPitched").alias("games"),
        F.col("battersFaced").alias("batters_faced"),
        F.col("numberOfPitches").alias("pitches"),
    )


def write_season_summary(downloaded: DataFrame, path: str) -> None:
    write_csv(season_export(downloaded), path)
