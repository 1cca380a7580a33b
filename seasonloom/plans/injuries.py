"""Surgery lists, and their reconciliation with reported surgeries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seasonloom.functions.scalar import if_else, is_in, parse_mdy
from seasonloom.operators.aggregate import group_count, histogram
from seasonloom.operators.joins import full_join
from seasonloom.operators.reshape import stack_rows
from seasonloom.sources import schemas
from seasonloom.sources.tables import read_csv

# Level codes of the surgery lists, by group.
MINOR_LEVELS = ("AAA", "AA", "A+", "A", "A-", "Rk")
AMATEUR_LEVELS = ("Coll", "HS")


def union_surgery_lists(tommy_john: DataFrame, internal_brace: DataFrame) -> DataFrame:
    """Both lists tagged by procedure; only the first is restricted to pitchers."""
    return stack_rows(
        tommy_john.withColumn("surgery", F.lit("tommy_john")).where("position = 'P'"),
        internal_brace.withColumn("surgery", F.lit("internal_brace")),
    )


def listed_surgeries(tommy_john: DataFrame, internal_brace: DataFrame) -> DataFrame:
    rows = union_surgery_lists(tommy_john, internal_brace)
    rows = rows.withColumn("date_surgery", parse_mdy("date_surgery"))
    return rows.select("player_id", "level", "date_surgery", "surgery", F.year("date_surgery").alias("year"))


def join_injury_sources(reported: DataFrame, listed: DataFrame) -> DataFrame:
    """Reported and listed surgeries matched on player and year, both sides kept."""
    reported = reported.withColumn("date_surgery", parse_mdy("date_surgery"))
    return full_join(reported, listed, ["player_id", "year"], ("_reported", "_listed"))


def ucl_injuries(reported: DataFrame, tommy_john: DataFrame, internal_brace: DataFrame) -> DataFrame:
    """(player_id, year, date_surgery, level), reported values first.

    Duplicates within a player-year are kept; surgeries without a readable date
    match each other on their missing year.
    """
    both = join_injury_sources(reported, listed_surgeries(tommy_john, internal_brace))
    level = (
        F.when(F.col("level_reported").isNotNull(), F.col("level_reported"))
        .when(F.col("level_listed") == "MLB", "Major")
        .when(is_in("level_listed", MINOR_LEVELS), "Minor")
        .when(is_in("level_listed", AMATEUR_LEVELS), "Amateur")
    )
    return both.select(
        "player_id",
        "year",
        F.coalesce("date_surgery_reported", "date_surgery_listed").alias("date_surgery"),
        level.alias("level"),
    )


def read_ucl_injuries(
    spark: SparkSession, reported: str, tommy_john: str, internal_brace: str
) -> DataFrame:
    """``ucl_injuries`` over three CSV paths."""
    return ucl_injuries(
        read_csv(spark, reported, schemas.REPORTED_INJURY),
        read_csv(spark, tommy_john, schemas.TOMMY_JOHN),
        read_csv(spark, internal_brace, schemas.INTERNAL_BRACE),
    )


def _plotted(listed: DataFrame, after: int) -> DataFrame:
    level = if_else(F.col("level") == "MLB", F.lit("MLB"), F.lit("Minors/Amateur"))
    return listed.where(F.col("year") > after).withColumn("level", level)


def surgeries_by_year_level(listed: DataFrame, after: int = 2009) -> DataFrame:
    """Surgeries per year, majors against everyone else."""
    return group_count(_plotted(listed, after), "year", "level")


def surgery_histogram(listed: DataFrame, after: int = 2009, bins: int = 15) -> DataFrame:
    """Surgeries per equal-width year bin and level, empty bins included."""
    return histogram(_plotted(listed, after), "year", ["level"], bins)
