"""Pitch-level enrichment, sequencing and the rows a velocity model is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seasonloom.functions.scalar import fps_to_mph, ratio
from seasonloom.operators.aggregate import group_count
from seasonloom.operators.joins import inner_join, left_join
from seasonloom.operators.windows import first_ranked, running_index
from seasonloom.session import stage
from seasonloom.sources import schemas
from seasonloom.sources.tables import read_csv

STARTER_PITCHES = 75
FASTBALLS = ("FF", "SI")


def join_pitch_context(
    pitch: DataFrame, event: DataFrame, game: DataFrame, biomechanics: DataFrame
) -> DataFrame:
    """Pitches with game, event and biomechanics columns where there are any."""
    joined = left_join(pitch, game, ["game_id"])
    joined = left_join(joined, event, ["game_id", "event_index"])
    return left_join(joined, biomechanics, [("play_id", "org_movement_id")], ("_pitch", "_biomech"))


def staged_pitches(
    pitch: DataFrame, event: DataFrame, game: DataFrame, biomechanics: DataFrame
) -> DataFrame:
    """Context and speed in mph, written once: numbering reads three of its columns a second time."""
    joined = join_pitch_context(pitch, event, game, biomechanics)
    return stage(joined.withColumn("release_speed_mph", fps_to_mph("release_speed")), "pitches")


def number_pitches(joined: DataFrame) -> DataFrame:
    """Each pitch's number within its pitcher and game.

    Pitches that the joins repeat are told apart by every joined column, so
    equal numbers go to equal rows only.
    """
    keys, order = ["game_id", "pitcher_id"], ["event_index", "play_index"]
    ties = ["play_id", *(c for c in joined.columns if c not in {*keys, *order, "play_id"})]
    return running_index(joined, keys, order, "pitch_number", ties)


def enrich_pitches(
    pitch: DataFrame, event: DataFrame, game: DataFrame, biomechanics: DataFrame
) -> DataFrame:
    """Context, speed in mph, and each pitch's number; the joins run once."""
    return number_pitches(staged_pitches(pitch, event, game, biomechanics))


def read_enriched_pitches(
    spark: SparkSession, pitch: str, event: str, game: str, biomechanics: str
) -> DataFrame:
    """``enrich_pitches`` over four CSV paths; columns no schema names get the type their values have."""
    return enrich_pitches(
        read_csv(spark, pitch, schemas.PITCH, infer_extra=True),
        read_csv(spark, event, schemas.EVENT, infer_extra=True),
        read_csv(spark, game, schemas.GAME, infer_extra=True),
        read_csv(spark, biomechanics, schemas.BIOMECHANICS, infer_extra=True),
    )


def _type_game_counts(pitches: DataFrame) -> DataFrame:
    """Pitches per pitcher, type and game: the one reduction both rules start from."""
    return group_count(pitches, "pitcher_id", "pitch_type", "game_id")


def pitch_type_counts(pitches: DataFrame) -> DataFrame:
    return group_count(pitches, "pitcher_id", "pitch_type")


def primary_pitch(pitches: DataFrame) -> DataFrame:
    """Each pitcher's most-thrown pitch type, where that is a fastball.

    A pitcher whose most-thrown type is something else is dropped, not re-ranked.
    """
    counts = _type_game_counts(pitches).groupBy("pitcher_id", "pitch_type").agg(F.sum("n").alias("n"))
    top = first_ranked(counts, ["pitcher_id"], "n", "pitch_type")
    return top.where(F.col("pitch_type").isin(*FASTBALLS))


def starters(pitches: DataFrame, starter_pitches: float = STARTER_PITCHES) -> DataFrame:
    """Pitchers with enough pitches per game; a missing game counts as one game."""
    per_game = _type_game_counts(pitches).groupBy("pitcher_id", "game_id").agg(F.sum("n").alias("n"))
    totals = per_game.groupBy("pitcher_id").agg(
        F.sum("n").alias("pitches"), F.count(F.lit(1)).alias("games")
    )
    totals = totals.withColumn("pitches_per_game", ratio(F.col("pitches"), F.col("games")))
    return totals.where(F.col("pitches_per_game") >= starter_pitches)


def pitch_model_data(
    pitches: DataFrame, starter_pitches: float = STARTER_PITCHES, counted: DataFrame | None = None
) -> DataFrame:
    """Primary-fastball pitches of starters, with the starters' totals.

    Both rules are one row per pitcher, so they are joined to each other first
    and the pitches are joined once.  The type filter is repeated on the pitches,
    where it reaches the scan; Spark infers none across a null-safe key.
    ``counted`` are the same pitches before numbering, which are cheaper to count.
    """
    counted = pitches if counted is None else counted
    qualified = inner_join(primary_pitch(counted), starters(counted, starter_pitches), ["pitcher_id"])
    fastballs = pitches.where(F.col("pitch_type").isin(*FASTBALLS))
    return inner_join(fastballs, qualified, ["pitcher_id", "pitch_type"])
