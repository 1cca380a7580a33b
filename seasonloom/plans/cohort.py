"""Season roll-ups, injury-risk cohorts and their rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seasonloom.functions.scalar import if_else, null_or, ratio
from seasonloom.operators.aggregate import at_largest, flag_rate, missing_share, strict_sum
from seasonloom.operators.joins import full_join, left_join, prior_year
from seasonloom.operators.windows import fill_down_seasons
from seasonloom.session import stage

STARTER_PITCHES = 75
MIN_BATTERS = 27
FIRST_YEAR = 2008

def _injured() -> Column:
    return F.col("date_surgery").isNotNull()


def season_rollup(seasons: DataFrame, starter_pitches: float = STARTER_PITCHES) -> DataFrame:
    """One row per player and season over all levels and leagues.

    The level is the one with most batters faced.  A total with a missing part
    is missing.  The role compares pitches with ``starter_pitches`` per game by
    multiplication, which needs no division: no games and no pitches is
    missing, no games but some pitches is a starter.
    """
    totals = seasons.groupBy("year", "player_id").agg(
        at_largest("level", by="batters_faced").alias("level"),
        strict_sum("games").alias("games"),
        strict_sum("batters_faced").alias("batters_faced"),
        strict_sum("pitches").alias("pitches"),
    )
    has_rate = (F.col("games") != 0) | (F.col("pitches") != 0)
    is_starter = F.col("pitches") >= starter_pitches * F.col("games")
    role = F.when(has_rate, if_else(is_starter, F.lit("starter"), F.lit("reliever")))
    return totals.withColumn("role", role)


def eligible_seasons(
    rollup: DataFrame, player: DataFrame, min_batters: int = MIN_BATTERS
) -> DataFrame:
    """Pitcher seasons that count in the denominator, with the last known role.

    The role is filled before short seasons are removed.  A roll-up has one row
    per player and season, so the fill window holds a career at most.
    """
    filled = fill_down_seasons(rollup, ["player_id"], "year", "role")
    filled = filled.where(F.col("batters_faced") >= min_batters)
    with_player = left_join(filled, player.select("player_id", "name_full", "position"), ["player_id"])
    return with_player.where(null_or("position", F.col("position") == "P"))


def _with_injuries(seasons: DataFrame, injuries: DataFrame, first_year: int) -> DataFrame:
    """Seasons and injuries of either source; amateur injuries remove the season.

    The year cut is applied on both sides of the join, where it is equivalent;
    the injury-level filter is not, and stays after it.
    """
    later = F.col("year") > first_year
    joined = full_join(
        seasons.where(later),
        injuries.where(later),
        ["year", "player_id"],
        ("_pss", "_injury"),
        left_unique=True,
    )
    kept = joined.where(null_or("level_injury", F.col("level_injury").isin("Major", "Minor")))
    return kept.withColumns(
        {
            "batters_faced": F.coalesce("batters_faced", F.lit(0)),
            "level": if_else(F.col("level_pss") == "MLB", F.lit("Majors"), F.lit("Minors")),
        }
    )


def survival_cohort(
    seasons: DataFrame,
    player: DataFrame,
    injuries: DataFrame,
    starter_pitches: float = STARTER_PITCHES,
    min_batters: int = MIN_BATTERS,
    first_year: int = FIRST_YEAR,
) -> DataFrame:
    """Player-seasons at risk with their injury and last year's pitch count.

    The roll-up is written once: it is read for the seasons and again for the
    years before them, and the two reads need different columns, so Spark would
    otherwise scan and group the raw seasons twice.
    """
    rollup = stage(season_rollup(seasons, starter_pitches), "season-rollup")
    cohort = _with_injuries(eligible_seasons(rollup, player, min_batters), injuries, first_year)
    previous = prior_year(rollup, "player_id", {"pitches": "previous_pitches"})
    return left_join(cohort, previous, ["year", "player_id"]).select(
        "year", "player_id", "name_full", "batters_faced", "role", "date_surgery", "level",
        "previous_pitches",
    )


def velo_injury_cohort(
    seasons: DataFrame,
    player: DataFrame,
    injuries: DataFrame,
    tracking: DataFrame,
    starter_pitches: float = STARTER_PITCHES,
    min_batters: int = MIN_BATTERS,
    first_year: int = FIRST_YEAR,
) -> DataFrame:
    """Player-seasons at risk with their injury and last year's fastball velocity."""
    rollup = season_rollup(seasons, starter_pitches)
    cohort = _with_injuries(eligible_seasons(rollup, player, min_batters), injuries, first_year)
    previous = prior_year(tracking, "player_id", {"fb_velo": "fb_velo"})
    return left_join(cohort, previous, ["player_id", "year"]).select(
        "year", "player_id", "name_full", "batters_faced", "role", "fb_velo", "date_surgery", "level",
        "level_pss",
    )


def injury_rate_year_level(cohort: DataFrame) -> DataFrame:
    return flag_rate(cohort, ["year", "level"], _injured())


def velo_missing_rate(velo_cohort: DataFrame, after: int = 2022) -> DataFrame:
    """Share of rows without a prior velocity, by year and season level."""
    recent = velo_cohort.where(F.col("year") > after)
    return recent.groupBy("year", "level_pss").agg(missing_share("fb_velo").alias("missing_rate"))


def baseline_cohort(
    season_files: DataFrame,
    listed: DataFrame,
    player: DataFrame,
    min_batters: int = MIN_BATTERS,
) -> DataFrame:
    """Player-seasons of the per-file summaries joined with listed surgeries.

    Here surgeries join before roles are filled, so a season known only from a
    surgery inherits the last role.  A row keeps its own role where it has one.
    A missing role is the last known one of the seasons before, or else of the
    same season; of several in one season the last in alphabetical order counts.
    The fill runs on one row per player and season.
    """
    pitchers = player.where("position = 'P'").select("player_id", "name_full")
    surgeries = listed.select(
        "year", F.col("player_id").alias("pitcher_id"), "level", "date_surgery"
    )
    keys = ["year", "pitcher_id"]
    joined = full_join(season_files, surgeries, keys)
    timeline = role_by_season(season_files, surgeries).withColumnRenamed("role", "known_role")
    timeline = fill_down_seasons(timeline, ["pitcher_id"], "year", "known_role")
    filled = left_join(joined, timeline, keys)
    with_role = filled.withColumn("role", F.coalesce("role", "known_role")).drop("known_role")
    named = with_role.join(pitchers, F.col("pitcher_id").eqNullSafe(F.col("player_id")))
    first_covered = season_files.agg(F.min("year")).scalar()
    counted = (F.col("level") == "MLB") | (F.col("batters_faced") >= min_batters)
    return named.where(counted & (F.col("year") >= first_covered)).select(
        "year", "pitcher_id", "name_full", "batters_faced", "role", "level", "date_surgery"
    )


def role_by_season(season_files: DataFrame, surgeries: DataFrame) -> DataFrame:
    """Every player-season of either source with the role its season file gives."""
    keys = ["year", "pitcher_id"]
    rows = season_files.select(*keys, "role").unionByName(
        surgeries.select(*keys), allowMissingColumns=True
    )
    return rows.groupBy(*keys).agg(F.max("role").alias("role"))


def baseline_risk(cohort: DataFrame) -> DataFrame:
    """Injury rate by year and role, ordered by role."""
    rates = flag_rate(cohort, ["year", "role"], _injured())
    return rates.select("year", "role", "count", "injury_rate").orderBy(
        F.asc_nulls_last("role"), F.asc_nulls_last("year")
    )
