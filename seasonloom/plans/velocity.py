"""Velocity decay over a game: fixed trend, pitcher and game effects, fitted lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seasonloom.operators.joins import inner_join, left_join
from seasonloom.operators.trends import MixedFit, fit_nested_lines, lines_at, ols_by_group

SPEED, NUMBER = "release_speed_mph", "pitch_number"


def velo_ols_game(model_data: DataFrame) -> DataFrame:
    """Least-squares line of speed on pitch number per pitcher and game."""
    return ols_by_group(model_data, ["pitcher_id", "game_id"], SPEED, NUMBER)


def velo_decay(model_data: DataFrame, reml: bool = True) -> MixedFit:
    """Speed on pitch number with random lines per pitcher and per pitcher-game."""
    return fit_nested_lines(model_data, SPEED, NUMBER, "pitcher_id", "game_id", reml)


def velo_decay_at(model_data: DataFrame, outer_cov, inner_cov, reml: bool = True) -> MixedFit:
    """The same model at given covariances, relative to the residual variance."""
    return lines_at(model_data, SPEED, NUMBER, "pitcher_id", "game_id", outer_cov, inner_cov, reml)


def pitcher_effects(fit: MixedFit, player: DataFrame) -> DataFrame:
    effects = fit.outer_effects().withColumnRenamed("pitcher_id", "player_id")
    named = left_join(effects, player.select("player_id", "name_full"), ["player_id"])
    return named.select("player_id", "name_full", "intercept", "slope")


def game_effects(fit: MixedFit, player: DataFrame, game: DataFrame) -> DataFrame:
    """Pitcher-game effects, their pitcher's effects and the total line."""
    effects = fit.inner_effects().withColumnRenamed("pitcher_id", "player_id")
    dated = left_join(effects, game.select("game_id", "date"), ["game_id"])
    both = left_join(dated, pitcher_effects(fit, player), ["player_id"], ("_game", "_pitcher"))
    totals = {
        f"{part}_total": F.lit(float(fixed)) + F.col(f"{part}_pitcher") + F.col(f"{part}_game")
        for part, fixed in zip(("intercept", "slope"), fit.fixed)
    }
    return both.withColumns(totals).select(
        "player_id", "name_full", "game_id", "date", "intercept_game", "slope_game",
        "intercept_pitcher", "slope_pitcher", "intercept_total", "slope_total",
    )


def fitted_pitches(
    model_data: DataFrame, effects: DataFrame, pitcher_id: int | None = None
) -> DataFrame:
    """Observed speed and the game's fitted line, for one pitcher or for all."""
    pitches = model_data.select("pitcher_id", "game_id", NUMBER, SPEED)
    if pitcher_id is not None:
        pitches = pitches.where(F.col("pitcher_id") == pitcher_id)
    lines = effects.select("player_id", "game_id", "date", "intercept_total", "slope_total")
    rows = inner_join(pitches, lines, [("pitcher_id", "player_id"), "game_id"])
    fitted = F.col("intercept_total") + F.col("slope_total") * F.col(NUMBER)
    return rows.select("pitcher_id", "game_id", "date", NUMBER, SPEED, fitted.alias("fitted_mph"))


def named_player(player: DataFrame, player_id: int) -> DataFrame:
    """Name of one player, as rows; the filter reaches the scan."""
    return player.where(F.col("player_id") == player_id).select("name_full")


def player_name(player: DataFrame, player_id: int) -> str | None:
    row = named_player(player, player_id).first()
    return row[0] if row else None
