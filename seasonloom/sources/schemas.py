"""Declared columns of every input table; nothing is inferred from the data."""

from __future__ import annotations

MAJORS_HAWKEYE = "pitcher bigint, year int, TotalPitches bigint, PrimaryFB_Velo double"
MINORS_HAWKEYE = MAJORS_HAWKEYE
MINORS_TRACKMAN = "pitcher_id bigint, year int, TotalPitches bigint, PrimaryFB_Velo double"
TOMMY_JOHN = "player_id bigint, level string, position string, date_surgery string"
INTERNAL_BRACE = "player_id bigint, level string, date_surgery string"
REPORTED_INJURY = "player_id bigint, year int, date_surgery string, level string"
SEASON_SUMMARY = (
    "year int, level string, league_id bigint, player_id bigint, "
    "games bigint, batters_faced bigint, pitches bigint"
)
SEASON_BY_FILE = "pitcher_id bigint, batters_faced bigint, role string"
PLAYER = "player_id bigint, name_full string, position string"
PITCH = (
    "game_id bigint, event_index bigint, play_index bigint, play_id string, "
    "pitch_type string, release_speed double, pitcher_id bigint"
)
EVENT = "game_id bigint, event_index bigint"
GAME = "game_id bigint, date date"
BIOMECHANICS = "org_movement_id string"
