"""Pitch rules, fitted lines and the point lookup on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seasonloom.plans import injuries, pitches, velocity


def _pitch_rows(spark):
    rows = [(g, p, e, i, f"{g}-{p}-{e}-{i}", kind, 132.0) for g, p, e, i, kind in (
        (1, 1, 1, 2, "FF"), (1, 1, 1, 1, "FF"), (1, 1, 0, 9, "SL"), (2, 1, 5, 1, "FF"),
        (1, 2, 2, 1, "SL"), (1, 2, 2, 2, "SL"), (1, 2, 3, 1, "FF"), (None, 3, 1, 1, "SI"), (4, 3, 1, 1, "SI"),
    )]
    return spark.createDataFrame(
        rows,
        "game_id int, pitcher_id int, event_index int, play_index int, play_id string, "
        "pitch_type string, release_speed double",
    )


def test_enrichment_keeps_every_pitch(spark):
    pitch = _pitch_rows(spark)
    game = spark.createDataFrame([(1, dt.date(2024, 4, 1))], "game_id int, date date")
    event = spark.createDataFrame([(1, 1, 7)], "game_id int, event_index int, inning int")
    biomechanics = spark.createDataFrame([("1-1-1-1", "fast")], "org_movement_id string, pitch_type string")
    rows = pitches.enrich_pitches(pitch, event, game, biomechanics)
    got = {r.play_id: r for r in rows.collect()}
    assert len(got) == 9
    assert [got[k].pitch_number for k in ("1-1-0-9", "1-1-1-1", "1-1-1-2", "2-1-5-1")] == [1, 2, 3, 1]
    assert (got["1-1-1-1"].pitch_type_pitch, got["1-1-1-1"].pitch_type_biomech) == ("FF", "fast")
    assert got["1-1-1-1"].inning == 7 and got["2-1-5-1"].date is None
    assert got["1-1-1-1"].release_speed_mph == pytest.approx(132 * 0.681818)


def test_model_rows_are_starters_primary_fastballs(spark):
    pitch = _pitch_rows(spark)
    assert {tuple(r) for r in pitches.primary_pitch(pitch).collect()} == {(1, "FF"), (3, "SI")}
    starters = {r.pitcher_id: (r.pitches, r.games) for r in pitches.starters(pitch, 2).collect()}
    assert starters == {1: (4, 2), 2: (3, 1)}
    rows = pitches.pitch_model_data(pitch, 2)
    assert sorted(r.play_id for r in rows.collect()) == ["1-1-1-1", "1-1-1-2", "2-1-5-1"]
    # A missing game counts as one game.
    assert {r.pitcher_id: r.games for r in pitches.starters(pitch, 1).collect()}[3] == 2


def test_fitted_lines_and_lookup(spark):
    data = spark.createDataFrame(
        [(1, 1, 1, 90.0), (1, 1, 2, 91.0), (2, 1, 1, 88.0)],
        "pitcher_id int, game_id int, pitch_number int, release_speed_mph double",
    )
    effects = spark.createDataFrame(
        [(1, 1, dt.date(2024, 4, 1), 90.0, 0.5), (2, 1, dt.date(2024, 4, 1), 88.0, 0.0)],
        "player_id int, game_id int, date date, intercept_total double, slope_total double",
    )
    one = velocity.fitted_pitches(data, effects, pitcher_id=1).orderBy("pitch_number").collect()
    assert [r.fitted_mph for r in one] == [90.5, 91.0]
    assert velocity.fitted_pitches(data, effects).count() == 3
    player = spark.createDataFrame([(1, "one")], "player_id int, name_full string")
    assert velocity.player_name(player, 1) == "one"
    assert velocity.player_name(player, 9) is None


def test_surgery_plot_tables(spark):
    listed = spark.createDataFrame(
        [(2009, "MLB"), (2010, "MLB"), (2010, "AA"), (2011, None), (2011, "HS")], "year int, level string"
    )
    counts = {(r.year, r.level): r.n for r in injuries.surgeries_by_year_level(listed).collect()}
    assert counts == {(2010, "MLB"): 1, (2010, "Minors/Amateur"): 1, (2011, None): 1, (2011, "Minors/Amateur"): 1}
    bins = injuries.surgery_histogram(listed, bins=2)
    assert bins.count() == 6
    assert bins.agg(F.sum("n")).first()[0] == 4
