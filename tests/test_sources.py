"""Delimited sources, the year folder and the season sink."""

import os

import pytest

from seasonloom.session import shared_dir, stage, unstage
from seasonloom.sources import schemas, tables


def _write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_csv_missing_values_and_column_order(spark, tmp_path):
    text = 'level,extra,player_id,position,date_surgery\n"",q,1,P,3/5/19\n,NA,NA,C,NA\nAA,z,x,P,1/1/20\n'
    _write(tmp_path, "list.csv", text)
    rows = tables.read_csv(spark, str(tmp_path / "list.csv"), schemas.TOMMY_JOHN)
    assert dict(rows.dtypes)["player_id"] == "bigint"
    assert [tuple(r) for r in rows.collect()] == [
        (1, "", "P", "3/5/19"), (None, None, "C", None), (None, "AA", "P", "1/1/20"),
    ]
    kept = tables.read_csv(spark, str(tmp_path / "list.csv"), schemas.TOMMY_JOHN, keep_extra=True)
    assert [r.extra for r in kept.collect()] == ["q", None, "z"]
    lacking = tables.read_csv(spark, str(tmp_path / "list.csv"), schemas.SEASON_SUMMARY)
    assert [r.games for r in lacking.collect()] == [None, None, None]


def test_year_folder_binds_by_name(spark, tmp_path):
    root = tmp_path / "seasons"
    _write(root, "2010_all.csv", "pitcher_id,batters_faced,role\n1,30,starter\n2,NA,NA\n")
    _write(root, "2011_all.csv", "role,pitcher_id,batters_faced\nreliever,1,44\n")
    _write(root, "2012_all.csv", "pitcher_id,batters_faced,role,team\n3,9,starter,BOS\n")
    _write(root / "2013_all.csv", "part-0.csv", "pitcher_id,batters_faced,role\n4,1,reliever\n")
    rows = tables.read_by_year(spark, str(root), schemas.SEASON_BY_FILE)
    assert rows.columns[0] == "year"
    got = sorted(tuple(r) for r in rows.select("year", "pitcher_id", "batters_faced", "role", "team").collect())
    assert got == [
        (2010, 1, 30, "starter", None), (2010, 2, None, None, None), (2011, 1, 44, "reliever", None),
        (2012, 3, 9, "starter", "BOS"), (2013, 4, 1, "reliever", None),
    ]


def test_year_folder_may_repeat_its_own_name(spark, tmp_path):
    root = tmp_path / "data"
    _write(root / "2010_all.csv" / "data", "part-0.csv", "pitcher_id,batters_faced,role\n4,1,reliever\n")
    rows = tables.read_by_year(spark, str(root), schemas.SEASON_BY_FILE).collect()
    assert [(r.year, r.pitcher_id) for r in rows] == [(2010, 4)]


def test_year_folder_without_files_is_an_error(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        tables.read_by_year(spark, str(tmp_path / "none"), schemas.SEASON_BY_FILE)


def test_strict_reading_refuses_unreadable_text(spark, tmp_path):
    _write(tmp_path, "list.csv", "player_id,level,date_surgery\nx,MLB,1/1/20\n")
    path = str(tmp_path / "list.csv")
    assert tables.read_csv(spark, path, schemas.INTERNAL_BRACE).first().player_id is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_csv(spark, path, schemas.INTERNAL_BRACE, strict=True).collect()


def test_undeclared_columns_get_the_type_of_their_values(spark, tmp_path):
    columns = {
        "whole": ["1", "-2", "NA", "+3"], "long": ["1", "3000000000", "", "4"], "huge": ["1", "99999999999999999999", "2", "3"],
        "fraction": ["1.5", "NA", "2", "-.5e3"], "day": ["2020-02-29", "NA", "", "2021-01-01"], "no_day": ["2021-02-29", "2020-01-01", "NA", ""],
        "mixed": ["2020-01-01", "5", "NA", ""], "quoted": ["1", '""', "2", "3"], "text": ["a", "NA", "1", ""],
        "java": ["1d", "2f", "NaN", "Infinity"], "nothing": ["NA", "", "NA", ""], "id": ["7", "8", "9", "x"],
    }
    lines = [",".join(columns), *(",".join(c[k] for c in columns.values()) for k in range(4))]
    _write(tmp_path, "any.csv", "\n".join(lines) + "\n")
    rows = tables.read_csv(spark, str(tmp_path / "any.csv"), "id int", infer_extra=True)
    assert dict(rows.dtypes) == {
        "id": "int", "whole": "int", "long": "bigint", "huge": "double", "fraction": "double", "day": "date", "no_day": "string",
        "mixed": "string", "quoted": "string", "text": "string", "java": "string", "nothing": "string",
    }
    got = rows.collect()
    assert [r.whole for r in got] == [1, -2, None, 3] and [r.fraction for r in got] == [1.5, None, 2.0, -500.0]
    assert [str(r.day) for r in got] == ["2020-02-29", "None", "None", "2021-01-01"]
    assert [r.quoted for r in got] == ["1", "", "2", "3"] and [r.id for r in got] == [7, 8, 9, None]


def test_kinds_merge_in_any_order():
    kinds = [0, *(1 << k for k in range(5))]
    for a in kinds:
        for b in kinds:
            assert tables._type_of(a | b) == tables._type_of(b | a)
    assert [tables._type_of(k) for k in kinds] == ["string", "int", "bigint", "double", "date", "string"]
    assert tables._type_of(1 | 8) == "string" and tables._type_of(1 | 2 | 4) == "double"


def test_a_folder_of_many_entries_plans_with_few_jobs(spark, tmp_path):
    root = tmp_path / "seasons"
    headers = ["pitcher_id,batters_faced,role", "role,pitcher_id,batters_faced"]
    for k in range(300):
        _write(root, f"{1700 + k} all.csv", headers[k % 2] + "\n" + ("1,2,starter" if k % 2 == 0 else "starter,1,2") + "\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many-entries", "plan")
    rows = tables.read_by_year(spark, str(root), schemas.SEASON_BY_FILE)
    jobs = len(tracker.getJobIdsForGroup("many-entries"))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs <= 10
    assert {tuple(r) for r in rows.collect()} == {(1700 + k, 1, 2, "starter") for k in range(300)}


def test_unstage_deletes_the_files(spark):
    staged = stage(spark.range(5).toDF("id"), "probe")
    unstage(staged)
    assert not os.path.exists(staged.staged_at)


def test_folder_with_mixed_headers_is_refused(spark, tmp_path):
    root = tmp_path / "mixed"
    _write(root, "a.csv", "player_id,level,date_surgery\n1,MLB,1/1/20\n")
    _write(root, "b.csv", "level,player_id,date_surgery\nMLB,2,1/1/20\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(root), schemas.INTERNAL_BRACE).collect()


def test_season_sink_renames_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "summary")
    columns = "year int, level string, league_id long, player_id long, gamesPitched long, battersFaced long, numberOfPitches long, team string"
    for games in (3, 4):
        frame = spark.createDataFrame([(2010, "MLB", 1, 7, games, None, 55, "X")], columns)
        tables.write_season_summary(frame, path)
    rows = tables.read_csv(spark, path, schemas.SEASON_SUMMARY)
    assert [tuple(r) for r in rows.collect()] == [(2010, "MLB", 1, 7, 4, None, 55)]


def test_stage_uses_the_configured_folder(spark):
    staged = stage(spark.range(5).toDF("id"), "probe")
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert staged.count() == 5
    assert all(shared_dir(spark) in f for f in staged.inputFiles())
