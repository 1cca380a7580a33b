"""Missing-value, tie and skew rules on small literal frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seasonloom.functions import scalar
from seasonloom.operators import aggregate, joins, reshape, windows
from seasonloom.plans import cohort, injuries, tracking


def _values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_two_digit_years(spark):
    texts = ["09/25/74", "3/5/19", "03/05/68", "03/05/69", "03/05/2019", "junk", None, "02/30/19", " 1/2/03x"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    parsed = [r[0] for r in _values(frame, scalar.parse_mdy("text"))]
    assert parsed == [
        dt.date(1974, 9, 25), dt.date(2019, 3, 5), dt.date(2068, 3, 5), dt.date(1969, 3, 5),
        dt.date(2020, 3, 5), None, None, None, dt.date(2003, 1, 2),
    ]


def test_scalar_rules(spark):
    frame = spark.createDataFrame([(None, 0.0), ("MLB", 2.0), ("AA", 4.0)], "level string, n double")
    pick = scalar.if_else(F.col("level") == "MLB", F.lit("Majors"), F.lit("Minors"))
    assert [r[0] for r in _values(frame, pick)] == [None, "Majors", "Minors"]
    assert [r[0] for r in _values(frame, scalar.ratio(F.lit(0), F.col("n")))] == [None, 0.0, 0.0]
    assert [r[0] for r in _values(frame, ~scalar.is_in("level", ["MLB"]))] == [True, False, True]
    labels = spark.createDataFrame([("12:34",), ("x:",), ("7",), (None,)], "label string")
    parts = _values(labels, scalar.label_part("label", 0), scalar.label_part("label", 1))
    assert parts == [(12, 34), (None, None), (7, None), (None, None)]
    names = spark.createDataFrame([("2009_all.csv",), ("abcd.csv",)], "name string")
    assert [r[0] for r in _values(names, scalar.year_prefix("name"))] == [2009, None]


def _null_keys(spark):
    left = spark.createDataFrame([(1, None, "a"), (2, 5, "b")], "id int, year int, v string")
    right = spark.createDataFrame([(1, None, "x"), (3, 7, "z")], "id int, year int, v string")
    return left, right


@pytest.mark.parametrize("left_unique", [False, True])
def test_full_join_matches_missing_keys(spark, left_unique):
    left, right = _null_keys(spark)
    joined = joins.full_join(left, right, ["id", "year"], ("_l", "_r"), left_unique)
    assert joined.columns == ["id", "year", "v_l", "v_r"]
    assert set(_values(joined, "*")) == {(1, None, "a", "x"), (2, 5, "b", None), (3, 7, None, "z")}


def test_full_join_under_skew_equals_plain(spark):
    rng = random.Random(1)
    rows = lambda n, hot: [(0 if rng.random() < hot else rng.randint(1, 30), i) for i in range(n)]
    left = spark.createDataFrame(rows(60, 0.4), "k int, a int")
    right = spark.createDataFrame(rows(70, 0.4), "k int, b int")
    plain = sorted(_values(left.join(right, "k", "full"), "*"), key=str)
    split = sorted(_values(joins.full_join(left, right, ["k"]), "*"), key=str)
    assert split == plain
    assert len(plain) > 60 * 70 * 0.1


def _scans(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("left_unique", [False, True])
def test_full_join_reads_each_side_twice(spark, left_unique, tmp_path):
    rows = [(0, i) for i in range(500)] + [(i, i) for i in range(40, 60)]
    spark.createDataFrame(rows, "k int, b int").write.parquet(str(tmp_path / "hot"))
    spark.createDataFrame([(0, 1), (45, 2), (99, 3), (None, 4)], "k int, a int").write.parquet(str(tmp_path / "few"))
    left, right = (spark.read.parquet(str(tmp_path / n)) for n in ("few", "hot"))
    joined = joins.full_join(left, right, ["k"], left_unique=left_unique)
    assert _scans(joined) == 4
    assert sorted(_values(joined, "*"), key=str) == sorted(_values(left.join(right, "k", "full"), "*"), key=str)


def test_left_join_renames_and_suffixes(spark):
    left = spark.createDataFrame([("p1", 1, "FF"), (None, 2, "SI")], "play string, n int, kind string")
    right = spark.createDataFrame([("p1", "m"), (None, "w")], "move string, kind string")
    joined = joins.left_join(left, right, [("play", "move")], ("_pitch", "_biomech"))
    assert joined.columns == ["play", "n", "kind_pitch", "kind_biomech"]
    assert set(_values(joined, "play", "kind_biomech")) == {("p1", "m"), (None, "w")}


def test_prior_year_needs_consecutive_seasons(spark):
    frame = spark.createDataFrame([(1, 2010, 5), (1, 2012, 7), (1, 2013, 9)], "player_id int, year int, n int")
    previous = joins.prior_year(frame, "player_id", {"n": "before"})
    joined = joins.left_join(frame, previous, ["player_id", "year"])
    assert sorted(_values(joined, "year", "before")) == [(2010, None), (2012, None), (2013, 7)]


SEASON = "year int, player_id int, level string, games long, batters_faced long, pitches long"


def test_season_rollup_rules(spark):
    rows = [
        (2010, 1, "AA", 1, 40, 80), (2010, 1, "A", 1, 40, 80),        # tied level
        (2010, 2, "MLB", None, 10, 10), (2010, 2, "AAA", 3, 90, 300),  # missing games
        (2010, 3, "A", 0, 0, 0), (2010, 4, "A", 0, 0, 10),             # no games
        (2010, 5, "A", 2, None, 100), (2010, 5, None, 1, None, 1),     # all batters missing
        (2010, 6, "A", 1, None, 75), (2010, 6, "AA", 1, 3, 75),        # missing ranks last
    ]
    rollup = cohort.season_rollup(spark.createDataFrame(rows, SEASON))
    got = {r.player_id: (r.level, r.games, r.batters_faced, r.role) for r in rollup.collect()}
    assert got == {
        1: ("A", 2, 80, "starter"),
        2: ("AAA", None, 100, None),
        3: ("A", 0, 0, None),
        4: ("A", 0, 0, "starter"),
        5: ("A", 3, None, "reliever"),
        6: ("AA", 2, None, "starter"),
    }


def test_fill_down(spark):
    rows = [(1, 2010, None), (1, 2011, "s"), (1, 2012, None), (1, None, None), (2, 2013, None), (1, 2014, "r")]
    frame = spark.createDataFrame(rows, "id int, year int, role string")
    filled = windows.fill_down(frame, ["id"], ["year"], "role")
    assert set(_values(filled, "*")) == {
        (1, 2010, None), (1, 2011, "s"), (1, 2012, "s"), (1, 2014, "r"), (1, None, "r"), (2, 2013, None),
    }


@pytest.mark.parametrize("bits", [2, 5, 22])
def test_fill_down_where_one_key_holds_most_rows(spark, bits):
    rng = random.Random(6)
    rows = [(1 if rng.random() < 0.8 else rng.randint(2, 9), rng.randint(-40, 400), rng.choice([None, None, None, "a", "b"])) for _ in range(1500)]
    rows += [(1, 7, None)] * 300 + [(None, 3, "n"), (None, 9, None), (1, None, None), (3, None, "z"), (3, None, None)]
    frame = spark.createDataFrame(rows, "g int, p int, v string").repartition(4)
    got = sorted(_values(windows.fill_down(frame, ["g"], ["p"], "v", bits), "*"), key=str)
    expected = []
    for g in {r[0] for r in rows}:
        own, last = {}, None
        for p in sorted({r[1] for r in rows if r[0] == g}, key=lambda p: (p is None, p or 0)):
            last = max((r[2] for r in rows if r[:2] == (g, p) and r[2]), default=last)
            own[p] = last
        expected += [(g, p, v or own[p]) for h, p, v in rows if h == g]
    assert got == sorted(expected, key=str)
    with pytest.raises(TypeError):
        windows.fill_down(frame, ["g"], ["v"], "p")


def test_fill_down_of_seasons_equals_the_scan(spark):
    rows = [(k % 7, 2000 + k // 7, "s" if k % 5 == 0 else None) for k in range(70)]
    frame = spark.createDataFrame(rows, "id int, year int, role string")
    assert sorted(_values(windows.fill_down_seasons(frame, ["id"], "year", "role"), "*"), key=str) == sorted(
        _values(windows.fill_down(frame, ["id"], ["year"], "role"), "*"), key=str
    )


def test_running_index_numbers_groups_in_order(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.4 else rng.randint(1, 40), rng.randint(0, 9), i) for i in range(400)]
    rows += [(None, None, 1000 + i) for i in range(12)]
    frame = spark.createDataFrame(rows, "g int, a int, b int").repartition(5)
    got = _values(windows.running_index(frame, ["g"], ["a"], "n", ["b"]), "g", "a", "b", "n")
    expected = []
    for g in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        expected += [(*r, i) for i, r in enumerate(group, 1)]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_running_index_of_exact_copies(spark):
    frame = spark.createDataFrame([(1, 1)] * 50 + [(2, 1)] * 3, "g int, a int")
    got = _values(windows.running_index(frame, ["g"], ["a"], "n"), "g", "n")
    assert sorted(got) == [(1, i) for i in range(1, 51)] + [(2, i) for i in range(1, 4)]


@pytest.mark.parametrize("bits", [3, 16])
def test_running_totals_chunks(spark, bits):
    rows = [(g, p, (p * 7 + ord(g)) % 5) for g in "ab" for p in range(-20, 20, 2)]
    frame = spark.createDataFrame(rows, "g string, p int, v int")
    totals = windows.running_totals(frame, ["g"], "p", {"t": F.col("v")}, bits)
    expected = [(g, p, sum(v for h, q, v in rows if h == g and q <= p)) for g, p, _ in rows]
    assert sorted(_values(totals, "g", "p", "t")) == expected


def test_running_totals_of_sparse_positions_need_no_single_task(spark):
    frame = spark.range(3000).select((F.col("id") * 5000 - 7_000_000).alias("p"), F.lit(1).alias("v"))
    totals = windows.running_totals(frame, [], "p", {"t": F.col("v")}, 8)
    assert totals.where(F.col("t") != (F.col("p") + 7_000_000) / 5000 + 1).count() == 0
    far = spark.createDataFrame([(-(2**63),), (-1,), (0,), (2**63 - 1,)], "p long")
    ends = windows.running_totals(far, [], "p", {"t": F.lit(1)})
    assert sorted(_values(ends, "p", "t")) == [(-(2**63), 1), (-1, 2), (0, 3), (2**63 - 1, 4)]


def test_top_value_is_not_reranked(spark):
    counts = spark.createDataFrame(
        [(1, "SL", 5), (1, "FF", 4), (2, "SI", 3), (2, "FF", 3), (3, None, 9)], "id int, kind string, n int"
    )
    top = windows.first_ranked(counts, ["id"], "n", "kind")
    assert sorted(_values(top, "id", "kind"), key=str) == [(1, "SL"), (2, "FF"), (3, None)]


def test_flag_rate_keeps_absent_sides_missing(spark):
    frame = spark.createDataFrame([(2010, True), (2010, False), (2011, False)], "year int, hit boolean")
    rates = aggregate.flag_rate(frame, ["year"], F.col("hit"))
    assert sorted(_values(rates, "year", "injured", "uninjured", "count", "injury_rate")) == [
        (2010, 1, 1, 2, 0.5), (2011, None, 1, None, None),
    ]


def test_histogram_bins(spark):
    frame = spark.createDataFrame([(y, "a") for y in (2010, 2010, 2012, 2014)] + [(2011, "b")], "y int, g string")
    bins = {(r.g, r.bin): (r.center, r.n) for r in aggregate.histogram(frame, "y", ["g"], 5).collect()}
    assert len(bins) == 10
    assert bins["a", 0] == (2010.0, 2) and bins["a", 4] == (2014.0, 1) and bins["b", 1] == (2011.0, 1)
    assert bins["b", 4] == (2014.0, 0)
    single = frame.where("y = 2010")
    assert {(r.bin, r.n) for r in aggregate.histogram(single, "y", ["g"], 3).collect()} == {(0, 2), (1, 0), (2, 0)}


def test_stack_widens_and_fills(spark):
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    b = spark.createDataFrame([(1.5, "x")], "v double, w string")
    stacked = reshape.stack_rows(a, b)
    assert dict(stacked.dtypes) == {"k": "int", "v": "double", "w": "string"}
    assert set(_values(stacked, "k", "v", "w")) == {(1, 2.0, None), (None, 1.5, "x")}


TRACKED = "{} int, year int, TotalPitches long, PrimaryFB_Velo double"


def _tracking(spark, majors, he, tm):
    frame = lambda rows, key: spark.createDataFrame(rows, TRACKED.format(key))
    return frame(majors, "pitcher"), frame(he, "pitcher"), frame(tm, "pitcher_id")


def _source_rows(rng, players):
    return [
        (p, y, rng.choice([None, 0, 10, 40]), rng.choice([None, 90.0, 90.99, 91.0, 92.5]))
        for p in range(players) for y in (2010, 2011) if rng.random() < 0.7
    ]


def test_vendor_rules(spark):
    he = [(1, 2010, 10, 90.0), (2, 2010, 10, 90.0), (3, 2010, 10, 90.0), (4, 2010, 10, 90.0),
          (5, 2010, 0, 90.0), (6, 2010, None, 90.0), (7, 2010, 10, 90.0), (7, 2010, 30, 92.0)]
    tm = [(1, 2010, 30, 90.99), (2, 2010, 30, 91.0), (3, 2010, 30, 91.5), (5, 2010, 0, 90.5)]
    _, minors = tracking.tagged_sources(*_tracking(spark, [], he, tm))
    got = {r.player_id: (r.pitches, r.fb_velo) for r in tracking.reconcile_vendors(minors).collect()}
    assert set(got) == {1, 4, 5, 6, 7}
    assert got[1] == (40.0, pytest.approx((900 + 30 * 90.99) / 40))
    assert (got[4], got[5], got[6]) == ((10.0, 90.0), (0.0, None), (0.0, None))
    assert got[7] == (40.0, pytest.approx(91.5))


def test_vendor_grouping_holds_few_values(spark):
    # A task holds these for all its player-seasons: four a source, and the same values as before.
    he = [(1, 2010, 10, 90.0), (2, 2010, None, 91.0), (3, 2010, 0, 90.0), (3, 2010, 0, 90.5),
          (4, 2010, 10, 90.0), (4, 2010, 30, 92.0), (5, 2010, None, 90.0), (5, 2010, 20, 92.0)]
    _, minors = tracking.tagged_sources(*_tracking(spark, [], he, []))
    wide = tracking.spread_by_vendor(minors)
    assert wide._jdf.queryExecution().executedPlan().toString().count("partial_") == 8
    got = {r.player_id: (r.pitches_he, r.fb_velo_he, r.pitches_tm, r.fb_velo_tm) for r in wide.collect()}
    assert got == {
        1: (10.0, 90.0, None, None), 2: (None, 91.0, None, None), 3: (0.0, 90.25, None, None),
        4: (40.0, 91.5, None, None), 5: (20.0, 92.0, None, None),
    }


def test_fused_tracking_equals_steps(spark):
    rng = random.Random(4)
    sources = _tracking(spark, *(_source_rows(rng, 60) for _ in range(3)))
    majors, minors = tracking.tagged_sources(*sources)
    steps = tracking.reconcile_levels(majors, tracking.reconcile_vendors(minors))
    fused = tracking.pitch_tracking(*sources)
    assert sorted(_values(fused, "*"), key=str) == sorted(_values(steps, *fused.columns), key=str)
    wide = tracking.spread_by_vendor(minors)
    pivoted = tracking.spread_by_pivot(minors, "vendor", ("he", "tm"))
    assert sorted(_values(wide, *pivoted.columns), key=str) == sorted(_values(pivoted, "*"), key=str)
    assert sorted(_values(tracking.pitch_tracking(*(s.repartition(4) for s in sources)), "*"), key=str) == sorted(
        _values(fused, "*"), key=str
    )


def test_duplicates_are_added_up_by_vendor_and_refused_by_the_pivot(spark):
    he = [(1, 2010, 10, 90.0), (1, 2010, 30, 92.0), (2, 2010, 5, 91.0)]
    _, minors = tracking.tagged_sources(*_tracking(spark, [], he, [(1, 2010, 7, 88.0)]))
    wide = {r.player_id: (r.pitches_he, r.fb_velo_he, r.pitches_tm) for r in tracking.spread_by_vendor(minors).collect()}
    assert wide == {1: (40.0, pytest.approx(91.5), 7.0), 2: (5.0, 91.0, None)}
    with pytest.raises(Exception, match="several rows for pitches_he at 1 2010 minors|several rows for fb_velo_he at 1 2010 minors"):
        tracking.spread_by_pivot(minors, "vendor", ("he", "tm")).collect()
    single = tracking.spread_by_pivot(minors.where("player_id = 2"), "vendor", ("he", "tm")).collect()
    assert [(r.pitches_he, r.fb_velo_he, r.pitches_tm) for r in single] == [(5.0, 91.0, None)]


def _brute_blend(a, b, gap):
    """Volume-weighted blend of two (pitches, velocity) pairs; None where a side is absent."""
    if a and b and abs(a[1] - b[1]) >= gap:
        return None
    present = [x for x in (a, b) if x]
    volume = sum(n or 0 for n, _ in present)
    speed = sum((n or 0) * v for n, v in present) / volume if volume else None
    return (volume, speed) if present else None


def test_tracking_matches_brute_force(spark):
    rng = random.Random(9)
    sources = [_source_rows(rng, 80) for _ in range(3)]
    majors, he, tm = ({r[:2]: r[2:] for r in rows if r[3] is not None} for rows in sources)
    expected = {}
    for key in set(majors) | set(he) | set(tm):
        minors = _brute_blend(he.get(key), tm.get(key), 1)
        minors = minors if minors and minors[1] is not None else None
        total = _brute_blend(majors.get(key), minors, 2)
        if total:
            expected[key] = total
    rows = tracking.pitch_tracking(*_tracking(spark, *sources)).collect()
    assert len(rows) == len(expected) > 50
    for r in rows:
        pitches, speed = expected[r.player_id, r.year]
        assert r.pitches == pitches
        assert r.fb_velo is None if speed is None else r.fb_velo == pytest.approx(speed)


def test_injury_levels(spark):
    reported = spark.createDataFrame(
        [(1, 2019, "3/5/19", "Major"), (2, None, None, None)],
        "player_id int, year int, date_surgery string, level string",
    )
    tommy_john = spark.createDataFrame(
        [(1, "AAA", "P", "4/5/19"), (3, "Ind", "P", "4/5/20"), (4, "HS", "C", "4/5/20"), (2, "Rk", "P", "?")],
        "player_id int, level string, position string, date_surgery string",
    )
    brace = spark.createDataFrame(
        [(5, "Coll", "1/1/21")], "player_id int, level string, date_surgery string"
    )
    result = injuries.ucl_injuries(reported, tommy_john, brace)
    assert sorted(_values(result, "player_id", "year", "date_surgery", "level")) == [
        (1, 2019, dt.date(2019, 3, 5), "Major"),
        (2, None, None, "Minor"),
        (3, 2020, dt.date(2020, 4, 5), None),
        (5, 2021, dt.date(2021, 1, 1), "Amateur"),
    ]


def test_cohort_order_of_steps(spark):
    seasons = spark.createDataFrame(
        [
            (2008, 1, "MLB", 1, 30, 100), (2009, 1, "A", 1, 30, 10), (2009, 2, "MLB", 1, 5, 10),
            (2009, 3, "MLB", 1, 30, 10), (2010, 4, "AA", 0, 40, 0), (2009, 4, "AA", 1, 40, 90),
            (2010, 6, "MLB", 1, 50, 10),
        ],
        SEASON,
    )
    player = spark.createDataFrame(
        [(1, "one", "P"), (2, "two", "P"), (3, "three", "C"), (4, "four", None), (6, "six", "P")],
        "player_id int, name_full string, position string",
    )
    day = dt.date(2010, 5, 1)
    injury = spark.createDataFrame(
        [(2, 2010, day, "Minor"), (4, 2010, day, "Major"), (6, 2010, day, "Amateur"), (7, None, None, "Major")],
        "player_id int, year int, date_surgery date, level string",
    )
    rows = cohort.survival_cohort(seasons, player, injury)
    assert set(_values(rows, "year", "player_id", "name_full", "batters_faced", "role", "level", "previous_pitches")) == {
        (2009, 1, "one", 30, "reliever", "Minors", 100),
        (2010, 2, None, 0, None, None, 10),
        (2009, 4, "four", 40, "starter", "Minors", None),
        (2010, 4, "four", 40, "starter", "Minors", 90),
    }


def test_baseline_fills_role_after_the_join(spark):
    seasons = spark.createDataFrame(
        [(2010, 1, 40, "starter"), (2011, 1, 40, None), (2010, 2, 5, "reliever")],
        "year int, pitcher_id int, batters_faced long, role string",
    )
    listed = spark.createDataFrame(
        [(1, "MLB", dt.date(2012, 1, 1), "tommy_john", 2012), (1, "AA", dt.date(2013, 1, 1), "tommy_john", 2013),
         (2, None, None, "tommy_john", 2010), (3, "MLB", dt.date(2009, 1, 1), "tommy_john", 2009)],
        "player_id int, level string, date_surgery date, surgery string, year int",
    )
    player = spark.createDataFrame(
        [(1, "one", "P"), (2, "two", "P"), (3, "three", "P")], "player_id int, name_full string, position string"
    )
    rows = cohort.baseline_cohort(seasons, listed, player)
    assert set(_values(rows, "year", "pitcher_id", "role", "level")) == {
        (2010, 1, "starter", None), (2011, 1, "starter", None), (2012, 1, "starter", "MLB"),
    }


def test_baseline_keeps_the_roles_of_several_rows_in_a_season(spark):
    seasons = spark.createDataFrame(
        [(2010, 1, 40, "starter"), (2010, 1, 41, "reliever"), (2011, 1, 40, None)],
        "year int, pitcher_id int, batters_faced long, role string",
    )
    listed = spark.createDataFrame([], "player_id int, level string, date_surgery date, surgery string, year int")
    player = spark.createDataFrame([(1, "one", "P")], "player_id int, name_full string, position string")
    rows = cohort.baseline_cohort(seasons, listed, player)
    assert set(_values(rows, "year", "batters_faced", "role")) == {
        (2010, 40, "starter"), (2010, 41, "reliever"), (2011, 40, "starter"),
    }
