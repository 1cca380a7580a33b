"""Every operator and pipeline as a query over one folder of driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seasonloom.functions import scalar
from seasonloom.operators import aggregate, joins, reshape, windows
from seasonloom.plans import cohort, injuries, pitches, survival, tracking, velocity
from seasonloom.session import apply_recommended, scratch_path, stage
from seasonloom.sources import schemas, tables
from seasonloom.sources.driver_views import DriverViews

Query = Callable[[SparkSession, str], DataFrame]

# The driver tables hold 1 to 10 pitches per pitcher and day.
STARTER_PITCHES = 2.5

_QUERIES: dict[str, Query] = {}


def _query(build: Callable[[DriverViews], DataFrame]) -> Callable[[DriverViews], DataFrame]:
    _QUERIES[build.__name__] = lambda spark, sf_dir: build(DriverViews(apply_recommended(spark), sf_dir))
    return build


def _significant(df: DataFrame) -> DataFrame:
    """Six significant digits of every number, in which two engines' sums agree."""
    numbers = [n for n, t in df.dtypes if t == "double"]
    digits = {n: F.when(F.col(n).isNotNull(), F.format_string("%.5e", n)).cast("double") for n in numbers}
    return df.withColumns(digits)


def _fit(build: Callable[[DriverViews], DataFrame]) -> Callable[[DriverViews], DataFrame]:
    """A query whose sums, logs or exponentials differ in the last digits between engines."""

    def rounded(v: DriverViews) -> DataFrame:
        return _significant(build(v))

    rounded.__name__ = build.__name__
    return _query(rounded)


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Sources and sinks


@_query
def scan_csv(v: DriverViews) -> DataFrame:
    path = scratch_path(v.spark, "majors")
    tables.write_csv(v.majors_hawkeye(), path)
    return tables.read_csv(v.spark, path, schemas.MAJORS_HAWKEYE)


@_query
def scan_csv_untyped(v: DriverViews) -> DataFrame:
    """A file of which no column is declared: whole numbers, fractions, dates, text and mixtures."""
    path = scratch_path(v.spark, "untyped")
    tables.write_csv(v.untyped(), path)
    return tables.read_csv(v.spark, path, "", infer_extra=True)


@_query
def scan_partitioned_dir(v: DriverViews) -> DataFrame:
    seasons = stage(v.season_by_file(), "season-files")
    root = scratch_path(v.spark, "season-folder")
    # A folder of calendar years: one entry per year, written from the staged rows.
    for row in seasons.select("year").distinct().toLocalIterator():
        of_year = seasons.where(F.col("year") == row.year).drop("year")
        tables.write_csv(of_year, f"{root}/{row.year}.csv")
    return tables.read_by_year(v.spark, root, schemas.SEASON_BY_FILE)


@_query
def sink_season_summary(v: DriverViews) -> DataFrame:
    path = scratch_path(v.spark, "season-summary")
    tables.write_season_summary(v.season_download(), path)
    return tables.read_csv(v.spark, path, schemas.SEASON_SUMMARY)


# Filters and scalar functions


@_query
def filter_position(v: DriverViews) -> DataFrame:
    return v.tommy_john().where("position = 'P'")


@_query
def filter_scalar_min(v: DriverViews) -> DataFrame:
    listed = _listed(v)
    first = v.season_by_file().agg(F.min("year")).scalar()
    return listed.where(F.col("year") >= first)


@_query
def player_lookup(v: DriverViews) -> DataFrame:
    return velocity.named_player(v.player(), 42)


@_query
def parse_date(v: DriverViews) -> DataFrame:
    text = F.date_format("o_orderdate", "M/d/yy")
    rows = v.table("orders").select("o_orderkey", text.alias("text"))
    parsed = rows.withColumn("parsed", scalar.parse_mdy("text"))
    return parsed.withColumn("parsed_year", F.year("parsed"))


@_query
def split_label(v: DriverViews) -> DataFrame:
    label = scalar.paste(F.col("pitcher_id").cast("string"), F.col("game_id").cast("string"), sep=":")
    labels = v.pitch().select(label.alias("pitcher_game"))
    return labels.select(
        "pitcher_game",
        scalar.label_part("pitcher_game", 0).alias("player_id"),
        scalar.label_part("pitcher_game", 1).alias("game_id"),
    )


@_query
def speed_mph(v: DriverViews) -> DataFrame:
    return v.pitch().select("play_id", scalar.fps_to_mph("release_speed").alias("release_speed_mph"))


# Joins, unions and reshapes


@_query
def left_join_player(v: DriverViews) -> DataFrame:
    rollup = cohort.season_rollup(v.season())
    return joins.left_join(rollup, v.player(), ["player_id"])


@_query
def prior_year_join(v: DriverViews) -> DataFrame:
    rollup = cohort.season_rollup(v.season())
    previous = joins.prior_year(rollup, "player_id", {"pitches": "previous_pitches"})
    return joins.left_join(rollup, previous, ["year", "player_id"])


@_query
def pitch_biomech_join(v: DriverViews) -> DataFrame:
    biomechanics = v.biomechanics().withColumn("pitch_type", F.lit("measured"))
    joined = joins.left_join(
        v.pitch(), biomechanics, [("play_id", "org_movement_id")], ("_pitch", "_biomech")
    )
    return joined.select("play_id", "pitch_type_pitch", "pitch_type_biomech", "metric")


@_query
def injury_reconcile(v: DriverViews) -> DataFrame:
    return injuries.join_injury_sources(v.reported_injury(), _listed(v))


@_query
def union_surgery_lists(v: DriverViews) -> DataFrame:
    return injuries.union_surgery_lists(v.tommy_john(), v.internal_brace())


@_query
def unpivot_metrics(v: DriverViews) -> DataFrame:
    _, minors = _tagged(v)
    return reshape.unpivot_metrics(
        minors, ["player_id", "year", "level", "vendor"], ["pitches", "fb_velo"]
    )


@_query
def pivot_vendor(v: DriverViews) -> DataFrame:
    _, minors = _tagged(v)
    return tracking.spread_by_pivot(minors, "vendor", ("he", "tm"))


@_query
def fill_role(v: DriverViews) -> DataFrame:
    return windows.fill_down(v.season_by_file(), ["pitcher_id"], ["year"], "role")


@_query
def duplicate_injuries(v: DriverViews) -> DataFrame:
    return aggregate.duplicate_keys(_injuries(v), ["player_id", "year"])


# Tracking and injuries


def _tagged(v: DriverViews) -> tuple[DataFrame, DataFrame]:
    return tracking.tagged_sources(v.majors_hawkeye(), v.minors_hawkeye(), v.minors_trackman())


def _listed(v: DriverViews) -> DataFrame:
    return injuries.listed_surgeries(v.tommy_john(), v.internal_brace())


def _injuries(v: DriverViews) -> DataFrame:
    return injuries.ucl_injuries(v.reported_injury(), v.tommy_john(), v.internal_brace())


def _tracking(v: DriverViews) -> DataFrame:
    return tracking.pitch_tracking(v.majors_hawkeye(), v.minors_hawkeye(), v.minors_trackman())


@_query
def reconcile_vendor(v: DriverViews) -> DataFrame:
    _, minors = _tagged(v)
    return tracking.reconcile_vendors(minors)


@_query
def reconcile_level(v: DriverViews) -> DataFrame:
    majors, minors = _tagged(v)
    return tracking.reconcile_levels(majors, tracking.reconcile_vendors(minors))


@_query
def pitch_tracking(v: DriverViews) -> DataFrame:
    return _tracking(v)


@_query
def listed_surgeries(v: DriverViews) -> DataFrame:
    return _listed(v)


@_query
def ucl_injury(v: DriverViews) -> DataFrame:
    return _injuries(v)


@_query
def surgeries_by_year_level(v: DriverViews) -> DataFrame:
    return injuries.surgeries_by_year_level(_listed(v))


@_query
def year_histogram(v: DriverViews) -> DataFrame:
    return injuries.surgery_histogram(_listed(v))


def _written(v: DriverViews, **frames: DataFrame) -> list[str]:
    """The frames as CSV folders, in the order given."""
    paths = []
    for name, frame in frames.items():
        paths.append(scratch_path(v.spark, name))
        tables.write_csv(frame, paths[-1])
    return paths


@_query
def pitch_tracking_csv(v: DriverViews) -> DataFrame:
    paths = _written(
        v, majors=v.majors_hawkeye(), minors_hawkeye=v.minors_hawkeye(), minors_trackman=v.minors_trackman()
    )
    return tracking.read_pitch_tracking(v.spark, *paths)


@_query
def ucl_injury_csv(v: DriverViews) -> DataFrame:
    paths = _written(
        v, reported=v.reported_injury(), tommy_john=v.tommy_john(), internal_brace=v.internal_brace()
    )
    return injuries.read_ucl_injuries(v.spark, *paths)


# Seasons and cohorts


def _staged_injuries(v: DriverViews) -> DataFrame:
    """Consolidated injuries written once: the cohort checks and joins them."""
    return stage(_injuries(v), "injuries")


def _survival_cohort(v: DriverViews) -> DataFrame:
    return cohort.survival_cohort(v.season(), v.player(), _staged_injuries(v))


def _velo_cohort(v: DriverViews) -> DataFrame:
    return cohort.velo_injury_cohort(v.season(), v.player(), _staged_injuries(v), _tracking(v))


def _baseline(v: DriverViews) -> DataFrame:
    season_files = stage(v.season_by_file(), "season-files")
    return cohort.baseline_cohort(season_files, _listed(v), v.player())


@_query
def baseline_cohort_levels(v: DriverViews) -> DataFrame:
    """The baseline cohort over season files that list a pitcher once per level."""
    season_files = stage(v.season_rows(), "season-rows")
    return cohort.baseline_cohort(season_files, _listed(v), v.player())


@_query
def season_rollup(v: DriverViews) -> DataFrame:
    return cohort.season_rollup(v.season())


@_query
def survival_cohort(v: DriverViews) -> DataFrame:
    return _survival_cohort(v)


@_query
def injury_counts(v: DriverViews) -> DataFrame:
    injured = F.col("date_surgery").isNotNull().alias("injury")
    return aggregate.group_count(_survival_cohort(v), "year", "level", injured)


@_query
def injury_rate_year_level(v: DriverViews) -> DataFrame:
    return cohort.injury_rate_year_level(_survival_cohort(v))


@_query
def velo_injury_cohort(v: DriverViews) -> DataFrame:
    return _velo_cohort(v)


@_query
def velo_missing_rate(v: DriverViews) -> DataFrame:
    # The shifted seasons end in 2014, so the last two years start after 2012.
    return cohort.velo_missing_rate(_velo_cohort(v), after=2012)


@_query
def baseline_cohort(v: DriverViews) -> DataFrame:
    return _baseline(v)


@_query
def baseline_risk(v: DriverViews) -> DataFrame:
    return cohort.baseline_risk(_baseline(v))


@_query
def baseline_risk_display(v: DriverViews) -> DataFrame:
    rates = cohort.baseline_risk(_baseline(v))
    return rates.withColumn("injury_rate", scalar.display_round("injury_rate", 3))


# Pitches


def _pitches(v: DriverViews) -> DataFrame:
    return pitches.enrich_pitches(v.pitch(), v.event(), v.game(), v.biomechanics())


def _model_data(v: DriverViews) -> DataFrame:
    joined = pitches.staged_pitches(v.pitch(), v.event(), v.game(), v.biomechanics())
    return pitches.pitch_model_data(pitches.number_pitches(joined), STARTER_PITCHES, joined)


@_query
def pitch_sequence(v: DriverViews) -> DataFrame:
    numbered = windows.running_index(
        v.pitch(), ["game_id", "pitcher_id"], ["event_index", "play_index"], "pitch_number", ["play_id"]
    )
    return numbered.select("game_id", "pitcher_id", "play_id", "pitch_number")


@_query
def pitch_enriched(v: DriverViews) -> DataFrame:
    return _pitches(v)


@_query
def pitch_enriched_csv(v: DriverViews) -> DataFrame:
    """Enrichment from files; the undeclared columns' types come from their values."""
    paths = _written(v, pitch=v.pitch(), event=v.event(), game=v.game(), biomechanics=v.biomechanics())
    return pitches.read_enriched_pitches(v.spark, *paths)


@_query
def pitch_type_counts(v: DriverViews) -> DataFrame:
    return pitches.pitch_type_counts(v.pitch())


@_query
def primary_pitch(v: DriverViews) -> DataFrame:
    return pitches.primary_pitch(v.pitch())


@_query
def starters(v: DriverViews) -> DataFrame:
    return pitches.starters(v.pitch(), STARTER_PITCHES)


@_query
def pitch_model_data(v: DriverViews) -> DataFrame:
    return _model_data(v)


# Statistical fits


def _stratum(v: DriverViews, stratum: str) -> DataFrame:
    return survival.injury_km(_survival_cohort(v), stratum)


@_fit
def km_by_role(v: DriverViews) -> DataFrame:
    return _stratum(v, "role")


@_fit
def km_by_level(v: DriverViews) -> DataFrame:
    return _stratum(v, "level")


@_query
def cox_fit(v: DriverViews) -> DataFrame:
    return _significant(survival.injury_cox(_survival_cohort(v)).table())


@_query
def cox_curve(v: DriverViews) -> DataFrame:
    return _significant(survival.injury_cox_curve(_survival_cohort(v)))


@_fit
def velo_ols_game(v: DriverViews) -> DataFrame:
    return velocity.velo_ols_game(_model_data(v))


@_query
def velo_decay_fixed(v: DriverViews) -> DataFrame:
    return velocity.velo_decay(_model_data(v)).fixed_effects()


@_query
def velo_decay_pitcher(v: DriverViews) -> DataFrame:
    return velocity.pitcher_effects(velocity.velo_decay(_model_data(v)), v.player())


@_query
def velo_decay_game(v: DriverViews) -> DataFrame:
    return velocity.game_effects(velocity.velo_decay(_model_data(v)), v.player(), v.game())


@_query
def velo_fitted(v: DriverViews) -> DataFrame:
    model_data = _model_data(v)
    effects = velocity.game_effects(velocity.velo_decay(model_data), v.player(), v.game())
    return velocity.fitted_pitches(model_data, effects)


# Covariances of the pitcher's and the game's lines, relative to the residual variance.
GIVEN_OUTER = ((0.5, -0.01), (-0.01, 0.002))
GIVEN_INNER = ((0.3, 0.005), (0.005, 0.001))


def _given(v: DriverViews, model_data: DataFrame | None = None):
    return velocity.velo_decay_at(model_data or _model_data(v), GIVEN_OUTER, GIVEN_INNER)


@_query
def velo_given_summary(v: DriverViews) -> DataFrame:
    return _significant(_given(v).summary())


@_query
def velo_given_pitcher(v: DriverViews) -> DataFrame:
    return _significant(velocity.pitcher_effects(_given(v), v.player()))


@_query
def velo_given_game(v: DriverViews) -> DataFrame:
    return _significant(velocity.game_effects(_given(v), v.player(), v.game()))


def _given_fitted(v: DriverViews, pitcher_id: int | None = None) -> DataFrame:
    model_data = stage(_model_data(v), "model-data")
    effects = velocity.game_effects(_given(v, model_data), v.player(), v.game())
    return _significant(velocity.fitted_pitches(model_data, effects, pitcher_id))


@_query
def velo_given_fitted(v: DriverViews) -> DataFrame:
    return _given_fitted(v)


@_query
def velo_given_fitted_pitcher(v: DriverViews) -> DataFrame:
    """One pitcher's observed and fitted speeds."""
    return _given_fitted(v, 7)


@_query
def velo_decay_gradient(v: DriverViews) -> DataFrame:
    """The criterion's derivative where the search ended: zero to a millionth of the criterion."""
    fit = velocity.velo_decay(_model_data(v))
    names = [f"{level}_{k}" for level in ("outer", "inner") for k in ("11", "21", "22")]
    rows = [(n, abs(round(float(d) / (1 + abs(fit.criterion)), 6))) for n, d in zip(names, fit.slope, strict=True)]
    return v.spark.createDataFrame(rows, "factor string, slope double")
