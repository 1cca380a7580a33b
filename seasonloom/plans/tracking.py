"""One row per player and season from three pitch-tracking sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seasonloom.functions.scalar import paste, ratio, within
from seasonloom.operators.reshape import pivot_metrics, stack_rows, unpivot_metrics
from seasonloom.sources import schemas
from seasonloom.sources.tables import read_csv

# Largest accepted velocity gap in mph, exclusive: between vendors, then levels.
VENDOR_GAP = 1.0
LEVEL_GAP = 2.0


def tag_source(df: DataFrame, player: str, level: str, vendor: str | None = None) -> DataFrame:
    """Common column names plus the source's level and, for the minors, vendor."""
    vendor_tag = [F.lit(vendor).alias("vendor")] if vendor else []
    return df.select(
        F.col(player).alias("player_id"),
        "year",
        F.lit(level).alias("level"),
        *vendor_tag,
        F.col("TotalPitches").alias("pitches"),
        F.col("PrimaryFB_Velo").alias("fb_velo"),
    )


def tagged_sources(
    majors: DataFrame, minors_hawkeye: DataFrame, minors_trackman: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Majors rows, and minors rows of both vendors; rows without a velocity are dropped."""
    minors = stack_rows(
        tag_source(minors_hawkeye, "pitcher", "minors", "he"),
        tag_source(minors_trackman, "pitcher_id", "minors", "tm"),
    )
    tagged = tag_source(majors, "pitcher", "majors")
    return tagged.where("fb_velo is not null"), minors.where("fb_velo is not null")


def _source_columns(source: Column, tag: str) -> list[Column]:
    """Volume and velocity of one source within a player-season group.

    One row per source is expected and passes through untouched.  Duplicates
    add up their pitches and average their velocity by volume.  Everything comes
    from four aggregates a source, as a task holds them for all its player-seasons.
    """
    velo = F.when(source, F.col("fb_velo"))
    pitches = F.sum(F.when(source, F.col("pitches")))
    volume, rows = F.coalesce(pitches, F.lit(0)), F.count(velo)
    # The only velocity, or the sum of several.
    total = F.sum(velo)
    weight = F.coalesce(F.col("pitches"), F.lit(0))
    return [
        pitches.cast("double").alias(f"pitches_{tag}"),
        F.when(rows == 1, total)
        .when(volume > 0, F.sum(weight * velo) / volume)
        .otherwise(F.try_divide(total, rows))
        .alias(f"fb_velo_{tag}"),
    ]


def _blend(a: str, b: str) -> dict[str, Column]:
    """Total volume and volume-weighted velocity of two sources."""
    n_a, n_b = (F.coalesce(F.col(f"pitches_{t}"), F.lit(0.0)) for t in (a, b))
    v_a, v_b = (F.coalesce(F.col(f"fb_velo_{t}"), F.lit(0.0)) for t in (a, b))
    return {"pitches": n_a + n_b, "fb_velo": ratio(n_a * v_a + n_b * v_b, n_a + n_b)}


def spread_by_vendor(minors: DataFrame) -> DataFrame:
    """Minors measures side by side, one row per player, season and level.

    Same result as the unpivot, name and pivot route, in one grouping, where a
    player and season has one row per vendor.  Several rows of one vendor are
    added up here; the pivot route refuses them.
    """
    he, tm = (F.col("vendor") == v for v in ("he", "tm"))
    return minors.groupBy("player_id", "year", "level").agg(
        *_source_columns(he, "he"), *_source_columns(tm, "tm")
    )


def spread_by_pivot(rows: DataFrame, tag: str, tags: tuple[str, str]) -> DataFrame:
    """The same spread through explicit unpivot and pivot operators; duplicates are an error."""
    ids = [c for c in rows.columns if c not in ("pitches", "fb_velo")]
    long = unpivot_metrics(rows, ids, ["pitches", "fb_velo"])
    long = long.withColumn("name", paste("name", tag)).drop(tag)
    names = [f"{metric}_{t}" for metric in ("pitches", "fb_velo") for t in tags]
    return pivot_metrics(long, [c for c in ids if c != tag], names)


def reconcile_vendors(minors: DataFrame, gap: float = VENDOR_GAP) -> DataFrame:
    """Blend the two minors vendors; a player-season on which they disagree is dropped."""
    wide = spread_by_vendor(minors).where(within("fb_velo_he", "fb_velo_tm", gap))
    blend = _blend("he", "tm")
    return wide.select("player_id", "year", "level", *(e.alias(n) for n, e in blend.items()))


def spread_by_level(majors: DataFrame, minors: DataFrame) -> DataFrame:
    rows = stack_rows(majors, minors).where("fb_velo is not null")
    is_majors, is_minors = (F.col("level") == v for v in ("majors", "minors"))
    return rows.groupBy("player_id", "year").agg(
        *_source_columns(is_majors, "majors"), *_source_columns(is_minors, "minors")
    )


def reconcile_levels(majors: DataFrame, minors: DataFrame, gap: float = LEVEL_GAP) -> DataFrame:
    """Blend majors with reconciled minors; disagreeing player-seasons are dropped."""
    wide = spread_by_level(majors, minors).where(within("fb_velo_majors", "fb_velo_minors", gap))
    blend = _blend("majors", "minors")
    return wide.select("player_id", "year", *(e.alias(n) for n, e in blend.items()))


def pitch_tracking(
    majors: DataFrame,
    minors_hawkeye: DataFrame,
    minors_trackman: DataFrame,
    vendor_gap: float = VENDOR_GAP,
    level_gap: float = LEVEL_GAP,
) -> DataFrame:
    """Consolidated (player_id, year, pitches, fb_velo).

    ``reconcile_vendors`` followed by ``reconcile_levels``, fused: all sources
    share the grouping key, so one shuffle brings a player-season together and
    both reconciliation steps are column arithmetic on the grouped row.
    """
    major_rows, minor_rows = tagged_sources(majors, minors_hawkeye, minors_trackman)
    rows = stack_rows(major_rows, minor_rows)
    source = F.coalesce("vendor", "level")
    tags = {"he": "he", "tm": "tm", "majors": "majors"}
    wide = rows.groupBy("player_id", "year").agg(
        *(c for tag, value in tags.items() for c in _source_columns(source == value, tag))
    )

    # Minors survive when a vendor has them, the vendors agree and any weight is left.
    blend = _blend("he", "tm")
    usable = within("fb_velo_he", "fb_velo_tm", vendor_gap) & blend["fb_velo"].isNotNull()
    wide = wide.withColumns({f"{n}_minors": F.when(usable, e) for n, e in blend.items()})

    agreed = wide.where(
        (F.col("fb_velo_majors").isNotNull() | F.col("fb_velo_minors").isNotNull())
        & within("fb_velo_majors", "fb_velo_minors", level_gap)
    )
    blend = _blend("majors", "minors")
    return agreed.select("player_id", "year", *(e.alias(n) for n, e in blend.items()))


def read_pitch_tracking(
    spark: SparkSession, majors_hawkeye: str, minors_hawkeye: str, minors_trackman: str
) -> DataFrame:
    """``pitch_tracking`` over three CSV paths."""
    return pitch_tracking(
        read_csv(spark, majors_hawkeye, schemas.MAJORS_HAWKEYE),
        read_csv(spark, minors_hawkeye, schemas.MINORS_HAWKEYE),
        read_csv(spark, minors_trackman, schemas.MINORS_TRACKMAN),
    )
