"""Survival curves and hazard ratios of the injury cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seasonloom.operators.survival import CoxFit, cox_curve, cox_fit, kaplan_meier


def _injured() -> Column:
    return F.col("date_surgery").isNotNull()


def injury_km(cohort: DataFrame, stratum: str, level: float = 0.95) -> DataFrame:
    """Injury-free curve over batters faced, per value of ``stratum``."""
    return kaplan_meier(cohort, "batters_faced", _injured(), [stratum], level)


def injury_cox(cohort: DataFrame) -> CoxFit:
    """Hazard ratios of starting (against relieving) and last year's pitches."""
    covariates = {
        "role_starter": (F.col("role") == "starter").cast("double"),
        "previous_pitches": F.col("previous_pitches").cast("double"),
    }
    return cox_fit(cohort, "batters_faced", _injured(), covariates)


def injury_cox_curve(
    cohort: DataFrame, at: dict[str, float] | None = None, level: float = 0.95
) -> DataFrame:
    return cox_curve(injury_cox(cohort), at, level)
