"""Kaplan-Meier curves and Cox proportional hazards as Spark jobs.

Rows are first reduced to distinct times, which combines map-side; everything
ordered then runs over distinct times in bounded chunks (``running_totals``).
Times are whole numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from seasonloom.operators.windows import running_totals
from seasonloom.session import stage, unstage

# Up to so many events tied at one time are summed one by one, more by series.
TIE_BLOCK = 16
# The series hold for arguments from here on; below, at most as many terms are summed.
_SERIES_FROM = 16

# A standard error above this, per standard unit of a covariate, says that the
# likelihood keeps rising towards infinity.
EXPLODED = 100.0


def _z(level: float) -> float:
    return NormalDist().inv_cdf((1 + level) / 2)


def _require_whole(df: DataFrame, time: str) -> None:
    if not isinstance(df.schema[time].dataType, IntegralType):
        raise TypeError(f"survival time {time!r} must have a whole-number type")


def _band(log_survival: Column, std_err: Column, level: float) -> tuple[Column, Column]:
    """Confidence band on the log scale, capped at 1."""
    half = _z(level) * std_err
    return F.exp(log_survival - half), F.least(F.lit(1.0), F.exp(log_survival + half))


def _risk_sets(per_time: DataFrame, by: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Totals over all rows whose time is this one or later."""
    backwards = per_time.withColumn("backwards", -F.col("time"))
    return running_totals(backwards, by, "backwards", totals).drop("backwards")


def kaplan_meier(
    df: DataFrame, time: str, event: Column, strata: Sequence[str], level: float = 0.95
) -> DataFrame:
    """Survival step function per stratum with a log-scale confidence band.

    Rows with a missing time, event or stratum are left out.  Every distinct
    time is listed, those with censoring only too, plus a row at time 0 where
    the data have none.  Rows censored at a time are still at risk at it.  Once
    all at risk have had the event, survival is 0 and the band is missing.
    """
    _require_whole(df, time)
    strata = list(strata)
    rows = df.select(*strata, F.col(time).cast("bigint").alias("time"), event.alias("event")).dropna()
    per_time = rows.groupBy(*strata, "time").agg(
        F.count_if("event").alias("n_event"), F.count_if(~F.col("event")).alias("n_censor")
    )
    # Read several times below, and far smaller than the rows it came from.
    per_time = stage(per_time, "survival-times")
    at_risk = _risk_sets(per_time, strata, {"n_risk": F.col("n_event") + F.col("n_censor")})

    d, n = F.col("n_event"), F.col("n_risk")
    survives = d < n
    steps = running_totals(
        at_risk,
        strata,
        "time",
        {
            "log_survival": F.when(survives, F.log1p(-d / n)).otherwise(0.0),
            "variance": F.when(survives, d / (n.cast("double") * (n - d))).otherwise(0.0),
            "ended": F.when(survives, 0).otherwise(1),
        },
    )
    start = per_time.groupBy(*strata).agg(
        F.sum(d + F.col("n_censor")).alias("n_risk"), F.min("time").alias("first")
    )
    zero = F.lit(0).cast("bigint")
    start = start.where("first > 0").select(
        *strata, zero.alias("time"), "n_risk", zero.alias("n_event"), zero.alias("n_censor"),
        F.lit(0.0).alias("log_survival"), F.lit(0.0).alias("variance"), zero.alias("ended"),
    )
    curve = steps.unionByName(start)
    alive = F.col("ended") == 0
    std_err = F.sqrt("variance")
    lower, upper = _band(F.col("log_survival"), std_err, level)
    return curve.select(
        *strata, "time", "n_risk", "n_event", "n_censor",
        F.when(alive, F.exp("log_survival")).otherwise(0.0).alias("survival"),
        F.when(alive, std_err).alias("std_err"),
        F.when(alive, lower).alias("lower"),
        F.when(alive, upper).alias("upper"),
    )


@dataclass
class CoxFit:
    """Estimates on the covariates' own scale, and the reduced rows behind them."""

    names: list[str]
    coef: np.ndarray
    covariance: np.ndarray
    loglik_null: float
    loglik: float
    iterations: int
    n: int
    n_event: int
    center: np.ndarray
    scale: np.ndarray
    default_at: np.ndarray
    reduced: DataFrame
    converged: bool

    def table(self) -> DataFrame:
        std_err = np.sqrt(np.diag(self.covariance))
        rows = [
            (name, float(b), float(np.exp(b)), float(s), float(b / s))
            for name, b, s in zip(self.names, self.coef, std_err)
        ]
        schema = "term string, coef double, hazard_ratio double, std_err double, z double"
        return self.reduced.sparkSession.createDataFrame(rows, schema)


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _standardised(names: Sequence[str], center: np.ndarray, scale: np.ndarray) -> list[str]:
    """Covariates in standard units, as SQL text: each iteration writes new formulas."""
    return [f"((`{n}` - {float(c)!r}D) / {float(s)!r}D)" for n, c, s in zip(names, center, scale)]


def _sum_all(**terms: str) -> list[Column]:
    return [F.expr(f"sum({e}) as {name}") for name, e in terms.items()]


def _tie_sums() -> list[str]:
    """Sums over the shares l / d of d tied events: of 1 / phi, 1 / phi^2 and ln phi, as h1, h2 and lg.

    With phi = s0 - (l / d) e0 = c (x - l), c = e0 / d and x = s0 / c, these are differences of
    the digamma, trigamma and log-gamma functions at b = x + 1 and a = x - m + 1 for the first m
    shares.  Their asymptotic series are cut after a term below 1e-13 of an argument of 16, and
    the leading logarithms are taken of the ratio, so that close arguments lose no digits.
    Shares with a smaller argument (16 at most), or few altogether, are summed one by one.
    """

    def gap(power: int) -> str:
        return f"(pow(b, -{power}) - pow(a, -{power}))"

    digamma = f"log1p(m / a) + m / (2 * a * b) - {gap(2)} / 12 + {gap(4)} / 120 - {gap(6)} / 252 + {gap(8)} / 240"
    trigamma = (
        f"m / (a * b) - {gap(2)} / 2 - {gap(3)} / 6 + {gap(5)} / 30 - {gap(7)} / 42 + {gap(9)} / 30"
    )
    gamma = (
        f"m * ln(a) + (b - 0.5D) * log1p(m / a) - m"
        f" + {gap(1)} / 12 - {gap(3)} / 360 + {gap(5)} / 1260 - {gap(7)} / 1680"
    )
    return [
        f"rest.h1 + if(m > 0, ({digamma}) / c, 0D) as h1",
        f"rest.h2 + if(m > 0, ({trigamma}) / (c * c), 0D) as h2",
        f"rest.lg + if(m > 0, m * ln(c) + {gamma}, 0D) as lg",
    ]


_REST = """aggregate(
    if(m < n_event, sequence(m, n_event - 1), cast(array() as array<bigint>)),
    named_struct('h1', 0D, 'h2', 0D, 'lg', 0D),
    (t, l) -> named_struct('h1', t.h1 + 1 / (s0 - l * c), 'h2', t.h2 + 1 / ((s0 - l * c) * (s0 - l * c)),
      'lg', t.lg + ln(s0 - l * c))) as rest"""


def _event_times(reduced: DataFrame, z: list[str], beta: np.ndarray) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Risk sets of all times, those of times with events and their sums, and what is staged.

    Events tied at one time leave the risk set one by one on average (Efron), which
    enters through three sums of each time (``_tie_sums``).  Every moment of the
    risk set is then r + q / phi, with r = e / e0 and q = s - r s0.
    """
    p = len(z)
    eta = " + ".join(f"{float(b)!r}D * {x}" for b, x in zip(beta, z))
    columns = {f"x_{i}": x for i, x in enumerate(z)} | {"eta": eta}
    rows = reduced.selectExpr("*", *(f"{e} as {name}" for name, e in columns.items()))
    rows = rows.selectExpr("*", "n * exp(eta) as weight", "if(event, n, 0) as n_hit")
    rows = rows.withColumn("w_hit", F.expr("if(event, weight, 0D)"))

    moments = {"0": "1"} | {f"1_{i}": f"x_{i}" for i in range(p)}
    moments |= {f"2_{i}{j}": f"x_{i} * x_{j}" for i, j in _pairs(p)}
    xs = [f"x_{i}" for i in range(p)]
    per_time = rows.groupBy("time").agg(
        *_sum_all(n_rows="n", n_event="n_hit", eta="n_hit * eta", **{x: f"n_hit * {x}" for x in xs}),
        *_sum_all(**{"a" + k: f"weight * {e}" for k, e in moments.items()}),
        *_sum_all(**{"e" + k: f"w_hit * {e}" for k, e in moments.items()}),
    )
    # Read twice for the running totals, and far smaller than the rows behind it.
    per_time = stage(per_time, "cox-times")
    risk = {"s" + k: F.col("a" + k) for k in moments} | {"n_risk": F.col("n_rows")}
    at_risk = _risk_sets(per_time, [], risk).drop(*("a" + k for k in moments))

    tied = at_risk.where("n_event > 0").selectExpr("*", "e0 / n_event as c", "s0 * n_event / e0 as x")
    by_series = f"least(cast(n_event as double), greatest(floor(x) - {_SERIES_FROM - 1}, 0))"
    tied = tied.selectExpr("*", f"if(n_event <= {TIE_BLOCK}, 0L, cast({by_series} as bigint)) as m")
    tied = tied.selectExpr("*", "x - m + 1 as a", "x + 1 as b", _REST).selectExpr("*", *_tie_sums())
    others = [k for k in moments if k != "0"]
    tied = tied.selectExpr("*", *(f"e{k} / e0 as r{k}" for k in others))
    return at_risk, tied.selectExpr("*", *(f"s{k} - r{k} * s0 as q{k}" for k in others)), per_time


def _score(reduced: DataFrame, z: list[str], beta: np.ndarray):
    """Log-likelihood, gradient and information at ``beta``: one job, one small row."""
    p = len(z)
    _, tied, staged = _event_times(reduced, z, beta)
    terms = ["eta - lg"]
    terms += [f"x_{i} - (n_event * r1_{i} + q1_{i} * h1)" for i in range(p)]
    terms += [
        f"n_event * r2_{i}{j} + q2_{i}{j} * h1 - (n_event * r1_{i} * r1_{j}"
        f" + (r1_{i} * q1_{j} + r1_{j} * q1_{i}) * h1 + q1_{i} * q1_{j} * h2)"
        for i, j in _pairs(p)
    ]
    row = tied.agg(*_sum_all(**{f"c{i}": e for i, e in enumerate(terms)})).first()
    unstage(staged)
    values = np.array([np.nan if v is None else float(v) for v in row])
    info = np.zeros((p, p))
    for (i, j), v in zip(_pairs(p), values[1 + p :]):
        info[i, j] = info[j, i] = v
    return values[0], values[1 : 1 + p], info


def _finite(score: tuple) -> bool:
    return all(np.isfinite(part).all() for part in score)


def cox_fit(
    df: DataFrame,
    time: str,
    event: Column,
    covariates: dict[str, Column],
    tolerance: float = 1e-9,
    max_iterations: int = 30,
    must_converge: bool = True,
) -> CoxFit:
    """Newton fit of log hazard ratios with Efron's treatment of ties.

    Complete cases are reduced once to counts per (time, event, covariates).
    Each iteration is one job that returns 1 + p + p(p+1)/2 numbers; the driver
    only solves the p x p system, halving the step while the fit gets worse.

    A fit that runs out of steps or halvings, or whose standard errors show that the
    likelihood has no maximum (a covariate that separates the events), has not
    converged: that raises, or is only marked with ``must_converge`` off.
    """
    _require_whole(df, time)
    names = list(covariates)
    p = len(names)
    rows = df.select(
        F.col(time).cast("bigint").alias("time"),
        event.alias("event"),
        *(e.cast("double").alias(n) for n, e in covariates.items()),
    ).dropna()
    reduced = stage(rows.groupBy("time", "event", *names).agg(F.count(F.lit(1)).alias("n")), "cox-rows")

    n = F.col("n")
    moments = reduced.agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("event"), n).otherwise(0)).alias("n_event"),
        *(F.sum(n * F.col(c)).alias("sum_" + c) for c in names),
        *(F.bool_and(F.col(c).isin(-1.0, 0.0, 1.0)).alias("dummy_" + c) for c in names),
    ).first()
    if not moments["n_event"]:
        raise ValueError("no events among the complete cases")
    center = np.array([moments["sum_" + c] / moments["n"] for c in names])
    spread = reduced.agg(
        *(F.sum(n * (F.col(c) - float(m)) ** 2).alias(c) for c, m in zip(names, center))
    ).first()
    scale = np.sqrt([v / moments["n"] for v in spread])
    if not (scale > 0).all():
        raise ValueError("a covariate does not vary among the complete cases")
    z = _standardised(names, center, scale)

    beta = np.zeros(p)
    loglik, gradient, info = _score(reduced, z, beta)
    loglik_null, iterations, converged = loglik, 0, False
    while iterations < max_iterations and not converged:
        iterations += 1
        try:
            step = np.linalg.solve(info, gradient)
        except np.linalg.LinAlgError:
            break
        for _ in range(20):
            trial = _score(reduced, z, beta + step)
            if _finite(trial) and trial[0] >= loglik - tolerance * abs(loglik):
                break
            step = step / 2
        else:
            break  # the last accepted point stands
        beta = beta + step
        converged = abs(trial[0] - loglik) <= tolerance * abs(loglik)
        loglik, gradient, info = trial
    try:
        inverse = np.linalg.inv(info)
    except np.linalg.LinAlgError:
        inverse = np.full((p, p), np.nan)
    # Covariates are in standard units, where a proper standard error is far below this.
    spread_of = np.sqrt(np.abs(np.diag(inverse)))
    converged = bool(converged and (spread_of < EXPLODED).all())
    if must_converge and not converged:
        raise ArithmeticError(
            f"no convergence after {iterations} steps: coefficients {beta / scale}, standard errors {spread_of / scale}"
        )
    dummy = np.array([moments["dummy_" + c] for c in names])
    return CoxFit(
        names=names,
        coef=beta / scale,
        covariance=inverse / np.outer(scale, scale),
        loglik_null=loglik_null,
        loglik=loglik,
        iterations=iterations,
        n=moments["n"],
        n_event=moments["n_event"],
        center=center,
        scale=scale,
        default_at=np.where(dummy, 0.0, center),
        reduced=reduced,
        converged=converged,
    )


def cox_curve(fit: CoxFit, at: dict[str, float] | None = None, level: float = 0.95) -> DataFrame:
    """Survival curve of a fit at given covariates, with a log-scale band.

    Covariates not given stay at their mean, or at 0 for a 0/1 dummy.  The
    variance carries both the hazard's and the coefficients' uncertainty.
    """
    at = at or {}
    point = np.array([at.get(n, d) for n, d in zip(fit.names, fit.default_at)])
    point = (point - fit.center) / fit.scale
    beta = fit.coef * fit.scale
    covariance = fit.covariance * np.outer(fit.scale, fit.scale)
    p = len(beta)
    z = _standardised(fit.names, fit.center, fit.scale)
    risk = float(np.exp(point @ beta))

    at_risk, tied, _ = _event_times(fit.reduced, z, beta)
    q = (f"(r1_{i} - {float(point[i])!r}D) * h1 + q1_{i} * h2 as d_q{i}" for i in range(p))
    jumps = tied.selectExpr("time", "h1 as d_hazard", "h2 as d_variance", *q)
    names = ["hazard", "variance", *(f"q{i}" for i in range(p))]
    steps = at_risk.select("time", "n_risk", "n_event", (F.col("n_rows") - F.col("n_event")).alias("n_censor"))
    steps = steps.join(jumps, "time", "left")
    steps = running_totals(
        steps, [], "time", {n: F.coalesce(F.col("d_" + n), F.lit(0.0)) for n in names}
    )
    zero = F.lit(0).cast("bigint")
    start = fit.reduced.agg(F.sum("n").alias("n_risk"), F.min("time").alias("first"))
    start = start.where("first > 0").select(
        zero.alias("time"), "n_risk", zero.alias("n_event"), zero.alias("n_censor"),
        *(F.lit(0.0).alias(n) for n in names),
    )
    columns = ["time", "n_risk", "n_event", "n_censor"]
    curve = steps.select(*columns, *names).unionByName(start)
    quadratic = sum(
        (
            float(covariance[i, j]) * F.col(f"q{i}") * F.col(f"q{j}")
            for i in range(p)
            for j in range(p)
        ),
        F.lit(0.0),
    )
    hazard = risk * F.col("hazard")
    std_err = risk * F.sqrt(F.col("variance") + quadratic)
    lower, upper = _band(-hazard, std_err, level)
    return curve.select(
        *columns, hazard.alias("cum_hazard"), F.exp(-hazard).alias("survival"),
        std_err.alias("std_err"), lower.alias("lower"), upper.alias("upper"),
    )
