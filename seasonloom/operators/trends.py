"""Linear trends: least squares per group, and a nested mixed-effects model.

Every trend is y ~ 1 + x within a group, so a group's rows enter only through
their count, means and centred sums of squares.  One map-side-combined grouping
produces them; no raw row is touched again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from seasonloom.operators.joins import left_join
from seasonloom.session import stage, unstage

# Symmetric 2 x 2 matrices are kept as columns 11, 12 and 22.
_SYM = ("11", "12", "22")
_ALL = [(i, j) for i in (0, 1) for j in (0, 1)]


def line_sums(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Count, means and centred sums of squares per group, complete rows only."""
    rows = df.select(*keys, F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    return rows.dropna().groupBy(*keys).agg(
        F.regr_count("y", "x").alias("n"),
        F.regr_avgx("y", "x").alias("mean_x"),
        F.regr_avgy("y", "x").alias("mean_y"),
        F.regr_sxx("y", "x").alias("sxx"),
        F.regr_sxy("y", "x").alias("sxy"),
        F.regr_syy("y", "x").alias("syy"),
    )


def ols_by_group(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares intercept and slope; missing where x does not vary."""
    sums = line_sums(df, keys, y, x)
    slope = F.try_divide("sxy", "sxx")
    return sums.select(
        *keys, "n", (F.col("mean_y") - slope * F.col("mean_x")).alias("intercept"), slope.alias("slope")
    )


def _num(value: float) -> str:
    """SQL double literal."""
    return f"({float(value)!r}D)"


def _add(*terms: str) -> str:
    return "(" + " + ".join(terms) + ")"


def _mul(*factors: str) -> str:
    return "(" + " * ".join(factors) + ")"


# The three entries of a symmetric matrix as SQL text: literals, or columns.
_Entries = tuple[str, str, str]


def _entries(cov: np.ndarray) -> _Entries:
    return _num(cov[0, 0]), _num(cov[0, 1]), _num(cov[1, 1])


def _entry(cov: _Entries, i: int, j: int) -> str:
    return cov[i + j]


def _shrink(prefix: str, vector: str, cov: _Entries) -> list[str]:
    """(I + S L)^-1 applied to the matrix S and to a vector, and log det(I + S L).

    S and the vector are columns, L the 2 x 2 relative covariance of one level's
    random effects.  No inverse of L appears, so L may be singular.  Formulas
    are SQL text; a search gives L as columns, so that all its steps share one
    compiled plan.
    """
    s11, s12, s22 = (prefix + c for c in _SYM)
    v1, v2 = vector + "1", vector + "2"
    l11, l12, l22 = cov
    w11, w12 = f"(1 + {s11} * {l11} + {s12} * {l12})", f"({s11} * {l12} + {s12} * {l22})"
    w21, w22 = f"({s12} * {l11} + {s22} * {l12})", f"(1 + {s12} * {l12} + {s22} * {l22})"
    # |I + S L| expanded so that a nearly singular S loses no digits.
    det = (
        f"(1 + {s11} * {l11} + 2 * {s12} * {l12} + {s22} * {l22}"
        f" + ({s11} * {s22} - {s12} * {s12}) * ({l11} * {l22} - {l12} * {l12}))"
    )
    return [
        f"({w22} * {s11} - {w12} * {s12}) / {det} as m11",
        f"({w22} * {s12} - {w12} * {s22}) / {det} as m12",
        f"({w11} * {s22} - {w21} * {s12}) / {det} as m22",
        f"({w22} * {v1} - {w12} * {v2}) / {det} as m1",
        f"({w11} * {v2} - {w21} * {v1}) / {det} as m2",
        f"ln({det}) as logdet",
    ]


def _explained(vector: str, shrunk: str, cov: _Entries) -> str:
    """v' L w, the part of the sum of squares a level's random effects take up."""
    return _add(*(_mul(f"{vector}{i + 1}", _entry(cov, i, j), f"{shrunk}{j + 1}") for i, j in _ALL))


def _sym(a, b, c) -> np.ndarray:
    return np.array([[a, b], [b, c]], dtype=float)


@dataclass
class MixedFit:
    """Estimates of y ~ 1 + x with correlated random lines at two nested levels."""

    outer: str
    inner: str
    fixed: np.ndarray
    outer_cov: np.ndarray
    inner_cov: np.ndarray
    sigma: float
    criterion: float
    iterations: int
    reml: bool
    sums: "_NestedSums"
    relative: tuple[np.ndarray, np.ndarray]
    fitted_fixed: np.ndarray
    converged: bool
    # Derivative of the criterion by the Cholesky factors, where a search ended.
    slope: np.ndarray | None = None

    def fixed_effects(self) -> DataFrame:
        rows = [("intercept", float(self.fixed[0])), ("slope", float(self.fixed[1]))]
        return self.sums.games.sparkSession.createDataFrame(rows, "term string, estimate double")

    def summary(self) -> DataFrame:
        """One row: fixed effects, residual standard deviation and criterion."""
        row = (float(self.fixed[0]), float(self.fixed[1]), self.sigma, self.criterion)
        columns = "intercept double, slope double, sigma double, criterion double"
        return self.sums.games.sparkSession.createDataFrame([row], columns)

    def _deviations(self) -> DataFrame:
        """Outer random lines on the fitting scale, and a = fixed + outer effect."""
        cov_b, cov_c = self.relative
        beta = self.fitted_fixed
        outer = self.sums.outer_table(cov_b, cov_c).selectExpr(self.outer, *_predicted(beta, cov_b))
        return outer.select(
            self.outer,
            "a1",
            "a2",
            (F.col("a1") - float(beta[0])).alias("b1"),
            (F.col("a2") - float(beta[1])).alias("b2"),
        )

    def _line(self, first: Column, second: Column) -> tuple[Column, Column]:
        """Intercept and slope on the data's own scale."""
        slope = second / self.sums.scale_x
        return (first - self.sums.mean_x * slope).alias("intercept"), slope.alias("slope")

    def outer_effects(self) -> DataFrame:
        """Predicted random intercept and slope per outer group."""
        rows = self._deviations()
        return rows.select(self.outer, *self._line(F.col("b1"), F.col("b2")))

    def inner_effects(self) -> DataFrame:
        """Predicted random intercept and slope per inner group.

        The outer table is one row per group, so the join keeps the inner rows;
        a group with many of them is split by adaptive execution.
        """
        cov_c = self.relative[1]
        games = self.sums.inner_table(cov_c).select(
            self.outer, self.inner, *("m" + c for c in _SYM), "m1", "m2"
        )
        rows = left_join(games, self._deviations(), [self.outer])
        a1, a2 = F.col("a1"), F.col("a2")
        g = (
            F.col("m1") - F.col("m11") * a1 - F.col("m12") * a2,
            F.col("m2") - F.col("m12") * a1 - F.col("m22") * a2,
        )
        c = [float(cov_c[i, 0]) * g[0] + float(cov_c[i, 1]) * g[1] for i in (0, 1)]
        return rows.select(self.outer, self.inner, *self._line(*c))


def _residual(beta: np.ndarray) -> tuple[str, str]:
    """m - M beta for one outer group."""
    b1, b2 = _num(beta[0]), _num(beta[1])
    return f"(m1 - m11 * {b1} - m12 * {b2})", f"(m2 - m12 * {b1} - m22 * {b2})"


def _predicted(beta: np.ndarray, cov_b: np.ndarray) -> list[str]:
    """a = beta + L (m - M beta), the outer group's own line, as columns a1 and a2."""
    h = _residual(beta)
    return [
        _add(_num(beta[i]), *(_mul(_num(cov_b[i, j]), h[j]) for j in (0, 1))) + f" as a{i + 1}"
        for i in (0, 1)
    ]


def _covariances(params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Relative covariances L L' of the outer and inner effects."""
    outer, inner = (np.array([[p[0], 0.0], [p[1], p[2]]]) for p in (params[:3], params[3:]))
    return outer @ outer.T, inner @ inner.T


class _NestedSums:
    """Sums of each inner group on a centred and scaled axis, and their reductions."""

    def __init__(self, df: DataFrame, y: str, x: str, outer: str, inner: str):
        self.outer, self.inner = outer, inner
        scattered = stage(line_sums(df, [outer, inner], y, x), "trend-sums")
        # In ranges of the keys: an outer group lies in one file, or in a few neighbours if it
        # is large, so that every job on the sums combines it before the shuffle.
        raw = stage(scattered.repartitionByRange(outer, inner), "trend-ranges")
        unstage(scattered)
        total = raw.agg(
            F.sum("n").alias("n"),
            (F.sum(F.col("n") * F.col("mean_x")) / F.sum("n")).alias("x"),
            (F.sum(F.col("n") * F.col("mean_y")) / F.sum("n")).alias("y"),
        ).first()
        if not total["n"]:
            raise ValueError("no complete rows to fit")
        self.n, self.mean_x, self.mean_y = total["n"], total["x"], total["y"]
        dx, dy = F.col("mean_x") - self.mean_x, F.col("mean_y") - self.mean_y
        sxx = F.col("sxx") + F.col("n") * dx * dx
        spread = raw.agg(F.sum(sxx)).first()[0]
        if not spread > 0:
            raise ValueError("x does not vary")
        self.scale_x = float(np.sqrt(spread / self.n))
        # Lines on the centred and scaled axis times this are lines on the data's own.
        self.back = np.array([[1.0, -self.mean_x / self.scale_x], [0.0, 1.0 / self.scale_x]])
        k = self.scale_x
        self.games = raw.select(
            outer,
            inner,
            F.col("n").cast("double").alias("s11"),
            (F.col("n") * dx / k).alias("s12"),
            (sxx / k**2).alias("s22"),
            (F.col("n") * dy).alias("r1"),
            ((F.col("sxy") + F.col("n") * dx * dy) / k).alias("r2"),
            (F.col("syy") + F.col("n") * dy * dy).alias("yy"),
        )

    def inner_table(self, cov_c: np.ndarray) -> DataFrame:
        return self.games.selectExpr("*", *_shrink("s", "r", _entries(cov_c)))

    def outer_table(self, cov_b: np.ndarray, cov_c: np.ndarray) -> DataFrame:
        """Inner groups summed per outer group, then shrunk once more."""
        return self._outer(self.games, [self.outer], _entries(cov_b), _entries(cov_c))

    def _outer(self, games: DataFrame, keys: Sequence[str], cov_b: _Entries, cov_c: _Entries) -> DataFrame:
        """Every column is a plain sum, so an outer group with very many inner
        groups is combined before the shuffle.  Column entries must be among ``keys``.
        """
        sums = {"a" + c: "m" + c for c in _SYM} | {"u" + i: "m" + i for i in "12"}
        sums |= {"yy": "yy - " + _explained("r", "m", cov_c), "inner_logdet": "logdet"}
        sums |= {f"kk{i}{j}": f"m{i} * m{j}" for i, j in _SYM}
        sums |= {f"kv{i}_{c}": f"m{i} * m{c}" for i in "12" for c in _SYM}
        sums |= {f"km{a}_{b}": f"m{a} * m{b}" for n, a in enumerate(_SYM) for b in _SYM[n:]}
        inner = games.selectExpr("*", *_shrink("s", "r", cov_c))
        per_outer = inner.groupBy(*keys).agg(*(F.expr(f"sum({e}) as {name}") for name, e in sums.items()))
        return per_outer.selectExpr("*", *_shrink("a", "u", cov_b))

    def explore(self, points: Sequence[np.ndarray], reml: bool) -> list["_Point"]:
        """Value and gradient of the criterion at several points, from one job.

        A point's covariances are columns beside the inner sums, so the compiled
        plan is the same for all jobs of a search; each inner group meets every
        point inside its task and is combined per point and outer group there.
        """
        names = ["point", *_OUTER, *_INNER]
        rows = [
            F.struct(*(F.lit(v).alias(n) for n, v in zip(names, (k, *_packed(p)), strict=True)))
            for k, p in enumerate(points)
        ]
        games = self.games.select("*", F.explode(F.array(*rows)).alias("p")).select(
            *self.games.columns, "p.*"
        )
        table = self._outer(games, [self.outer, *names], _OUTER, _INNER)
        table = table.selectExpr("*", *_OUTER_LINES)
        totals = table.groupBy("point").agg(*(F.expr(f"sum({e}) as c{i}") for i, e in enumerate(_TERMS)))
        found = {r["point"]: [float(v) for v in r[1:]] for r in totals.collect()}
        return [_Point.of(p, found[k], self.n, reml) for k, p in enumerate(points)]

    def evaluate(self, params: np.ndarray, reml: bool, table: DataFrame | None = None) -> dict:
        """Profiled criterion, fixed effects and residual variance: one small row."""
        return self.solve(*_covariances(params), reml, table)

    def solve(self, cov_b: np.ndarray, cov_c: np.ndarray, reml: bool, table: DataFrame | None = None) -> dict:
        """The same at given relative covariances."""
        table = self.outer_table(cov_b, cov_c) if table is None else table
        terms = ["yy - " + _explained("u", "m", _entries(cov_b)), "logdet + inner_logdet"]
        terms += ["m11", "m12", "m22", "m1", "m2"]
        square, logdet, m11, m12, m22, m1, m2 = _global_sums(table, terms)
        information = _sym(m11, m12, m22)
        beta = np.linalg.solve(information, [m1, m2])
        freedom = self.n - 2 if reml else self.n
        variance = (square - beta @ [m1, m2]) / freedom
        criterion = logdet + freedom * (1 + np.log(2 * np.pi * variance))
        if reml:
            criterion += np.linalg.slogdet(information)[1]
        return {
            "criterion": float(criterion),
            "beta": beta,
            "variance": float(variance),
            "beta_cov": np.linalg.inv(information),
        }

    def gradient(self, params: np.ndarray, state: dict, reml: bool, table: DataFrame) -> np.ndarray:
        """Derivative of the criterion by the six Cholesky factors: six sums."""
        cov_b, _ = _covariances(params)
        w = state["beta_cov"] if reml else np.zeros((2, 2))
        inverse = _num(1 / state["variance"])
        h = [f"{e} as h{i + 1}" for i, e in enumerate(_residual(state["beta"]))]
        # F = I - L M, and T = L - L M L = F L.
        f = [
            f"{_num(i == j)} - {_add(*(_mul(_num(cov_b[i, k]), 'm' + _name(k, j)) for k in (0, 1)))}"
            f" as f{i + 1}{j + 1}"
            for i, j in _ALL
        ]
        r = []
        for i, j in ((0, 0), (0, 1), (1, 1)):
            shrunk = [_mul(f"f{i + 1}{k + 1}", _num(cov_b[k, j])) for k in (0, 1)]
            fixed = [_mul(f"f{i + 1}{k + 1}", _num(w[k, l]), f"f{j + 1}{l + 1}") for k, l in _ALL]
            r.append(f"{_add(*shrunk, *fixed)} as r{_name(i, j)}")
        rows = table.selectExpr("*", *h, *_predicted(state["beta"], cov_b), *f).selectExpr("*", *r)
        sums = []
        for p, q in ((0, 0), (0, 1), (1, 1)):
            mwm = [_mul("m" + _name(p, k), _num(w[k, l]), "m" + _name(l, q)) for k, l in _ALL]
            sums.append(f"h{p + 1} * h{q + 1} * {inverse} - m{_name(p, q)} + {_add(*mwm)}")
        for p, q in ((0, 0), (0, 1), (1, 1)):
            outer = _add(*(_mul(_km(p, k, l, q), f"a{k + 1}", f"a{l + 1}") for k, l in _ALL))
            cross = _add(
                *(_mul(_add(_kv(p, q, k), _kv(q, p, k)), f"a{k + 1}") for k in (0, 1))
            )
            kernel = _add(*(_mul(_km(p, k, l, q), "r" + _name(k, l)) for k, l in _ALL))
            square = f"(kk{_name(p, q)} - {cross} + {outer}) * {inverse}"
            sums.append(f"{square} - a{_name(p, q)} + {kernel}")
        row = _global_sums(rows, sums)
        parts = []
        for score, p in ((_sym(*row[:3]), params[:3]), (_sym(*row[3:]), params[3:])):
            factor = np.array([[p[0], 0.0], [p[1], p[2]]])
            by_factor = -2 * score @ factor
            parts += [by_factor[0, 0], by_factor[1, 0], by_factor[1, 1]]
        return np.array(parts)


def _name(i: int, j: int) -> str:
    return f"{min(i, j) + 1}{max(i, j) + 1}"


def _km(p: int, k: int, l: int, q: int) -> str:
    """Sum over inner groups of K[p,k] K[l,q]."""
    first, second = sorted((_name(p, k), _name(l, q)), key=_SYM.index)
    return f"km{first}_{second}"


def _kv(p: int, q: int, k: int) -> str:
    """Sum over inner groups of k[p] K[q,k]."""
    return f"kv{p + 1}_{_name(q, k)}"


def _global_sums(df: DataFrame, terms: Sequence[str]) -> list[float]:
    row = df.agg(*(F.expr(f"sum({e}) as c{i}") for i, e in enumerate(terms))).first()
    return [float(v) for v in row]


# Covariance entries of a point as columns.
_OUTER: _Entries = ("b11", "b12", "b22")
_INNER: _Entries = ("c11", "c12", "c22")
_PARTS = ((0, 0), (0, 1), (1, 1))

# An outer group's line is a = z + F beta, with z = L m and F = I - L M.
_OUTER_LINES = [
    f"{_add(*(_mul(_entry(_OUTER, i, k), f'm{k + 1}') for k in (0, 1)))} as z{i + 1}" for i in (0, 1)
] + [
    f"{_num(i == j)} - {_add(*(_mul(_entry(_OUTER, i, k), 'm' + _name(k, j)) for k in (0, 1)))} as f{i + 1}{j + 1}"
    for i, j in _ALL
]


def _quadratic(pieces: Callable[[int, int], list[str]]) -> list[str]:
    """Coefficients of b1 b1, b1 b2 and b2 b2 from terms of each ordered pair."""
    return [_add(*pieces(0, 0)), _add(*pieces(0, 1), *pieces(1, 0)), _add(*pieces(1, 1))]


def _search_terms() -> list[str]:
    """Sums over outer groups from which value and gradient follow for any fixed effects.

    First what the value needs (7).  Then for each entry of the outer effects' score the
    coefficients of 1, b1, b2, b1 b1, b1 b2 and b2 b2, where h = m - M b; the same for the inner
    effects' score, where an inner group's g = k - K a; last the inner parts without b (3).
    """
    terms = ["yy - " + _explained("u", "m", _OUTER), "logdet + inner_logdet", "m11", "m12", "m22", "m1", "m2"]
    for p, q in _PARTS:
        terms.append(f"m{p + 1} * m{q + 1}")
        terms += [f"-(m{p + 1} * m{_name(q, k)} + m{q + 1} * m{_name(p, k)})" for k in (0, 1)]
        terms += _quadratic(lambda k, l: [_mul("m" + _name(p, k), "m" + _name(l, q))])  # noqa: B023
    for p, q in _PARTS:
        cross = [_add(_kv(p, q, k), _kv(q, p, k)) for k in (0, 1)]
        terms.append(
            f"kk{_name(p, q)} - {_add(*(_mul(cross[k], f'z{k + 1}') for k in (0, 1)))}"
            f" + {_add(*(_mul(_km(p, k, l, q), f'z{k + 1}', f'z{l + 1}') for k, l in _ALL))}"
        )
        for n in (1, 2):
            mixed = [_mul(_km(p, k, l, q), f"(z{k + 1} * f{l + 1}{n} + f{k + 1}{n} * z{l + 1})") for k, l in _ALL]
            terms.append(f"{_add(*mixed)} - {_add(*(_mul(cross[k], f'f{k + 1}{n}') for k in (0, 1)))}")
        terms += _quadratic(
            lambda i, j: [_mul(_km(p, k, l, q), f"f{k + 1}{i + 1}", f"f{l + 1}{j + 1}") for k, l in _ALL]  # noqa: B023
        )
    for p, q in _PARTS:
        shrunk = [
            _mul(_km(p, k, l, q), f"f{k + 1}{j + 1}", _entry(_OUTER, j, l)) for k, l in _ALL for j in (0, 1)
        ]
        terms.append(f"{_add(*shrunk)} - a{_name(p, q)}")
    return terms


_TERMS = _search_terms()


def _packed(params: np.ndarray) -> list[float]:
    return [float(c[i, j]) for c in _covariances(params) for i, j in _PARTS]


@dataclass
class _Point:
    """Criterion and gradient at one set of Cholesky factors."""

    params: np.ndarray
    value: float
    slope: np.ndarray
    beta: np.ndarray
    variance: float

    @classmethod
    def of(cls, params: np.ndarray, sums: list[float], n: int, reml: bool) -> "_Point":
        square, logdet, m11, m12, m22, m1, m2 = sums[:7]
        information = _sym(m11, m12, m22)
        beta = np.linalg.solve(information, [m1, m2])
        freedom = n - 2 if reml else n
        variance = (square - beta @ [m1, m2]) / freedom
        if not variance > 0:
            return cls(params, np.inf, np.zeros(6), beta, variance)
        value = logdet + freedom * (1 + np.log(2 * np.pi * variance))
        by_beta = np.array([1, beta[0], beta[1], beta[0] ** 2, beta[0] * beta[1], beta[1] ** 2])
        w = np.zeros(3)
        if reml:
            value += np.linalg.slogdet(information)[1]
            inverse = np.linalg.inv(information)
            w = np.array([inverse[0, 0], inverse[0, 1], inverse[1, 1]])
        parts = []
        plain = {"outer": [-m11, -m12, -m22], "inner": sums[43:46]}
        for k, level in enumerate(("outer", "inner")):
            blocks = np.array(sums[7 + 18 * k : 25 + 18 * k]).reshape(3, 6)
            score = blocks @ by_beta / variance + plain[level] + blocks[:, 3:] @ w
            low = params[3 * k : 3 * k + 3]
            by_factor = -2 * _sym(*score) @ np.array([[low[0], 0.0], [low[1], low[2]]])
            parts += [by_factor[0, 0], by_factor[1, 0], by_factor[1, 1]]
        return cls(params, float(value), np.array(parts), beta, float(variance))


# Outer and inner standard deviations to begin from, relative to the residual's.
_STARTS = [
    np.array([b, 0.0, 0.3 * b, c, 0.0, 0.3 * c]) for b in (1.0, 0.3, 0.1, 0.03) for c in (1.0, 0.3, 0.1, 0.03)
]
_NUDGE = 1e-4
# A longer step than Newton's shortens the way along the flat valley of a singular optimum.
_LENGTHS = (1.0, 3.0, 0.25)


def _newton_step(point: _Point, around: Sequence[_Point]) -> np.ndarray:
    """Newton's step, with the curvature from gradients beside the point.

    Directions of negative curvature are followed downhill by their size, so the
    step always descends; it is cut to a length of one.
    """
    curvature = np.array([(a.slope - point.slope) / _NUDGE for a in around])
    size, axes = np.linalg.eigh((curvature + curvature.T) / 2)
    size = np.maximum(np.abs(size), 1e-6 * max(np.abs(size).max(), 1e-12))
    step = -axes @ ((axes.T @ point.slope) / size)
    return step / max(1.0, float(np.linalg.norm(step)))


def _search(
    explore: Callable[[Sequence[np.ndarray]], list[_Point]], tolerance: float, max_iterations: int
) -> tuple[_Point, int, bool]:
    """Newton's method in which a job tries several step lengths at once.

    Each job evaluates its candidates and what their next step needs.  The last value
    says whether it converged: the criterion stands and its gradient is about zero.
    """
    with_nudges = lambda p: [p, *(p + _NUDGE * np.eye(6)[k] for k in range(6))]
    start = min(explore(_STARTS), key=lambda p: p.value)
    here, *around = explore(with_nudges(start.params))
    for iteration in range(1, max_iterations + 1):
        step = _newton_step(here, around)
        for shorter in range(6):
            lengths = [length / 64**shorter for length in _LENGTHS]
            found = explore([p for length in lengths for p in with_nudges(here.params + length * step)])
            tried = [found[k : k + 7] for k in range(0, len(found), 7)]
            best = min(tried, key=lambda t: t[0].value)
            if best[0].value <= here.value + 1e-12 * (1 + abs(here.value)):
                break
        else:
            return here, iteration, bool(np.linalg.norm(here.slope) <= 1e-4 * (1 + abs(here.value)))
        drop, scale = here.value - best[0].value, 1 + abs(best[0].value)
        here, around = best[0], best[1:]
        if drop <= tolerance * scale and np.linalg.norm(here.slope) <= 1e-6 * scale:
            return here, iteration, True
    return here, max_iterations, False


def fit_nested_lines(
    df: DataFrame,
    y: str,
    x: str,
    outer: str,
    inner: str,
    reml: bool = True,
    tolerance: float = 1e-8,
    max_iterations: int = 100,
    must_converge: bool = True,
) -> MixedFit:
    """Fit y ~ x + (1 + x | outer) + (1 + x | outer:inner).

    The residual variance and the fixed effects are profiled out, which leaves
    the six Cholesky factors of the two relative covariances.  A job groups the
    staged inner sums by ``outer`` for several points at once; 46 sums a point come
    back.  A search that does not converge raises, or is only marked with
    ``must_converge`` off.
    """
    sums = _NestedSums(df, y, x, outer, inner)
    point, iterations, converged = _search(lambda points: sums.explore(points, reml), tolerance, max_iterations)
    if must_converge and not converged:
        raise ArithmeticError(f"no convergence after {iterations} steps at criterion {point.value}")
    relative = _covariances(point.params)
    return _solved(sums, relative, point.beta, point.variance, point.value, reml, iterations, converged, point.slope)


def lines_at(
    df: DataFrame,
    y: str,
    x: str,
    outer: str,
    inner: str,
    outer_cov: np.ndarray,
    inner_cov: np.ndarray,
    reml: bool = True,
) -> MixedFit:
    """The same model at given covariances of both levels' lines, without a search.

    The covariances are relative to the residual variance, on the scale of x.  Fixed
    effects, residual variance and criterion follow in closed form from one grouping.
    """
    sums = _NestedSums(df, y, x, outer, inner)
    onto = np.linalg.inv(sums.back)
    relative = tuple(onto @ np.asarray(c, dtype=float) @ onto.T for c in (outer_cov, inner_cov))
    state = sums.solve(*relative, reml)
    return _solved(sums, relative, state["beta"], state["variance"], state["criterion"], reml, 0, True)


def _solved(sums, relative, beta, variance, criterion, reml, iterations, converged, slope=None) -> MixedFit:
    """Back from the centred and scaled axis; so is the criterion's determinant with REML."""
    cov_b, cov_c = (sums.back @ c @ sums.back.T * variance for c in relative)
    fixed = sums.back @ beta
    fixed[0] += sums.mean_y
    return MixedFit(
        outer=sums.outer,
        inner=sums.inner,
        fixed=fixed,
        outer_cov=cov_b,
        inner_cov=cov_c,
        sigma=float(np.sqrt(variance)),
        criterion=float(criterion + (2 * np.log(sums.scale_x) if reml else 0.0)),
        iterations=iterations,
        reml=reml,
        sums=sums,
        relative=relative,
        fitted_fixed=beta,
        converged=converged,
        slope=slope,
    )
