"""Survival, least-squares and mixed-model fits against small dense solutions."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonloom.operators import survival, trends
from seasonloom.operators.survival import cox_curve, cox_fit, kaplan_meier
from seasonloom.operators.trends import fit_nested_lines, ols_by_group

Z = 1.959963984540054


def _events(spark, rows, extra="g string"):
    return spark.createDataFrame(rows, f"time int, event boolean, {extra}")


def test_km_by_hand(spark):
    # A tie of event and censoring at 5, and the last row an event.
    rows = [(2, True), (5, True), (5, False), (8, False), (9, True), (9, True)]
    frame = _events(spark, [(t, e, "a") for t, e in rows])
    curve = kaplan_meier(frame, "time", F.col("event"), ["g"]).orderBy("time").collect()
    assert [(r.time, r.n_risk, r.n_event, r.n_censor) for r in curve] == [
        (0, 6, 0, 0), (2, 6, 1, 0), (5, 5, 1, 1), (8, 3, 0, 1), (9, 2, 2, 0),
    ]
    s5 = 5 / 6 * 4 / 5
    se5 = math.sqrt(1 / (6 * 5) + 1 / (5 * 4))
    assert [r.survival for r in curve] == pytest.approx([1, 5 / 6, s5, s5, 0])
    assert curve[2].std_err == pytest.approx(se5)
    assert curve[2].lower == pytest.approx(math.exp(math.log(s5) - Z * se5))
    assert curve[2].upper == 1.0
    assert (curve[4].std_err, curve[4].lower, curve[4].upper) == (None, None, None)


def test_km_time_zero_and_missing(spark):
    rows = [(0, True, "a"), (0, False, "a"), (3, False, "a"), (None, True, "a"), (4, True, None), (4, None, "b")]
    curve = kaplan_meier(_events(spark, rows), "time", F.col("event"), ["g"]).orderBy("time").collect()
    assert [(r.time, r.n_risk, r.n_event, r.n_censor) for r in curve] == [(0, 3, 1, 1), (3, 1, 0, 1)]
    assert curve[1].survival == pytest.approx(2 / 3)


def test_km_spans_chunks(spark):
    rng = np.random.default_rng(3)
    times, events = rng.integers(0, 20_000, 3000), rng.random(3000) < 0.3
    frame = _events(spark, [(int(t), bool(e), "a") for t, e in zip(times, events)])
    curve = kaplan_meier(frame, "time", F.col("event"), ["g"]).orderBy("time").collect()
    expected, n, log_s = {}, 3000, 0.0
    for t in np.unique(times):
        d, c = int(events[times == t].sum()), int((~events[times == t]).sum())
        log_s += math.log1p(-d / n) if d < n else -math.inf
        expected[int(t)], n = math.exp(log_s), n - d - c
    got = {r.time: r.survival for r in curve if r.n_event + r.n_censor}
    assert got == pytest.approx(expected)
    values = [r.survival for r in curve]
    assert all(0 <= b <= a + 1e-12 and a <= 1 for a, b in zip(values, values[1:]))


def test_km_refuses_fractional_time(spark):
    frame = spark.createDataFrame([(1.5, True, "a")], "time double, event boolean, g string")
    with pytest.raises(TypeError):
        kaplan_meier(frame, "time", F.col("event"), ["g"])


def _cox_terms(beta, time, event, x):
    """Efron log-likelihood, gradient and information, one tie at a time."""
    w = np.exp(x @ beta)
    loglik, grad, info = 0.0, np.zeros(len(beta)), np.zeros((len(beta),) * 2)
    for t in np.unique(time[event]):
        risk, tied = time >= t, (time == t) & event
        loglik += (x[tied] @ beta).sum()
        grad += x[tied].sum(0)
        for l in range(tied.sum()):
            share = w * risk - l / tied.sum() * w * tied
            s0, s1 = share.sum(), share @ x
            loglik -= math.log(s0)
            grad -= s1 / s0
            info += (x.T * share) @ x / s0 - np.outer(s1, s1) / s0**2
    return loglik, grad, info


def _dense_cox(time, event, x):
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        _, grad, info = _cox_terms(beta, time, event, x)
        beta = beta + np.linalg.solve(info, grad)
    loglik, _, info = _cox_terms(beta, time, event, x)
    return beta, np.linalg.inv(info), loglik


@pytest.fixture(scope="module")
def cox_case(spark):
    rng = np.random.default_rng(11)
    n = 160
    x = np.column_stack([rng.integers(0, 2, n), rng.normal(900, 300, n).round()]).astype(float)
    time = rng.integers(1, 25, n)
    event = rng.random(n) < 0.5
    rows = [(int(t), bool(e), float(a), float(b)) for t, e, (a, b) in zip(time, event, x)]
    rows += [(5, True, None, 1.0), (None, True, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "time int, event boolean, starter double, load double")
    fit = cox_fit(frame, "time", F.col("event"), {c: F.col(c) for c in ("starter", "load")})
    return fit, time, event, x


def test_cox_matches_dense(cox_case):
    fit, time, event, x = cox_case
    beta, covariance, loglik = _dense_cox(time, event, x)
    assert fit.coef == pytest.approx(beta, rel=1e-6)
    assert fit.covariance == pytest.approx(covariance, rel=1e-5)
    assert fit.loglik == pytest.approx(loglik)
    assert (fit.n, fit.n_event) == (len(time), event.sum())
    assert list(fit.default_at) == pytest.approx([0.0, x[:, 1].mean()])
    table = fit.table().collect()
    assert [r.term for r in table] == ["starter", "load"]
    assert table[0].hazard_ratio == pytest.approx(math.exp(beta[0]), rel=1e-6)


def test_cox_tie_blocks(cox_case, monkeypatch):
    fit, time, event, x = cox_case
    monkeypatch.setattr(survival, "TIE_BLOCK", 2)
    z = survival._standardised(fit.names, fit.center, fit.scale)
    loglik, grad, info = survival._score(fit.reduced, z, np.zeros(2))
    dense = _cox_terms(np.zeros(2), time, event, (x - fit.center) / fit.scale)
    assert loglik == pytest.approx(dense[0])
    assert grad == pytest.approx(dense[1], abs=1e-8)
    assert info == pytest.approx(dense[2])


@pytest.mark.parametrize("ties", [1, 17, 10_000_000])
def test_any_number_of_ties_at_one_time(spark, ties):
    # Counts of (time, event, x); at time 3 all that are left have the event.
    rows = [(1, True, 0.5, ties), (1, True, -1.0, 2 * ties // 3), (1, False, 0.25, 40), (2, True, 1.0, 2), (2, False, 0.0, 3)]
    rows += [(3, True, 2.0, 20), (3, True, 0.0, 9)]
    beta = np.array([0.3])
    got = survival._score(spark.createDataFrame(rows, "time long, event boolean, x double, n long"), ["x"], beta)
    loglik = gradient = information = 0.0
    for t in (1, 2, 3):
        risk, hit = [r for r in rows if r[0] >= t], [r for r in rows if r[0] == t and r[1]]
        s, e = ([sum(n * math.exp(0.3 * x) * x**k for _, _, x, n in part) for k in range(3)] for part in (risk, hit))
        d = sum(r[3] for r in hit)
        share = np.arange(d) / d if d else np.zeros(0)
        phi = [s[k] - share * e[k] for k in range(3)]
        loglik += sum(0.3 * x * n for _, _, x, n in hit) - np.log(phi[0]).sum()
        gradient += sum(x * n for _, _, x, n in hit) - (phi[1] / phi[0]).sum()
        information += (phi[2] / phi[0] - (phi[1] / phi[0]) ** 2).sum()
    assert got[0] == pytest.approx(loglik, rel=1e-9)
    assert got[1][0] == pytest.approx(gradient, rel=1e-8, abs=1e-9 * ties)
    assert got[2][0, 0] == pytest.approx(information, rel=1e-8)


def test_cox_leaves_nothing_of_its_evaluations_behind(cox_case):
    from seasonloom.session import shared_dir

    fit = cox_case[0]
    left = os.listdir(os.path.join(shared_dir(fit.reduced.sparkSession), "seasonloom"))
    assert not [name for name in left if name.startswith("cox-times")]


def test_cox_curve_matches_dense(cox_case):
    fit, time, event, x = cox_case
    at = {"starter": 1.0, "load": 700.0}
    point = np.array([1.0, 700.0])
    curve = {r.time: r for r in cox_curve(fit, at).collect()}
    beta, covariance, _ = _dense_cox(time, event, x)
    w, base = np.exp(x @ beta), math.exp(point @ beta)
    hazard, variance, q = 0.0, 0.0, np.zeros(2)
    assert curve[0].survival == 1.0
    for t in np.unique(time):
        tied = (time == t) & event
        for l in range(tied.sum()):
            share = w * (time >= t) - l / tied.sum() * w * tied
            s0 = share.sum()
            hazard += base / s0
            variance += (base / s0) ** 2
            q += base * ((share @ x) / s0 - point) / s0
        std_err = math.sqrt(variance + q @ covariance @ q)
        row = curve[int(t)]
        assert row.cum_hazard == pytest.approx(hazard, rel=1e-6)
        assert row.survival == pytest.approx(math.exp(-hazard), rel=1e-6)
        assert row.std_err == pytest.approx(std_err, rel=1e-5)
        assert row.lower == pytest.approx(math.exp(-hazard - Z * std_err), rel=1e-5)


def test_ols_by_group(spark):
    rows = [("a", float(i), 3.0 - 0.5 * i) for i in range(1, 6)] + [("b", 2.0, 9.0), ("a", None, 1.0)]
    frame = spark.createDataFrame(rows, "g string, x double, y double")
    lines = {r.g: r for r in ols_by_group(frame, ["g"], "y", "x").collect()}
    assert (lines["a"].n, lines["a"].intercept, lines["a"].slope) == pytest.approx((5, 3.0, -0.5))
    assert (lines["b"].intercept, lines["b"].slope) == (None, None)


@pytest.fixture(scope="module")
def nested(spark):
    """Two-level random lines with enough rows to identify every variance."""
    rng = np.random.default_rng(5)
    rows = []
    for pitcher in range(14):
        b = rng.multivariate_normal([0, 0], [[1.5, -0.02], [-0.02, 0.004]])
        for game in range(6):
            c = rng.multivariate_normal([0, 0], [[0.6, 0.01], [0.01, 0.002]])
            for number in range(1, int(rng.integers(8, 20))):
                mean = 93 - 0.03 * number + b[0] + c[0] + (b[1] + c[1]) * number
                rows.append((pitcher, game, number, float(mean + rng.normal(0, 0.8))))
    rows.append((3, 2, None, 90.0))
    frame = spark.createDataFrame(rows, "pitcher int, game int, number int, speed double")
    return frame, rows[:-1]


class _Dense:
    """The same model with its full covariance matrix."""

    def __init__(self, rows):
        self.pitcher, self.game, number, self.y = (np.array(c) for c in zip(*rows))
        self.x = np.column_stack([np.ones(len(number)), number])
        self.same_pitcher = self.pitcher[:, None] == self.pitcher
        self.same_game = self.same_pitcher & (self.game[:, None] == self.game)

    def solve(self, outer, inner, sigma):
        v = self.x @ outer @ self.x.T * self.same_pitcher
        v = v + self.x @ inner @ self.x.T * self.same_game + sigma**2 * np.eye(len(self.y))
        inverse = np.linalg.inv(v)
        information = self.x.T @ inverse @ self.x
        beta = np.linalg.solve(information, self.x.T @ inverse @ self.y)
        scaled = inverse @ (self.y - self.x @ beta)
        return v, information, beta, scaled

    def criterion(self, outer, inner, sigma, reml):
        v, information, beta, scaled = self.solve(outer, inner, sigma)
        n = len(self.y)
        value = np.linalg.slogdet(v)[1] + (self.y - self.x @ beta) @ scaled
        value += (n - 2 if reml else n) * math.log(2 * math.pi)
        return value + (np.linalg.slogdet(information)[1] if reml else 0.0)

    def effects(self, outer, inner, sigma):
        _, _, _, scaled = self.solve(outer, inner, sigma)
        b = {p: outer @ self.x[self.pitcher == p].T @ scaled[self.pitcher == p] for p in set(self.pitcher)}
        c = {}
        for p, g in set(zip(self.pitcher, self.game)):
            here = (self.pitcher == p) & (self.game == g)
            c[p, g] = inner @ self.x[here].T @ scaled[here]
        return b, c


@pytest.mark.parametrize("reml", [True, False])
def test_mixed_model_matches_dense(nested, reml):
    frame, rows = nested
    fit = fit_nested_lines(frame, "speed", "number", "pitcher", "game", reml)
    dense = _Dense(rows)
    found = (fit.outer_cov, fit.inner_cov, fit.sigma)
    _, _, beta, _ = dense.solve(*found)
    assert fit.fixed == pytest.approx(beta, rel=1e-6)

    # The optimum: no small move of any parameter lowers the dense criterion.
    best = dense.criterion(*found, reml)
    for matrix in (0, 1):
        for i, j in ((0, 0), (0, 1), (1, 1)):
            for sign in (1, -1):
                moved = [found[0].copy(), found[1].copy(), found[2]]
                step = sign * 2e-2 * math.sqrt(found[matrix][i, i] * found[matrix][j, j])
                moved[matrix][i, j] += step
                moved[matrix][j, i] = moved[matrix][i, j]
                assert dense.criterion(*moved, reml) > best - 1e-4
    for factor in (0.99, 1.01):
        assert dense.criterion(fit.outer_cov, fit.inner_cov, fit.sigma * factor, reml) > best - 1e-6

    b, c = dense.effects(*found)
    outer = {r.pitcher: (r.intercept, r.slope) for r in fit.outer_effects().collect()}
    assert set(outer) == set(b)
    for key, value in b.items():
        assert outer[key] == pytest.approx(tuple(value), abs=1e-6)
    inner = {(r.pitcher, r.game): (r.intercept, r.slope) for r in fit.inner_effects().collect()}
    assert set(inner) == set(c)
    for key, value in c.items():
        assert inner[key] == pytest.approx(tuple(value), abs=1e-6)


def test_search_takes_few_jobs_and_ends_on_a_flat_gradient(nested, monkeypatch):
    frame, rows = nested
    jobs = []
    explore = trends._NestedSums.explore
    monkeypatch.setattr(trends._NestedSums, "explore", lambda *a: jobs.append(1) or explore(*a))
    fit = fit_nested_lines(frame, "speed", "number", "pitcher", "game")
    # The sums are staged and centred in three more.
    assert len(jobs) <= 12
    assert fit.criterion == pytest.approx(_Dense(rows).criterion(fit.outer_cov, fit.inner_cov, fit.sigma, True), rel=1e-9)
    assert np.linalg.norm(fit.slope) <= 1e-6 * (1 + abs(fit.criterion))


@pytest.mark.parametrize("reml", [True, False])
def test_points_of_a_search_agree_with_one_at_a_time(nested, reml):
    frame, _ = nested
    sums = trends._NestedSums(frame, "speed", "number", "pitcher", "game")
    points = [np.array([0.9, -0.1, 0.3, 0.6, 0.1, 0.25]), np.zeros(6), np.array([1.0, 0.4, 0.0, 0.2, 0.0, 0.5])]
    for params, found in zip(points, sums.explore(points, reml), strict=True):
        state = sums.evaluate(params, reml)
        assert found.value == pytest.approx(state["criterion"], rel=1e-12)
        assert found.beta == pytest.approx(state["beta"]) and found.variance == pytest.approx(state["variance"])
        one = sums.gradient(params, state, reml, sums.outer_table(*trends._covariances(params)))
        assert found.slope == pytest.approx(one, rel=1e-8, abs=1e-8)


@pytest.mark.parametrize("reml", [True, False])
@pytest.mark.parametrize("outer, inner", [
    ([[1.5, -0.03], [-0.03, 0.004]], [[0.5, 0.01], [0.01, 0.003]]),
    ([[0.0, 0.0], [0.0, 0.0]], [[1.0, 0.1], [0.1, 0.01]]),
])
def test_lines_at_given_covariances_match_dense(nested, outer, inner, reml):
    frame, rows = nested
    fit = trends.lines_at(frame, "speed", "number", "pitcher", "game", outer, inner, reml)
    dense = _Dense(rows)
    outer, inner = (np.array(c) * fit.sigma**2 for c in (outer, inner))
    assert fit.outer_cov == pytest.approx(outer) and fit.inner_cov == pytest.approx(inner)
    _, _, beta, _ = dense.solve(outer, inner, fit.sigma)
    assert fit.fixed == pytest.approx(beta, rel=1e-9)
    best = dense.criterion(outer, inner, fit.sigma, reml)
    assert fit.criterion == pytest.approx(best, rel=1e-9)
    for factor in (0.999, 1.001):  # the residual variance is the best one at these relative covariances
        assert dense.criterion(outer * factor, inner * factor, fit.sigma * factor**0.5, reml) > best
    b, c = dense.effects(outer, inner, fit.sigma)
    assert {r.pitcher: (r.intercept, r.slope) for r in fit.outer_effects().collect()} == {
        k: pytest.approx(tuple(v), abs=1e-8) for k, v in b.items()
    }
    assert {(r.pitcher, r.game): (r.intercept, r.slope) for r in fit.inner_effects().collect()} == {
        k: pytest.approx(tuple(v), abs=1e-8) for k, v in c.items()
    }


def test_mixed_model_gradient(nested):
    frame, _ = nested
    sums = fit_nested_lines(frame, "speed", "number", "pitcher", "game", max_iterations=1, must_converge=False).sums
    from seasonloom.operators.trends import _covariances

    point = np.array([0.9, -0.1, 0.3, 0.6, 0.1, 0.25])
    for reml in (True, False):
        state = sums.evaluate(point, reml)
        slope = sums.gradient(point, state, reml, sums.outer_table(*_covariances(point)))
        for k in range(6):
            step = np.eye(6)[k] * 1e-4
            up, down = (sums.evaluate(point + s, reml)["criterion"] for s in (step, -step))
            assert slope[k] == pytest.approx((up - down) / 2e-4, rel=1e-4, abs=1e-4)


def test_unfinished_fits_say_so(spark, cox_case, nested, monkeypatch):
    frame = spark.createDataFrame([(t, t <= 20, float(t <= 20)) for t in range(1, 41)], "time long, hit boolean, x double")
    with pytest.raises(ArithmeticError):
        cox_fit(frame, "time", F.col("hit"), {"x": F.col("x")})
    assert not cox_fit(frame, "time", F.col("hit"), {"x": F.col("x")}, must_converge=False).converged
    rows = spark.createDataFrame([(t, t % 3 > 0, float(t * t % 7)) for t in range(1, 41)], "time long, hit boolean, x double")
    args = (rows, "time", F.col("hit"), {"x": F.col("x")})
    assert cox_fit(*args).converged
    assert not cox_fit(*args, max_iterations=1, must_converge=False).converged
    lines, _ = nested
    with pytest.raises(ArithmeticError):
        fit_nested_lines(lines, "speed", "number", "pitcher", "game", max_iterations=1)


def test_failing_line_search_keeps_the_accepted_point(spark, monkeypatch):
    rows = spark.createDataFrame([(t, t % 3 > 0, float(t * t % 7)) for t in range(1, 41)], "time long, hit boolean, x double")
    score = survival._score
    monkeypatch.setattr(survival, "_score", lambda r, z, b: (score(r, z, b) if not b.any() else (-math.inf, b, np.eye(len(b)))))
    fit = cox_fit(rows, "time", F.col("hit"), {"x": F.col("x")}, must_converge=False)
    assert not fit.converged and fit.coef.tolist() == [0.0] and fit.loglik == fit.loglik_null


def test_inner_sums_lie_together_by_outer_group(spark):
    # So a job on the sums shuffles about one partial row per outer group and point, on any number
    # of files; the large outer group spans neighbouring files.
    games = spark.range(6000).selectExpr(
        "if(id < 3000, 0, 1 + id % 300) as pitcher", "id as game", "explode(array(1, 2, 4)) as number"
    )
    rows = games.withColumn("speed", 90 + F.col("number") * (F.col("pitcher") % 5) + F.col("game") % 7)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        sums = trends._NestedSums(rows, "speed", "number", "pitcher", "game")
    finally:
        spark.conf.unset(name)
    placed = sums.games.select("pitcher", F.input_file_name().alias("file")).distinct().collect()
    files = {r.file for r in placed}
    assert len(files) > 4 and sums.games.count() == 6000
    assert len(placed) <= 301 + len(files) - 1
    assert len({r.file for r in placed if r.pitcher == 0}) > 1
