"""Walk-forward models against direct solves on the training rows."""

import datetime as dt
import itertools

import numpy as np
import pytest

from monthspine.functions import linear
from monthspine.functions.calendar import shift_literal
from monthspine.operators import walkforward as W

T, P = 60, 9
FIRST, START, GAP = "2000-01-31", shift_literal("2000-01-31", 48), 2
NAMES = [f"x{i}" for i in range(P)]
LAYOUT = W.Design({"fwd": NAMES[:3], "macro": NAMES[3:]}, ["a", "b", "_mean"])
RNG = np.random.default_rng(7)
X = RNG.normal(size=(T, P)) @ RNG.normal(size=(P, P)) * 0.5 + RNG.normal(size=P)
Y = X @ RNG.normal(size=(P, 2)) * 0.3 + RNG.normal(size=(T, 2))
YS = np.column_stack([Y, Y.mean(axis=1)])


@pytest.fixture(scope="module")
def rows(spark):
    days = [dt.date.fromisoformat(shift_literal(FIRST, i)) for i in range(T)]
    f = [(days[i], n, float(X[i, j])) for i in range(T) for j, n in enumerate(NAMES)]
    y = [(days[i], n, float(YS[i, j])) for i in range(T) for j, n in enumerate(LAYOUT.targets)]
    schema = "date date, name string, value double"
    return W.design_rows(spark.createDataFrame(f, schema), spark.createDataFrame(y, schema), LAYOUT).cache()


def collected(df):
    return {(r.date.year * 12 + r.date.month - 24001, r.target): r.y_hat for r in df.collect()}


def direct(make, refit=1):
    """Forecasts of ``make(X_train, y_train, mean_train) -> predictor`` refit every ``refit`` months."""
    out = {}
    for t in range(48, T):
        end = 48 + (t - 48) // refit * refit - GAP
        for j, g in enumerate(["a", "b"]):
            out[t, g] = float(make(X[:end], YS[:end, j], YS[:end, 2])(X[t : t + 1])[0])
    return out


def ols(z, y):
    c = np.linalg.lstsq(np.column_stack([np.ones(len(z)), z]), y, rcond=None)[0]
    return lambda q: c[0] + q @ c[1:]


def pca(z, k, scaled):
    mu, sd = z.mean(0), z.std(0) if scaled else np.ones(z.shape[1])
    v = np.linalg.svd((z - mu) / sd, full_matrices=False)[2][:k]
    return lambda q: ((q - mu) / sd) @ v.T


def through(fmap, z, y):
    m = ols(fmap(z), y)
    return lambda q: m(fmap(q))


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-7)


FW, MA = LAYOUT.cols("fwd"), LAYOUT.cols("macro")


def test_ols_and_refits(rows):
    for refit in (1, 5):
        same(collected(W.linear_forecast(rows, LAYOUT, [("raw", FW)], START, GAP, refit_every=refit)), direct(lambda x, y, m: through(lambda q: q[:, :3], x, y), refit))


def test_pcr_scaled_and_not(rows):
    for scaled in (True, False):
        def make(x, y, m, scaled=scaled):
            f = pca(x[:, 3:], 2, scaled)
            return through(lambda q: f(q[:, 3:]), x, y)

        same(collected(W.linear_forecast(rows, LAYOUT, [("pca", MA, 2, scaled)], START, GAP)), direct(make))


def test_cp_and_factors(rows):
    def make(x, y, m):
        c, f = ols(x[:, :3], m), pca(x[:, 3:], 3, True)
        return through(lambda q: np.column_stack([c(q[:, :3]), f(q[:, 3:])]), x, y)

    steps = [("cp", FW, LAYOUT.target("_mean")), ("pca", MA, 3, True)]
    same(collected(W.linear_forecast(rows, LAYOUT, steps, START, GAP)), direct(make))


def test_cubic_factors(rows):
    def make(x, y, m):
        c, f = ols(x[:, :3], m), pca(x[:, 3:], 3, True)

        def fmap(q):
            s = f(q[:, 3:])
            return np.column_stack([c(q[:, :3]), s[:, 0], s[:, 0] ** 3, s[:, 2]])

        return through(fmap, x, y)

    got = W.cubic_forecast(rows, LAYOUT, [("cp", FW, LAYOUT.target("_mean"))], MA, START, GAP, refit_every=3, picked=(0, 2))
    same(collected(got), direct(make, 3))


def standard(z):
    mu, sd = z.mean(0), z.std(0)
    return lambda q: (q - mu) / sd


def ridge(z, y, alpha):
    f = standard(z)
    s = f(z)
    b = np.linalg.solve(s.T @ s + alpha * np.eye(s.shape[1]), s.T @ (y - y.mean()))
    return lambda q: y.mean() + f(q) @ b


def tuned_ridge(x, y, m):
    cut = int(len(y) * 0.85)
    errs = [np.mean((y[cut:] - ridge(x[:cut], y[:cut], a)(x[cut:])) ** 2) for a in linear.RIDGE_GRID]
    return ridge(x, y, linear.RIDGE_GRID[int(np.argmin(errs))])


def test_tuned_ridge(rows):
    got = W.linear_forecast(rows, LAYOUT, [("raw", MA), ("raw", FW)], START, GAP, "ridge", refit_every=4, tune_every=1)
    same(collected(got), direct(tuned_ridge, 4))


def test_penalty_is_kept_between_tunings(rows):
    def make(t_end):
        x, y = X[:t_end], YS[:t_end, 0]
        cut = int(len(y) * 0.85)
        errs = [np.mean((y[cut:] - ridge(x[:cut], y[:cut], a)(x[cut:])) ** 2) for a in linear.RIDGE_GRID]
        return linear.RIDGE_GRID[int(np.argmin(errs))]

    got = collected(W.linear_forecast(rows, LAYOUT, [("raw", MA), ("raw", FW)], START, GAP, "ridge", refit_every=3, tune_every=2))
    for t in range(48, T):
        fit, tune = 48 + (t - 48) // 3 * 3, 48 + (t - 48) // 6 * 6
        want = ridge(X[: fit - GAP], YS[: fit - GAP, 0], make(tune - GAP))(X[t : t + 1])[0]
        assert got[t, "a"] == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize("mix", [1.0, 0.5])
def test_coordinate_descent_is_stationary(mix):
    s = standard(X)(X)
    y = Y[:, 0] - Y[:, 0].mean()
    corr, cross = s.T @ s / T, s.T @ y / T
    for alpha in (0.01, 0.2):
        b = linear.descend(corr, cross, np.array([alpha * mix]), np.array([alpha * (1 - mix)]), 1e-10)[:, 0]
        grad = corr @ b - cross + alpha * (1 - mix) * b
        for g, v in zip(grad, b):
            assert (abs(g) <= alpha * mix + 1e-6) if v == 0 else g == pytest.approx(-np.sign(v) * alpha * mix, abs=1e-6)


def test_lasso_zeroes_everything_under_a_large_penalty():
    s = standard(X)(X)
    y = Y[:, 0] - Y[:, 0].mean()
    assert not linear.descend(s.T @ s / T, s.T @ y / T, np.array([50.0]), np.array([0.0])).any()


def test_short_samples_take_the_middle_penalty():
    z = np.column_stack([np.ones(12), X[:12], YS[:12]])
    a, b = z[:9].T @ z[:9], z.T @ z
    assert linear.tune(a, b, [("raw", FW)], LAYOUT.width, LAYOUT.target("a"), "ridge") == (float(np.median(linear.RIDGE_GRID)), 0.0)


def test_user_model_sees_only_its_training_rows(spark):
    days = [dt.date.fromisoformat(shift_literal(FIRST, i)) for i in range(20)]
    df = spark.createDataFrame([("k", d, float(i)) for i, d in enumerate(days)], "k string, date date, y double")
    got = W.walk_forward(df, ["k"], lambda train, live: [train["y"].max() * 100 + train["y"].min()] * len(live), shift_literal(FIRST, 10), 2, refit_every=4)
    rows = {r.date: r.y_hat for r in got.collect()}
    assert [rows[d] for d in days[10:]] == [(10 + (i // 4) * 4 - 3) * 100.0 for i in range(10)]


def test_importance_names(rows):
    coefs = W.coefficients(rows, LAYOUT, [("raw", FW)], START, GAP, refit_every=6)
    got = {(r.target, r.name): r.mean_abs for r in W.importance(coefs, LAYOUT).collect()}
    assert set(got) == set(itertools.product(["a", "b"], ["(intercept)", *NAMES])) and got["a", "x5"] == 0.0


def lasso(z, y, alpha):
    """Plain coordinate descent on standardised features."""
    mu, sd = z.mean(0), z.std(0)
    q, c, b = (z - mu) / sd, y - y.mean(), np.zeros(z.shape[1])
    for _ in range(5000):
        before = b.copy()
        for j in range(len(b)):
            rho = q[:, j] @ (c - q @ b + q[:, j] * b[j]) / len(y)
            b[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0)
        if np.abs(b - before).max() < 1e-10:
            break
    return lambda p: y.mean() + (p - mu) / sd @ b


@pytest.mark.parametrize("alphas", [None, (0.01, 0.1, 1.0), (0.05,)])
def test_grid_over_components_and_penalties(rows, alphas):
    from monthspine.operators import origins as O

    groups = [LAYOUT.cols("macro")[:3], LAYOUT.cols("macro")[3:]]
    variants = O.component_variants([("pca", LAYOUT.cols("fwd"), 2, True)], groups, [1, 2, 3])
    got = {(r.date.year * 12 + r.date.month - 24001, r.target): r for r in O.grid_forecast(rows, LAYOUT, variants, START, GAP, alphas, refit_every=4).collect()}

    def model(x, y, k, alpha):
        maps = [pca(x[:, :3], 2, True), pca(x[:, 3:6], k, True), pca(x[:, 6:], k, True)]
        fmap = lambda p: np.column_stack([m(p[:, c]) for m, c in zip(maps, (slice(0, 3), slice(3, 6), slice(6, 9)))])
        fit = ols(fmap(x), y) if alpha is None else lasso(fmap(x), y, alpha)
        return lambda p: fit(fmap(p))

    for t in range(48, T):
        end = 48 + (t - 48) // 4 * 4 - GAP
        cut = int(end * 0.85)
        for j, g in enumerate(["a", "b"]):
            y = YS[:, j]
            tried = [(((model(X[:cut], y[:cut], k, al)(X[cut:end]) - y[cut:end]) ** 2).mean(), i, k - 1)
                     for i, al in enumerate(alphas or [None]) for k in (1, 2, 3)]
            loss, i, v = min(tried)
            r = got[t, g]
            assert (r.variant, r.alpha) == (v, alphas[i] if alphas else 0.0)
            assert r.val_loss == pytest.approx(loss, rel=1e-3)
            assert r.y_hat == pytest.approx(model(X[:end], y[:end], v + 1, alphas[i] if alphas else None)(X[t : t + 1])[0], abs=2e-3)


def test_factor_of_the_own_target(rows):
    steps = [("cp", LAYOUT.cols("fwd"), None), ("pca", LAYOUT.cols("macro"), 2, True)]
    got = collected(W.linear_forecast(rows, LAYOUT, steps, START, GAP))

    def make(x, y, mean):
        cp, pcs = ols(x[:, :3], y), pca(x[:, 3:], 2, True)
        return through(lambda p: np.column_stack([cp(p[:, :3]), pcs(p[:, 3:])]), x, y)

    for k, v in direct(make).items():
        assert got[k] == pytest.approx(v, abs=1e-8)
