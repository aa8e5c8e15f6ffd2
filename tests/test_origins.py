"""Fits on imputed, chosen and revised columns against fits on each origin's own rows."""

import datetime as dt

import numpy as np
import pytest

from monthspine.functions import linear
from monthspine.operators import origins as O
from monthspine.operators import walkforward as W

NAMES, GOALS = ["a", "b", "c", "d"], ["t", "u"]
LAYOUT = W.Design({"all": NAMES}, GOALS)
GAP, N = 2, 48


def month(i):
    first = dt.date(1990 + (i + 1) // 12, (i + 1) % 12 + 1, 1)
    return first - dt.timedelta(days=1)


def number(i):
    return month(i).year * 12 + month(i).month


def data(seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(N, 4))
    y = x[:, :2] @ rng.normal(size=(2, 2)) + 0.3 * rng.normal(size=(N, 2))
    x[rng.random((N, 4)) < 0.15] = np.nan
    x[0, :3] = 0.5
    x[:7, 3] = np.nan
    x[38:, 2] = np.nan
    y[-3:] = np.nan
    return x, y


def long(spark, values, names):
    rows = [(month(i), n, float(v)) for i, line in enumerate(values) for n, v in zip(names, line) if not np.isnan(v)]
    return spark.createDataFrame(rows, "date date, name string, value double")


def plain(x, y, start, impute, timing, every, kind="ols"):
    """Follows the rows of each origin: impute, mask, choose, carry forward, fit."""
    out, log, kept = {}, {}, None
    for k, t in enumerate(range(start, N)):
        seen, end = x[: t + 1].copy(), t - GAP
        if impute:
            fill = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in seen[:end].T])
            known = ~np.isnan(seen)
            filled = np.where(known, seen, fill)
            if timing:
                for j in range(4):
                    at = np.flatnonzero(known[:, j])
                    outside = np.ones(t + 1, bool) if not len(at) else (np.arange(t + 1) < at[0]) | (np.arange(t + 1) > at[-1])
                    filled[outside & ~known[:, j], j] = np.nan
            seen = filled
        if k % every == 0:
            kept = ~np.isnan(seen[:end]).any(0)
            cols = np.flatnonzero(kept)
            ok = ~np.isnan(y[:end]).any(1)
            z = np.column_stack([np.ones(end), seen[:end][:, cols], y[:end]])[ok]
            width, cut = 1 + len(cols), int(end * 0.85)
            s, early = z.T @ z, (zc := z[: ok[:cut].sum()]).T @ zc
            fits = [O.logged_fit(early, s, [("raw", list(range(1, width)))] if len(cols) else [], width, width + j, kind) for j in range(2)]
            for j, g in enumerate(GOALS):
                log[number(t), g] = fits[j]["val_loss"], fits[j]["alpha"], int(kept.sum())
        row = seen.copy()
        for i in range(1, t + 1):
            row[i] = np.where(np.isnan(row[i]), row[i - 1], row[i])
        for j, g in enumerate(GOALS):
            out[month(t), g] = float(np.dot(fits[j]["coef"], np.concatenate([[1.0], row[t][cols]])))
    return out, log


@pytest.mark.parametrize(("impute", "timing", "every", "kind"), [
    (True, True, 1, "ols"), (True, False, 1, "ols"), (False, True, 1, "ols"), (True, True, 5, "ols"), (True, True, 4, "ridge"),
])
def test_equals_each_origins_own_rows(spark, impute, timing, every, kind):
    x, y = data(3)
    fits, df = O.expanding_fits(
        long(spark, x, NAMES), long(spark, y, GOALS), LAYOUT, [("raw", [1, 2, 3, 4])], str(month(20)), GAP, kind,
        refit_every=every, impute=impute, keep_timing=timing,
    )
    want, log = plain(x, y, 20, impute, timing, every, kind)
    got = {(r.date, r.target): r.y_hat for r in df.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-7), k
    for r in fits.collect():
        loss, alpha, n = log[r.fit_m, r.target]
        assert (r.val_loss, r.alpha, sum(r.kept)) == (pytest.approx(loss), pytest.approx(alpha), n)


@pytest.mark.parametrize("impute", [True, False])
def test_later_months_change_no_forecast(spark, impute):
    x, y = data(5)
    call = lambda a, b: {(r.date, r.target): r.y_hat for r in O.expanding_fits(
        long(spark, a, NAMES), long(spark, b, GOALS), LAYOUT, [("raw", [1, 2, 3, 4])], str(month(20)), GAP, impute=impute)[1].collect()}
    whole = call(x, y)
    x2, y2 = x.copy(), y.copy()
    x2[35:] = 9.0
    y2[35:] -= 4.0
    for k, v in call(x2, y2).items():
        if k[0] < month(35):
            assert v == pytest.approx(whole[k])


def revised(spark, versions, y):
    rows = [(month(o), month(i), n, float(v)) for o, x in versions.items() for i, line in enumerate(x) for n, v in zip(NAMES, line) if not np.isnan(v)]
    features = spark.createDataFrame(rows, "origin date, date date, name string, value double")
    return O.revised_design(features, long(spark, y, GOALS), LAYOUT)


def history(seed=1):
    """Every origin's version of its months: some entries revised, some missing for a while."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(N, 4))
    y = base[:, :2] @ rng.normal(size=(2, 2)) + 0.2 * rng.normal(size=(N, 2))
    versions = {}
    for o in range(N):
        x = base[: o + 1].copy()
        if o % 3 == 0:
            x[rng.integers(0, o + 1, 2), rng.integers(0, 4)] += 0.5
        if o % 7 == 0 and o > 5:
            x[rng.integers(0, o - 3), 1] = np.nan
        versions[o] = x
    return versions, y


def test_moments_by_differences_equal_whole_ones(spark):
    versions, y = history()
    got = {r.origin: linear.unpack(np.array(r.moments), LAYOUT.size) for r in O.revised_moments(revised(spark, versions, y), LAYOUT.size, GAP).collect()}
    for o in range(GAP + 1, N):
        z = np.column_stack([np.ones(o - GAP), versions[o][: o - GAP], y[: o - GAP]])
        z = z[~np.isnan(z).any(1)]
        assert got[number(o)] == pytest.approx(z.T @ z, abs=1e-9), o


def test_only_changed_rows_reach_the_sums(spark):
    versions, y = history()
    versions = {o: versions[N - 1][: o + 1] for o in versions}
    assert O.changed_rows(revised(spark, versions, y), GAP).count() == N - GAP - 1
    versions[N - 4] = versions[N - 4] + 0.25
    # one origin's version differs in all months: they change there and back
    assert O.changed_rows(revised(spark, versions, y), GAP).count() == (N - GAP - 1) + 2 * (N - 4 - GAP - 1) + 1


@pytest.mark.parametrize("kind", ["ols", "ridge"])
def test_fits_on_own_versions(spark, kind):
    versions, y = history(2)
    fits, df = O.revised_fits(revised(spark, versions, y), LAYOUT, [("raw", [1, 2, 3, 4])], str(month(20)), GAP, kind, refit_every=3)
    got = {(r.date, r.target): r.y_hat for r in df.collect()}
    log = {(r.fit_m, r.target): r for r in fits.collect()}
    for k, t in enumerate(range(20, N)):
        if k % 3 == 0:
            end, cut = t - GAP, int((t - GAP) * 0.85)
            z = np.column_stack([np.ones(end), versions[t][:end], y[:end]])
            ok = ~np.isnan(z).any(1)
            early, whole = z[:cut][ok[:cut]], z[ok]
            fit = [O.logged_fit(early.T @ early, whole.T @ whole, [("raw", [1, 2, 3, 4])], 5, 5 + j, kind) for j in range(2)]
            for j, g in enumerate(GOALS):
                assert log[number(t), g].val_loss == pytest.approx(fit[j]["val_loss"])
        for j, g in enumerate(GOALS):
            want = np.dot(fit[j]["coef"], np.concatenate([[1.0], versions[t][t]]))
            if np.isnan(want):
                assert got[month(t), g] is None
            else:
                assert got[month(t), g] == pytest.approx(want, abs=1e-7)
