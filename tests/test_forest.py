"""Forests against trees grown one node at a time, and against a plain loop over refits and settings."""

import datetime as dt

import numpy as np
import pytest

from monthspine.operators import forest as FO
from monthspine.operators import walkforward as W


def plain_tree(x, y, w, depth, leaf):
    """Nested tuples (mean,) or (mean, feature, edge, left, right) by trying every split."""
    here = w > 0
    mean = np.average(y[here], weights=w[here])
    if depth == 0 or np.ptp(y[here]) == 0:
        return (mean,)
    best, tie = None, FO.EQUAL * (w * (y - y.mean()) ** 2).sum()
    for f in range(x.shape[1]):
        values = np.unique(x[here, f])
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            sides = [here & (x[:, f] <= cut), here & (x[:, f] > cut)]
            if min(s.sum() for s in sides) < leaf:
                continue
            sse = sum((w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum() for s in sides)
            if best is None or sse < best[0] - tie:
                best = sse, f, cut, sides
    if best is None:
        return (mean,)
    return mean, best[1], best[2], *[plain_tree(x, y, np.where(s, w, 0), depth - 1, leaf) for s in best[3]]


def walk(tree, row, depth):
    while depth and len(tree) > 1:
        tree, depth = tree[3 + int(row[tree[1]] > tree[2])], depth - 1
    return tree[0]


@pytest.mark.parametrize("leaf", [1, 5])
def test_trees_equal_plain_ones_at_every_depth(leaf):
    rng = np.random.default_rng(leaf)
    x = rng.normal(size=(40, 4))
    x[:, 1] = np.round(x[:, 1])
    y, ahead = x[:, 0] * x[:, 2] + rng.normal(size=40), rng.normal(size=(25, 4))
    counts = FO.bootstrap(40, 0, 6, 42)
    grown = FO.grow(x, y, counts, 5, leaf)
    for t in range(6):
        tree = plain_tree(x, y, counts[t], 5, leaf)
        for depth in (0, 2, 3, 5):
            assert grown.predict(ahead, depth)[t] == pytest.approx([walk(tree, r, depth) for r in ahead])


def test_spans_end_at_every_forest_size():
    spans = FO.Grid().spans()
    assert {200, 500, 1000} <= {b for _, b in spans} and spans[0][0] == 0
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and max(b - a for a, b in spans) <= FO.SPAN


def month(i):
    d = dt.date(1990 + i // 12, i % 12 + 1, 28)
    return (d.replace(day=1) + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1)


def series(seed=0, n=60):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.column_stack([x[:, 0] + 0.5 * rng.normal(size=n), np.where(x[:, 1] > 0, 1.0, -1.0) + 0.1 * rng.normal(size=n)])
    x[:4, 2] = np.nan
    x[n - 10, 0] = np.nan
    y[20, 0] = np.nan
    y[-12:] = np.nan
    return x, y


LAYOUT = W.Design({"all": ["a", "b", "c"]}, ["t", "u"])


def frame(spark, x, y):
    none = lambda v: None if np.isnan(v) else float(v)
    rows = [(month(i), (1990 + i // 12) * 12 + i % 12 + 1, [1.0, *map(none, x[i]), *map(none, y[i])]) for i in range(len(x))]
    return spark.createDataFrame(rows, "date date, m int, z array<double>")


def plain_forecast(x, y, first, gap, grid, every, tune_every):
    out = {}
    for t, name in enumerate(LAYOUT.targets):
        kept = grid.settings()[0]
        for k, fit in enumerate(range(first, len(x), every)):
            ok = np.arange(len(x)) < fit - gap
            ok &= ~np.isnan(x).any(1) & ~np.isnan(y[:, t])
            n, cut = ok.sum(), int(ok.sum() * 0.85)
            xs, ys = x[ok], y[ok, t]
            value = lambda xa, ya, rows, s: np.mean([[walk(tree, r, s[1]) for r in rows] for tree in (
                plain_tree(xa, ya, w, s[1], s[2]) for w in FO.bootstrap(len(ya), 0, s[0], 7))], 0)
            if k % tune_every == 0 and cut >= 10 and n - cut >= 3:
                errors = [((ys[cut:] - value(xs[:cut], ys[:cut], xs[cut:], s)) ** 2).mean() for s in grid.settings()]
                kept = grid.settings()[int(np.argmin(errors))]
            for i in range(fit, min(fit + every, len(x))):
                if not np.isnan(x[i]).any():
                    out[month(i), name] = (value(xs, ys, x[i : i + 1], kept)[0], *kept)
    return out


def test_equals_a_plain_loop(spark):
    x, y = series()
    grid = FO.Grid((3, 5), (1, 3), (1, 4))
    df = FO.forest_forecast(frame(spark, x, y), LAYOUT, LAYOUT.cols("all"), str(month(24)), 3, grid, refit_every=5, tune_every=3, seed=7)
    got = {(r.date, r.target): (r.y_hat, r.trees, r.depth, r.leaf) for r in df.collect()}
    want = plain_forecast(x, y, 24, 3, grid, 5, 3)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k
    assert len({v[1:] for v in got.values()}) > 1


def test_short_samples_take_the_default(spark):
    x, y = series(n=30)
    grid = FO.Grid((3, 5), (1, 3), (1, 4))
    df = FO.forest_forecast(frame(spark, x, y), LAYOUT, LAYOUT.cols("all"), str(month(14)), 3, grid, refit_every=5, tune_every=1, seed=7)
    early = [r for r in df.collect() if r.date <= month(18)]
    assert early and {(r.trees, r.depth, r.leaf) for r in early} == {grid.settings()[0]}


def test_later_months_change_no_forecast(spark):
    x, y = series(3)
    call = lambda a, b: {(r.date, r.target): r.y_hat for r in FO.forest_forecast(
        frame(spark, a, b), LAYOUT, LAYOUT.cols("all"), str(month(30)), 3, FO.Grid((4,), (2, 3), (1,)), refit_every=4, tune_every=2).collect()}
    whole = call(x, y)
    x2, y2 = x.copy(), y.copy()
    x2[42:] += 5
    y2[42:] -= 5
    for k, v in call(x2, y2).items():
        if k[0] < month(42):
            assert v == pytest.approx(whole[k])
