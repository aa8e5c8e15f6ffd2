import datetime as dt

import numpy as np
import pytest

from monthspine.functions.calendar import shift_literal
from monthspine.operators import benchmarks as B

Y = [0.3, -0.1, 0.4, 0.1, 0.5, -0.2, 0.6, 0.2]


def series(spark, y):
    rows = [("a", dt.date.fromisoformat(shift_literal("2000-01-31", i)), v) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "k string, date date, y double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


@pytest.mark.parametrize("gap", [0, 2])
def test_hist_mean_reads_nothing_after_the_gap(spark, gap):
    got = column(B.with_benchmarks(series(spark, Y), ["k"], gap, kinds=["hist_mean"]), "hist_mean")
    for t, v in enumerate(got):
        end = t - gap
        assert (v is None) if end < 1 else v == pytest.approx(np.mean(Y[:end]))


@pytest.mark.parametrize("halflife", [1, 12])
def test_ewma(spark, halflife):
    got = column(B.with_ewma(series(spark, Y), ["k"], halflife=halflife), "ewma")
    alpha, e = 1 - 0.5 ** (1 / halflife), Y[0]
    assert got[0] is None
    for t in range(1, len(Y)):
        assert got[t] == pytest.approx(e)
        e = alpha * Y[t] + (1 - alpha) * e


def test_ewma_over_many_half_lives(spark):
    """Powers would leave the double range after a thousand half-lives."""
    y = [0.1 + (i * 37 % 101) / 50 for i in range(160)]
    got = column(B.with_ewma(series(spark, y), ["k"], halflife=0.1), "ewma")
    alpha, e = 1 - 0.5**10, y[0]
    for t in range(1, len(y)):
        assert got[t] == pytest.approx(e, rel=1e-12)
        e = alpha * y[t] + (1 - alpha) * e


def test_ar1_matches_least_norm_regression(spark):
    got = column(B.with_ar1(series(spark, Y), ["k"]), "ar1")
    assert got[:2] == [None, None]
    for t in range(2, len(Y)):
        x = np.column_stack([np.ones(t - 1), Y[: t - 1]])
        c = np.linalg.lstsq(x, np.array(Y[1:t]), rcond=None)[0]
        assert got[t] == pytest.approx(c[0] + c[1] * Y[t - 1])


def test_missing_outcome_empties_the_benchmark(spark):
    y = [0.3, None, 0.4, 0.1]
    d = B.with_benchmarks(series(spark, y), ["k"], window=2)
    assert column(d, "hist_mean") == [None, 0.3, None, None]
    assert column(d, "rolling") == [None, 0.3, None, None]


def test_unknown_benchmark(spark):
    with pytest.raises(ValueError):
        B.with_benchmarks(series(spark, Y), ["k"], kinds=["median"])
