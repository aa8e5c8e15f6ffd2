import pytest
from pyspark.sql import functions as F

from monthspine.functions.calendar import shift_literal
from monthspine.operators import ensemble as E

# seed 0 validates best but forecasts worst; seed 2 is missing in the last month
MONTHS = [shift_literal("2000-01-31", i) for i in range(5)]
TRUTH = [1.0, 1.0, 1.0, 1.0, 1.0]
HATS = {0: [3.0] * 5, 1: [1.5] * 5, 2: [1.1, 1.1, 1.1, 1.1, None]}
LOSS = {0: 0.1, 1: 0.2, 2: 0.3}


@pytest.fixture
def cube(spark):
    rows = [(d, 12, s, HATS[s][i], LOSS[s]) for i, d in enumerate(MONTHS) for s in HATS if HATS[s][i] is not None]
    return spark.createDataFrame(rows, "d string, maturity int, seed int, y_hat double, val_loss double").select(
        F.col("d").cast("date").alias("date"), "maturity", "seed", "y_hat", "val_loss")


@pytest.fixture
def truth(spark):
    return spark.createDataFrame(list(zip(MONTHS, TRUTH)), "d string, y double").select(F.col("d").cast("date").alias("date"), F.lit(12).alias("maturity"), "y")


def members(df):
    out = {}
    for r in df.collect():
        out.setdefault(str(r.date), set()).add(r.seed)
    return [out.get(d, set()) for d in MONTHS]


def test_trailing_with_fallback(cube, truth):
    got = members(E.members_by_trailing(cube, truth, 1, lookback=2, min_history=2, lag=1))
    assert got == [{0}, {0}, {0}, {2}, {2}]


def test_trailing_without_fallback(cube, truth):
    got = members(E.members_by_trailing(cube, truth, 1, lookback=2, min_history=2, lag=1, fallback=False))
    assert got == [set(), set(), set(), {2}, {2}]


def test_a_member_without_forecast_keeps_its_place_but_not_its_vote(cube, truth):
    m = E.members_by_trailing(cube, truth, 2, lookback=2, min_history=2, lag=1)
    last = [r for r in E.combine(m).collect() if str(r.date) == MONTHS[-1]][0]
    assert (last.members, last.y_hat) == (2, 1.5)


def test_size_never_exceeds_k(cube):
    assert E.members_by_validation(cube, 2).groupBy("date", "maturity").count().where("count > 2").count() == 0


def test_same_selection_gives_the_same_ensemble(cube):
    a, b = (E.combine(E.members_by_validation(cube, 2)) for _ in range(2))
    assert a.exceptAll(b).count() == 0


def test_turnover(spark, cube, truth):
    got = {str(r.date): r.replaced for r in E.turnover(E.members_by_trailing(cube, truth, 1, 2, 2, 1)).collect()}
    assert [got[d] for d in MONTHS] == [0, 0, 0, 1, 0]


def test_quantiles_with_an_outlier(spark):
    """One huge value must not move the others into one bin, nor change a quantile."""
    import datetime as dt

    import numpy as np

    days = [dt.date.fromisoformat(shift_literal("2000-01-31", i)) for i in range(12)]
    rng = np.random.default_rng(4)
    rows = [(d, float(v)) for d in days for v in rng.normal(size=50)] + [(days[3], 1e9), (days[5], None)]
    got = E.expanding_quantiles(spark.createDataFrame(rows, "date date, v double"), "v", {"lo": 0.05, "mid": 0.5, "hi": 0.99}).collect()
    for r in got:
        seen = [v for d, v in rows if d <= r.date and v is not None]
        assert (r.lo, r.mid, r.hi) == pytest.approx(tuple(np.quantile(seen, [0.05, 0.5, 0.99])))
    assert len(got) == 12
