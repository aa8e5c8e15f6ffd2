"""Training medians against plain medians of each origin's rows."""

import datetime
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from monthspine.operators import transforms as T

cells = st.one_of(st.none(), st.just(float("nan")), st.integers(-3, 3).map(float), st.floats(-1e6, 1e6))


def plain(values, gap):
    out = []
    for i in range(len(values)):
        seen = [v for v in values[: max(0, i - gap)] if v is not None and v == v]
        out.append(statistics.median(seen) if seen else None)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(cells, max_size=40), st.integers(0, 5))
def test_running_medians(values, gap):
    for got, wanted in zip(T.running_medians(values, gap), plain(values, gap), strict=True):
        assert got == (wanted if wanted is None else pytest.approx(wanted, rel=1e-9, abs=1e-9))


def test_every_column_row_and_key_stays(spark):
    month = lambda k: datetime.date(2000 + k // 12, k % 12 + 1, 1)
    series = {"a": [3.0, None, 1.0, 2.0, 9.0, None, 4.0], None: [None, None, 5.0], "c": [7.0]}
    rows = [(f"t{k}", month(k), s, v) for s, vs in series.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "note string, date date, series string, value double").repartition(5)
    out = T.training_median(df, ["series"], gap=1, all_missing=-1.0)
    assert out.columns == [*df.columns, "fill"] and out.count() == len(rows)
    for s, vs in series.items():
        got = sorted((r for r in out.collect() if r.series == s), key=lambda r: r.date)
        assert [(r.note, r.value) for r in got] == [(f"t{k}", v) for k, v in enumerate(vs)]
        assert [r.fill for r in got] == [-1.0 if m is None else m for m in plain(vs, 1)]
    assert T.training_median(df.limit(0), ["series"], gap=1).count() == 0


def test_no_list_per_row(spark):
    df = spark.createDataFrame([], "date date, series string, value double")
    plan = T.impute_training_median(df, ["series"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
