import pytest
from pyspark.sql import functions as F

from monthspine import fixed_values as fv
from monthspine.functions import columns as C
from monthspine.operators import grouping as G
from monthspine.operators import lags as L
from monthspine.operators import panel as P
from monthspine.operators import registry as R
from monthspine.operators import transforms as T
from monthspine.operators import vintage as V


def months(spark, n=6, value=None):
    d = spark.range(n).select(F.last_day(F.add_months(F.lit("2000-01-31").cast("date"), F.col("id").cast("int"))).alias("date"), F.lit("s").alias("series"))
    return d.withColumn("value", value if value is not None else F.month("date").cast("double"))


def test_unknown_transform_code(spark):
    with pytest.raises(Exception, match="unknown transform code"):
        T.apply_tcodes(months(spark).withColumn("tcode", F.lit(8)), ["series"]).collect()


def test_transform_codes_by_hand(spark):
    x = [1.0, 2.0, 4.0, 7.0]
    import math

    want = {1: 7.0, 2: 3.0, 3: 1.0, 4: math.log(7), 5: math.log(7 / 4), 6: math.log(7 / 4) - math.log(2), 7: 7 / 4 - 1 - 1}
    for code, v in want.items():
        d = spark.createDataFrame([(f"2000-0{i + 1}-28", "s", y, code) for i, y in enumerate(x)], "date string, series string, value double, tcode int")
        assert T.apply_tcodes(d, ["series"]).orderBy("date").collect()[-1].transformed == pytest.approx(v)


def test_logs_of_non_positive_values_are_missing(spark):
    d = spark.createDataFrame([("2000-01-31", "s", -1.0, 4), ("2000-02-29", "s", 0.0, 4)], "date string, series string, value double, tcode int")
    assert [r.transformed for r in T.apply_tcodes(d, ["series"]).collect()] == [None, None]


@pytest.mark.parametrize("selector", ["every_nth:0", "weekly", "spaced:x"])
def test_unknown_selector(spark, selector):
    with pytest.raises(ValueError):
        P.select_dates(months(spark), selector)


def test_listed_date_outside(spark):
    with pytest.raises(Exception, match="outside the calendar"):
        P.select_dates(months(spark), ["1999-01-31"]).collect()
    assert P.select_dates(months(spark), "spaced:0").count() == 0
    assert [r.date.month for r in P.select_dates(months(spark), "spaced:1").collect()] == [1]


def test_strict_grouping(spark):
    mapping = spark.createDataFrame([("t", "g")], "series string, grp string")
    with pytest.raises(Exception, match="series without a group"):
        G.attach_group(months(spark), mapping).collect()
    assert {r.grp for r in G.attach_group(months(spark), mapping, default="Other").collect()} == {"Other"}


def test_full_mapping(spark):
    macro = spark.createDataFrame([("RPI",), ("GS10",)], "series string")
    fwd = spark.createDataFrame([("12",)], "series string")
    got = {(r.series, r.grp) for r in G.full_mapping(macro, fwd, fwd).collect()}
    assert got == {("RPI", "Output and Income"), ("GS10", "Interest and Exchange Rates"), ("12", "Forward Rates"), ("12", "Yields")}
    assert len(fv.series_groups()) == len({s for s, _ in fv.series_groups()}) == 126


def test_registry_needs_codes(spark):
    names = spark.createDataFrame([("RPI", 5), ("HWIURATIO", None)], "series string, tcode int")
    with pytest.raises(Exception, match="without transform code"):
        R.build_registry(names, R.rule_rows(), L.default_policies(spark)).collect()


def test_registry_defaults(spark):
    names = spark.createDataFrame([("RPI", 5), ("HWIURATIO", 2), ("GS10", 2), ("EXJPUSx", 5), ("CLAIMSx", 5), ("S&P PE ratio", 5)], "series string, tcode int")
    got = {r.series: r for r in R.build_registry(names, R.rule_rows(), L.default_policies(spark)).collect()}
    assert (got["RPI"].kind, got["RPI"].target, got["RPI"].lag_months) == ("direct_alfred", "RPI", 2)
    assert (got["HWIURATIO"].kind, got["HWIURATIO"].target, got["HWIURATIO"].components, got["HWIURATIO"].formula) == ("derived_formula", "", '["JTSJOL","UNEMPLOY"]', "JTSJOL / UNEMPLOY")
    assert (got["EXJPUSx"].target, got["EXJPUSx"].revision_class) == ("EXJPUS", "market_effectively_nonrevised")
    assert (got["CLAIMSx"].kind, got["CLAIMSx"].target, got["CLAIMSx"].vintage_flag) == ("direct_fred", "ICSA", "N")
    assert (got["S&P PE ratio"].kind, got["S&P PE ratio"].lag_mode) == ("public_proxy", L.SCHEDULED)
    assert len(got["RPI"]) == 20


def test_schedule_beats_fixed_lag(spark):
    pol = L.resolve_policies(spark.createDataFrame([("S&P PE ratio",)], "series string"), L.default_policies(spark))
    d = pol.withColumn("d", F.lit("2000-03-31").cast("date"))
    assert d.select(L.lag_in_force("d").alias("n")).first().n == 5


def test_nan_is_missing(spark):
    d = spark.createDataFrame([("NaN",), ("1.5",), ("x",), (None,)], "t string")
    assert [r.v for r in d.select(C.to_number("t").alias("v")).collect()] == [None, 1.5, None, None]


def test_first_present():
    assert C.first_present(["R2", "r2_oos"], ["r2", "R2"]) == "R2"
    assert C.first_present(["x"], ["r2"]) is None


def test_clean_history(spark):
    raw = spark.createDataFrame([("a", "2000-01-15", "2000-02-01", " 9999-12-31 ", "1"), ("a", "bad", "2000-02-01", None, "1"), ("a", "2000-01-15", "2000-03-01", None, "?")],
                                "series_id string, obs_date string, realtime_start string, realtime_end string, value string")
    got = sorted((str(r.obs_date), str(r.realtime_start), str(r.realtime_end), r.value) for r in V.clean_history(raw).fillna(-1.0).collect())
    assert got == [("2000-01-31", "2000-02-01", "9999-12-31", 1.0), ("2000-01-31", "2000-03-01", "9999-12-31", -1.0)]
