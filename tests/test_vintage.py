import datetime as dt

import pytest
from pyspark.sql import functions as F

from monthspine import fixed_values as fv
from monthspine.operators import vintage as V

HIST = "series_id string, obs string, start string, end string, value double"
D = dt.date.fromisoformat


def history(spark, rows):
    h = spark.createDataFrame(rows, HIST)
    return h.select("series_id", *[F.col(a).cast("date").alias(b) for a, b in [("obs", "obs_date"), ("start", "realtime_start"), ("end", "realtime_end")]], "value")


# January is revised in April; March is never published; revisions start mid-month
ROWS = [
    ("a", "2000-01-31", "2000-02-10", "2000-04-14", 1.0),
    ("a", "2000-01-31", "2000-04-15", "9999-12-31", 1.5),
    ("a", "2000-02-29", "2000-03-31", "9999-12-31", 2.0),
    ("a", "2000-04-30", "2000-05-20", "9999-12-31", 4.0),
]


def test_asof_with_revision_and_gap(spark):
    got = {(str(r.as_of)[:7], str(r.obs_date)[:7]): r.value for r in V.asof_panel(history(spark, ROWS), "2000-01-31", "2000-06-30").collect()}
    assert got == {
        ("2000-02", "2000-01"): 1.0, ("2000-03", "2000-01"): 1.0, ("2000-03", "2000-02"): 2.0,
        ("2000-04", "2000-01"): 1.5, ("2000-04", "2000-02"): 2.0,
        ("2000-05", "2000-01"): 1.5, ("2000-05", "2000-02"): 2.0, ("2000-05", "2000-04"): 4.0,
        ("2000-06", "2000-01"): 1.5, ("2000-06", "2000-02"): 2.0, ("2000-06", "2000-04"): 4.0,
    }


def test_asof_never_reads_the_future(spark):
    h = history(spark, ROWS)
    valid = V.expand_validity(h, "2000-01-31", "2000-12-31")
    assert valid.where((F.col("realtime_start") > F.col("as_of")) | (F.col("realtime_end") < F.col("as_of"))).count() == 0


def test_null_value_of_the_newest_vintage_wins(spark):
    h = history(spark, [("a", "2000-01-31", "2000-01-31", "2000-02-28", 1.0), ("a", "2000-01-31", "2000-02-29", "9999-12-31", None)])
    assert [r.value for r in V.asof_panel(h, "2000-01-31", "2000-02-29").orderBy("as_of").collect()] == [1.0, None]


REG = "series string, kind string, target string, num string, den string, rule string, lag_mode string, lag_months int, lag_schedule string, tcode int"


def registry(spark, rows):
    return spark.createDataFrame(rows, REG)


def direct(name, rule="same_month_end"):
    return (name, "direct_alfred", name, None, None, rule, "fixed", 1, "", 1)


def test_picks(spark):
    h = history(spark, ROWS)
    reads = V.decision_reads(registry(spark, [direct("a", "month_end_plus_1m")]))
    strict = {str(r.decision)[:7]: (r.value, str(r.obs_date)[:7]) for r in V.pick_strict(h, reads, "2000-01-31", "2000-06-30").collect()}
    assert strict == {"2000-02": (1.0, "2000-01"), "2000-03": (2.0, "2000-02"), "2000-04": (2.0, "2000-02"), "2000-05": (4.0, "2000-04"), "2000-06": (4.0, "2000-04")}
    latest = {str(r.decision)[:7]: r.value for r in V.pick_latest(h, reads, "2000-01-31", "2000-06-30").collect()}
    assert latest == {"2000-02": 1.5, "2000-03": 2.0, "2000-04": 2.0, "2000-05": 4.0, "2000-06": 4.0}
    early = {str(r.decision)[:7]: r.value for r in V.pick_earliest(h, V.decision_reads(registry(spark, [direct("a")])), "1999-12-31", "2000-06-30").collect()}
    assert early == {"2000-01": 1.0}


def test_selection(spark):
    months = spark.createDataFrame([("2000-03-31",), ("2000-04-30",), ("2000-07-31",)], "m string").select(F.col("m").cast("date").alias("vintage_month"))
    dates = spark.createDataFrame([("2000-01-31",), ("2000-02-29",), ("2000-05-31",), ("2000-09-30",)], "d string").select(F.col("d").cast("date").alias("forecast_date"))
    got = {str(r.forecast_date)[:7]: (str(r.selected_archive_month)[:7], r.archive_source_tag) for r in V.vintage_selection(dates, months).collect()}
    assert got == {
        "2000-01": ("2000-03", fv.TAG_ANCHOR), "2000-02": ("2000-03", fv.TAG_ARCHIVE),
        "2000-05": ("2000-04", fv.TAG_ARCHIVE), "2000-09": ("2000-07", fv.TAG_ARCHIVE),
    }


def frame(spark, rows, schema, dates):
    df = spark.createDataFrame(rows, schema)
    for c in dates:
        df = df.withColumn(c, F.col(c).cast("date"))
    return df


def backfill(spark, tag, blocked):
    """Series x is known in February only; its archive starts in May with values back to January."""
    bal = frame(spark, [
        ("2000-01-31", "x", None, ""), ("2000-02-29", "x", 9.0, fv.TAG_STRICT), ("2000-03-31", "x", None, ""),
        ("2000-04-30", "x", None, ""), ("2000-05-31", "x", None, ""), ("2000-06-30", "x", None, ""),
    ], "decision string, series string, value double, tag string", ["decision"])
    arch = frame(spark, [("2000-05-31", f"2000-{m:02d}-{d}", "x", 10.0 + m) for m, d in [(1, 31), (2, 29), (3, 31), (4, 30)]],
                 "vintage_month string, date string, series_id string, value double", ["vintage_month", "date"])
    plain = frame(spark, [("2000-01-31", "x", 100.0), ("2000-04-30", "x", 400.0)], "date string, series string, value double", ["date"])
    out = V.anchor_backfill(bal, registry(spark, [direct("x")]), arch, plain, tag=tag, blocked=blocked)
    return [(r.value, r.tag) for r in out.orderBy("decision").collect()]


def test_backfill_from_anchor_then_same_month_then_plain(spark):
    tag = fv.TAG_ANCHOR_VINTAGE
    assert backfill(spark, tag, []) == [
        (11.0, tag), (9.0, fv.TAG_STRICT), (13.0, tag), (14.0, tag), (14.0, tag), (400.0, fv.TAG_NON_REVISED)]


def test_backfill_blocked_series_takes_nothing_before_its_archive_once_started(spark):
    tag = fv.TAG_ANCHOR_VINTAGE
    assert backfill(spark, tag, ["x"]) == [
        (11.0, tag), (9.0, fv.TAG_STRICT), (None, ""), (None, ""), (14.0, tag), (400.0, fv.TAG_NON_REVISED)]


def test_panel_invariants(spark):
    import __spark_entry__ as entry

    p = entry.queries()["vintage_panel"](spark, "/root/testdata/sf0.001")
    assert p.groupBy("forecast_date", "date", "series").count().where("count > 1").count() == 0
    assert p.where((F.col("tag") == fv.TAG_MISSING) != F.col("raw").isNull()).count() == 0
    assert p.groupBy("forecast_date").agg(F.countDistinct("series").alias("n")).select("n").distinct().count() == 1


def test_unknown_rule_fails(spark):
    with pytest.raises(Exception, match="unknown release rule"):
        V.pick_strict(history(spark, ROWS), V.decision_reads(registry(spark, [direct("a", "weekly")])), "2000-01-31", "2000-06-30").collect()


def test_features_need_every_macro_series_in_the_registry(spark):
    f = frame(spark, [("2000-01-31", "macro", "z", 1.0)], "date string, source string, series string, value double", ["date"])
    p = frame(spark, [("2000-01-31", "2000-01-31", "a", 1.0)], "forecast_date string, date string, series string, transformed double", ["forecast_date", "date"])
    names = spark.createDataFrame([("a",)], "series string")
    with pytest.raises(Exception, match="without as-of data: z"):
        V.realtime_features(f.unionByName(f.withColumn("source", F.lit("curve"))), p, p, names, "2000-01-31", "2000-02-29").collect()


def test_best_while_valid_equals_looking_at_every_month(spark):
    import random

    rnd = random.Random(2)
    spans = []
    for key in "ab":
        for rank in range(60):
            lo = rnd.randint(23990, 24080)
            spans.append((key, lo, lo + rnd.choice([-1, 0, 1, 2, 7, 15, 31, 400]), rank, float(rank)))
    df = spark.createDataFrame(spans, "key string, lo int, hi int, rank long, value double")
    of = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    for first, last in (("2000-03-31", "2005-06-30"), ("2001-01-31", "2001-01-31")):
        got = {(r.key, r.m): (r.rank, r.value) for r in V.best_while_valid(df, of, first, last).collect()}
        a, b = (int(d[:4]) * 12 + int(d[5:7]) for d in (first, last))
        live = lambda k, m: [s[3] for s in spans if s[0] == k and s[1] <= m <= s[2]]
        assert got == {(k, m): (max(live(k, m)), float(max(live(k, m)))) for k in "abc" for m in range(a, b + 1) if live(k, m)}


def test_a_span_is_never_unfolded_over_its_months(spark):
    df = spark.createDataFrame([("a", 0, 999_999, 1, 1.0)], "key string, lo int, hi int, rank long, value double")
    plan = V.best_while_valid(df, df.select("key").distinct(), "1900-01-31", "2150-12-31")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2  # two blocks of the span, and the months of the key
