import datetime as dt

import pytest

from monthspine.operators.curve import excess_returns, require_maturities
from monthspine.sources import panels as P
from monthspine.sources import sinks as K
from monthspine.sources.curves import read_curve


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def got(df):
    return sorted(tuple(str(v) if isinstance(v, dt.date) else v for v in r) for r in df.collect())


def test_wide_csv_moves_to_the_previous_month_end(spark, tmp_path):
    path = write(tmp_path / "m.csv", "date,A,S&P 500\nTransform:,5,1\n1/1/2000,1.5,x\n2/1/2000,,3\n")
    values, codes = P.read_wide_csv(spark, path)
    assert got(codes) == [("A", 5), ("S&P 500", 1)]
    assert [r for r in got(values.fillna(-1.0)) if r[2] != -1.0] == [("1999-12-31", "A", 1.5), ("2000-01-31", "S&P 500", 3.0)]
    assert values.count() == 4


def test_wide_csv_rejects_other_shifts(spark, tmp_path):
    path = write(tmp_path / "m.csv", "date,A\n1/1/2000,1\n")
    with pytest.raises(ValueError):
        P.read_wide_csv(spark, path, shift="next")


def test_archive_tree_with_changing_columns(spark, tmp_path):
    write(tmp_path / "2000" / "2000-01.csv", 'sasdate,AMBSL,BOGMBASE,X\nTransform:,1,1,1\n1/1/2000,7,,1\n2/1/2000,,8,n/a\nbad,1,1,1\n')
    write(tmp_path / "2000" / "2000-02.csv", 'sasdate,X,"NEW"\nTransform:,1,1\n1/1/2000,2,5\n')
    write(tmp_path / "notes.csv", "sasdate,X\n1/1/2000,99\n")
    rows = P.read_vintage_archive(spark, str(tmp_path))
    assert [r for r in got(rows.fillna(-1.0)) if r[3] != -1.0] == [
        ("2000-01-31", "2000-01-31", "BOGMBASE", 7.0), ("2000-01-31", "2000-01-31", "X", 1.0), ("2000-01-31", "2000-02-29", "BOGMBASE", 8.0),
        ("2000-02-29", "2000-01-31", "NEW", 5.0), ("2000-02-29", "2000-01-31", "X", 2.0)]


def test_balanced_csv(spark, tmp_path):
    path = write(tmp_path / "b.csv", "decision_date,A\n2000-01-31,1\n2000-02-29,2\n2000-03-31,3\n")
    assert got(P.read_balanced_csv(spark, path, "2000-02-29", "2000-03-31")) == [("2000-02-29", "A", 2.0), ("2000-03-31", "A", 3.0)]


def test_curve_layouts(spark, tmp_path):
    kr = write(tmp_path / "kr.csv", "date,1,12\n2000-01-28,0.01,0.02\n2000-02-29,0.03,0.04\n")
    lw = write(tmp_path / "lw.csv", "% note\nyyyymm, 1m , 12m\n200001,1.0,2.0\n200002,3.0,4.0\n")
    head = "".join(f"line {i}\n" for i in range(9))
    gsw = write(tmp_path / "gsw.csv", head + "Date,BETA0,SVENY01,SVENY02\n2000-01-03,9,1,2\n2000-01-28,9,5,6\n2000-02-03,9,,8\n")
    args = ("2000-01-31", "2000-02-29")
    assert got(read_curve(spark, kr, "kr", *args, [1, 12])) == [("2000-01-31", 1, 0.01), ("2000-01-31", 12, 0.02), ("2000-02-29", 1, 0.03), ("2000-02-29", 12, 0.04)]
    assert got(read_curve(spark, lw, "lw", *args, [12])) == [("2000-01-31", 12, 0.02), ("2000-02-29", 12, 0.04)]
    assert got(read_curve(spark, gsw, "gsw", *args, [12, 24])) == [("2000-01-31", 12, 0.05), ("2000-01-31", 24, 0.06), ("2000-02-29", 24, 0.08)]
    with pytest.raises(ValueError):
        read_curve(spark, kr, "swap", *args, [1])
    with pytest.raises(ValueError):
        read_curve(spark, kr, "kr", *args, [7])


def test_curve_without_pairs(spark):
    curve = spark.createDataFrame([("2000-01-31", 12, 0.1), ("2000-01-31", 30, 0.1)], "date string, maturity int, y double")
    for h in (1, 12):
        with pytest.raises(ValueError):
            require_maturities(curve, h)
        with pytest.raises(Exception, match="month yield is missing|no maturity pair"):
            excess_returns(curve, h).collect()


def test_runs_with_different_columns(spark, tmp_path):
    write(tmp_path / "a" / "20240101_000000" / "performance.csv", "maturity,r2\n24,0.1\n36,0.2\n")
    write(tmp_path / "b" / "20240102_000000" / "performance.csv", "maturity,pval\n24,0.5\n")
    rows = P.collect_runs(spark, str(tmp_path), ["maturity", "r2", "pval"], glob="performance.csv")
    assert sorted(map(str, (tuple(r) for r in rows.collect()))) == [
        "('a', '20240101_000000', '24', '0.1', None)", "('a', '20240101_000000', '36', '0.2', None)", "('b', '20240102_000000', '24', None, '0.5')"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("2000-01-31", 1), ("2000-02-29", 2)], "date string, v int")
    K.write_dates(a, path)
    K.write_dates(spark.createDataFrame([("2000-02-29", 3)], "date string, v int"), path)
    done = K.read_table(spark, path)
    assert sorted(r.v for r in done.collect()) == [1, 3]
    tasks = spark.createDataFrame([("2000-01-31",), ("2000-03-31",)], "date string").select(done.schema["date"].name)
    assert [r.date for r in K.pending(tasks, done.select(done.date.cast("string").alias("date")), ["date"]).collect()] == ["2000-03-31"]


def test_transformed_panel_fills_before_it_differences(spark):
    rows = [("1999-12-31", "UMCSENTx", 1.0), ("2000-01-31", "UMCSENTx", None), ("2000-02-29", "UMCSENTx", 4.0), ("2000-02-29", "Z", 5.0)]
    values = spark.createDataFrame(rows, "date string, series string, value double").selectExpr("cast(date as date) date", "series", "value")
    codes = spark.createDataFrame([("UMCSENTx", 2)], "series string, tcode int")
    out = P.transformed_panel(values, codes, "2000-01-31", "2000-02-29")
    assert got(out) == [("2000-01-31", "UMCSENTx", 0.0), ("2000-02-29", "UMCSENTx", 3.0), ("2000-02-29", "Z", 5.0)]


def test_one_table_per_sheet(spark, tmp_path):
    K.write_tables({"tags": spark.range(2), "audit": spark.range(3)}, str(tmp_path))
    assert [K.read_table(spark, str(tmp_path / n)).count() for n in ("tags", "audit")] == [2, 3]


def test_quoted_fields_hold_separators_line_ends_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('sasdate,"A, total",B\r\n1/1/2000,"1,5",2\r\n2/1/2000,"say ""x""\nand y",\r\n\r\n')
    (tmp_path / "b.csv").write_text("sasdate,C\n1/1/2000,7\n")
    got = {(r.path[-5:], r.line, r.column): r.text for r in P.csv_cells(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.csv", 0, "sasdate"): "1/1/2000",
        ("a.csv", 0, "A, total"): "1,5",
        ("a.csv", 0, "B"): "2",
        ("a.csv", 1, "sasdate"): "2/1/2000",
        ("a.csv", 1, "A, total"): 'say "x"\nand y',
        ("a.csv", 1, "B"): "",
        ("b.csv", 0, "sasdate"): "1/1/2000",
        ("b.csv", 0, "C"): "7",
    }
