import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from monthspine.functions import distributions as D
from monthspine.functions.serial import with_hac_tstat
from monthspine.operators import correlation as K
from monthspine.operators import ensemble as E
from monthspine.operators import significance as G


def test_student_t_tail(spark):
    # upper tail values of printed tables
    known = [(1, 6.313752, 0.05), (2, 2.919986, 0.05), (5, 2.570582, 0.025), (30, 2.457262, 0.01), (61, -1.670219, 0.95)]
    df = spark.createDataFrame([(n, t) for n, t, _ in known], "n long, t double")
    got = [r.p for r in df.select(D.student_t_upper(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got == pytest.approx([p for *_, p in known], abs=1e-6)


def test_normal_tail(spark):
    zs = [0.0, 0.5, 1.959964, -1.0, 4.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r.p for r in df.select(D.normal_upper(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(z / math.sqrt(2)) for z in zs], abs=1e-12)


def test_hac_by_hand(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(0.2, 1.0, 20)
    df = spark.createDataFrame([([float(v) for v in f],)], "x array<double>")
    got = with_hac_tstat(df, "x", 12).first()
    e = f - f.mean()
    s = (e @ e) + 2 * sum((1 - k / 13) * (e[k:] @ e[:-k]) for k in range(1, 13))
    assert got.t_stat == pytest.approx(f.mean() * 20 / math.sqrt(s))


def exact_p(x, y):
    """All ways to split the pooled ranks."""
    pool = sorted([*x, *y])
    rank = {v: i + 1 for i, v in enumerate(pool)}
    n1, n2 = len(x), len(y)
    u = sum(rank[v] for v in x) - n1 * (n1 + 1) / 2
    top = max(u, n1 * n2 - u)
    all_u = [sum(c) - n1 * (n1 + 1) / 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    return min(1.0, 2 * sum(v >= top for v in all_u) / len(all_u))


def test_mann_whitney_exact(spark):
    x, y = [1.2, 3.4, 0.3, 9.0], [2.2, 5.5, 7.7, 8.1, 6.6]
    rows = [("k", v, True) for v in x] + [("k", v, False) for v in y]
    got = G.mann_whitney(spark.createDataFrame(rows, "k string, v double, flag boolean"), ["k"], "v", "flag").first()
    assert got.p_value == pytest.approx(exact_p(x, y))


def test_mann_whitney_needs_three(spark):
    rows = [("k", 1.0, True), ("k", 2.0, True), ("k", 3.0, False), ("k", 4.0, False), ("k", 5.0, False)]
    assert G.mann_whitney(spark.createDataFrame(rows, "k string, v double, flag boolean"), ["k"], "v", "flag").first().p_value is None


def brute_tau(x, y):
    n = len(x)
    pairs = list(itertools.combinations(range(n), 2))
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i, j in pairs)
    a = sum(x[i] != x[j] for i, j in pairs)
    b = sum(y[i] != y[j] for i, j in pairs)
    return s / math.sqrt(a * b) if a and b else None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=2, max_size=25))
def test_kendall_counts_pairs_exactly(points):
    x, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    want, got = brute_tau(x, y), K.kendall_tau_b(x, y)
    assert (got is None) == (want is None)
    assert want is None or got == pytest.approx(want)


@pytest.mark.parametrize("blocks", [1, 3])
def test_association_does_not_depend_on_blocks(spark, blocks):
    rng = np.random.default_rng(0)
    rows = [(f"2000-01-{d + 1:02d}", f"s{i}", float(rng.normal())) for d in range(25) for i in range(6) if (d, i) != (3, 2)]
    df = spark.createDataFrame(rows, "d string, s string, v double").select(F.col("d").cast("date").alias("date"), "s", "v")
    got = {(r.a, r.b): (r.n, r.corr) for r in K.association(df, [], "s", "v", "pearson", blocks=blocks).collect()}
    assert len(got) == 30 and got["s2", "s0"][0] == 24
    cols = {s: [v for _, q, v in rows if q == s] for s in ["s0", "s1"]}
    assert got["s0", "s1"][1] == pytest.approx(np.corrcoef(cols["s0"], cols["s1"])[0, 1])


@pytest.mark.parametrize("bins", [1, 7, 512])
def test_expanding_quantiles_are_exact(spark, bins):
    rng = np.random.default_rng(1)
    rows = [(f"2000-{m:02d}-28", float(v)) for m in range(1, 9) for v in np.round(rng.normal(size=37), 2)]
    df = spark.createDataFrame(rows, "d string, y_hat double").select(F.last_day(F.col("d").cast("date")).alias("date"), "y_hat")
    got = {str(r.date)[:7]: (r.lo, r.hi) for r in E.expanding_quantiles(df, "y_hat", {"lo": 0.013, "hi": 0.9}, bins).collect()}
    for m in range(1, 9):
        past = [v for d, v in rows if int(d[5:7]) <= m]
        assert got[f"2000-{m:02d}"] == pytest.approx(tuple(np.quantile(past, [0.013, 0.9])))


@pytest.mark.parametrize("method", ["pearson", "kendall"])
def test_blocks_equal_pairs(method):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(70, 6)), 1)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 3.0
    x[2:, 5] = np.nan
    n, corr = K.BLOCKWISE[method](x[:, :3], x[:, 2:])
    for i in range(3):
        for j in range(4):
            a, b = x[:, i], x[:, 2 + j]
            both = ~np.isnan(a) & ~np.isnan(b)
            assert n[i, j] == both.sum()
            want = K.METHODS[method](a[both], b[both]) if both.sum() >= 2 else None
            assert np.isnan(corr[i, j]) if want is None else corr[i, j] == pytest.approx(want)


def test_several_blocks_give_one_matrix(spark):
    rows = [(f"2000-{m:02d}-28", f"i{k}", float((m * (k + 3)) % 7)) for m in range(1, 13) for k in range(9)]
    df = spark.createDataFrame(rows, "d string, item string, v double").selectExpr("CAST(d AS DATE) AS date", "item", "v")
    one, many = ({(r.a, r.b): (r.n, r.corr) for r in K.association(df, [], "item", "v", "kendall", blocks=b).collect()} for b in (None, 4))
    assert one.keys() == many.keys() and len(one) == 72
    for k, (n, c) in one.items():
        assert many[k] == (n, pytest.approx(c) if c is not None else None)
