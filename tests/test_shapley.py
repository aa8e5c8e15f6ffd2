from math import factorial

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from monthspine.operators import attribution as A


def brute(v, n):
    out = []
    for i in range(n):
        total = 0.0
        for s in range(1 << n):
            if not s >> i & 1:
                k = bin(s).count("1")
                total += factorial(k) * factorial(n - k - 1) / factorial(n) * (v[s | 1 << i] - v[s])
        out.append(total)
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=16, max_size=16))
def test_values_and_additivity(spark, v):
    df = spark.createDataFrame([("k", s, float(x)) for s, x in enumerate(v)], "k string, bits int, v double")
    phi = A.shapley(df, ["k"], 4)
    assert [r.phi for r in phi.orderBy("player").collect()] == pytest.approx(brute(v, 4), abs=1e-9)
    chk = A.additivity(df, phi, ["k"], 4, scale=3.0, shift=1.0).first()
    assert chk.residual == pytest.approx(0.0, abs=1e-9) and chk.base_value == pytest.approx(3 * v[0] + 1)


def test_rank_agreement(spark):
    rows = [("2000-01-31", 12, s, g, x) for s, xs in {0: [1.0, 2.0, 3.0], 1: [3.0, 2.0, 1.0], 2: [2.0, 4.0, 6.0], 3: [1.0, 1.0, 1.0]}.items() for g, x in zip("abc", xs)]
    rows += [("2000-01-31", 12, 4, "a", 9.0)]  # lacks items: no correlation
    got = A.rank_agreement(spark.createDataFrame(rows, "date string, maturity int, seed int, grp string, signed double"), "grp", "signed").first()
    assert (got.n_pairs, got.min_rho) == (3, pytest.approx(-1.0)) and got.mean_rho == pytest.approx(-1 / 3)
