"""Mixing: targets by plain resharing, sizes, bounds and repeatability."""

import pytest

from monthspine.llm import mixing as M

SF = "/root/testdata/sf0.001"


def plain_targets(sizes: dict, weights=M.WEIGHTS, times=3):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > times * sizes[n]}
        if not over:
            return target | share
        for n in over:
            target[n] = times * sizes[n]
            left -= target[n]
        open_ -= over
    return target


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [(i, "w " * (1 + i % 7), "hot") for i in range(4000)]
    rows += [(10_000 + i, "a b  c\td", f"s{i % 5}") for i in range(200)]
    rows += [(20_000 + i, None if i % 3 else "z z", None) for i in range(60)]
    rows += [(30_000, "v " * 5000, "s1"), (30_000, "v " * 5000, "s1"), (None, "q", "s2"), (None, "q", "s2")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")


def check(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    sizes = {n: sum(r.size for r in rs) for n, rs in sources.items()}
    wanted = plain_targets(sizes)
    for n, rs in sources.items():
        assert {r.source_size for r in rs} == {sizes[n]}
        assert all(r.target == pytest.approx(wanted[n]) for r in rs)
        assert abs(sum(r.taken for r in rs) - wanted[n]) <= max(r.size for r in rs)


def test_targets_bounds_and_fixed_size(spark, skewed):
    rows = M.mix_sources(spark, skewed, bucket_rows=50).collect()
    assert len(rows) == skewed.count()
    check(rows)
    assert len({r.source for r in rows}) == 7


def test_reruns_agree_whatever_the_partitions(spark, skewed):
    key = lambda df: sorted(map(str, M.mix_sources(spark, df, bucket_rows=50).collect()))
    assert key(skewed.repartition(7)) == key(skewed.coalesce(1))


def test_buckets_do_not_change_the_mix(spark, skewed):
    key = lambda n: sorted(map(str, M.mix_sources(spark, skewed, bucket_rows=n).collect()))
    assert key(20) == key(100_000)


def test_given_table(spark):
    check(M.mix_sources(spark, spark.read.parquet(f"{SF}/documents.parquet")).collect())


def test_carried_columns_and_empty_tables(spark, skewed):
    out = M.mix_sources(spark, skewed.withColumnRenamed("size", "target"), keep=("text",))
    assert out.columns[:3] == ["doc_id", "source", "text"]
    empty = spark.createDataFrame([], skewed.schema)
    assert M.mix_sources(spark, empty).collect() == []
    silent = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken) for r in M.mix_sources(spark, silent).collect()] == [(0, 0), (0, 0)]


def test_plan_has_no_python(spark):
    plan = M.op7_mixing(spark, spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
