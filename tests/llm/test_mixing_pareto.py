"""Unequal inclusion: levels, the Pareto ranking against a plain one, shares of each grade."""

import hashlib
import math

import pytest

from monthspine.llm import mixing as M

SF = "/root/testdata/sf0.01"


def plain_probabilities(sizes, wanted):
    """p = min(1, level * digits of the size) with expected words ``wanted``, the level by bisection."""
    low, high = 0.0, 2.0
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(1.0, level * s.bit_length()) * s for s in sizes) < wanted:
            low = level
        else:
            high = level
    return [min(1.0, low * s.bit_length()) for s in sizes]


def random_number(doc_id, text):
    inner = hashlib.md5(text.encode()).hexdigest()
    return (int(hashlib.md5(f"7:{doc_id}:{inner}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, "w " * (1 + i * i % 700), "hot") for i in range(3000)]
    rows += [(5000 + i, "a b  c\td" if i % 2 else "v " * 900, f"s{i % 3}") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def plain_mix(rows):
    """Copies of each document by plain Pareto sampling within each source."""
    copies = {}
    for name in {r.source for r in rows}:
        own = [r for r in rows if r.source == name]
        certain = min(3, math.floor(own[0].target / own[0].source_size))
        wanted = own[0].target - certain * own[0].source_size
        ps = plain_probabilities([r.size for r in own], wanted)
        ranked = []
        for r, p in zip(own, ps):
            copies[r.doc_id] = certain
            u = random_number(r.doc_id, r.text)
            ranked.append((0.0 if p > 1 - 1e-9 else (u / (1 - u)) / (p / (1 - p)) if p > 0 else math.inf, r.doc_id, r.size))
        done = 0
        for _, d, size in sorted(ranked):
            if done < wanted and done + size - wanted <= wanted - done:
                copies[d] += 1
            done += size
    return copies


@pytest.mark.parametrize("bucket_rows", [20, 500])
def test_mix_equals_plain_pareto_sampling(spark, table, bucket_rows):
    rows = M.mix_sources(spark, table, bucket_rows=bucket_rows, keep=("text",)).collect()
    assert {r.doc_id: r.copies for r in rows} == plain_mix(rows)


def test_longer_texts_go_before_fragments(spark, table):
    rows = [r for r in M.mix_sources(spark, table).collect() if r.source == "hot"]
    extra = min(r.copies for r in rows)
    wanted = rows[0].target - extra * rows[0].source_size
    ps = plain_probabilities([r.size for r in rows], wanted)
    for low, high in ((1, 6), (6, 8), (8, 9), (9, 11)):
        group = [(r.copies - extra, p) for r, p in zip(rows, ps) if low <= r.size.bit_length() < high]
        drawn, expected = sum(c for c, _ in group), sum(p for _, p in group)
        assert abs(drawn - expected) <= 4 * math.sqrt(len(group)) / 2
    assert max(ps) > 1.2 * min(ps)


def test_rows_of_no_id_do_not_share_one_number(spark):
    rows = [(None, f"{'w ' * (1 + i % 9)}n{i}", "a") for i in range(2000)] + [(None, "x y", "b")] * 50
    out = M.mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), bucket_rows=20).collect()
    for name in ("a", "b"):
        own = [r for r in out if r.source == name]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
