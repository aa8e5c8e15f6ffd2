"""SimHash against all pairs of small tables."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from monthspine.llm import simhash as S

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(i)
    low = {r: min((ids[i] for i in g if ids[i] is not None), default=None) for r, g in groups.items()}
    return [low[find(i)] for i in range(len(fps))]


def test_fingerprints():
    texts = [None, "", " \t\n", "One", "a B c", "ÀB c d e f", "x " * 500, "the Quick brown\x0bfox jumps over the lazy dog"]
    for t in texts:
        assert S.fingerprint(t) & (2**64 - 1) == plain_fingerprint(t), t


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    fps = [plain_fingerprint(r.text) for r in rows]
    want = plain_components(fps, [r.doc_id for r in rows])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(spark, docs).collect()}
    assert got == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, want)}


def clusters(n, spread, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 40])):
            f = center
            for b in rng.sample(range(64), rng.randint(0, spread)):
                f ^= 1 << b
            out.append(f)
    return out


@pytest.mark.parametrize("seed,correlated", [(1, False), (2, True)])
def test_components_of_made_fingerprints(spark, seed, correlated):
    fps = clusters(60, 5, seed)
    if correlated:  # bits 0-15 follow bit 40, so some partitions are hardly selective
        fps = [(f & ~0xFFFF) | (0xFFFF if f >> 40 & 1 else 0) for f in fps]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    named = {r.fp: r.component_id for r in S.near_duplicates(spark, df).collect()}
    assert [named[f] for f in signed] == plain_components(fps, list(range(len(fps))))


def test_every_choice_of_partitions_is_complete(spark):
    fps = np.array(clusters(40, 4, 3), np.uint64)
    df = spark.createDataFrame([(int(f),) for f in np.unique(fps).view(np.int64)], "fp long")
    n, both = S.bit_counts(df)
    want = plain_components(np.unique(fps).tolist(), list(range(n)))
    for m, ts in ((1, [4]), (2, [0, 3]), (3, [1, 1, 0]), (3, [2, -1, 1]), (4, [0, 0, 0, 1])):
        groups = S.correlated_groups(n, both, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        parts = [S.Partition(tuple(g[:20] if m == 1 else g), t) for g, t in zip(groups, ts) if t >= 0]
        if m == 1:
            continue
        edges = S.links(df, parts).collect()
        index = {int(f): i for i, f in enumerate(np.unique(fps).view(np.int64))}
        root = list(range(n))
        for a, b in sorted((index[e.a], index[e.b]) for e in edges):
            assert (int(np.unique(fps)[a]) ^ int(np.unique(fps)[b])).bit_count() <= 4
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
        assert root == want, (m, ts)


def test_thresholds_cost_least():
    costs = [[0.0, 5.0, 9.0, 20.0], [0.0, 1.0, 2.0, 3.0], [0.0, 4.0, 30.0, 90.0]]
    best = min(
        (sum(c[t + 1] for c, t in zip(costs, ts)), list(ts)) for ts in itertools.product(range(-1, 3), repeat=3) if sum(ts) == 2
    )
    assert S.allot(costs, 2) == best


def test_dense_bucket_gives_a_forest(monkeypatch):
    rng = np.random.default_rng(5)
    f = np.unique(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (5000, 3)).astype(np.uint64), axis=1))
    a, b = S.bucket_links(np.zeros(len(f), np.int64), f, 4)
    assert len(a) < len(f) * 5
    monkeypatch.setattr(S, "WIDE", 10**9)
    a1, _ = S.bucket_links(np.zeros(len(f), np.int64), f, 4)
    assert len(a1) == len(f) - 1


def test_long_chain(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {(r.node, r.root) for r in S.components(spark, df).collect()} == {(i, 0) for i in range(1, n + 1)}


def test_odd_rows(spark):
    rows = [(7, None), (3, ""), (None, " "), (9, "same text here now ok"), (9, "same text here now ok"), (None, "alone in the wide world"), (None, "another one beside it all")]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, component_id string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in S.simhash_components(spark, docs).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (None, 3), (9, 9), (9, 9), (None, None), (None, None)], key=str)
    kept = S.one_of_each(spark, docs).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(
        [(3, ""), (9, rows[3][1]), (None, rows[5][1]), (None, rows[6][1])], key=str
    )
    assert S.simhash_components(spark, docs.limit(0)).collect() == []
