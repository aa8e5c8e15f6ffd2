"""Substring dedup against a plain dictionary of windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from monthspine.llm import substrings as S

SF = "/root/testdata/sf0.001"


def plain(rows, size=20):
    """{row number: kept words}; rows of (id, text)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] is not None, rows[i][1] or ""))
    seen, kept = set(), {}
    for i in order:
        ws = re.findall(r"[^\x20\x09-\x0D]+", rows[i][1] or "")
        gone = [False] * len(ws)
        for p in range(len(ws) - size + 1):
            win = tuple(ws[p : p + size])
            if win in seen:
                gone[p : p + size] = [True] * size
            seen.add(win)
        kept[i] = (len(ws), sum(gone), [w for w, g in zip(ws, gone) if not g])
    return kept


def digest(n, removed, ws):
    return n, removed, hashlib.sha256(" ".join(ws).encode()).hexdigest()


def test_given_table(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(S, "SHARD_WINDOWS", 10_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {rows[i][0]: digest(*k) for i, k in plain(rows).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.op5_substrings(docs).collect()}
    assert got == want
    assert sum(v[1] for v in got.values()) > 100


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(300)]
    passage = [rng.choice(voc) for _ in range(60)]
    rows = []
    for i in range(300):
        ws = [rng.choice(voc) for _ in range(rng.choice([0, 5, 19, 20, 21, 80]))]
        if i % 3 == 0:  # a hot passage, whole or in part
            a = rng.randint(0, 30)
            ws[len(ws) // 2 : len(ws) // 2] = passage[a : a + rng.randint(15, 60)]
        rows.append((i, " \n".join(ws)))
    rows += [(500, rows[0][1]), (500, rows[0][1]), (None, "x " * 200), (None, None), (501, ""), (502, "x " * 50), (503, "y " * 5000)]
    return rows


@pytest.mark.parametrize("depth,block,shard,cells", [(2, 2_000, 300, 4), (1, 10**9, 10**9, 4), (2, 3_000, 500, 0.01)])
def test_copies_in_any_layout(spark, monkeypatch, copies, depth, block, shard, cells):
    """The last case has a sketch so narrow that nearly everything is estimated repeated: the result stays exact."""
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    monkeypatch.setattr(S, "SHARD_WINDOWS", shard)
    monkeypatch.setattr(S.Plan.__init__, "__defaults__", (depth, 20))
    monkeypatch.setattr(S, "CELLS_PER_WINDOW", cells)
    if cells < 1:
        monkeypatch.setattr(S, "max", lambda a, b: 64 if a == 1024 else max(a, b), raising=False)
    docs = spark.createDataFrame([(*r, "t") for r in copies], "doc_id long, text string, block string").repartition(5)
    got = sorted(((r.doc_id, r.text) for r in S.kept_text(docs).collect()), key=str)
    want = sorted(((copies[i][0], " ".join(k[2])) for i, k in plain(copies).items()), key=str)
    assert got == want


def test_one_plan_shuffles_texts_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    df = S.op5_substrings(docs)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") >= 2


def test_packing_round_trip():
    for numbers in ([], [0], [5, 5, 9], [1, 2**40, 2**63 + 1], list(range(1000))):
        assert S._unpack(S._pack(np.array(numbers, np.uint64))).tolist() == numbers


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    plan = S.Plan(500)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 3, 200)) for _ in range(4)]
    plan.size = 3
    pieces = [p for b, t in enumerate(texts) for p in plan.sketch(b, [t])]
    answers = {}
    for shard in {p[1] for p in pieces}:
        for block, s, _, flags in plan.merge_sketches([p for p in pieces if p[1] == shard]):
            answers.setdefault(block, {})[s] = flags
    everything = [tuple(t.split()[i : i + 3]) for t in texts for i in range(198)]
    for b, t in enumerate(texts):
        flagged = plan.candidates(S.Block([t], 3), answers[b])
        for i, f in enumerate(flagged):
            assert f or everything.count(tuple(t.split()[i : i + 3])) == 1


def test_empty_table(spark):
    assert S.op5_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_and_windows_of_a_block_are_taken_at_once(monkeypatch):
    import numpy as np

    from monthspine.llm import common as C

    texts = ["a b c a b c a", None, "", " \t\n", "a b", "  a\x0bb\x0cc\rd ", "x y   z\x1cw a b c", "a b c"]
    words, counts = C.split_words(texts)
    assert words.to_pylist() == [w.decode() for t in texts for w in C.words(t)]
    assert counts.tolist() == [len(C.words(t)) for t in texts]
    plain = C.WordHashes()
    want = [[C.Windows(3, b).of(plain.of(C.words(t))).tolist() for t in texts] for b in S._BASES]
    calls, of = [], S.Windows.of
    monkeypatch.setattr(S.Windows, "of", lambda self, h: calls.append(len(h)) or of(self, h))
    block = S.Block(texts, 3)
    assert len(calls) == 2
    assert [block.h1.tolist(), block.h2.tolist()] == [sum(w, []) for w in want]
    assert block.counts.tolist() == list(map(len, want[0]))
    for few in ([], [None], ["a b"]):
        block = S.Block(few, 3)
        assert len(block.h1) == 0 and np.array_equal(block.counts, np.zeros(len(few)))
