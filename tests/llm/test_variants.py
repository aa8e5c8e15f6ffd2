"""Spelling variants against comparing every word with every other."""

import random
import re
import zlib
from collections import Counter

import pytest

from monthspine.llm import variants as V


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [form, n, len(near), words[form] if form else None]
    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w
    return sorted((w, f or "", root(w), n, k, fn or 0) for w, (f, n, k, fn) in out.items())


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def texts(seed, n=260):
    rnd = random.Random(seed)
    base = ["Wonderful", "language", "gramática", "Ökonomie", "aaaaaaaa", "abababab", "rührend", "extraordinary", "×÷×÷×÷×÷"]
    out = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 40)):
            w = rnd.choice(base)
            if rnd.random() < 0.4:
                k, c = rnd.randrange(len(w)), rnd.choice("abéz")
                w = rnd.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
            words.append(w)
        out.append((i, rnd.choice([" ", "-", "1", "\n"]).join(words)))
    out += [(n, None), (n + 1, ""), (None, "wonderful wonderfull wonderful"), (None, "wonderful"), (3, out[3][1]), (n + 2, "long" * 500 + " " + "long" * 500)]
    return out


@pytest.mark.parametrize(("seed", "most"), [(1, V.LIST), (2, 8), (3, 1)])
def test_equals_all_pairs(spark, seed, most):
    rows = texts(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    assert got(V.spelling_variants(spark, docs, most=most)) == brute(rows)


def test_chain_of_forms(spark):
    rows = [(1000 + k, w) for w, n in (("abcdefghij", 900), ("abcdefghi", 40), ("abcdefgh", 3)) for k in range(n)]
    table = {r[0]: r for r in got(V.spelling_variants(spark, spark.createDataFrame(rows, "doc_id long, text string")))}
    want = {r[0]: r for r in brute(rows)}
    assert table == want and table["abcdefgh"][2] == "abcdefghij"


def test_sorted_list_scan_equals_all_pairs():
    rnd = random.Random(4)
    for _ in range(200):
        words = sorted({"".join(rnd.choices("ab", k=rnd.randint(0, 6))) for _ in range(rnd.randint(1, 40))})
        listed = V.SortedList(words)
        for q in words + ["", "abba", "bbbbbbb"]:
            assert [words[i] for i in listed.within_one(q)] == [w for w in words if one_edit(q, w)], (q, words)


def test_scan_skips_ranges():
    """A list of many words without a near one is left at the first letters of each range."""

    class Counted(str):
        looked = 0

        def __getitem__(self, i):
            Counted.looked += 1
            return str.__getitem__(self, i)

    words = sorted(f"{p}{q}" + "x" * 30 + str(i) for p in "bcd" for q in "efg" for i in range(100))
    listed = V.SortedList(words)
    listed.words = [Counted(w) for w in words]
    assert listed.within_one("zz" + "y" * 30) == []
    assert Counted.looked < 100


def test_no_words(spark):
    assert V.spelling_variants(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert V.spelling_variants(spark, spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")).collect() == []
