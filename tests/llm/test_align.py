"""Alignment against whole-text encoding and plain loops over byte ranges."""

import functools
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers

from monthspine.llm import align as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def encoders():
    return A.Encoders(*PATHS)


def plain(text):
    """Ids of the whole text by both vocabularies; none when a side does not give the bytes back."""
    if not text:
        return [], []
    e = encoders()
    a, b = e.a.model.encode(" " + text, add_special_tokens=False).ids, e.b.model.encode(text)
    same = all(b"".join(v.bytes[i] for i in ids) == (" " + text).encode() for v, ids in ((e.a, a), (e.b, b)))
    return (a, b) if same else ([], [])


def ranges(ids, sizes):
    out, at = [], 0
    for i in ids:
        out.append((at, at + sizes[i]))
        at += sizes[i]
    return out


def odd_texts(n=300, seed=1):
    rnd = random.Random(seed)
    parts = [" ", "  ", "\n", "\t ", " \n ", " ", "　", "\x1c ", "it's", "word", "Straße", "naïve,", "12345", "x" * 90, "<|endoftext|>", "<s>", "<0x41>",
             "日本語", "при", "вет", "é", "👩‍👩‍👧", "²", "...", "don't", "▁", "​", "ﬁ", "\x00", "\r\n", "'s", "=" * 40, "Ⅳ", " "]
    return ["".join(rnd.choices(parts, k=rnd.randint(1, 25))) for _ in range(n)] + [p for p in parts] + [" a", "a ", "a  ", "  a"]


def test_remembered_chunks_give_the_ids_of_whole_texts():
    texts = odd_texts()
    got = encoders().encode(texts)
    for t, a, b in zip(texts, *(g.to_pylist() for g in got)):
        assert (a, b) == plain(t), repr(t)


def brute(rows):
    e = encoders()
    size_a, size_b = ([len(x) for x in v.bytes] for v in (e.a, e.b))
    out, counts, links = [], Counter(), []
    for i, t in rows:
        a, b = plain(t)
        ra, rb = ranges(a, size_a), ranges(b, size_b)
        found = [(x, y) for x, (s, f) in zip(a, ra) for y, (u, v) in zip(b, rb) if max(s, u) < min(f, v)]
        counts.update(found)
        links.append(found)
        ends = sorted({f for _, f in ra} & {v for _, v in rb})
        groups, low = [], 0
        for edge in ends:
            sides = [",".join(str(x) for x, (s, f) in zip(ids, r) if low <= s and f <= edge) for ids, r in ((a, ra), (b, rb))]
            groups.append("|".join(sides))
            low = edge
        out.append([i, len(a), len(b), len(ends), len(found), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(*row, sum(counts[p] == top[p[1]] for p in found), sum(counts[p] for p in found)) for row, found in zip(out, links)], counts


def key(row):
    return tuple(map(repr, row))


def test_equals_plain_loops(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts(120, 7))]
    rows += [(1000, None), (1001, ""), (None, "a null id"), (None, "a null id"), (5, "a repeated id"), (1002, "word " * 3000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, pairs string").repartition(4)
    found, totals = A.align_documents(spark, docs, *PATHS)
    want, counts = brute(rows)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert {(r.a, r.b): r.n for r in totals.collect()} == dict(counts)


def test_several_blocks_in_a_task(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts(60, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    blocks = A.aligned_blocks(docs, *PATHS, "doc_id", "text", least=200)
    assert blocks.count() > 5
    got = A.scored(blocks, A.pair_counts(blocks)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows)[0], key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found, totals = A.align_documents(spark, docs, *PATHS)
    assert found.collect() == [] and totals.collect() == []
    nothing, totals = A.align_documents(spark, spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *PATHS)
    assert sorted(map(tuple, nothing.collect())) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]
