"""Packing against plain best-fit decreasing and whole-text encoding."""

import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from monthspine.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, window):
    room, members = [], []
    for at, n in enumerate(lengths):
        fits = [(c, w) for w, c in enumerate(room) if c >= n]
        if fits:
            w = min(fits)[1]
        else:
            w = len(room)
            room.append(window)
            members.append([])
        room[w] -= n
        members[w].append(at)
    return members


def test_best_fit_equals_the_plain_one_in_room_left():
    rnd = random.Random(3)
    for _ in range(60):
        lengths = sorted((rnd.randint(1, 64) for _ in range(rnd.randint(0, 120))), reverse=True)
        fill = lambda ms: sorted(sum(lengths[i] for i in m) for m in ms)
        assert fill(P.best_fit(lengths, 64)) == fill(plain_best_fit(lengths, 64))


def rows(n=400, seed=5):
    rnd = random.Random(seed)
    vocabulary = ["alpha", "beta,", "gamma", "delta.", "épsilon", "zeta!", "42", "η"]
    out = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 40, 300, 900])))) for i in range(n)]
    return [*out, (n, None), (n + 1, ""), (n + 2, "  \n"), (None, "null id"), (None, "null id"), (7, out[7][1]), (n + 3, "long " * 9000)]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def encode(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("per_task", [50, 1 << 15])
def test_every_id_lies_in_one_piece(spark, per_task):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, length string, sequence_id int").repartition(5)
    got = P.pack_documents(docs, PATH, 2, rows_per_task=per_task, keep_ids=True).collect()
    whole = defaultdict(list)
    for i, t in data:
        whole[i].append(encode(t))
    pieces = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append(r)
    for i, texts in whole.items():
        assert sum(r.length for r in pieces[i]) == sum(map(len, texts))
        if len(texts) == 1:
            assert [x for r in sorted(pieces[i], key=lambda r: r.start) for x in r.ids] == texts[0]
            assert {r.doc_tokens for r in pieces[i]} == {len(texts[0])}
    assert set(pieces) == set(whole)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= P.WINDOW
        pad = 0 if at & (at - 1) == 0 else P.WINDOW - at
        assert pad <= P.SLACK
        padding += pad
    assert padding < 0.01 * sum(r.length for r in got)


def test_reruns_agree_and_an_empty_table_has_no_piece(spark):
    docs = spark.createDataFrame(rows(200, 9), "doc_id long, text string").repartition(4)
    a, b = (sorted(map(tuple, P.pack_documents(docs, PATH, 2, rows_per_task=64).collect()), key=repr) for _ in range(2))
    assert a == b
    assert P.pack_documents(docs.limit(0), PATH, 2).collect() == []


def test_one_id_for_all_rows_is_dealt_evenly(spark):
    docs = spark.range(2000).selectExpr("1L AS doc_id", "'same text' AS text")
    got = P.pack_documents(docs, PATH, 2, rows_per_task=500)
    tasks = {r.sequence_id >> 32 for r in got.collect()}
    assert len(tasks) == 4


def test_training_rows_hold_all_ids(spark):
    docs = spark.createDataFrame(rows(60, 2), "doc_id long, text string")
    pieces = P.pack_documents(docs, PATH, 2, window=256, slack=2, keep_ids=True)
    got = P.sequences(pieces, 0, 256).collect()
    for r in got:
        n = len(r.input_ids)
        assert n & (n - 1) == 0 and n <= 256 and len(r.segments) == n
    assert sum(s > 0 for r in got for s in r.segments) == sum(len(encode(t)) for _, t in rows(60, 2))


def test_texts_are_read_from_arrow_columns():
    """Slices of a column, also with nulls, give the ids of their texts; the tokenizer's file is read once in a process."""
    import pyarrow as pa

    from monthspine.llm.tokens import WordEncoder

    texts = [t for _, t in rows(40, 7)]
    encoder = WordEncoder(PATH)
    assert WordEncoder(PATH).full is encoder.full
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        for i in range(0, len(texts), 9):
            ids, lens = encoder.encode(column[i : i + 9], 2)
            assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [encode(t) for t in texts[i : i + 9]]
