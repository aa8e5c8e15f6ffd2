"""Token files against whole texts encoded by the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from monthspine.llm import tokens as T
from monthspine.llm.common import shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = [
    None,
    "",
    " \t\n",
    "It's THE end... of Été!!! don't we'll",
    "<|endoftext|> x<|ENDOFTEXT|>y <|startoftext|>.",
    "é Å Å İstanbul İ ǅ ﬁ µm ßÜ 3rd 12,5 a b c\x1cd\x85e",
    "end…. ….. x…! ### $$$word*** a|b |",
    "\U0001f600\U0001f600! 中文 ال",
    "word " * 20_000,
    "x" * 5_000,
]


@pytest.fixture(scope="module")
def full():
    return Tokenizer.from_file(PATH)


def expected(full, text):
    return [*full.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_give_the_ids_of_whole_texts(full):
    ids, lens = T.WordEncoder(PATH).encode(ODD, 2)
    assert np.split(ids, np.cumsum(lens)[:-1])[3].tolist() == expected(full, ODD[3])
    for got, text in zip(np.split(ids, np.cumsum(lens)[:-1]), ODD):
        assert got.tolist() == expected(full, text), text and text[:60]


def test_memory_of_words_is_bounded(full):
    encoder = T.WordEncoder(PATH, bound=10)
    for text in ("a b c d e f g h i j k l m", "n o p q a b", "a z"):
        ids, _ = encoder.encode([text], 2)
        assert ids.tolist() == expected(full, text)
        assert len(encoder.place) < 25


def test_whole_table_round_trip(spark, full):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = T.op4_tokens(spark, docs).orderBy("doc_id").collect()
    start = 0
    for row, doc in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = np.array(expected(full, doc.text), "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_files_and_manifest(spark, full):
    rows = [(5, "b c"), (None, "nil"), (5, "a"), (1, None), (9, "tail .")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    folder = shared_folder(spark, "tokens-test")
    T.write_tokens(docs.repartition(3), folder, PATH, 2)
    files = T.open_tokens(folder)
    flat, doc_ids = [], []
    for s in files.manifest["shards"]:
        ids, off, doc = T.shard_arrays(folder, s["shard"], files.manifest["dtype"])
        assert s["base"] == len(flat) and off[-1] == len(ids) == s["n_tokens"] and len(doc) == s["n_docs"]
        flat += ids.tolist()
        doc_ids += doc.tolist()
    assert doc_ids == [T.NULL_ID, 1, 5, 5, 9]
    assert flat == [i for t in ("nil", None, "a", "b c", "tail .") for i in expected(full, t)]
    assert [r.doc_id for r in T.read_tokens(spark, files).orderBy("start").collect()] == [None, 1, 5, 5, 9]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.op4_tokens(spark, docs).collect() == []


def test_words_are_encoded_once_by_their_letters(full):
    """Words that differ in case and closing punctuation only are one word for the library, in all pieces of a task."""
    encoder, asked = T.WordEncoder(PATH), []

    class Counted:
        def __init__(self, model):
            self.model = model

        def tokenize(self, word):
            asked.append(word)
            return self.model.tokenize(word)

    encoder.merge = Counted(encoder.merge)
    texts = ["Straße, straße STRASSE. Été été! Word word; WORD", "word... Été? ÀÖØ× \x0bàö", None]
    for _ in range(2):
        ids, lens = encoder.encode(texts, 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [expected(full, t) for t in texts]
    assert len(asked) == len(set(asked)) == 5


def test_texts_reach_the_encoder_in_pieces_of_bounded_size():
    import pyarrow as pa

    from monthspine.llm.common import text_slices

    texts = ["a" * 10, None, "b" * 25, "", "c" * 9, "ü" * 5, "d"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "text": texts})
    pieces = [p.column(1).to_pylist() for p in text_slices([batch.slice(0, 0), batch], 1, 20)]
    assert sum(pieces, []) == texts
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 20 for p in pieces) and len(pieces) == 3
    assert [p.column(1).to_pylist() for p in text_slices([batch.slice(2, 3)], 1, 20)] == [["b" * 25], ["", "c" * 9]]
