"""The pipeline's stages against plain versions of what each keeps."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from monthspine.llm import simhash as S

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(P.stored(spark, stage(spark, out[-1], SF), "test"))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_columns_and_only_lose_rows(steps):
    for before, after in zip(steps[:4], steps[1:5]):
        assert after.columns == before.columns
    for before, after in zip(steps[:3], steps[1:4]):
        assert ids(after) < ids(before) and after.count() == len(ids(after))
    assert ids(steps[4]) <= ids(steps[3])


def test_clean_documents_stay_and_junk_goes(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = ids(steps[1])
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) > 0.96 * len(good)
    assert sum(d in kept for d, q in labels.items() if q == 0) < 0.1 * sum(q == 0 for q in labels.values())


def test_one_document_of_each_component(steps):
    rows = sorted(steps[1].collect(), key=lambda r: r.doc_id)
    fps = [S.fingerprint(r.text) & (2**64 - 1) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert ids(steps[2]) == {rows[i].doc_id for i in range(len(rows)) if find(i) == i}


def test_no_benchmark_passage_is_left(spark, steps):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    had = {r.doc_id for r in steps[2].collect() if any(i in r.text for i in items)}
    assert had and not had & ids(steps[3])
    assert ids(steps[2]) - ids(steps[3]) == had


def test_mix_takes_whole_copies(steps):
    texts = {r.doc_id: r.text for r in steps[3].collect()}
    for r in steps[4].groupBy("doc_id", "text").count().collect():
        assert r.text == texts[r.doc_id] and r["count"] <= 3


def test_tokens_cover_the_mix(steps):
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = sorted((r.doc_id, r.text) for r in steps[4].collect())
    rows = sorted((r.doc_id, r.start, r.n_tokens) for r in steps[5].collect())
    start = 0
    for (d, text), row in zip(docs, rows, strict=True):
        n = len(full.encode(text, add_special_tokens=False).ids) + 1
        assert row == (d, start, n)
        start += n


def test_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _copies string, _FP int"
    rows = [(1, None, None, None, None, "a", 1), (1, None, None, None, None, "a", 1), (None, "words and more words of prose, here.", "en", "s", 9, "b", 2)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == table.columns
        assert docs.count() <= 3 * table.count()
        P.token_binary(spark, docs, SF).count()
