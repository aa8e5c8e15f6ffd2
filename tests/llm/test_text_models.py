"""Quality, toxicity and language models by held-out accuracy, and their odd rows."""

import numpy as np
import pytest

from monthspine.llm import language as L
from monthspine.llm import quality as Q
from monthspine.llm import toxicity as T

SF = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "words here"), (4, "a " * 20_000), (5, "12 34 !!"), (5, "12 34 !!")]


def odd(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ODD], "doc_id long, text string, id string, score int")


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(2)
    k, n = 6, 60_000
    good = rng.random(n) < 0.8
    hit = np.array([0.3, 0.5, 0.4, 0.2, 0.6, 0.35])
    votes = np.where(rng.random((n, k)) < np.where(good[:, None], 0.01, hit), Q.JUNK, Q.GOOD)
    votes[rng.random((n, k)) < 0.1] = Q.ABSTAIN
    patterns, counts = np.unique(Q.pattern_of(votes), return_counts=True)
    assert (Q.votes_of(Q.pattern_of(votes), k) == votes).all()
    model = Q.fit_label_model(patterns, counts.astype(float), k)
    assert abs(model.good - 0.8) < 0.03
    assert np.abs(model.accuracy[:, 0, Q.JUNK] - 0.9 * hit).max() < 0.05


def test_quality_agrees_with_labels_it_never_saw(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = Q.op3_quality(docs).join(labels, "doc_id").collect()
    right = [r.kept == bool(r.quality) for r in rows]
    assert np.mean(right) > 0.97
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.97


def test_quality_of_odd_rows(spark):
    docs = odd(spark)
    model = Q.fit_quality(docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "'x' id", "1 score")))
    out = {r.doc_id: r for r in Q.quality_scores(docs, model).collect()}
    assert all(out[i].score == 0.0 and not out[i].kept for i in (1, 2, 3))
    assert Q.good_documents(docs, model).columns == docs.columns
    assert Q.op3_quality(docs.limit(0)).collect() == []
    assert len(Q.op3_quality(docs.limit(1)).collect()) == 1


@pytest.fixture(scope="module")
def toxic_tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def toxic_model(toxic_tables):
    got = T.training_rows(*toxic_tables).toPandas().sort_values("doc_id")
    return T.fit_toxicity(got["text"].tolist(), got["toxic"].to_numpy(np.int64))


def test_toxicity_held_out(spark, toxic_tables):
    docs, labels = toxic_tables
    rows = T.op6_toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic = np.array([r.toxic for r in rows])
    said = np.array([r.predicted for r in rows])
    assert (said[toxic == 0] == 0).mean() > 0.98 and (said[toxic == 1] == 1).mean() > 0.88


def test_table_equals_landmarks():
    """The weight of each subsequence gives the value that the Nystroem features give."""
    words, marks = ["idiot", "idxiot", "harmless", "x", ""], ["idiot", "stupid", "house"]
    beta = np.array([0.5, -1.0, 2.0])
    table = np.zeros(64**3)
    for j, m in enumerate(marks):
        o, c, v = T.subsequences([m])
        np.add.at(table, c, beta[j] * v / T.kernel_norms(o, v, 1)[0])
    model = T.ToxicityModel(table, 0.25, np.zeros(4))
    assert np.allclose(model.word_scores(words), T.kernel(words, marks) @ beta + 0.25)


def test_kernel_against_plain_sums():
    import itertools

    def plain(s, t):
        def sub(w):
            w, out = "^" + w + "$", {}
            for i, j, k in itertools.combinations(range(len(w)), 3):
                if k - i < T.SPAN:
                    out.setdefault((w[i], w[j], w[k]), []).append(T.LAMBDA ** (k - i + 1))
            return out

        a, b = sub(s), sub(t)
        norm = lambda x: np.sqrt(sum(v * v for vs in x.values() for v in vs))
        return sum(sum(a[u]) * sum(b[u]) for u in a if u in b) / (norm(a) * norm(b))

    words, marks = ["idiot", "iidiioott", "stupid"], ["idiot", "pid"]
    assert np.allclose(T.kernel(words, marks), [[plain(w, m) for m in marks] for w in words])


def test_gapped_insults(toxic_model):
    scores = T.WordScores(toxic_model)
    bad = ["you i d i o t", "what a s-t-u-p-i-d man", "m.o.r.o.n", "stuupid", "such scuum", "the worthlesss one", "patthetic", "loxser"]
    assert (toxic_model.probability(scores.judge(bad)) >= 0.5).sum() >= len(bad) - 1
    fine = ["the thing is heon", "on the of and", "", None]
    assert (toxic_model.probability(scores.judge(fine)) < 0.5).all()


def test_toxicity_of_odd_rows(spark, toxic_model):
    docs = odd(spark)
    out = T.toxicity_scores(docs, toxic_model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == 0 for r in out)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in T.op6_toxicity(docs, labels).collect())
    assert T.op6_toxicity(docs.limit(0), labels).collect() == []
    assert len(T.op6_toxicity(docs, labels.limit(0)).collect()) == len(ODD)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = L.op9_language(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.99
    assert all(0 <= r.score <= 1 for r in out)


def test_text_vectors_are_bundles_of_bound_letters():
    vectors = L.LetterVectors(256)
    texts = ["Ab, c!", "", None, "ÀB 中文中文", "x" * 3000, "12"]
    x, spoken = L.text_vectors(texts, vectors)
    assert spoken.tolist() == [True, False, False, True, True, False]
    for row, text in zip(x, texts):
        clean = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
        clean = f" {' '.join(clean.split())} " if clean.split() else " "
        want = np.zeros(256)
        for i in range(len(clean) - 2):
            a, b, c = vectors.of(np.array([ord(k) for k in clean[i : i + 3]])).astype(int)
            want += np.roll(a, 2) * np.roll(b, 1) * c
        assert np.array_equal(row, want)


def test_language_of_odd_rows(spark):
    docs = odd(spark).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    out = L.op9_language(docs).collect()
    assert len(out) == len(ODD) and {r.lang_pred for r in out} == {"und"}
    taught = spark.createDataFrame([(1, "das ist ein haus", "de"), (2, "this is the house", "en")], "doc_id long, text string, lang string")
    model = L.fit_language(taught)
    got = {r.doc_id: r.lang_pred for r in L.languages(odd(spark), model).collect()}
    assert got[1] == got[2] == got[3] == got[5] == "und" and got[None] in ("de", "en")
    assert L.op9_language(docs.limit(0)).collect() == []
