"""Quality rules: counts against plain loops, and the order that the measured costs give."""

import re

from monthspine.llm import rules as R

SF = "/root/testdata/sf0.001"


def plain(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    rep = {i + o for i, w in enumerate(wins) if wins.count(w) > 1 for o in range(5)}
    return {
        "n_words": len(ws),
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(rep),
    }


TEXTS = [
    None,
    "",
    " \n \t",
    "aa bb cc dd ee ff gg hh ii jj kk",
    "a a a a a a a a a a a a",
    "one two three four five x one two three four five y z w q r s t",
    "same line here\nsame line here\n\n\n other été <b> ### $$ %% && ||   x",
    "中文 " * 30,
    "SHOUT " + " ".join(f"W{i}ORD" for i in range(40)),
]


def test_counts(spark):
    of = R.counter()
    for text in TEXTS:
        want = plain(text)
        assert {k: getattr(of(text), k) for k in want} == want, text


def test_order_is_by_rejection_per_cost():
    cheap, dear, useless = (R.Rule(n, (), lambda c: False) for n in ("cheap", "dear", "useless"))
    assert R.ordered([(useless, 1e-9, 0.0), (dear, 1.0, 0.5), (cheap, 0.1, 0.2)]) == [cheap, dear, useless]


def test_order_never_changes_the_verdict(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 2), (3, TEXTS[3], 3)], "doc_id long, text string, kept int")
    a = R.quality_rules(docs, list(R.RULES)).select("doc_id", "kept").collect()
    b = R.quality_rules(docs, list(R.RULES)[::-1]).select("doc_id", "kept").collect()
    assert sorted(a, key=str) == sorted(b, key=str) and len(a) == len(TEXTS) + 2
    assert {r.doc_id for r in a if r.kept} == {3}


def test_short_circuit(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    (row,) = R.quality_rules(docs, list(R.RULES)).collect()
    assert (row.rejected_by, row.n_rules) == ("too_short", 1)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert R.op10_rules(docs).collect() == []


def test_clean_labelled_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1").select("doc_id")
    out = R.op10_rules(docs).join(good, "doc_id").filter("not base_failed")
    assert out.filter("not kept").count() <= 0.01 * out.count()
