"""Benchmark decontamination: planted passages, measured recall, clean documents."""

import random

import numpy as np
import pytest

from monthspine.llm import decontaminate as D

SF = "/root/testdata/sf0.01"
VOC = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "n r st ly ed ing or al tion ne".split()]


def prose(rng, n):
    return [VOC[min(int(rng.expovariate(0.05)), len(VOC) - 1)] for _ in range(n)]


def edited(rng, ws, share):
    ws = list(ws)
    for _ in range(int(share * len(ws))):
        at = rng.randrange(len(ws))
        kind = rng.randrange(3)
        if kind == 0:
            ws[at] = f"new{rng.randrange(999)}"
        elif kind == 1:
            ws.insert(at, f"put{rng.randrange(999)}")
        elif len(ws) > 3:
            del ws[at]
    return ws


def plain_distance(item, ws):
    """Least word edit distance of the item to any stretch."""
    row = [0] * (len(ws) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(ws, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_distance_and_stretch():
    rng = random.Random(1)
    for _ in range(200):
        item, ws = prose(rng, rng.randint(1, 12)), prose(rng, rng.randint(0, 30))
        a, h = D.NormalHashes().of(" ".join(item)), D.NormalHashes().of(" ".join(ws))
        distance, start, end = D.best_stretch(a, h, 0, len(h))
        assert distance == plain_distance(item, ws)
        assert plain_distance(item, ws[start:end]) == distance and abs((end - start) - len(item)) <= distance


@pytest.mark.parametrize("share,least", [(0.0, 1.0), (0.05, 0.97), (0.1, 0.9), (0.18, 0.6)])
def test_recall_against_brute_force(share, least):
    rng = random.Random(int(100 * share))
    items = [(i, " ".join(prose(rng, rng.randint(15, 60)))) for i in range(150)]
    index, hashes = D.Items(items, D.Walks(D.repeats_for(D.RECALL, D.DESIGN_DISTANCE))), D.NormalHashes()
    texts = [hashes.of(" ".join(prose(rng, 60) + edited(rng, t.split(), share) + prose(rng, 60))) for _, t in items]
    wanted = {k for k, w in enumerate(index.words) if D.edit_end(w, texts[k])[0] <= int(D.MAX_DISTANCE * len(w))}
    found = {t for t, k, *_ in index.matches(texts, D.MAX_DISTANCE) if t == k}
    assert len(wanted) > 100 and len(found & wanted) >= least * len(wanted)


def test_whole_short_items_are_found():
    rng = random.Random(9)
    items = [(n, " ".join(f"s{n}x{k}" for k in range(n))) for n in range(1, 30)]
    index, hashes = D.Items(items, D.Walks(4)), D.NormalHashes()
    texts = [hashes.of(" ".join(prose(rng, rng.randint(0, 9))) + " " + t.upper() + "! " + " ".join(prose(rng, 5))) for _, t in items]
    hits = {(t, k) for t, k, *_ in index.matches(texts, 0.2)}
    assert {(t, t) for t in range(len(items))} <= hits


def test_given_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    hits = {(r.doc_id, r.item_id) for r in D.op2_decontamination(spark, docs, items).collect()}
    norm = lambda t: f" {' '.join(x for x in (w.strip(D._PUNCTUATION) for w in t.lower().split()) if x)} "
    texts = {r.doc_id: norm(r.text) for r in docs.collect()}
    planted = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if norm(r.text) in t}
    assert planted and planted <= hits
    # nothing far from every item is reported
    words = {r.item_id: norm(r.text).split() for r in items.collect()}
    for d, i in hits - planted:
        assert plain_distance(words[i], texts[d].split()) <= 0.2 * len(words[i])
    kept = {r.doc_id for r in D.without_benchmark(spark, docs, items).collect()}
    assert kept == set(texts) - {d for d, _ in hits}


def test_layout_does_not_matter(spark):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    key = lambda df: sorted(map(tuple, D.benchmark_hits(spark, df, items).collect()))
    assert key(docs.repartition(11)) == key(docs.coalesce(1).orderBy("text"))


def test_blocks_of_items(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = sorted(map(tuple, D.benchmark_hits(spark, docs, items).collect()))
    kept = D.without_benchmark(spark, docs, items).count()
    monkeypatch.setattr(D, "BLOCK_ITEMS", 15)
    assert sorted(map(tuple, D.benchmark_hits(spark, docs, items).collect())) == whole
    assert D.without_benchmark(spark, docs, items).count() == kept


def test_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog and then it sleeps all day long"
    docs = [(1, None), (2, ""), (3, " . ! "), (None, item), (4, f"x {item.upper()}!"), (4, f"x {item.upper()}!"), (5, "word " * 30_000)]
    docs = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "..."), (1, item)], "item_id long, text string")
    hits = D.benchmark_hits(spark, docs, items).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id, r.distance) for r in hits) == sorted(2 * [(False, 4, 1, 0), (False, 4, 1, 0), (True, 0, 1, 0)])
    assert sorted(r.doc_id for r in D.without_benchmark(spark, docs, items).collect()) == [1, 2, 3, 5]
    assert D.benchmark_hits(spark, docs.limit(0), items).collect() == []
    assert D.benchmark_hits(spark, docs, items.limit(0)).collect() == []
    assert D.without_benchmark(spark, docs, items.limit(0)).count() == docs.count()


def test_anchors_are_local():
    h = np.random.default_rng(3).integers(1, 2**63, 500).astype(np.uint64)
    assert set(D.anchors(h[100:300])[(lambda a: (a >= D.REACH) & (a < 200 - D.REACH))(D.anchors(h[100:300]))] + 100) <= set(D.anchors(h))


def test_a_word_is_looked_up_once_for_many_texts():
    import numpy as np

    class Counted(D.NormalHashes):
        looked = 0

        def __getitem__(self, word):
            Counted.looked += 1
            return super().__getitem__(word)

    texts = ["One two, TWO! (three) ... two", None, "", " \n", "ΣΑΣ İx   two", "!!", "two " * 50]
    hashes = Counted()
    got = hashes.of_all(texts)
    assert Counted.looked == len({w for t in texts if t for w in t.encode().split()})
    for h, t in zip(got, texts, strict=True):
        cores = [w.decode().lower().strip(D._PUNCTUATION) for w in (t or "").encode().split()]
        assert h.tolist() == [(D.xxhash.xxh3_64_intdigest(c) >> 1) + 1 for c in cores if c] and h.dtype == np.uint64
    assert hashes.of_all([]) == [] and len(hashes.of(None)) == 0


def test_texts_are_walked_for_the_classes_of_the_items_only():
    import numpy as np

    ws = [f"w{i}" for i in range(400)]
    short, long = " ".join(ws[10:40]), " ".join(ws[100:200])
    for items, classes in (([(1, short)], {0, 1, 2}), ([(1, short), (2, long)], {0, 1, 2, 3}), ([(1, "w1")], set())):
        index = D.Items(items, D.Walks(4), complete=False)
        assert index.used <= classes and (index.used >= {2} or not classes)
        h = D.NormalHashes().of(" ".join(ws))
        starts = np.arange(0, 390, 3)
        every = {(r, c): keys.tolist() for r, (c, _, keys) in enumerate(D.Walks(4).hashes(h, starts, np.full(len(starts), 400)))}
        some = [(c, keys.tolist()) for c, _, keys in D.Walks(4).hashes(h, starts, np.full(len(starts), 400), index.used)]
        assert some == [(c, keys) for (_, c), keys in every.items() if c in index.used]
