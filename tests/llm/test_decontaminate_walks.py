"""What the walks find on their own, and items that share a beginning."""

import random
import time

import pytest
from test_decontaminate import edited, plain_distance, prose

from monthspine.llm import decontaminate as D


def walks():
    return D.Walks(D.repeats_for(D.RECALL, D.DESIGN_DISTANCE))


def rare_words(rng, n):
    return [f"w{rng.randrange(20_000)}" for _ in range(n)]


def test_items_with_anchors_come_through_walks_alone():
    rng = random.Random(31)
    items = [(i, " ".join(rare_words(rng, rng.randint(40, 80)))) for i in range(300)]
    index, hashes = D.Items(items, walks(), complete=False), D.NormalHashes()
    assert not index.run_sizes
    texts = [hashes.of(" ".join(rare_words(rng, 50) + edited(rng, t.split(), 0.2) + rare_words(rng, 50))) for _, t in items]
    wanted = {k for k, w in enumerate(index.words) if D.edit_end(w, texts[k])[0] <= int(D.MAX_DISTANCE * len(w))}
    found = {t for t, k, *_ in index.matches(texts, D.MAX_DISTANCE) if t == k}
    assert len(wanted) > 200 and len(found & wanted) >= D.RECALL * len(wanted)


@pytest.mark.parametrize("words", [15, 20, 28, 40, 60])
def test_recall_at_the_bound_for_each_length(words):
    rng = random.Random(words)
    items = [(i, " ".join(rare_words(rng, words))) for i in range(150)]
    index, hashes = D.Items(items, walks(), complete=False), D.NormalHashes()
    texts = [hashes.of(" ".join(rare_words(rng, 50) + edited(rng, t.split(), 0.2) + rare_words(rng, 50))) for _, t in items]
    wanted = {k for k, w in enumerate(index.words) if D.edit_end(w, texts[k])[0] <= int(D.MAX_DISTANCE * len(w))}
    found = {t for t, k, *_ in index.matches(texts, D.MAX_DISTANCE) if t == k}
    assert len(found & wanted) >= D.RECALL * len(wanted) > 0


@pytest.mark.parametrize("complete", [True, False])
def test_shared_beginnings_against_plain_distances(complete, monkeypatch):
    rng = random.Random(8)
    prompt = prose(rng, 8)
    items = [(i, " ".join(prompt + prose(rng, rng.randint(4, 40)))) for i in range(60)]
    items += [(60 + i, items[i][1]) for i in range(20)] + [(80, " ".join(prompt))]
    texts = [" ".join(prose(rng, 20) + edited(rng, t.split(), 0.1) + prose(rng, 20)) for _, t in items[::3]]
    texts += [" ".join(prompt + prompt + prose(rng, 9) + prompt), "", " ".join(prompt[2:])]
    hashes = D.NormalHashes()
    texts = [hashes.of(t) for t in texts]
    found = {}
    for bound in (1, D.SHARED, 10_000):
        monkeypatch.setattr(D, "SHARED", bound)
        found[bound] = D.Items(items, walks(), complete=complete).matches(texts, D.MAX_DISTANCE)
    assert found[1] == found[D.SHARED] == found[10_000]
    if complete:
        words = [hashes.of(t).tolist() for _, t in items]
        near = {(t, k): plain_distance(w, x.tolist()) for t, x in enumerate(texts) for k, w in enumerate(words)}
        assert {(t, k) for t, k, *_ in found[1]} == {p for p, n in near.items() if n <= int(0.2 * len(words[p[1]]))}


def test_many_items_of_one_prompt():
    rng = random.Random(4)
    prompt = "answer the following question with one of the options".split()
    items = [(i, " ".join(prompt + rare_words(rng, 30))) for i in range(20_000)]
    hashes = D.NormalHashes()
    texts = [hashes.of(" ".join(rare_words(rng, 20) + t.split() + rare_words(rng, 20))) for _, t in items[:1000]]
    texts += [hashes.of(" ".join(prompt + rare_words(rng, 40))) for _ in range(1000)]
    index = D.Items(items, walks(), complete=True)
    start = time.time()
    hits = {(t, k) for t, k, distance, *_ in index.matches(texts, D.MAX_DISTANCE) if distance == 0}
    assert hits >= {(i, i) for i in range(1000)} and all(t < 1000 for t, _ in hits)
    assert time.time() - start < 60


def test_more_anchors_need_fewer_walks():
    counts = [D.repeats_for(0.9, 0.2, n_anchors=n) for n in (5, 7, 12, 30)]
    assert counts == sorted(counts, reverse=True) and counts[1] == 4
    with pytest.raises(ValueError):
        D.repeats_for(0.9, 0.2, n_anchors=1)
