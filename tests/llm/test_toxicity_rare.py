"""Toxicity from labels with errors and from insults that few documents hold."""

import random

import numpy as np

from monthspine.llm import toxicity as T

COMMON = ["idiot", "moron", "stupid", "pathetic", "loser", "scum"]
RARE = ["gobshite", "numbnuts", "wazzock", "plonker"]


def made(rng, vocabulary, insult=None, n=60):
    ws = [vocabulary[min(int(rng.expovariate(0.002)), len(vocabulary) - 1)] for _ in range(n)]
    if insult:
        ws.insert(rng.randrange(n), insult)
    return " ".join(ws)


def test_rare_insults_and_wrong_labels():
    rng = random.Random(4)
    ends = "ta ne ri so lu mak ver den hol pis".split()
    vocabulary = ["".join(rng.choice(ends) for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    texts = [made(rng, vocabulary) for _ in range(1200)]
    texts += [made(rng, vocabulary, COMMON[i % 6]) for i in range(300)] + [made(rng, vocabulary, w) for w in RARE for _ in range(12)]
    toxic = np.array([0] * 1200 + [1] * (len(texts) - 1200))
    wrong = rng.sample(range(len(texts)), len(texts) // 100)
    toxic[wrong] = 1 - toxic[wrong]
    # every insult is quoted in one clean document
    texts += [made(rng, vocabulary, w) for w in COMMON + RARE]
    toxic = np.append(toxic, [0] * 10)
    model = T.fit_toxicity(texts, toxic)
    scores = T.WordScores(model)
    found = lambda ws: np.mean(model.probability(scores.judge([made(rng, vocabulary, w) for w in ws for _ in range(10)])) >= 0.5)
    assert found(COMMON) > 0.9 and found(RARE) > 0.6
    assert found([None] * 20) < 0.05
