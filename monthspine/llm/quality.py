"""Quality classifier from weak labels: heuristic labellers, their accuracies by EM, and a hashed linear scorer.

Each labeller looks at one property of a text and votes junk (0), good (1) or abstains (2). Nobody says how far a vote can
be trusted: expectation-maximisation estimates for every labeller how it votes on good and on junk documents, from the
counts of vote patterns over all documents. The posteriors of a bounded sample of documents then train a logistic scorer
on hashed features of word shapes, which judges every document, also where labellers abstain.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_batches

JUNK, GOOD, ABSTAIN = 0, 1, 2
#: Hashed features of a text, and the most documents that train their weights.
BUCKETS = 1024
TRAINING_ROWS = 6000
_SYMBOLS = "#*$%&|<>"
_SENTENCE_END = re.compile(r"[.!?:;\"')\]]\s*$")

#: Labellers: (name, share it looks at, junk above (or below, if the first bound is the smaller one), good beyond).
LABELLERS = (
    ("symbols", "symbols", 0.03, 0.01),
    ("capitals", "capitals", 0.30, 0.12),
    ("letters", "letters", 0.80, 0.88),
    ("bare_words", "bare", 0.10, 0.04),
    ("stutter", "same", 0.10, 0.04),
    ("shouts", "shouts", 0.20, 0.05),
    ("variety", "distinct", 0.15, 0.25),
    ("open_lines", "open_lines", 0.60, 0.30),
)


class WordTable(dict):
    """Facts about words, computed once for each: characters, letters, capitals, symbols, shouted end, shape bucket."""

    def __init__(self, bound: int = 1_000_000):
        super().__init__()
        self.bound, self.facts, self.new = bound, np.empty((0, 6), np.int32), []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    @staticmethod
    def describe(word: str) -> tuple[int, ...]:
        shape, last = [], ""
        for c in word:
            kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c if c in _SYMBOLS else "."
            if kind != last:
                shape.append(kind)
                last = kind
        bucket = zlib.crc32("".join(shape[:12]).encode()) % (BUCKETS - 64)
        letters = sum(map(str.isalpha, word))
        capitals = sum(map(str.isupper, word))
        return len(word), letters, capitals, sum(c in _SYMBOLS for c in word), word.endswith("!!"), bucket

    def of(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and facts of all words, and the number of words of each text."""
        if len(self) > self.bound:
            self.clear()
            self.facts = self.facts[:0]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter((i for ws in split for i in map(self.__getitem__, ws)), np.int64, int(counts.sum()))
        if self.new:
            found = np.array([self.describe(w.decode()) for w in self.new], np.int32)
            self.facts = np.concatenate([self.facts, found])
            self.new = []
        return at, self.facts[at], counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def describe(texts: list[str | None], table: WordTable) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Shares the labellers look at, and the hashed features, of each text. Without words: all shares and features 0."""
    split = [t.encode().split() if t else [] for t in texts]
    at, facts, counts = table.of(split)
    n = np.maximum(counts, 1)
    chars, letters, capitals, symbols, shouts = _sums(facts[:, :5], counts).T
    text = np.repeat(np.arange(len(texts)), counts)
    same = np.zeros(len(at))
    same[1:] = (at[1:] == at[:-1]) & (text[1:] == text[:-1])
    bare = _sums((facts[:, 1] == 0).astype(float), counts)
    same = _sums(same, counts)
    ends = np.cumsum(counts)
    distinct = np.array([len(np.unique(at[e - c : e])) for e, c in zip(ends.tolist(), counts.tolist())], float)
    lines = [[x for x in (t or "").split("\n") if x.strip()] for t in texts]
    open_lines = np.array([sum(not _SENTENCE_END.search(x[-8:]) for x in ls) / max(1, len(ls)) for ls in lines])
    shares = {
        "n_words": counts,
        "symbols": symbols / np.maximum(chars, 1),
        "capitals": capitals / np.maximum(letters, 1),
        "letters": letters / np.maximum(chars, 1),
        "bare": bare / n,
        "same": same / n,
        "shouts": shouts / n,
        # long texts repeat words more; against the root of the length the share is about level
        "distinct": distinct / np.minimum(n, 20 * np.sqrt(n)),
        "open_lines": open_lines,
    }
    hashed = np.bincount(text * BUCKETS + facts[:, 5], minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS) / n[:, None]
    # shares of the whole text count more than single shapes
    hashed[:, BUCKETS - 1] = 4 * same / n
    hashed[:, BUCKETS - 2] = 4 * (1 - np.minimum(1, shares["distinct"]))
    hashed[:, BUCKETS - 3] = open_lines
    hashed[:, BUCKETS - 4] = counts == 0
    return shares, np.sqrt(hashed).astype(np.float32)


def votes(shares: dict[str, np.ndarray]) -> np.ndarray:
    """Votes of all labellers on each text; all vote junk without words, and a few words say nothing of shares of words."""
    out = np.full((len(shares["n_words"]), len(LABELLERS)), ABSTAIN, np.int8)
    for k, (name, share, junk, good) in enumerate(LABELLERS):
        x = shares[share]
        bad, fine = (x >= junk, x <= good) if junk > good else (x <= junk, x >= good)
        out[bad, k], out[fine, k] = JUNK, GOOD
        if name in ("stutter", "variety", "open_lines", "capitals", "bare_words"):
            out[shares["n_words"] < 20, k] = ABSTAIN
    out[shares["n_words"] == 0] = JUNK
    return out


def pattern_of(found: np.ndarray) -> np.ndarray:
    return found.astype(np.int64) @ 3 ** np.arange(found.shape[1], dtype=np.int64)


def votes_of(pattern: np.ndarray, k: int = len(LABELLERS)) -> np.ndarray:
    return (np.asarray(pattern)[:, None] // 3 ** np.arange(k) % 3).astype(np.int8)


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and accuracy[k, c, v]: the chance that labeller k votes v on a document of class c."""

    good: float
    accuracy: np.ndarray

    def posterior(self, found: np.ndarray) -> np.ndarray:
        """Chance that a document with these votes is good."""
        logs = np.log([1 - self.good, self.good]) + sum(np.log(self.accuracy[k][:, found[:, k]]).T for k in range(found.shape[1]))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, k: int = len(LABELLERS), rounds: int = 100) -> LabelModel:
    """EM on the counts of vote patterns. It starts from labellers that seldom vote junk on good documents."""
    found = votes_of(patterns, k)
    accuracy = np.tile(np.array([[0.4, 0.4, 0.2], [0.03, 0.77, 0.2]]), (k, 1, 1))
    model = LabelModel(0.8, accuracy)
    total = max(1.0, float(counts.sum()))
    for _ in range(rounds):
        q = model.posterior(found) * counts
        sides = np.stack([counts - q, q])
        accuracy = np.stack([[[side[found[:, j] == v].sum() + 1.0 for v in range(3)] for side in sides] for j in range(k)])
        accuracy = accuracy / accuracy.sum(axis=2, keepdims=True)
        good = float(np.clip(q.sum() / total, 0.01, 0.99))
        moved = abs(good - model.good) + float(np.abs(accuracy - model.accuracy).max())
        model = LabelModel(good, accuracy)
        if moved < 1e-6:
            break
    return model


def fit_scorer(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 100) -> np.ndarray:
    """Logistic weights (the last is the constant) for soft labels, by Newton steps over the buckets in use."""
    used = np.flatnonzero(x.any(axis=0))
    a = np.hstack([x[:, used], np.ones((len(x), 1))]).astype(np.float64)
    n = max(1, len(x))
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - y) / n + ridge * w
        curve = (a.T * (p * (1 - p) / n)) @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    out = np.zeros(x.shape[1] + 1)
    out[used], out[-1] = w[:-1], w[-1]
    return out


@dataclass(frozen=True)
class QualityModel:
    label: LabelModel
    weights: np.ndarray

    def score(self, texts: list[str | None], table: WordTable) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of the votes, and the scorer's chance of good; 0 for texts without words."""
        shares, x = describe(texts, table)
        z = x @ self.weights[:-1] + self.weights[-1]
        score = np.where(shares["n_words"] == 0, 0.0, 1 / (1 + np.exp(-np.clip(z, -50, 50))))
        return self.label.posterior(votes(shares)), score


def fit_quality(docs: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Labeller accuracies from the vote patterns of all documents; weights from about ``rows`` of them at most."""

    def make():
        table = WordTable()
        return lambda texts: {"pattern": pattern_of(votes(describe(texts, table)[0]))}

    patterns = map_batches(docs.select(F.col(text_col).alias("text")), ["text"], make, "pattern long")
    seen = patterns.groupBy("pattern").count().orderBy("pattern").collect()
    model = fit_label_model(np.array([r["pattern"] for r in seen], np.int64), np.array([r["count"] for r in seen], float))

    def make_features():
        table = WordTable()

        def step(texts):
            shares, x = describe(texts, table)
            return {"good": model.posterior(votes(shares)), "x": [v.tobytes() for v in x]}

        return step

    sample = bounded_sample(docs.select(id_col, text_col), rows, F.col(id_col), F.col(text_col)).select(F.col(text_col).alias("text"))
    got = map_batches(sample, ["text"], make_features, "good double, x binary").toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, BUCKETS)
    return QualityModel(model, fit_scorer(x, got["good"].to_numpy()))


def quality_scores(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``weak_good`` (posterior of the votes), ``score`` (0 to 1) and ``kept`` (score at least 0.5).

    Null, empty and blank texts score 0. Repeated rows and equal ids give a row each; other columns are not read. An empty
    table gives no row.
    """

    def make():
        table = WordTable()

        def step(ids, texts):
            weak, score = model.score(texts, table)
            return {"id": ids, "weak_good": weak, "score": score, "kept": score >= 0.5}

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = map_batches(rows, ["id", "text"], make, "id long, weak_good double, score double, kept boolean")
    return out.withColumnRenamed("id", id_col)


def good_documents(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with all columns."""

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        table = WordTable()
        parts = [model.score(texts.iloc[i : i + 500].tolist(), table)[1] >= 0.5 for i in range(0, len(texts), 500)]
        return pd.Series(np.concatenate(parts) if parts else np.empty(0, bool))

    return docs.filter(keep(F.col(text_col)))


def op3_quality(docs: DataFrame) -> DataFrame:
    return quality_scores(docs, fit_quality(docs))
