"""Toxicity by a string-kernel support vector machine with Nystroem landmarks.

The kernel of two words counts their common subsequences of three characters, gaps allowed; a subsequence weighs
LAMBDA to the length it spans in each word (at most SPAN), so an insult with inserted or dropped characters still shares
most of them. Landmark words give the Nystroem features K_mm**-1/2 k(landmarks, word), and a linear support vector machine
with squared hinge loss is trained on them. Labels are those of whole documents: a sentence of a clean document has clean
words only, and a sentence of a toxic one is a positive example for its most telling words, which are found first by how
much more often they, or words with the same beginning, occur in toxic documents. A document is judged by its worst word,
the next worst, and the share of words on the toxic side, made a probability on the training documents and their sentences.

The decision is linear in the kernel, so it is kept as one weight per subsequence (the landmarks' subsequences weighed
by their coefficients) and a word is judged by a sum over its own subsequences: the same value without meeting landmarks.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, map_batches, mix

LAMBDA = 0.7
SPAN = 6
LANDMARKS = 160
#: Most labelled documents that train the model, in all and of either label.
TRAINING_ROWS = 8000
#: Chance, over all words and beginnings of a sample together, that one not tied to toxic documents becomes a witness.
WITNESS_CHANCE = 0.01
#: A witness, and a word that stands for it, is so many times as frequent in toxic documents as in clean ones, at least.
WITNESS_RATIO = 10

_SKIP = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_START, _END = 62, 63
#: Distances of the second and third character from the first, by the length they span.
_STEPS = [(a, b) for a, b in itertools.combinations(range(1, SPAN), 2)]


def _letter_codes() -> np.ndarray:
    """Codes 1 .. 61 of characters: Latin letters and digits have their own, others share the rest; 62 and 63 mark the ends."""
    codes = 37 + np.arange(0x110000) % 25
    codes[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]] = np.arange(1, 37)
    return codes.astype(np.int32)


_CODES = _letter_codes()


def units(text: str | None) -> list[str]:
    """Words in lower case, letters and digits only; a run of three and more single characters is one word as well."""
    if not text:
        return []
    ws = [w for w in (_SKIP.sub("", w) for w in text.lower().split()) if w]
    return ws + spelled(ws)


def spelled(ws: list[str]) -> list[str]:
    """Words that are spelled with spaces between their letters."""
    runs = (list(g) for one, g in itertools.groupby(ws, lambda w: len(w) == 1) if one)
    return ["".join(r) for r in runs if len(r) >= 3]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of every subsequence of three characters within SPAN, of all words with their end marks."""
    lens = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    stream = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le"), "<u4")
    stream = np.where(stream == 1, _START, np.where(stream == 2, _END, _CODES[stream]))
    owner = np.repeat(np.arange(len(words)), lens)
    found = []
    for a, b in _STEPS:
        if b >= len(stream):
            continue
        inside = owner[:-b] == owner[b:]
        code = (stream[:-b] * 4096 + stream[a : len(stream) - b + a] * 64 + stream[b:])[inside]
        found.append((owner[:-b][inside], code, np.full(len(code), LAMBDA ** (b + 1))))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def kernel_norms(owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """What kernel values are divided by: the root of a word's squared weights."""
    return np.sqrt(np.maximum(np.bincount(owner, weight * weight, n), 1e-12))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of words (rows) and landmarks (columns)."""
    owner, code, weight = subsequences(words)
    norms = kernel_norms(owner, weight, len(words))
    out = np.empty((len(words), len(landmarks)))
    table = np.zeros(64**3)
    for j, landmark in enumerate(landmarks):
        o, c, w = subsequences([landmark])
        np.add.at(table, c, w / kernel_norms(o, w, 1)[0])
        out[:, j] = np.bincount(owner, weight * table[code], len(words)) / norms
        table[c] = 0
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, steps: int = 60) -> np.ndarray:
    """Squared-hinge support vector machine (the last weight is the constant) by Newton steps on the active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(steps):
        active = y * (x @ w) < 1
        a = x[active]
        c = cost * weight[active]
        new = np.linalg.solve(np.diag(ridge) + (a.T * c) @ a, (a.T * c) @ y[active])
        if np.abs(new - w).max() < 1e-7:
            return new
        w = new
    return w


#: What a document without words is judged by: worst and next worst word score, and toxic words per thousand (logarithm).
_SILENT = (-3.0, -3.0, 0.0)


@dataclass(frozen=True)
class ToxicityModel:
    """Weight of each subsequence, constant, and the weights that make what a document is judged by a probability."""

    table: np.ndarray
    constant: float
    judge: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Decision value of each word, 10,000 words at a time: a word has a hundred subsequences or more."""
        out = np.empty(len(words))
        for i in range(0, len(words), 10_000):
            part = words[i : i + 10_000]
            owner, code, weight = subsequences(part)
            norms = kernel_norms(owner, weight, len(part))
            out[i : i + len(part)] = np.bincount(owner, weight * self.table[code], len(part)) / norms + self.constant
        return out

    def probability(self, seen: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(seen @ self.judge[:-1] + self.judge[-1], -50, 50)))


def judged_by(scores: np.ndarray) -> tuple[float, float, float]:
    """Worst and next worst word (at least 3 below and above zero), and the logarithm of toxic words per thousand."""
    if not len(scores):
        return _SILENT
    top = np.clip(np.partition(scores, -2)[-2:], -3, 3) if len(scores) > 1 else np.clip([-3.0, scores[0]], -3, 3)
    return float(top[1]), float(top[0]), float(np.log1p(1000 * (scores > 0).mean()))


class WordScores(dict):
    """Scores of raw words, each judged once; bounded."""

    def __init__(self, model: ToxicityModel, bound: int = 1_000_000):
        super().__init__()
        self.model, self.bound = model, bound
        self.scores, self.size, self.new = np.empty(0), np.empty(0, np.int32), []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def judge(self, texts: list[str | None]) -> np.ndarray:
        """A row of what each text is judged by. Words without letters or digits do not count."""
        if len(self) > self.bound:
            self.clear()
            self.scores, self.size = self.scores[:0], self.size[:0]
        split = [t.encode().split() if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter((i for ws in split for i in map(self.__getitem__, ws)), np.int64, int(counts.sum()))
        if self.new:
            plain = [_SKIP.sub("", w.decode().lower()) for w in self.new]
            self.scores = np.concatenate([self.scores, self.model.word_scores(plain)])
            self.size = np.concatenate([self.size, np.array([len(p) for p in plain], np.int32)])
            self.new = []
        out = np.empty((len(texts), 3))
        ends = np.cumsum(counts)
        for t, (e, n) in enumerate(zip(ends.tolist(), counts.tolist())):
            here = at[e - n : e]
            size = self.size[here]
            here = here[size > 0]
            scores = self.scores[here]
            if (size == 1).sum() >= 3:
                joined = spelled([p for p in (_SKIP.sub("", w.decode().lower()) for w in split[t]) if p])
                if joined:
                    scores = np.concatenate([scores, self.model.word_scores(joined)])
            out[t] = judged_by(scores)
        return out


def _beginnings(word: str) -> list[str]:
    """The word itself (marked) and its beginnings of 4 to 8 characters."""
    return [f"{word}$", *(word[:k] for k in range(4, min(9, len(word))))]


def mark_counts(marks: np.ndarray, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the words of all documents, and the number of documents of each."""
    if not docs:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(np.concatenate([np.unique(marks[d]) for d in docs]), return_counts=True)


def tail(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Logarithm of Chernoff's bound on the chance that a or more of a + b documents are toxic, if each is with this share."""
    n = a + b
    out = a * np.log(np.maximum(a, 1) / (n * share)) + b * np.log(np.maximum(b, 1) / (n * (1 - share)))
    return np.where(a > n * share, -out, 0.0)


def find_witnesses(words: list[str], docs: list[np.ndarray], toxic: np.ndarray, chance: float = WITNESS_CHANCE) -> list[str]:
    """Words and beginnings that are more frequent in toxic documents than chance allows, most telling first.

    ``docs`` are the numbers of each document's words. Beginnings are counted by hashes, once in a document. Toxic documents
    with a witness are explained; the search goes on in those that are left, where few occurrences tell a rare insult from
    chance. The bound is one on chance, so an insult needs no more occurrences in a larger sample.
    """
    marks = np.zeros((len(words), 6), np.uint64)
    for i, w in enumerate(words):
        if len(w) >= 3:
            found = _beginnings(w)
            marks[i, : len(found)] = [xxhash.xxh3_64_intdigest(b) | 1 for b in found]
    left = [d for d, label in zip(docs, toxic.tolist()) if label]
    clean = len(docs) - len(left)
    kinds, counts = mark_counts(marks, [d for d, label in zip(docs, toxic.tolist()) if not label])
    chosen: list[str] = []
    while left and clean:
        keys, a = mark_counts(marks, left)
        a, b = a.astype(float), np.zeros(len(keys))
        _, here, there = np.intersect1d(keys, kinds, assume_unique=True, return_indices=True)
        b[here] = counts[there]
        log = tail(a, b, len(left) / (len(left) + clean))
        good = (keys > 0) & (a >= 3) & (a / len(left) > WITNESS_RATIO * b / clean) & (log <= np.log(chance / max(1, len(keys))))
        score = dict(zip(keys[good].tolist(), log[good].tolist()))
        named: dict[str, float] = {}
        for i in np.flatnonzero(np.isin(marks, keys[good]).any(axis=1)).tolist():
            named.update({u: score[h] for u, h in zip(_beginnings(words[i]), marks[i].tolist()) if h in score})
        before = len(chosen)
        for u in sorted(named, key=lambda u: (named[u], len(u), u)):
            stem = u.rstrip("$")
            if not any(stem.startswith(c.rstrip("$")) or c.startswith(stem) for c in chosen):
                chosen.append(u)
        if len(chosen) == before:
            break
        new = set(chosen[before:])
        telling = np.array([is_witness(w, new) for w in words])
        left = [d for d in left if not telling[d].any()]
    return chosen


def is_witness(word: str, witnesses: set[str]) -> bool:
    return any(b in witnesses for b in _beginnings(word)) or word in witnesses


def first_of_copies(words: list[str], docs: list[np.ndarray]) -> list[int]:
    """One document of each group of near copies: those that agree in one of ten bands of three min-hashes of their less
    frequent words.

    Copies of one toxic document would make any of its words look like an insult.
    """
    count = np.zeros(len(words), np.int64)
    for d in docs:
        count[d] += 1
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    rare = count <= max(2, len(docs) // 20)
    salts = np.random.default_rng(3).integers(1, 2**63, 30, dtype=np.uint64)
    known, first = set(), []
    for i, d in enumerate(docs):
        h = hashes[d[rare[d]]]
        if not len(h):
            first.append(i)
            continue
        least = np.array([mix(h ^ salt).min() for salt in salts]).reshape(10, 3)
        bands = {(k, *row) for k, row in enumerate(least.tolist())}
        if not bands & known:
            first.append(i)
        known |= bands
    return first


def gapped(word: str, rng: np.random.Generator, n: int = 3) -> list[str]:
    """The word with a character put in or doubled, at n random places inside it."""
    out = []
    for at in rng.integers(1, max(2, len(word)), n).tolist():
        put = "abcdefghijklmnopqrstuvwxyz0123456789"[int(rng.integers(36))] if rng.integers(2) else word[at - 1]
        out.append(word[:at] + put + word[at:])
    return out


def fit_toxicity(texts: list[str | None], toxic: np.ndarray, landmarks: int = LANDMARKS, seed: int = 5) -> ToxicityModel:
    """Train on labelled documents; without both labels nothing is toxic."""
    rng = np.random.default_rng(seed)
    none = ToxicityModel(np.zeros(64**3), -1.0, np.array([0.0, 0.0, 0.0, -5.0]))
    if not 0 < toxic.sum() < len(toxic):
        return none
    place: dict[str, int] = {}
    docs = [np.fromiter({place.setdefault(w, len(place)) for w in units(t)}, np.int64) for t in texts]
    words = list(place)
    first = first_of_copies(words, docs)
    texts, toxic, docs = [texts[i] for i in first], toxic[first], [docs[i] for i in first]
    seen = np.zeros((2, len(words)), np.int64)
    for d, t in zip(docs, toxic.tolist()):
        seen[t, d] += 1
    witnesses = set(find_witnesses(words, docs, toxic))
    # a few clean documents with an insult (a quotation, a wrong label) do not make it a clean word
    often = seen[1] * int((toxic == 0).sum()) > WITNESS_RATIO * seen[0] * int(toxic.sum())
    bad = {words[i]: int(seen[1, i]) for i in np.flatnonzero(often).tolist() if is_witness(words[i], witnesses)}
    clean = sorted(words[i] for i in np.flatnonzero(seen[0] > 0).tolist() if words[i] not in bad)
    del place, docs, words
    if not bad or not clean:
        return none
    order = sorted(bad, key=lambda w: (-bad[w], w))
    positive = order[:1500]
    pick = lambda n: [clean[i] for i in sorted(rng.choice(len(clean), min(n, len(clean)), replace=False))]
    marks = positive[: landmarks // 2]
    # one landmark for each witness before further common words
    first = {next((w for w in order if is_witness(w, {u})), None) for u in witnesses} - {None}
    marks = (sorted(first, key=lambda w: (-bad[w], w)) + [w for w in marks if w not in first])[: landmarks // 2]
    marks += pick(landmarks - len(marks))
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    negative = pick(6000)
    known = set(clean)
    positive += sorted({v for w in positive[:400] for v in gapped(w, rng)} - known - set(positive))
    for _ in range(4):
        words = positive + negative
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        weight = np.where(y > 0, len(negative) / max(1, len(positive)) * 0.5, 1.0)
        w = fit_svm(kernel(words, marks) @ root, y, weight)
        beta = root @ w[:-1]
        table = np.zeros(64**3)
        for j, mark in enumerate(marks):
            o, c, v = subsequences([mark])
            np.add.at(table, c, beta[j] * v / kernel_norms(o, v, 1)[0])
        model = ToxicityModel(table, float(w[-1]), none.judge)
        # the clean words that come nearest to toxic ones join the negative examples
        scores = model.word_scores(clean)
        hard = [clean[i] for i in np.argsort(-scores, kind="stable")[:1500] if scores[i] > -1]
        if set(hard) <= set(negative):
            break
        negative = sorted(set(negative) | set(hard))
    pieces, labels = _sentences(texts, toxic, witnesses)
    scores, everything = WordScores(model), texts + pieces
    judged = np.concatenate([scores.judge(everything[i : i + 500]) for i in range(0, len(everything), 500)])
    return ToxicityModel(table, model.constant, _calibrate(judged, np.concatenate([toxic, labels])))


def _sentences(texts: list[str | None], toxic: np.ndarray, witnesses: set[str]) -> tuple[list[str], np.ndarray]:
    """One sentence of each document with its label: of a toxic one the first with a witness, of a clean one the first."""
    pieces, labels = [], []
    for text, t in zip(texts, toxic.tolist()):
        for piece in _SENTENCE.split(text or ""):
            ws = units(piece)
            if ws and (not t or any(is_witness(w, witnesses) for w in ws)):
                pieces.append(piece)
                labels.append(t)
                break
    return pieces, np.array(labels, np.int64)


def _calibrate(seen: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic weights from documents and sentences; a toxic sign never speaks for a text, so none is negative."""
    used = [0, 1, 2]
    while True:
        a = np.hstack([seen[:, used], np.ones((len(seen), 1))])
        w = np.zeros(len(used) + 1)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a.T * (p * (1 - p) + 1e-6)) @ a + 1e-2 * np.eye(len(w)), a.T @ (p - toxic) + 1e-2 * w)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        low = [k for k in range(len(used)) if w[k] < 0]
        if not low:
            out = np.zeros(4)
            out[used], out[3] = w[:-1], w[-1]
            return out
        used.pop(low[0])


def training_rows(
    docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text, toxic) of at most about ``rows`` labelled documents outside the held-out fold, half of either label at most.

    An id that stands for several rows gives one, the text that comes first in code-point order; so no repeated row makes the
    sample longer. Other columns of either table, also of these names, are not looked at.
    """
    docs = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    known = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    parts = [bounded_sample(known.filter(F.col("toxic") == t), rows // 2, F.col(id_col)) for t in (1, 0)]
    chosen = parts[0].unionByName(parts[1])
    return docs.join(chosen, id_col).groupBy(id_col).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on).

    Null, empty and blank texts have the score of a text without any toxic word. Repeated rows and equal ids give a row
    each; other columns are not read. An empty table gives no row.
    """

    def make():
        scores = WordScores(model)

        def step(ids, texts):
            p = model.probability(scores.judge(texts))
            return {"id": ids, "score": p, "predicted": (p >= 0.5).astype(np.int32)}

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, ["id", "text"], make, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    got = training_rows(docs, labels).toPandas().sort_values("doc_id")
    model = fit_toxicity(got["text"].tolist(), got["toxic"].to_numpy(np.int64))
    return toxicity_scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
