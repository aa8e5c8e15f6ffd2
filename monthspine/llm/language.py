"""Language identification with hyperdimensional vectors.

Every letter has a random vector of DIMENSIONS signs. An n-gram binds the vectors of its letters, each rotated by its
place, by multiplication; a text bundles the vectors of all its n-grams by addition; a language prototype bundles the
unit vectors of its training texts. A text has the language whose prototype is nearest by cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, held_out, map_batches, sample_hash, slices, stored

DIMENSIONS = 1024
GRAM = 3
#: Most labelled documents of a language, about, that train its prototype; all of a language with fewer.
TRAINING_ROWS = 8000
#: Counts of so many languages at most are broadcast.
FEW_LANGUAGES = 10_000
#: Columns of the table of n-gram counts that are in memory at once.
_BLOCK = 4096
_SPACE = 32


class LetterVectors:
    """The sign vectors of letters by code point, made from the code point alone."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self._known = dimensions, {}

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.empty((len(points), self.dimensions), np.int8)
        for row, p in enumerate(points.tolist()):
            if p not in self._known:
                if len(self._known) > 20_000:
                    self._known.clear()
                self._known[p] = np.random.default_rng([17, p]).integers(0, 2, self.dimensions, np.int8) * 2 - 1
            out[row] = self._known[p]
        return out


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the letters of all texts in lower case, any run of other characters as one space, and their text."""
    lower = [f" {t.lower()} " if t else "  " for t in texts]
    stream = np.frombuffer("".join(lower).encode("utf-32-le"), "<u4").astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lower), np.int64, len(lower)))
    points, place = np.unique(stream, return_inverse=True)
    is_letter = np.fromiter((chr(p).isalpha() for p in points.tolist()), bool, len(points))
    stream = np.where(is_letter, points, _SPACE)[place]
    first = np.concatenate([[True], (stream[1:] != _SPACE) | (stream[:-1] != _SPACE) | (text[1:] != text[:-1])])
    return stream[first], text[first]


def text_vectors(texts: list[str | None], vectors: LetterVectors, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text, and whether it has a letter."""
    stream, text = letters(texts)
    out = np.zeros((len(texts), vectors.dimensions), np.float32)
    spoken = np.bincount(text[stream != _SPACE], minlength=len(texts)) > 0
    if len(stream) < n:
        return out, spoken
    points, letter = np.unique(stream, return_inverse=True)
    inside = text[n - 1 :] == text[: len(text) - n + 1]
    gram = np.zeros(int(inside.sum()), np.int64)
    # numbers of n-grams are made anew with each letter, so that they stay small for any alphabet
    for k in range(n):
        gram = gram * len(points) + letter[k : len(letter) - n + 1 + k][inside]
        if k < n - 1:
            _, gram = np.unique(gram, return_inverse=True) if len(points) ** (k + 2) > 2**40 else (None, gram)
    kinds, first, kind = np.unique(gram, return_index=True, return_inverse=True)
    at = np.flatnonzero(inside)[first]
    owner = text[n - 1 :][inside]
    table = vectors.of(points)
    turned = [np.roll(table, n - 1 - k, axis=1) for k in range(n)]
    for a in range(0, len(kinds), _BLOCK):
        b = min(a + _BLOCK, len(kinds))
        bound = turned[0][letter[at[a:b]]]
        for k in range(1, n):
            bound = bound * turned[k][letter[at[a:b] + k]]
        here = (kind >= a) & (kind < b)
        cells = owner[here] * (b - a) + kind[here] - a
        counts = np.bincount(cells, minlength=len(texts) * (b - a)).reshape(len(texts), b - a)
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out, spoken


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in code point order, their unit prototypes, and the mean prototype that all languages share."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    shared: np.ndarray

    def predict(self, texts: list[str | None], vectors: LetterVectors) -> tuple[list[str], np.ndarray]:
        """Language (``und`` without letters or without any prototype) and (1 + cosine) / 2 of each text."""
        x, spoken = text_vectors(texts, vectors)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        cosine = unit(unit(x) - self.shared) @ self.prototypes.T
        best = cosine.argmax(axis=1)
        score = np.where(spoken, np.clip((1 + cosine.max(axis=1)) / 2, 0, 1), 0.0)
        return [self.languages[b] if s else "und" for b, s in zip(best.tolist(), spoken.tolist())], score


def sample_of_each(known: DataFrame, rows: int, few: int = FEW_LANGUAGES) -> DataFrame:
    """About ``rows`` rows of each language, by a hash of id and text; those with the least hash always, so none is left out.

    The counts have a row for each value of ``lang``. Up to ``few`` of them are broadcast; more join on salts, so that a
    language with a third of all rows is no single task.
    """
    drawn = known.withColumn("h", sample_hash(F.col("id"), F.col("text")))
    counts = drawn.groupBy("lang").agg(F.count("*").alias("n_lang"), F.min("h").alias("least"))
    counts = stored(known.sparkSession, counts, "languages")
    if counts.count() <= few:
        joined = drawn.join(F.broadcast(counts), "lang")
    else:
        salts = F.array(*[F.lit(i).cast("long") for i in range(64)])
        joined = drawn.withColumn("salt", F.col("h") % 64).join(counts.withColumn("salt", F.explode(salts)), ["lang", "salt"]).drop("salt")
    share = F.lit(float(rows)) / F.col("n_lang")
    chosen = (share >= 1) | (F.col("h").cast("double") < share * 2.0**63) | (F.col("h") == F.col("least"))
    return joined.filter(chosen).drop("n_lang", "least", "h")


def fit_language(docs: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Prototypes from about ``rows`` documents of each language at most, outside the held-out fold.

    A language with fewer documents has all of them in its prototype, however large the table is.
    What the languages have in common is taken from texts and prototypes before they are compared.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    known = sample_of_each(known, rows).select("lang", "text")
    schema = "lang string, n long, bundle binary"
    arrow = arrow_schema(schema)

    def bundle(batches):
        vectors, sums = LetterVectors(), {}
        for piece in slices(batches):
            langs = piece.column(0).to_pylist()
            x, spoken = text_vectors(piece.column(1).to_pylist(), vectors)
            x = unit(x)
            for lang in set(langs):
                rows = np.array([a == lang for a in langs]) & spoken
                n, total = sums.get(lang, (0, 0))
                sums[lang] = (n + int(rows.sum()), total + x[rows].sum(axis=0, dtype=np.float64))
        for lang, (n, total) in sums.items():
            yield pa.RecordBatch.from_pylist([{"lang": lang, "n": n, "bundle": total.tobytes()}], schema=arrow)

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b) for b in part["bundle"]], axis=0)
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "n": [part["n"].sum()], "bundle": [total.tobytes()]})

    got = known.mapInArrow(bundle, schema).groupBy("lang").applyInPandas(add, schema).filter("n > 0").collect()
    got = sorted(got, key=lambda r: r.lang.encode())
    if not got:
        return LanguageModel((), np.empty((0, DIMENSIONS)), np.zeros(DIMENSIONS))
    means = unit(np.stack([np.frombuffer(r.bundle) for r in got]))
    shared = means.mean(axis=0) if len(got) > 1 else np.zeros(DIMENSIONS)
    return LanguageModel(tuple(r.lang for r in got), unit(means - shared), shared)


def languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score``.

    Null, empty and letterless texts give ``und`` and score 0. Repeated rows and equal ids give a row each; other columns
    are not read. An empty table gives no row.
    """

    def make():
        vectors = LetterVectors()

        def step(ids, texts):
            lang, score = model.predict(texts, vectors)
            return {"id": ids, "lang_pred": lang, "score": score}

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, ["id", "text"], make, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def op9_language(docs: DataFrame) -> DataFrame:
    return languages(docs, fit_language(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
