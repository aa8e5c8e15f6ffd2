"""Quality rules as a short-circuit cascade, ordered by what was measured on a sample.

A rule rejects a document from a few counts of its text. Counts differ in cost, and rules in how much they reject. The
cascade measures both on a sample (seconds for the counts a rule needs, share of documents it rejects), orders the rules
by rejection per cost and stops at the first rule that rejects. The order never changes which documents are kept.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Windows, WordHashes, bounded_sample, covered, map_batches

_SYMBOL = re.compile(r"[#*$%&|<>]")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_WORD = re.compile(WORD)


class TextCounts:
    """Counts of one text, each computed when first asked for."""

    def __init__(self, text: str | None, hashes: WordHashes, windows: Windows):
        self.text, self._hashes, self._windows, self._known = text or "", hashes, windows, {}

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = COUNTS[name](self)
        return self._known[name]


def _dup_lines(c: TextCounts) -> int:
    seen, dup = set(), 0
    for line in c.text.split("\n"):
        if _WORD.search(line):
            dup += line in seen
            seen.add(line)
    return dup


def _repeat_words(c: TextCounts) -> int:
    h = c._windows.of(c._hashes.of(c.words))
    if not len(h):
        return 0
    _, back, count = np.unique(h, return_inverse=True, return_counts=True)
    return int(covered(count[back] > 1, c._windows.size, c.n_words).sum())


#: The counts rules may use. Words are bytes; a code point is a byte that does not continue another.
COUNTS: dict[str, Callable[[TextCounts], object]] = {
    "words": lambda c: c.text.encode().split(),
    "n_words": lambda c: len(c.words),
    "word_chars": lambda c: len(b"".join(c.words).decode()),
    "n_symbols": lambda c: len(_SYMBOL.findall(c.text)),
    "n_dup_lines": _dup_lines,
    "n_lines": lambda c: sum(1 for x in c.text.split("\n") if _WORD.search(x)),
    "n_repeat_words": _repeat_words,
    "n_letters": lambda c: sum(map(str.isalpha, c.text)),
    "n_capitals": lambda c: len(_CAPITAL.findall(c.text)),
}


@dataclass(frozen=True)
class Rule:
    """Rejects where ``test`` is true; ``needs`` are the counts it reads, for measuring its cost."""

    name: str
    needs: tuple[str, ...]
    test: Callable[[TextCounts], bool]


#: Both base rules of the contract, and the shares beyond which a text is taken for junk.
BASE = (
    Rule("too_short", ("n_words",), lambda c: c.n_words < 10),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda c: 100 * c.n_repeat_words > 20 * c.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", ("n_symbols", "word_chars"), lambda c: 100 * c.n_symbols > 10 * c.word_chars),
    Rule("same_lines", ("n_dup_lines", "n_lines"), lambda c: 100 * c.n_dup_lines > 30 * c.n_lines),
    Rule("word_length", ("n_words", "word_chars"), lambda c: not 2 * c.n_words <= c.word_chars <= 20 * c.n_words),
    Rule("few_letters", ("n_letters", "word_chars"), lambda c: 100 * c.n_letters < 60 * c.word_chars),
    Rule("shouting", ("n_letters", "n_capitals"), lambda c: 100 * c.n_capitals > 60 * c.n_letters),
)


def counter(size: int = 5) -> Callable[[str | None], TextCounts]:
    hashes, windows = WordHashes(), Windows(size, 0x9E3779B97F4A7C15)
    return lambda text: TextCounts(text, hashes, windows)


def measure(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """Each rule with its seconds per text and the share of texts it rejects, every rule alone on every text."""
    of = counter()
    out = []
    for rule in rules:
        began, hits = time.perf_counter(), 0
        for text in texts:
            hits += bool(rule.test(of(text)))
        out.append((rule, (time.perf_counter() - began) / max(1, len(texts)), hits / max(1, len(texts))))
    return out


def ordered(measured: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejection per second first; equal ones by name."""
    return [m[0] for m in sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-9), m[0].name))]


def plan_cascade(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 1000, id_col: str = "doc_id", text_col: str = "text"
) -> list[Rule]:
    """Order the rules on about ``sample`` documents, by a hash of the id. Only the order depends on the sample."""
    rows = bounded_sample(docs.select(id_col, text_col), sample, F.col(id_col), F.col(text_col)).select(text_col).collect()
    return ordered(measure([r[0] for r in rows], rules))


def quality_rules(
    docs: DataFrame,
    rules: list[Rule],
    id_col: str = "doc_id",
    text_col: str = "text",
    counts: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, the asked ``counts``, ``kept``, ``rejected_by`` (first rejecting rule, null if kept), ``n_rules``.

    Null and empty texts have all counts 0. Repeated rows and equal ids give a row each; other columns are not read.
    """
    asked = "".join(f", {c} long" for c in counts)

    def make():
        of = counter()

        def step(ids, texts):
            out = {"id": ids, "kept": [], "rejected_by": [], "n_rules": []} | {c: [] for c in counts}
            for text in texts:
                c, by, tried = of(text), None, 0
                for rule in rules:
                    tried += 1
                    if rule.test(c):
                        by = rule.name
                        break
                out["kept"].append(by is None)
                out["rejected_by"].append(by)
                out["n_rules"].append(tried)
                for name in counts:
                    out[name].append(getattr(c, name))
            return out

        return step

    found = map_batches(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
        ["id", "text"],
        make,
        f"id long{asked}, kept boolean, rejected_by string, n_rules int",
    )
    return found.withColumnRenamed("id", id_col)


def op10_rules(docs: DataFrame) -> DataFrame:
    """The contract's columns: base counts of every document, ``base_failed``, and the cascade's verdict."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = quality_rules(docs, plan_cascade(docs), counts=counts)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", *counts, failed.alias("base_failed"), "kept")


#: The same verdict without any order: which rule rejects first depends on measured costs, whether one does not.
OP10_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
b AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         length(regexp_replace(text, '[^\\pL]', '', 'g')) AS n_letters,
         length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_capitals
  FROM w),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
c AS (
  SELECT DISTINCT doc_id, i + o AS pos
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g), (SELECT unnest(range(0, 5)) AS o)
  WHERE n > 1),
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM c GROUP BY 1),
s AS (SELECT b.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM b LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * n_letters < 60 * word_chars OR 100 * n_capitals > 60 * n_letters) AS kept
FROM f
"""
