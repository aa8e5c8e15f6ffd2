"""Spelling variants: words one edit apart, each led to a much more frequent one.

Search by dynamic programming over sorted lists. For a word, the sorted list is scanned once; the edit matrix against it is
kept as its three cells around the diagonal, one row for each letter of the current list word, and rows of the letters that
the next list word shares with it are used again. Where all three cells exceed one edit, every list word with that prefix
is skipped. Suffixes are lists of reversed words.

The vocabulary is dealt into lists by pigeonhole: of two words one edit apart, the longer of length m, either the first
half is the same or the rest is. So a word stands, for its own length and for the next one (as the shorter word), in the
list of its first half and in that of its last. A list beyond ``LIST`` words is dealt again by halves of what its words do
not share yet, until one letter is left; words are distinct, so the lists end up bounded, and none is cut. A pair is
counted where it meets first: in a list by suffixes only if the halves that the prefix list stands for differ.

Each word of a list yields one row, the number of near words there and the most frequent of them, never its pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored

#: Runs of letters, as they stand in texts.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Words need so many code points and occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is at least so many times as frequent as its variant.
RATIO = 10
#: One run in so many loses a letter.
DROP = 31
#: Words of a list that one task scans; longer lists are dealt again.
LIST = 2000
#: Distinct words a task counts before it hands them on.
HELD = 300_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FIND = re.compile("[a-zÀ-ÿ]+").findall


# ---- words ----------------------------------------------------------------------------------------


def words_of(doc_id, text: str) -> Counter:
    """The words of one text with their counts: lower-cased runs, some of them without a letter.

    A null id stands as empty text in the checksum that picks letters to drop.
    """
    found: Counter = Counter()
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_FIND(text.encode().translate(_LOWER).decode())).items():
        size = len(run)
        if size >= LEAST_LENGTH:
            h = zlib.crc32(run.encode(), prefix)
            if h % DROP == 0:
                at = h % size
                run = run[:at] + run[at + 1 :]
                if size == LEAST_LENGTH:
                    continue
            found[run] += n
    return found


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of all words of LEAST_LENGTH or more code points and LEAST_COUNT or more occurrences; counted map-side first."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for piece in slices(batches, 200):
            for doc_id, text in zip(*(c.to_pylist() for c in piece.columns)):
                if text:
                    held.update(words_of(doc_id, text))
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    parts = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- one list -------------------------------------------------------------------------------------


class SortedList:
    """Words in code-point order with the prefixes neighbours share, for scans that skip."""

    def __init__(self, words: list[str]):
        self.words, n = words, len(words)
        self.shared = shared = [0] * (n + 1)
        for i in range(1, n):
            a, b = words[i - 1], words[i]
            k, most = 0, min(len(a), len(b))
            while k < most and a[k] == b[k]:
                k += 1
            shared[i] = k
        shared[n] = -1
        # the next place that shares less with its neighbour
        self.less = less = [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            k = i + 1
            while shared[k] >= shared[i]:
                k = less[k]
            less[i] = k

    def within_one(self, query: str, common: int = 0) -> list[int]:
        """Places of the words exactly one insertion, deletion or replacement from ``query``; all share ``common`` first letters."""
        words, shared, less = self.words, self.shared, self.less
        size = len(query)
        q = query + "\0\0"
        # cells (i, i - 1), (i, i) and (i, i + 1) of the edit matrix after i letters of the list word
        rows = [(1, 0, 1)] * (common + 1)
        out, at, n, keep = [], 0, len(words), common
        while at < n:
            word = words[at]
            length = len(word)
            a, b, c = rows[keep]
            i = keep
            alive = True
            while i < length:
                x = word[i]
                if i > size:
                    low = 2
                else:
                    low = min(b + 1, a + (x != q[i - 1])) if i else b + 1
                mid = min(b + (x != q[i]), c + 1, low + 1) if i < size else 2
                high = min(c + (x != q[i + 1]), mid + 1) if i + 1 < size else 2
                a, b, c = low, mid, high
                i += 1
                if i == len(rows):
                    rows.append((a, b, c))
                else:
                    rows[i] = (a, b, c)
                if a > 1 and b > 1 and c > 1:
                    alive = False
                    break
            if alive:
                gap = size - length
                if (gap == 0 and b == 1) or (gap == -1 and a == 1) or (gap == 1 and c == 1):
                    out.append(at)
                at += 1
                keep = shared[at]
            else:
                # every word that begins with these i letters is more than one edit away
                at += 1
                while shared[at] >= i:
                    at = less[at]
                keep = shared[at]
        return out


def near_in_list(entries: list[tuple[str, int]], m: int, lo: int, tail: int, avoid: list[int]) -> list[tuple[str, int, int, str]]:
    """(word, near words here, n and word of the most frequent) for the words of a list that have any.

    Words have m or m - 1 code points and share their first ``lo`` and last ``tail``. Only those with m look for others;
    two shorter ones meet in a list of their own length. Pairs that share a prefix of a length in ``avoid`` meet elsewhere.
    """
    backwards = tail > lo
    key = (lambda w: w[::-1]) if backwards else (lambda w: w)
    order = sorted((key(w), n) for w, n in entries)
    listed = SortedList([w for w, _ in order])
    plain = [key(w) for w in listed.words]
    common, found = max(lo, tail), {}

    def meet(at: int, other: int) -> None:
        count, best = found.get(at, (0, None))
        seen = -order[other][1], plain[other]
        found[at] = count + 1, seen if best is None else min(best, seen)

    for at, word in enumerate(listed.words):
        if len(word) < m:
            continue
        for other in listed.within_one(word, common):
            if any(plain[at][:edge] == plain[other][:edge] for edge in avoid):
                continue
            meet(at, other)
            if len(plain[other]) < m:
                meet(other, at)
    return [(plain[at], count, -best[0], best[1]) for at, (count, best) in found.items()]


# ---- lists of the vocabulary ----------------------------------------------------------------------


def _halves(d: DataFrame) -> DataFrame:
    """Each row in the two lists that halve what its list does not share yet; ``avoid`` notes the prefix of the other half."""
    rest = F.col("m") - F.col("lo") - F.col("tail")
    first = F.col("lo") + F.floor(rest / 2).cast("int")
    last = F.col("m") - first
    by_first = F.struct(first.alias("lo"), F.col("tail"), F.col("avoid"))
    by_last = F.struct(F.col("lo"), last.alias("tail"), F.array_append("avoid", first).alias("avoid"))
    d = d.withColumn("way", F.explode(F.array(by_first, by_last)))
    return _keyed(d.select("word", "n", "m", "way.lo", "way.tail", "way.avoid"))


def _keyed(d: DataFrame) -> DataFrame:
    first = F.expr("substring(word, 1, lo)")
    last = F.when(F.col("tail") > 0, F.expr("substring(word, -tail, tail)")).otherwise("")
    return d.select("word", "n", "m", "lo", "tail", "avoid", first.alias("first"), last.alias("last"))


KEY = ["m", "lo", "tail", "avoid", "first", "last"]


def lists(spark: SparkSession, words: DataFrame, most: int = LIST) -> DataFrame:
    """Lists (KEY, entries) in which every pair of near words meets, longer than ``most`` only if their words share all but one letter.

    Rows of lists that are too long join with their keys salted, so a list that holds a third of all rows is no single task.
    """
    size = F.length("word")
    start = words.withColumn("m", F.explode(F.array(size, size + 1)))
    start = start.select("word", "n", "m", F.lit(0).alias("lo"), F.lit(0).alias("tail"), F.array().cast("array<int>").alias("avoid"))
    rows, done = _halves(start), None
    salts = 32
    while True:
        rows = stored(spark, rows, "lists")
        sizes = rows.groupBy(*KEY).agg(F.count("*").alias("size"))
        long = sizes.where((F.col("size") > most) & (F.col("m") - F.col("lo") - F.col("tail") > 1)).select(*KEY)
        long = stored(spark, long, "long")
        if long.isEmpty():
            part, rows = rows, None
        else:
            salted = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(salts)).cast("int"))
            spread = long.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            part = salted.join(spread, [*KEY, "salt"], "left_anti").drop("salt")
            rows = _halves(salted.join(spread, [*KEY, "salt"], "left_semi").drop("salt"))
        found = part.groupBy(*KEY).agg(F.collect_list(F.struct("word", "n")).alias("entries")).where(F.size("entries") > 1)
        done = found if done is None else done.unionByName(found)
        if rows is None:
            return done


def near_words(spark: SparkSession, words: DataFrame, most: int = LIST) -> DataFrame:
    """word, n_near, best (its most frequent near word; ties: the smallest), best_n for all words that have a near one."""
    found = lists(spark, words, most).select("m", "lo", "tail", "avoid", "entries")

    def run(batches):
        for piece in slices(batches, 200):
            out = []
            *keys, entries = (c.to_pylist() for c in piece.columns)
            for entry, *key in zip(entries, *keys):
                out += near_in_list([(e["word"], e["n"]) for e in entry], *key)
            if out:
                word, count, n, best = zip(*out)
                yield pa.RecordBatch.from_pydict({"word": word, "n_near": pa.array(count, pa.int64()), "best_n": pa.array(n, pa.int64()), "best": best})

    # lists differ in length: deal them anew, so that long ones do not meet in a task
    dealt = found.repartition(F.xxhash64("entries")).mapInArrow(run, "word string, n_near long, best_n long, best string")
    top: Column = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    each = dealt.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top"))
    return each.select("word", "n_near", F.col("top.word").alias("best"), (-F.col("top.n")).alias("best_n"))


def with_roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """Adds root: from the word, forms are followed to the last. Each round doubles the distance.

    Counts grow by RATIO with every form, so the ways end; 64-bit counts allow 19 forms, five rounds.
    """
    rows = stored(spark, forms.withColumn("root", F.coalesce("form", "word")), "forms")
    while True:
        ahead = rows.where(F.col("root") != F.col("word")).select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = rows.join(ahead, "root", "left").withColumn("root", F.coalesce("_next", "root"))
        moved = stored(spark, moved.select(*rows.columns, F.col("_next").isNotNull().alias("_moved")), "roots")
        rows = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return rows


def spelling_variants(spark: SparkSession, docs: DataFrame, ratio: int = RATIO, most: int = LIST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus.

    Null and empty texts have no words, a table without words gives no row. Rows count as they stand, also repeated ones.
    A null id stands as empty text in the checksum of a run. Other columns are not looked at.
    """
    words = stored(spark, vocabulary(docs, id_col, text_col), "words")
    near = near_words(spark, words, most)
    joined = words.join(near, "word", "left")
    takes = F.col("best_n") >= ratio * F.col("n")
    forms = joined.select(
        "word",
        F.when(takes, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best_n")).alias("form_n"),
    )
    return with_roots(spark, forms).select("word", "form", "root", "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's word table of ``documents``."""
    return spelling_variants(spark, docs)
