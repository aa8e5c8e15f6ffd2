"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

A CGK walk turns a word sequence into a longer one: at step j it writes the word it stands on and moves on by a random
bit of (j, word). Two sequences at a small edit distance fall into step again after each edit, so their walks agree in
most places: edit distance becomes Hamming distance. Bit-sampling LSH then hashes a few sampled places of the walk, and
repeats that with independent walks.

Windows start at anchors: words whose hash is the least among their neighbours. Which words are anchors depends on the
words around only, so a copied passage has the anchors of its item, wherever it stands, and a walk from an anchor needs
no window at every word. From an anchor, walks of several lengths (size classes) are sampled: an item uses at each of its
anchors the longest class that still lies within what is left of it, so the hashed window is as long as the item.

The number of walks follows from RECALL at the largest distance, with the chance that an anchor is unedited, for items of
``ANCHORS`` anchors. Shorter items have too few, so their unedited pieces stand in: with e edits allowed, one of e + 1 pieces
of an item is unchanged, and the run of words at its beginning is looked up at every word. ``complete`` gives every item
its pieces, so that no stretch within ``max_distance`` is missed.

Items may share beginnings (prompts). A hash that more than ``SHARED`` items have proposes only those of which ``WITNESSES``
rare words are near: of any e + 3 words of an item three are unedited, and each item brings the e + 3 that fewest of the
group have.

Windows that share a hash with an item are verified: the item is aligned with the words around the window, and the edit
distance (insertions, deletions and changes of words; free ends in the document) must be at most ``max_distance`` of the
item's words. Items are the stated query set: they go to the tasks
in blocks of ``BLOCK_ITEMS`` items, so what is broadcast is bounded; documents are read once per block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, distinct_words, mix, slices, spans, split_words

#: Items a task holds at once; an item has a few dozen hashes, so a block stays below some 50 MB.
BLOCK_ITEMS = 20_000
#: Texts whose walks are made at once, so few that their arrays stay in a core's cache.
AT_ONCE = 100
#: Words on either side of an anchor, none of which has a smaller hash: a third of all words are anchors.
REACH = 1
#: Anchors from which on an item comes through its walks alone (some 28 words).
ANCHORS = 7
#: Items of one hash up to which all are proposed.
SHARED = 16
#: Unedited rare words that an item of a more frequent hash must show.
WITNESSES = 3
#: Places sampled for a hash, and the walk lengths (in words) of the size classes.
SAMPLES = 3
CLASSES = (6, 12, 24, 48)
#: Items are found up to this share of edited words; the walks' repeats are set for RECALL at DESIGN_DISTANCE.
MAX_DISTANCE = 0.2
DESIGN_DISTANCE = MAX_DISTANCE
RECALL = 0.9
#: Longest run of words that stands for a piece of an item; one in five edited leaves pieces of three or four words.
PIECE = 4

_PUNCTUATION = ".,;:!?\"'()[]{}<>#*$%&|"


class NormalHashes(dict):
    """Hash of a word in lower case without punctuation at its ends; 0 if nothing is left. Remembered up to a bound."""

    def of_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The hashes of each text's words, without zeros; a word is looked up once for all texts."""
        if len(self) >= 1_000_000:
            self.clear()
        words, counts = split_words(texts)
        listed, place = distinct_words(words)
        new = [w for w in listed if w not in self]
        cores = [w.lower().strip(_PUNCTUATION) for w in new]
        self.update(zip(new, [(xxhash.xxh3_64_intdigest(c) >> 1) + 1 if c else 0 for c in cores]))
        h = np.fromiter(map(self.__getitem__, listed), np.uint64, len(listed))[place]
        left = h > 0
        ends = np.concatenate([[0], np.cumsum(left)])[np.cumsum(counts)]
        return np.split(h[left], ends[:-1]) if texts else []

    def of(self, text: str | None) -> np.ndarray:
        return self.of_all([text])[0]


def repeats_for(recall: float, distance: float, samples: int = SAMPLES, n_anchors: int = ANCHORS) -> int:
    """Walks needed for an item of so many anchors to be met with the given chance, if this share of its words is edited.

    An anchor survives if no word within REACH of it is edited. An edit puts a walk out of step for a few places and costs
    it about two of them on average, so a sampled place agrees with chance 1 - 2 * distance.
    """
    survives = (1 - distance) ** (2 * REACH + 1)
    agree = max(0.05, 1 - 2 * distance) ** samples
    wanted = 1 - (1 - recall) ** (1 / n_anchors)
    if wanted >= survives:
        raise ValueError(f"{n_anchors} anchors cannot reach a recall of {recall} at {distance}")
    return max(1, math.ceil(math.log(1 - wanted / survives) / math.log(1 - agree)))


def anchors(h: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Places whose hash is the least of all within ``reach`` words; the first of equal ones."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.int64)
    best = np.ones(n, bool)
    for k in range(1, min(reach, n - 1) + 1):
        best[k:] &= h[k:] < h[:-k]
        best[:-k] &= h[:-k] <= h[k:]
    return np.flatnonzero(best)


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each word and the size - 1 next ones."""
    out = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for k in range(size):
        out = mix(out + h[k : k + len(out)])
    return out


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each closed by REACH paddings, and where each ends (behind its paddings)."""
    pad = np.full(REACH, 2**64 - 1, np.uint64)
    h = np.concatenate([np.empty(0, np.uint64), *(x for t in texts for x in (t, pad))])
    return h, np.cumsum([len(t) + REACH for t in texts], dtype=np.int64)


class Walks:
    """Sampled places of independent walks, and the hashes made of them."""

    def __init__(self, repeats: int, classes: tuple[int, ...] = CLASSES, samples: int = SAMPLES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.repeats, self.classes = repeats, classes
        self.salts = rng.integers(1, 2**63, repeats, dtype=np.uint64)
        # a walk of s steps stands on word s / 2 on average; the margin keeps nearly all walks inside the window
        self.steps = [int(1.6 * c) for c in classes]
        # one place from each stretch of the walk: neighbouring places often stand on one word
        edges = [np.linspace(0, s, samples + 1).astype(int) for s in self.steps]
        self.places = [[[int(rng.integers(a, b)) for a, b in zip(e[:-1], e[1:])] for e in edges] for _ in range(repeats)]

    def hashes(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, wanted: set[int] | None = None):
        """(class, indices into starts, hashes) of all walks from starts that have room for the class before their ends.

        With ``wanted`` only of these classes; a walk ends at the last place that one of them samples.
        """
        wanted = set(range(len(self.classes))) if wanted is None else wanted
        room = ends - starts
        for r, salt in enumerate(self.salts):
            coin = mix(h ^ salt)
            live, at, last = np.arange(len(starts)), starts.copy(), ends - 1
            sums = [np.zeros(len(starts), np.uint64) for _ in self.classes]
            step = 0
            for c, size in enumerate(self.classes):
                inside = room[live] >= size
                live, at, last = live[inside], at[inside], last[inside]
                sums = [s[inside] if k >= c else s for k, s in enumerate(sums)]
                if not len(live) or c > max(wanted, default=-1):
                    break
                end = self.places[r][c][-1] + 1 if c == max(wanted) else self.steps[c]
                while step < end:
                    for k in range(c, len(self.classes)):
                        if k in wanted and step in self.places[r][k]:
                            sums[k] = mix(sums[k] + np.take(h, at))
                    # 64 fair bits of each word; later steps read them again, turned by the salt
                    if step and step % 64 == 0:
                        coin = mix(coin + salt)
                    bit = np.take(coin, at)
                    bit >>= np.uint64(step % 64)
                    bit &= np.uint64(1)
                    at += bit.view(np.int64)
                    np.minimum(at, last, out=at)
                    step += 1
                if c not in wanted:
                    continue
                tag = np.uint64((r * len(self.classes) + c + 1) * 0x9E3779B97F4A7C15 % 2**64)
                yield c, live, mix(sums[c] ^ tag)


def edit_end(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the window, and the end of the leftmost such stretch."""
    row = np.zeros(len(window) + 1, np.int64)
    along = np.arange(len(window) + 1)
    for i, word in enumerate(item.tolist(), 1):
        turn = np.empty_like(row)
        turn[0] = i
        turn[1:] = np.minimum(row[1:] + 1, row[:-1] + (window != word))
        # insertions run along the row: the least of turn[j'] + (j - j')
        row = np.minimum.accumulate(turn - along) + along
    end = int(row.argmin())
    return int(row[end]), end


def best_stretch(item: np.ndarray, h: np.ndarray, low: int, high: int, limit: int | None = None) -> tuple[int, int, int] | None:
    """(distance, start, end) of the stretch of h[low:high] nearest to the item; None beyond the limit."""
    window = h[low:high]
    limit = len(item) if limit is None else limit
    # an edit touches one word of the item at most, so all others must be there
    there = set(window.tolist())
    if sum(map(there.__contains__, item.tolist())) < len(item) - limit:
        return None
    distance, end = edit_end(item, window)
    if distance > limit:
        return None
    _, back = edit_end(item[::-1], window[:end][::-1])
    return distance, low + end - back, low + end


class Items:
    """The hashes of a block of items, for looking up those of windows."""

    def __init__(self, items: list[tuple[object, str | None]], walks: Walks, max_distance: float = MAX_DISTANCE, complete: bool = True):
        hashes = NormalHashes()
        self.ids, self.walks = [i for i, _ in items], walks
        self.words = hashes.of_all([text for _, text in items])
        self.lens = np.array([len(h) for h in self.words], np.int64)
        self.limits = np.array([math.floor(max_distance * len(h)) for h in self.words], np.int64)
        # all items one after another, so that each step works on every one of them
        h, ends = joined(self.words)
        begins = ends - REACH - self.lens
        starts = anchors(h)
        owner = np.searchsorted(ends, starts, "right")
        room = ends[owner] - REACH - starts
        starts, owner, room = (x[room > 0] for x in (starts, owner, room))
        useful = owner[(starts - begins[owner] >= REACH) & (room >= walks.classes[0])]
        with_pieces = (self.lens > 0) & (complete | (np.bincount(useful, minlength=len(items)) < ANCHORS))
        # with e edits one of e + 1 pieces is unchanged, so a run from each piece stands for it
        pieces = np.where(with_pieces, self.limits + 1, 0)
        sizes = np.minimum(PIECE, self.lens // (self.limits + 1))
        self.run_sizes = set(sizes[with_pieces].tolist())
        found = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
        # texts are walked for the classes that items use
        self.used: set[int] = set()
        for size in self.run_sizes:
            k = np.flatnonzero(with_pieces & (sizes == size))
            of = np.repeat(k, pieces[k])
            at = spans(np.zeros(len(k), np.int64), pieces[k]) * (self.lens[of] // pieces[of])
            found.append((runs(h, size)[begins[of] + at], of, at))
        fitting = np.searchsorted(walks.classes, room, "right") - 1
        for c, live, keys in walks.hashes(h, starts, starts + room):
            own = fitting[live] == c
            self.used |= {c} if own.any() else set()
            found.append((keys[own], owner[live[own]], (starts - begins[owner])[live[own]]))
        keys, owners, offsets = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners, self.offsets = keys[order], owners[order], offsets[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.groups: dict[int, tuple] = {}

    def _rare(self, a: int, n: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Rare words of the items behind the entries a .. a + n - 1, sorted; the entry of each; words they reach back and on.

        An item has as many of them as edits and ``WITNESSES`` together, a repeated word counted each time.
        """
        if a not in self.groups:
            owners, offsets = self.owners[a : a + n], self.offsets[a : a + n]
            members, entry_of = np.unique(owners, return_inverse=True)
            item = np.repeat(np.arange(len(members)), self.lens[members])
            word = np.concatenate([self.words[k] for k in members])
            once = np.unique(np.stack([word, item.astype(np.uint64)]), axis=1)[0]
            names, counts = np.unique(once, return_counts=True)
            order = np.lexsort((word, counts[np.searchsorted(names, word)], item))
            word, item = word[order], item[order]
            place = np.arange(len(item)) - np.searchsorted(item, item, "left")
            rare = place < self.limits[members][item] + WITNESSES
            word, item = word[rare], item[rare]
            # an item may stand behind several entries
            by_item = np.argsort(entry_of, kind="stable")
            first = np.searchsorted(entry_of[by_item], item, "left")
            many = np.searchsorted(entry_of[by_item], item, "right") - first
            word, entry = np.repeat(word, many), a + by_item[spans(first, many)]
            order = np.argsort(word, kind="stable")
            back = int((offsets + self.limits[owners]).max())
            on = int((self.lens[owners] - offsets + self.limits[owners]).max())
            self.groups[a] = word[order], entry[order], back, on
        return self.groups[a]

    def candidates(self, h: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """Texts are h[.. ends[0]], h[ends[0] ..] and so on, each closed by REACH paddings. (text, item): places in h."""
        out: dict[tuple[int, int], set[int]] = {}
        starts = anchors(h)
        text = np.searchsorted(ends, starts, "right")
        places, owners, sources = [], [], []

        def propose(entries, begin, of_text):
            owners.append(self.owners[entries])
            places.append(begin - self.offsets[entries])
            sources.append(of_text)

        def look_up(keys, begin, of_text):
            hit = np.flatnonzero(self.seen[(keys & np.uint64(0xFFFFF)).astype(np.int64)])
            a = np.searchsorted(self.keys, keys[hit], "left")
            n = np.searchsorted(self.keys, keys[hit], "right") - a
            few = n <= SHARED
            propose(spans(a[few], n[few]), np.repeat(begin[hit[few]], n[few]), np.repeat(of_text[hit[few]], n[few]))
            for i in np.flatnonzero(~few).tolist():
                p, t = int(begin[hit[i]]), int(of_text[hit[i]])
                word, entry, back, on = self._rare(int(a[i]), int(n[i]))
                low, high = int(ends[t - 1]) if t else 0, int(ends[t]) - REACH
                near = np.unique(h[max(low, p - back) : min(high, p + on)])
                x = np.searchsorted(word, near, "left")
                entries, shown = np.unique(entry[spans(x, np.searchsorted(word, near, "right") - x)], return_counts=True)
                k = self.owners[entries]
                entries = entries[shown >= np.minimum(WITNESSES, self.lens[k] - self.limits[k])]
                propose(entries, np.full(len(entries), p), np.full(len(entries), t))

        for _, live, keys in self.walks.hashes(h, starts, ends[text] - REACH, self.used):
            look_up(keys, starts[live], text[live])
        for size in sorted(self.run_sizes):
            keys = runs(h, size)
            every = np.arange(len(keys))
            look_up(keys, every, np.searchsorted(ends, every, "right"))
        if not owners:
            return out
        for t, k, at in set(zip(*(np.concatenate(x).tolist() for x in (sources, owners, places)))):
            out.setdefault((t, k), set()).add(at)
        return out

    def matches(self, texts: list[np.ndarray], max_distance: float) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) of the nearest verified stretch of each item in each text."""
        if len(texts) > AT_ONCE:
            parts = ((i, self.matches(texts[i : i + AT_ONCE], max_distance)) for i in range(0, len(texts), AT_ONCE))
            return [(i + t, *rest) for i, part in parts for t, *rest in part]
        h, ends = joined(texts)
        out = []
        for (t, k), places in sorted(self.candidates(h, ends).items()):
            low, high = int(ends[t]) - len(texts[t]) - REACH, int(ends[t]) - REACH
            found = self._nearest(h, low, high, self.words[k], sorted(places), math.floor(max_distance * len(self.words[k])))
            if found:
                out.append((t, k, found[0], found[1] - low, found[2] - low))
        return out

    @staticmethod
    def _nearest(h, low, high, item, places, limit):
        first, end = (item[0], len(item) - 1) if len(item) else (None, 0)
        for at in places:
            if low <= at and at + end < high and h[at] == first and (h[at : at + len(item)] == item).all():
                return 0, at, at + len(item)
        best, reached = (limit + 1, 0, 0), low
        for at in places:
            a, b = max(low, at - limit), min(high, at + len(item) + limit)
            if b > max(a, reached):
                best = min(best, best_stretch(item, h, a, b, limit) or best)
                reached = b
        return best if best[0] <= limit else None


def _held(spark: SparkSession, items: DataFrame, item_col: str, text_col: str):
    """The items as broadcast blocks of bounded size."""
    query = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    n = max(1, -(-query.count() // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [spark.sparkContext.broadcast(sorted(map(tuple, query.filter(block == b).collect()), key=str)) for b in range(n)]


def _finder(held, walks: Walks, max_distance: float, complete: bool):
    """A function that finds the items of a block in texts, made once in a task."""
    hashes, index = NormalHashes(), Items(held.value, walks, max_distance, complete)

    def find(texts):
        for t, k, distance, a, b in index.matches(hashes.of_all(texts), max_distance) if texts else []:
            yield t, index.ids[k], len(index.words[k]), distance, a, b

    return find


def benchmark_hits(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    max_distance: float = MAX_DISTANCE,
    repeats: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    complete: bool = False,
) -> DataFrame:
    """(id, item, n_item_words, distance, start_word, end_word): benchmark items found in documents.

    Words are compared in lower case without punctuation at their ends; start_word and end_word count such words. A row
    for each document and item: its nearest stretch. Stretches at ``max_distance`` are met with a chance of RECALL at least;
    ``complete`` meets all, for more look-ups. Items and texts that are null, empty or without a word match nothing;
    repeated rows and equal ids give rows each; other columns are not read. Empty tables give no row.
    """
    walks = Walks(repeats or repeats_for(RECALL, DESIGN_DISTANCE))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item long, n_item_words int, distance int, start_word int, end_word int"
    arrow = arrow_schema(schema)
    out = None
    for held in _held(spark, items, item_col, item_text_col):

        def run(batches, held=held):
            find = None
            for piece in slices(batches):
                find = find or _finder(held, walks, max_distance, complete)
                ids = piece.column(0).to_pylist()
                found = [(ids[t], *rest) for t, *rest in find(piece.column(1).to_pylist())]
                columns = list(zip(*found)) or [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def without_benchmark(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    max_distance: float = MAX_DISTANCE,
    repeats: int | None = None,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    complete: bool = False,
) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item. All columns are kept, also of rows with a null text or id."""
    walks = Walks(repeats or repeats_for(RECALL, DESIGN_DISTANCE))
    for held in _held(spark, items, item_col, item_text_col):
        docs = docs.filter(_is_clean(held, walks, max_distance, complete)(F.col(text_col)))
    return docs


def _is_clean(held, walks: Walks, max_distance: float, complete: bool):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _finder(held, walks, max_distance, complete)
        for texts in batches:
            out = np.ones(len(texts), bool)
            for i in range(0, len(texts), 500):
                out[[i + t for t, *_ in find(texts.iloc[i : i + 500].tolist())]] = False
            yield pd.Series(out)

    return clean


def op2_decontamination(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every document that holds a benchmark item, with the item, the distance and the place."""
    return benchmark_hits(spark, docs, items)
