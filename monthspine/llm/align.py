"""Tokens of two vocabularies aligned by the bytes they stand for.

Both tokenizers cut the same bytes, a space and the text. Where a token of A and one of B end at the same byte, a group
ends; tokens whose byte ranges overlap are linked. A block of documents is aligned in Arrow: the id lists are flattened
with their parent indices, byte lengths are summed up within each document, and an Acero hash join on (document, end)
tells the ends that only A, only B or both have. Every such end closes one link: the intersection of the A and the B token
that cover it, since two overlapping ranges share exactly one stretch without an end inside.

Partial link counts of a block come from ``Table.group_by``; Spark merges them and sends a block the totals of the pairs
it has, no others, so no task holds the counts of the corpus. A second Acero join in the block brings them to the links.
Blocks are stored between the two passes: texts are encoded once.

Encoding remembers chunks. Both vocabularies always break where a space follows another character that is no white space:
byte-level splitting starts a new word there, and no piece of B holds a space behind another character (checked when the
model is loaded; otherwise whole texts are encoded). Tests hold this against whole texts.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, spans, stored
from .tokens import _Places

#: Bytes of text a block holds at least, unless the input of its task ends; a single longer document is a block.
BLOCK_BYTES = 3 << 19
#: Chunks are remembered up to this many, and this many characters of them.
CHUNKS, CHARACTERS = 300_000, 16 << 20
#: New chunks are encoded so many at a time.
AT_ONCE = 4096
#: Stands for the space in pieces of B.
MARK = "▁"

_CUT = re.compile(r"(?<=\S)(?= )")
_LOOSE = re.compile(r"\s ")


def letter_bytes() -> dict[str, int]:
    """The byte that each printable letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """A byte-level vocabulary: ids of strings, special tokens being plain text, and the bytes of an id."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        letters = letter_bytes()
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens:
    """A piece vocabulary that puts a space before a text and falls back to bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]
        self.breaks_at_spaces = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.space = pieces.index(MARK)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text; of a lone space for an empty one."""
        return [ids or [self.space] for ids in self.model.encode(texts, num_threads=1)]


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of binary values one after another, and where each begins and ends."""
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def _gives_back(ids: pa.ListArray, of: pa.Array, spelt: pa.Array) -> np.ndarray:
    """Whether the bytes of each id list, joined, are the text spelt there."""
    data, each = _letters(of.take(ids.flatten()))
    ends = each[ids.offsets.to_numpy()]
    want, edges = _letters(spelt)
    if np.array_equal(ends, edges):
        good = np.ones(len(ids), bool)
        good[np.searchsorted(edges, np.flatnonzero(data != want), "right") - 1] = False
        return good
    pairs = zip(ends[:-1], ends[1:], edges[:-1], edges[1:])
    return np.array([np.array_equal(data[s:e], want[u:v]) for s, e, u, v in pairs], bool)


class Encoders:
    """Ids of both vocabularies for whole texts, with a bounded memory of chunks."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.bytes = [pa.array(v.bytes, pa.binary()) for v in (self.a, self.b)]
        self.sizes = [pc.cast(pc.binary_length(v), pa.int64()) for v in self.bytes]
        self._reset()

    def _reset(self) -> None:
        self.place, self.held = _Places(), 0
        self.starts = [np.empty(0, np.int64)] * 2
        self.lens = [np.empty(0, np.int64)] * 2
        self.flat = [np.empty(0, np.int32)] * 2
        self.good = np.empty(0, bool)

    def chunks(self, text: str) -> list[str]:
        """The text's chunks without the space that each begins with; their encodings make up the text's."""
        spaced = " " + text
        if not self.b.breaks_at_spaces:
            return [text]
        if _LOOSE.search(spaced) or spaced.endswith(" "):
            return [c[1:] for c in _CUT.split(spaced)]
        return spaced.split(" ")[1:]

    def _learn(self) -> None:
        new = self.place.new
        kept = [[self.starts[k], self.lens[k], self.flat[k]] for k in range(2)]
        known, good = [len(self.flat[0]), len(self.flat[1])], [self.good]
        grown = [[[], []], [[], []]]
        for i in range(0, len(new), AT_ONCE):
            part = new[i : i + AT_ONCE]
            spelt = pa.array([" " + c for c in part]).cast(pa.binary())
            same = pc.invert(pc.match_substring(pa.array(part, pa.string()), MARK)).to_numpy(zero_copy_only=False)
            for k, ids in enumerate((self.a.encode([" " + c for c in part]), self.b.encode(part))):
                ids = pa.array(ids, pa.list_(pa.int32()))
                same &= _gives_back(ids, self.bytes[k], spelt)
                grown[k][0].append(np.diff(ids.offsets.to_numpy()).astype(np.int64))
                grown[k][1].append(ids.flatten().to_numpy())
            good.append(same)
        for k in range(2):
            lens = np.concatenate(grown[k][0])
            self.starts[k] = np.concatenate([kept[k][0], known[k] + np.cumsum(lens) - lens])
            self.lens[k] = np.concatenate([kept[k][1], lens])
            self.flat[k] = np.concatenate([kept[k][2], *grown[k][1]])
        self.good = np.concatenate(good)
        self.held += sum(map(len, new))
        new.clear()

    def encode(self, texts: list[str | None]) -> tuple[pa.ListArray, pa.ListArray]:
        """Id lists of both vocabularies; empty ones for a text without tokens."""
        if len(self.place) > CHUNKS or self.held > CHARACTERS:
            self._reset()
        split = [self.chunks(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.array(list(map(self.place.__getitem__, chain.from_iterable(split))), np.int64)
        if self.place.new:
            self._learn()
        edges = np.concatenate([[0], np.cumsum(counts)])
        bad = np.concatenate([[0], np.cumsum(~self.good[at])])
        whole = np.diff(bad[edges]) == 0
        at, counts = at[np.repeat(whole, counts)], np.where(whole, counts, 0)
        edges = np.concatenate([[0], np.cumsum(counts)])
        out = []
        for k in range(2):
            lens = self.lens[k][at]
            ends = np.concatenate([[0], np.cumsum(lens)])[edges]
            ids = self.flat[k][spans(self.starts[k][at], lens)]
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
        return out[0], out[1]


def _ends(ids: pa.ListArray, sizes: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Flat ids, their documents, and (document, end) keys: cumulative sums of the byte lengths within each document."""
    flat, parents = pc.list_flatten(ids), pc.cast(pc.list_parent_indices(ids), pa.int64())
    ends = pc.cumulative_sum(sizes.take(flat))
    starts = ids.offsets.slice(0, len(ids))
    before = pc.subtract(ends, sizes.take(flat))
    first = before.take(pc.if_else(pc.less(starts, len(flat)), starts, 0)) if len(flat) else pa.array([0] * len(ids), pa.int64())
    within = pc.subtract(ends, first.take(parents))
    return flat, parents, pc.add(pc.shift_left(parents, 40), within)


@functools.cache
def _labels(n: int, middle: str, last: str) -> pa.Array:
    """Texts of the ids below n: id i inside a group at 2 i, at its end at 2 i + 1."""
    return pa.array([f"{i}{s}".encode() for i in range(n) for s in (middle, last)], pa.binary())


def group_digests(a: pa.Array, b: pa.Array, key_a: np.ndarray, key_b: np.ndarray, closing: np.ndarray, docs: int) -> list[str]:
    """SHA-256 of each document's groups as text; '' without tokens. ``closing`` are the sorted ends that both have."""
    group_a, group_b = np.searchsorted(closing, key_a), np.searchsorted(closing, key_b)
    b_before = np.concatenate([[0], np.searchsorted(key_b, closing, "right")])
    a_through = np.searchsorted(key_a, closing, "right")
    order = np.empty(len(a) + len(b), np.int64)
    n_a = int(pc.max(a).as_py() or 0) + 1 if len(a) else 1
    n_b = int(pc.max(b).as_py() or 0) + 1 if len(b) else 1
    label_a, label_b = _labels(1 << n_a.bit_length(), ",", "|"), _labels(1 << n_b.bit_length(), ",", ";")
    order[np.arange(len(a)) + b_before[group_a]] = 2 * a.to_numpy().astype(np.int64) + (closing[group_a] == key_a)
    order[np.arange(len(b)) + a_through[group_b]] = 2 * b.to_numpy().astype(np.int64) + (closing[group_b] == key_b) + len(label_a)
    labels = pa.concat_arrays([label_a, label_b])
    text = labels.take(pa.array(order))
    offsets = np.frombuffer(text.buffers()[1], np.int32)[: len(text) + 1]
    data = memoryview(text.buffers()[2]) if len(text) else memoryview(b"")
    per_doc = np.bincount(key_a >> 40, minlength=docs) + np.bincount(key_b >> 40, minlength=docs)
    edges = offsets[np.concatenate([[0], np.cumsum(per_doc)])]
    return [hashlib.sha256(data[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(edges[:-1].tolist(), edges[1:].tolist())]


def align(a_ids: pa.ListArray, b_ids: pa.ListArray, size_a: pa.Array, size_b: pa.Array) -> tuple[dict, pa.Table]:
    """Columns per document (n_a, n_b, n_groups, n_links, groups_sha256) and the links (doc, a, b) in order."""
    docs = len(a_ids)
    a, _, key_a = _ends(a_ids, size_a)
    b, _, key_b = _ends(b_ids, size_b)
    left = pa.table({"end": key_a, "a": a})
    right = pa.table({"end": key_b, "b": b})
    ends = left.join(right, "end", join_type="full outer", use_threads=False).sort_by("end")
    both = pc.and_(pc.is_valid(ends["a"]), pc.is_valid(ends["b"]))
    doc = pc.shift_right(ends["end"], 40)
    links = pa.table({"doc": doc, "a": pc.fill_null_backward(ends["a"]), "b": pc.fill_null_backward(ends["b"])})
    counted = pa.table({"doc": doc, "both": pc.cast(both, pa.int64())}).group_by("doc", use_threads=False).aggregate([("both", "sum"), ([], "count_all")])
    n_groups, n_links = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    at = counted["doc"].to_numpy()
    n_groups[at], n_links[at] = counted["both_sum"].to_numpy(), counted["count_all"].to_numpy()
    closing = pc.filter(ends["end"], both).to_numpy()
    digests = group_digests(a, b, key_a.to_numpy(), key_b.to_numpy(), closing, docs)
    columns = {
        "n_a": np.diff(a_ids.offsets.to_numpy()).astype(np.int64),
        "n_b": np.diff(b_ids.offsets.to_numpy()).astype(np.int64),
        "n_groups": n_groups,
        "n_links": n_links,
        "groups_sha256": digests,
    }
    return columns, links


def blocks_of(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list, list]]:
    """Ids and texts in blocks of ``least`` bytes of text or more."""
    ids, texts, held = [], [], 0
    for piece in slices(batches, 64):
        for i, t in zip(*(c.to_pylist() for c in piece.columns)):
            ids.append(i)
            texts.append(t)
            held += len(t) if t else 0
            if held >= least:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


_PER_DOC = {"doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string"}
_BLOCK = "block long, " + ", ".join(f"{n} array<{t}>" for n, t in _PER_DOC.items()) + ", pairs array<long>, counts array<long>, links binary"


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, least: int = BLOCK_BYTES) -> DataFrame:
    """One row per block: columns of its documents, its distinct pairs with their counts, and each link as its pair's place.

    A pair is a * 2**32 + b. Blocks are numbered by task and order, the same in a repeated task.
    """

    def run(batches):
        from pyspark import TaskContext

        number, encoders = TaskContext.get().partitionId() << 32, None
        for ids, texts in blocks_of(batches, least):
            encoders = encoders or Encoders(path_a, path_b)
            columns, links = align(*encoders.encode(texts), *encoders.sizes)
            packed = pc.add(pc.shift_left(pc.cast(links["a"], pa.int64()), 32), pc.cast(links["b"], pa.int64()))
            pairs = pa.table({"pair": packed}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
            at = pc.index_in(packed, pairs["pair"].combine_chunks()).to_numpy()
            kind = "<u2" if len(pairs) <= 1 << 16 else "<u4"
            row = {"block": [number], "pairs": [pairs["pair"].to_numpy()], "counts": [pairs["count_all"].to_numpy()]}
            row |= {"doc_id": [ids]} | {n: [v] for n, v in columns.items()} | {"links": [at.astype(kind).tobytes()]}
            lists = {"block": pa.int64(), "links": pa.binary(), "groups_sha256": pa.list_(pa.string())}
            yield pa.RecordBatch.from_pydict({f: pa.array(row[f], lists.get(f, pa.list_(pa.int64()))) for f in names})
            number += 1

    names = [f.split()[0] for f in _BLOCK.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, n: how many links of the corpus hold the pair; best: whether no other pair of its b has more."""
    parts = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    total = parts.groupBy("pair").agg(F.sum("n").alias("n"))
    total = total.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n")
    return total.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def scored(blocks: DataFrame, totals: DataFrame) -> DataFrame:
    """The documents of the blocks with n_best and count_sum, from the totals of the pairs that a block asks for."""
    asked = blocks.select("block", F.explode("pairs").alias("pair")).join(totals.select("pair", "n", "best"), "pair")
    answers = asked.groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("answers"))
    names = list(_PER_DOC)
    schema = ", ".join(f"{n} {t}" for n, t in _PER_DOC.items()) + ", n_best long, count_sum long"

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                col = {n: row.column(n)[0].values if row.column(n)[0].is_valid else None for n in [*names, "pairs", "answers"]}
                docs = len(col["doc_id"])
                n_best = count_sum = np.zeros(docs, np.int64)
                if len(col["pairs"]):
                    raw = row.column("links")[0].as_py()
                    kind = "<u2" if len(col["pairs"]) <= 1 << 16 else "<u4"
                    pair = col["pairs"].take(pa.array(np.frombuffer(raw, kind)))
                    doc = np.repeat(np.arange(docs), col["n_links"].to_numpy())
                    links = pa.table({"doc": doc, "pair": pair})
                    told = col["answers"].flatten()
                    known = pa.table({"pair": told[0], "n": told[1], "best": pc.cast(told[2], pa.int64())})
                    found = links.join(known, "pair", use_threads=False).group_by("doc", use_threads=False).aggregate([("n", "sum"), ("best", "sum")])
                    n_best, count_sum = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
                    n_best[found["doc"].to_numpy()] = found["best_sum"].to_numpy()
                    count_sum[found["doc"].to_numpy()] = found["n_sum"].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*(col[n] for n in names), pa.array(n_best), pa.array(count_sum)], [*names, "n_best", "count_sum"]
                )

    # blocks stay where their rows are; a row is one block, so none is gathered anew
    joined = blocks.select("block", *names, "pairs", "links").join(answers, "block", "left")
    return joined.select(*names, "pairs", "links", "answers").mapInArrow(run, schema)


def align_documents(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment, and the link counts (a, b, n, best) of all pairs.

    Every row is a document of its own, also with a null or repeated id. Null and empty texts, and texts that a vocabulary
    does not give back byte for byte, have no tokens: zeros and an empty digest. Other columns are not looked at.
    """
    blocks = stored(spark, aligned_blocks(docs, path_a, path_b, id_col, text_col), "aligned")
    totals = stored(spark, pair_counts(blocks), "pairs")
    return scored(blocks, totals), totals.select("a", "b", "n", "best")


def op12_alignment(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's digest of ``documents``: the 50k byte-level vocabulary against the 32k piece vocabulary."""
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found, _ = align_documents(spark, docs, *paths)
    return found
