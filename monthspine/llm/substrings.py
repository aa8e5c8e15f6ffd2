"""Substring dedup: words are removed that lie in a window of words which also starts earlier in the corpus.

Documents are dealt into blocks by ranges of their id, so block order is document order, and each block's texts are
shuffled once. Three passes run over the blocks, in one plan:

1. A block hashes all its windows and adds them to a count-min sketch. A sketch row is as wide as several times the number
   of windows, far too wide to be sent around, so a block sends it sparse: sorted cell numbers as compressed differences,
   cut into shards of the row. A task per shard merges what the blocks sent and answers each block with one bit per cell
   it sent: whether the merged count is two or more. Counts are only ever too high, so no repeated window is lost.
2. A block sends the hashes of those windows all of whose cells were estimated repeated, again sorted and cut into shards
   of the hash space. A task per shard groups them exactly and answers with one bit per hash: whether an earlier block has
   it. Hashes have 96 bits; equal hashes are taken for equal windows (chance of any error below 1e-9 for 10**10 windows).
3. A block drops the words of windows that an earlier block has, or that start earlier in the block.

A window that occurs a million times is one row of each block that has it, so hot windows need no further splitting.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Windows, arrow_schema, covered, word_hashes, words

WINDOW = 20
DEPTH = 2
#: Cells of a sketch row for each window of the corpus, about.
CELLS_PER_WINDOW = 4
#: Text bytes in a block, and windows in a shard, about.
BLOCK_BYTES = 8 << 20
SHARD_WINDOWS = 2 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_PIECE = arrow_schema("block long, shard long, payload binary")
_ANSWER = arrow_schema("block long, shard long, kind long, answer binary")


def _pack(numbers: np.ndarray) -> bytes:
    """Sorted 64-bit integers: the first, and the compressed differences of the rest."""
    if not len(numbers):
        return b""
    step = np.diff(numbers)
    most = int(step.max()) if len(step) else 0
    kind = next(k for k in (1, 2, 4, 8) if most < 1 << 8 * k)
    raw = step.astype(f"<u{kind}").tobytes()
    head = np.array([numbers[0], len(raw), kind], "<u8").tobytes()
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    first, size, kind = np.frombuffer(blob[:24], "<u8").tolist()
    raw = pa.decompress(blob[24:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.uint64(first) + np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.frombuffer(raw, f"<u{kind}"), dtype=np.uint64)])


def _join(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def _parts(blob: bytes, n: int) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(blob[: 4 * n], "<u4").astype(np.int64)) + 4 * n
    return [blob[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist())]


class Block:
    """The windows of a block's texts in document order."""

    def __init__(self, texts: list[str | None], size: int):
        h, n_words = word_hashes(texts)
        ends = np.cumsum(n_words)
        # windows of all words one after another; those that reach into the next text are none
        starts = np.arange(max(0, len(h) - size + 1))
        inside = starts + size <= np.repeat(ends, n_words)[: len(starts)]
        self.counts = np.maximum(n_words - size + 1, 0)
        self.h1, self.h2 = (Windows(size, b).of(h)[inside] for b in _BASES)


def _shards(numbers: np.ndarray, width: int, shards: int):
    """Sorted numbers below ``width`` cut into equal ranges: (shard, first index, end index)."""
    edge = np.searchsorted(numbers, np.array([width * s // shards for s in range(1, shards)], np.uint64))
    edge = [0, *edge.tolist(), len(numbers)]
    return [(s, a, b) for s, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]


def _cells(block: Block, depth: int, width: int):
    """Of each sketch row: its distinct cells, the place of each window's cell among them, and the cells' counts."""
    for row, h in zip(range(depth), (block.h1, block.h2)):
        cell = (h >> np.uint64(16)) % np.uint64(width)
        yield row, *np.unique(cell, return_inverse=True, return_counts=True)


class Plan:
    """Sizes that follow from the corpus: sketch width and numbers of shards."""

    def __init__(self, n_windows: int, depth: int = DEPTH, size: int = WINDOW):
        if not 1 <= depth <= 2:
            raise ValueError("a window has two hashes, so a sketch has one or two rows")
        self.size, self.depth = size, depth
        self.width = max(1 << 10, CELLS_PER_WINDOW * n_windows)
        self.shards = max(1, -(-n_windows // SHARD_WINDOWS))

    def sketch(self, block_id: int, texts: list):
        """Pass 1: the block's sparse sketch, a piece for each shard of each row."""
        block = Block(texts, self.size)
        for row, cells, _, counts in _cells(block, self.depth, self.width):
            for s, a, b in _shards(cells, self.width, self.shards):
                many = np.packbits(counts[a:b] > 1).tobytes()
                yield block_id, row * self.shards + s, _join(_pack(cells[a:b]), many)

    def merge_sketches(self, rows: list[tuple[int, int, bytes]]):
        """Merge a shard's pieces, and answer each with the cells counted twice or more."""
        pieces, ones = [], []
        for _, _, blob in rows:
            cells, many = _parts(blob, 2)
            pieces.append(_unpack(cells))
            ones.append(1 + np.unpackbits(np.frombuffer(many, np.uint8), count=len(pieces[-1])).astype(np.int64))
        _, place = np.unique(np.concatenate(pieces), return_inverse=True)
        repeated = np.bincount(place, weights=np.concatenate(ones)) >= 2
        for (block, shard, _), flags in zip(rows, np.split(repeated[place], np.cumsum([len(p) for p in pieces])[:-1])):
            yield block, shard, 0, np.packbits(flags).tobytes()

    def candidates(self, block: Block, answers: dict[int, bytes]) -> np.ndarray:
        """Which windows have all their cells estimated repeated."""
        out = np.ones(len(block.h1), bool)
        for row, cells, place, _ in _cells(block, self.depth, self.width):
            flags = np.zeros(len(cells), bool)
            for s, a, b in _shards(cells, self.width, self.shards):
                got = answers[row * self.shards + s]
                flags[a:b] = np.unpackbits(np.frombuffer(got, np.uint8), count=b - a).astype(bool)
            out &= flags[place]
        return out

    def distinct(self, block: Block, answers: dict[int, bytes]):
        """Candidate windows, the first window of each distinct candidate in hash order, and each candidate's place there."""
        at = np.flatnonzero(self.candidates(block, answers))
        order = at[np.lexsort((at, block.h2[at] >> np.uint64(32), block.h1[at]))]
        a, b = block.h1[order], block.h2[order] >> np.uint64(32)
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return order, order[new], np.cumsum(new) - 1

    def _hash_shards(self, block: Block, first: np.ndarray):
        return _shards(block.h1[first] >> np.uint64(24), 1 << 40, self.shards)

    def send(self, block_id: int, texts: list, answers: dict[int, bytes]):
        """Pass 2: the hashes of the block's distinct candidates, a piece for each shard of the hash space."""
        block = Block(texts, self.size)
        _, first, _ = self.distinct(block, answers)
        for s, a, b in self._hash_shards(block, first):
            low = (block.h2[first[a:b]] >> np.uint64(32)).astype("<u4").tobytes()
            yield block_id, s, _join(_pack(block.h1[first[a:b]]), low)

    def merge_exactly(self, rows: list[tuple[int, int, bytes]]):
        """Group a shard's hashes, and answer each piece with those that an earlier block has."""
        rows = sorted(rows, key=lambda r: r[0])
        pieces = []
        for _, _, blob in rows:
            high, low = _parts(blob, 2)
            pieces.append((_unpack(high), np.frombuffer(low, "<u4")))
        a, b = (np.concatenate(x) for x in zip(*pieces))
        order = np.lexsort((np.arange(len(a)), b, a))  # pieces are in block order, so the first of equal ones is earliest
        seen = np.zeros(len(a), bool)
        seen[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
        for (block, shard, _), flags in zip(rows, np.split(seen, np.cumsum([len(p[0]) for p in pieces])[:-1])):
            yield block, shard, 1, np.packbits(flags).tobytes()

    def remove(self, texts: list, sketch: dict[int, bytes], exact: dict[int, bytes]) -> tuple[list[list[bytes]], list[np.ndarray]]:
        """Pass 3: the words of each text, and which of them go."""
        block = Block(texts, self.size)
        order, first, place = self.distinct(block, sketch)
        earlier = np.zeros(len(first), bool)
        for s, a, b in self._hash_shards(block, first):
            earlier[a:b] = np.unpackbits(np.frombuffer(exact[s], np.uint8), count=b - a).astype(bool)
        gone = np.zeros(len(block.h1), bool)
        gone[order] = earlier[place] | (order != first[place])
        ends = np.cumsum(block.counts)
        listed = [words(t) for t in texts]
        return listed, [
            covered(gone[e - n : e], self.size, len(ws)) if n and gone[e - n : e].any() else np.zeros(len(ws), bool)
            for e, n, ws in zip(ends.tolist(), block.counts.tolist(), listed)
        ]


def _blocks(docs: DataFrame, size: int, id_col: str, text_col: str) -> tuple[DataFrame, Plan]:
    """Rows as (block, id, text), with about equal numbers of rows in a block, and the plan for them.

    Block edges are quantiles of the ids; rows of one id are never parted, and null ids are block 0.
    """
    ids = F.col(id_col).cast("long")
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0))
    r = docs.agg(F.sum(n_bytes.cast("long")).alias("bytes"), F.count("*").alias("rows")).first()
    n_blocks = max(1, -(-(r.bytes or 0) // BLOCK_BYTES))
    edges = []
    if n_blocks > 1:
        at = [i / n_blocks for i in range(1, n_blocks)]
        edges = sorted(set(docs.select(ids.alias("id")).approxQuantile("id", at, 0.1 / n_blocks)))
    edge = F.lit([int(e) for e in edges]).cast("array<bigint>")
    number = F.coalesce(F.size(F.filter(edge, lambda e: e < ids)), F.lit(0)).cast("long") if edges else F.lit(0).cast("long")
    rows = docs.select(number.alias("block"), ids.alias("id"), F.col(text_col).alias("text"))
    # a window starts at a word, and a word has seldom less than five bytes with its space
    return rows, Plan((r.bytes or 0) // 6 + 1, size=size)


def _by_shard(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("shard").to_pylist(), table.column("answer").to_pylist()))


def _ids_and_texts(table: pa.Table) -> tuple[list, list]:
    """In document order: null ids first, then by id; rows of one id by their text, null first."""
    ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] is not None, texts[i] or ""))
    return [ids[i] for i in order], [texts[i] for i in order]


def _table(rows, schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def removed_words(
    docs: DataFrame, finish, schema: str, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``finish(words, gone)`` turns each document's words and their removal flags into the columns of ``schema`` after id.

    A null text has no words. Rows of one id are taken as documents one after another, ordered by their text. A text with
    fewer words than a window keeps them all. Other columns are not read. An empty table gives no row.
    """
    rows, plan = _blocks(docs, size, id_col, text_col)
    out_schema = arrow_schema(f"id long, {schema}")

    def sketch(table: pa.Table) -> pa.Table:
        _, texts = _ids_and_texts(table)
        return _table(plan.sketch(table.column("block")[0].as_py(), texts), _PIECE)

    def rows_of(table: pa.Table):
        return list(zip(*(table.column(c).to_pylist() for c in ("block", "shard", "payload"))))

    def merge(table: pa.Table) -> pa.Table:
        return _table(plan.merge_sketches(rows_of(table)), _ANSWER)

    def exact(table: pa.Table) -> pa.Table:
        return _table(plan.merge_exactly(rows_of(table)), _ANSWER)

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], _PIECE)
        _, texts = _ids_and_texts(table)
        return _table(plan.send(table.column("block")[0].as_py(), texts, _by_shard(answers)), _PIECE)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], out_schema)
        ids, texts = _ids_and_texts(table)
        kind = answers.column("kind").to_numpy()
        estimated, known = (_by_shard(answers.filter(pa.array(kind == k))) for k in (0, 1))
        listed, gone = plan.remove(texts, estimated, known)
        return _table(((i, *finish(ws, g)) for i, ws, g in zip(ids, listed, gone)), out_schema)

    piece, answer = "block long, shard long, payload binary", "block long, shard long, kind long, answer binary"
    by_block = rows.groupBy("block")
    estimated = by_block.applyInArrow(sketch, piece).groupBy("shard").applyInArrow(merge, answer)
    sent = by_block.cogroup(estimated.groupBy("block")).applyInArrow(send, piece)
    earlier = sent.groupBy("shard").applyInArrow(exact, answer)
    both = estimated.unionByName(earlier)
    return by_block.cogroup(both.groupBy("block")).applyInArrow(cut, f"id long, {schema}").withColumnRenamed("id", id_col)


def _kept(ws: list[bytes], gone: np.ndarray) -> bytes:
    return b" ".join(itertools.compress(ws, (~gone).tolist()) if gone.any() else ws)


def kept_text(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the kept words joined by one space."""

    def finish(ws, gone):
        return (_kept(ws, gone).decode(),)

    return removed_words(docs, finish, "text string", size, id_col, text_col).withColumnRenamed("text", text_col)


def op5_substrings(docs: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, n_words, n_removed, kept_sha256."""

    def finish(ws, gone):
        return len(ws), int(gone.sum()), hashlib.sha256(_kept(ws, gone)).hexdigest()

    return removed_words(docs, finish, "n_words long, n_removed long, kept_sha256 string")


OP5_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS win FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM h) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, i + o AS pos FROM r, (SELECT unnest(range(0, 20)) AS o)),
g AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY 1),
k AS (SELECT doc_id, pos, ws[pos] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM k ANTI JOIN c USING (doc_id, pos) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""
