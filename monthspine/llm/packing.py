"""Documents packed into token windows: best-fit decreasing over a segment tree of remaining capacities.

A text is encoded once, where it is read. Documents longer than a window are cut into full windows first; what remains of
each is one piece. Only the lengths and checksums of pieces travel (and the ids, if asked for): rows are dealt evenly over
tasks, whatever their ids, and every task packs its own pieces, largest first, each into the open window that it fills best.
A segment tree whose leaves are remaining capacities finds that window in a walk of the tree's height.

Windows that stay emptier than ``slack`` at the end are taken apart: their pieces are cut at powers of two, and such parts,
largest first, fill windows without a gap. The last of them form sequences whose lengths are powers of two, which need no
padding. So no sequence has more than ``slack`` tokens of padding, in a table of any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_slices
from .tokens import WordEncoder

WINDOW = 4096
#: Padding a window of best-fit decreasing may keep: one token in a hundred.
SLACK = WINDOW // 100
#: Documents a task packs: the memory and time of a task are bounded by it.
ROWS_PER_TASK = 1 << 15

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def powers_of(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class OpenWindows:
    """Open windows by remaining capacity; a segment tree tells which capacities have any."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        stack = self.stacks[capacity]
        stack.append(window)
        node = capacity + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remaining capacity and number of the tightest window with room for ``need``, no longer open; None without one."""
        node = need + self.leaves
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        stack = self.stacks[capacity]
        window = stack.pop()
        if not stack:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return capacity, window


def best_fit(lengths: Iterable[int], window: int) -> list[list[int]]:
    """Members of each window, in order; ``lengths`` descend and none exceeds ``window``."""
    tree, members = OpenWindows(window), []
    for at, length in enumerate(lengths):
        found = tree.take(length)
        if found is None:
            found = window, len(members)
            members.append([])
        capacity, number = found
        members[number].append(at)
        if capacity > length:
            tree.put(capacity - length, number)
    return members


def without_gaps(sizes: list[int], window: int) -> list[int]:
    """Lengths of sequences that descending powers of two fill one after another: whole windows, then powers of two."""
    full, rest = divmod(sum(sizes), window)
    return [window] * full + powers_of(rest)


def arrange(rows: list[tuple], window: int, slack: int) -> list[tuple]:
    """Pieces (row, start, length, part, sequence, offset) of rows (tokens, number of full windows).

    ``part`` tells which checksum of the row is meant: ("full", i), ("rest", 0) or ("cut", i).
    """
    out, sequence = [], 0
    for r, (tokens, full) in enumerate(rows):
        for i in range(full):
            out.append((r, i * window, window, ("full", i), sequence, 0))
            sequence += 1
    rests = sorted(((tokens - full * window, r) for r, (tokens, full) in enumerate(rows) if tokens > full * window), key=lambda x: -x[0])
    cuts = []
    for members in best_fit((n for n, _ in rests), window):
        if window - sum(rests[i][0] for i in members) <= slack:
            offset = 0
            for i in members:
                n, r = rests[i]
                out.append((r, rows[r][1] * window, n, ("rest", 0), sequence, offset))
                offset += n
            sequence += 1
            continue
        for i in members:
            n, r = rests[i]
            start = rows[r][1] * window
            for k, size in enumerate(powers_of(n)):
                cuts.append((size, r, start, k))
                start += size
    cuts.sort(key=lambda c: -c[0])
    ends = iter(without_gaps([c[0] for c in cuts], window))
    room = offset = 0
    for size, r, start, k in cuts:
        if offset == room:
            room, offset = next(ends), 0
            sequence += 1
        out.append((r, start, size, ("cut", k), sequence - 1, offset))
        offset += size
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, window: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """One row per document: tokens, checksums of its full windows, of what remains, and of the parts that may be cut to."""
    schema = "doc_id long, doc_tokens long, full array<long>, rest long, cut array<long>" + (", ids binary" if keep_ids else "")
    longs = pa.list_(pa.int64())

    def run(batches):
        encoder = None
        for piece in text_slices(batches, 1):
            encoder = encoder or WordEncoder(tokenizer_path)
            flat, lens = encoder.encode(piece.column(1), end_id)
            full, rest, cut, raw, at = [], [], [], [], 0
            for n in lens.tolist():
                ids = flat[at : at + n]
                at += n
                edge = n - n % window
                full.append([_crc(ids[i : i + window]) for i in range(0, edge, window)])
                rest.append(_crc(ids[edge:]))
                edges = np.cumsum([edge, *powers_of(n - edge)]).tolist()
                cut.append([_crc(ids[a:b]) for a, b in zip(edges, edges[1:])])
                if keep_ids:
                    raw.append(ids.astype("<u4").tobytes())
            columns = [piece.column(0), pa.array(lens, pa.int64()), pa.array(full, longs), pa.array(rest, pa.int64()), pa.array(cut, longs)]
            names = ["doc_id", "doc_tokens", "full", "rest", "cut"]
            if keep_ids:
                columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    window: int = WINDOW,
    slack: int = SLACK,
    rows_per_task: int = ROWS_PER_TASK,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: its document, place in it and checksum, and its sequence and place there.

    With ``keep_ids`` the ids of the piece follow as ``ids``. Sequence numbers are unique: the task's number in the upper
    32 bits. Every row of the input is a document of its own, also with a null or repeated id; a null or empty text is the
    end id alone; an empty table gives no piece. Other columns of ``docs`` are not looked at.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    schema = PIECES + (", ids array<long>" if keep_ids else "")

    def run(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        first = TaskContext.get().partitionId() << 32
        order = sorted(range(table.num_rows), key=list(zip(*(
            [v if v is not None else -(1 << 63) for v in table["doc_id"].to_pylist()], table["doc_tokens"].to_pylist(), table["rest"].to_pylist()
        ))).__getitem__)
        table = table.take(pa.array(order))
        ids, tokens, rest = (table[c].to_pylist() for c in ("doc_id", "doc_tokens", "rest"))
        full, cut = table["full"].to_pylist(), table["cut"].to_pylist()
        crc = {"full": lambda r, i: full[r][i], "rest": lambda r, i: rest[r], "cut": lambda r, i: cut[r][i]}
        pieces = arrange([(n, len(f)) for n, f in zip(tokens, full)], window, slack)
        for i in range(0, len(pieces), 20_000):
            part = pieces[i : i + 20_000]
            columns = {
                "doc_id": pa.array([ids[p[0]] for p in part], pa.int64()),
                "start": pa.array([p[1] for p in part], pa.int64()),
                "length": pa.array([p[2] for p in part], pa.int64()),
                "ids_crc32": pa.array([crc[p[3][0]](p[0], p[3][1]) for p in part], pa.int64()),
                "doc_tokens": pa.array([tokens[p[0]] for p in part], pa.int64()),
                "sequence_id": pa.array([first + p[4] for p in part], pa.int64()),
                "offset": pa.array([p[5] for p in part], pa.int64()),
            }
            if keep_ids:
                raw = [np.frombuffer(table["ids"][p[0]].as_py(), "<u4")[p[1] : p[1] + p[2]].astype(np.int64) for p in part]
                columns["ids"] = pa.array(raw, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    tasks = -(-docs.count() // rows_per_task) or 1
    rows = encoded(docs, tokenizer_path, end_id, window, id_col, text_col, keep_ids)
    return rows.repartition(tasks).mapInArrow(run, schema)


def sequences(pieces: DataFrame, pad_id: int, window: int = WINDOW) -> DataFrame:
    """Training rows of pieces with ids: sequence_id, input_ids (padded, or a power of two long), and each token's document as
    ``segments`` (its number within the sequence, 0 for padding). A group is one window of tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    found = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    marks = F.flatten(F.transform("parts", lambda p, i: F.array_repeat(i + 1, F.size(p["ids"]))))
    found = found.select("sequence_id", ids.alias("ids"), marks.alias("marks"))
    n = F.size("ids")
    whole = F.exists(F.array(*[F.lit(1 << b) for b in range(window.bit_length())]), lambda p: p == n)
    gap = F.when(whole, 0).otherwise(F.lit(window) - n)
    return found.select(
        "sequence_id",
        F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), gap)).alias("input_ids"),
        F.concat("marks", F.array_repeat(F.lit(0), gap)).alias("segments"),
    )


def op11_packing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's pieces of ``documents``: windows of 4096 ids of the 49k word vocabulary, end id 2."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2)
