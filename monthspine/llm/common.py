"""Helpers the operators of this folder share: words, word hashes, shared files, learning folds."""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthspine.session import ensure_checkpoint_dir

#: A word is a longest run without these bytes.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: bytes.split() breaks at exactly the six characters of SPACES."""
    return text.encode().split() if text else []


def split_words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and the number of words of each text; no word is empty."""
    trimmed = pc.ascii_trim_whitespace(pa.array(texts, pa.large_string()))
    split = pc.ascii_split_whitespace(trimmed)
    # a text without words splits into one empty word
    some = pc.greater(pc.binary_length(trimmed), 0).fill_null(False).to_numpy(zero_copy_only=False)
    words = split.flatten()
    counts = pc.list_value_length(split).fill_null(0).to_numpy().astype(np.int64)
    return words.filter(pc.greater(pc.binary_length(words), 0)), np.where(some, counts, 0)


def distinct_words(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """Different words, and the place of each word among them."""
    words = words.dictionary_encode()
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and the number of words of each text; each different word is hashed once."""
    words, counts = split_words(texts)
    listed, place = distinct_words(words)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, listed), np.uint64, len(listed))[place], counts


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __init__(self, bound: int = 1_000_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Windows:
    """Hashes of all runs of ``size`` consecutive numbers, by prefix sums of an invertible polynomial modulo 2**64."""

    def __init__(self, size: int, base: int):
        if base % 2 == 0:
            raise ValueError("an even base has no inverse")
        self.size, self.base, self.inverse = size, base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, h: np.ndarray) -> np.ndarray:
        n = len(h) - self.size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        if len(self.up) < len(h):
            self.up, self.down = _powers(self.base, 2 * len(h)), _powers(self.inverse, 2 * len(h))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[: len(h)], dtype=np.uint64)])
        return mix((sums[self.size :] - sums[:n]) * self.down[:n])


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lens[i] - 1 of all i, one after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def covered(flags: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n positions lie in a flagged window; flags[i] stands for the window i .. i + size - 1."""
    step = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(flags)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step[:n]) > 0


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def fold(id_value) -> int:
    """The same remainder in Python, for tests and small fixtures."""
    return zlib.crc32(str(id_value).encode()) % 5


def sample_hash(*key: Column) -> Column:
    """63 fair bits of a key."""
    return F.xxhash64(*key, F.lit("sample")).bitwiseAND(F.lit(2**63 - 1))


def sample_bound(rows: int, n: int) -> int:
    """What ``sample_hash`` is below for about ``rows`` of ``n`` keys, for any number of them."""
    return min(2**63 - 1, 2**63 * rows // n)


def bounded_sample(df: DataFrame, rows: int, key: Column, *content: Column) -> DataFrame:
    """About ``rows`` rows, by a hash of ``key``: the same in every run. Only for fitting models.

    A table of ``rows`` rows or fewer is its own sample. Rows with equal keys share their luck; where that leaves fewer than
    half of ``rows`` or more than twice as many, keys are too few to draw by, and ``content`` joins them. Where even that
    repeats too much, the rows of the least hashes are taken: those that compete for the last places are equal in key and
    content. So a sample is never empty, never beyond twice ``rows``, and no row but its equals could stand in its place.
    """
    n = df.count()
    if n <= rows:
        return df
    for drawn in ((key,), (key, *content)):
        sample = df.filter(sample_hash(*drawn) < sample_bound(rows, n))
        if rows <= 2 * sample.count() <= 4 * rows:
            return sample
    return df.orderBy(sample_hash(key, *content)).limit(rows)


def unused_prefix(df: DataFrame, *names: str) -> str:
    """Underscores that make all the names differ from the columns of ``df``."""
    taken, prefix = {c.lower() for c in df.columns}, "_"
    while any(prefix + n.lower() in taken for n in names):
        prefix += "_"
    return prefix


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return posixpath.join(ensure_checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")


def stored(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: computed once, and kept if executors are lost."""
    path = shared_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a shared folder, for plain binary files."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in small pieces, so that temporary arrays stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, n_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64)
        ends, i = np.cumsum(sizes), 0
        while i < batch.num_rows:
            before = ends[i] - sizes[i]
            n = max(1, int(np.searchsorted(ends, before + n_bytes, "right")) - i)
            yield batch.slice(i, n)
            i += n


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow fields of a flat Spark schema text."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in ddl.split(","))])


def map_batches(df: DataFrame, columns: list[str], make: Callable, schema: str) -> DataFrame:
    """``make()`` runs once in each task and returns a function from the column lists of a piece to a dictionary of columns."""
    out = arrow_schema(schema)

    def run(batches):
        step = None
        for piece in slices(batches):
            step = step or make()
            cols = step(*(c.to_pylist() for c in piece.columns))
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return df.select(*columns).mapInArrow(run, schema)
