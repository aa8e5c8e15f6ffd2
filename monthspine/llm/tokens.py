"""Token ids as flat unsigned integer files with 64-bit document offsets.

One shard per range partition of the id column holds three files: ``.ids`` (token ids, 16 or 32 bits by the vocabulary's
size), ``.off`` (64-bit offsets of its documents, one more than it has documents) and ``.doc`` (64-bit document ids).
``manifest.json`` lists the shards with their bases: the prefix sums of the shard lengths. A document's tokens start at
base + offset, so any reader can memory-map a shard alone or address the corpus as one array.

A text is encoded word by word and words are remembered: the vocabulary used here drops white space before merging, so
the ids of a text are those of its words one after another. Texts are split, words made distinct, and their ids put in
place by Arrow; Python sees each distinct word of a piece, and the library each word without its case and closing
punctuation. Tests hold this against encoding whole texts.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_folder, shared_folder, text_slices

#: Stands in the ``.doc`` files for a null id.
NULL_ID = -(2**63)
#: Cut from the end of a word before it is looked up; the vocabulary's splitting rule always breaks between a letter and these.
_TAIL = ".,!#*$%&|?;:"
#: Letters that lower-case one by one, whatever stands beside them.
_LETTERS = "a-zà-öø-ÿßA-ZÀ-ÖØ-Þ"
_ALL_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]))


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each character up to U+00FF, by its UTF-8 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class _Ids:
    """Lists of ids by number, in arrays with room to grow."""

    def __init__(self):
        self.n, self.size = 0, 0
        self.edges, self.flat = np.zeros(1024, np.int32), np.empty(4096, np.uint32)

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        n, size = self.n + len(lens), self.size + len(flat)
        if n >= len(self.edges):
            self.edges = np.concatenate([self.edges, np.zeros(n, np.int32)])
        if size > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(size, np.uint32)])
        self.edges[self.n + 1 : n + 1] = self.size + np.cumsum(lens)
        self.flat[self.size : size] = flat
        self.n, self.size = n, size

    def lists(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.edges[: self.n + 1]), pa.array(self.flat[: self.size]))

    def lens(self, at: np.ndarray) -> np.ndarray:
        return self.edges[at + 1] - self.edges[at]


def _loaded(path: str):
    """The tokenizer of a file, read once in a process: functions sent by value keep no globals from task to task."""
    import tokenizers

    held = vars(tokenizers).setdefault("_monthspine_loaded", {})
    if path not in held:
        held[path] = tokenizers.Tokenizer.from_file(path)
    return held[path]


class WordEncoder:
    """Ids of whole texts, with a bounded memory of words."""

    def __init__(self, path: str, bound: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.full = _loaded(path)
        self.merge, self.letters, self.bound = self.full.model, _byte_letters(), bound
        self._reset()

    def _reset(self) -> None:
        self.place, self.ids = _Numbers(), _Ids()
        # lower-cased words of letters, and what stands behind them
        self.cores, self.core_ids = _Numbers(), _Ids()

    def _core(self, core: str) -> list[int]:
        if core[:1].isalpha():
            return [t.id for t in self.merge.tokenize(core if core.isascii() else core.translate(self.letters))]
        return self._whole(core)

    def _whole(self, text: str) -> list[int]:
        return self.full.encode(text, add_special_tokens=False).ids

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """The numbers of lower-cased cores or tails; new ones are encoded."""
        parts = parts.dictionary_encode()
        found, new = self.cores.of(parts.dictionary)
        if new:
            self._add(self.core_ids, map(self._core, new))
        return found[parts.indices.to_numpy()]

    @staticmethod
    def _add(ids: _Ids, found) -> None:
        flat, lens = array("I"), array("I")
        for f in found:
            flat.extend(f)
            lens.append(len(f))
        ids.add(np.frombuffer(flat, np.uint32), np.frombuffer(lens, np.uint32))

    def _learn(self, new: pa.Array) -> None:
        """The ids of new words: letters with closing punctuation by their two parts, others by the whole library."""
        plain = pc.match_substring_regex(new, f"^[{_LETTERS}]+[{re.escape(_TAIL)}]*$")
        by_parts = plain.to_numpy(zero_copy_only=False)
        words = new.filter(plain)
        core = pc.utf8_rtrim(words, characters=_TAIL)
        cores, tails = self._numbers(pc.utf8_lower(core)), self._numbers(pc.utf8_ltrim(words, characters=_ALL_LETTERS))
        both = np.stack([cores, tails], axis=1).ravel()
        others = new.filter(pc.invert(plain)).to_pylist()
        # words are numbered in the order they stand here, so both kinds are put back in it
        kinds = _Ids()
        kinds.add(self.core_ids.lists().take(pa.array(both)).flatten().to_numpy(), self.core_ids.lens(both).reshape(-1, 2).sum(axis=1))
        self._add(kinds, map(self._whole, others))
        at = np.empty(len(new), np.int64)
        at[by_parts] = np.arange(len(words))
        at[~by_parts] = len(words) + np.arange(len(others))
        self.ids.add(kinds.lists().take(pa.array(at)).flatten().to_numpy(), kinds.lens(at))

    def encode(self, texts: pa.Array | list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text; the end id closes every text."""
        if len(self.place) > self.bound:
            self._reset()
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(texts)
        counts = pc.list_value_length(split).fill_null(0).to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        found, new = self.place.of(words.dictionary)
        if new:
            self._learn(pa.array(new, pa.string()))
        # the end id stands behind all words, as one more list
        ends = np.cumsum(counts)
        at = np.insert(found[words.indices.to_numpy()], ends, self.ids.n)
        known = _Ids()
        known.n, known.size, known.edges, known.flat = self.ids.n, self.ids.size, self.ids.edges, self.ids.flat
        known.add(np.array([end_id], np.uint32), np.ones(1, np.int64))
        ids = known.lists().take(pa.array(at)).flatten().to_numpy()
        edges = np.concatenate([[0], np.cumsum(known.lens(at), dtype=np.int64)])
        return ids, np.diff(edges[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])])


class _Numbers(dict):
    """Word to its number."""

    def of(self, words: pa.Array) -> tuple[np.ndarray, list[str]]:
        """The numbers of different words, and those of them that are new: they get the next numbers in their order."""
        listed = words.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in listed if w not in self]
        self.update(zip(new, range(len(self), len(self) + len(new))))
        return np.fromiter(map(self.__getitem__, listed), np.int64, len(listed)), new


class _Places(dict):
    """Word to its number; unseen words get the next one and are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


@dataclass(frozen=True)
class TokenFiles:
    """A written set of shards: where it is, and its manifest."""

    folder: str
    manifest: dict


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> TokenFiles:
    """Encode every whole text and write the shards in ascending id order.

    Rows are dealt by ranges of the id before encoding, so each text is encoded once, in its place. Null ids come first;
    rows with equal ids are ordered by their text. A null text has only the end id. A shard's files get their names when
    they are complete, so a repeated task replaces them by equal ones. The driver sees one line per shard.
    """
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    kind = "uint16" if size <= 1 << 16 else "uint32"
    store, root = open_folder(folder)
    store.create_dir(root, recursive=True)

    def run(batches):
        from pyspark import TaskContext

        shard = f"shard-{TaskContext.get().partitionId():08d}"
        encoder = None
        doc_ids, offsets, total = [], [0], 0
        for piece in text_slices(batches, 1):
            if encoder is None:
                files, here = open_folder(folder)
                encoder = WordEncoder(tokenizer_path)
                temporary = posixpath.join(here, f".{shard}-{uuid.uuid4().hex}")
                out = files.open_output_stream(temporary + ".ids")
            ids, lens = encoder.encode(piece.column(1), end_id)
            out.write(ids.astype(f"<{np.dtype(kind).str[1:]}").tobytes())
            doc_ids += [NULL_ID if i is None else i for i in piece.column(0).to_pylist()]
            offsets += (total + np.cumsum(lens)).tolist()
            total += int(lens.sum())
        if encoder is None:
            return
        out.close()
        for suffix, values in ((".off", offsets), (".doc", doc_ids)):
            with files.open_output_stream(temporary + suffix) as f:
                f.write(np.array(values, "<i8").tobytes())
        for suffix in (".ids", ".off", ".doc"):
            files.move(temporary + suffix, posixpath.join(here, shard + suffix))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(doc_ids)], "n_tokens": [total]})

    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = dealt.repartitionByRange("id").sortWithinPartitions("id", "text")
    rows = sorted(dealt.mapInArrow(run, "shard string, n_docs long, n_tokens long").collect())
    shards, base = [], 0
    for r in rows:
        shards.append({"shard": r.shard, "base": base, "n_docs": r.n_docs, "n_tokens": r.n_tokens})
        base += r.n_tokens
    manifest = {"dtype": kind, "end_id": end_id, "n_tokens": base, "shards": shards}
    with store.open_output_stream(posixpath.join(root, "manifest.json")) as f:
        f.write(json.dumps(manifest).encode())
    return TokenFiles(folder, manifest)


def open_tokens(folder: str) -> TokenFiles:
    """A set of shards that was written before."""
    store, root = open_folder(folder)
    with store.open_input_stream(posixpath.join(root, "manifest.json")) as f:
        return TokenFiles(folder, json.loads(f.read()))


def shard_arrays(folder: str, shard: str, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (memory-mapped where the folder is a mounted one), offsets and document ids of a shard."""
    store, root = open_folder(folder)
    path = posixpath.join(root, shard)

    def whole(suffix, kind):
        with store.open_input_stream(path + suffix) as f:
            return np.frombuffer(f.read(), kind)

    kind = f"<{np.dtype(dtype).str[1:]}"
    ids = np.memmap(path + ".ids", kind, "r") if type(store).__name__ == "LocalFileSystem" else whole(".ids", kind)
    return ids, whole(".off", "<i8"), whole(".doc", "<i8")


def read_tokens(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32 bits)."""
    folder, dtype, shards = files.folder, files.manifest["dtype"], files.manifest["shards"]

    def run(batches):
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, off, doc = shard_arrays(folder, shard, dtype)
                for i in range(0, len(doc), 5000):
                    edge = off[i : i + 5001]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edge[:-1], edge[1:])]
                    chunk = doc[i : i + 5000]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(chunk, pa.int64(), mask=chunk == NULL_ID),
                            "start": pa.array(base + edge[:-1], pa.int64()),
                            "n_tokens": pa.array(np.diff(edge), pa.int64()),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    listed = spark.createDataFrame([(s["shard"], s["base"]) for s in shards], "shard string, base long")
    listed = listed.repartition(max(1, len(shards)), "shard")
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_tokens(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's digest of ``documents``: written with the 49k word vocabulary and end id 2, read back."""
    import public_tokenizers

    files = write_tokens(docs, shared_folder(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_tokens(spark, files)
