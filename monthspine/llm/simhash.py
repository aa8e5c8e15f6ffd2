"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are split into partitions of bits with thresholds t1 .. tm whose sum is radius - m + 1: two
fingerprints at most ``radius`` bits apart then differ in at most t_i bits of some partition i. Correlated bits go into one
partition, so that the others stay selective, and a dynamic programme allots the thresholds: it weighs the rows that
probing with a threshold emits against the candidates expected from counts over all fingerprints. Every fingerprint is
sent to the partition values within its threshold; those that meet are compared in full.

Copies have one fingerprint and are collapsed before. A bucket in which many fingerprints meet yields a spanning forest
of its links, never its pairs: a fingerprint is compared with those not yet linked, and a group of near copies leaves
that set in a few steps. Very large buckets are split by exact matches on radius + 1 further pieces first.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stored, unused_prefix

BITS = 64
RADIUS = 4
SHINGLE = 4
#: Expected cost of comparing a pair, in rows sent.
PAIR_COST = 0.05
#: Buckets up to this size are compared in all their pairs at once, over all buckets of a batch.
NARROW = 8
#: Buckets above this size are split by exact matches first.
WIDE = 2048


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit majority of the XXH64 hashes (seed 42) of the word shingles, A-Z in lower case; 0 without words."""
    ws = text.encode().lower().split() if text else []
    if not ws:
        return 0
    line = b" ".join(ws)
    lens = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lens + 1) - 1
    k = min(size, len(ws))
    digest = xxhash.xxh64_intdigest
    h = [digest(line[a:b], 42) for a, b in zip((ends - lens)[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist())]
    bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row."""

    def make():
        return lambda ids, texts: {"id": ids, "fp": [fingerprint(t) for t in texts]}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, ["id", "text"], make, "id long, fp long")


# --- partitions and thresholds --------------------------------------------------------------------------------------


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set, over all of them."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        i, j = np.triu_indices(BITS)
        cells = {"i": pa.array([*i, -1], pa.int32()), "j": pa.array([*j, -1], pa.int32())}
        yield pa.RecordBatch.from_pydict(cells | {"n": pa.array([*both[i, j].astype(int), n], pa.int64())})

    rows = fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, total = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r.i < 0:
            total = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return total, both


def correlated_groups(total: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of nearly equal size; a group grows by the bit most correlated with it."""
    n = max(1, total)
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        inside = corr[np.ix_(free, free)]
        group = [free.pop(int(inside.max(axis=1).argmax()))]
        while len(group) < size:
            group.append(free.pop(int(corr[np.ix_(free, group)].mean(axis=1).argmax())))
        groups.append(sorted(group))
    return groups


def mask_of(bits) -> int:
    """Bits as a signed 64-bit integer."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int

    def flips(self) -> list[int]:
        """Masks of all ways to change at most ``threshold`` bits of the partition."""
        return [mask_of(c) for k in range(self.threshold + 1) for c in itertools.combinations(self.bits, k)]


def _ball(width: int, t: int) -> int:
    return sum(math.comb(width, k) for k in range(t + 1))


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 (never probed) with the given sum and the least summed cost; costs[i][t + 1] is that of t."""
    best = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, len(row) - 1):
                found = (cost + row[t + 1], [*ts, t])
                if used + t not in step or found < step[used + t]:
                    step[used + t] = found
        best = step
    return best[total]


def choose_partitions(fps: DataFrame, radius: int = RADIUS, counts: tuple[int, ...] = (2, 3, 4)) -> list[Partition]:
    """Correlated groups of bits and their thresholds, from counts over all fingerprints.

    With equal values only, a partition has half the sum of squared value counts as candidates. Each further differing
    bit multiplies by the odds that two fingerprints differ in it.
    """
    total, both = bit_counts(fps)
    if total < 2:
        return [Partition(tuple(range(BITS)), 0)]
    groups = {(m, i): g for m in counts for i, g in enumerate(correlated_groups(total, both, m))}
    part = lambda m, i: F.lit(m * 100 + i).alias("part")
    values = [F.struct(part(m, i), F.col("fp").bitwiseAND(F.lit(mask_of(g))).alias("value")) for (m, i), g in groups.items()]
    pairs = fps.select(F.explode(F.array(*values)).alias("x")).groupBy("x.part", "x.value").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("part").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).collect()
    pairs = {r.part: r.pairs for r in pairs}
    p = np.diag(both) / total
    differ = np.clip(2 * p * (1 - p), 1e-6, 0.5)
    found = []
    for m in counts:
        rows = []
        for i in range(m):
            g = groups[m, i]
            # elementary symmetric sums of the odds: expected pairs that differ in exactly k bits of the group
            sums = [1.0] + [0.0] * radius
            for odds in differ[g] / (1 - differ[g]):
                for k in range(radius, 0, -1):
                    sums[k] += odds * sums[k - 1]
            equal = pairs[m * 100 + i] + 1.0
            probes = [_ball(len(g), t) for t in range(radius + 1)]
            rows.append([0.0] + [n * (total + PAIR_COST * equal * sum(sums[: t + 1])) for t, n in enumerate(probes)])
        cost, ts = allot(rows, radius - m + 1)
        found.append((cost, m, ts))
    _, m, ts = min(found)
    return [Partition(tuple(groups[m, i]), t) for i, t in enumerate(ts) if t >= 0]


# --- links ----------------------------------------------------------------------------------------------------------


def spanning_links(f: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join all of the distinct fingerprints that are joined by links of at most ``radius`` bits."""
    out, left = [], f
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                hit = left[near]
                left = left[~near]
                out.append((np.full(len(hit), x), hit))
                queue.extend(hit)
    return out


def wide_links(f: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for many fingerprints: two of them agree in one of radius + 1 pieces."""
    if len(f) <= WIDE:
        return spanning_links(f, radius)
    out = []
    for piece in np.array_split(np.arange(BITS), radius + 1):
        part = f & np.uint64(sum(1 << int(b) for b in piece))
        order = np.argsort(part, kind="stable")
        for group in np.split(f[order], np.flatnonzero(np.diff(part[order])) + 1):
            if len(group) > 1:
                out += spanning_links(group, radius)
    return out


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets of rows sorted by key."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(keys)))
    found = []
    bucket = np.cumsum(new) - 1
    narrow = np.flatnonzero((size[bucket] > 1) & (size[bucket] <= NARROW))
    for k in range(1, NARROW):
        a = narrow[:-k] if k < len(narrow) else narrow[:0]
        a = a[bucket[narrow[k:]] == bucket[a]] if len(a) else a
        near = a[(np.bitwise_count(fps[a] ^ fps[a + k]) <= radius) & (fps[a] != fps[a + k])]
        found.append((fps[near], fps[near + k]))
    for b in np.flatnonzero(size > NARROW):
        found += wide_links(np.unique(fps[start[b] : start[b] + size[b]]), radius)
    a = np.concatenate([x for x, _ in found]).view(np.int64)
    b = np.concatenate([y for _, y in found]).view(np.int64)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.empty((2, 0), np.int64)
    return pairs[0], pairs[1]


def links(fps: DataFrame, partitions: list[Partition], radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints that join all that are within the radius of one another."""
    probes = []
    for p in partitions:
        value = F.col("fp").bitwiseAND(F.lit(mask_of(p.bits)))
        probes.append(F.transform(F.lit(p.flips()), lambda flip, value=value: value.bitwiseXOR(flip)))
    rows = fps.select(F.explode(F.concat(*probes)).alias("key"), "fp")
    rows = rows.repartition("key").sortWithinPartitions("key", "fp")

    def run(batches):
        keys, values = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                keys = np.concatenate([keys, batch.column(0).to_numpy()])
                values = np.concatenate([values, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            # the last bucket may go on in the next batch
            cut = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                a, b = bucket_links(keys[:cut], values[:cut], radius)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})
                keys, values = keys[cut:], values[cut:]

    return rows.mapInArrow(run, "a long, b long").distinct()


# --- components -----------------------------------------------------------------------------------------------------


def _fingerprint_of_rows(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, int(r.h or 0)


def components(spark: SparkSession, edges: DataFrame, tag: str = "links") -> DataFrame:
    """(node, root): the least node of each component, by alternating large and small stars over stored edges.

    Minima are combined before they are shuffled, and rows meet them in a join that can split a hot node.
    """
    edges = stored(spark, edges.select(F.col("a"), F.col("b")), tag)
    mark = _fingerprint_of_rows(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a and b != m").select(F.col("m").alias("a"), "b").distinct()
        large = stored(spark, large, tag)
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        small = small.unionByName(down.select(F.col("m").alias("a"), "b")).distinct()
        edges = stored(spark, small, tag)
        now = _fingerprint_of_rows(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(spark: SparkSession, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint: a name of its component, and the smallest id in it.

    ``fps`` has the columns id and fp. A component of null ids only has the component_id null.
    """
    distinct = stored(spark, fps.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-distinct")
    edges = links(distinct.select("fp"), choose_partitions(distinct, radius), radius)
    roots = components(spark, edges, "simhash-links")
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = stored(spark, named, "simhash-roots")
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.join(ids, "root").select("fp", "root", "component_id")


def simhash_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable over links).

    Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows give a row each. Other
    columns are not read. An empty table gives no row.
    """
    fps = stored(spark, fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    named = near_duplicates(spark, fps)
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays, null ids last.

    Of rows with that id and the same fingerprint, the one with the smallest text stays. All columns are kept.
    """

    @F.pandas_udf("long")
    def of_text(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    columns, mark = docs.columns, unused_prefix(docs, "fp", "key", "text")
    fp, key, by_text = mark + "fp", mark + "key", F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn(fp, of_text(F.col(text_col))).withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)))
    rows = stored(spark, rows, "simhash-rows")
    fps = rows.select(F.col(key).alias("id"), F.col(fp).alias("fp"))
    first = fps.join(near_duplicates(spark, fps), "fp").groupBy("root").agg(F.min(F.struct("id", "fp")).alias("k"))
    first = first.select(F.col("k.id").alias(key), F.col("k.fp").alias(fp))
    one = rows.join(first, [key, fp], "left_semi").groupBy(key, fp).agg(F.min_by(F.struct(*columns), by_text).alias("row"))
    return one.select("row.*")
