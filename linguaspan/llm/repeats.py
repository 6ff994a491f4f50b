"""What the operators on repeated passages share: recurring anchors, their occurrences, and a local suffix sort.

An anchor is a run of `length` words chosen by its own content (textops.anchors), so that every passage of
2 * length - 3 words holds one and all copies of a passage hold the same ones. A window of `window` words can only recur
where it holds an anchor that recurs; everything else is dropped before anything is sorted, joined or compiled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut
from .textops import anchors, gram_hashes, inside, mix, portions, utf8, word_hashes, words

U = np.uint64
EVEN = U(0xFFFFFFFFFFFFFFFE)
BROADCAST_BYTES = 1 << 24
SHARD_BYTES = 1 << 23


@dataclass
class Part:
    """Some neighbouring texts of a batch: rows a to b, their words and where these stand in data."""

    a: int
    b: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    tokens: np.ndarray
    salt: np.ndarray | None = None

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        at, h = anchors(self.tokens, self.bounds, length)
        return at, self.salted(h, at)

    def salted(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (h if self.salt is None else mix(h ^ self.salt[self.text_of(at)])) & EVEN


Reader = Callable[[pa.RecordBatch], Iterator[Part]]


def read_texts(batch: pa.RecordBatch) -> Iterator[Part]:
    data, offsets = utf8(batch.column("text"))
    for a, b in portions(offsets):
        starts, ends, bounds = words(data, offsets[a : b + 1])
        yield Part(a, b, data, offsets, starts, ends, bounds, word_hashes(data, starts, ends))


def by_bucket(h: np.ndarray, buckets: int, *more: np.ndarray) -> pa.RecordBatch:
    """Sorted hashes cut into `buckets` ranges of equal width, one row of packed bytes each; `more` is packed alongside."""
    edges = np.searchsorted(h, (np.arange(buckets + 1, dtype=object) * 2**64 // buckets)[1:-1].astype(np.uint64)) if buckets > 1 else np.zeros(0, np.int64)
    edges = np.concatenate([[0], edges, [len(h)]])
    use = [k for k in range(buckets) if edges[k] < edges[k + 1]]
    cells = [[x[edges[k] : edges[k + 1]].tobytes() for k in use] for x in (h, *more)]
    return pa.record_batch([pa.array(use, pa.int32()), *[pa.array(c, pa.binary()) for c in cells]], names=["bucket", *[f"c{i}" for i in range(len(cells))]])


def buckets_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shards_of(rows: DataFrame, column: str = "text") -> int:
    """By the bytes of all texts, so that no shard grows with the corpus; several for each task in any case."""
    total = rows.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(4 * buckets_of(rows) + 1, total // SHARD_BYTES + 1)


def by_shard(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, ...) with _row, a hash of both, and _shard. Steps that group by _shard read one shuffle of the texts."""
    return rows.withColumn("_row", F.xxhash64("doc_id", "text")).withColumn("_shard", F.pmod("_row", F.lit(shards_of(rows))).cast("int"))


def cells(column: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Packed numbers of all rows in a row, and how many each row has."""
    data, offsets = utf8(column)
    return data[offsets[0] : offsets[-1]].view(dtype), np.diff(offsets) // np.dtype(dtype).itemsize


def heads_of(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that are equal in all columns begins."""
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])) if len(columns[0]) else np.zeros(0, np.int64)


def pack(x: np.ndarray, heads: np.ndarray) -> pa.Array:
    return pa.array([x[a:b].tobytes() for a, b in zip(heads, np.append(heads[1:], len(x)))], pa.binary())


def recurring_by_shard(sharded: DataFrame, length: int, buckets: int, read: Reader = None) -> DataFrame:
    """(shard, c0): for each shard of by_shard() the hashes of those of its anchors that stand in two rows at least, wherever these are."""

    def collect(table: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.uint64)]
        for part in (read or read_texts)(table):
            at, h = part.anchors(length)
            text = part.text_of(at)
            order = np.lexsort((h, text))
            found.append(h[order][heads_of(h[order], text[order])])
        h, n = np.unique(np.concatenate(found), return_counts=True)
        out = pa.Table.from_batches([by_bucket(h | (n > 1).astype(np.uint64), buckets)])
        return out.append_column("shard", pa.array(np.full(out.num_rows, table.column("_shard")[0].as_py()), pa.int32()))

    def meet(table: pa.Table) -> pa.Table:
        h, size = cells(table.column("c0"), np.uint64)
        shard = np.repeat(np.asarray(table.column("shard")), size)
        order = np.argsort(h, kind="stable")
        h, shard = h[order], shard[order]
        heads = heads_of(h & EVEN)
        count = np.diff(np.append(heads, len(h)))
        ok = np.repeat((count > 1) | (h[np.append(heads[1:], len(h)) - 1] & U(1) > 0), count) if len(h) else np.zeros(0, bool)
        h, shard = h[ok] & EVEN, shard[ok]
        order = np.lexsort((h, shard))
        h, shard = h[order], shard[order]
        heads = heads_of(shard)
        return pa.table([pa.array(shard[heads], pa.int32()), pack(h, heads)], names=["shard", "c0"])

    return sharded.groupBy("_shard").applyInArrow(collect, "bucket int, c0 binary, shard int").groupBy("bucket").applyInArrow(meet, "shard int, c0 binary")


def among(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes are among those known, which are in order."""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def reach(part: Part, at: np.ndarray, length: int, window: int) -> np.ndarray:
    """How many windows starting before each anchor belong to it: a window belongs to its first recurring anchor."""
    if not len(at):
        return np.zeros(0, np.int64)
    text = part.text_of(at)
    before = np.full(len(at), -1)
    before[1:] = at[:-1]
    return np.minimum(np.minimum(window - length, at - before - 1), at - part.bounds[text])


def contexts(part: Part, at: np.ndarray, length: int, window: int) -> np.ndarray:
    """Row i: the words (32 bits each, 0 for none) from which all windows of anchor i are made; its own words begin at window - length."""
    back = window - length
    left = reach(part, at, length, window)
    text = part.text_of(at)
    place = np.arange(-back, window)
    where = at[:, None] + place
    ok = (place >= -left[:, None]) & (where < part.bounds[text + 1][:, None])
    small = (part.tokens >> U(32)).astype(np.uint32) | np.uint32(1)
    return np.where(ok, small[np.minimum(np.maximum(where, 0), len(small) - 1)], 0).astype(np.uint32)


def suffix_sort(context: np.ndarray, first: np.ndarray, second: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sort the suffixes that begin a window, by their leading `window` words: multikey quicksort, several words at a time.

    first: what must be equal besides the words; second: what orders equal windows. Returns, in sorted order, each
    suffix's row, its begin in the row, the number of its group of equal windows, and the window's hash.
    """
    back = window - length
    rows, width = context.shape if len(context) else (0, back + window)
    step = next(k for k in (10, 8, 6, 5, 4, 3, 2, 1) if window % k == 0)
    flat = gram_hashes(context.ravel().astype(np.uint64), step) if rows else np.zeros(0, np.uint64)
    flat = np.concatenate([flat, np.zeros(step - 1, np.uint64)])
    row, begin = np.nonzero((context[:, : back + 1] > 0) & (context[:, window - 1 :] > 0)) if rows else (np.zeros(0, np.int64),) * 2
    at = row * width + begin
    order = np.argsort(first[row], kind="stable")
    group = _groups(first[row][order])
    total = first[row].copy()
    for r in range(0, window, step):
        key = flat[at + r]
        total = mix(total * U(0x9E3779B97F4A7C15) ^ key)
        again = np.lexsort((key[order], group))  # groups stay together; each is split by its next words
        order = order[again]
        k, g = key[order], group[again]
        group = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]) | (g[1:] != g[:-1]))]) if len(k) else g
    again = np.lexsort((second[row][order], group))
    order = order[again]
    return row[order], begin[order], group[again], total[order]


def window_hashes(part: Part, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and hash, as suffix_sort gives it, of every window; the salt is what must be equal besides the words."""
    at = np.flatnonzero(inside(part.bounds, window))
    step = next(k for k in (10, 8, 6, 5, 4, 3, 2, 1) if window % k == 0)
    block = gram_hashes((part.tokens >> U(32)) | U(1), step)
    total = part.salt[part.text_of(at)]
    for r in range(0, window, step):
        total = mix(total * U(0x9E3779B97F4A7C15) ^ block[at + r])
    return at, total


def _groups(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x[1:] != x[:-1])]) if len(x) else np.zeros(0, np.int64)


def islands(spans: DataFrame, *keys: str) -> DataFrame:
    """Merge overlapping and touching spans [start_word, end_word) of equal keys."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy("start_word", "end_word")
    before = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce((F.col("start_word") > before).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("_island")
