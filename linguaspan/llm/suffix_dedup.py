"""Suffix-array deduplication: suffixes, range-partitioned by sampled splitters, sorted locally, compared across boundaries.

A suffix whose first words don't recur can't begin a repeat and is left out before the sort: only suffixes around
recurring anchors go on, with the words that decide. They are range-partitioned by their leading words (Spark samples the
splitters), so a hot passage may span several buckets. Each bucket sorts its suffixes by multikey quicksort; equal
neighbours are repeats. The first and the last run of each bucket may go on in the next, so these are compared across all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, pick, ship
from .repeats import among, buckets_of, by_shard, cells, contexts, islands, read_texts, recurring_by_shard, suffix_sort

KIND = pa.schema([("lead", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("context", pa.binary())])
SCHEMA = "lead bigint, h bigint, doc_id bigint, at int, context binary"


def duplicates(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, start_word, end_word, first_copy): maximal spans of words that lie in windows of min_words words which stand in two documents at least.

    first_copy: no document of lower doc_id has these windows; spans that aren't first copies can be removed without losing
    a text. Words are separated by white space; texts of fewer than min_words words have no window. Null and empty texts and
    rows with a null doc_id are left out; rows of one doc_id are one document, so repeated rows are no repeats. An empty table
    gives no row. Texts are used whole, however long. Other columns are ignored.
    """
    if min_words < 8:
        raise ValueError("min_words must be 8 at least")
    length = (min_words + 1) // 2
    ship(docs.sparkSession)
    rows = pick(docs, "doc_id", "text").where("doc_id is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    sharded, back = by_shard(rows), min_words - length

    def emit(table: pa.Table, known: pa.Table) -> pa.Table:
        anchors = np.sort(cells(known.column("c0"), np.uint64)[0])
        ids, out = np.asarray(table.column("doc_id")), [pa.table({f.name: pa.array([], f.type) for f in KIND}, KIND)]
        for part in read_texts(table) if len(anchors) else ():
            at, h = part.anchors(length)
            ok = among(anchors, h)
            at, h = at[ok], h[ok]
            for lo in range(0, len(at), 1 << 14):
                a = at[lo : lo + (1 << 14)]
                text = part.text_of(a)
                c = _slice(part, at, lo, length, min_words)
                lead = (c[:, back].astype(np.int64) << 31) | (c[:, back + 1] >> 1)
                packed = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(np.arange(len(c) + 1, dtype=np.int32) * np.int32(c.shape[1] * 4)), pa.py_buffer(np.ascontiguousarray(c))])
                out.append(pa.table([pa.array(lead), pa.array(h[lo : lo + (1 << 14)].view(np.int64)), pa.array(ids[part.a + text]), pa.array((a - part.bounds[text]).astype(np.int32)), packed], KIND))
        return pa.concat_tables(out)

    # Spark samples the splitters from the suffixes; the texts' shuffle, on which these rest, is there by then
    suffixes = sharded.groupBy("_shard").cogroup(recurring_by_shard(sharded, length, buckets_of(docs)).groupBy("shard")).applyInArrow(emit, SCHEMA)
    ranged = suffixes.repartitionByRange(buckets_of(docs), "lead", "h", "doc_id")

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        table = pa.Table.from_batches(batches) if batches else None
        if table is None or not table.num_rows:
            return
        width = back + min_words
        h, doc, at, lead = (np.asarray(table.column(c)) for c in ("h", "doc_id", "at", "lead"))
        context = np.frombuffer(b"".join(table.column("context").to_pylist()), np.uint32).reshape(-1, width)
        # the runs that may go on in another bucket: those of the least and the greatest (lead, anchor)
        order = np.lexsort((h, lead))
        edge = np.isin(h, h[order[[0, -1]]])
        row, begin, group, window = suffix_sort(context, h.view(np.uint64), doc, length, min_words)
        start = at[row] - back + begin
        is_edge = edge[row]
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        tails = np.append(heads[1:], len(group)) - 1
        low, high = doc[row[heads]], doc[row[tails]]  # equal windows are in order of doc_id
        size = np.diff(np.append(heads, len(group)))
        repeat, first = np.repeat(low != high, size), np.repeat(low, size) == doc[row]
        keep = repeat & ~is_edge
        yield _runs(doc[row[keep]], start[keep], first[keep], min_words)
        e = np.flatnonzero(is_edge)
        for lo in range(0, len(e), 1 << 16):
            k = e[lo : lo + (1 << 16)]
            yield _batch(doc[row[k]], start[k], start[k] + min_words, np.zeros(len(k), bool), window[k].view(np.int64))

    found = cut(ranged.mapInArrow(bucket, "doc_id bigint, start_word int, end_word int, first_copy boolean, window bigint"))
    edges = found.where("window is not null")
    meet = edges.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    across = edges.join(meet, "window").select("doc_id", "start_word", "end_word", (F.col("doc_id") == F.col("low")).alias("first_copy"))
    return islands(found.where("window is null").drop("window").unionByName(across), "doc_id", "first_copy").select("doc_id", "start_word", "end_word", "first_copy")


def _slice(part, at: np.ndarray, lo: int, length: int, window: int) -> np.ndarray:
    """The contexts of some anchors: the one before the first is needed too, as windows go to their first anchor."""
    skip = 1 if lo else 0
    return contexts(part, at[lo - skip : lo + (1 << 14)], length, window)[skip:]


def _batch(doc: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, window: np.ndarray | None) -> pa.RecordBatch:
    w = pa.nulls(len(doc), pa.int64()) if window is None else pa.array(window)
    return pa.record_batch([pa.array(doc, pa.int64()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(first, pa.bool_()), w], names=["doc_id", "start_word", "end_word", "first_copy", "window"])


def _runs(doc: np.ndarray, start: np.ndarray, first: np.ndarray, window: int) -> pa.RecordBatch:
    """One row for windows that begin at neighbouring words."""
    order = np.lexsort((start, first, doc))
    doc, start, first = doc[order], start[order], first[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | (start[1:] > start[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1 if len(heads) else heads
    return _batch(doc[heads], start[heads], start[tails] + window, first[heads], None)
