"""Word vectors: training pairs, subsampling, negatives, pooling, nearest words; and learned merges for subwords."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import merges as M
from ..functions import text as X
from ..runtime import cut, ship


def context_windows(lines: DataFrame, id_column: str, window: int = 5) -> DataFrame:
    """(id, pos, centre, context): up to `window` words on each side."""
    left = F.slice("words", F.greatest(F.col("pos") + 1 - window, F.lit(1)), F.least(F.col("pos"), F.lit(window)))
    right = F.slice("words", F.col("pos") + 2, F.lit(window))
    return lines.select(id_column, "words", F.posexplode("words").alias("pos", "centre")).select(id_column, "pos", "centre", F.concat(left, right).alias("context"))


def sentence_contexts(lines: DataFrame, id_column: str) -> DataFrame:
    """(id, pos, centre, context): the sentence without its centre."""
    rest = F.concat(F.slice("words", F.lit(1), F.col("pos")), F.slice("words", F.col("pos") + 2, F.size("words")))
    return lines.select(id_column, "words", F.posexplode("words").alias("pos", "centre")).select(id_column, "pos", "centre", rest.alias("context"))


def keep_probability(freq: DataFrame) -> DataFrame:
    """(word, freq, keep): 1e-3 / p * (1 + sqrt(1000 p)), 1 at most, p the word's share."""
    total = freq.agg(F.sum("freq").alias("total"))
    p = F.col("freq") / F.col("total")
    return freq.crossJoin(F.broadcast(total)).select("word", "freq", F.round(F.least(F.lit(1.0), 0.001 / p * (1 + F.sqrt(1000 * p))), 6).alias("keep"))  # total is one row


def subsampled(lines: DataFrame, id_column: str, seed: int = 12345) -> DataFrame:
    """(id, pos, word) of the words that stay, by a hash of place and seed."""
    freq = lines.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    rows = lines.select(id_column, F.posexplode("words").alias("pos", "word")).join(keep_probability(freq).select("word", "keep"), "word")
    return rows.where(F.pmod(F.xxhash64(id_column, "pos", F.lit(seed)), F.lit(1000000)) < F.col("keep") * 1000000).select(id_column, "pos", "word")


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits scattered (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STEP = 0x9E3779B97F4A7C15
PLACES = 1 << 16  # windows that are made at a time


def drawn(keys: np.ndarray, bad: np.ndarray, size: int, n: int) -> np.ndarray:
    """A row of n numbers of 1..size-1 for each key, that aren't in its row of bad; zeros where all are bad. The t-th draw is a hash of key and t, bad ones are passed over."""
    each = np.sort(np.where((bad >= 1) & (bad < size), bad, 0), axis=1)
    free = size - 1 - ((each[:, :1] > 0).sum(1) + ((each[:, 1:] > 0) & (each[:, 1:] != each[:, :-1])).sum(1))
    out, got, t, left = np.zeros((len(keys), n), np.int32), np.zeros(len(keys), np.int64), 0, np.flatnonzero(free > 0) if n else []
    while len(left):
        k = (mixed(keys[left] + np.uint64(t * STEP & (1 << 64) - 1)) % np.uint64(size - 1)).astype(np.int64) + 1
        good = left[ok := (bad[left] != k[:, None]).all(1)]
        out[good, got[good]] = k[ok]
        got[good] += 1
        left, t = left[got[left] < n], t + 1
    return out


def negatives(rows: DataFrame, size: int, n: int = 10, window: int = 5, seed: int = 12345, id_column: str = "id") -> DataFrame:
    """(id, pos, centre, context, negatives) of rows (id, words as vocabulary numbers): windows as those of context_windows, with n numbers of 1..size-1 outside centre and context; none if the vocabulary has no others."""
    ship(rows.sparkSession)
    near, places = np.array([d for d in range(-window, window + 1) if d]), PLACES

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(words), 0), np.int64)
            flat, row = np.asarray(words.flatten(), np.int64), np.repeat(np.arange(len(sizes)), sizes)
            begin = np.cumsum(sizes) - sizes
            keys = np.asarray(batch.column("_key")).astype(np.uint64)
            for lo in range(0, len(flat), places):
                r, centre = row[lo : lo + places], flat[lo : lo + places]
                pos = np.arange(lo, lo + len(r)) - begin[r]
                there = (pos[:, None] + near >= 0) & (pos[:, None] + near < sizes[r][:, None])
                around = np.where(there, flat[np.clip(np.arange(lo, lo + len(r))[:, None] + near, 0, len(flat) - 1)], 0)
                found = drawn(mixed(keys[r] + pos.astype(np.uint64) * np.uint64(STEP)), np.column_stack([centre, around]), size, n)
                some = (found > 0).all(1) if n else np.zeros(len(r), bool)
                yield pa.record_batch([batch.column(id_column).take(pa.array(r)), pa.array(pos, pa.int32()), pa.array(centre, pa.int32()), lists(around[there], there.sum(1)), lists(found[some].ravel(), some * n)], names=[id_column, "pos", "centre", "context", "negatives"])

    schema = T.StructType([rows.schema[id_column], *T._parse_datatype_string("pos int, centre int, context array<int>, negatives array<int>")])
    return rows.select(id_column, "words", F.xxhash64(id_column, F.lit(seed)).alias("_key")).mapInArrow(run, schema)


def weighted_negatives(freq: DataFrame, n: int, seed: int = 12345) -> DataFrame:
    """(word, draws): n draws with chances in proportion to freq^0.75, each word's share rounded by a seeded hash."""
    total = freq.agg(F.sum(F.pow("freq", F.lit(0.75))).alias("total"))
    share = F.pow("freq", F.lit(0.75)) / F.col("total") * n
    luck = F.pmod(F.xxhash64("word", F.lit(seed)), F.lit(1000000)) / 1000000.0
    return freq.crossJoin(F.broadcast(total)).select("word", (F.floor(share) + F.when(luck < share - F.floor(share), 1).otherwise(0)).cast("bigint").alias("draws"))  # total is one row


def pooled(tokens: DataFrame, vectors: DataFrame, id_column: str, how: str = "avg") -> DataFrame:
    """(id, embedding): tokens (id, word) joined with vectors (word, embedding) and pooled by avg, sum or max in each dimension."""
    fold = {"avg": F.avg, "sum": F.sum, "max": F.max}[how]
    each = tokens.join(vectors, "word").select(id_column, F.posexplode("embedding").alias("d", "v")).groupBy(id_column, "d").agg(F.round(fold("v"), 6).alias("v"))
    return each.groupBy(id_column).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("embedding"))


def averaged_subwords(rows: DataFrame, id_column: str) -> DataFrame:
    """(id, word_no, weight): weights of `##` pieces averaged with those of the word they belong to; rows (id, pos, piece, weight)."""
    word = F.sum(F.when(F.col("piece").startswith("##"), 0).otherwise(1)).over(Window.partitionBy(id_column).orderBy("pos"))
    return rows.withColumn("word_no", word).groupBy(id_column, "word_no").agg(F.round(F.avg("weight"), 6).alias("weight"))


def nearest(vectors: DataFrame, k: int = 5, distance: str = "cos", queries: DataFrame | None = None) -> DataFrame:
    """(id, other, score, rank): each query's k nearest others, by cosine (falling) or Euclidean distance (rising). vectors: (id, embedding); queries: all of them unless given."""
    from .match import exact_knn

    found = exact_knn(vectors if queries is None else queries, vectors, k, -1.0, 9.9, distance=distance, others=True)
    return found.select(F.col("query_id").alias("id"), F.col("db_id").alias("other"), "score", "rank")


def train_vectors(lines: DataFrame, size: int = 300, window: int = 5, least: int = 5, seed: int = 12345) -> DataFrame:
    """(word, embedding) by Spark's skip-gram with hierarchical softmax; the objective isn't negative sampling."""
    from pyspark.ml.feature import Word2Vec

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=least, seed=seed, inputCol="words", outputCol="v").fit(lines.select("words"))
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select("word", vector_to_array("vector").cast("array<float>").alias("embedding"))


FALL = 4  # from each round of learn_merges to the next, the least count is divided by this
BLOCK = 1 << 22  # symbols of words that are one array


def learn_merges(freq: DataFrame, symbols: int = 32000, least: int = 1) -> DataFrame:
    """(rank, left, right, n): byte-pair merges of words (word, freq); each merges the most frequent pair of neighbouring symbols, ties by the pair.

    A merge depends on all before it, so rounds are learnt: each of all merges whose pair is there at least so many times. No rarer pair can become part of one of them,
    so all words are cut between such neighbours, and one task has the different parts that are left, with their frequencies; then all words, in blocks dealt to all
    tasks, are merged likewise. The same merges come out as if one task had all words.
    """
    spark = freq.sparkSession
    ship(spark)
    size, schema = BLOCK, "syms binary, freqs binary"

    def block(syms: np.ndarray, freqs: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([syms.tobytes()], pa.binary()), pa.array([freqs.tobytes()], pa.binary())], names=["syms", "freqs"])

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for syms, freqs in zip(*b.columns):
                yield np.frombuffer(syms.as_buffer(), np.int32), np.frombuffer(freqs.as_buffer(), np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        syms, freqs = [], []
        for b in batches:
            words = b.column("word")
            syms.append(M.numbered("".join(words.to_pylist()), np.asarray(pc.utf8_length(words), np.int64))[1:])
            freqs.append(np.asarray(b.column("freq"), np.int64))
            if sum(map(len, syms)) >= size:
                yield block(np.concatenate([[np.int32(0)], *syms]), np.concatenate(freqs))
                syms, freqs = [], []
        if syms:
            yield block(np.concatenate([[np.int32(0)], *syms]), np.concatenate(freqs))

    def apply(merges: list[tuple[int, int, int]]):
        return lambda batches: (block(M.applied(syms, merges), freqs) for syms, freqs in arrays(batches))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for syms, freqs in arrays(batches):
            yield pa.record_batch([pa.array(x, pa.int64()) for x in M.pair_counts(syms, freqs)], names=["pair", "n"])

    def cut_up(common: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for syms, freqs in arrays(batches):
                flat, sizes, n = M.chains(syms, freqs, common)
                ends = np.concatenate([[0], np.cumsum(sizes * 4)]).astype(np.int32)
                yield pa.record_batch([pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))]), pa.array(n, pa.int64())], names=["part", "n"])

        return run

    def learn(most: int, least: int, made: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            syms, freqs = [np.zeros(1, np.int32)], [np.zeros(0, np.int64)]
            for b in batches:
                ends = np.asarray(pc.cumulative_sum(pc.binary_length(b.column("part"))), np.int64) // 4
                flat = np.frombuffer(b"".join(b.column("part").to_pylist()), np.int32)
                syms.append(np.insert(flat, ends, 0))
                freqs.append(np.asarray(b.column("n"), np.int64))
            found = list(M.learnt(np.concatenate(syms), np.concatenate(freqs), most, least, made))
            yield pa.record_batch([pa.array([m[i] for m in found], pa.int64()) for i in range(3)], names=["left", "right", "n"])

        return run

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = cut(freq.select("word", F.col("freq").cast("bigint").alias("freq")).where("length(word) > 1").repartition(parts, "word").mapInArrow(pack, schema))
    merges, names, rows, least = [], [], [], max(least, 1)
    name = lambda k: names[k - M.FIRST] if k >= M.FIRST else chr(k - 1)
    pairs = lambda: words.mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    now = max(-(-(pairs().agg(F.max("n")).first()[0] or 0) // FALL), least)
    while len(rows) < symbols and now:
        if merges:
            words = cut(words.mapInArrow(apply(merges), schema))
        common = np.sort(np.array([r.pair for r in pairs().where(F.col("n") >= now).select("pair").collect()], np.int64))
        merges = []
        if len(common):
            chains = words.mapInArrow(cut_up(common), "part binary, n bigint").groupBy("part").agg(F.sum("n").alias("n"))
            for r in chains.repartition(1).mapInArrow(learn(symbols - len(rows), now, names), "left bigint, right bigint, n bigint").collect():
                rows.append((len(rows), name(r.left), name(r.right), r.n))
                merges.append((r.left, r.right, M.FIRST + len(names)))
                names.append(rows[-1][1] + rows[-1][2])
        now = max(now // FALL, least) if now > least else 0
    return spark.createDataFrame(rows, "rank int, left string, right string, n bigint")
