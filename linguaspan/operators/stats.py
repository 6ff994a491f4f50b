"""Corpus statistics over (id, words) tables, where words is an array: counts, frequencies, OOV, idf and tf-idf."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..runtime import cut, ship


def corpus_stats(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_lines, n_words, vocabulary, mean_length, min_length, max_length)."""
    sizes = lines.groupBy(*keys).agg(F.count("*").alias("n_lines"), F.sum(F.size("words")).cast("bigint").alias("n_words"), F.round(F.avg(F.size("words")), 6).alias("mean_length"), F.min(F.size("words")).cast("bigint").alias("min_length"), F.max(F.size("words")).cast("bigint").alias("max_length"))
    types = lines.select(*keys, F.explode("words").alias("word")).distinct().groupBy(*keys).agg(F.count("*").alias("vocabulary"))
    if not keys:
        return sizes.crossJoin(types)
    return sizes.join(types, list(keys), "left").withColumn("vocabulary", F.coalesce("vocabulary", F.lit(0).cast("bigint")))


def word_freq(lines: DataFrame, *keys: str) -> DataFrame:
    return lines.select(*keys, F.explode("words").alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("freq"))


def oov(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: types and tokens of test that train lacks, and how many test sentences stand in train; both have `words` and `text`."""
    known = word_freq(train).select("word")
    types = word_freq(test).join(known, "word", "left_anti").agg(F.count("*").alias("oov_types"), F.coalesce(F.sum("freq"), F.lit(0)).cast("bigint").alias("oov_tokens"))
    seen = test.join(train.select("text").distinct(), "text", "left_semi").agg(F.count("*").alias("seen_sentences"))
    return types.crossJoin(seen)


def document_frequency(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def idf(lines: DataFrame) -> DataFrame:
    """(word, df, idf): ln(sentences / (1 + df))."""
    n = lines.agg(F.count("*").alias("n"))
    return document_frequency(lines).crossJoin(F.broadcast(n)).select("word", "df", F.round(F.ln(F.col("n") / (F.col("df") + 1)), 6).alias("idf"))  # n is one row


def token_tfidf(lines: DataFrame, model: DataFrame, id_column: str, tf: bool = True) -> DataFrame:
    """(id, word, tf, tfidf) of each sentence's distinct words; a word that the model lacks has idf 0."""
    counts = lines.select(id_column, F.explode("words").alias("word")).groupBy(id_column, "word").agg(F.count("*").alias("tf"))
    weight = F.col("tf") if tf else F.lit(1)
    return counts.join(model.select("word", "idf"), "word", "left").select(id_column, "word", "tf", F.round(weight * F.coalesce("idf", F.lit(0.0)), 6).alias("tfidf"))


def vocabulary(lines: DataFrame, least: int = 5, most: int = 0) -> DataFrame:
    """(idx, word, freq): <unk> is 0, then by falling frequency and by word; of `least` occurrences at least, `most` entries in all (0: no bound).

    Equal frequencies are numbered together: their counts make the offsets, so no partition holds the whole vocabulary.
    """
    freq = word_freq(lines).where(F.col("freq") >= least)
    steps = freq.groupBy("freq").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.col("freq").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each different frequency
    inside = F.row_number().over(Window.partitionBy("freq").orderBy("word"))
    ranked = freq.join(steps.select("freq", before.alias("_before")), "freq").select((F.col("_before") + inside).cast("bigint").alias("idx"), "word", "freq")
    unk = lines.sparkSession.createDataFrame([(0, "<unk>", 0)], "idx bigint, word string, freq bigint")
    out = unk.unionByName(ranked)
    return out.where(F.col("idx") < most) if most else out


def encode(lines: DataFrame, vocab: DataFrame, id_column: str) -> DataFrame:
    """(id, pos, idx): unknown words are 0."""
    return lines.select(id_column, F.posexplode("words").alias("pos", "word")).join(vocab.select("word", "idx"), "word", "left").select(id_column, "pos", F.coalesce("idx", F.lit(0).cast("bigint")).alias("idx"))


SHARD_WORDS = 1 << 19  # words of a shard, about


def encoded_rows(lines: DataFrame, vocab: DataFrame, id_column: str) -> DataFrame:
    """(id, words): each row's words as vocabulary numbers, unknown ones 0; rows without words go.

    Rows are dealt to shards of about SHARD_WORDS words, once. A shard asks for its different words, so a word goes to the vocabulary once a shard and not once a place.
    """
    spark = lines.sparkSession
    ship(spark)
    rows = lines.where(F.size("words") > 0).select(id_column, "words")
    n = max(1, math.ceil((rows.agg(F.sum(F.size("words")).alias("n")).first().n or 0) / SHARD_WORDS))
    dealt = rows.select(F.pmod(F.xxhash64(id_column, "words"), F.lit(n)).cast("int").alias("shard"), id_column, F.array_join("words", " ").alias("text")).repartition(n, "shard")

    def types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in pc.unique(batch.column("shard")):
                words = pc.unique(pc.split_pattern(batch.column("text").filter(pc.equal(batch.column("shard"), shard)), " ").flatten())
                yield pa.record_batch([pa.array([shard.as_py()] * len(words), pa.int32()), words], names=["shard", "word"])

    def numbered(texts: pa.Table, known: pa.Table) -> pa.Table:
        words = pc.split_pattern(texts.column("text").combine_chunks(), " ")
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        at = pc.index_in(words.flatten(), value_set=known.column("word").combine_chunks())
        numbers = pc.fill_null(known.column("idx").combine_chunks().take(at), 0) if len(known) else pa.array(np.zeros(len(at), np.int32))
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(words), np.int64))])
        return pa.table([texts.column(id_column), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), numbers)], names=[id_column, "words"])

    known = dealt.select("shard", "text").mapInArrow(types, "shard int, word string").distinct().join(vocab.where("idx > 0").select("word", F.col("idx").cast("int").alias("idx")), "word")
    schema = T.StructType([lines.schema[id_column], T.StructField("words", T.ArrayType(T.IntegerType()))])
    return dealt.groupBy("shard").cogroup(known.select("shard", "word", "idx").groupBy("shard")).applyInArrow(numbered, schema)


def oov_rate(encoded: DataFrame) -> DataFrame:
    return encoded.agg(F.count("*").alias("n_tokens"), F.round(F.avg(F.when(F.col("idx") == 0, 100.0).otherwise(0.0)), 6).alias("oov_percent"))


def domain_tfidf(lines: DataFrame, tag: str, most: int = 0, form: str = "ratio", digits: int = 6) -> DataFrame:
    """(tag, word, tfidf), each tag's vector of length 1. A word's idf is ln(D / N), N the number of tags with it; form `product` is ln(D * N)."""
    freq = cut(word_freq(lines, tag))  # read by several steps
    if most:
        top = freq.groupBy("word").agg(F.sum("freq").alias("n")).orderBy(F.col("n").desc(), "word").limit(most)
        freq = freq.join(top.select("word"), "word", "left_semi")
    totals = freq.groupBy(tag).agg(F.sum("freq").alias("total"))
    n_tags = totals.agg(F.count("*").alias("d"))
    spread = freq.groupBy("word").agg(F.count("*").alias("n"))
    ratio = F.col("d") / F.col("n") if form == "ratio" else F.col("d") * F.col("n")
    value = freq.join(spread, "word").join(totals, tag).crossJoin(F.broadcast(n_tags)).withColumn("v", F.col("freq") / F.col("total") * F.ln(ratio))  # n_tags is one row
    norm = F.col("norm")
    value = value.join(value.groupBy(tag).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")), tag)
    return value.select(tag, "word", F.round(F.when(norm > 0, F.col("v") / norm).otherwise(F.lit(0.0)), digits).alias("tfidf"))


def domain_similarity(model: DataFrame, test: DataFrame, tag: str, id_column: str) -> DataFrame:
    """(id, tag, cosine, rank) of each test text's counts with each tag's vector. A text without a known word has cosine 0 with all. The model is made once, for three steps."""
    model = cut(model)
    counts = test.select(id_column, F.explode("words").alias("word")).groupBy(id_column, "word").agg(F.count("*").alias("tf")).join(model.select("word").distinct(), "word", "left_semi")
    norm = counts.groupBy(id_column).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    sums = counts.join(model, "word").groupBy(id_column, tag).agg(F.sum(F.col("tf") * F.col("tfidf")).alias("dot"))
    every = test.select(id_column).distinct().crossJoin(model.select(tag).distinct())  # the result has every text with every tag
    scored = every.join(sums, [id_column, tag], "left").join(norm, id_column, "left").withColumn("cosine", F.round(F.coalesce(F.col("dot") / F.col("norm"), F.lit(0.0)), 4))
    rank = F.row_number().over(Window.partitionBy(id_column).orderBy(F.col("cosine").desc(), tag))
    return scored.select(id_column, tag, "cosine", rank.cast("bigint").alias("rank"))


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, percent, running): running totals in order of the value."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each different value
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4)).withColumn("running", F.sum("n").over(w))
