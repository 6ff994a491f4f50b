"""A corpus pipeline: language ID, near duplicates, repeated passages, source mixture, SentencePiece. Counted as part of the subpackage llm.

Each stage works on all rows that the one before it kept, reread from Parquet in the folder that all machines share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from linguaspan.llm import language_id, mixing, phrase_automata, pieces, queries, signature_trees
from linguaspan.runtime import remove, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a profile recognises; null, empty and letterless texts go, a null id stays."""
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the lowest id; rows without an id, text or words stay."""
    return signature_trees.one_of_each(docs, queries.THRESHOLD, queries.GRAM, queries.BANDS, queries.ROWS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document of lower doc_id has; texts of which nothing is left go, rows without an id or text stay."""
    return phrase_automata.without_repeats(docs, queries.MIN_WORDS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, each source weighed by its tokens to the power of ALPHA; a null source is the empty name."""
    return mixing.taken(docs, None, queries.ALPHA, queries.BLOCK_TOKENS, queries.SHARD_BLOCKS, queries.SEED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids, decoded again and compared; a null text has null ids."""
    return pieces.encode(docs)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("mixing sources", mixture), ("SentencePiece", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir.

    Each stage is written and read again; what one has written is deleted once the next is there, and the last one's rows stay in the shared folder. Null ids and texts,
    empty texts, repeated rows and an empty table are handled as each stage's operator says: language ID drops null, empty and letterless texts, the others keep rows without
    an id. Columns beyond those of documents are carried up to the last stage.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
