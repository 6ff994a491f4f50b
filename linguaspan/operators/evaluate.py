"""Corpus scores of (id, hyp, refs): BLEU, chrF, RIBES."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grams
from ..functions import kernels as K
from ..functions import text as X
from ..runtime import ship


def _clipped(rows: DataFrame, orders: range) -> DataFrame:
    """(n, correct, total_hyp, total_ref): gram counts of the hypothesis, clipped by the greatest count in a reference.

    Counting and clipping stay inside a row, so only sums leave a task: a row for each order and batch. hyp and refs are strings (of characters) or arrays (of words).
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(orders), 3), np.int64)
        for batch in batches:
            for hyp, refs in zip(batch.column("hyp").to_pylist(), batch.column("refs").to_pylist()):
                sums += [grams.clipped(hyp or "", [r for r in refs or () if r is not None], n) for n in orders]
        yield pa.record_batch([pa.array(list(orders), pa.int32()), *[pa.array(sums[:, k]) for k in range(3)]], names=["n", "correct", "total_hyp", "total_ref"])

    parts = rows.select("hyp", "refs").mapInArrow(run, "n int, correct bigint, total_hyp bigint, total_ref bigint")
    return parts.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("correct", "total_hyp", "total_ref")])


def bleu(rows: DataFrame, lower: bool = False) -> DataFrame:
    """One row: bleu, p1..p4, brevity, ratio, hyp_length, ref_length; the reference length is the closest, of equally close ones the shorter."""
    words = lambda c: X.tokens(F.lower(c) if lower else c)
    rows = rows.select("id", words(F.col("hyp")).alias("hyp"), F.transform("refs", words).alias("refs"))
    close = F.array_min(F.transform("refs", lambda r: F.struct(F.abs(F.size(r) - F.size("hyp")).alias("d"), F.size(r).alias("n"))))["n"]
    lengths = rows.agg(F.sum(F.size("hyp")).alias("hyp_length"), F.sum(close).alias("ref_length"))
    p = _clipped(rows, range(1, 5)).groupBy().pivot("n", [1, 2, 3, 4]).agg(F.first(F.when(F.col("total_hyp") > 0, F.col("correct") / F.col("total_hyp")).otherwise(0.0)))
    one = p.crossJoin(lengths)  # one row each
    logs = sum((F.when(F.coalesce(F.col(str(n)), F.lit(0.0)) > 0, F.ln(F.col(str(n)))).otherwise(F.lit(-9999999999.0)) for n in range(1, 5)), F.lit(0.0))
    brevity = F.when(F.col("hyp_length") >= F.col("ref_length"), 1.0).when(F.col("hyp_length") > 0, F.exp(1 - F.col("ref_length") / F.col("hyp_length"))).otherwise(0.0)
    score = F.when(F.col("ref_length") > 0, 100 * brevity * F.exp(logs / 4)).otherwise(0.0)
    return one.select(F.round(score, 4).alias("bleu"), *[F.round(100 * F.coalesce(F.col(str(n)), F.lit(0.0)), 4).alias(f"p{n}") for n in range(1, 5)], F.round(brevity, 4).alias("brevity"), F.round(F.col("hyp_length") / F.col("ref_length"), 4).alias("ratio"), "hyp_length", "ref_length")


def chrf(rows: DataFrame, order: int = 6, beta: float = 3.0, space: bool = False) -> DataFrame:
    """One row: chrf, precision, recall over character n-grams; orders without n-grams count as 0."""
    plain = lambda c: c if space else F.regexp_replace(c, X.BLANK, "")
    rows = rows.select("id", plain(F.col("hyp")).alias("hyp"), F.transform("refs", plain).alias("refs"))
    sums = _clipped(rows, range(1, order + 1)).agg(
        (F.sum(F.coalesce(F.col("correct") / F.col("total_hyp"), F.lit(0.0))) / order).alias("p"), (F.sum(F.coalesce(F.col("correct") / F.col("total_ref"), F.lit(0.0))) / order).alias("r")
    )
    p, r, b = F.coalesce("p", F.lit(0.0)), F.coalesce("r", F.lit(0.0)), beta * beta
    return sums.select(F.round(F.when(p + r > 0, 100 * (1 + b) * p * r / (b * p + r)).otherwise(0.0), 4).alias("chrf"), F.round(100 * p, 4).alias("precision"), F.round(100 * r, 4).alias("recall"))


def ribes(rows: DataFrame, alpha: float = 0.25, beta: float = 0.10, case: bool = False) -> DataFrame:
    """(id, ribes): best over the references; a sentence without a reference that isn't empty is left out. Average it for the corpus."""
    ship(rows.sparkSession)
    words = lambda c: X.tokens(c if case else F.lower(c))
    f = K.arrow(lambda h, r: round(max(K.ribes(list(h), list(x), alpha, beta) for x in r if len(x)), 6), "double")
    rows = rows.select("id", words(F.col("hyp")).alias("hyp"), F.filter(F.transform("refs", words), lambda r: F.size(r) > 0).alias("refs")).where(F.size("refs") > 0)
    return rows.select("id", f("hyp", "refs").alias("ribes"))
