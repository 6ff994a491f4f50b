"""Mixing sources to target weights by Sainte-Laguë apportionment.

The documents of a source stand in a seeded order and are cut into blocks of equal tokens: a document belongs to
the block in which its first token falls. The seats of a shard go to the sources of highest quotients
weight / (2 * seats held + 1), which gives each source an integer quota of blocks in every shard; a seeded Feistel
permutation of a source's blocks then says which block serves which shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut, pick, ship
from .sharding import permute

WORD = r"[^ \t\n\r\f\x0B]+"


def quotas(sources: DataFrame, seats: int) -> DataFrame:
    """(source, quota): the `seats` highest quotients of sources (source, weight); equal quotients go to the first source by name."""
    each = sources.where("weight > 0").withColumn("seat", F.explode(F.sequence(F.lit(0), F.lit(seats - 1))))
    each = each.withColumn("quotient", F.col("weight") / (F.col("seat") * 2 + 1))
    top = each.orderBy(F.col("quotient").desc(), "source", "seat").limit(seats)  # a distributed top-k
    return top.groupBy("source").agg(F.count("*").alias("quota"))


def plan(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.8, block_tokens: int = 512, shard_blocks: int = 100, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, block, shard) of the documents that the mixture takes.

    weights: by source, and a source that isn't named weighs nothing; without it a source weighs its number of tokens to the power of alpha (0: all the
    same, 1: nothing changes). As many shards are made as the scarcest source can fill, one at least (a source short of blocks then gives what it has).
    A source without a whole block takes no part, nor do the tokens after a source's last whole block. A source whose highest quotient isn't among
    the first `shard_blocks` has no seat, and none of its documents is taken; what the others have beyond the shards is left. dropped() tells how much. A null source is the
    empty name; a null text has no tokens, and such a document belongs to the block at whose place it stands. Documents are ordered
    by a hash of doc_id, then doc_id, then tokens; repeated rows each count; equal quotients go to the first source by name. An empty table gives no row. Other columns, whatever their names, are ignored.
    """
    return _plan(docs, weights, alpha, block_tokens, shard_blocks, seed).drop("_row")


def taken(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.8, block_tokens: int = 512, shard_blocks: int = 100, seed: int = 17) -> DataFrame:
    """The rows of docs that plan() takes, with all their columns; rows equal in doc_id, text and source are taken together.

    A null source is the empty name, a null text has no tokens, a null doc_id is an id like any other; an empty table gives no row. Texts are used whole. Columns
    stay as they are, whatever their names.
    """
    chosen = _plan(docs, weights, alpha, block_tokens, shard_blocks, seed).select("_row").distinct()
    places = [docs.columns.index(c) for c in ("doc_id", "text", "source")]
    flat = docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])
    kept = flat.withColumn("_row", F.xxhash64(*[F.col(f"_in{i}") for i in places])).join(chosen, "_row", "left_semi").drop("_row")
    return kept.toDF(*docs.columns)


def dropped(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.8, block_tokens: int = 512, shard_blocks: int = 100, seed: int = 17) -> DataFrame:
    """(source, n_docs, n_tokens, docs_dropped, tokens_dropped, share): what plan() leaves of every source; share of the source's tokens, 0 if it has none."""
    count = lambda rows, *names: rows.groupBy("source").agg(F.count("*").alias(names[0]), F.sum("n_tokens").alias(names[1]))
    whole = count(pick(docs, "text", "source").select(F.coalesce("source", F.lit("")).alias("source"), _tokens().alias("n_tokens")), "n_docs", "n_tokens")
    used = count(plan(docs, weights, alpha, block_tokens, shard_blocks, seed), "docs_used", "tokens_used")
    left = whole.join(used, "source", "left").withColumn("tokens_dropped", F.col("n_tokens") - F.coalesce("tokens_used", F.lit(0)))
    share = F.when(F.col("n_tokens") > 0, F.col("tokens_dropped") / F.col("n_tokens")).otherwise(0.0)
    return left.select("source", "n_docs", "n_tokens", (F.col("n_docs") - F.coalesce("docs_used", F.lit(0))).alias("docs_dropped"), "tokens_dropped", F.round(share, 6).alias("share"))


def _tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def _plan(docs: DataFrame, weights: dict[str, float] | None, alpha: float, block_tokens: int, shard_blocks: int, seed: int) -> DataFrame:
    ship(docs.sparkSession)
    rows = pick(docs, "doc_id", "text", "source").select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        _tokens().alias("n_tokens"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
        F.xxhash64("doc_id", "text", "source").alias("_row"),
    )
    rows = cut(rows.withColumn("slice", F.substring("key", 1, 3)))  # few bytes a document; 4096 runs of the order, so that no source is one task
    slices = rows.groupBy("source", "slice").agg(F.sum("n_tokens").alias("tokens"))
    of_source = Window.partitionBy("source")
    before = of_source.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source", "slice", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).withColumn("n_blocks", F.floor(F.col("tokens") / block_tokens).cast("bigint"))
    if weights is None:
        weight: Column = F.pow(F.col("tokens").cast("double"), F.lit(float(alpha)))
    elif weights:
        weight = F.coalesce(F.create_map(*[F.lit(x) for p in weights.items() for x in (p[0], float(p[1]))])[F.col("source")], F.lit(0.0))
    else:
        weight = F.lit(0.0)
    parts = totals.where("n_blocks > 0").withColumn("weight", weight)
    quota = parts.join(quotas(parts.select("source", "weight"), shard_blocks), "source").select("source", "n_blocks", "quota")
    shards = quota.agg(F.greatest(F.lit(1).cast("bigint"), F.min(F.floor(F.col("n_blocks") / F.col("quota")))).alias("n_shards"))
    quota = quota.crossJoin(F.broadcast(shards))  # one row
    inner = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(slices, ["source", "slice"])
    placed = placed.withColumn("block", F.floor((F.col("base") + F.col("inside")) / block_tokens)).join(quota, "source").where("block < n_blocks")

    @F.pandas_udf("bigint")
    def seat(block: pd.Series, n: pd.Series) -> pd.Series:
        out = np.empty(len(block), np.int64)
        n = n.to_numpy()
        for size in np.unique(n).tolist():
            at = np.flatnonzero(n == size)
            out[at] = permute(block.to_numpy()[at], size, seed)
        return pd.Series(out)

    done = placed.withColumn("shard", F.floor(seat("block", "n_blocks") / F.col("quota"))).where("shard < n_shards")
    return done.select("doc_id", "source", "n_tokens", "block", "shard", "_row")
