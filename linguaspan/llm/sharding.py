"""A reproducible global shuffle: a Feistel permutation with cycle walking over dense row numbers.

Rows are numbered in order of an id column; the permutation maps a row number to its place in the shuffled order,
and place p is slot p // n_shards of shard p % n_shards. Either direction can be computed for any single row from
(number of rows, seed) alone; shard sizes differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, pick, ship

PRIME, ROUNDS = 2**31 - 1, 8


def round_keys(seed: int) -> list[tuple[int, int]]:
    """A factor and an addend below PRIME for each round."""
    raw = np.random.Generator(np.random.PCG64(seed)).integers(1, PRIME, 2 * ROUNDS)
    return [(int(raw[2 * i]), int(raw[2 * i + 1])) for i in range(ROUNDS)]


def bits(n: int) -> int:
    """Width of the smallest domain, a power of two and 4 at least, that holds 0..n-1."""
    return max(2, int(max(n - 1, 1)).bit_length())


def _network(x: np.ndarray, width: int, keys: list[tuple[int, int]], back: bool) -> np.ndarray:
    low = width - width // 2
    left, right = x >> low, x & (1 << low) - 1
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        a, b = keys[i]
        half, size = (right, width - low) if i % 2 == 0 else (left, low)
        t = (half * a + b) % PRIME
        f = t * t % PRIME & (1 << size) - 1
        if i % 2 == 0:
            left = left ^ f
        else:
            right = right ^ f
    return left << low | right


def permute(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The place of each row number x in 0..n-1 (or, back, the row number at each place). Values that leave 0..n-1 walk on along their cycle."""
    if n > 1 << 62:
        raise ValueError("at most 2**62 rows")
    keys, width = round_keys(seed), bits(n)
    out = _network(np.asarray(x, np.int64), width, keys, back)
    while len(at := np.flatnonzero(out >= n)):
        out[at] = _network(out[at], width, keys, back)
    return out


def locate(shard: int, slot: int, n: int, n_shards: int, seed: int) -> int:
    """The row number in a slot of a shard."""
    return int(permute(np.array([slot * n_shards + shard]), n, seed, back=True)[0])


def shuffled(rows: DataFrame, n_shards: int = 64, seed: int = 17, id_column: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, row_number, place, shard, slot, and the carried columns) for every row.

    Rows are numbered from 0 in order of the id, nulls first; rows of equal id are numbered in order of a hash of the
    carried columns, and those that are equal in all are interchangeable, so the result is the same in every run. Null ids are rows like any others. An
    empty table gives no row. Columns that aren't carried, however long their texts, are neither read nor moved, and their names may clash. A carried column that bears the name
    of a result column is an error. Ids that are equal or null fall in one range, if nothing is carried that tells them apart; their rows are then a few bytes each.
    """
    names = ("row_number", "place", "shard", "slot")
    if n_shards < 1 or {id_column, *carry} & set(names):
        raise ValueError("n_shards must be positive, and the id and carried columns can't be named " + ", ".join(names))
    spark = rows.sparkSession
    ship(spark)
    slim = pick(rows, id_column, *carry).withColumn("_tie", F.xxhash64(*[F.col(c) for c in carry]) if carry else F.lit(0).cast("bigint"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.repartitionByRange(parts, F.col(id_column).asc_nulls_first(), "_tie").sortWithinPartitions(F.col(id_column).asc_nulls_first(), "_tie")
    # written once: the ranges, sampled by Spark, are then the same for the count and for the numbering
    ordered = cut(ordered.withColumn("_part", F.spark_partition_id()))
    sizes = dict(ordered.groupBy("_part").count().collect())  # a number for each partition
    n, begins, total = sum(sizes.values()), {}, 0
    for p in sorted(sizes):
        begins[p], total = total, total + sizes[p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            part = batch.column("_part").to_numpy()
            number = np.empty(len(part), np.int64)
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part == p)
                number[at] = begins[p] + seen.get(p, 0) + np.arange(len(at))
                seen[p] = seen.get(p, 0) + len(at)
            place = permute(number, n, seed)
            yield pa.record_batch([batch.column(id_column), *[pa.array(v) for v in (number, place, place % n_shards, place // n_shards)], *[batch.column(c) for c in carry]], names=[id_column, *names, *carry])

    schema = T.StructType([ordered.schema[id_column], *[T.StructField(c, T.LongType()) for c in names], *[ordered.schema[c] for c in carry]])
    return ordered.mapInArrow(run, schema)


def write_shards(rows: DataFrame, path: str, n_shards: int = 64, seed: int = 17, id_column: str = "doc_id", carry: tuple[str, ...] = ()) -> None:
    """Write the shuffled table as one folder for each shard, in order of the slots."""
    df = shuffled(rows, n_shards, seed, id_column, carry)
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
