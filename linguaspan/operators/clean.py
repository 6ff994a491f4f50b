"""Cleaning, de-duplication and splits of bitext (pair_id, src, tgt)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def reasons(pairs: DataFrame, least: int = 1, most: int = 99, longest_word: int = 99, fertility: float = 6.0, equals: bool = True, unique: bool = True, mode: str = "space", order: str = "pair_id") -> DataFrame:
    """pairs with `reason`: the first rule that drops the pair (equals, min, max, maxw, fert, uniq), or null; a rule set to 0 is off.

    unique keeps the first of equal pairs that no other rule drops, in order of `order`.
    """
    s, t = X.tokens(F.coalesce("src", F.lit("")), mode), X.tokens(F.coalesce("tgt", F.lit("")), mode)
    low, high = F.least(F.size(s), F.size(t)), F.greatest(F.size(s), F.size(t))
    widest = F.coalesce(F.array_max(F.transform(F.concat(s, t), lambda w: F.length(w))), F.lit(0))
    rules = [(equals, s == t, "equals"), (least, low < least, "min"), (most, high > most, "max"), (longest_word, widest > longest_word, "maxw"), (fertility, (low > 0) & (high / low > fertility), "fert")]
    reason = F.lit(None).cast("string")
    for on, test, name in reversed(rules):
        if on:
            reason = F.when(test, F.lit(name)).otherwise(reason)
    out = pairs.withColumn("reason", reason)
    if unique:
        first = F.row_number().over(Window.partitionBy("reason", "src", "tgt").orderBy(order))
        out = out.withColumn("reason", F.when(F.col("reason").isNull() & (first > 1), F.lit("uniq")).otherwise(F.col("reason")))
    return out


def clean(pairs: DataFrame, **options) -> DataFrame:
    return reasons(pairs, **options).where("reason is null").drop("reason")


def report(pairs: DataFrame, **options) -> DataFrame:
    """(reason, n, share): kept pairs have the reason `kept`."""
    counts = reasons(pairs, **options).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a handful of rows


def shuffled(rows: DataFrame, seed: int, id_column: str) -> DataFrame:
    """rows with `_order`, a key by which sorting shuffles them reproducibly; with seed 0 it is the id itself."""
    return rows.withColumn("_order", F.col(id_column) if seed == 0 else F.xxhash64(id_column, F.lit(seed)))


def split_sets(rows: DataFrame, sizes: list[tuple[str, int]], remain: str = "trn", seed: int = 0, id_column: str = "pair_id") -> DataFrame:
    """rows with set_name: consecutive slices of the given sizes; what is left is `remain`. The slices' rows alone are ordered: a distributed top-k."""
    total = sum(n for _, n in sizes)
    keyed = shuffled(rows, seed, id_column)
    head = keyed.select(id_column, "_order").orderBy("_order", id_column).limit(total)
    place = F.row_number().over(Window.orderBy("_order", id_column))  # over the slices only
    bound, cases = 0, None
    for label, n in sizes:
        bound += n
        cases = F.when(F.col("_place") <= bound, F.lit(label)) if cases is None else cases.when(F.col("_place") <= bound, F.lit(label))
    named = head.withColumn("_place", place).select(id_column, cases.alias("set_name"))
    return rows.join(named, id_column, "left").withColumn("set_name", F.coalesce("set_name", F.lit(remain)))


def split_by_map(rows: DataFrame, names: DataFrame, id_column: str, remain: str = "trn") -> DataFrame:
    """rows with set_name from names (id, set_name); rows that it doesn't name are `remain`."""
    return rows.join(names, id_column, "left").withColumn("set_name", F.coalesce("set_name", F.lit(remain)))


def split_by_offsets(rows: DataFrame, files: DataFrame, number: str = "row_number") -> DataFrame:
    """rows with set_name of files (position, set_name, n): row numbers are dealt to the files in order; files is a short list. Other totals than the number of rows are an error."""
    total, count = files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], rows.count()
    if total != count:
        raise ValueError(f"the files have {total} lines, the rows are {count}")
    w = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = files.withColumn("hi", F.sum("n").over(w)).withColumn("lo", F.col("hi") - F.col("n")).select("set_name", "lo", "hi")
    return rows.join(ends, (F.col(number) >= F.col("lo")) & (F.col(number) < F.col("hi")), "left").drop("lo", "hi")
