"""Readers and writers of line-aligned text. Row identity is a 0-based column; files are joined on it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut


def numbered(df: DataFrame, name: str = "line_no") -> DataFrame:
    """df with dense 0-based numbers in order of its partitions: one count for each partition goes to the driver, no row moves."""
    marked = cut(df.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = dict(marked.groupBy(part.alias("p")).count().collect())
    begin, at = {}, 0
    for p in sorted(sizes):
        begin[p], at = at, at + sizes[p]
    offset: Column = F.create_map(*[F.lit(x) for kv in begin.items() for x in kv])[part] if begin else F.lit(0)
    return marked.select((offset + F.col("_m").bitwiseAND(F.lit(2**33 - 1))).cast("bigint").alias(name), *[c for c in df.columns])


def read_lines(spark: SparkSession, path: str, strip: bool = False) -> DataFrame:
    """(line_no, text) of a file; gzip by suffix. A missing file is an error."""
    text = spark.read.text(path, wholetext=False).withColumnRenamed("value", "text")
    text = text.withColumn("text", F.regexp_replace("text", "\r$", ""))
    return numbered(text.withColumn("text", F.trim("text")) if strip else text)


def zipped(named: dict[str, DataFrame], strict: bool = True) -> DataFrame:
    """(line_no, one column a file) of files of equal length; strict: different lengths are an error, else the shortest counts."""
    frames = list(named.items())
    if strict:
        sizes = {k: d.count() for k, d in frames}
        if len(set(sizes.values())) > 1:
            raise ValueError(f"files differ in length: {sizes}")
    return reduce(lambda a, b: a.join(b, "line_no"), [d.withColumnRenamed("text", k) for k, d in frames])


def _literal(path: str) -> str:
    """A path of which no character stands for others."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def references(spark: SparkSession, stem: str) -> DataFrame:
    """(line_no, refs) of `stem`, or else stem0, stem1, ... or stem.ref0, ..., looked up in the file system of the path."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(stem).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    match = lambda tail: sorted(f.getPath().toString() for f in found.globStatus(jvm.org.apache.hadoop.fs.Path(_literal(stem) + tail)) or ())
    paths = match("") or match("[0-9]*") or match(".ref*")
    if not paths:
        raise FileNotFoundError(stem)
    each = [read_lines(spark, _literal(p)).withColumn("ref_no", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, each).groupBy("line_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("ref_no", "text"))), lambda r: r["text"]).alias("refs"))


def columns(lines: DataFrame, *names: str, sep: str = "\t") -> DataFrame:
    """TSV lines as named columns."""
    parts = F.split("text", sep)
    return lines.select("line_no", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def vectors(lines: DataFrame, normalise: bool = True) -> DataFrame:
    """(vec_id, embedding) of lines of numbers; lines of different widths are an error."""
    from ..functions.text import unit

    x = lines.select(F.col("line_no").alias("vec_id"), F.transform(F.split(F.trim("text"), " +"), lambda v: v.cast("float")).alias("embedding"))
    low, high = x.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} numbers")
    return x.withColumn("embedding", unit(F.col("embedding")).cast("array<float>")) if normalise else x


def segments(lines: DataFrame) -> DataFrame:
    """(line_no, text) of SGML lines `<seg id=...>text</seg>`."""
    return lines.where(F.col("text").rlike("^\\s*<seg")).select("line_no", F.regexp_extract("text", "<seg[^>]*>\\s*(.*?)\\s*</seg>", 1).alias("text"))


def match_pairs(lines: DataFrame, one_based: bool = False) -> DataFrame:
    """(query_id, rank, score, db_id) of lines `score TAB id TAB score TAB id ...`."""
    parts = F.filter(F.split("text", "\t"), lambda x: x != "")
    cells = F.when(F.size(parts) >= 2, F.transform(F.sequence(F.lit(0), F.size(parts) - 2, F.lit(2)), lambda i: F.struct(F.get(parts, i).cast("double").alias("score"), (F.get(parts, i + 1).cast("bigint") - int(one_based)).alias("db_id"))))
    return lines.select(F.col("line_no").alias("query_id"), F.posexplode(cells).alias("rank", "m")).select("query_id", (F.col("rank") + 1).alias("rank"), "m.score", "m.db_id")


def nth_lines(frames: dict[str, DataFrame], numbers: list[int]) -> DataFrame:
    """(file, n, text): the n-th lines, counted from 1, of each file."""
    return reduce(DataFrame.unionByName, [d.where(F.col("line_no").isin([n - 1 for n in numbers])).select(F.lit(k).alias("file"), (F.col("line_no") + 1).alias("n"), "text") for k, d in frames.items()])


def write_lines(df: DataFrame, column: str, path: str, order: str = "line_no") -> None:
    """One text folder in order; null is an empty line."""
    df.orderBy(order).select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).write.text(path)


def write_factors(df: DataFrame, path: str, order: str = "line_no") -> None:
    """`path`.f1 and .f2; different token counts are an error."""
    bad = df.where(F.size(F.split("f1", " ")) != F.size(F.split("f2", " "))).limit(1).count()
    if bad:
        raise ValueError("f1 and f2 differ in length")
    for f in ("f1", "f2"):
        write_lines(df, f, f"{path}.{f}", order)


def write_sets(df: DataFrame, path: str, name: str = "set_name") -> None:
    df.write.partitionBy(name).parquet(path)


def read_config(path: str) -> dict[str, str]:
    """`key: value` lines of a tokenizer file; mode is required, vocabulary is dropped."""
    with open(path, encoding="utf-8") as f:
        pairs = [line.split("#")[0].split(":", 1) for line in f if ":" in line.split("#")[0]]
    out = {k.strip(): v.strip().strip("'\"") for k, v in pairs if k.strip() != "vocabulary"}
    if "mode" not in out:
        raise ValueError("a tokenizer file needs a mode")
    return out


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
