"""HTML of alignments and differences, a column each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions import text as X
from ..runtime import ship


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def link_lines(pairs: DataFrame, height: int = 120, keep: bool = False) -> DataFrame:
    """(pair_id, html): source words above, target words below, an SVG line for each link. keep: the other columns too."""
    x = lambda i: (i * 60 + 30).cast("string")
    texts = lambda words, y: F.array_join(F.transform(words, lambda w, i: F.concat(F.lit('<text x="'), x(i), F.lit(f'" y="{y}">'), escaped(w), F.lit("</text>"))), "")
    lines = F.array_join(F.transform("links", lambda p: F.concat(F.lit('<line x1="'), x(p["s"]), F.lit('" y1="20" x2="'), x(p["t"]), F.lit(f'" y2="{height - 20}"/>'))), "")
    return pairs.select(*(pairs.columns if keep else ["pair_id"]), F.concat(F.lit(f'<svg height="{height}">'), texts("src", 15), texts("tgt", height - 5), lines, F.lit("</svg>")).alias("html"))


PORTION = 1 << 22  # characters of HTML that are held at a time


def link_matrix(pairs: DataFrame) -> DataFrame:
    """(pair_id, matrix), and html where pairs have that: a table with a row for each source word and a mark for each link."""
    ship(pairs.sparkSession)
    kept, portion = [c for c in ("pair_id", "html") if c in pairs.columns], PORTION

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at, made, size = batch.select(kept), 0, [], 0
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in ("src", "tgt", "links")]
                made.append(None if None in row else K.link_table(*row))
                size += len(made[-1] or "")
                if size >= portion or i == batch.num_rows - 1:
                    yield pa.record_batch([*own.slice(at, len(made)).columns, pa.array(made, pa.string())], names=[*kept, "matrix"])
                    at, made, size = i + 1, [], 0

    return pairs.select(*kept, "src", "tgt", "links").mapInArrow(run, T.StructType([*(pairs.schema[c] for c in kept), T.StructField("matrix", T.StringType())]))


def differences(rows: DataFrame, colour: str = "red", only_different: bool = False) -> DataFrame:
    """(id, html) of rows (id, hyp, ref): the hypothesis with words outside the common subsequence coloured."""
    ship(rows.sparkSession)
    rows = rows.where("hyp <> ref") if only_different else rows
    return rows.select("id", K.arrow(lambda h, r: K.word_diff(list(h), list(r), colour), "string")(X.tokens(F.col("hyp")), X.tokens(F.col("ref"))).alias("html"))


def dictionary_hits(rows: DataFrame, colour: str = "blue", only_hits: bool = False) -> DataFrame:
    """(id, hits, html) of rows (id, hyp, entries): distinct dictionary entries that stand in the hypothesis on token borders."""
    hits = F.array_sort(F.array_distinct(F.filter("entries", lambda e: (e != "") & X.contains_phrase(F.col("hyp"), e))))
    mark = lambda acc, e: F.replace(acc, F.concat(F.lit(" "), escaped(e), F.lit(" ")), F.concat(F.lit(f' <b style="color:{colour}">'), escaped(e), F.lit("</b> ")))
    out = rows.withColumn("hits", hits).select("id", "hits", F.trim(F.aggregate("hits", F.concat(F.lit(" "), escaped(F.col("hyp")), F.lit(" ")), mark)).alias("html"))
    return out.where(F.size("hits") > 0) if only_hits else out
