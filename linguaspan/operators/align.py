"""Word alignments: lexical tables, phrase pairs and groups of (pair_id, src, tgt, links), src and tgt token arrays, links array<struct<s, t>>."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import kernels as K
from ..functions import text as X
from ..runtime import cut, ship


def equal_links(pairs: DataFrame) -> DataFrame:
    """pairs (src, tgt, ...) with links between tokens that are equal in lower case."""
    ship(pairs.sparkSession)

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return K.equal_links(a, b)

    return pairs.withColumn("links", F.arrow_udf(run, "array<struct<s:int,t:int>>")("src", "tgt"))


def lexical(pairs: DataFrame, digits: int | None = 7) -> DataFrame:
    """(s, t, n, s2t, t2s), rounded to so many digits: links counted by words, words without a link by NULL; s2t is n over t's total, t2s n over s's. Links out of range are ignored."""
    ok = F.filter("links", lambda p: (p["s"] < F.size("src")) & (p["t"] < F.size("tgt")))
    rows = pairs.select("src", "tgt", ok.alias("links"))
    linked = rows.select(F.explode(F.transform("links", lambda p: F.struct(F.get("src", p["s"]).alias("s"), F.get("tgt", p["t"]).alias("t")))).alias("p")).select("p.s", "p.t")
    free_t = rows.select(F.explode(F.filter(F.transform("tgt", lambda w, j: F.when(~F.exists("links", lambda p: p["t"] == j), w)), lambda w: w.isNotNull())).alias("t")).select(F.lit("NULL").alias("s"), "t")
    free_s = rows.select(F.explode(F.filter(F.transform("src", lambda w, i: F.when(~F.exists("links", lambda p: p["s"] == i), w)), lambda w: w.isNotNull())).alias("s")).select("s", F.lit("NULL").alias("t"))
    counts = linked.unionByName(free_t).unionByName(free_s).groupBy("s", "t").agg(F.count("*").alias("n"))
    by_s, by_t = (counts.groupBy(c).agg(F.sum("n").alias(f"of_{c}")) for c in ("s", "t"))
    cut = lambda c: c if digits is None else X.rounded(c, digits)
    return counts.join(by_s, "s").join(by_t, "t").select("s", "t", "n", cut(F.col("n") / F.col("of_t")).alias("s2t"), cut(F.col("n") / F.col("of_s")).alias("t2s"))


PHRASES = 1 << 15  # phrase pairs that are made at a time


class _Spans:
    """The spans (begin, end) of a side that its sentence's phrases have: their different texts, each span's text (of), and in how many phrases each text is (n)."""

    def __init__(self, words: list[str], boxes: list[tuple[int, ...]], k: int):
        count = np.zeros((len(words), len(words)), np.int64)
        for b in boxes:
            far = b[4 - k : 8 - k]
            count[b[k] : b[k + 1] + 1, b[k + 2] : b[k + 3] + 1] += (far[1] - far[0] + 1) * (far[3] - far[2] + 1)
        begins, ends = np.nonzero(count)
        stop = np.cumsum([len(w) + 1 for w in words])
        start, text, known = stop - [len(w) + 1 for w in words], " ".join(words), {}
        number = [known.setdefault(text[i:j], len(known)) for i, j in zip(start[begins].tolist(), (stop[ends] - 1).tolist())]
        self.of = np.zeros_like(count)
        self.of[begins, ends] = number
        self.texts = list(known)
        self.n = np.bincount(number, count[begins, ends], len(known)).astype(np.int64)
        self.often = np.bincount(number, minlength=len(known)) > 1  # texts that the sentence has twice

    def digests(self) -> list[bytes]:
        return [blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in self.texts]


def _sides(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[int, list[tuple[int, ...]], _Spans, _Spans]]:
    """For each row that has phrases: its number, their boxes and the spans of both sides."""
    for k in range(batch.num_rows):
        src, tgt, links = (batch.column(c)[k].as_py() or [] for c in ("src", "tgt", "links"))
        if boxes := K.phrase_boxes(len(src), len(tgt), [(x["s"], x["t"]) for x in links], longest):
            yield k, boxes, _Spans(src, boxes, 0), _Spans(tgt, boxes, 4)


def phrase_pairs(pairs: DataFrame, longest: int = 7) -> DataFrame:
    """(pair_id, s_begin, s_end, t_begin, t_end, src_phrase, tgt_phrase), ends inclusive."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, boxes, s, t in _sides(batch, longest):
                texts = [pa.array(x.texts, pa.string()) for x in (s, t)]
                for at in K.unboxed(boxes, PHRASES):
                    own = [x.take(pa.array(y.of[at[i], at[i + 1]])) for x, y, i in zip(texts, (s, t), (0, 2))]
                    yield pa.record_batch([batch.column("pair_id").take(pa.array(np.full(at.shape[1], k))), *[pa.array(x, pa.int32()) for x in at], *own], names=schema.names)

    schema = T.StructType([pairs.schema["pair_id"], *T._parse_datatype_string("s_begin int, s_end int, t_begin int, t_end int, src_phrase string, tgt_phrase string")])
    return pairs.select("pair_id", "src", "tgt", "links").mapInArrow(run, schema)


def _position_weights(pairs: DataFrame, table: DataFrame, own: str, other: str, weight: str) -> DataFrame:
    """(pair_id, weights): for each word of a side the mean weight of its links, or that of NULL if it has none."""
    each = pairs.select("pair_id", F.posexplode(own).alias("k", "w"), "links", other)
    side, far = ("s", "t") if own == "src" else ("t", "s")
    mates = F.transform(F.filter("links", lambda p: p[side] == F.col("k")), lambda p: F.get(other, p[far]))
    each = each.select("pair_id", "k", F.col("w").alias(side), F.explode(F.when(F.size(mates) > 0, mates).otherwise(F.array(F.lit("NULL")))).alias(far))
    means = each.join(table.select("s", "t", weight), ["s", "t"], "left").groupBy("pair_id", "k").agg(F.avg(F.coalesce(weight, F.lit(0.0))).alias("v"))
    return means.groupBy("pair_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias(f"_{own}"))


def _shared_spans(pairs: DataFrame, longest: int) -> DataFrame:
    """(pair_id, shared): of each sentence pair the spans (side, digest) whose text another pair has too, and in how many phrases of all pairs the text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, _, *sides in _sides(batch, longest):
                for side, x in enumerate(sides):
                    yield pa.record_batch([batch.column("pair_id").take(pa.array([k] * len(x.n))), pa.array([side] * len(x.n), pa.int32()), pa.array(x.digests(), pa.binary()), pa.array(x.n)], names=schema.names)

    schema = T.StructType([pairs.schema["pair_id"], *T._parse_datatype_string("side int, digest binary, n bigint")])
    same = Window.partitionBy("side", "digest")
    spans = pairs.select("pair_id", "src", "tgt", "links").mapInArrow(run, schema)
    spans = spans.withColumn("total", F.sum("n").over(same)).withColumn("pairs", F.count("*").over(same)).where("pairs > 1")
    return spans.groupBy("pair_id").agg(F.collect_list(F.struct("side", "digest", "total")).alias("shared"))


def _products(weights: list[float]) -> np.ndarray:
    """The product of weights from each place to each later one, from the left."""
    out, w = np.zeros((len(weights), len(weights))), np.array(weights, np.float64)
    for i in range(len(w)):
        out[i, i:] = np.cumprod(w[i:])
    return out


def _counted_phrases(rows: DataFrame, longest: int, shared: bool) -> DataFrame:
    """(src_phrase, tgt_phrase, n, of_s, of_t, lex_s2t, lex_t2s) of rows (src, tgt, links, _src, _tgt, shared), counted within each row: the phrase pairs both sides of which other rows have too (shared), or else the others, which no other row has."""

    def counted(boxes: list[tuple[int, ...]], sides: tuple[_Spans, _Spans], common: list[np.ndarray], lex: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        """Numbers of the texts, n and both weights."""
        again = []
        for at in K.unboxed(boxes, PHRASES):
            s, t = sides[0].of[at[0], at[1]], sides[1].of[at[2], at[3]]
            ok = (common[0][s] & common[1][t]) == shared
            many = sides[0].often[s] | sides[1].often[t]
            each = [s, t, np.ones(len(s), np.int64), lex[0][at[0], at[1]], lex[1][at[2], at[3]]]
            yield [x[ok & ~many] for x in each]
            again.append([x[ok & many] for x in each])
        s, t, _, a, b = map(np.concatenate, zip(*again))
        if len(s):
            key = s * len(sides[1].n) + t
            by = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.diff(key[by], prepend=-1))
            yield [s[by][new], t[by][new], np.diff(new, append=len(by)), np.maximum.reduceat(a[by], new), np.maximum.reduceat(b[by], new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, boxes, *sides in _sides(batch, longest):
                known = {(x["side"], x["digest"]): x["total"] for x in batch.column("shared")[k].as_py() or ()}
                if shared and not known:
                    continue
                found = [np.array([known.get((i, d), 0) for d in x.digests()], np.int64) for i, x in enumerate(sides)]
                common, totals = [x > 0 for x in found], [np.where(x > 0, x, y.n) for x, y in zip(found, sides)]
                texts = [pa.array(x.texts, pa.string()) for x in sides]
                for s, t, n, a, b in counted(boxes, sides, common, [_products(batch.column(c)[k].as_py()) for c in ("_src", "_tgt")]):
                    for lo in range(0, len(s), PHRASES):
                        x = slice(lo, lo + PHRASES)
                        yield pa.record_batch([texts[0].take(pa.array(s[x])), texts[1].take(pa.array(t[x])), *map(pa.array, (n[x], totals[0][s[x]], totals[1][t[x]], a[x], b[x]))], names=["src_phrase", "tgt_phrase", "n", "of_s", "of_t", "lex_s2t", "lex_t2s"])

    return rows.mapInArrow(run, "src_phrase string, tgt_phrase string, n bigint, of_s bigint, of_t bigint, lex_s2t double, lex_t2s double")


def phrase_table(pairs: DataFrame, longest: int = 7) -> DataFrame:
    """(src_phrase, tgt_phrase, n, p_t_given_s, p_s_given_t, lex_s2t, lex_t2s): relative frequencies both ways, and lexical weights.

    A lexical weight is the product, over a side's words, of the mean weight of each word's links, or of NULL for a word without one; of a phrase pair that is
    linked in several ways the greatest counts. All links of a consistent phrase lie inside it, so a word's weight is the same in all phrases of a sentence.

    Totals of a side are sums over spans, of which there are far fewer than phrase pairs; these travel as digests of 128 bits. A phrase pair can stand in several
    sentences only if both its sides do: only such pairs are grouped across sentences, the others are counted where they are made and never sent. Sentences are told apart by pair_id.
    """
    ship(pairs.sparkSession)
    table = lexical(pairs, None)
    weights = _position_weights(pairs, table, "src", "tgt", "s2t").join(_position_weights(pairs, table, "tgt", "src", "t2s"), "pair_id")
    rows = cut(pairs.select("pair_id", "src", "tgt", "links").join(weights, "pair_id").join(_shared_spans(pairs, longest), "pair_id", "left").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair_id"))  # few bytes, long work
    both = _counted_phrases(rows, longest, True).groupBy("src_phrase", "tgt_phrase").agg(F.sum("n").alias("n"), F.max("of_s").alias("of_s"), F.max("of_t").alias("of_t"), F.max("lex_s2t").alias("lex_s2t"), F.max("lex_t2s").alias("lex_t2s"))
    short = lambda c: X.rounded(c, 7)
    return both.unionByName(_counted_phrases(rows, longest, False)).select("src_phrase", "tgt_phrase", "n", short(F.col("n") / F.col("of_s")).alias("p_t_given_s"), short(F.col("n") / F.col("of_t")).alias("p_s_given_t"), short(F.col("lex_s2t")).alias("lex_s2t"), short(F.col("lex_t2s")).alias("lex_t2s"))


def unfolded(pairs: DataFrame, by_source: bool = True, consecutive: bool = False) -> DataFrame:
    """(pair_id, groups): the alignment's groups as text."""
    ship(pairs.sparkSession)
    f = K.arrow(lambda s, t, a: " ".join(K.unfold(list(s), list(t), list(a), by_source, consecutive)), "string")
    return pairs.select("pair_id", f("src", "tgt", "links").alias("groups"))


def lcs_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, length, ratio, common): longest common subsequence of src and tgt."""
    ship(pairs.sparkSession)
    f = K.arrow(lambda s, t: " ".join(s[i] for i, _ in K.lcs(list(s), list(t))), "string")
    n = F.size(F.filter(F.split("common", " "), lambda w: w != ""))
    ratio = F.when(F.size("src") + F.size("tgt") > 0, 2 * n / (F.size("src") + F.size("tgt"))).otherwise(1.0)
    return pairs.withColumn("common", f("src", "tgt")).select("pair_id", n.alias("length"), ratio.alias("ratio"), "common").withColumn("ratio", X.rounded(F.col("ratio"), 6))


def masked(pairs: DataFrame, mark: str = "✖", fold: bool | Callable = True) -> DataFrame:
    """(pair_id, ratio, src, tgt): both sides with unrelated words masked; fold as in the kernel."""
    ship(pairs.sparkSession)
    f = K.arrow(lambda s, t: (lambda m: {"ratio": m["ratio"], "src": " ".join(m["a"]), "tgt": " ".join(m["b"])})(K.mask_unrelated(list(s), list(t), mark, fold)), "struct<ratio:double,src:string,tgt:string>")
    return pairs.withColumn("m", f("src", "tgt")).select("pair_id", X.rounded(F.col("m.ratio"), 6).alias("ratio"), "m.src", "m.tgt")


def acronyms(words: DataFrame, valid: DataFrame, least: int = 1, most: int = 2) -> DataFrame:
    """(id, acronym): words of `valid` (word) that choices of `least` to `most` characters of each word, in order of the words, make; words: (id, words).

    What begins no valid word is dropped at once. Every worker has the list and its prefixes.
    """
    spark = words.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast([r.word for r in valid.select(F.lower("word").alias("word")).distinct().collect()])
    kept: list[set[str]] = []

    def every(ws: list[str]) -> list[str]:
        if not kept:
            kept.extend(({w[:i] for w in known.value for i in range(len(w) + 1)}, set(known.value)))
        prefixes, whole = kept
        reach = {""}
        for w in ws:
            choices = K.subsequences(w.lower(), least, most)
            reach = {p for a in reach for s in choices if (p := a + s) in prefixes}
        return sorted((reach & whole) - {""})

    return words.select("id", F.explode(K.arrow(lambda ws: every(list(ws)), "array<string>")("words")).alias("acronym"))


def acronym_parts(phrases: DataFrame, acronym: str, least: int = 1, most: int = 2) -> DataFrame:
    """Phrases (id, words) that can stand for the acronym: a prefix is carried from word to word, and what leaves the acronym is dropped at once."""
    ship(phrases.sparkSession)

    def fits(ws: list[str]) -> bool:
        reach = {""}
        for w in ws:
            reach = {a + s for a in reach for s in K.subsequences(w.lower(), least, most) if acronym.lower().startswith(a + s)}
        return acronym.lower() in reach

    return phrases.where(K.arrow(lambda ws: fits(list(ws)), "boolean")("words"))


def ranked_links(pairs: DataFrame) -> DataFrame:
    """Each source word's best target by count."""
    t = lexical(pairs).where("s <> 'NULL' and t <> 'NULL'")
    return t.withColumn("_r", F.row_number().over(Window.partitionBy("s").orderBy(F.col("n").desc(), "t"))).where("_r = 1").drop("_r")
