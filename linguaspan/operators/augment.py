"""Sentences augmented with retrieved translations: tags, repairs, priming, contexts, gaps. Token columns are arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels as K
from ..functions import text as X
from ..runtime import ship


def attach(matches: DataFrame, train: DataFrame, strict: bool = True) -> DataFrame:
    """matches (tst_id, trn_id, ...) with the train sentence's columns; an id that train lacks is an error (strict) or dropped."""
    joined = matches.join(train.withColumn("_there", F.lit(True)), "trn_id", "left" if strict else "inner")
    return joined.withColumn("_there", F.when(F.col("_there").isNull(), F.raise_error(F.lit("a match names a train sentence that isn't there"))).otherwise(F.lit(True))).where("_there").drop("_there") if strict else joined.drop("_there")


def tagged(rows: DataFrame, tag_c: bool = False, tag_u: bool = False, tag_e: bool = False, ratio: float = 0.0, least: float = 0.0, sep: str = "‖") -> DataFrame:
    """(tst_id, f1, f2) of rows (tst_id, tst, src, tgt, links, score[, ref]): words of test, separator and target, and their tags.

    Test words are C if related to the match's source (tag_c), else S; target words T if all their links lead to related source words (or always,
    without tag_u), else U. tag_e: all S and E. No match, a low score or too small a share of T words in ref: both lines empty.
    """
    if ratio > 1 or (ratio and "ref" not in rows.columns) or (ratio and tag_e) or (tag_e and (tag_c or tag_u)):
        raise ValueError("ratio must be 1 at most, needs ref and excludes tag_e; tag_e excludes tag_c and tag_u")
    ship(rows.sparkSession)
    rel = K.arrow(lambda a, b: K.related(list(a), list(b)), "array<boolean>")
    rows = rows.withColumn("_s", rel("src", "tst") if tag_u else F.transform("src", lambda _: F.lit(True)))
    s_tags = F.transform(rel("tst", "src"), lambda r: F.when(r, F.lit("C")).otherwise(F.lit("S"))) if tag_c else F.transform("tst", lambda _: F.lit("S"))
    rows = rows.withColumn("_c", s_tags).withColumn("_t", X.all_linked(F.col("tgt"), F.col("links"), F.col("_s")) if tag_u else F.transform("tgt", lambda _: F.lit(True)))
    t_tags = F.transform("tgt", lambda _: F.lit("E")) if tag_e else F.transform("_t", lambda r: F.when(r, F.lit("T")).otherwise(F.lit("U")))
    ok = (F.col("score") >= least) & F.col("src").isNotNull()
    if ratio:
        kept = F.filter(F.transform("tgt", lambda w, j: F.when(F.get("_t", j), w)), lambda w: w.isNotNull())
        ok = ok & (X.share_found(kept, F.col("ref")) >= ratio)
    return rows.select("tst_id", F.when(ok, F.array_join(F.concat("tst", F.array(F.lit(sep)), "tgt"), " ")).otherwise("").alias("f1"), F.when(ok, F.array_join(F.concat("_c", F.array(F.lit(sep)), t_tags), " ")).otherwise("").alias("f2"))


def table_suffix(ratio: float = 0.0, tag_c: bool = False, tag_u: bool = False, tag_e: bool = False) -> str:
    return (f".ratio{ratio}" if ratio else "") + (".SE" if tag_e else ".S" + "C" * tag_c + "T" + "U" * tag_u)


def _factors(pairs: list[tuple[str, str]]) -> dict:
    return {"f1": " ".join(w for w, _ in pairs), "f2": " ".join(t for _, t in pairs)}


def injected(rows: DataFrame) -> DataFrame:
    """(tst_id, f1, f2): matched test words of a complete tuple are R, followed by the tuple's target words as T; the rest is S; empty if nothing is injected."""
    ship(rows.sparkSession)

    def one(tst, src, tgt, links) -> dict:
        pairs = K.lcs(list(tst), list(src))
        to_src = dict(pairs)
        own = K.complete_tuples(len(src), len(tgt), [(p["s"], p["t"]) for p in links], {s for _, s in pairs})
        last = {max(g[0]): g for g in own}
        inside = {s for g in own for s in g[0]}
        out = []
        for i, w in enumerate(tst):
            s = to_src.get(i)
            out.append((w, "R" if s in inside else "S"))
            if s in last:
                out += [(tgt[t], "T") for t in last[s][1]]
        return _factors(out) if own else {"f1": "", "f2": ""}

    return rows.select("tst_id", K.arrow(one, "struct<f1:string,f2:string>")("tst", "src", "tgt", "links").alias("m")).select("tst_id", "m.*")


def repaired(rows: DataFrame, mark_matched: bool = False, hide: bool = False, by_run: bool = False, least_run: int = 1) -> DataFrame:
    """(tst_id, f1, f2): test words S (or C where matched), @@@, target words T if supported by matched words, else R; hide makes each run of R one @@@.

    by_run: support comes from the tuples of the longest common run (of least_run words at least, else both lines are empty); otherwise from any matched source word in
    a target word's linked span.
    """
    ship(rows.sparkSession)

    def one(tst, src, tgt, links) -> dict:
        ls = [(p["s"], p["t"]) for p in links]
        if by_run:
            a, b, n = K.longest_run(list(tst), list(src))
            if n < least_run:
                return {"f1": "", "f2": ""}
            matched, good = set(range(a, a + n)), {t for g in K.span_groups(len(src), len(tgt), ls, b, b + n) for t in g[1]}
        else:
            pairs = K.lcs(list(tst), list(src))
            matched, hit = {i for i, _ in pairs}, {s for _, s in pairs}
            spans = {t: [s for s, u in ls if u == t] for t in range(len(tgt))}
            good = {t for t, ss in spans.items() if ss and any(min(ss) <= s <= max(ss) for s in hit)}
        out = [(w, "C" if mark_matched and i in matched else "S") for i, w in enumerate(tst)] + [("@@@", "R")]
        for t, w in enumerate(tgt):
            if t in good:
                out.append((w, "T"))
            elif not hide or out[-1] != ("@@@", "R"):
                out.append(("@@@", "R") if hide else (w, "R"))
        return _factors(out)

    return rows.select("tst_id", K.arrow(one, "struct<f1:string,f2:string>")("tst", "src", "tgt", "links").alias("m")).select("tst_id", "m.*")


def run_injected(rows: DataFrame, least_run: int = 1) -> DataFrame:
    """(tst_id, f1, f2): the tuples of the longest common run replaced in place by source (R) and target (T); the rest is S."""
    ship(rows.sparkSession)

    def one(tst, src, tgt, links) -> dict:
        a, b, n = K.longest_run(list(tst), list(src))
        own = K.span_groups(len(src), len(tgt), [(p["s"], p["t"]) for p in links], b, b + n) if n >= least_run else []
        if not own:
            return {"f1": "", "f2": ""}
        last = {max(g[0]): g for g in own}
        out = []
        for i, w in enumerate(tst):
            s = b + i - a
            inside = a <= i < a + n
            out.append((w, "R" if inside else "S"))
            if inside and s in last:
                out += [(tgt[t], "T") for t in last[s][1]]
        return _factors(out)

    return rows.select("tst_id", K.arrow(one, "struct<f1:string,f2:string>")("tst", "src", "tgt", "links").alias("m")).select("tst_id", "m.*")


def with_nearest(test: DataFrame, found: DataFrame) -> DataFrame:
    """(tst_id, f1, f2): test words S, then @@@ and the match's target words, all E; of several matches (ord) the last counts; none leaves both empty."""
    last = found.withColumn("_r", F.row_number().over(Window.partitionBy("tst_id").orderBy(F.col("ord").desc()))).where("_r = 1").select("tst_id", "tgt")
    joined = test.join(last, "tst_id", "left")
    tags = F.concat(F.transform("tst", lambda _: F.lit("S")), F.array(F.lit("E")), F.transform("tgt", lambda _: F.lit("E")))
    return joined.select("tst_id", F.coalesce(F.array_join(F.concat("tst", F.array(F.lit("@@@")), "tgt"), " "), F.lit("")).alias("f1"), F.coalesce(F.array_join(tags, " "), F.lit("")).alias("f2"))


def primed(queries: DataFrame, matches: DataFrame, n: int = 999, total: int = 999, each: int = 999, least: float = 0.0, single: bool = False, inference: bool = False, prime: bool = True, ranges: bool = False, perfect: float = 0.0, seed: int = 1234) -> DataFrame:
    """(query_id, example, source, prefix, target) of queries (query_id, src, tgt) and matches (query_id, rank, score, m_src, m_tgt).

    perfect: the share of training queries that get themselves as a match, chosen by a hash of the id.
    """
    ship(queries.sparkSession)
    best = matches.where(F.col("score") >= least).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "m_src", "m_tgt"))).alias("ms"))
    rows = queries.join(best, "query_id", "left").withColumn("ms", F.coalesce("ms", F.expr("cast(array() as array<struct<rank:bigint,score:double,m_src:array<string>,m_tgt:array<string>>>)")))
    lucky = F.lit(not inference) & (F.pmod(F.xxhash64("query_id", F.lit(seed)), F.lit(1000000)) < int(perfect * 1e6))

    def one(src, tgt, ms, own) -> list:
        found = [(m["score"], list(m["m_src"]), list(m["m_tgt"])) for m in ms]
        if own:
            found.insert(0, (1.0, list(src), list(tgt)))
        tag = (lambda s: f"⸨{min(max(int(s * 10 + 1e-9), 0), 10) / 10:.1f}⸩") if ranges else None
        return [{"source": a, "prefix": b, "target": c} for a, b, c in K.pack(found, list(src), list(tgt), n, total, each, single, inference, prime, tags=tag)]

    out = rows.withColumn("e", K.arrow(one, "array<struct<source:string,prefix:string,target:string>>")("src", "tgt", "ms", lucky))
    return out.select("query_id", F.posexplode("e").alias("example", "e")).select("query_id", "example", "e.*")


def context_sets(queries: DataFrame, matches: DataFrame, most: int = 1, least: float = 0.5, characters: int = 100, inference: bool = False) -> DataFrame:
    """(query_id, pack, scores, context_src, context_tgt): packs of distinct matches (query_id, score, m_src, m_tgt as texts), scores clamped to [0, 1] and tagged."""
    ship(queries.sparkSession)
    ok = matches.withColumn("score", X.clamp(F.col("score"))).where(F.col("score") >= least)
    rows = ok.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("score"), "m_src", "m_tgt")), asc=False).alias("ms")).join(queries.select("query_id"), "query_id", "left_semi")

    def one(ms) -> list:
        packs = K.contexts([(m["score"], m["m_src"], m["m_tgt"]) for m in ms], most, characters, inference)
        return [{"scores": " ".join(f"⸨{f'{ms[i]['score']:.6f}'[:3]}⸩" for i in p), "context_src": " ⸨sep⸩ ".join(ms[i]["m_src"] for i in p), "context_tgt": " ⸨sep⸩ ".join(ms[i]["m_tgt"] for i in p)} for p in packs]

    out = rows.withColumn("p", K.arrow(one, "array<struct<scores:string,context_src:string,context_tgt:string>>")("ms"))
    return out.select("query_id", F.posexplode("p").alias("pack", "p")).select("query_id", "pack", "p.*")


def flat_matches(queries: DataFrame, matches: DataFrame, most: int = 0, least: float = 0.0, perfect: bool = False, inference: bool = False) -> DataFrame:
    """(query_id, kind, rank, score, src, tgt, m_src, m_tgt): a row without a match (kind 0), the perfect one (kind 1) if wanted, then each match (kind 2) until the score falls short or `most` are given. inference: the first match, or else the row without."""
    cols = ["query_id", "kind", "rank", "score", "src", "tgt", "m_src", "m_tgt"]
    own = queries.select("query_id", "src", "tgt")
    stop = F.min(F.when(F.col("score") < least, F.col("rank"))).over(Window.partitionBy("query_id"))
    found = matches.withColumn("_stop", stop).where("_stop is null or rank < _stop")
    found = found.where(F.col("rank") <= most) if most else found
    found = own.join(found, "query_id").withColumn("kind", F.lit(2)).withColumn("score", X.below_one(F.col("score"))).select(*cols)
    none = own.select("query_id", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("rank"), F.lit(0.0).alias("score"), "src", "tgt", F.lit("").alias("m_src"), F.lit("").alias("m_tgt"))
    if inference:
        first = found.where("rank = 1")
        return first.unionByName(none.join(first, "query_id", "left_anti"))
    out = none.unionByName(found)
    return out.unionByName(none.withColumns({"kind": F.lit(1), "score": F.lit(1.0), "m_src": F.col("src"), "m_tgt": F.col("tgt")})) if perfect else out


def gap_filled(pairs: DataFrame, least: int = 1, most: int = 5, longest: int = 5, share: float = 0.5, seed: int = 0, gap: str = "｟gap｠", sep: str = "｟sep｠") -> DataFrame:
    """(pair_id, source, target, n_gaps, n_words): `src sep tgt-with-gaps` and the fillings; a row's choice depends on its id and the seed alone. Rows whose gaps can't be placed are dropped."""
    ship(pairs.sparkSession)
    f = K.arrow(lambda w, k: K.gaps(list(w), k, least, most, longest, share, gap), "struct<with_gaps:string,filled:string,n_gaps:int,n_words:int>")
    out = pairs.withColumn("g", f("tgt", F.xxhash64("pair_id", F.lit(seed)))).where("g is not null")
    return out.select("pair_id", F.concat_ws(" ", F.array_join("src", " "), F.lit(sep), "g.with_gaps").alias("source"), F.col("g.filled").alias("target"), "g.n_gaps", "g.n_words")


def joiner_features(rows: DataFrame, joiner: str = "￭") -> DataFrame:
    """(id, feats) of rows (id, tags, pieces): each piece gets the tag of the word it is of, by a running count of word begins."""
    begins = F.transform("pieces", lambda p, i: F.when((i > 0) & (p.startswith(joiner) | F.get("pieces", i - 1).endswith(joiner)), F.lit(0)).otherwise(F.lit(1)))
    upto = lambda i: F.aggregate(F.slice(begins, F.lit(1), i + 1), F.lit(0), lambda a, b: a + b)
    return rows.select("id", F.array_join(F.transform("pieces", lambda _, i: F.get("tags", F.least(upto(i), F.size("tags")) - 1)), " ").alias("feats"))


def memory_lines(lines: DataFrame, least: float = 0.5, most: int = 0, sep: str = "￭") -> DataFrame:
    """(id, inp, ref, rank, score, src, tgt) of lines `inp TAB ref (TAB score TAB id=src￭tgt)*`: matches of score `least` at least, the first `most` of these."""
    parts = F.split("line", "\t")
    cells = F.transform(F.sequence(F.lit(2), F.size(parts) - 2, F.lit(2)), lambda i: F.struct(F.get(parts, i).cast("double").alias("score"), F.get(parts, i + 1).alias("m")))
    rows = lines.select("id", F.get(parts, F.lit(0)).alias("inp"), F.get(parts, F.lit(1)).alias("ref"), F.when(F.size(parts) >= 4, cells).otherwise(F.expr("cast(array() as array<struct<score:double,m:string>>)")).alias("ms"))
    good = F.slice(F.filter("ms", lambda m: m["score"] >= least), 1, most) if most else F.filter("ms", lambda m: m["score"] >= least)
    out = rows.withColumn("ms", good).select("id", "inp", "ref", F.posexplode("ms").alias("rank", "m"))
    pair = F.substring_index("m.m", "=", -1)
    return out.select("id", "inp", "ref", "rank", "m.score", F.split_part(pair, F.lit(sep), F.lit(1)).alias("src"), F.split_part(pair, F.lit(sep), F.lit(2)).alias("tgt"))


def attention(rows: DataFrame, similarity: str | None = None) -> DataFrame:
    """(id, tokens, weights) of rows (id, inp, tgt, related[, similarity]): 1 for each input token, 0 for the separator, relatedness times similarity for target tokens; borders are 1."""
    own = F.transform("tgt", lambda _, j: F.when(F.get("related", j), F.get(similarity, j) if similarity else F.lit(1.0)).otherwise(F.lit(0.0)))
    one = F.array(F.lit(1.0))
    return rows.select("id", F.concat("inp", F.array(F.lit("｟fuzzymatch｠")), "tgt").alias("tokens"), F.concat(one, F.transform("inp", lambda _: F.lit(1.0)), F.array(F.lit(0.0)), own, one).alias("weights"))
