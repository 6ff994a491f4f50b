import random
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from linguaspan.functions import grams as G
from linguaspan.functions import kernels as K
from linguaspan.functions import merges as M
from linguaspan.functions import text as X
from linguaspan.operators import align, augment, clean, embed, evaluate, match, stats
from linguaspan.plans import catalogue
from linguaspan.sources import lines as L

SF = "/root/testdata/sf0.001"
QUICK = ["corpus_stats_by_lang", "oov_report", "sentence_idf", "domain_tfidf", "clean_report", "split_sets", "word_levenshtein", "bleu_corpus", "chrf_corpus", "related_targets_any", "joiner_features", "vocab_build", "flat_matches", "masked_ngrams", "ngram_candidates", "fuzzy_testset", "ngram_overlap_best", "lcs_pairs", "mask_unrelated", "diff_html", "unfold_groups", "unfold_groups_by_target", "acronyms", "link_html", "score_tags", "softmax_scores", "bleu_two_references", "match_list_rows", "label_vectors_sum"]


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).values.tolist()))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "part", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.ORACLE[name]).df()
    assert list(sorted(a.columns)) == list(sorted(b.columns))
    assert rows(a.astype(object)) == rows(b.astype(object))


def test_tokens_of_the_conservative_mode(spark):
    df = spark.createDataFrame([("Hello World!",), ("it's 3.5 (ok)",)], "t string").select(X.tokens(F.col("t"), "conservative").alias("w"), "t")
    got = [r.w for r in df.collect()]
    assert got[0] == ["Hello", "World", "￭!"]
    back = df.select(X.detokenise(F.col("w")).alias("d"), "t").collect()
    assert all(r.d == r.t for r in back)


def test_reasons_follow_the_order_of_the_rules(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "", "b"), (3, "a b", "c d"), (4, "a b", "c d"), (5, "x", "1 2 3 4 5 6 7")], "pair_id int, src string, tgt string")
    assert {r.pair_id: r.reason for r in clean.reasons(df).collect()} == {1: "equals", 2: "min", 3: None, 4: "uniq", 5: "fert"}


def test_bleu_of_itself_is_100(spark):
    df = spark.createDataFrame([(1, "alpha b c d e", ["alpha b c d e"])], "id int, hyp string, refs array<string>")
    r = evaluate.bleu(df).first()
    assert r.bleu == 100.0 and r.brevity == 1.0
    assert evaluate.chrf(df).first().chrf == 100.0


def test_phrases_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        links = {(rng.randrange(n), rng.randrange(m)) for _ in range(rng.randint(0, 6))}
        want = set()
        for a in range(n):
            for b in range(a, n):
                for c in range(m):
                    for d in range(c, m):
                        inner = [(s, t) for s, t in links if a <= s <= b]
                        if inner and all((a <= s <= b) == (c <= t <= d) for s, t in links):
                            (x, y), (z, w) = ((min(v), max(v)) for v in zip(*inner))  # what is left without free words at the borders
                            if y - x < 3 and w - z < 3:
                                want.add((a, b, c, d))
        got = set(K.phrases(n, m, sorted(links), 3))
        assert got == want, (n, m, links)


def test_grams_of_rows_with_nulls():
    lists = pa.array([["a", "b", "a", "b"], None, [], ["𝚇", "1", "x"], ["a", "b"]], pa.list_(pa.string()))
    row, found = G.word_ngrams(lists, 2)
    assert list(zip(row.tolist(), found.to_pylist())) == [(0, "a b"), (0, "b a"), (0, "a b"), (3, "𝚇 1"), (3, "1 x"), (4, "a b")]
    masked = G.masked(pa.array([["3.5", ".", "a1", "", "--", "5.5.5"]]))
    assert masked.to_pylist() == [["𝚇", "𝚇", "a1", "𝚇", "𝚇", "5.5.5"]]
    assert G.word_ngrams(masked, 2, 1)[1].to_pylist() == ["𝚇 a1", "a1 𝚇", "𝚇 5.5.5"]
    assert G.clipped("aab", ["ab", "aa"], 1) == (3, 3, 4) and G.clipped([], [["a"]], 1) == (0, 0, 1)


def test_ngrams_of_short_arrays(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r.g for r in df.select(X.ngrams(F.col("w"), 2).alias("g")).collect()] == [["a b", "b c"], [], []]


def test_best_overlap_prefers_the_lowest_id(spark):
    t = spark.createDataFrame([(0, "x a b c d e y".split())], "tst_id int, words array<string>")
    d = spark.createDataFrame([(2, "a b c d e".split()), (1, "q a b c d e".split())], "trn_id int, words array<string>")
    r = match.best_overlap(t, d, 5).first()
    assert (r.trn_id, r.length, r.overlap) == (1, 5, "a b c d e")


def test_tagging_conflicts_and_empty_lines(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a"], ["A"], [(0, 0)], 0.9), (2, ["a"], ["c"], ["C"], [(0, 0)], 0.1)], "tst_id int, tst array<string>, src array<string>, tgt array<string>, links array<struct<s:int,t:int>>, score double")
    got = {r.tst_id: (r.f1, r.f2) for r in augment.tagged(df, True, True, least=0.5).collect()}
    assert got == {1: ("a b ‖ A", "C S ‖ T"), 2: ("", "")}
    with pytest.raises(ValueError):
        augment.tagged(df, tag_c=True, tag_e=True)


def test_lines_are_numbered_and_zipped(spark, tmp_path):
    (tmp_path / "a").write_text("x\ny\n")
    (tmp_path / "b").write_text("1\n2\n3\n")
    a, b = L.read_lines(spark, str(tmp_path / "a")), L.read_lines(spark, str(tmp_path / "b"))
    assert [(r.line_no, r.text) for r in b.orderBy("line_no").collect()] == [(0, "1"), (1, "2"), (2, "3")]
    with pytest.raises(ValueError):
        L.zipped({"s": a, "t": b})
    assert L.zipped({"s": a, "t": b}, strict=False).count() == 2


def test_references_are_found_beside_the_stem(spark, tmp_path):
    (tmp_path / "r[1]0").write_text("a\nb\n")
    (tmp_path / "r[1]1").write_text("c\nd\n")
    (tmp_path / "one").write_text("x\n")
    assert [r.refs for r in L.references(spark, str(tmp_path / "r[1]")).orderBy("line_no").collect()] == [["a", "c"], ["b", "d"]]
    assert [r.refs for r in L.references(spark, str(tmp_path / "one")).collect()] == [["x"]]
    with pytest.raises(FileNotFoundError):
        L.references(spark, str(tmp_path / "none"))


def test_alignments_of_another_form_are_an_error(spark):
    df = spark.createDataFrame([("0-1 2-0",), ("0-x 1-1",), ("",), (None,)], "a string")
    got = df.select(X.links(F.col("a"), strict=False).alias("p")).collect()
    assert [r.p and [(x.s, x.t) for x in r.p] for r in got] == [[(0, 1), (2, 0)], [(1, 1)], [], None]
    with pytest.raises(Exception, match="no alignment"):
        df.select(X.links(F.col("a")).alias("p")).collect()


def test_splits_must_have_all_rows(spark):
    files = spark.createDataFrame([(0, "a", 2), (1, "b", 1)], "position int, set_name string, n bigint")
    got = clean.split_by_offsets(spark.range(3).withColumnRenamed("id", "row_number"), files)
    assert {r.row_number: r.set_name for r in got.collect()} == {0: "a", 1: "a", 2: "b"}
    with pytest.raises(ValueError):
        clean.split_by_offsets(spark.range(4).withColumnRenamed("id", "row_number"), files)


def test_vocabulary_ties_go_by_word(spark):
    df = spark.createDataFrame([(["b", "a", "c", "c"],)], "words array<string>")
    assert [(r.idx, r.word) for r in stats.vocabulary(df, 1).orderBy("idx").collect()] == [(0, "<unk>"), (1, "c"), (2, "a"), (3, "b")]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_merges_are_learnt_from_the_documents(spark):
    got = catalogue.QUERIES["subword_merges"](spark, SF).toPandas()
    first = catalogue.documents(spark, SF).selectExpr("explode(words) as w").selectExpr("explode(transform(sequence(1, greatest(length(w) - 1, 1)), i -> substr(w, i, 2))) as p").where("length(p) = 2").groupBy("p").count().orderBy(F.col("count").desc(), "p").first()
    assert got["rank"].tolist() == list(range(len(got))) and len(got) > 1000 and (got.n.diff().dropna() <= 0).all()
    assert (got.left[0] + got.right[0], got.n[0]) == (first.p, first["count"])


def _counted_anew(words, symbols, least=1):
    """Merges of {word: frequency}, by counting all pairs again for each."""
    parts, out = {w: list(w) for w in words}, []
    while len(out) < symbols:
        n = {}
        for w, p in parts.items():
            for x in zip(p, p[1:]):
                n[x] = n.get(x, 0) + words[w]
        if not n or (best := min(n.items(), key=lambda x: (-x[1], x[0])))[1] < least:
            break
        out.append((*best[0], best[1]))
        for w, p in parts.items():
            i, new = 0, []
            while i < len(p):
                two = tuple(p[i : i + 2]) == best[0]
                new.append("".join(p[i : i + 1 + two]))
                i += 1 + two
            parts[w] = new
    return out


@pytest.mark.parametrize("fall, block, symbols, least", [(2, 50, 400, 1), (4, 1 << 22, 60, 1), (3, 200, 400, 7), (2, 50, 0, 1)])
def test_merges_of_rounds_equal_counting_anew(spark, monkeypatch, fall, block, symbols, least):
    monkeypatch.setattr(embed, "FALL", fall)
    monkeypatch.setattr(embed, "BLOCK", block)
    rng = random.Random(5)
    words = {"".join(rng.choice("aaabcd😀\0") for _ in range(rng.randint(1, 10))): rng.randint(1, 9) for _ in range(150)} | {"aaaaa": 70, "ababab": 30, "aaaaaaaa": 3}
    rows = spark.createDataFrame([*words.items(), (None, 5), ("", 9)], "word string, freq bigint")
    got = sorted(embed.learn_merges(rows, symbols, least).collect())
    want = _counted_anew(words, symbols, least)
    assert [tuple(r)[1:] for r in got] == want and [r.rank for r in got] == list(range(len(want))) and bool(want) == bool(symbols)
    assert list(M.byte_pairs(words.items(), symbols, least)) == want


def test_merges_of_no_words(spark):
    assert embed.learn_merges(spark.createDataFrame([("a", 3), (None, 1)], "word string, freq bigint")).collect() == []


def test_one_task_has_few_parts_of_many_words():
    rng = random.Random(6)
    words = {"".join(rng.choice(["the", "ing", "q", "x", "é", "!", "7", "zu"]) for _ in range(8)) for _ in range(3000)}
    texts = M.numbered("".join(words), np.array([len(w) for w in words]))
    freqs = np.ones(len(words), np.int64)
    pair, n = M.pair_counts(texts, freqs)
    least = int(n.max()) // 2
    flat, sizes, times = M.chains(texts, freqs, pair[n >= least])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    parts = {}
    for a, b, k in zip(ends, ends[1:], times):
        key = flat[a:b].tobytes()
        parts[key] = parts.get(key, 0) + int(k)
    few = np.concatenate([[0], *(x for p in parts for x in (np.frombuffer(p, np.int32), [0]))]).astype(np.int32)
    of_all, of_parts = (list(M.learnt(w, f, 400, least, [])) for w, f in ((texts.copy(), freqs), (few, np.array([*parts.values()], np.int64))))
    assert of_all == of_parts and len(of_all) > 3 and 20 * len(few) < len(texts)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_negatives_come_from_the_whole_vocabulary(spark):
    size = catalogue.QUERIES["vocab_build"](spark, SF).count()
    words = catalogue.documents(spark, SF).selectExpr("sum(size(words)) as n").first().n
    got = catalogue.QUERIES["negative_samples"](spark, SF)
    r = got.selectExpr("min(array_min(negatives)) as a", "max(array_max(negatives)) as b", "count(distinct id, pos) as n", "count(if(arrays_overlap(negatives, context) or array_contains(negatives, centre), 1, null)) as bad").first()
    assert (r.a, r.b, r.n, r.bad) == (1, size - 1, words, 0)


def test_acronyms_take_any_letters(spark):
    words = spark.createDataFrame([(1, ["light", "amber"]), (2, ["Ox"])], "id int, words array<string>")
    valid = spark.createDataFrame([(w,) for w in ("la", "Gab", "hama", "it", "x", "ox", "o", "lightam")], "word string")
    assert {(r.id, r.acronym) for r in align.acronyms(words, valid).collect()} == {(1, "la"), (1, "gab"), (2, "x"), (2, "ox"), (2, "o")}
    assert K.subsequences("abc", 2, 2) == ["a", "ab", "ac", "b", "bc", "c"] and K.subsequences("ab", 0, 1) == ["", "a", "b"]
    assert [r.id for r in align.acronym_parts(words, "gab").collect()] == [1]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_windows_of_all_documents(spark):
    docs = catalogue.documents(spark, SF).where("words is not null").toPandas()
    got = catalogue.QUERIES["context_windows_documents"](spark, SF).toPandas()
    want = {(d, i): (w[i], " ".join([*w[max(i - 5, 0) : i], *w[i + 1 : i + 6]])) for d, w in zip(docs.doc_id, map(list, docs.words)) for i in range(len(w))}
    assert len(got) == len(want) and dict(zip(zip(got.doc_id, got.pos), zip(got.centre, got.context))) == want


def test_phrases_are_of_up_to_seven_words(spark, monkeypatch):
    pair = [(1, [*"abcdefgh"], [*"abcdefgh"], [(i, i) for i in range(8)])]
    rows = spark.createDataFrame(pair, "pair_id int, src array<string>, tgt array<string>, links array<struct<s:int,t:int>>")
    monkeypatch.setattr(catalogue, "token_pairs", lambda *_: rows)
    for name in ("phrase_pairs", "phrase_table"):
        got = {r.src_phrase for r in catalogue.QUERIES[name](spark, SF).collect()}
        assert {"a b c d e f g", "b c d e f g h"} <= got and max(map(len, got)) == 13


def _same_as_sql(spark, folder, name, **tables):
    """Whether a query over small made tables has the rows of its SQL, with the same text of each value."""
    con = duckdb.connect()
    for t, table in tables.items():
        pq.write_table(table, f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    a, b = catalogue.QUERIES[name](spark, str(folder)).toPandas(), con.execute(catalogue.ORACLE[name]).df()
    assert len(a) and rows(a) == rows(b)


def _talk(*turns):
    """conversations: one for each (conv_id, user's text, assistant's text)."""
    each = [(c, t, role, text) for c, u, a in turns for t, role, text in ((0, "user", u), (1, "assistant", a))]
    return pa.table({"conv_id": pa.array([x[0] for x in each], pa.int64()), "turn": pa.array([x[1] for x in each], pa.int64()), "role": [x[2] for x in each], "text": [x[3] for x in each]})


def test_masking_folds_case_as_its_sql(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "mask_unrelated", conversations=_talk((1, "groß Maß MASS ΟΔΟΣ", "gross mass maß οδοσ"), (2, "a b", "c A")))


def test_tags_of_scores_that_round_to_minus_zero(spark, tmp_path):
    e = [[-7.961560186231509e-06] + [0.5] * 8, [7e-06] + [0.5] * 8, [-0.3] * 9, [0.1234] * 9]
    _same_as_sql(spark, tmp_path, "score_tags", embeddings=pa.table({"vec_id": pa.array(range(4), pa.int64()), "embedding": pa.array(e, pa.list_(pa.float32())), "label": pa.array([0] * 4, pa.int32())}))


def test_tags_of_scores_that_are_minus_zero(spark, tmp_path):
    e = [[-0.0], [0.0], [-1e-10], [float("nan")], [float("-inf")], [], None]
    _same_as_sql(spark, tmp_path, "score_tags", embeddings=pa.table({"vec_id": pa.array(range(7), pa.int64()), "embedding": pa.array(e, pa.list_(pa.float32())), "label": pa.array([0] * 7, pa.int32())}))


@pytest.mark.parametrize("kind", [pa.float32(), pa.float64()])
def test_tags_of_scores_round_as_their_sql(spark, tmp_path, kind):
    """Ties of doubles, and scores so large that rounding moves them."""
    x = np.concatenate([(np.arange(-4000, 4001) + 0.5) / 30000, np.arange(-64, 65) / 32, np.arange(-50, 51) * 3.1e11 / 7, [1e38, -1e38, np.inf, -np.inf, np.nan, -0.0]])
    e = [[v] for v in x.tolist()] + [[1e300 if kind == pa.float64() else 1e30], [None], [], None]
    _same_as_sql(spark, tmp_path, "score_tags", embeddings=pa.table({"vec_id": pa.array(range(len(e)), pa.int64()), "embedding": pa.array(e, pa.list_(kind)), "label": pa.array([0] * len(e), pa.int32())}))


def test_shares_at_ties_round_as_their_sql(spark, tmp_path):
    """41 of 640 is a tie at six digits; its double, moved by six, is less than one."""
    _same_as_sql(spark, tmp_path, "shared_word_ratio", conversations=_talk((1, "a " * 41 + "b " * 599, "a")))


def test_ratios_of_counts_at_ties_round_as_their_sql(spark):
    sql = lambda n, of, digits: duckdb.execute(f"select round(n / of, {digits}) from (select ?::bigint as n, ?::bigint as of)", [n, of]).fetchone()[0]
    sides = spark.createDataFrame([(1, ["a"] * 41 + ["b"] * 599, ["a"] * 41 + ["c"] * 599)], "pair_id bigint, src array<string>, tgt array<string>")
    row = align.lcs_pairs(sides).first()
    assert (row.length, row.ratio) == (41, sql(82, 1280, 6))
    assert align.masked(sides).first().ratio == sql(82, 1280, 6)
    pair = [(["a"] * 41, ["b"] * 6400, [(i, i) for i in range(41)])]
    table = align.lexical(spark.createDataFrame(pair, "src array<string>, tgt array<string>, links array<struct<s:int,t:int>>")).where("s = 'a'").first()
    assert (table.n, table.s2t, table.t2s) == (41, sql(41, 6400, 7), 1.0)


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_by_distance_with_copies_and_ties(spark, block):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (60, 4)).astype(np.float32) / 3
    x[40:50] = x[:10]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, embedding array<float>")
    got = match.exact_knn(df.where("id % 5 = 0"), df, 4, block=block, distance="euclidean", others=True).collect()
    want = {(i, j, n + 1) for i in range(0, 60, 5) for n, (_, j) in enumerate(sorted((round(float(np.sqrt(((x[i].astype(float) - x[j]) ** 2).sum())), 6), j) for j in range(60) if j != i)[:4])}
    assert {(r.query_id, r.db_id, r.rank) for r in got} == want


@pytest.mark.parametrize("name", ["nearest_euclidean", "knn_cosine", "match_list_text"])
def test_searches_equal_sql(spark, tmp_path, name):
    _same_as_sql(spark, tmp_path, name, embeddings=pq.read_table(f"{SF}/embeddings.parquet"))


@pytest.mark.parametrize("block", [5, 2048])
def test_nearest_by_counts_equal_all_counts(spark, monkeypatch, block):
    monkeypatch.setattr(match, "COUNTED", 4)
    rng = random.Random(5)
    df = spark.createDataFrame([(i, [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for i in range(40)], "id bigint, words array<string>")
    test, train = df.where("id % 3 = 0").withColumnRenamed("id", "tst_id"), df.withColumnRenamed("id", "trn_id")
    want = match.top(match.fuzzy_counts(test, train, 2, 3).where("tst_id <> trn_id"), "score", 3)
    got = match.nearest_by_counts(test, train, 3, 2, 3, block)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_matches_of_queries_equal_sql(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "flat_matches", conversations=_talk(*[(10 * k, " ".join(f"w{(k * j) % 7}" for j in range(9)), f"t {k}") for k in range(12)]))


def test_links_of_slices_and_nulls_equal_those_of_rows():
    rng = random.Random(2)
    rows_ = [None if rng.random() < 0.1 else [[rng.choice(["a", "A", "b", "ß", "ẞ", "C"]) for _ in range(rng.randint(0, 5))] for _ in range(2)] for _ in range(200)]
    a, b = (pa.array([r and r[k] for r in rows_], pa.list_(pa.string())).slice(7) for k in (0, 1))
    got = K.equal_links(a, b).to_pylist()
    assert got == [r and [{"s": i, "t": j} for i, x in enumerate(r[0]) for j, y in enumerate(r[1]) if x.lower() == y.lower()] for r in rows_[7:]]


def test_a_batch_is_converted_a_few_rows_at_a_time(spark, monkeypatch):
    seen = []
    whole = pa.Array.to_pylist
    f = K.arrow(lambda x: [v + 1 for v in x], "array<int>")
    assert [r.y for r in spark.createDataFrame([([1, 2],), (None,), ([],)], "x array<int>").select(f("x").alias("y")).collect()] == [[2, 3], None, []]
    monkeypatch.setattr(F, "arrow_udf", lambda run, _: lambda column: run(column))
    assert K.arrow(lambda x: seen.append(x) or x, "int")(pa.array(range(1000))).to_pylist() == list(range(1000)) and whole(pa.array(seen)) == list(range(1000))
    assert K.AT_A_TIME <= 256


def test_html_of_a_batch_comes_in_portions(spark, monkeypatch):
    from linguaspan.operators import render

    monkeypatch.setattr(render, "PORTION", 300)
    df = align.equal_links(spark.createDataFrame([(i, ["a", "b"] * (i % 4), ["b", "c"]) for i in range(30)], "pair_id bigint, src array<string>, tgt array<string>"))
    got = {r.pair_id: (r.html, r.matrix) for r in render.link_matrix(render.link_lines(df, keep=True)).collect()}
    assert len(got) == 30 and all(m.count("<tr>") == 1 + 2 * (i % 4) and m.count("■") == i % 4 and h.count("<line") == i % 4 for i, (h, m) in got.items())


def test_negatives_of_numbered_rows(spark, monkeypatch):
    from linguaspan.operators import embed

    monkeypatch.setattr(stats, "SHARD_WORDS", 20)
    monkeypatch.setattr(embed, "PLACES", 7)
    texts = {i: [f"w{(i * j) % 9}" for j in range(i)] for i in range(12)} | {50: None}
    lines_ = spark.createDataFrame(list(texts.items()), "id bigint, words array<string>")
    vocab = stats.vocabulary(lines_, 2)
    number = {r.word: r.idx for r in vocab.collect()}
    ids = {i: [number.get(w, 0) for w in ws] for i, ws in texts.items() if ws}
    got_rows = stats.encoded_rows(lines_, vocab, "id")
    assert {r.id: r.words for r in got_rows.collect()} == ids
    want = {(r.id, r.pos, r.centre, tuple(r.context)) for r in embed.context_windows(spark.createDataFrame(list(ids.items()), "id bigint, words array<int>"), "id").collect()}
    for size in (len(number), 40):
        got = embed.negatives(got_rows, size, 3).collect()
        assert {(r.id, r.pos, r.centre, tuple(r.context)) for r in got} == want and len(got) == len(want)
        for r in got:
            free = set(range(1, size)) - {r.centre, *r.context}
            assert len(r.negatives) == (3 if free else 0) and set(r.negatives) <= free


@pytest.mark.parametrize("name", ["phrase_pairs", "phrase_table"])
def test_phrases_that_sentences_share_equal_sql(spark, tmp_path, name):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("abcdeABxyz") for _ in range(rng.randint(1, 7)))
    turns = [(i, text(), text()) for i in range(40)]
    _same_as_sql(spark, tmp_path, name, conversations=_talk(*turns, *[(100 + i, s, t) for i, s, t in turns[:10]]))


def test_boxes_give_each_phrase_once_in_portions():
    rng = random.Random(4)
    for _ in range(100):
        n, m = rng.randint(1, 7), rng.randint(1, 7)
        boxes = K.phrase_boxes(n, m, [(rng.randrange(n), rng.randrange(m)) for _ in range(rng.randint(0, 6))], 3)
        parts = list(K.unboxed(boxes, 5))
        got = [tuple(p) for part in parts for p in part.T.tolist()]
        assert all(part.shape[1] <= 5 for part in parts) and len(set(got)) == len(got) == sum(np.prod([b - a + 1 for a, b in zip(x[::2], x[1::2])]) for x in boxes)


def test_similarity_reads_the_documents_once(spark):
    files = catalogue.QUERIES["domain_similarity"](spark, SF).inputFiles()  # what is left to read
    assert any("benchmark" in f for f in files) and not any("documents" in f for f in files)
