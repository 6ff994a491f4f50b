import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from linguaspan.llm import collision_ann, host_suffixes, language_id, line_quality, mixing, phrase_automata, pieces, repeats, sharding, signature_trees, suffix_dedup

ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string, Doc_Id int"


def prose(rng, n, stem=""):
    return " ".join(stem + "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    shared, other = prose(rng, 60), prose(rng, 55)
    texts = [prose(rng, rng.randint(20, 200)) for _ in range(20)]
    texts += [prose(rng, 30) + "\n" + shared + "  " + prose(rng, 30) for _ in range(4)]
    texts += [shared, other + " " + prose(rng, 9), prose(rng, 9) + " " + other, "x " * 300, "x " * 200]
    texts += [texts[0], texts[0], texts[1] + " more", None, "", "one", "one", " \n ", "long " + prose(rng, 30000)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, shared), (3, texts[3])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), "clash", 1) for i, t in rows], ODD)


def windows(rows, w):
    home, docs = {}, {}
    for i, t in rows:
        ws = (t or "").split() if i is not None else []
        for s in range(len(ws) - w + 1):
            k = tuple(ws[s : s + w])
            home[k] = min(home.get(k, i), i)
            docs.setdefault(k, set()).add(i)
    out = set()
    for i, t in rows:
        ws = (t or "").split() if i is not None else []
        for s in range(len(ws) - w + 1):
            k = tuple(ws[s : s + w])
            if len(docs[k]) > 1:
                out |= {(i, p, home[k] == i) for p in range(s, s + w)}
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 23, 900])
def test_repeats_equal_brute_force(spark, corpus, shard_bytes, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard_bytes)
    docs = frame(spark, corpus)
    want = windows(corpus, 50)
    got = {(r.doc_id, p, r.first_copy) for r in suffix_dedup.duplicates(docs, 50).collect() for p in range(r.start_word, r.end_word)}
    assert got == want


@pytest.mark.parametrize("shard_bytes", [1 << 23, 900])
def test_phrases_equal_brute_force(spark, corpus, shard_bytes, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard_bytes)
    got = {(r.doc_id, p, r.home == r.doc_id) for r in phrase_automata.occurrences(frame(spark, corpus), 50).collect() for p in range(r.start_word, r.end_word)}
    assert got == windows(corpus, 50)


def test_repeats_are_removed_but_for_their_home(spark, corpus):
    docs = frame(spark, corpus)
    kept = phrase_automata.without_repeats(docs, 50)
    assert kept.columns == docs.columns
    gone = {(i, p) for i, p, first in windows(corpus, 50) if not first}
    want = sorted((str(i), " ".join(w for p, w in enumerate((t or "").split()) if (i, p) not in gone)) for i, t in corpus if t is None or i is None or not t.split() or any((i, p) not in gone for p in range(len(t.split()))))
    assert sorted((str(r[0]), " ".join((r[1] or "").split())) for r in kept.collect()) == want


def test_shuffle_is_a_permutation_that_can_be_computed(spark):
    for n in (1, 2, 5, 64, 1000):
        p = sharding.permute(np.arange(n), n, 3)
        assert sorted(p) == list(range(n)) and (sharding.permute(p, n, 3, back=True) == np.arange(n)).all()
    rows = spark.createDataFrame([(i // 2 if i else None, "c") for i in range(51)], "doc_id bigint, Shard string")
    got = sharding.shuffled(rows, 4, 3).toPandas()
    assert sorted(got.row_number) == list(range(51)) and got.groupby("shard").size().max() - got.groupby("shard").size().min() <= 1
    r = got.iloc[7]
    assert sharding.locate(int(r["shard"]), int(r["slot"]), 51, 4, 3) == r["row_number"]
    assert sharding.shuffled(rows.limit(0), 4, 3).count() == 0


def test_quotas_are_sainte_lague(spark):
    got = {r.source: r.quota for r in mixing.quotas(spark.createDataFrame([("a", 53.0), ("b", 24.0), ("c", 23.0), ("d", 0.0)], "source string, weight double"), 7).collect()}
    assert got == {"a": 3, "b": 2, "c": 2}


def test_mixture_takes_whole_blocks(spark):
    rows = [(i, "w " * 10, None if i % 7 == 0 else f"s{i % 3}") for i in range(300)] + [(None, None, "s0"), (5, "w " * 10, "s2")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = mixing.plan(docs, {"s0": 2.0, "s1": 1.0, "": 1.0}, 0.8, 50, 8, 1).toPandas()
    assert set(plan.source) <= {"s0", "s1", ""}
    used = plan.groupby(["source", "shard"]).block.nunique()
    assert (used.loc["s0"] == 4).all() and (used.loc["s1"] == 2).all()
    taken = mixing.taken(docs, None, 1.0, 50, 8, 1)
    assert taken.columns == docs.columns and 0 < taken.count() <= 302
    assert mixing.plan(docs.limit(0)).count() == 0


def test_what_the_mixture_drops_is_told(spark):
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(300)] + [(300 + i, "w " * 10, "rare") for i in range(5)] + [(400, None, "void")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.source: r for r in mixing.dropped(docs, None, 0.8, 50, 3, 1).collect()}
    plan = mixing.plan(docs, None, 0.8, 50, 3, 1).toPandas()
    assert set(got) == {"s0", "s1", "s2", "rare", "void"} and got["rare"].share == 1.0 and got["void"].docs_dropped == 1 and got["void"].share == 0.0
    for s, r in got.items():
        mine = plan[plan.source == s]
        assert (r.n_docs - r.docs_dropped, r.n_tokens - r.tokens_dropped) == (len(mine), mine.n_tokens.sum())


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    x, bounds = rng.normal(size=(11, len(line_quality.FEATURES))), np.array([0, 4, 4, 11])
    field = line_quality.Field(rng.normal(size=(2, x.shape[1])), rng.normal(size=2), rng.normal(size=(2, 2)))
    got = line_quality.viterbi(x, bounds, field)
    score = x @ field.weights.T
    for a, b in zip(bounds[:-1], bounds[1:]):
        best = max(itertools.product((0, 1), repeat=b - a), key=lambda y: field.start[y[0]] + sum(score[a + k, y[k]] for k in range(b - a)) + sum(field.moves[y[k - 1], y[k]] for k in range(1, b - a))) if b > a else ()
        assert tuple(got[a:b]) == best


def test_lines_of_odd_texts(spark, corpus):
    got = {(r.doc_id, r.n_lines) for r in line_quality.label_lines(frame(spark, corpus), line_quality.untrained()).collect()}
    assert (20, 2) in got and any(n == 0 for _, n in got)
    labels = spark.createDataFrame([(0, 1), (0, 1), (24, 0), (None, 1)], "doc_id bigint, quality int")
    line_quality.fit(frame(spark, corpus), labels)


def test_languages_by_held_out_accuracy(spark):
    rng = random.Random(2)
    make = lambda lang: " ".join("".join(rng.choice({"a": "aeioulmn", "b": "krtzschü", "c": "qwxyjvpb"}[lang]) for _ in range(5)) for _ in range(40))
    rows = [(i, make("abc"[i % 3]), "abc"[i % 3] if i < 60 else None) for i in range(120)] + [(500, None, "a"), (501, "", None), (502, "123 456", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, 0.12, 0.01, 20).collect()}
    assert np.mean([got[i].language == "abc"[i % 3] for i in range(60, 120)]) > 0.95
    assert not any(got[i].accepted for i in (500, 501, 502))
    assert language_id.accepted(docs, 0.12, 0.01, 20).columns == docs.columns
    assert language_id.identify(docs.limit(0)).count() == 0


def test_pages_keep_unique_runs(spark, monkeypatch):
    rng = random.Random(4)
    nav = "".join(f"<li><a href='/{k}'>menu{k}</a></li>" for k in range(12))
    bodies = [prose(rng, 40) for _ in range(6)]
    html = [f"<html><head><title>t</title><script>var x='<p>';</script></head><body><ul>{nav}</ul><p>{b}</p><div>one &amp; two {b}</div></body></html>" for b in bodies]
    rows = [(i, "http://User@Site.org:80/a" if i < 5 else "http://b.org/", h) for i, h in enumerate(html)] + [(7, None, None), (8, "nothing", ""), (9, "http://site.org/x", html[0]), (None, "http://site.org/", "<p>broken < a <b")]
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for shard_bytes in (1 << 23, 500):
        monkeypatch.setattr(host_suffixes, "HOST_BYTES", shard_bytes)
        got = {r.page_id: r for r in host_suffixes.extract(docs).collect()}
        assert got[0].host == "site.org" and "menu3" not in got[0].text and bodies[0] in got[0].text and "one & two" in got[0].text
        assert got[9].text == got[0].text and "menu3" in got[5].text
        assert got[7].text == "" and got[8].n_words == 0 and len(got) == 10


def test_empty_tables(spark):
    docs = spark.createDataFrame([], ODD)
    assert suffix_dedup.duplicates(docs).count() == 0
    assert phrase_automata.occurrences(docs).count() == 0
    assert phrase_automata.without_repeats(docs).count() == 0
    assert signature_trees.classes(docs).count() == 0
    assert signature_trees.one_of_each(docs).count() == 0
    assert pieces.encode(docs).count() == 0
    assert collision_ann.neighbours(spark.createDataFrame([], T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))).count() == 0
    assert host_suffixes.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    texts = [prose(rng, 150) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate([*texts, texts[0], texts[1] + " end", None, ""])]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {40, 41, 42, 43} and all(r.exact for r in got) and len(ids) > 20
