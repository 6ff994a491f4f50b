import random

import numpy as np
import pytest
from test_jaccard import expected
from test_llm import ODD, frame, prose, windows

import corpus_pipeline
from linguaspan.llm import language_id, pieces


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    shared = prose(rng, 60)
    texts = [prose(rng, 150) for _ in range(40)]
    texts += [texts[0], texts[1] + " end", None, "", shared + " " + prose(rng, 80), prose(rng, 80) + " " + shared, prose(rng, 20000)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, prose(rng, 90)), (7, texts[7]), (2, None)]


def test_every_stage_handles_odd_rows(spark, rows):
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "")
        assert kept.columns == ODD.replace(",", "").split()[::2], name
        assert kept.count() <= len(rows) and stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(rows)


def test_stages_equal_brute_force(spark, rows):
    docs = frame(spark, rows)
    key = lambda r: (str(r[0]), str(r[1]))
    language = sorted(map(key, corpus_pipeline.language(spark, docs, "").collect()))
    known = {r.doc_id: r.accepted for r in language_id.identify(docs).where("doc_id is not null and doc_id <> 2").collect()}
    assert {i for i, _ in language if i not in ("None", "2")} == {str(i) for i, ok in known.items() if ok}
    want = expected(rows, 0.5)
    assert sorted(map(key, corpus_pipeline.near_duplicates(spark, docs, "").collect())) == sorted(key(r) for r in rows if r[0] not in want or want[r[0]][0] == r[0])
    gone = {(i, p) for i, p, first in windows(rows, 50) if not first}
    left = [(i, t, [w for p, w in enumerate((t or "").split()) if (i, p) not in gone]) for i, t in rows]
    left = sorted((str(i), " ".join(ws)) for i, t, ws in left if ws or i is None or not (t or "").split())
    assert sorted((str(r[0]), " ".join((r[1] or "").split())) for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()) == left
    coder = pieces.Coder(pieces.load_model())
    for r in corpus_pipeline.tokens(spark, docs, "").collect():
        assert r.ids is None or r.exact and coder.decode(np.array(r.ids, int)).decode() in {t for i, t in rows if i == r.doc_id}


def test_run_applies_the_stages_in_turn(spark, rows, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, now.collect()))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
