import itertools
import random

import numpy as np
import pyarrow as pa
from test_llm import ODD, prose

from linguaspan.llm import line_quality
from linguaspan.llm.textops import utf8


def page(rng, kinds):
    """A document of content (1) and boilerplate (0) lines."""
    make = {1: lambda: prose(rng, rng.randint(8, 30)).capitalize() + ".", 0: lambda: " | ".join(prose(rng, 1) for _ in range(rng.randint(4, 12)))}
    return "\n".join(make[k]() for k in kinds)


def corpus(rng, n):
    docs = []
    for i in range(n):
        good = i % 3 > 0
        kinds = [1] * rng.randint(4, 12) if good else [0] * rng.randint(4, 12)
        if rng.random() < 0.5:  # boilerplate around content, or some content in boilerplate
            kinds = [1 - kinds[0]] * rng.randint(1, 2) + kinds
        docs.append((i, page(rng, kinds), kinds, int(good)))
    return docs


def test_boilerplate_lines_are_found_in_good_documents(spark):
    rng = random.Random(4)
    train, held = corpus(rng, 300), corpus(rng, 200)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in train], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in train] + [(None, 1), (5, None), (900, 1)], "doc_id bigint, quality int")
    field = line_quality.fit(docs, labels)
    x, sizes, bounds = line_quality.features(*utf8(pa.array([t for _, t, _, _ in held])))
    got, want = line_quality.viterbi(x, bounds, field), np.array([k for _, _, kinds, _ in held for k in kinds])
    hit = ((got == 0) & (want == 0)).sum()
    assert hit / (got == 0).sum() > 0.95 and hit / (want == 0).sum() > 0.95  # precision and recall of boilerplate lines
    mixed = [i for i, (a, b) in enumerate(itertools.pairwise(bounds)) if len(set(want[a:b])) > 1]
    assert np.mean([len(set(got[bounds[i] : bounds[i + 1]])) > 1 for i in mixed]) > 0.9
    out = {r.doc_id: r for r in line_quality.label_lines(spark.createDataFrame([(i, t) for i, t, _, _ in held], "doc_id bigint, text string"), field).collect()}
    assert np.mean([out[i].retained == (q == 1) for i, _, _, q in held]) > 0.95


def test_share_and_retention_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [page(rng, [rng.randint(0, 1) for _ in range(rng.randint(1, 9))]) for _ in range(30)] + [None, "", " \n\t\n", "one", "tie\ntie", "a | b\n" * 3, page(rng, [0, 1] * 3000)]
    field = line_quality.untrained()
    got = line_quality.label_lines(spark.createDataFrame([(i if i else None, t, "en", "s", 1, "clash", 2) for i, t in enumerate(texts)] + [(3, texts[3], None, None, None, None, None)], ODD), field).collect()
    assert len(got) == len(texts) + 1
    by = {r.doc_id: r for r in got}
    for i, text in enumerate(texts):
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\f\v")]
        r = by[i if i else None]
        assert r.n_lines == len(lines)
        if not lines:
            assert (r.n_content, r.content_share, r.retained) == (0, 0, False)
        elif len(lines) < 10:
            score = line_quality.features(*utf8(pa.array([text])))[0] @ field.weights.T
            weigh = lambda y: field.start[y[0]] + sum(score[k, a] for k, a in enumerate(y)) + sum(field.moves[a, b] for a, b in itertools.pairwise(y))
            best = max(itertools.product((0, 1), repeat=len(lines)), key=weigh)
            share = sum(len(x.encode()) for x, y in zip(lines, best) if y) / sum(len(x.encode()) for x in lines)
            assert r.n_content == sum(best) and abs(r.content_share - share) < 1e-12 and r.retained == (share >= 0.5)


def test_ties_and_empty_tables(spark):
    flat = line_quality.Field(np.zeros((2, len(line_quality.FEATURES))), np.zeros(2), np.zeros((2, 2)))
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id bigint, text string")
    assert [(r.n_content, r.retained) for r in line_quality.label_lines(docs, flat).collect()] == [(0, False)]
    none = docs.limit(0)
    assert line_quality.label_lines(none, flat).count() == 0
    field = line_quality.fit(none, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert np.array_equal(field.weights, line_quality.untrained().weights)


def test_gradients_lead_to_the_likeliest_field():
    """The field's moves and weights equal those of a plain search for the same likelihood."""
    rng = np.random.default_rng(3)
    x, bounds = np.column_stack([np.ones(60), rng.normal(size=60)]), np.arange(0, 61, 5)
    labels = (x[:, 1] + rng.normal(size=60) > 0).astype(int)
    field = line_quality.train(x, bounds, labels, 3000, 1e-2)

    def loss(weights, start, moves):
        total = 0.0
        for a, b in itertools.pairwise(bounds):
            s = x[a:b] @ weights.T
            paths = {y: start[y[0]] + sum(s[k, v] for k, v in enumerate(y)) + sum(moves[u, v] for u, v in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=b - a)}
            top = max(paths.values())
            total += paths[tuple(labels[a:b])] - top - np.log(sum(np.exp(v - top) for v in paths.values()))
        return -total / 60 + 0.005 * sum((p**2).sum() for p in (weights, start, moves))

    at = loss(field.weights, field.start, field.moves)
    for k, p in enumerate((field.weights, field.start, field.moves)):
        for i in np.ndindex(p.shape):
            for step in (0.05, -0.05):
                other = [q.copy() for q in (field.weights, field.start, field.moves)]
                other[k][i] += step
                assert loss(*other) > at - 1e-7
