import numpy as np
import pytest

from linguaspan.llm import collision_ann


@pytest.mark.parametrize("block", [128, 8192])
def test_neighbours_recall(spark, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[5], x[9], x[20], x[21] = x[4], 0, x[10], x[10]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(700, None, 1), (None, x[0].tolist(), 1), (705, [], 1), (710, [1.0, 2.0], 1), (5, x[5].tolist(), 1), (800, [1e200] * 16, 1), (805, [float("nan")] * 16, 1)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, VEC_ID int")
    got = collision_ann.neighbours(docs, 5, block, 5).toPandas()
    ids = [i for i in range(600) if i != 9] + [800]
    y = np.vstack([x, np.ones((201, 16))])[ids]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -9)
    near = got.groupby("vec_id").neighbour_id.apply(set)
    assert set(got.vec_id) == {i for i in ids if i % 5 == 0}
    assert np.mean([len(near[i] & {ids[k] for k in np.argsort(-row)[:5]}) / 5 for i, row in zip(ids, s) if i % 5 == 0]) >= 0.9
    first = got[got.vec_id == 10].sort_values("rank").neighbour_id.tolist()
    assert first[:2] == [20, 21] and got.groupby("vec_id")["rank"].max().max() == 5  # equal vectors in order of id


def test_collisions_are_counted_and_only_those_over_the_threshold_measured():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    block, radius = collision_ann.Block(np.arange(900), x), np.full(3, 0.9)
    i, j, d = block.search(np.arange(3), x[:3], 900, radius)
    p, half = x @ block.a.T, collision_ann.HALF_WINDOW / np.sqrt(32) * 0.9
    for q in range(3):
        want = np.flatnonzero((np.abs(p - p[q]) <= half).sum(axis=1) >= collision_ann.needed(len(block.a)))
        assert set(j[i == q]) == set(want) - {q}
    assert block.verified == len(j)
