from collections import Counter

import pytest
from test_llm import ODD

from linguaspan.llm import mixing, sharding


def sainte_lague(weights, seats):
    held = Counter()
    for _ in range(seats):
        held[min(weights, key=lambda s: (-weights[s] / (2 * held[s] + 1), s))] += 1
    return {s: n for s, n in held.items() if n}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, "w " * (i % 5), "en", None if i % 7 == 0 else f"s{i % 3}", 1, "clash", 2) for i in range(200)]
    rows += [(None, "a b", "en", "s0", 1, "x", 1), (None, None, None, None, None, None, None), (3, "", "en", "s1", 1, "x", 1), (5, "w", "en", "s2", 1, "x", 1), (5, "w", "en", "s2", 1, "x", 1), (300, "long " * 5000, "en", "s1", 1, "x", 1)]
    return spark.createDataFrame(rows, ODD)


def test_quotas_equal_those_of_one_seat_after_another(spark):
    for weights in ({"a": 53.0, "b": 24.0, "c": 23.0}, {"b": 1.0, "a": 1.0, "c": 1.0, "d": 3.0}, {"x": 1e-9, "y": 1.0}):
        for seats in (1, 7, 40):
            got = {r.source: r.quota for r in mixing.quotas(spark.createDataFrame(list(weights.items()), "source string, weight double"), seats).collect()}
            assert got == sainte_lague(weights, seats)


def test_mixture_of_odd_rows(odd):
    plan = mixing.plan(odd, None, 0.8, 20, 6, 1).toPandas()
    assert set(plan.source) <= {"", "s0", "s1", "s2"} and len(plan)
    taken = mixing.taken(odd, None, 0.8, 20, 6, 1)
    assert taken.columns == odd.columns
    key = lambda i, n: (i, n)
    want = Counter(key(None if r.doc_id != r.doc_id else int(r.doc_id), int(r.n_tokens)) for r in plan.itertuples())
    assert set(Counter(key(r[0], len((r[1] or "").split())) for r in taken.collect())) == set(want)
    assert mixing.taken(odd.limit(0)).count() == 0 and mixing.dropped(odd.limit(0)).count() == 0


def test_shuffle_of_odd_rows(odd):
    got = sharding.shuffled(odd, 4, 3).toPandas()
    n = odd.count()
    assert sorted(got.row_number) == list(range(n)) == sorted(got.place) and (got.shard == got.place % 4).all()
    assert got.sort_values("row_number").doc_id.isna().tolist() == [True] * 2 + [False] * (n - 2)
    carried = sharding.shuffled(odd, 4, 3, carry=("text",))
    again = sharding.shuffled(odd.repartition(7), 4, 3, carry=("text",))
    assert sorted(map(str, carried.collect())) == sorted(map(str, again.collect()))  # ties go by what is carried
    with pytest.raises(ValueError):
        sharding.shuffled(odd.toDF(*["shard", *odd.columns[1:]]), 4, 3, id_column="shard")
