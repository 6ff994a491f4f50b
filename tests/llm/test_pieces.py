import itertools
import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from test_llm import ODD, prose

from linguaspan.llm import pieces


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    bits = ["ab", " ", "the", "国", "é", "\n", "  ", "ing", "x", "_", "==", "1", "00", "🙂"]
    out = ["", " ", "a", "the international community  and   others\n\n", "é漢字🙂 x" * 40, "国际社会" * 90, " " * 1500, "a" * 1500, "=" * 900 + "-" * 300, "the international community " * 40, prose(rng, 400)]
    return out + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 900))) for _ in range(12)]


@pytest.mark.parametrize("segment", [64, 200, 1 << 16])
def test_pieces_are_those_of_the_unaltered_library(spark, texts, segment):
    got = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), segment_chars=segment, chunk=64).collect()
    sp = SentencePieceProcessor(model_file=pieces.MODEL)
    assert {r.doc_id: r.ids for r in got} == dict(enumerate(sp.encode(texts))) and all(r.exact for r in got)


def test_a_giant_text_at_the_default_chunk(spark):
    rng = random.Random(3)
    text = prose(rng, 15000) + " " * 3000 + "a" * 70000 + "国際" * 9000 + prose(rng, 3000)
    row = pieces.encode(spark.createDataFrame([(1, text, "en", "s", 1, "clash", 2), (1, text, None, None, None, None, None)], ODD)).collect()
    want = SentencePieceProcessor(model_file=pieces.MODEL).encode(text)
    assert len(row) == 2 and all(r.ids == want and r.exact and r.n_tokens == len(want) for r in row)


def test_transfer_matrices_equal_brute_force(texts):
    """The states that a chunk's matrix joins are those between which a row of neighbours leads; their products are associative and give the whole."""
    coder = pieces.Coder(pieces.load_model())
    for text in texts[4:]:
        ready = coder.prepare(text)[0][:330]
        cuts = [0, 70, 150, 250, len(ready)]
        if len(ready) < 330:
            continue
        m = [coder.transfer(ready[max(0, a - 16) : b + 16], a - max(0, a - 16), max(0, min(len(ready), b + 16) - b), a == 0) for a, b in itertools.pairwise(cuts)]
        found = coder.matches(ready)
        for (a, b), matrix in zip(itertools.pairwise(cuts), m):
            for (piece, over), ends in matrix.items():
                reached, todo, want = {(a + over, piece)}, [(a + over, piece)], set()
                while todo:
                    i, c = todo.pop()
                    if i >= b:
                        want.add((c, i - b))
                        continue
                    for size, x in found[i]:
                        if coder.neighbours(c, x) and (i + size, x) not in reached:
                            reached.add((i + size, x))
                            todo.append((i + size, x))
                assert ends == want
        left = pieces.combine(pieces.combine(pieces.combine(m[0], m[1]), m[2]), m[3])
        assert left == pieces.combine(m[0], pieces.combine(m[1], pieces.combine(m[2], m[3]))) == pieces.combine(pieces.combine(m[0], m[1]), pieces.combine(m[2], m[3]))
        assert sum(over == 0 for _, over in left[pieces.START, 0]) == 1
        spans = pieces.states(m)
        ids = np.concatenate([coder.backtrace(ready[max(0, a - 16) : b + 16], a - max(0, a - 16), max(0, min(len(ready), b + 16) - b), *s) for (a, b), s in zip(itertools.pairwise(cuts), spans)])
        assert ids.tolist() == coder.sp.encode(ready)


@pytest.mark.parametrize("segment", [1 << 16, 300])
def test_round_trip_of_odd_rows(spark, segment):
    rng = random.Random(6)
    every = "".join(map(chr, [*range(0x800, 0xD800), *range(0xE000, 0x10000)]))
    odd = [None, "", "▁ mark ▁▁", "  two  blanks\n\nlines\t", "▁" * 700 + prose(rng, 100), every + "▁", "\x00 nul \ufeff"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "en", "s", 1, "clash", 2) for i, t in enumerate(odd)] + [(4, odd[4], "en", "s", 1, "clash", 2)], ODD)
    got = pieces.encode(docs, segment_chars=segment, chunk=64).collect()
    assert len(got) == 8 and all(r.exact for r in got if r.doc_id != 0)
    assert [(r.n_tokens, r.ids, r.exact) for r in got if r.doc_id == 0] == [(0, None, None)] and pieces.encode(docs.limit(0)).count() == 0
