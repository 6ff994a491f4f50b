import random
import resource
import subprocess
import sys

import numpy as np
import pyarrow as pa
from test_llm import ODD, prose

from linguaspan.llm import language_id


def test_bundles_are_built_letter_by_letter():
    texts = ["Hello, World! hello", "", "ab", "国际社会 的 国际", "Ω ω Ж ж é É é", " 12 34 ", None, "a" * 50, "héllo wörld ß 国 x" * 30]
    got = language_id.bundles(pa.array(texts))
    for text, vector in zip(texts, got):
        letters = []
        for c in text or "":
            x = int(language_id._letters_of(np.array([ord(c)], np.uint32))[0])
            if x or not letters or letters[-1]:
                letters.append(x)
        want = np.zeros(language_id.WIDTH)
        for k in range(len(letters) - 2):
            if any(letters[k : k + 3]):
                bound = np.ones(language_id.WIDTH)
                for late, x in enumerate(letters[k : k + 3]):
                    bound = bound * np.roll(language_id.letter_vectors(np.array([x]))[0], 2 - late)
                want += bound
        assert np.array_equal(vector, want)


def test_every_letter_has_its_own_vector():
    v = language_id.letter_vectors(np.arange(0x4E00, 0x4E00 + 3000)).astype(np.float32)
    s = v @ v.T / language_id.WIDTH
    np.fill_diagonal(s, 0)
    assert np.abs(s).max() < 0.25


def test_memory_is_bounded():
    code = """
import random, resource, pyarrow as pa
from linguaspan.llm import language_id
rng = random.Random(1)
texts = ["".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(17)) for _ in range(10000)] + ["".join(rng.choice("abcdefghij klm") for _ in range(50)) for _ in range(10000)] + ["".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(400000))]
language_id.bundles(pa.array(texts[:1]))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for lo in range(0, len(texts), 10000):
    language_id.bundles(pa.array(texts[lo : lo + 10000]))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    used = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert used < 500


def test_stage_of_odd_rows(spark):
    rng = random.Random(3)
    make = lambda lang: " ".join("".join(rng.choice({"a": "aeioulmn", "b": "krtzschü"}[lang]) for _ in range(5)) for _ in range(40))
    rows = [(i, make("ab"[i % 2]), "ab"[i % 2], "s", 1, "clash", 2) for i in range(40)] + [(None, make("a"), None, None, None, None, None), (3, None, "a", "s", 0, "x", 1), (3, "", "a", "s", 0, "x", 1), (50, make("b") * 3000, None, "s", 1, "", 1)]
    docs = spark.createDataFrame(rows + rows[:1], ODD)
    kept = language_id.accepted(docs, 0.12, 0.01, 20)
    assert kept.columns == docs.columns and sorted(str(r[0]) for r in kept.collect()) == sorted([*map(str, range(40)), "0", "None", "50"])
    assert language_id.accepted(docs.limit(0)).count() == 0 and language_id.identify(docs, 0.12, 0.01, 20).count() == len(rows) + 1
    got = language_id.identify(docs, 0.12, 0.01, 20, {"y": np.ones(language_id.WIDTH) / 32, "x": np.ones(language_id.WIDTH) / 32}).where("cosine <> 0").collect()
    assert all(r.language == "y" and r.margin == 0 and not r.accepted for r in got)  # equal cosines go to the first that is given
