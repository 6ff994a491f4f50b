"""Language identification with hyperdimensional profiles.

Every letter of any script has a random vector of +1 and -1, of a hash of its code point. An n-gram vector binds (multiplies) the vectors of its letters,
each permuted (rotated) once for every later letter; a text bundles (adds) the vectors of its n-grams. A language
prototype bundles the unit vectors of a bounded sample of labelled texts. A text gets the language of the
prototype of highest cosine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..runtime import pick, ship
from .textops import mix, portions, utf8

U = np.uint64

WIDTH = 1024
PLANES = 0x32400  # code points of the first planes; what is beyond holds no letters
CELLS = 1 << 24  # texts times different trigrams that are bundled at a time


def _alphabet() -> np.ndarray:
    """Code point -> letter: the code point of its lower case; 0 for what is neither a letter nor a mark of one."""
    table = np.zeros(PLANES, np.uint32)
    for cp in range(PLANES):
        if unicodedata.category(chr(cp))[0] in "LM":
            low = chr(cp).lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


_cache: dict[str, np.ndarray] = {}


def _letters_of(points: np.ndarray) -> np.ndarray:
    if not _cache:
        _cache["alphabet"] = _alphabet()
    return np.where(points < PLANES, _cache["alphabet"][np.minimum(points, PLANES - 1)], 0)


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """[letters, WIDTH]: a random vector of +1 and -1 of each letter's own, the bits of a hash of its code point; 0 stands for all that is no letter."""
    bits = mix(mix(letters.astype(np.uint64)[:, None] + U(1)) + np.arange(1, WIDTH // 64 + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def gram_vectors(first: np.ndarray, second: np.ndarray, third: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The bound vector of each trigram; its letters are given as rows of `letters`, vectors of which earlier ones are rotated further."""
    return (np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]).astype(np.float32)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Text number, trigram (numbers of letters) and count, by text, of the texts in data[offsets[0]:offsets[-1]]; the letters; and the bits of a number. Runs of non-letters are one letter."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = data[lo:hi]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets - lo]
    symbols = _letters_of(points)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(begins))
    gap = symbols == 0
    keep = np.ones(len(symbols), bool)
    keep[1:] = ~(gap[1:] & gap[:-1] & (text[1:] == text[:-1]))
    symbols, text = symbols[keep], text[keep]
    place = np.zeros(PLANES, np.int64)
    place[symbols] = 1
    letters = np.flatnonzero(place)
    place[letters] = np.arange(len(letters))
    number, bits = place[symbols], max(1, int(len(letters)).bit_length())
    if len(number) < 3:
        return (np.zeros(0, np.int64),) * 3 + (letters, bits)
    ok = text[:-2] == text[2:]
    if len(letters) and letters[0] == 0:
        solid = number > 0
        ok &= solid[:-2] | solid[1:-1] | solid[2:]
    code, text = (number[:-2] << 2 * bits | number[1:-1] << bits | number[2:])[ok], text[:-2][ok]
    if 3 * bits + len(offsets).bit_length() < 63:
        key = text << 3 * bits | code
        key.sort()
        text, code = key >> 3 * bits, key & (1 << 3 * bits) - 1
    else:
        order = np.lexsort((code, text))
        text, code = text[order], code[order]
    new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])])) if len(code) else np.zeros(0, np.int64)
    return text[new], code[new], np.diff(np.append(new, len(code))), letters, bits


def bundles(column: pa.Array) -> np.ndarray:
    """A vector for each text; zero for one without letters. Memory is bounded by CELLS, whatever the texts' lengths and letters."""
    data, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, WIDTH), np.float32)
    for a, b in portions(offsets, 1 << 19):
        text, code, count, letters, bits = trigrams(data, offsets[a : b + 1])
        if not len(text):
            continue
        vectors = letter_vectors(letters)
        lo = 0
        while lo < len(text):
            first, n, hi = text[lo], int(text[-1] - text[lo]) + 1, len(text)
            known, at = np.unique(code[lo:hi], return_inverse=True)
            while n > 1 and n * len(known) > CELLS:  # one text has no more trigrams than characters, and these are bounded by its own size
                n = max(1, n // 2)
                hi = int(np.searchsorted(text, first + n))
                known, at = np.unique(code[lo:hi], return_inverse=True)
            dense = np.zeros((n, len(known)), np.float32)
            dense[text[lo:hi] - first, at] = count[lo:hi]
            for c in range(0, len(known), 4096):
                k = known[c : c + 4096]
                out[a + first : a + first + len(dense)] += dense[:, c : c + 4096] @ gram_vectors(k >> 2 * bits, k >> bits & (1 << bits) - 1, k & (1 << bits) - 1, vectors)
            lo = hi
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def prototypes(docs: DataFrame, sample_per_language: int = 300) -> dict[str, np.ndarray]:
    """A prototype for each value of `lang`, of its `sample_per_language` labelled texts of least hash: the documented bound."""
    ship(docs.sparkSession)
    rows = pick(docs, "doc_id", "text", "lang").where("lang is not null and text is not null").withColumn("h", F.xxhash64("doc_id"))
    least = rows.select("lang", "h").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= sample_per_language)
    bounds = {r["lang"]: r["most"] for r in least.groupBy("lang").agg(F.max("h").alias("most")).collect()}
    if not bounds:
        return {}
    limit = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col("lang")]

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        total = unit(bundles(pa.array(pdf["text"], pa.string()))).sum(axis=0, dtype=np.float64)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "profile": [total.tolist()]})

    found = rows.where(F.col("h") <= limit).groupBy("lang").applyInPandas(bundle, "lang string, profile array<double>").collect()
    out = {r["lang"]: np.asarray(r["profile"], np.float64) for r in sorted(found, key=lambda r: r["lang"])}
    return {k: v / n for k, v in out.items() if (n := np.linalg.norm(v)) > 0}


def judge(column: pa.Array, names: list[str], profiles: np.ndarray, min_cosine: float, min_margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its cosine, its lead over the second, and whether the text is accepted."""
    cosines = np.round(unit(bundles(column)).astype(np.float64) @ profiles.T, 6)
    order = np.argsort(-cosines, axis=1, kind="stable")
    rows = np.arange(len(cosines))
    best = cosines[rows, order[:, 0]]
    lead = best - cosines[rows, order[:, 1]] if len(names) > 1 else best
    return np.asarray(names, dtype=object)[order[:, 0]], best, lead, (best >= min_cosine) & (lead >= min_margin)


def identify(docs: DataFrame, min_cosine: float = 0.12, min_margin: float = 0.01, sample_per_language: int = 300, profiles: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, language, cosine, margin, accepted) for every row of docs (doc_id, text, lang).

    A text is accepted if its best cosine reaches min_cosine and leads the second by min_margin. Null, empty and
    letterless texts have cosine 0 and are rejected (language null), and so are texts of fewer than three letters and gaps. A null lang only keeps a row out of the sample; a null doc_id is
    carried along; repeated rows are judged each; equal cosines go to the first language by name. With no labelled
    row nothing is known and every text is rejected. An empty table gives no row. Texts are used whole, in bounded memory. Other columns are ignored.
    """
    ship(docs.sparkSession)
    known = prototypes(docs, sample_per_language) if profiles is None else profiles
    names, matrix = list(known), np.array(list(known.values()), np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if names:
                language, cosine, margin, accepted = judge(batch.column("text"), names, matrix, min_cosine, min_margin)
                language[cosine == 0] = None
            else:
                language, cosine, margin, accepted = np.full(n, None, object), np.zeros(n), np.zeros(n), np.zeros(n, bool)
            yield pa.record_batch([batch.column("doc_id"), pa.array(language, pa.string()), pa.array(cosine), pa.array(margin), pa.array(accepted)], names=["doc_id", "language", "cosine", "margin", "accepted"])

    rows = pick(docs, "doc_id", "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("language string, cosine double, margin double, accepted boolean")]))


def accepted(docs: DataFrame, min_cosine: float = 0.12, min_margin: float = 0.01, sample_per_language: int = 300) -> DataFrame:
    """The rows of docs, with all their columns, that identify() accepts: decided row by row, without a join or shuffle.

    Null, empty and letterless texts go; a null doc_id or lang alone doesn't make a row go; of repeated rows all stay or go; an empty table gives no row.
    Other columns, whatever their names, are carried along.
    """
    ship(docs.sparkSession)
    known = prototypes(docs, sample_per_language)
    names, matrix = list(known), np.array(list(known.values()), np.float64)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = judge(batch.column(at), names, matrix, min_cosine, min_margin)[3] if names else np.zeros(batch.num_rows, bool)
            yield batch.filter(pa.array(ok))

    flat = docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])  # names may clash
    return flat.mapInArrow(run, flat.schema).toDF(*docs.columns)
