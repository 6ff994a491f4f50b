"""Line sequence labelling: a linear-chain conditional random field marks lines content or boilerplate.

The field has two labels (0 boilerplate, 1 content), a weight for each line feature and label, and weights for
the first label and each transition. It is trained on a bounded sample of documents labelled good or poor; the labels of
their lines are latent. They are estimated in rounds: first line by line, from how often such lines stand in good and in poor documents,
then by the field itself, so that a poor document may have lines of content and a good one boilerplate, and transitions are learnt
from both. Viterbi decoding then labels every line of every document, and the share of bytes in content lines decides whether a document stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import pick, ship
from .textops import BYTE, _powers, mix, portions, utf8, word_hashes, words

U = np.uint64
FEATURES = ("bias", "short", "long", "letters", "digits", "capitals", "symbols", "bars", "marks_per_word", "word_length", "ends_sentence", "repeated", "first", "last", "echoes")


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_LETTER = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER[128:] = True
_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_SYMBOL = _class("#$%&*<>=@[]\\^_`{}~+/")
_BAR = _class("|\t>»")
_STOP = _class(".!?:;\"')")
_LOUD = _class("!?")
_SPACE = _class(" \t\r\f\v")


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each line that isn't blank, and the number of such lines before each text."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    breaks = np.flatnonzero(data[lo:hi] == 10) + lo
    begins = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begins = begins[begins < hi]
    if not len(begins):
        return begins, begins, np.zeros(len(offsets), np.int64)
    ends = np.append(begins[1:], hi)
    ends = ends - (data[ends - 1] == 10)
    solid = np.concatenate([[0], np.cumsum(~(_SPACE | _class("\n"))[data[lo:hi]])])
    keep = solid[ends - lo] > solid[begins - lo]
    begins, ends = begins[keep], ends[keep]
    return begins, ends, np.searchsorted(begins, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature matrix of the lines, their sizes in bytes, and the number of lines before each text."""
    begins, ends, bounds = lines(data, offsets)
    if not len(begins):
        return np.zeros((0, len(FEATURES))), np.zeros(0), bounds
    lo, raw = int(offsets[0]), data[int(offsets[0]) : int(offsets[-1])]

    def count(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
        return (total[ends - lo] - total[begins - lo]).astype(np.float64)

    size = (ends - begins).astype(np.float64)
    spaces = count(_SPACE)
    solid = np.maximum(size - spaces, 1)
    word_count = spaces + 1
    letter = count(_LETTER)
    place = np.arange(int(size.sum())) - np.repeat((np.cumsum(size) - size).astype(np.int64), size.astype(np.int64))
    at = place + np.repeat(begins, size.astype(np.int64))
    hashes = mix(np.add.reduceat(BYTE[data[at]] * _powers(int(size.max()))[place], (np.cumsum(size) - size).astype(np.int64)))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((np.arange(len(text)), hashes, text))
    repeated = np.zeros(len(text))
    same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    repeated[order[1:][same]] = 1
    first, last = np.zeros(len(text)), np.zeros(len(text))
    full = np.flatnonzero(np.diff(bounds) > 0)
    first[bounds[full]] = 1
    last[bounds[full + 1] - 1] = 1
    word, word_ends, _ = words(data, offsets)
    tokens = word_hashes(data, word, word_ends)
    line = np.searchsorted(begins, word, "right") - 1
    echo = np.flatnonzero((tokens[1:] == tokens[:-1]) & (line[1:] == line[:-1]))
    echoes = np.bincount(line[echo], minlength=len(size)) / np.maximum(np.bincount(line, minlength=len(size)), 1)
    x = np.column_stack([
        np.ones(len(size)), size < 25, np.minimum(np.log1p(size) / 8, 1.5), letter / solid, count(_DIGIT) / solid, count(_UPPER) / np.maximum(letter, 1),
        count(_SYMBOL) / solid, np.minimum(count(_BAR) / word_count, 1), np.minimum(count(_LOUD) / word_count, 1), np.minimum(solid / word_count / 10, 2),
        _STOP[data[ends - 1]], repeated, first, last, echoes,
    ])
    return x, size, bounds


@dataclass
class Field:
    """weights: [2, features]; start: [2]; moves: [from, to]."""

    weights: np.ndarray
    start: np.ndarray
    moves: np.ndarray


def untrained() -> Field:
    """For corpora without labels of both kinds: symbols, bars, shouting, capitals and repeats speak for boilerplate."""
    w = np.zeros((2, len(FEATURES)))
    w[1] = [2.0, -0.3, 0, 1.0, -3.0, -3.0, -15.0, -6.0, -6.0, 0, 0.5, -1.5, 0, 0, -6.0]
    return Field(w, np.zeros(2), np.array([[0.8, -0.8], [-0.8, 0.8]]))


def _steps(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences by falling length, and for each step how many of these still have a line."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    longest = int(size.max()) if len(size) else 0
    return order, np.searchsorted(-size[order], -np.arange(longest), "left")


def viterbi(x: np.ndarray, bounds: np.ndarray, field: Field) -> np.ndarray:
    """The likeliest labels of all lines, all sequences side by side; ties go to the lower label."""
    score = x @ field.weights.T
    out, back = np.zeros(len(x), np.int8), np.zeros((len(x), 2), np.int8)
    order, live = _steps(bounds)
    base, size = bounds[:-1][order], np.diff(bounds)[order]
    if not len(live):
        return out
    best = field.start + score[base[: live[0]]]
    ends = best.copy()
    for t in range(1, len(live)):
        n = live[t]
        reach = best[:n, :, None] + field.moves
        back[base[:n] + t] = reach.argmax(axis=1)
        best = reach.max(axis=1) + score[base[:n] + t]
        ends[:n] = best
    label = ends.argmax(axis=1)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        out[base[:n] + t] = label[:n]
        label[:n] = back[base[:n] + t, label[:n]]
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def lines_alone(x: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model of single lines, both labels of equal weight together, by Newton's method."""
    share = np.where(labels, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (share * (labels - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(x: np.ndarray, bounds: np.ndarray, labels: np.ndarray, rounds: int = 150, ridge: float = 1e-4, weights: np.ndarray | None = None) -> Field:
    """Maximum conditional likelihood by Adam with exact forward-backward gradients; labels: one for each line; weights: to begin with."""
    order, live = _steps(bounds)
    base = bounds[:-1][order]
    n_lines, gold = len(x), np.eye(2)[labels]
    inner = np.ones(n_lines, bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    gold_moves = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(gold_moves, (labels[at - 1], labels[at]), 1)
    p = [np.zeros((2, x.shape[1])) if weights is None else weights, np.zeros(2), np.zeros((2, 2))]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for i in range(1, rounds + 1):
        score = x @ p[0].T
        alpha, beta = np.zeros((n_lines, 2)), np.zeros((n_lines, 2))
        alpha[base[: live[0]]] = p[1] + score[base[: live[0]]]
        for t in range(1, len(live)):
            a = base[: live[t]] + t
            alpha[a] = _lse(alpha[a - 1][:, :, None] + p[2], 1) + score[a]
        for t in range(len(live) - 1, 0, -1):
            a = base[: live[t]] + t
            beta[a - 1] = _lse(p[2] + (score[a] + beta[a])[:, None, :], 2)
        total = np.repeat(_lse(alpha + beta, 1)[bounds[:-1][np.diff(bounds) > 0]], np.diff(bounds)[np.diff(bounds) > 0])
        each = np.exp(alpha + beta - total[:, None])
        both = np.exp(alpha[at - 1][:, :, None] + p[2] + (score[at] + beta[at])[:, None, :] - total[at][:, None, None]).sum(axis=0) if len(at) else 0
        heads = base[: live[0]]
        grads = [(gold - each).T @ x, (gold - each)[heads].sum(axis=0), gold_moves - both]
        for k in range(3):
            g = grads[k] / n_lines - ridge * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] + 0.1 * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
    return Field(*p)


def latent(x: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, good: np.ndarray, rounds: int = 3) -> Field:
    """A field for lines of which only their documents' labels are known. good: of each document; sizes: bytes of each line.

    The first labels are those of a field without transitions; then fields are trained on what the last one says, but for the lines that it makes
    contradict their document: of a document's lines, those of least score are boilerplate until half of a poor one's bytes are, and those of highest score are
    content until half of a good one's are.
    """
    document = np.repeat(np.arange(len(good)), np.diff(bounds))
    weights = lines_alone(x, good[document].astype(np.int64))
    field = Field(np.stack([-weights / 2, weights / 2]), np.zeros(2), np.zeros((2, 2)))
    for _ in range(rounds):
        score = x @ (field.weights[1] - field.weights[0])
        labels = viterbi(x, bounds, field).astype(np.int64)
        rank = np.where(good[document], -score, score)  # what first becomes the document's own label
        order = np.lexsort((np.arange(len(x)), rank, document))
        before = np.cumsum(sizes[order]) - sizes[order]
        before -= before[bounds[:-1]][document[order]] if len(order) else 0  # the order keeps documents in place
        total = np.bincount(document, sizes, len(good))
        sure = np.empty(len(x), bool)
        sure[order] = before < total[document[order]] / 2
        labels = np.where(sure, good[document], labels).astype(np.int64)
        weights = lines_alone(x, labels)
        field = train(x, bounds, labels, 60, weights=np.stack([-weights / 2, weights / 2]))
    return field


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 2000) -> Field:
    """A field trained on the `sample_docs` labelled documents of least hash: the documented bound of the sample.

    A null doc_id or quality is no label; of a doc_id's labels the lowest counts, and repeated rows of a document each do. Null and empty texts have no lines. Without labelled
    lines of both kinds (empty tables too) the field is untrained().
    """
    ship(docs.sparkSession)
    marks = pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_docs rows are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            x, size, bounds = features(data, offsets)
            x = np.column_stack([x, size])
            yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array([x[a:b].astype(np.float32).tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["doc_id", "quality", "x"])

    found = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("quality", rows.schema["quality"].dataType), T.StructField("x", T.BinaryType())])).collect()
    found = sorted((r for r in found if r["x"]), key=lambda r: (r["doc_id"], bytes(r["x"])))
    good = np.array([r["quality"] > 0 for r in found], bool)
    if len(set(good.tolist())) < 2:
        return untrained()
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES) + 1) for r in found]
    x = np.concatenate(parts).astype(np.float64)
    return latent(x[:, :-1], x[:, -1], np.concatenate([[0], np.cumsum([len(p) for p in parts])]), good)


def label_lines(docs: DataFrame, field: Field, min_share: float = 0.5) -> DataFrame:
    """(doc_id, n_lines, n_content, content_share, retained) for every row of docs (doc_id, text).

    content_share is the share of bytes in lines marked content; a document is retained if it reaches min_share.
    Blank lines are no lines. A null or empty text has no line, share 0, and is not retained. A null doc_id is carried
    along, repeated rows are judged each, ties in decoding go to boilerplate, other columns are ignored. An empty table gives no row. Texts are used whole.
    """
    ship(docs.sparkSession)
    rows = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n, good, share = (np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, np.float64))
            for a, b in portions(offsets):
                x, size, bounds = features(data, offsets[a : b + 1])
                label = viterbi(x, bounds, field)
                counts = [np.concatenate([[0], np.cumsum(y)]) for y in (label.astype(np.int64), label * size, size)]
                inside = [c[bounds[1:]] - c[bounds[:-1]] for c in counts]
                n[a:b], good[a:b], share[a:b] = np.diff(bounds), inside[0], inside[1] / np.maximum(inside[2], 1)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n), pa.array(good), pa.array(share), pa.array((n > 0) & (share >= min_share))], names=["doc_id", "n_lines", "n_content", "content_share", "retained"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("n_lines bigint, n_content bigint, content_share double, retained boolean")]))
