"""Substring deduplication with repeated-phrase automata.

The documents are cut into shards of bounded size. Recurring passages are confirmed first: windows of min_words words that stand in two
documents at least. A shard sends what it has once, however many of its documents have it: its anchors, to learn which recur anywhere, then its
windows at these, to learn which do. The lowest document that has a window is its home; neighbouring windows of one home are a passage. Each
shard compiles an Aho-Corasick automaton (over words, not characters) of the anchors of just those passages that its documents hold, cut from
their own texts, so no automaton grows with the corpus and no passage is sent. Every document is streamed through its shard's automaton; each
hit is extended along the passage, which locates every occurrence to its full length.

All three steps read one shuffle of the texts by shard; nothing is broadcast, collected or switched by size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import pick, ship
from .repeats import among, buckets_of, by_shard, cells, heads_of, islands, pack, reach, read_texts, recurring_by_shard
from .textops import anchors, gram_hashes, plain, portions, utf8, word_hashes, words

U = np.uint64


def _anchor_length(min_words: int) -> int:
    if min_words < 8:
        raise ValueError("min_words must be 8 at least")
    return (min_words + 1) // 2


def _windows(sharded: DataFrame, recurring: DataFrame, min_words: int, buckets: int) -> DataFrame:
    """(shard, row, start, end, home): for each shard the runs of windows of its rows that recur, from start to before end, each window once.

    A window is met by its first recurring anchor, which is the same wherever it stands, so neighbouring windows of a row stay together.
    """
    length = _anchor_length(min_words)
    names = ["bucket", "shard", "low", "high", "row", "start", "count", "h"]

    def collect(table: pa.Table, known: pa.Table) -> pa.Table:
        anchor_table = np.sort(cells(known.column("c0"), np.uint64)[0])
        ids, rows = np.asarray(table.column("doc_id")), np.asarray(table.column("_row"))
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for part in read_texts(table) if len(anchor_table) else ():
            at, anchor = part.anchors(length)
            ok = among(anchor_table, anchor)
            at, anchor = at[ok], anchor[ok]
            count = reach(part, at, length, min_words) + 1
            begin = np.repeat(at, count) - (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
            anchor, text = np.repeat(anchor, count), part.text_of(begin)
            ok = begin + min_words <= part.bounds[text + 1]
            begin, text, anchor = begin[ok], text[ok], anchor[ok]
            if len(begin):
                found.append((anchor, gram_hashes(part.tokens, min_words)[begin], ids[part.a + text], rows[part.a + text], (begin - part.bounds[text]).astype(np.int32)))
        anchor, h, doc, row, start = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, row, doc, h))
        anchor, h, doc, row, start = (x[order] for x in (anchor, h, doc, row, start))
        heads = heads_of(h)
        high = doc[np.append(heads[1:], len(h)) - 1] if len(h) else doc
        anchor, h, low, row, start = (x[heads] for x in (anchor, h, doc, row, start))  # the first is of the lowest document
        bucket = ((anchor >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
        order = np.lexsort((start, row, bucket))
        bucket, h, low, high, row, start = (x[order] for x in (bucket, h, low, high, row, start))
        run = heads_of(bucket, low, high, row, start - np.arange(len(start)))
        count = np.diff(np.append(run, len(h))).astype(np.int32)
        of_bucket = heads_of(bucket[run])
        packed = [pack(x, of_bucket) for x in (low[run], high[run], row[run], start[run], count)]
        shard = table.column("_shard")[0].as_py() if table.num_rows else 0
        return pa.table([pa.array(bucket[run][of_bucket], pa.int32()), pa.array(np.full(len(of_bucket), shard), pa.int32()), *packed, pack(h, run[of_bucket])], names=names)

    def meet(table: pa.Table) -> pa.Table:
        low, runs = cells(table.column("low"), np.int64)
        high, row, start, count = (cells(table.column(c), t)[0] for c, t in (("high", np.int64), ("row", np.int64), ("start", np.int32), ("count", np.int32)))
        h = cells(table.column("h"), np.uint64)[0]
        shard = np.repeat(np.asarray(table.column("shard")), runs)
        run = np.repeat(np.arange(len(low)), count)
        place = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
        order = np.argsort(h, kind="stable")
        heads = heads_of(h[order])
        size = np.diff(np.append(heads, len(h)))
        least, most = np.minimum.reduceat(low[run][order], heads), np.maximum.reduceat(high[run][order], heads)
        home = np.empty(len(h), np.int64)
        again = np.empty(len(h), bool)
        home[order], again[order] = np.repeat(least, size), np.repeat(least != most, size)
        run, begin, home = run[again], (start[run] + place)[again], home[again]
        order = np.lexsort((begin, home, row[run], shard[run]))
        run, begin, home = run[order], begin[order], home[order]
        heads = heads_of(shard[run], row[run], home, begin - np.arange(len(begin)))
        tails = np.append(heads[1:], len(begin)) - 1 if len(heads) else heads
        return pa.table([pa.array(shard[run[heads]], pa.int32()), pa.array(row[run[heads]]), pa.array(begin[heads].astype(np.int32)), pa.array(begin[tails].astype(np.int32) + np.int32(1)), pa.array(home[heads])], names=["shard", "row", "start", "end", "home"])

    kinds = "bucket int, shard int, low binary, high binary, row binary, start binary, count binary, h binary"
    return sharded.groupBy("_shard").cogroup(recurring.groupBy("shard")).applyInArrow(collect, kinds).groupBy("bucket").applyInArrow(meet, "shard int, row bigint, start int, end int, home bigint")


def _passages(table: pa.Table, runs: pa.Table, min_words: int) -> tuple[np.ndarray, pa.Array]:
    """Homes and texts of a shard's passages: runs that go on in one another, cut from the rows that have them."""
    row, start, end, home = (np.asarray(runs.column(c)) for c in ("row", "start", "end", "home"))
    order = np.lexsort((start, home, row))
    row, start, end, home = (x[order] for x in (row, start, end, home))
    heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (home[1:] != home[:-1]) | (start[1:] > end[:-1])])) if len(row) else np.zeros(0, np.int64)
    end = end[np.append(heads[1:], len(row)) - 1] if len(heads) else end
    row, start, home = row[heads], start[heads], home[heads]
    names, at = np.unique(np.asarray(table.column("_row")), return_index=True)
    data, offsets = utf8(table.column("text"))
    out: list[str] = []
    for head, tail in zip(heads_of(row), np.append(heads_of(row)[1:], len(row))):
        i = int(at[np.searchsorted(names, row[head])])
        starts, ends, _ = words(data, offsets[i : i + 2])
        out += [data[starts[s] : ends[e - 2 + min_words]].tobytes().decode() for s, e in zip(start[head:tail].tolist(), end[head:tail].tolist())]
    return home, pa.array(out, pa.string())


class Automaton:
    """The anchors of some passages, compiled; finds where a text has min_words words or more of a passage."""

    def __init__(self, homes: np.ndarray, texts: pa.Array, min_words: int):
        import ahocorasick

        self.min_words, self.length, self.homes = min_words, _anchor_length(min_words), homes
        data, offsets = utf8(texts)
        starts, ends, self.bounds = words(data, offsets)
        tokens = word_hashes(data, starts, ends)
        self.vocabulary = np.unique(tokens)
        self.words = self.known(tokens)
        at, _ = anchors(tokens, self.bounds, self.length)
        places: dict[tuple, list[int]] = {}
        for p in at.tolist():
            places.setdefault(tuple(self.words[p : p + self.length].tolist()), []).append(p)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, value in places.items():
            self.machine.add_word(key, value)
        self.empty = not places
        if not self.empty:
            self.machine.make_automaton()
        self.ends = self.bounds[np.searchsorted(self.bounds, np.arange(len(tokens)), "right")] if len(tokens) else self.bounds
        self.passage = np.searchsorted(self.bounds, np.arange(len(tokens)), "right") - 1

    def known(self, tokens: np.ndarray) -> np.ndarray:
        """Word numbers from 1; 0 for words of no passage."""
        place = np.searchsorted(self.vocabulary, tokens)
        ok = place < len(self.vocabulary)
        ok[ok] = self.vocabulary[place[ok]] == tokens[ok]
        return np.where(ok, place + 1, 0).astype(np.uint32)

    def locate(self, text: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, home) of every occurrence, in word numbers of known()."""
        out: list[tuple[int, int, int]] = []
        if self.empty or len(text) < self.min_words:
            return out
        done: dict[int, int] = {}  # (text position - passage position) -> how far it has been compared
        n = len(text)
        # an occurrence has only words of passages: other words cut the text, and what is then too short holds none
        solid = np.flatnonzero(np.diff(np.concatenate([[0], (text > 0).astype(np.int8), [0]])))
        hits = ((a + end, value) for a, b in zip(solid[::2].tolist(), solid[1::2].tolist()) if b - a >= self.min_words for end, value in self.machine.iter(tuple(text[a:b].tolist())))
        for end, value in hits:
            s = end - self.length + 1
            for p in value:
                if done.get(s - p, -1) >= s:
                    continue
                lo, hi = self.bounds[self.passage[p]], self.ends[p]
                right = _equal(text[s + self.length : min(n, s + hi - p)], self.words[p + self.length : hi]) + self.length
                left = _equal(text[max(0, s - (p - lo)) : s][::-1], self.words[lo:p][::-1])
                done[s - p] = s + right
                if left + right >= self.min_words:
                    out.append((s - left, s + right, int(self.homes[self.passage[p]])))
        return out


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many words from the begin on are equal."""
    n = min(len(a), len(b))
    for lo in range(0, n, 256):
        differ = np.flatnonzero(a[lo : min(n, lo + 256)] != b[lo : min(n, lo + 256)])
        if len(differ):
            return lo + int(differ[0])
    return n


def _streamed(rows: DataFrame, min_words: int, handle, schema: T.StructType | str) -> DataFrame:
    """handle(table, automaton) over each shard of rows (doc_id, text, ...)."""
    length, buckets = _anchor_length(min_words), buckets_of(rows)
    sharded = by_shard(rows)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        return handle(docs, Automaton(*_passages(docs, found, min_words), min_words))

    runs = _windows(sharded, recurring_by_shard(sharded, length, buckets), min_words, buckets)
    return sharded.groupBy("_shard").cogroup(runs.groupBy("shard")).applyInArrow(run, schema)


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (start, end, home) of which those of one home that overlap or touch are one."""
    out: list[tuple[int, int, int]] = []
    for s, e, home in sorted(spans, key=lambda x: (x[2], x[0])):
        if out and out[-1][2] == home and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1]), home
        else:
            out.append((s, e, home))
    return out


def _spans(table: pa.Table, machine: Automaton) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """Row, byte starts and ends of its words, and its occurrences."""
    text = table.column("text").combine_chunks()
    data, offsets = utf8(text)
    for a, b in portions(offsets):
        starts, ends, bounds = words(data, offsets[a : b + 1])
        known = machine.known(word_hashes(data, starts, ends))
        for i in range(a, b):
            lo, hi = bounds[i - a], bounds[i - a + 1]
            yield i, starts[lo:hi], ends[lo:hi], merged(machine.locate(known[lo:hi]))


def _usable(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def occurrences(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, start_word, end_word, home): every occurrence of a recurring passage of min_words words or more.

    A passage recurs if two documents at least have it; home is the lowest doc_id that does, whose own occurrence is in the
    result too. Occurrences of one home that overlap or touch are one row. Words are separated by white space. Null and empty
    texts and rows with a null doc_id have no occurrence; rows of one doc_id are one document, so repeated rows are no repeats. An empty
    table gives no row. Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = _usable(pick(docs, "doc_id", "text"))

    def handle(table: pa.Table, machine: Automaton) -> pa.Table:
        ids = np.asarray(table.column("doc_id"))
        found = [(ids[i], s, e, home) for i, _, _, spans in _spans(table, machine) for s, e, home in spans]
        x = np.array(found, np.int64).reshape(-1, 4)
        return pa.table([pa.array(x[:, 0]), pa.array(x[:, 1].astype(np.int32)), pa.array(x[:, 2].astype(np.int32)), pa.array(x[:, 3])], names=["doc_id", "start_word", "end_word", "home"])

    found = _streamed(rows, min_words, handle, "doc_id bigint, start_word int, end_word int, home bigint")
    return islands(found, "doc_id", "home").select("doc_id", "start_word", "end_word", "home")


def without_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs without the words of recurring passages, but in the passages' homes; documents of which no word is left go.

    Columns stay as they are (n_chars, if there is one, follows the text). Rows without a doc_id or text stay as they are, and so do texts without words; rows
    of one doc_id are one document, and repeated rows are treated alike: all keep what the document keeps. Of two documents that tie for nothing but the doc_id's
    order the lower one is the home. An empty table gives no row; other columns, whatever their names, are carried along.
    """
    ship(docs.sparkSession)
    whole = plain(docs, "doc_id", "text", "n_chars")
    names, schema = whole.columns, whole.schema
    rows = _usable(whole)

    def handle(table: pa.Table, machine: Automaton) -> pa.Table:
        ids = np.asarray(table.column("doc_id"))
        texts = table.column("text").to_pylist()
        keep = np.ones(table.num_rows, bool)
        changed = False
        for i, starts, ends, spans in _spans(table, machine):
            gone = np.zeros(len(starts) + 1, bool)
            for s, e, home in spans:
                if home < ids[i]:
                    gone[s:e] = True
            if gone.any():
                changed = True
                texts[i], keep[i] = _remove(texts[i], starts - starts[0], ends - starts[0], gone[:-1])
        if changed:
            table = table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, table.schema.field("text").type))
            if "n_chars" in names:
                kind = table.schema.field("n_chars").type
                table = table.set_column(table.schema.get_field_index("n_chars"), "n_chars", pa.array([None if t is None else len(t) for t in texts], kind))
        return table.filter(pa.array(keep)).select(names).cast(pa.schema([(n, table.schema.field(n).type) for n in names]))

    done = _streamed(rows, min_words, handle, rows.select(*names).schema)
    rest = whole.where("doc_id is null or text is null")
    return done.select(*[F.col(f.name).cast(f.dataType) for f in schema]).unionByName(rest).toDF(*docs.columns)


def _remove(text: str, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple[str, bool]:
    """The text without some of its words and the white space that follows each of these."""
    if gone.all():
        return "", False
    raw = text.encode()
    lead = len(raw) - len(raw.lstrip(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"))
    new = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    out, at = [], 0
    for a, b in zip(new[::2].tolist(), new[1::2].tolist()):
        out.append(raw[at : lead + starts[a]])
        at = lead + starts[b] if b < len(starts) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode().rstrip(), True
