"""HTML extraction with a host suffix array.

A page is a stream of words and tag names (scripts, styles, titles and comments are no part of it). The pages are dealt to shards by host,
and the streams of a host stand in one suffix array; substrings of min_tokens tokens that distinct pages of the host share are boilerplate. A host too large
for a shard is split over several, each with a suffix array of its own; these first learn which anchors recur in another one, then compare the
substrings that hold one, each sent once a shard. Words that boilerplate covers go, and runs of the words that are left make a page's text.
All steps read one shuffle of the pages.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import cut, pick, ship
from . import repeats
from .repeats import Part, among, contexts, heads_of, suffix_sort, window_hashes
from .textops import WHITE, mix, portions, word_hashes

U = np.uint64
OPENER = re.compile(rb"(?i)<(?:(script|style|noscript|template|title)\b|!--)")
CLOSER = re.compile(rb"(?i)</(script|style|noscript|template|title)\s*>|-->")
HOST_BYTES = 1 << 24
BLOCKS = [b"p", b"div", b"br", b"h1", b"h2", b"h3", b"h4", b"h5", b"h6", b"li", b"ul", b"ol", b"tr", b"td", b"th", b"table", b"article", b"section", b"header", b"footer", b"nav", b"main", b"aside", b"body", b"blockquote", b"pre", b"hr", b"dl", b"dt", b"dd", b"form"]


def host(url: str | None) -> str:
    """Host name in lower case, without user and port; the empty name where there is none."""
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].partition(":")[0].lower() if m else ""


def visible(page: bytes) -> bytes:
    """The page with a blank for each comment and each element that isn't shown. What is never closed hides nothing. One pass: closers are looked up by bisection."""
    opener = OPENER.search(page)
    if not opener:
        return page
    closers: dict[bytes, tuple[list[int], list[int]]] = {}
    for m in CLOSER.finditer(page, opener.start()):
        starts, ends = closers.setdefault((m[1] or b"").lower(), ([], []))
        starts.append(m.start())
        ends.append(m.end())
    tag_ends = np.flatnonzero(np.frombuffer(page, np.uint8) == ord(">"))
    out, at = [], 0
    for m in OPENER.finditer(page):
        if m.start() < at:
            continue
        name, inner = (m[1] or b"").lower(), m.end()
        if name:
            k = int(np.searchsorted(tag_ends, inner))
            if k == len(tag_ends):
                continue
            inner = int(tag_ends[k]) + 1
        starts, ends = closers.get(name, ([], []))
        k = bisect_left(starts, inner)
        if k < len(starts):
            out.append(page[at : m.start()])
            at = ends[k]
    out.append(page[at:])
    return b" ".join(out)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words and tag names (`<name`, `</name`), which of them are tags, and their number before each page."""
    n = len(data)
    opens = np.flatnonzero(data == ord("<"))
    after = data[np.minimum(opens + 1, n - 1)] if n else opens
    opens = opens[((after | 32) >= ord("a")) & ((after | 32) <= ord("z")) | np.isin(after, [ord("/"), ord("!"), ord("?")])]
    closes = np.flatnonzero(data == ord(">"))
    at = np.searchsorted(closes, opens)
    page = np.searchsorted(offsets, opens, "right")
    ok = at < len(closes)
    opens, at, page = opens[ok], at[ok], page[ok]
    ends = closes[at] if len(at) else at
    ok = ends < offsets[np.minimum(page, len(offsets) - 1)]  # a tag ends in its page
    opens, ends = opens[ok], ends[ok]
    ends, first = np.unique(ends, return_index=True)  # a "<" inside a tag begins nothing
    opens = opens[first]
    step = np.zeros(n + 1, np.int8)
    step[opens] += 1
    step[ends + 1] -= 1
    in_tag = np.cumsum(step[:-1], dtype=np.int8) > 0
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~WHITE[data] & ~in_tag
    border = np.zeros(n + 2, bool)
    border[offsets + 1] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | border[1:-1]))
    stops = np.flatnonzero(solid[1:-1] & (~solid[2:] | border[2:])) + 1
    breaks = np.flatnonzero(WHITE[data] | (data == ord(">")) | (data == ord("/")))
    name_end = breaks[np.searchsorted(breaks, opens + 2)] if len(opens) else opens
    s, e = np.concatenate([starts, opens]), np.concatenate([stops, name_end])
    tag = np.zeros(len(s), bool)
    tag[len(starts) :] = True
    order = np.argsort(s, kind="stable")
    return s[order], e[order], tag[order], np.searchsorted(s[order], offsets)


def read_pages(table: pa.Table) -> Iterator[Part]:
    """Parts whose salt is the host's hash; a part also has the attributes tag and, as stream, a hash of each page's tokens. Pages are those of sharded()."""
    codec = pa.Codec("zstd")
    pages = [codec.decompress(x, n, asbytes=True) for x, n in zip(table.column("page").to_pylist(), table.column("n_bytes").to_pylist())]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
    hosts = [h.encode() for h in table.column("host").to_pylist()]
    sizes = np.array([len(h) for h in hosts], np.int64)
    names = np.frombuffer(b"".join(hosts) + b" ", np.uint8)
    begin = np.cumsum(sizes) - sizes
    salt = np.full(len(hosts), U(12345))
    full = np.flatnonzero(sizes)
    salt[full] = word_hashes(names, begin[full], begin[full] + sizes[full])
    for a, b in portions(offsets):
        data = np.frombuffer(b"".join(pages[a:b]), np.uint8)
        where = offsets[a : b + 1] - offsets[a]
        starts, ends, tag, bounds = tokens_of(data, where)
        tokens = word_hashes(data, starts, ends)
        part = Part(a, b, data, where, starts, ends, bounds, tokens, salt[a:b])
        part.tag = tag
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + np.arange(len(tokens), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)), dtype=np.uint64)])
        part.stream = (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)
        yield part


def _stretches(parts: list[Part], known: np.ndarray, length: int, min_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What stands around the known anchors, each stretch of a host once: its tokens, host, and the least and the greatest of its pages' streams."""
    width = (2 * min_tokens - length) * 4
    held: list[tuple] = [(np.zeros(0, f"S{width + 1}"), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for part in parts:
        at, h = part.anchors(length)
        at = at[among(known, h)]
        if len(at):
            text = part.text_of(at)
            held.append((_cells(contexts(part, at, length, min_tokens)), part.salt[text], part.stream[text]))
    stretch, salt, stream = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((stream, stretch, salt))
    stretch, salt, stream = stretch[order], salt[order], stream[order]
    heads = heads_of(salt, stretch)
    return _open(stretch[heads], width), salt[heads], stream[heads], stream[np.append(heads[1:], len(stream)) - 1] if len(heads) else stream


def suffix_array(parts: list[Part], known: np.ndarray, min_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each different substring of min_tokens tokens that holds a known anchor, in the hosts of some parts, and the least and the greatest stream of the pages that have it."""
    length = _anchor_length(min_tokens)
    context, salt, low, high = _stretches(parts, known, length, min_tokens)
    row, _, group, window = suffix_sort(context, salt, low, length, min_tokens)
    heads = heads_of(group)
    if not len(heads):
        return np.zeros(0, np.uint64), low[:0], low[:0]
    return window[heads], np.minimum.reduceat(low[row], heads), np.maximum.reduceat(high[row], heads)


def boilerplate(parts: list[Part], min_tokens: int) -> np.ndarray:
    """Hashes, in order, of the substrings that two pages of a host have whose streams aren't equal; the parts hold all pages of these hosts."""
    found = [np.zeros(0, np.uint64)]
    for part in parts:
        at, h = part.anchors(_anchor_length(min_tokens))
        order = np.lexsort((h, part.text_of(at)))
        found.append(h[order][heads_of(h[order], part.text_of(at)[order])])
    h, n = np.unique(np.concatenate(found), return_counts=True)
    window, low, high = suffix_array(parts, h[n > 1], min_tokens)
    return np.sort(window[low != high])


def _anchor_length(min_tokens: int) -> int:
    return (min_tokens + 2) // 2


def sharded(pages: DataFrame) -> DataFrame:
    """(page_id, host, page, n_bytes, _shard, _split): what pages (page_id, url, html) show, compressed, since it is shuffled once and read several times.

    A shard has all pages of its hosts; a host of more than HOST_BYTES is split over several shards.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([host(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("n")], names=["host", "n"])

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                hosts, texts = [host(u) for u in part.column("url").to_pylist()], [visible((h or "").encode()) for h in part.column("html").to_pylist()]
                cells = [pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.record_batch([part.column("page_id"), pa.array(hosts, pa.string()), *cells, part.column("_spot")], names=["page_id", "host", "page", "n_bytes", "_spot"])

    loads = pages.select("url", (F.coalesce(F.octet_length("html"), F.lit(0)) + 64).cast("bigint").alias("n")).mapInArrow(sizes, "host string, n bigint").groupBy("host").agg(F.sum("n").alias("n"))
    loads = cut(loads.where(F.col("n") > HOST_BYTES).select("host", F.ceil(F.col("n") / HOST_BYTES).alias("_n")))
    large = F.broadcast(loads) if loads.count() * 128 <= repeats.BROADCAST_BYTES else loads  # a row for each host that is split
    schema = T.StructType([pages.schema["page_id"], *T._parse_datatype_string("host string, page binary, n_bytes bigint, _spot bigint")])
    rows = pages.withColumn("_spot", F.xxhash64("url", "html")).mapInArrow(shown, schema).join(large, "host", "left")
    key = F.xxhash64("host", F.coalesce(F.pmod(F.col("_spot"), F.col("_n")), F.lit(0)))
    return rows.withColumns({"_shard": F.pmod(key, F.lit(repeats.shards_of(pages, "html"))).cast("int"), "_split": F.col("_n").isNotNull()}).drop("_n", "_spot")


def _across(pages: DataFrame, min_tokens: int) -> DataFrame:
    """(shard, h): for each shard the boilerplate of its split hosts. A shard sends each substring once, so that what all pages have meets once a shard."""
    buckets = repeats.buckets_of(pages)
    anchors = repeats.recurring_by_shard(pages, _anchor_length(min_tokens), buckets, _split_pages)

    def collect(table: pa.Table, known: pa.Table) -> pa.Table:
        window, low, high = suffix_array(list(_split_pages(table)), np.sort(repeats.cells(known.column("c0"), np.uint64)[0]), min_tokens)
        order = np.argsort(window)
        out = pa.Table.from_batches([repeats.by_bucket(window[order], buckets, low[order], high[order])])
        return out.append_column("shard", pa.array(np.full(out.num_rows, table.column("_shard")[0].as_py() if table.num_rows else 0), pa.int32()))

    def meet(table: pa.Table) -> pa.Table:
        h, size = repeats.cells(table.column("c0"), np.uint64)
        low, high = (repeats.cells(table.column(c), np.int64)[0] for c in ("c1", "c2"))
        shard = np.repeat(np.asarray(table.column("shard")), size)
        order = np.argsort(h, kind="stable")
        heads = heads_of(h[order])
        apart = np.minimum.reduceat(low[order], heads) != np.maximum.reduceat(high[order], heads)
        again = np.empty(len(h), bool)
        again[order] = np.repeat(apart, np.diff(np.append(heads, len(h))))
        h, shard = h[again], shard[again]
        order = np.lexsort((h, shard))
        heads = heads_of(shard[order])
        return pa.table([pa.array(shard[order][heads], pa.int32()), repeats.pack(h[order], heads)], names=["shard", "h"])

    found = pages.groupBy("_shard").cogroup(anchors.groupBy("shard")).applyInArrow(collect, "bucket int, c0 binary, c1 binary, c2 binary, shard int")
    return found.groupBy("bucket").applyInArrow(meet, "shard int, h binary")


def _split_pages(table: pa.Table) -> Iterator[Part]:
    table = table.filter(table.column("_split"))
    return read_pages(table) if table.num_rows else iter(())


def _cells(c: np.ndarray) -> np.ndarray:
    """Rows as byte strings; a last byte that isn't 0 keeps the zeros before it."""
    raw = np.ascontiguousarray(c.astype(">u4")).view(np.uint8)
    return np.ascontiguousarray(np.concatenate([raw, np.ones((len(raw), 1), np.uint8)], axis=1)).view(f"S{raw.shape[1] + 1}").ravel()


def _open(cells: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(cells).view(np.uint8).reshape(-1, width + 1)[:, :width]).view(">u4").astype(np.uint32)


_block: list[np.ndarray] = []


def _blocks() -> np.ndarray:
    if not _block:
        names = [x + b for b in BLOCKS for x in (b"<", b"</")]
        size = np.array([len(x) for x in names])
        begin = np.cumsum(size) - size
        _block.append(np.sort(word_hashes(np.frombuffer(b"".join(names), np.uint8), begin, begin + size)))
    return _block[0]


def texts_of(table: pa.Table, parts: list[Part], known: np.ndarray, min_tokens: int, min_run: int) -> pa.Table:
    """The pages of some parts, read from table, without what the known hashes cover."""
    out: list[pa.RecordBatch] = []
    for part in parts:
        at, h = window_hashes(part, min_tokens)
        at = at[among(known, h)]
        covered = np.zeros(len(part.tokens) + 1, np.int32)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + min_tokens, -1)
        free = (np.cumsum(covered[:-1]) == 0) & ~part.tag
        page = np.repeat(np.arange(part.b - part.a), np.diff(part.bounds))
        word = np.flatnonzero(~part.tag)  # runs are counted in words: tags don't end them, boilerplate does
        open_ = free[word]
        new = np.ones(len(word), bool)
        new[1:] = (open_[1:] != open_[:-1]) | (page[word][1:] != page[word][:-1])
        run = np.cumsum(new) - 1
        long = np.bincount(run) >= min_run if len(run) else np.zeros(0, bool)
        keep = word[open_ & long[run]] if len(word) else word
        lines = np.cumsum(part.tag & np.isin(part.tokens, _blocks()))
        size = part.ends[keep] - part.starts[keep]
        first = np.cumsum(size + 1) - size - 1
        text = np.full(int((size + 1).sum()), ord(" "), np.uint8)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(first, size) + place] = part.data[np.repeat(part.starts[keep], size) + place]
        breaks = np.flatnonzero(lines[keep][1:] != lines[keep][:-1])
        text[(first + size)[breaks]] = 10
        at_page = np.searchsorted(page[keep], np.arange(part.b - part.a + 1))
        edge = np.append(first, len(text))[at_page]
        raw = text.tobytes()
        texts = [html.unescape(raw[x : max(x, y - 1)].decode("utf-8", "replace")) for x, y in zip(edge[:-1], edge[1:])]
        rows = table.slice(part.a, part.b - part.a)
        words = np.bincount(page[word], minlength=part.b - part.a)
        cells = [rows.column("page_id").combine_chunks(), rows.column("host").combine_chunks(), pa.array(texts, pa.string()), pa.array(words.astype(np.int64)), pa.array(np.diff(at_page).astype(np.int64))]
        out.append(pa.record_batch(cells, names=["page_id", "host", "text", "n_words", "n_kept"]))
    return pa.Table.from_batches(out) if out else None


def extract(pages: DataFrame, min_tokens: int = 16, min_run: int = 5) -> DataFrame:
    """(page_id, host, text, n_words, n_kept) for every row of pages (page_id, url, html).

    text: runs of min_run words at least that no boilerplate of the page's host covers, with line breaks where block tags stand. Pages with
    equal streams count as one, so copies of a page don't erase each other. A null or empty html gives an empty text, a null url the empty host,
    whose pages are compared like any host's; a null page_id is carried along; repeated rows are extracted each. A page shorter than
    min_tokens has no boilerplate. What is never closed (a tag, a comment) hides nothing and takes no longer. An empty table gives no row. Pages are used whole, however
    long; other columns, whatever their names, are ignored.
    """
    if min_tokens < 8:
        raise ValueError("min_tokens must be 8 at least")
    ship(pages.sparkSession)
    rows = sharded(pick(pages, "page_id", "url", "html"))

    def write(table: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        for split in (False, True):
            some = table.filter(pc.equal(table.column("_split"), split))
            if some.num_rows:
                parts = list(read_pages(some))
                hashes = np.sort(repeats.cells(known.column("h"), np.uint64)[0]) if split else boilerplate(parts, min_tokens)
                out.append(texts_of(some, parts, hashes, min_tokens, min_run))
        return pa.concat_tables(out) if out else pa.table([pa.array([], f.type) for f in kind], kind)

    schema = T.StructType([rows.schema["page_id"], *T._parse_datatype_string("host string, text string, n_words bigint, n_kept bigint")])
    kind = to_arrow_schema(schema)
    return rows.groupBy("_shard").cogroup(_across(rows, min_tokens).groupBy("shard")).applyInArrow(write, schema)
