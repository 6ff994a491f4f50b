"""N-gram Jaccard join with signature trees.

A document is the set of its word n-grams. Sets that are equal are one set, so exact copies cost nothing further. A
set's signature is a bitmap of its n-grams. A tree over sets has signatures at its leaves; every inner node holds the OR of
its children's bitmaps, the range of their sizes and their largest number of bit collisions. Two trees (or one, with itself)
are walked together: a pair of nodes is dropped when the sizes are too far apart, or when even the largest possible overlap,
the common bits plus the collisions, is less than the threshold needs. Surviving leaf pairs are verified on the sets.

So that the work is spread and no tree holds the corpus, sets are dealt to trees by min-hashes: `bands` keys of `rows` minima
each. Two sets of Jaccard j meet in a tree with probability 1 - (1 - j**rows)**bands, 0.9999 at j = 0.5 with
the defaults; the walk itself loses nothing. What the walks leave connects sets to clusters. A cluster's sets then stand in one tree
with their n-grams, each pair in one place, and are verified; a tree too large for a task is cut into blocks, and pairs of trees are walked.
No pair is ever sent anywhere: a tree gives stars and numbers of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, pick, ship
from .textops import gram_hashes, inside, mix, plain, portions, utf8, word_hashes, words

U = np.uint64
BITS, FAN, FRONTIER, HOT_BITS = 4, 8, 1 << 20, 2048


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram sets of some texts, one after another and each in order, and where each begins. A text of fewer words is one gram."""
    starts, ends, bounds = words(data, offsets)
    tokens = word_hashes(data, starts, ends)
    ok = np.flatnonzero(inside(bounds, n))
    grams = gram_hashes(tokens, n)[ok]
    text = np.searchsorted(bounds, ok, "right") - 1
    count = np.diff(bounds)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        whole = [mix(np.array([U(int(np.bitwise_xor.reduce(mix(tokens[bounds[i] : bounds[i + 1]] + np.arange(1, count[i] + 1, dtype=np.uint64))))) + U(count[i])]))[0] for i in few]
        grams, text = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([text, few])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    return grams, np.searchsorted(text, np.arange(len(offsets)))


def identity(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set; the sets must not be empty."""
    at = bounds[:-1]
    return np.add.reduceat(mix(grams), at), np.add.reduceat(mix(grams ^ U(0x5851F42D4C957F2D)), at)


def band_keys(grams: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[sets, bands]"""
    rng = np.random.Generator(np.random.PCG64(9001))
    odd = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | U(1)
    out = np.empty((len(bounds) - 1, bands), np.uint64)
    for b in range(bands):
        key = np.full(len(out), U(b))
        for r in range(rows):
            x = grams * odd[b * rows + r]
            key = mix(key * U(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(x ^ (x >> U(29)), bounds[:-1]))
        out[:, b] = key
    return out


def width_of(size: np.ndarray) -> np.ndarray:
    """Bytes of a signature: a power of two, BITS bits an n-gram at least, so collisions stay few whatever the size."""
    return np.maximum(8, 1 << np.ceil(np.log2(np.maximum(size * BITS / 8, 1))).astype(np.int64))


def signature(grams: np.ndarray, width: int) -> bytes:
    out = np.zeros(width * 8, bool)
    out[(mix(grams ^ U(77)) & U(width * 8 - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


class Tree:
    """Levels from the leaves up: OR-combined bitmaps, least and greatest sizes, most collisions."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        lost = sizes - np.bitwise_count(bitmaps).sum(axis=1)
        self.levels = [(bitmaps, sizes, sizes, lost)]
        while len(bitmaps) > 1:
            self.grow()
            bitmaps = self.levels[-1][0]

    def grow(self) -> None:
        bitmaps, lo, hi, lost = self.levels[-1]
        at = np.arange(0, len(bitmaps), FAN)
        self.levels.append((np.bitwise_or.reduceat(bitmaps, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(lost, at)))


def dual_walk(one: Tree, two: Tree, threshold: float, tested: dict[int, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a leaf of one tree and one of the other (i < j, if it is the same tree) that could reach the threshold; what waits is kept in pieces.

    tested: gets the number of node pairs whose bound was computed, by level from the leaves up.
    """
    same = one is two
    for short, long in ((one, two), (two, one)):
        while len(short.levels) < len(long.levels):
            short.grow()  # a root over the root: both are walked level by level
    top = len(one.levels) - 1
    wait = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while wait:
        level, i, j = wait.pop()
        if len(i) > FRONTIER:
            wait += [(level, i[k : k + FRONTIER], j[k : k + FRONTIER]) for k in range(0, len(i), FRONTIER)]
            continue
        (bits1, lo1, hi1, lost1), (bits2, lo2, hi2, lost2) = one.levels[level], two.levels[level]
        ok = (hi1[i] >= threshold * lo2[j] - 1e-9) & (hi2[j] >= threshold * lo1[i] - 1e-9)
        if same and level == 0:
            ok &= i < j
        i, j = i[ok], j[ok]
        if tested is not None:
            tested[level] = tested.get(level, 0) + len(i)
        common = np.empty(len(i), np.int64)
        step = max(1, (1 << 22) // (8 * bits1.shape[1]))
        for k in range(0, len(i), step):
            common[k : k + step] = np.bitwise_count(bits1[i[k : k + step]] & bits2[j[k : k + step]]).sum(axis=1)
        most = np.minimum(common + np.minimum(lost1[i], lost2[j]), np.minimum(hi1[i], hi2[j]))
        ok = most * (1 + threshold) >= threshold * (lo1[i] + lo2[j]) - 1e-9
        i, j = i[ok], j[ok]
        if level == 0:
            yield i, j
            continue
        ci = (i[:, None, None] * FAN + np.arange(FAN)[:, None]).repeat(FAN, 2).ravel()
        cj = (j[:, None, None] * FAN + np.arange(FAN)).repeat(FAN, 1).ravel()
        ok = (ci < len(one.levels[level - 1][1])) & (cj < len(two.levels[level - 1][1]))
        if same:
            ok &= ci <= cj
        wait.append((level - 1, ci[ok], cj[ok]))


def _fold(marks: list[bytes], at: np.ndarray, widths: np.ndarray, width: int) -> np.ndarray:
    """Some signatures, those that are wider made narrower by OR of their parts."""
    rows = np.empty((len(at), width // 8), np.uint64)
    for w in np.unique(widths[at]).tolist():
        mine = np.flatnonzero(widths[at] == w)
        rows[mine] = np.bitwise_or.reduce(np.frombuffer(b"".join(marks[k] for k in at[mine]), np.uint64).reshape(len(mine), -1, width // 8), axis=1)
    return rows


def unit_pairs(sizes: np.ndarray, marks: list[bytes], rank: np.ndarray, side: np.ndarray, threshold: float, tested: dict[int, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that could reach the threshold: of one tree, if all sides are 0, or of two, those of sides 1 and 2. rank: [sets, .], brings similar sets together.

    Signatures of a pair can differ in width by a power of two or a few, as sizes may; each width has its trees, of the sets of this width and those that reach it.
    """
    widths = np.array([len(m) for m in marks])
    most = 2 ** (1 + int(np.ceil(-np.log2(threshold))))
    for width in np.unique(widths).tolist():
        reach = np.flatnonzero((widths >= width) & (widths <= width * most))
        order = reach[np.lexsort([*rank[reach].T[::-1]])]
        parts = [order[side[order] == x] for x in ((1, 2) if side.any() else (0,))]
        if not all(len(x) for x in parts) or len(order) < 2:
            continue
        grown = [Tree(_fold(marks, x, widths, width), sizes[x]) for x in parts]
        for i, j in dual_walk(grown[0], grown[-1], threshold, tested):
            x, y = parts[0][i], parts[-1][j]
            ok = (widths[x] == width) | (widths[y] == width)  # else both are wider: their own turn comes
            yield x[ok], y[ok]


def few_pairs(sizes: np.ndarray, marks: list[bytes], heads: np.ndarray, count: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The surviving pairs of many units of FAN sets at most, whose root has leaves only, together: by the same bound."""
    widths = np.array([len(m) for m in marks])
    for n in range(2, FAN + 1):
        i, j = np.triu_indices(n, 1)
        for lo in range(0, int((count == n).sum()), 1 << 15):
            h = heads[count == n][lo : lo + (1 << 15)]
            a, b = (h[:, None] + i).ravel(), (h[:, None] + j).ravel()
            ok = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
            a, b = a[ok], b[ok]
            narrow = np.minimum(widths[a], widths[b])
            for width in np.unique(narrow).tolist():
                x, y = a[narrow == width], b[narrow == width]
                used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
                rows = _fold(marks, used, widths, width)
                lost = sizes[used] - np.bitwise_count(rows).sum(axis=1)
                p, q = place[: len(x)], place[len(x) :]
                common = np.concatenate([np.zeros(0, np.int64), *[np.bitwise_count(rows[p[k : k + step]] & rows[q[k : k + step]]).sum(axis=1) for step in [max(1, (1 << 22) // width)] for k in range(0, len(p), step)]])
                most = np.minimum(common + np.minimum(lost[p], lost[q]), np.minimum(sizes[x], sizes[y]))
                ok = most * (1 + threshold) >= threshold * (sizes[x] + sizes[y]) - 1e-9
                yield x[ok], y[ok]


def exact(grams: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard of pairs of sets. Where there are many pairs, the n-grams that most sets have get a bit each and are compared as bitmaps without collisions."""
    size = np.diff(bounds)
    common = np.zeros(len(a), np.int64)
    if len(a) > 4 * len(size):
        known, code, df = np.unique(grams, return_inverse=True, return_counts=True)
        hot = np.argsort(-df, kind="stable")[:HOT_BITS]
        bit = np.full(len(known), -1)
        bit[hot] = np.arange(len(hot))
        owner = np.repeat(np.arange(len(size)), size)
        place = bit[code]
        table = np.zeros((len(size), HOT_BITS), bool)
        table[owner[place >= 0], place[place >= 0]] = True
        rows = np.packbits(table, axis=1).view(np.uint64)
        for k in range(0, len(a), 1 << 15):
            common[k : k + (1 << 15)] = np.bitwise_count(rows[a[k : k + (1 << 15)]] & rows[b[k : k + (1 << 15)]]).sum(axis=1)
        rest = (place < 0) & (df[code] > 1)  # an n-gram of one set alone is common to no pair
        grams, owner = grams[rest], owner[rest]
        bounds = np.searchsorted(owner, np.arange(len(size) + 1))
    left = np.diff(bounds)
    todo = np.flatnonzero((left[a] > 0) & (left[b] > 0))
    todo = todo[np.argsort(a[todo], kind="stable")]
    heads = np.flatnonzero(np.concatenate([[True], a[todo][1:] != a[todo][:-1]])) if len(todo) else np.zeros(0, np.int64)
    for h, t in zip(heads, np.append(heads[1:], len(todo))):
        one = grams[bounds[a[todo[h]]] : bounds[a[todo[h]] + 1]]
        for lo in range(h, t, 256):
            p = todo[lo : min(t, lo + 256)]
            n = left[b[p]]
            first = np.cumsum(n) - n
            other = grams[np.repeat(bounds[b[p]] - first, n) + np.arange(int(n.sum()))]
            place = np.searchsorted(one, other)
            common[p] += np.add.reduceat((one[np.minimum(place, len(one) - 1)] == other).astype(np.int64), first)
    return common / (size[a] + size[b] - common)


def roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n things the least of those that the pairs connect it with."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (root[root] != root).any():
                root = root[root]
    return root


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole units, from batches that are sorted by unit: no unit spans two tables, and a table is little more than a batch or a unit."""
    held: list[pa.Table] = []
    open_unit = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table, units = pa.Table.from_batches([batch]), batch.column("unit").to_numpy()
        if held and open_unit != units[0]:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        earlier = np.flatnonzero(units != units[-1])
        if len(earlier):
            yield pa.concat_tables([*held, table.slice(0, earlier[-1] + 1)]).combine_chunks()
            held = []
        held.append(table.slice(earlier[-1] + 1 if len(earlier) else 0))
        open_unit = units[-1]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _members(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, set1, set2, size, signature, keys) of each row with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for a, b in portions(offsets):
                grams, bounds = gram_sets(data, offsets[a : b + 1], n)
                full = np.flatnonzero(np.diff(bounds) > 0)
                if not len(full):
                    continue
                bounds = np.append(bounds[full], bounds[-1])
                one, two = identity(grams, bounds)
                sizes = np.diff(bounds)
                marks = [signature(grams[x:y], w) for x, y, w in zip(bounds[:-1], bounds[1:], width_of(sizes).tolist())]
                keys = band_keys(grams, bounds, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * np.int32(bands)), pa.array(keys.ravel().view(np.int64)))
                yield pa.record_batch([pa.array(ids[a + full]), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sizes), pa.array(marks, pa.binary()), lists], names=["doc_id", "set1", "set2", "size", "signature", "keys"])

    return docs.mapInArrow(run, "doc_id bigint, set1 bigint, set2 bigint, size bigint, signature binary, keys array<bigint>")


def _units(rows: DataFrame, group: str, most: int, threshold: float) -> DataFrame:
    """rows with (unit, side, several): a group whose load is `most` at most is one unit; of a larger one the blocks meet pair by pair, a unit for each pair.

    Blocks are of one size class (powers of two), and only classes whose sizes can reach the threshold meet. So no group is one task, and no pair of sets is lost.
    """
    parts = F.ceil(F.col("load") / most).cast("int")
    reach = 1 + math.ceil(-math.log2(threshold) - 1e-9)
    meets = F.when(parts <= 1, F.array(F.struct(F.lit(0).alias("d"), F.lit(0).alias("p")))).otherwise(
        F.flatten(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(d.alias("d"), p.alias("p")))))
    )
    rows = rows.withColumns({"several": parts > 1, "_own": F.floor(F.log2("size")).cast("int"), "_spot": F.pmod(F.xxhash64("set1", "set2"), parts).cast("int"), "_meet": F.explode(meets)})
    mine, other = F.struct(F.col("_own").alias("c"), F.col("_spot").alias("p")), F.struct((F.col("_own") + F.col("_meet.d")).alias("c"), F.col("_meet.p").alias("p"))
    pair = F.xxhash64(group, F.least(mine, other), F.greatest(mine, other))
    return rows.withColumns({"unit": F.when(F.col("several"), pair).otherwise(F.xxhash64(group)), "side": F.when(~F.col("several") | (mine == other), 0).when(mine < other, 1).otherwise(2)})


def _parts(units: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and number of rows of each unit, and whether it is small: one side, FAN sets at most."""
    heads = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]]))
    count = np.diff(np.append(heads, len(units)))
    return heads, count, (count <= FAN) & (np.maximum.reduceat(side, heads) == 0)


def _walked(units: DataFrame, threshold: float) -> DataFrame:
    """(doc_id_a, doc_id_b): star edges that connect the sets of a unit (unit, side, id, size, signature) which could reach the threshold with each other."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(batches):
            unit, side, ids, sizes, one, two = (np.asarray(t.column(c)) for c in ("unit", "side", "id", "size", "rank1", "rank2"))
            marks, rank = t.column("signature").to_pylist(), np.column_stack([one, two, sizes])
            heads, count, small = _parts(unit, side)

            def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                yield from few_pairs(sizes, marks, heads[small], count[small], threshold)
                for h, n in zip(heads[~small].tolist(), count[~small].tolist()):
                    for i, j in unit_pairs(sizes[h : h + n], marks[h : h + n], rank[h : h + n], side[h : h + n], threshold):
                        yield h + i, h + j

            root = roots(len(ids), found())
            at = np.flatnonzero(ids[root] != ids)
            yield pa.record_batch([pa.array(ids[root[at]]), pa.array(ids[at])], names=["doc_id_a", "doc_id_b"])

    return units.select("unit", "side", "id", "size", "rank1", "rank2", "signature").repartition("unit").sortWithinPartitions("unit").mapInArrow(walk, "doc_id_a bigint, doc_id_b bigint")


def _verified(units: DataFrame, threshold: float) -> DataFrame:
    """(set1, set2, id, root, links, several) of each set of a unit (unit, side, set1, set2, id, grams): how many sets it is linked with there, and the least id that links reach."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(batches):
            unit, side, one, two, ids = (np.asarray(t.column(c)) for c in ("unit", "side", "set1", "set2", "id"))
            order = np.lexsort((two, one, ids, unit))  # by id, so that the least row is the least id; a row that repeats another goes
            order = order[np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in (unit, one, two)], axis=0)])]
            unit, side, one, two, ids = (x[order] for x in (unit, side, one, two, ids))
            cells = t.column("grams").to_pylist()
            sets = [np.frombuffer(cells[k], np.uint64) for k in order.tolist()]
            sizes = np.array([len(x) for x in sets])
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            flat = np.concatenate(sets)
            marks = [signature(x, w) for x, w in zip(sets, width_of(sizes).tolist())]
            heads, count, small = _parts(unit, side)
            links = np.zeros(len(unit), np.int64)

            def linked() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                again = np.flatnonzero((unit[1:] == unit[:-1]) & (ids[1:] == ids[:-1]))
                yield again, again + 1  # sets of one document
                jobs = [(0, len(unit), few_pairs(sizes, marks, heads[small], count[small], threshold))]
                jobs += [(h, h + n, unit_pairs(sizes[h : h + n], marks[h : h + n], band_keys(flat[bounds[h] : bounds[h + n]], bounds[h : h + n + 1] - bounds[h], 3, 1), side[h : h + n], threshold)) for h, n in zip(heads[~small].tolist(), count[~small].tolist())]
                for lo, hi, pairs in jobs:
                    for a, b in pairs:
                        for k in range(0, len(a), FRONTIER):
                            x, y = a[k : k + FRONTIER], b[k : k + FRONTIER]
                            ok = exact(flat[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], x, y) >= threshold
                            x, y = lo + x[ok], lo + y[ok]
                            links[:] += np.bincount(x, minlength=len(links)) + np.bincount(y, minlength=len(links))
                            yield x, y

            root = roots(len(unit), linked())
            several = np.asarray(t.column("several"))[order]
            yield pa.record_batch([pa.array(x) for x in (one, two, ids, ids[root], links, several)], names=["set1", "set2", "id", "root", "links", "several"])

    return units.select("unit", "side", "set1", "set2", "id", "grams", "several").repartition("unit").sortWithinPartitions("unit").mapInArrow(verify, "set1 bigint, set2 bigint, id bigint, root bigint, links bigint, several boolean")


def classes(docs: DataFrame, threshold: float = 0.7, n: int = 3, bands: int = 32, rows: int = 2, group_sets: int = 4096, group_grams: int = 1 << 21) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of each document that has a link or a copy; one that is alone in its class has no row.

    Two documents are linked if the Jaccard coefficient of their word n-gram sets is `threshold` at least. A class is what links and copies connect; class_id is
    its lowest doc_id. n_links is the number of different sets, other than the document's own, that it is linked with; n_copies that of other
    documents with an equal set. So the result grows with the documents, not with their pairs, and yet every link between different texts counts.
    A text of fewer than n words is one gram; a text without words, a null text and a null doc_id have no links. Rows of one doc_id are one
    document: its numbers are the sums over its different sets, its class is one; rows that repeat another add nothing. An empty table gives no row. Other
    columns, whatever their names, are ignored. A coefficient equal to the threshold links. Texts are used whole. group_sets and group_grams say how much a task compares at a time; they
    change no row.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and 1 at most")
    ship(docs.sparkSession)
    texts = pick(docs, "doc_id", "text").where("doc_id is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    members = cut(_members(texts, n, bands, rows))
    light = members.select("doc_id", "set1", "set2").distinct()
    low = light.groupBy("set1", "set2").agg(F.min("doc_id").alias("id"), (F.count("*") - 1).alias("n_copies"))
    sets = cut(members.groupBy("set1", "set2").agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("signature").alias("signature"), F.first("keys").alias("keys")))
    # only keys that two sets have are worth a tree
    each = sets.select("set1", "set2", F.explode("keys").alias("key"))
    met = each.groupBy("key").agg(F.count("*").alias("load")).where("load > 1")
    heavy = sets.select("set1", "set2", "id", "size", "signature", F.get("keys", F.lit(0)).alias("rank1"), F.get("keys", F.lit(1)).alias("rank2"))
    trees = _units(each.join(met, "key").join(heavy, ["set1", "set2"]), "key", group_sets, threshold)
    clusters = components(_walked(trees, threshold).distinct()).withColumnRenamed("group_id", "cluster")
    wanted = cut(sets.select("id", "set1", "size").join(clusters.withColumnRenamed("doc_id", "id"), "id"))
    loads = wanted.groupBy("cluster").agg(F.sum("size").alias("load"))
    wanted = wanted.groupBy("id", "cluster").agg(F.collect_set("set1").alias("names")).join(loads, "cluster")
    # only the texts of sets that could have a link go on
    source = texts.join(cut(wanted.withColumnRenamed("id", "doc_id")), "doc_id")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            names = batch.column("names").to_pylist()
            for a, b in portions(offsets):
                grams, bounds = gram_sets(data, offsets[a : b + 1], n)
                full = np.flatnonzero(np.diff(bounds) > 0)
                if not len(full):
                    continue
                bounds = np.append(bounds[full], bounds[-1])
                one, two = (x.view(np.int64) for x in identity(grams, bounds))
                at = np.flatnonzero([int(x) in names[a + i] for x, i in zip(one, full)])  # else another text of this doc_id
                cells = pa.array([grams[bounds[i] : bounds[i + 1]].tobytes() for i in at], pa.binary())
                rows_ = pa.array(a + full[at])
                yield pa.record_batch([*[batch.column(c).take(rows_) for c in ("cluster", "load", "doc_id")], *[pa.array(x[at]) for x in (one, two, np.diff(bounds))], cells], names=["cluster", "load", "id", "set1", "set2", "size", "grams"])

    full = source.mapInArrow(again, "cluster bigint, load bigint, id bigint, set1 bigint, set2 bigint, size bigint, grams binary")
    done = cut(_verified(_units(full, "cluster", group_grams, threshold), threshold))
    linked = done.groupBy("set1", "set2").agg(F.sum("links").alias("n_links"), F.min("root").alias("root"))
    each_doc = light.join(low, ["set1", "set2"]).join(linked, ["set1", "set2"], "left").withColumn("root", F.coalesce("root", "id"))
    each_doc = cut(each_doc.select("doc_id", "root", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"))
    found = each_doc.groupBy("doc_id").agg(F.min("root").alias("class_id"), F.max("root").alias("_most"), F.sum("n_links").alias("n_links"), F.sum("n_copies").alias("n_copies"))
    # within a unit classes are whole; those that several units share, or a document with several sets, are connected here
    across = done.where("several and id <> root").select(F.col("root").alias("doc_id_a"), F.col("id").alias("doc_id_b"))
    torn = each_doc.join(found.where("class_id <> _most").select("doc_id", "class_id"), "doc_id").where("class_id <> root").select(F.col("class_id").alias("doc_id_a"), F.col("root").alias("doc_id_b"))
    across = cut(across.unionByName(torn).distinct())
    found = found.drop("_most").where("n_links > 0 or n_copies > 0")
    if across.isEmpty():
        return found
    whole = components(across).select(F.col("doc_id").alias("class_id"), "group_id")
    return found.join(whole, "class_id", "left").select("doc_id", F.coalesce("group_id", "class_id").alias("class_id"), "n_links", "n_copies")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(doc_id, group_id) of every document that has an edge (doc_id_a, doc_id_b): group_id is the lowest doc_id that can be reached.

    Alternating large-star and small-star steps; every round is checkpointed, its number grows with the logarithm of a component's size.
    """
    now = cut(edges.select(F.greatest("doc_id_a", "doc_id_b").alias("u"), F.least("doc_id_a", "doc_id_b").alias("v")).where("u <> v").distinct())
    last = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).unionByName(now.select(F.col("v").alias("doc_id"), F.col("v").alias("group_id")).distinct())


def one_of_each(docs: DataFrame, threshold: float = 0.7, n: int = 3, bands: int = 32, rows: int = 2) -> DataFrame:
    """docs without the documents of which a lower doc_id is in their class (see classes()); of a repeated doc_id all its rows stay or go.

    Rows without doc_id, text or words stay. An empty table gives no row. Columns stay as they are, whatever their names.
    """
    gone = classes(docs, threshold, n, bands, rows).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone"))
    whole = plain(docs, "doc_id")
    return whole.join(gone, whole["doc_id"] == gone["_gone"], "left_anti").toDF(*docs.columns)
