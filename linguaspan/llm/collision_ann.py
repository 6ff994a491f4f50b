"""Approximate nearest neighbours by collision-counting hashing.

A hash function is a single projection onto a random direction (the directions are orthonormal); a block of vectors keeps
a sorted array for each. A query's window in an array is centred at the query's own projection, and grows with the search radius
(virtual rehashing: the same arrays serve every radius). A vector that stands in the windows of `needed` arrays at least is
verified by its true distance. A query is done when its k-th verified distance is within the radius.

Every vector is indexed, in blocks by ranges of the first projection. A query first searches its own block, which gives it a radius;
then it goes to the blocks whose box of projections its radius reaches, with windows of that radius. Projections don't lengthen
distances, so the blocks left out hold nothing nearer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut, pick, ship

HALF_WINDOW = 1.2  # in standard deviations of the projected difference of two vectors at the radius's distance
INSIDE = math.erf(HALF_WINDOW / math.sqrt(2))
LEVELS = tuple(0.25 * 1.1**i for i in range(23))  # radii; the last one holds the sphere
MOST_BLOCKS = 1 << 16  # blocks grow beyond that, so that the boxes that are broadcast stay under 40 MB for 64 directions


def directions(dim: int, most: int = 64) -> np.ndarray:
    """[number, dim]: at most `most` orthonormal directions, the same for every block."""
    q, _ = np.linalg.qr(np.random.Generator(np.random.PCG64(31337)).normal(size=(dim, dim)))
    return q.T[:most].astype(np.float32)


def needed(m: int, slack: float = 1.0) -> int:
    """The collision threshold: as many as a vector at the radius's distance has, less `slack` standard deviations."""
    return max(0, math.floor(m * INSIDE - slack * math.sqrt(m * INSIDE * (1 - INSIDE))))


class Block:
    """The sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.a = ids, x, directions(x.shape[1])
        p = x @ self.a.T
        order = np.argsort(p, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(p, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T)
        self.verified = 0  # distances computed so far

    def windows(self, p: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[queries, arrays]: where each query's window begins and ends in each array."""
        lo, hi = np.empty(p.shape, np.int32), np.empty(p.shape, np.int32)
        for j, line in enumerate(self.sorted):
            lo[:, j] = np.searchsorted(line, p[:, j] - half, "left")
            hi[:, j] = np.searchsorted(line, p[:, j] + half, "right")
        return lo, hi

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, radius: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, position and squared distance of the k nearest verified vectors, by (distance, id).

        With a radius for each query one level is searched; without, the windows grow until k vectors are verified within the level's radius or it holds the
        sphere. Only what enters a window is counted, and only vectors that come to the collision threshold are measured.
        """
        m, n = len(self.a), len(self.x)
        need, levels, out = needed(m), LEVELS if radius is None else (1.0,), []
        scale = HALF_WINDOW / math.sqrt(q.shape[1])
        for first in range(0, len(q), 256):
            part, ids = q[first : first + 256], q_ids[first : first + 256]
            p = part @ self.a.T
            reach = np.ones(len(part), np.float32) if radius is None else radius[first : first + 256].astype(np.float32)
            spans = [self.windows(p, (scale * level * reach).astype(np.float32)) for level in levels]
            for i in range(len(part)):
                counts, done = np.zeros(n, np.int64), np.zeros(n, bool)
                done[self.ids == ids[i]] = True
                js, ds = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
                before = None
                for level, (lo, hi) in zip(levels, spans):
                    a, b = lo[i].tolist(), hi[i].tolist()
                    if before is None:
                        new = [line[x:y] for line, x, y in zip(self.order, a, b)]
                    else:
                        new = [line[x:y] for line, x, y in zip(self.order, a, before[0])] + [line[x:y] for line, x, y in zip(self.order, before[1], b)]
                    before = a, b
                    counts += np.bincount(np.concatenate(new), minlength=n)
                    at = np.flatnonzero((counts >= need) & ~done)
                    done[at] = True
                    js.append(at)
                    ds.append(np.maximum(2 - 2 * (self.x[at] @ part[i]), 0))
                    self.verified += len(at)
                    if radius is None and sum(np.count_nonzero(d <= level * level) for d in ds) >= k:
                        break
                j, d = np.concatenate(js), np.concatenate(ds)
                best = np.lexsort((self.ids[j], d))[:k]
                out.append((np.full(len(best), first + i), j[best], d[best]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        i, j, d = (np.concatenate(x) for x in zip(*out))
        return i, j, d


def box(x: np.ndarray) -> np.ndarray:
    """[2, arrays]: the least and the greatest projection of some vectors in each direction."""
    p = x @ directions(x.shape[1]).T
    return np.stack([p.min(axis=0), p.max(axis=0)]).astype(np.float32)


def reached(q: np.ndarray, radius: np.ndarray, boxes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Number of each box that lies within the radius of some query, and these queries: projections onto orthonormal directions don't lengthen distances."""
    p = q @ directions(q.shape[1]).T
    for b, (low, high) in enumerate(boxes):
        away = np.maximum(np.maximum(low - p, p - high), 0)
        own = np.flatnonzero(np.einsum("ij,ij->i", away, away) <= np.square(radius))
        if len(own):
            yield b, own


def _unit(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, at, vector): unit vectors as bytes, with their first projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("embedding")
            sizes = np.asarray(pa.compute.list_value_length(lists))
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                x = values[begin[own][:, None] + np.arange(dim)]
                most = np.abs(x).max(axis=1)
                ok = np.isfinite(most) & (most > 0)
                x = np.divide(x, most[:, None], out=np.zeros_like(x), where=ok[:, None])  # squares of very large or small entries would be lost
                norm = np.linalg.norm(x, axis=1)
                x = (x[ok] / norm[ok][:, None]).astype(np.float32)
                if len(x):
                    yield pa.record_batch([pa.array(ids[own][ok]), pa.array(np.full(len(x), dim, np.int32)), pa.array((x @ directions(dim, 1)[0]).astype(np.float64)), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "dim", "at", "vector"])

    return rows.mapInArrow(run, "vec_id bigint, dim int, at double, vector binary")


def neighbours(vectors: DataFrame, k: int = 10, block: int = 8192, every: int = 50) -> DataFrame:
    """(vec_id, neighbour_id, rank, cosine): for each vector whose id is divisible by `every`, its k nearest others among all vectors by cosine; equal ones in order of id.

    Approximate: a true neighbour is missed if too few windows hold it. Null ids, null, empty or zero vectors, and vectors with a null or an entry that
    isn't finite take no part; entries may be of any size that a double holds. Only vectors of equal length are compared. Rows that repeat an id with the same vector are one; rows of
    one id with different vectors are each searched and found, and a pair of ids has its best cosine; a vector is no neighbour of its own id. With
    fewer than k others all are given. An empty table, or one without a query, gives no row. Other columns are ignored. cosine is rounded to 6 decimals.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = pick(vectors, "vec_id", "embedding").where("vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null)").withColumn("vec_id", F.col("vec_id").cast("bigint"))
    count = rows.count()
    n_blocks = max(1, min(MOST_BLOCKS, math.ceil(count / block)))
    points = _unit(rows)
    ranged = points.repartitionByRange(n_blocks, "dim", "at", "vec_id") if count else points

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block of each length in the partition; equal rows stand in one partition, and one of them is kept."""
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        t = pa.Table.from_batches(batches)
        dims, ids = (np.asarray(t.column(c)) for c in ("dim", "vec_id"))
        cells = t.column("vector").to_pylist()
        for dim in np.unique(dims).tolist():
            own = sorted({(int(ids[i]), cells[i]) for i in np.flatnonzero(dims == dim)})
            x = np.frombuffer(b"".join(c for _, c in own), np.float32).reshape(-1, dim)
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([np.array([i for i, _ in own], np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([box(x).tobytes()], pa.binary())], names=["dim", "ids", "x", "box"])

    blocks = cut(ranged.mapInArrow(pack, "dim int, ids binary, x binary, box binary").withColumn("block", F.monotonically_increasing_id()))
    found_boxes = blocks.select("block", "dim", "box").collect()  # MOST_BLOCKS at most for a length
    boxes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in found_boxes}:
        own = [r for r in found_boxes if r["dim"] == dim]
        boxes[dim] = np.array([r["block"] for r in own], np.int64), np.stack([np.frombuffer(r["box"], np.float32).reshape(2, -1) for r in own])
    known = spark.sparkContext.broadcast(boxes)
    kind = "block bigint, dim int, ids binary, x binary, radius binary, q binary, n binary, d binary"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Search the queries of a block in it; then name the other blocks that each query's radius reaches."""
        for batch in batches:
            for r in batch.to_pylist():
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"], np.float32).reshape(-1, r["dim"])
                at = np.flatnonzero(ids % every == 0)
                if not len(at):
                    continue
                q_ids, q = ids[at], x[at]
                i, j, d = Block(ids, x).search(q_ids, q, k, None)
                radius = np.full(len(at), 2.0)  # too few in its own block: all may be nearer
                held = np.bincount(i, minlength=len(at)) >= k
                last = np.searchsorted(i, np.arange(len(at)), "right") - 1
                radius[held] = np.sqrt(d[last[held]]) + 1e-6
                yield _row(r["block"], r["dim"], q=q_ids[i], n=ids[j], d=d.astype(np.float32))
                names, all_boxes = known.value[r["dim"]]
                for b, some in reached(q, radius, all_boxes):
                    if names[b] != r["block"]:
                        yield _row(int(names[b]), r["dim"], ids=q_ids[some], x=q[some], radius=radius[some])

    first = cut(blocks.select("block", "dim", "ids", "x").mapInArrow(own, kind))
    data = blocks.select("block", "dim", "ids", "x", F.lit(None).cast("binary").alias("radius"))
    asked = first.where("q is null").select("block", "dim", "ids", "x", "radius")
    # a block comes before the queries that go to it, and these stream past
    stream = data.unionByName(asked).repartition(n_blocks, "block").sortWithinPartitions("block", F.col("radius").isNotNull())

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for batch in batches:
            for r in batch.to_pylist():
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"], np.float32).reshape(-1, r["dim"])
                if r["radius"] is None:
                    here, index = (r["block"], ids, x), None
                    continue
                index = index or Block(*here[1:])  # the row before it is its block's, or of its block's queries
                radius = np.frombuffer(r["radius"], np.float64)
                i, j, d = index.search(ids, x, k, radius)
                ok = d <= np.square(radius)[i]
                yield _row(r["block"], r["dim"], q=ids[i[ok]], n=index.ids[j[ok]], d=d[ok].astype(np.float32))

    found = first.where("q is not null").unionByName(stream.mapInArrow(across, kind)).select("q", "n", "d")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, n, d in zip(*[batch.column(c).to_pylist() for c in ("q", "n", "d")]):
                yield pa.record_batch([pa.array(np.frombuffer(q, np.int64)), pa.array(np.frombuffer(n, np.int64)), pa.array(np.round(1 - np.frombuffer(d, np.float32).astype(np.float64) / 2, 6))], names=["vec_id", "neighbour_id", "cosine"])

    long = found.mapInArrow(unpack, "vec_id bigint, neighbour_id bigint, cosine double").groupBy("vec_id", "neighbour_id").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.col("cosine").desc(), "neighbour_id"))
    return long.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "neighbour_id", "rank", "cosine")


def _row(block: int, dim: int, **cells: np.ndarray) -> pa.RecordBatch:
    names = ("ids", "x", "radius", "q", "n", "d")
    return pa.record_batch([pa.array([block], pa.int64()), pa.array([dim], pa.int32()), *[pa.array([np.ascontiguousarray(cells[c]).tobytes() if c in cells else None], pa.binary()) for c in names]], names=["block", "dim", *names])
