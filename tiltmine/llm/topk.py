"""Exact top-k by inner product, pruned with segment means and deviations.

A vector is cut into segments.  With mean m and deviation s of a segment of length
L, the squared distance of two segments is at least L * ((m1 - m2)^2 + (s1 - s2)^2),
so the inner product of two vectors is at most half of what their squared lengths
exceed the sum of these by.  Bounds are taken coarse to fine; a candidate is dropped
when its bound falls below the k-th best product known for the query, and products
of the survivors are exact integers.

Candidates stay where they are read.  Queries are passed to them in rounds: blocks
of queries of at most ROUND_BYTES are broadcast, each task compares all of its
candidates with them, block by block, and carries the k-th best product of each
query from block to block, so that bounds prune across blocks.  A task gives k rows a query.

Defined results: vectors that are null, empty, or hold null or non-finite components
(also after scaling) take no part; vectors of different length do not meet.  A query never finds its own
row; other rows of the same id count as others.  Equal products rank by the smaller
id.  Components of any size take part: where doubles would not be exact, products are
made of whole numbers of any length.  Ranks follow the exact products; a product
beyond the range of a long is shown as the nearest long.  Fewer than k candidates give
fewer rows.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmine.llm.shared import materialize, only

K = 5
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 8192
QUERIES_AT_ONCE = 64
#: Bytes of query blocks that are broadcast at a time.
ROUND_BYTES = 32 << 20
#: Vectors with a component of this size or more are kept in blocks of their own.
LARGE = 1 << 20
BLOCK = "dim int, n int, ids binary, rows binary, vectors binary"
FOUND = "query_id long, query_row long, vec_id long, score long, beyond binary"
_LONG = (-(1 << 63), (1 << 63) - 1)
#: Bytes of a product's order beyond a long: doubles squared, summed over any dimension.
_WIDE = 300


def usable(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = only(vectors, id_column, vector_column).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    if dict(v.dtypes)["v"] != "array<float>":
        v = v.withColumn("v", F.col("v").cast("array<double>"))
    fits = F.expr(f"forall(v, x -> x is not null and not isnan(x) and abs(cast(x as double) * {scale}D) < double('infinity'))")
    return v.where("id is not null and v is not null and size(v) > 0").where(fits)


def _gathered(batches: Iterator[pa.RecordBatch], size: int, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dim, ids, rows, whole-number vectors as doubles) of rows of one length, small and large ones apart."""
    held: dict[tuple[int, bool], list] = {}

    def out(key) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        return (key[0], *(np.concatenate(x) for x in zip(*held.pop(key))))

    for batch in batches:
        lists = batch.column("v")
        ids, rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
        dims = np.asarray(lists.value_lengths())
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            q = np.floor(scale * lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
            large = np.abs(q).max(axis=1) >= LARGE
            for kind in (False, True):
                own = np.flatnonzero(large == kind)
                for part in range(0, len(own), size):
                    some, key = own[part : part + size], (int(dim), kind)
                    held.setdefault(key, []).append((ids[at[some]], rows[at[some]], q[some]))
                    if sum(len(x[0]) for x in held[key]) >= size:
                        yield out(key)
    for key in list(held):
        yield out(key)


def _blocks(size: int, scale: float):
    """Packs the queries of a partition into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, rows, q in _gathered(batches, size, scale):
            kind = "<f8" if np.abs(q).max() >= LARGE else "<i4"
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (ids, rows, q.astype(kind))], names=["dim", "n", "ids", "rows", "vectors"])

    return run


def _levels(dim: int) -> list[np.ndarray]:
    """Bounds of 1, 4 and 16 segments."""
    return [np.unique(np.linspace(0, dim, k + 1).astype(int)) for k in (1, 4, 16) if k <= dim]


def _statistics(q: np.ndarray) -> list[np.ndarray]:
    """sqrt(L) * mean and sqrt(L) * deviation of every segment, level by level."""
    out = []
    for cuts in _levels(q.shape[1]):
        length = np.diff(cuts)
        mean = np.add.reduceat(q, cuts[:-1], axis=1) / length
        left = q - np.repeat(mean, length, axis=1)
        out.append(np.hstack([mean * np.sqrt(length), np.sqrt(np.add.reduceat(left * left, cuts[:-1], axis=1))]))
    return out


class Queries:
    """A block of queries with the best products found so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.rows, self.q, self.k = ids, rows, q, k
        self.top = float(np.abs(q).max(initial=0))
        self.length = np.sqrt((q * q).sum(axis=1)) if self.top < LARGE else None
        self.statistics = _statistics(q) if self.top < LARGE else None
        self.score = np.full((len(q), k), -np.inf)
        self.found = np.full((len(q), k), _LONG[1], np.int64)
        self.large: list[list[tuple[int, int]]] = [[] for _ in range(len(q))]  # heaps of (product, -id)

    def meet(self, ids: np.ndarray, rows: np.ndarray, c: np.ndarray, statistics: list[np.ndarray] | None, length: np.ndarray | None) -> None:
        """Compares the queries with a block of candidates."""
        if self.statistics is None or statistics is None or self.top * float(np.abs(c).max(initial=0)) * c.shape[1] >= 2**53:
            self._meet_large(ids, rows, c)
            return
        k = self.k
        for at in range(0, len(self.q), QUERIES_AT_ONCE):
            some = slice(at, at + QUERIES_AT_ONCE)
            alive = rows[None, :] != self.rows[some, None]
            # half of |q|^2 + |c|^2 less the bound of the distance: sums of products of means and of deviations
            bound = self.statistics[0][some] @ statistics[0].T
            slack = 1e-9 * self.length[some, None] * length[None, :] + 1e-6
            floor = self.score[some, -1:]
            if not np.isfinite(floor).all():  # nothing to prune by yet: the likeliest give a first floor
                seed = min(4 * k, len(ids))
                first = np.unique(np.argpartition(bound, len(ids) - seed, axis=1)[:, len(ids) - seed :])
                scores = np.where(alive[:, first], self.q[some] @ c[first].T, -np.inf)
                if len(first) >= k:
                    floor = np.maximum(floor, np.partition(scores, len(first) - k, axis=1)[:, len(first) - k, None])
            for n, (of_q, of_c) in enumerate(zip(self.statistics, statistics)):  # coarse to fine, for what is left
                left = np.flatnonzero(alive.any(axis=0))
                bound = bound[:, left] if n == 0 else of_q[some] @ of_c[left].T
                alive[:, left] &= bound + slack[:, left] >= floor
            left = np.flatnonzero(alive.any(axis=0))
            if len(left):
                exact = np.where(alive[:, left], self.q[some] @ c[left].T, -np.inf)
                score = np.hstack([self.score[some], exact])
                found = np.hstack([self.found[some], np.broadcast_to(ids[left], exact.shape)])
                order = np.lexsort((found, -score), axis=1)[:, :k]
                self.score[some], self.found[some] = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)

    def _meet_large(self, ids: np.ndarray, rows: np.ndarray, c: np.ndarray) -> None:
        """The same in whole numbers of any length."""
        whole = [[int(x) for x in v] for v in c]
        for i, q in enumerate(self.q):
            own, heap = [int(x) for x in q], self.large[i]
            for j, v in enumerate(whole):
                if rows[j] != self.rows[i]:
                    item = (sum(a * b for a, b in zip(own, v)), -int(ids[j]))
                    if len(heap) < self.k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)

    def result(self) -> pa.RecordBatch:
        i, j = np.nonzero(np.isfinite(self.score))
        found = [(int(self.ids[a]), int(self.rows[a]), int(self.found[a, b]), int(self.score[a, b])) for a, b in zip(i, j)]
        found += [(int(self.ids[a]), int(self.rows[a]), -n, s) for a, heap in enumerate(self.large) for s, n in heap]
        shown = [min(max(s, _LONG[0]), _LONG[1]) for *_, s in found]
        # what a long cannot tell apart is ordered by more bytes; those of a long come last of the largest and first of the smallest
        beyond = [(s + (1 << (8 * _WIDE - 1))).to_bytes(_WIDE, "big") if s > _LONG[1] or s <= _LONG[0] else None for *_, s in found]
        columns = [pa.array([r[n] for r in found], pa.int64()) for n in range(3)] + [pa.array(shown, pa.int64()), pa.array(beyond, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])


def _search(k: int, scale: float, passed):
    """Compares the candidates of a task with all query blocks of a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[Queries]] = {}
        for dim, n, ids, rows, vectors in passed.value:
            q = np.frombuffer(vectors, "<f8" if len(vectors) == 8 * dim * n else "<i4").astype(np.float64).reshape(n, dim)
            blocks.setdefault(dim, []).append(Queries(np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8"), q, k))
        for dim, ids, rows, c in _gathered(batches, CANDIDATE_BLOCK, scale):
            if dim in blocks:
                small = float(np.abs(c).max()) < LARGE
                statistics, length = (_statistics(c), np.sqrt((c * c).sum(axis=1))) if small else (None, None)
                for block in blocks[dim]:
                    block.meet(ids, rows, c, statistics, length)
        for own in blocks.values():
            yield from (b.result() for b in own)

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = K, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    stored = materialize(usable(vectors, id_column, vector_column, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")  # stored: a row keeps its number
    queries = stored.where(F.col("id") % every == 0)
    queries = queries.repartition(1 + queries.count() // (4 * QUERY_BLOCK), F.xxhash64("row"))
    queries = materialize(queries.mapInArrow(_blocks(QUERY_BLOCK, scale), BLOCK).withColumn("block", F.monotonically_increasing_id()), "queries")
    size = F.octet_length("vectors") + F.octet_length("ids") + F.octet_length("rows")
    rounds: list[list[int]] = []
    room = 0
    for r in queries.select("block", size.alias("bytes")).orderBy("block").collect():  # two numbers for hundreds of queries
        if not rounds or r.bytes > room:
            rounds.append([])
            room = ROUND_BYTES
        rounds[-1].append(r.block)
        room -= r.bytes
    found = spark.createDataFrame([], FOUND)
    for own in rounds:
        rows = queries.where(F.col("block").between(own[0], own[-1])).collect()
        passed = spark.sparkContext.broadcast([(r.dim, r.n, bytes(r.ids), bytes(r.rows), bytes(r.vectors)) for r in rows])
        found = found.unionByName(materialize(stored.mapInArrow(_search(k, scale, passed), FOUND), "found"))
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id, query_row order by score desc, beyond desc nulls last, vec_id)")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
