"""Exact nearest neighbours of many queries at once: cells around pivots, pruned by the triangle inequality.

A few vectors, the pivots, cut the space into cells; each vector belongs to its nearest pivot. Of a cell it
is enough to know the distances of its members to the pivot: the least ``k`` of them, the largest, the
smallest, and the number. With d(q, p) they bound the distance of any member from both sides, so a query
knows, before any vector is compared, a radius that holds ``k`` neighbours, and needs only cells that reach
into it. Cells are stored as blocks of bounded size, and blocks are dealt, cell by cell, to a fixed number of
parts; queries travel in blocks to the parts that hold a cell they need. Parts are copied to a fixed number
of shares, and a block of queries meets one share, so what is shuffled grows with the rows of both sides and
not with their product. Within a part each cell is compared with the queries that need it, by one matrix
product, and the best found so far narrow what the next cells are asked. A hot cell is many blocks in several
parts, so no task ever holds a whole cell. The best ``k`` of each query and part are merged at the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intelweave.functions.flow import with_computed
from intelweave.functions.vectors import similarity

MEMBERS = 64  # of a cell at least on average: smaller ones cost more queries than they spare members
BLOCK = 4096  # members of a block at most on average, and queries of a query block
PARTS = SHARES = 8  # a query is sent to each part at most, a vector to each share
_SLACK = 1e-9  # of the squared lengths: what a matrix product may err


@dataclass
class Cells:
    """Pivots and what is known of their cells: sizes, blocks, radii (least, largest) and the least ``k`` radii."""

    pivots: np.ndarray
    size: np.ndarray
    blocks: np.ndarray
    low: np.ndarray
    high: np.ndarray
    nearest: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of vectors to all pivots."""
        d = np.square(x).sum(1)[:, None] - 2 * x @ self.pivots.T + np.square(self.pivots).sum(1)
        return np.sqrt(np.maximum(d, 0))

    def radius(self, d: np.ndarray, k: int) -> np.ndarray:
        """For each query a distance within which ``k`` vectors lie (infinite if there are fewer in all)."""
        bound = np.full(len(d), np.inf)
        for a in range(0, len(d), 256):
            reach = (d[a:a + 256, :, None] + self.nearest).reshape(min(256, len(d) - a), -1)
            bound[a:a + 256] = np.partition(reach, k - 1, 1)[:, k - 1] if reach.shape[1] >= k else np.inf
        return bound

    def needed(self, d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Queries x cells: whether a member may lie within the bound."""
        slack = 1e-6 * (1 + bound[:, None])
        return (self.size > 0) & (d - self.high <= bound[:, None] + slack) & (self.low - d <= bound[:, None] + slack)

    def part(self, cell: Column, block: Column) -> Column:
        """Number of the part of a block: equal shares of the members, cells in the order of their numbers."""
        before, size, blocks = (F.get(F.array(*[F.lit(int(n)) for n in v]).cast("array<bigint>"), cell) for v in (np.cumsum(self.size) - self.size, self.size, self.blocks))
        return F.call_function("div", (before * blocks + block * size) * PARTS, blocks * int(self.size.sum())).cast("int")

    def parts(self) -> np.ndarray:
        """Cells x parts: whether a part holds a block of the cell, by the same division."""
        before, total = np.cumsum(self.size) - self.size, self.blocks * max(int(self.size.sum()), 1)
        first, last = (((before * self.blocks + n * self.size) * PARTS // total)[:, None] for n in (0, self.blocks - 1))
        at = np.arange(PARTS)
        return (self.size > 0)[:, None] & (first <= at) & (at <= last)


def _stored(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    """Entries in the type they are stored in, where that is a float; others as doubles."""
    x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return x if x.dtype in (np.float32, np.float64) else x.astype(np.float64)


def _entries(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return _stored(batch, column, dim).astype(np.float64)


def whole(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite entries."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < 1e150, F.lit(False)))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def choose_pivots(vectors: DataFrame, dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` different vectors, those with the least hashes: the same ones on any cluster."""
    h = F.xxhash64(F.lit(seed), "v")
    rows = vectors.select(h.alias("h"), "v").groupBy("h").agg(F.min("v").alias("v")).orderBy("h").limit(count).collect()
    found = np.array([r["v"] for r in rows], np.float64).reshape(-1, dim)
    if len(found) < 2:
        return found
    # Along the line of their widest spread, so that cells of one part lie near each other.
    around = found - found.mean(0)
    return found[np.argsort(around @ np.linalg.svd(around, full_matrices=False)[2][0], kind="stable")]


def assigned(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Vectors (id, v) with the number of their nearest pivot and the distance to it."""
    dim = pivots.shape[1]
    plain = Cells(pivots, *[np.empty(0)] * 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                d = plain.distances(_entries(part, "v", dim))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], names=["id", "v", "cell", "radius"])

    types = dict(vectors.dtypes)
    return vectors.mapInArrow(run, f"id {types['id']}, v {types['v']}, cell int, radius double")


def cells_of(members: DataFrame, pivots: np.ndarray, k: int) -> Cells:
    """What is known of the cells, by one aggregate of a row a cell; ``k`` least radii are kept on the map side too."""
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("radius"))
    stats = members.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).collect()
    p = len(pivots)
    size, low, high, nearest = np.zeros(p, np.int64), np.full(p, np.inf), np.full(p, -np.inf), np.full((p, k), np.inf)
    for r in stats:
        size[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    ranked = members.select("cell", "radius").withColumn("rank", rank).where(F.col("rank") <= k).groupBy("cell").agg(F.sort_array(F.collect_list("radius")).alias("r")).collect()
    for r in ranked:  # a row a cell, k numbers each
        nearest[r["cell"], :len(r["r"])] = r["r"]
    return Cells(pivots, size, np.maximum(-(-size // BLOCK), 1), low, high, nearest)


def _blocks(rows: DataFrame, keys: list[str], dim: int, most: int) -> DataFrame:
    """Rows (keys..., id, v) as blocks (keys..., ids, data) of at most ``most`` rows each."""
    id_type = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, n = None, 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cols = [pa.array([v], pa.int32()) for v in key]
            return pa.RecordBatch.from_arrays([*cols, *_packed(table.column("id"), _stored(table, "v", dim))], names=[*keys, "ids", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ks = np.stack([batch.column(c).to_numpy() for c in keys], 1)
            cut = np.append(np.flatnonzero(np.append(True, (ks[1:] != ks[:-1]).any(1))), len(ks))
            for a, b in zip(cut, cut[1:]):
                while a < b:
                    if held and (tuple(ks[a]) != key or n >= most):
                        yield block()
                        held, n = [], 0
                    key = tuple(ks[a].tolist())
                    take = min(b - a, most - n)
                    held.append(batch.slice(a, take))
                    n += take
                    a += take
        if held:
            yield block()

    schema = ", ".join(f"{c} int" for c in keys) + f", ids array<{id_type}>, data binary"
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _packed(ids: pa.Array, x: np.ndarray) -> list[pa.Array]:
    """One row: all ids as a list, all entries as bytes."""
    return [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x.tobytes()], pa.binary())]


def asked(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(part, share, ids, data, bounds): blocks of queries for every part with a cell that they need, in one share each."""
    dim, parts = cells.pivots.shape[1], cells.parts().astype(np.float32)
    id_type = dict(queries.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = -(-batch.num_rows // max(-(-batch.num_rows // BLOCK), 1))
            for a in range(0, batch.num_rows, max(step, 1)):
                rows = batch.slice(a, step)
                x, stored = _entries(rows, "v", dim), _stored(rows, "v", dim)
                d = cells.distances(x)
                bound = cells.radius(d, k)
                wanted = cells.needed(d, bound).astype(np.float32) @ parts > 0
                share = zlib.crc32(stored.tobytes()) % SHARES
                for part in np.flatnonzero(wanted.any(0)).tolist():
                    at = np.flatnonzero(wanted[:, part])
                    block = _packed(rows.column("id").take(pa.array(at)), stored[at])
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([share], pa.int32()), *block, pa.array([bound[at].tobytes()], pa.binary())],
                                                     names=["part", "share", "ids", "data", "bounds"])

    return queries.mapInArrow(run, f"part int, share int, ids array<{id_type}>, data binary, bounds binary")


def _nearest_of(q: np.ndarray, bound: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its best ``k`` members within the bound: their places and exact squared distances, ties by id."""
    qq, xx = np.square(q).sum(1), np.square(x).sum(1)
    for a in range(0, len(q), 256):
        part = slice(a, a + 256)
        d = qq[part, None] - 2 * q[part] @ x.T + xx
        slack = _SLACK * (qq[part, None] + xx.max(initial=0))
        edge = np.square(bound[part, None]) * (1 + 1e-9) + slack
        near = d <= edge
        many = np.flatnonzero(near.sum(1) > 4 * k)  # sorting out the few of the others costs less than a partition
        if len(many):
            near[many] &= d[many] <= np.partition(d[many], k - 1, 1)[:, k - 1:k] + 2 * slack[many]
        for i in np.flatnonzero(near.any(1)).tolist():
            at = np.flatnonzero(near[i])
            exact = np.square(x[at] - q[a + i]).sum(1)
            order = np.lexsort((ids[at], exact))[:k]
            yield a + i, at[order], exact[order]


class _Best:
    """What the queries of one block have found so far: at most ``k`` each and their ties, and the bounds this leaves."""

    def __init__(self, ids: pa.Array, q: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.q, self.k, self.bound = ids, q, k, bound.copy()
        self.least = np.full((len(q), k), np.inf)
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.n = 0

    def ask(self, rows: np.ndarray, ids: pa.Array, x: np.ndarray, rank: np.ndarray) -> None:
        """Compare the queries at ``rows`` with members ``x``, whose ids are ``ids``."""
        near = list(_nearest_of(self.q[rows], self.bound[rows], x, rank, self.k))
        if not near:
            return
        for i, _, exact in near:
            row = rows[i]
            self.least[row] = np.sort(np.append(self.least[row], exact))[:self.k]
            self.bound[row] = min(self.bound[row], np.sqrt(self.least[row, -1]))
        row = np.repeat(rows[[i for i, _, _ in near]], [len(at) for _, at, _ in near])
        place, exact = (np.concatenate([n[j] for n in near]) for j in (1, 2))
        self.held.append((row, ids.take(pa.array(place)), exact))
        self.n += len(row)
        if self.n > 4 * self.k * len(self.q) + BLOCK:
            self._settle()

    def _settle(self) -> None:
        row, exact = (np.concatenate([h[j] for h in self.held]) for j in (0, 2))
        good = np.flatnonzero(exact <= self.least[row, -1])
        ids = pa.concat_arrays([h[1] for h in self.held]).take(pa.array(good))
        self.held, self.n = [(row[good], ids, exact[good])], len(good)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._settle()
            row, ids, exact = self.held[0]
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(row)), ids, pa.array(exact)], names=["query", "id", "distance"])


def knn_join(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "id", vector_col: str = "embedding", pivots: int = 128, seed: int = 42) -> DataFrame:
    """``(query_id, id, distance, similarity)``: the ``k`` nearest ``vectors`` of every row of ``queries``, exactly.

    ``distance`` is the squared Euclidean one, ties go to the smaller id. Both frames have ``id_col`` and
    ``vector_col``; a query that is itself among the vectors is its own neighbour. Vectors that are null, hold
    null or infinite entries or differ in length from the first pivot's neighbours (the most frequent length)
    are left out on both sides. Vectors that repeat count each, repeated queries are asked once; null ids are
    kept and come first among ties.
    Fewer than ``k`` vectors give fewer rows, none give none. Other columns are left out.

    ``pivots`` bounds what reaches the driver: that many vectors and ``k`` numbers for each. Frames that are
    costly to compute should be staged: vectors are read for pivots, cells and blocks.
    """
    spark = vectors.sparkSession
    points = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    dims = points.where("v IS NOT NULL AND size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    query_type, id_type = dict(queries.dtypes)[id_col], dict(vectors.dtypes)[id_col]
    schema = f"query_id {query_type}, id {id_type}, distance double, similarity double"
    if dims is None:
        return spark.createDataFrame([], schema)
    dim = dims["d"]
    points = points.where(whole(F.col("v"), dim))
    asking = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(whole(F.col("v"), dim)).distinct()
    wanted = asking.select(F.struct("id", F.xxhash64("v").alias("h")).alias("id"), "v")
    centres = choose_pivots(points, dim, min(pivots, -(-dims["n"] // MEMBERS)), seed)
    if not len(centres):
        return spark.createDataFrame([], schema)
    members = assigned(points, centres)
    cells = cells_of(members, centres, k)

    numbers = F.array(*[F.lit(int(b)) for b in cells.blocks])
    block = F.pmod(F.xxhash64("id", "v"), F.get(numbers, F.col("cell"))).cast("int")
    placed = members.withColumn("block", block).withColumn("part", cells.part(F.col("cell"), F.col("block")))
    stored = _blocks(placed.select("part", "cell", "block", "id", "v"), ["part", "cell", "block"], dim, 4 * BLOCK)
    stored = stored.select("part", "cell", "ids", "data", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    sought = asked(wanted, cells, k).withColumnsRenamed({"ids": "query_ids", "data": "query_data"})
    # The left side of a merge is streamed: a block of queries meets all blocks of its part in a row.
    pairs = sought.join(stored.hint("merge"), ["part", "share"])
    asked_type, stored_type = (np.float32 if t == "array<float>" else np.float64 for t in (dict(wanted.dtypes)["v"], dict(points.dtypes)["v"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        best, last = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                asking_ids, data = batch.column("query_ids")[i].values, batch.column("query_data")[i].as_buffer()
                if best is None or data != last or not asking_ids.equals(best.ids):
                    if best is not None:
                        yield from best.rows()
                    q = np.frombuffer(data, asked_type).astype(np.float64).reshape(-1, dim)
                    best, last = _Best(asking_ids, q, np.frombuffer(batch.column("bounds")[i].as_buffer(), np.float64), k), data
                    d = cells.distances(q)
                rows = np.flatnonzero(cells.needed(d, best.bound)[:, batch.column("cell")[i].as_py()])
                if not len(rows):
                    continue
                ids = batch.column("ids")[i].values
                x = np.frombuffer(batch.column("data")[i].as_buffer(), stored_type).astype(np.float64).reshape(-1, dim)
                rank = np.empty(len(ids), np.int64)
                rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
                best.ask(rows, ids, x, rank)
        if best is not None:
            yield from best.rows()

    key = wanted.schema["id"].dataType.simpleString()
    found = pairs.select("cell", "ids", "data", "query_ids", "query_data", "bounds").mapInArrow(run, f"query {key}, id {id_type}, distance double")
    best = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    top = found.withColumn("rank", best).where(F.col("rank") <= k)
    return with_computed(top, {"similarity": similarity(F.col("distance"))}).select(F.col("query.id").alias("query_id"), "id", "distance", "similarity")
