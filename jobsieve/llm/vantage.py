"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

A router, a vantage-point tree over a bounded sample, deals the rows into cells of near vectors;
large cells are split into shards by hash, so that no shard outgrows a task whatever the data. For
every cell the range of its rows' distances to each vantage point above it is known exactly. A
shard's own tree is built in the task that searches it; rows come first and queries follow in
batches, so a task holds one shard and one batch.

A query searches the shards of its own cell first. With the distance found there it visits other
cells only where the triangle inequality allows something nearer. ``factor`` relaxes the pruning,
within trees and between cells: a side is left out once ``factor * lower bound`` exceeds the distance
of the k-th found. Factor one is exact; larger ones skip more and may miss some.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.skew import fits_broadcast
from ..session import cut
from .common import free
from .vectors import finite, matrix

SHARD_ROWS = 8192
BLOCK_QUERIES = 8192
LEAF_ROWS = 256
#: Levels of the router, and sample rows per cell it is fitted on: 65,536 rows at most.
MAX_LEVELS, SAMPLE_PER_CELL = 12, 16
_LAST = np.iinfo(np.int64).max


def distances(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares summed in the order of the components."""
    total = np.zeros(len(points))
    for j in range(points.shape[1]):
        gap = points[:, j] - one[..., j]
        total += gap * gap
    return np.sqrt(total)


def _halves(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A vantage point, the row farthest from the first one, and the rows in two halves by distance to it."""
    vantage = points[rows[distances(points[rows], points[rows[0]]).argmax()]]
    far = distances(points[rows], vantage)
    order = np.argsort(far, kind="stable")
    return vantage, rows[order], far[order], order


# --- the router ----------------------------------------------------------------


@dataclass
class Router:
    """A complete tree of ``levels``: node i has children 2i + 1 and 2i + 2."""

    levels: int
    dim: int
    vantage: np.ndarray
    radius: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, levels: int) -> Router:
        n, dim = (1 << levels) - 1, sample.shape[1]
        vantage, radius = np.zeros((n, dim)), np.zeros(n)
        parts = {0: np.arange(len(sample))}
        for i in range(n):
            rows = parts.pop(i)
            if len(rows) < 2:  # copies of few vectors: one side stays empty
                vantage[i], radius[i] = (sample[rows[0]] if len(rows) else 0.0), np.inf
                parts[2 * i + 1], parts[2 * i + 2] = rows, rows[:0]
                continue
            vantage[i], rows, far, _ = _halves(sample, rows)
            half = len(rows) // 2
            radius[i] = far[half - 1]
            parts[2 * i + 1], parts[2 * i + 2] = rows[:half], rows[half:]
        return cls(levels, dim, vantage, radius)

    def path(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of every point and its distances to the vantage points on the way."""
        node, far = np.zeros(len(points), np.int64), np.zeros((len(points), self.levels))
        for level in range(self.levels):
            far[:, level] = distances(points, self.vantage[node])
            node = 2 * node + 1 + (far[:, level] > self.radius[node])
        return node - ((1 << self.levels) - 1), far

    def bounds(self, points: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For every point and cell the distance that no row of the cell can be nearer than."""
        far = np.stack([distances(points, v) for v in self.vantage], 1) if len(self.vantage) else np.zeros((len(points), 0))
        least = np.zeros((len(points), len(cells)))
        node = cells + (1 << self.levels) - 1
        for level in range(self.levels - 1, -1, -1):
            node = (node - 1) // 2
            d = far[:, node]
            np.maximum(least, np.maximum(low[:, level] - d, d - high[:, level]), out=least)
        return least


# --- one shard's tree ------------------------------------------------------------


class Tree:
    """A vantage-point tree over the rows of one shard, searched by many queries together."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.points, self.ids = points, ids
        self.square = (points * points).sum(1)
        self.order = np.arange(len(points))
        #: (begin, end, vantage, children, (low, high) of each child)
        self.nodes: list[tuple] = []
        waiting = [(0, len(points), -1, 0)]
        while waiting:
            a, b, parent, side = waiting.pop()
            if parent >= 0:
                self.nodes[parent][3][side] = len(self.nodes)
            if b - a <= leaf_rows:
                self.nodes.append((a, b, None, None, None))
                continue
            vantage, rows, far, _ = _halves(points, self.order[a:b])
            self.order[a:b] = rows
            half = (b - a) // 2
            ranges = ((far[0], far[half - 1]), (far[half], far[-1]))
            self.nodes.append((a, b, vantage, [0, 0], ranges))
            waiting += [(a, a + half, len(self.nodes) - 1, 0), (a + half, b, len(self.nodes) - 1, 1)]
        self.visited = 0

    def search(self, queries: np.ndarray, own: np.ndarray, tau: np.ndarray, k: int, factor: float) -> tuple:
        """(query, row, score) of the k nearest rows to each query, as far as they are within ``tau``."""
        m = len(queries)
        score = np.full((m, k), np.inf)
        row = np.full((m, k), -1, np.int64)
        tau = tau.copy()
        squares = (queries * queries).sum(1)
        slack = 1e-9 * (np.sqrt(squares) + np.sqrt(self.square.max(initial=0.0)))
        stack = [(0, np.arange(m), np.zeros(m))]
        while stack:
            at, active, least = stack.pop()
            go = ~(factor * least > tau[active] + slack[active])
            active = active[go]
            if not len(active):
                continue
            a, b, vantage, children, ranges = self.nodes[at]
            if vantage is None:
                self.visited += len(active) * (b - a)
                self._leaf(self.order[a:b], queries, squares, own, active, tau, score, row, k)
                continue
            d = distances(queries[active], vantage)
            bound = [np.maximum(least[go], np.maximum(lo - d, d - hi)) for lo, hi in ranges]
            near = int((bound[0] > bound[1]).sum() * 2 > len(active))  # the side more queries are in goes first
            stack += [(children[c], active, bound[c]) for c in (1 - near, near)]
        at, slot = np.nonzero(row >= 0)
        return at, row[at, slot], score[at, slot]

    def _leaf(self, rows, queries, squares, own, active, tau, score, row, k) -> None:
        points = self.points[rows]
        with np.errstate(invalid="ignore", over="ignore"):
            rough = squares[active][:, None] - 2 * (queries[active] @ points.T) + self.square[rows]
            mine = self.ids[rows][None] == own[active][:, None]
            rough[mine] = np.inf
            eps = 1e-12 * (squares[active] + self.square[rows].max())
            limit = tau[active] ** 2
            if len(rows) > k:
                limit = np.minimum(limit, np.partition(rough, k - 1, 1)[:, k - 1])
            close = ~(rough > (limit + 2 * eps)[:, None]) & ~mine
        q, r = np.nonzero(close)
        if not len(q):
            return
        exact = distances(queries[active[q]], points[r])
        # what is known and what is new, in the order of query, score and id
        q = np.concatenate((np.repeat(np.arange(len(active)), k), q))
        s = np.concatenate((score[active].reshape(-1), exact))
        x = np.concatenate((row[active].reshape(-1), rows[r]))
        ids = np.where(x >= 0, self.ids[x], _LAST)
        order = np.lexsort((x < 0, ids, s, q))
        q, s, x = q[order], s[order], x[order]
        first = np.searchsorted(q, np.arange(len(active)))
        take = first[:, None] + np.arange(k)
        score[active], row[active] = s[take], x[take]
        tau[active] = np.minimum(tau[active], score[active, -1])


# --- the jobs --------------------------------------------------------------------


def search(
    df: DataFrame, id_col: str, vec_col: str, every: int, k: int = 10, *, factor: float = 1.0,
    shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """The ``k`` nearest rows of every row whose id is divisible by ``every``.

    Returns ``query_id, rank, vec_id, score``: the Euclidean distance in double precision, nearest
    first, ties to the smaller id; all other rows if there are fewer than ``k``.

    * Rows whose vector is null, empty, all zero, or holds a null, NaN or infinite component take no
      part, neither as query nor as candidate.
    * Rows are told apart by their id: a query's own id is no candidate. Rows equal in id and vector
      count once. Rows that share an id but not the vector are all candidates, and queries of their
      own whose answers stand under the same ``query_id``.
    * A row without an id is a candidate like any other, after all ids in ties, but no query.
    * Vectors of different lengths have no distance: each is compared with those of its own length.
    * An empty table gives no rows. Other columns, whatever their names, have no effect.
    """
    spark = df.sparkSession
    zero = F.forall(F.col("vec"), lambda x: x == 0)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vec"))
    rows = rows.where(finite(F.col("vec"))).where(~zero)
    kind = rows.schema["vec"].dataType.simpleString()
    hashed = F.xxhash64("id", "vec")
    lengths = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = (common[0]["dim"], common[0]["n"]) if common else (1, 0)
    levels = min(MAX_LEVELS, max(0, int(np.ceil(np.log2(max(1, n) / shard_rows)))))
    sample = rows.where(F.size("vec") == dim).orderBy(hashed).limit(SAMPLE_PER_CELL << levels).select("vec").collect() if levels else []
    router = Router.fit(np.array([r[0] for r in sample], np.float64).reshape(-1, dim), levels)

    # every row with its cell, and for each cell the ranges of its distances
    routed = cut(rows.mapInArrow(_route(router), f"id long, vec {kind}, cell int, n long, low array<double>, high array<double>"))
    of = lambda name, f: F.array(*[f(F.get(name, F.lit(i))) for i in range(levels)]).cast("array<double>").alias(name)
    cells = (
        routed.where(F.col("n").isNotNull()).groupBy("cell").agg(F.sum("n").alias("n"), of("low", F.min), of("high", F.max))
        .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("n") / shard_rows)).cast("int"))
    )
    known = cells.where(F.col("cell") >= 0).orderBy("cell").collect()  # at most 2 ** MAX_LEVELS
    shards = cut(cells.select("cell", "shards"))
    whole = routed.where(F.col("n").isNull()).select("id", "vec", "cell")
    small = F.broadcast(shards) if fits_broadcast(shards) else shards
    placed = whole.join(small, "cell").withColumn("shard", F.pmod(F.xxhash64("id", "vec"), "shards").cast("int"))
    is_query = F.col("id").isNotNull() & (F.pmod("id", F.lit(every)) == 0)
    asked = whole.where(is_query).dropDuplicates(["id", "vec"])
    # Blocks of queries: near cells, which visit about the same shards, share one; a full cell has several.
    # One row per cell: at most 2 ** MAX_LEVELS of them and the lengths of other vectors.
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    total = cut(
        asked.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
        .select("cell", F.ceil(F.col("m") / block_queries).cast("int").alias("blocks"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
        .select("cell", "blocks", F.floor(F.col("before") / block_queries).alias("first"))
    )
    queries = cut(
        asked.join(F.broadcast(total) if fits_broadcast(total) else total, "cell")
        .select(
            "id", "vec", "cell", F.xxhash64("vec").alias("key"), F.col("cell").alias("home"),
            (F.col("first") + F.pmod(F.xxhash64("vec", "id"), "blocks")).cast("int").alias("block"),
        )
    )

    def run(visits: DataFrame) -> DataFrame:
        pairs = visits.join(small, "cell").select(
            "id", "vec", "key", "tau", "cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block"
        )
        asked_of = pairs.select("cell", "shard", "block").distinct()
        stored = placed.join(asked_of, ["cell", "shard"]).select(
            "cell", "shard", "block", F.lit(0).alias("kind"), "id", F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("tau"), "vec"
        )
        coming = pairs.select("cell", "shard", "block", F.lit(1).alias("kind"), "id", "key", "tau", "vec")
        where = ["cell", "shard", "block"]
        tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        together = stored.unionByName(coming).repartition(tasks, *where).sortWithinPartitions(*where, "kind")
        return together.mapInArrow(_visit(k, factor, leaf_rows), "query_id long, key long, vec_id long, score double")

    unbounded = F.lit(float("inf")).alias("tau")
    found = cut(_best(run(queries.select("id", "vec", "key", "cell", "block", unbounded)), k))
    kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "key", F.col("score").alias("tau"))
    elsewhere = queries.join(kth, ["id", "key"], "left").withColumn("tau", F.coalesce("tau", unbounded))
    if len(known) > 1:
        more = elsewhere.where(F.col("cell") >= 0).mapInArrow(
            _elsewhere(router, known, factor), f"id long, vec {kind}, key long, tau double, cell int, block int"
        )
        found = _best(found.drop("rank").unionByName(run(more)), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; Spark keeps only k per task before it shuffles."""
    order = Window.partitionBy("query_id", "key").orderBy("score", F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _route(router: Router):
    """Adds each row's cell; every task adds one row per cell with its count and its ranges."""
    names = ["id", "vec", "cell", "n", "low", "high"]
    lists = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, list] = {}
        for batch in batches:
            vec = batch.column(1)
            kind = vec.type
            size = vec.value_lengths().to_numpy(zero_copy_only=False)
            cell = -size.astype(np.int64)
            same = np.flatnonzero(size == router.dim)
            if len(same):
                cell[same], far = router.path(matrix(vec.take(pa.array(same))))
                order = np.argsort(cell[same], kind="stable")
                got, first = np.unique(cell[same][order], return_index=True)
                low, high = np.minimum.reduceat(far[order], first, 0), np.maximum.reduceat(far[order], first, 0)
                for c, l, h, m in zip(got.tolist(), low, high, np.diff(np.append(first, len(same))).tolist()):
                    n, l0, h0 = count.get(c, (0, l, h))
                    count[c] = [n + m, np.minimum(l, l0), np.maximum(h, h0)]
            for c, m in zip(*[x.tolist() for x in np.unique(cell[cell < 0], return_counts=True)]):
                count[c] = [count.get(c, (0,))[0] + m, np.zeros(router.levels), np.zeros(router.levels)]
            n = len(size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), vec, pa.array(cell, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, lists), pa.nulls(n, lists)], names=names
            )
        if count:
            n = len(count)
            low, high = (pa.array([list(v[i]) for v in count.values()], lists) for i in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.array(list(count), pa.int32()), pa.array([v[0] for v in count.values()], pa.int64()), low, high],
                names=names,
            )

    return run


def _elsewhere(router: Router, known: list, factor: float):
    """The cells other than its own that may hold something nearer, per query."""
    cells = np.array([c["cell"] for c in known], np.int64)
    low, high = (np.array([c[x] for c in known], np.float64).reshape(len(cells), -1) for x in ("low", "high"))
    step = max(1, (1 << 20) // max(len(cells), len(router.vantage) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                points = matrix(batch.column("vec"))
                tau = batch.column("tau").to_numpy(zero_copy_only=False)
                home = batch.column("home").to_numpy(zero_copy_only=False)
                least = router.bounds(points, cells, low, high)
                slack = 1e-9 * np.sqrt((points * points).sum(1)) + 1e-9 * high.max(initial=0.0)
                at, to = np.nonzero(~(factor * least > (tau + slack)[:, None]) & (cells[None] != home[:, None]))
                if len(at):
                    take = pa.array(at)
                    out = {c: batch.column(c).take(take) for c in ("id", "vec", "key", "tau", "block")}
                    out["cell"] = pa.array(cells[to], pa.int32())
                    yield pa.RecordBatch.from_pydict({c: out[c] for c in ("id", "vec", "key", "tau", "cell", "block")})

    return run


def _visit(k: int, factor: float, leaf_rows: int):
    """Builds a shard's tree from the rows that come first and answers the queries that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree, ids = None, [], None, None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "shard", "block", "kind")], 1)
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)]):
                piece, place = batch.slice(a, b - a), tuple(where[a][:3].tolist())
                if place != at:
                    at, held, tree = place, [], None
                points = matrix(piece.column("vec"))
                if where[a][3] == 0:
                    held.append((piece.column("id"), points))
                    continue
                if tree is None:
                    if not held:
                        continue
                    ids, tree = _tree(held, leaf_rows)
                    held = []
                own = piece.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                tau = piece.column("tau").to_numpy(zero_copy_only=False)
                q, row, score = tree.search(points, own, tau, k, factor)
                if len(q):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[q]), piece.column("key").take(pa.array(q)), ids.take(pa.array(row)), pa.array(score)],
                        names=["query_id", "key", "vec_id", "score"],
                    )

    return run


def _tree(held: list[tuple[pa.Array, np.ndarray]], leaf_rows: int) -> tuple[pa.Array, Tree]:
    """The tree of a shard's rows, each once, and their ids; a row without id sorts last."""
    ids = pa.concat_arrays([i for i, _ in held])
    points = np.concatenate([p for _, p in held])
    numbers = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
    order = np.lexsort((*points.T[::-1], numbers))
    again = (numbers[order][1:] == numbers[order][:-1]) & (points[order][1:] == points[order][:-1]).all(1)
    keep = order[np.concatenate(([True], ~again))] if len(order) else order
    return ids.take(pa.array(keep)), Tree(points[keep], numbers[keep], leaf_rows)
