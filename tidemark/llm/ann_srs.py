"""Approximate nearest neighbours by low-dimensional stable projections.

A vector is projected by ``m`` seeded Gaussian (2-stable) directions: for two
vectors at distance d, (projected distance / d)^2 is chi-square with m degrees
of freedom.  So once the next projected neighbour is at p and the k-th best
distance found is d, a better neighbour still ahead is missed with probability
at most ``1 - sure`` if p^2 / d^2 >= the ``sure`` quantile: that is the
stopping test.  There is no cap on the neighbours that are verified.  ``sure`` is
the smallest value that finds the share ``recall`` of the true neighbours within
the sample below, and never less than ``LEAST_SURE``.

The projected points are indexed by a kd-tree.  Its upper levels are fitted on
at most ``SAMPLE`` rows and cut space into cells; every row goes to its cell,
a cell with many rows (equal vectors, say) is dealt over blocks, and a block
builds the lower levels, with leaves of ``LEAF`` points.  Leaves out of reach are
left out by their boxes, and the points of the others are verified one after
another in the order of their projected distance, on the original vectors, in
double precision, until the test holds.

Round one searches each query's own cell and gives it a bound.  Round two goes
to all cells that the stopping test with that bound does not rule out.  A block
meets at most ``QUERIES`` queries at a time.

Vectors that are null, zero, of another length than most of the sample, or hold
null or non-finite components take no part, nor do null ids.  Rows with the
query's own id are not its candidates; of a repeated id that asks, the vector
with the smallest hash asks.  Ties go to the smaller id.  With fewer candidates
than k all are returned.  An empty table gives an empty table.  Columns other
than the id, the vector and those of ``is_query`` are not read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

SAMPLE, LEAF, CELL_ROWS, BLOCK_ROWS, QUERIES, MOST_CELLS = 16384, 32, 1024, 2048, 1024, 2048
#: Sample rows that ask when ``sure`` is fitted, and the least ``sure``.
ASKING, LEAST_SURE = 200, 0.9
#: Points that are verified between two looks at the stopping test, at first.
STEP = 32
#: Projections of equal vectors may differ by rounding; relative to the squared length.
SLACK = 1e-9


def chi_square_quantile(p: float, m: int) -> float:
    """By bisection of the regularized gamma function's series."""
    from math import exp, lgamma, log

    def below(x: float) -> float:
        a, x = m / 2, x / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return total * exp(-x + a * log(x) - lgamma(a))

    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def fit_sure(sample: np.ndarray, directions: np.ndarray, k: int, recall: float) -> float:
    """The chi-square probability whose quantile, as stopping test, keeps the share ``recall`` of the sample's own neighbours."""
    asks, points = sample[:ASKING], sample @ directions
    m = directions.shape[1]
    if len(sample) <= k + 1:
        return LEAST_SURE
    ratio = []
    for i, q in enumerate(asks):
        d = ((sample - q) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.argpartition(d, k)[:k]
        ratio.append(((points[near] - points[i]) ** 2).sum(axis=1) / max(d[near].max(), 1e-300))
    stop = float(np.quantile(np.concatenate(ratio), recall))
    lo, hi = LEAST_SURE, 1 - 1e-9
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_quantile(mid, m) < stop else (lo, mid)
    return hi


class Cells:
    """The kd-tree's upper levels: splits (axis, value) as a heap, and each cell's box."""

    def __init__(self, points: np.ndarray, cells: int) -> None:
        self.depth = max(0, int(np.ceil(np.log2(max(1, cells)))))
        m = points.shape[1]
        n = 1 << self.depth
        self.axis, self.value = np.zeros(n, np.int32), np.zeros(n)
        self.low, self.high = np.full((n, m), -np.inf), np.full((n, m), np.inf)
        groups = {1: (np.arange(len(points)), np.full(m, -np.inf), np.full(m, np.inf))}
        for node in range(1, n):
            rows, low, high = groups.pop(node)
            here = points[rows] if len(rows) else np.zeros((1, m))
            axis = int(np.argmax(here.max(0) - here.min(0)))
            value = float(np.median(here[:, axis]))
            self.axis[node], self.value[node] = axis, value
            left = points[rows, axis] < value
            up, down = high.copy(), low.copy()
            up[axis], down[axis] = min(high[axis], value), max(low[axis], value)
            groups[2 * node], groups[2 * node + 1] = (rows[left], low, up), (rows[~left], down, high)
        for node, (_, low, high) in groups.items():
            self.low[node - n], self.high[node - n] = low, high

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.value[node])
        return node - (1 << self.depth)

    def near(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point from every cell's box."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(axis=1)


class Leaves:
    """The lower levels: points of a block in leaves of about equal size, with boxes."""

    def __init__(self, points: np.ndarray) -> None:
        parts, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                parts.append(rows)
                continue
            axis = int(np.argmax(points[rows].max(0) - points[rows].min(0)))
            order = np.argpartition(points[rows, axis], len(rows) // 2)
            todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        self.leaf = np.empty(len(points), np.int64)
        for number, rows in enumerate(parts):
            self.leaf[rows] = number
        self.low = np.array([points[r].min(0) for r in parts])
        self.high = np.array([points[r].max(0) for r in parts])

    def near(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point from the box of each point's leaf."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(axis=1)[self.leaf]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 1))


def search(table: DataFrame, is_query: F.Column, k: int = 10, m: int = 32, recall: float = 0.95, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), key, score (Euclidean distance) of each query's k nearest found."""
    v = F.col(vector)
    base = table.select(F.col(key).cast("bigint").alias("id"), v.cast("array<double>").alias("v"), is_query.alias("asks")).where("id is not null and v is not null and size(v) > 0")
    base = base.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0))
    count = base.count()
    empty = table.sparkSession.createDataFrame([], f"query_id bigint, rank int, {key} bigint, score double")
    if not count:
        return empty
    # a bounded sample, the rows of the smallest hashes
    some = base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("v").toPandas()["v"]
    d = int(pd.Series([len(x) for x in some]).mode()[0])
    base = base.where(F.size("v") == d)
    directions = np.random.default_rng(seed).standard_normal((d, m))
    sample = np.stack([np.asarray(x, np.float64) for x in some if len(x) == d])
    cells = Cells(sample @ directions, min(MOST_CELLS, -(-count // CELL_ROWS)))
    stop = chi_square_quantile(fit_sure(sample, directions, k, recall), m)

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), d)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.of(x @ directions).astype(np.int32))], [*b.schema.names, "cell"])

    placed = written(base.mapInArrow(place, "id bigint, v array<double>, asks boolean, cell int"), "vectors")
    # one row for each cell, MOST_CELLS at most
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = {c: -(-n // BLOCK_ROWS) for c, n in sizes.items()}
    look = lambda numbers: F.coalesce(F.create_map(*[F.lit(x) for item in numbers.items() for x in item])[F.col("cell")], F.lit(1)) if any(n > 1 for n in numbers.values()) else F.lit(1)
    rows = placed.select("id", "v", "cell", F.pmod(F.xxhash64("id", "v"), look(blocks)).cast("int").alias("block"))

    def visit(routed: DataFrame) -> DataFrame:
        """routed: query_id, q, bound, cell. The k best in each block of the cells."""
        asked = {r["cell"]: -(-r["n"] // QUERIES) for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        wanted = rows.where(F.col("cell").isin(*asked)) if len(asked) < len(sizes) else rows
        left = wanted.withColumn("turn", F.explode(F.sequence(F.lit(0), look(asked) - 1)))
        right = routed.withColumn("block", F.explode(F.sequence(F.lit(0), look(blocks) - 1))).withColumn("turn", F.pmod(F.xxhash64("query_id"), look(asked)).cast("int"))

        def meet(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(points) and len(queries):
                x, ids = _matrix(points["v"]), points["id"].to_numpy()
                p = x @ directions
                tree, length = Leaves(p), (p * p).sum(axis=1)
                asked = _matrix(queries["q"])
                for query, q, at, bound in zip(queries["query_id"], asked, asked @ directions, queries["bound"], strict=True):
                    slack = SLACK * (1 + at @ at)
                    best, names, limit = np.empty(0), np.empty(0, np.int64), bound * bound
                    far = np.maximum(0, length - 2 * (p @ at) + at @ at)
                    order = np.flatnonzero((ids != query) & (far <= limit * stop + slack) & (tree.near(at) <= limit * stop + slack))
                    order = order[np.argsort(far[order], kind="stable")]
                    done, step = 0, STEP
                    while done < len(order) and far[order[done]] <= limit * stop + slack:
                        r = order[done : done + step]
                        done, step = done + step, 2 * step
                        diff = x[r] - q
                        best = np.concatenate([best, (diff * diff).sum(axis=1)])
                        names = np.concatenate([names, ids[r]])
                        if len(best) > k:
                            keep = np.lexsort((names, best))[:k]
                            best, names = best[keep], names[keep]
                        if len(best) == k:
                            limit = min(limit, best.max())
                    out.append(pd.DataFrame({"query_id": np.full(len(best), query), "id": names, "score": np.sqrt(best)}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

        return left.groupBy("cell", "block", "turn").cogroup(right.groupBy("cell", "block", "turn")).applyInPandas(meet, "query_id bigint, id bigint, score double")

    queries = placed.where("asks").groupBy(F.col("id").alias("query_id")).agg(F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("q"), "cell")).alias("one")).select("query_id", "one.q", "one.cell")
    first = written(visit(queries.withColumn("bound", F.lit(float("inf")))), "first")
    # of the candidates of a query in its own cell, at most k for each block
    ranked = Window.partitionBy("query_id").orderBy("score", "id")
    bounds = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    bounded = queries.join(bounds, "query_id", "left").select("query_id", "q", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted(sizes))
        for b in parts:
            q = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(len(b), d)
            bound, own = b.column("bound").to_numpy(), b.column("cell").to_numpy()
            for i in range(len(b)):
                at = q[i] @ directions
                near = known[cells.near(at)[known] <= bound[i] * bound[i] * stop + SLACK * (1 + at @ at)]
                near = near[near != own[i]].astype(np.int32)
                if len(near):
                    take = pa.array(np.full(len(near), i))
                    yield pa.RecordBatch.from_arrays([b.column("query_id").take(take), b.column("q").take(take), b.column("bound").take(take), pa.array(near)], ["query_id", "q", "bound", "cell"])

    routed = written(bounded.mapInArrow(route, "query_id bigint, q array<double>, bound double, cell int"), "routed")
    found = first.unionByName(visit(routed)) if not routed.isEmpty() else first
    best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
