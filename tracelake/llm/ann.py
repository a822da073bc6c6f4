"""Nearest neighbours by low-dimensional Gaussian (2-stable) projections in kd-trees (after SRS, Sun et al. 2014).

Every vector is projected to DIMENSIONS numbers. For a projected difference p of a true difference d, |p|^2 / |d|^2
has a chi-square distribution with DIMENSIONS degrees of freedom. So points come in ascending projected distance from
a kd-tree, each is verified in the original space, and the search stops when the chi-square test says that a point
nearer than the k-th found would, with probability STOP, have had a smaller projected distance than the present one.

Distribution: the top of the kd-tree is fitted on a sample of at most SAMPLE rows and cuts the projected space into
cells; every row is indexed in its cell, large cells in blocks of about BLOCK_ROWS by a hash. A query first searches
its own cell, which bounds its k-th distance, then in rounds those up to the 4th, 16th, 64th, ... in ascending projected
distance, as far as the test does not rule them out with the bound of the round before. Rounds end when no query has a
cell left, so their number grows with the logarithm of the cells.

Equal vectors are one point with its least k + 1 ids, and equal queries are one query; a group of copies of any size
sends at most k + 1 rows from each map task. Vectors that are null, zero or hold a null or non-finite component take
no part; only vectors of one length are compared. Ties go to the smaller id. Rows with a null id take no part.
Repeated rows count once. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import Workspace

DIMENSIONS = 8
STOP = 0.97
SAMPLE = 40_000
CELL_ROWS = 8_192
MAX_CELLS = 4_096
BLOCK_ROWS = 65_536
LEAF = 64
SEED = 20_14


def projection(length: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng((SEED, length)).standard_normal((length, dimensions))


def chi_square_quantile(p: float, dof: int) -> float:
    """x with P(chi-square with an even `dof` <= x) = p, by bisection of the closed form."""
    if dof % 2:
        raise ValueError("an even number of dimensions is needed")

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for k in range(1, dof // 2):
            term *= x / 2 / k
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 10.0 * dof + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def top_cells(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Splits (axis, value) of a balanced kd-tree in heap order; the widest axis at its median."""
    splits: list[tuple[int, float]] = []
    groups = [sample]
    while len(groups) < cells:
        after = []
        for g in groups:
            axis = int(np.argmax(np.ptp(g, axis=0))) if len(g) else 0
            value = float(np.median(g[:, axis])) if len(g) else 0.0
            splits.append((axis, value))
            after += [g[g[:, axis] <= value], g[g[:, axis] > value]]
        groups = after
    return splits


def cell_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), dtype=np.int64)
    depth = int(math.log2(len(splits) + 1))
    if splits:
        axes, values = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
        for _ in range(depth):
            at = 2 * at + 1 + (points[np.arange(len(points)), axes[at]] > values[at])
    return at - (2**depth - 1)


def cell_boxes(splits: list[tuple[int, float]], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest corner of every cell."""
    boxes = [(np.full(dimensions, -np.inf), np.full(dimensions, np.inf))]
    depth, at = int(math.log2(len(splits) + 1)), 0
    for _ in range(depth):
        after = []
        for low, high in boxes:
            axis, value = splits[at]
            at += 1
            left, right = high.copy(), low.copy()
            left[axis] = right[axis] = value
            after += [(low, left), (right, high)]
        boxes = after
    return np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])


class KdTree:
    """Leaves of about LEAF projected points with their bounding boxes, met in ascending distance."""

    def __init__(self, points: np.ndarray):
        self.points, leaves, stack = points, [], [np.arange(len(points))]
        while stack:
            rows = stack.pop()
            spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(1)
            if len(rows) <= LEAF or not spread.max() > 0:
                leaves.append(rows)
                continue
            axis = int(spread.argmax())
            half = len(rows) // 2
            order = rows[np.argpartition(points[rows, axis], half)]
            stack += [order[:half], order[half:]]
        self.leaves = [r for r in leaves if len(r)]
        self.low = np.array([points[r].min(axis=0) for r in self.leaves]).reshape(len(self.leaves), -1)
        self.high = np.array([points[r].max(axis=0) for r in self.leaves]).reshape(len(self.leaves), -1)

    def ascending(self, query: np.ndarray):
        """(projected squared distances, rows) in steps, each step's points nearer than all that come later."""
        gap = np.maximum(np.maximum(self.low - query, query - self.high), 0)
        to_leaf = (gap**2).sum(axis=1)
        order = np.argsort(to_leaf, kind="stable")
        wait_d, wait_r = np.zeros(0), np.zeros(0, dtype=np.int64)
        for k, leaf in enumerate(order):
            rows = self.leaves[leaf]
            wait_d = np.concatenate((wait_d, ((self.points[rows] - query) ** 2).sum(axis=1)))
            wait_r = np.concatenate((wait_r, rows))
            bound = to_leaf[order[k + 1]] if k + 1 < len(order) else np.inf
            ready = wait_d <= bound
            if ready.any():
                d, r = wait_d[ready], wait_r[ready]
                s = np.argsort(d, kind="stable")
                yield d[s], r[s]
                wait_d, wait_r = wait_d[~ready], wait_r[~ready]


def search(tree: KdTree, vectors: np.ndarray, query: np.ndarray, projected: np.ndarray, k: int, bound: float, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the k nearest found; `bound` is a k-th distance known already, `limit` the test's quantile."""
    best_d, best_r = np.zeros(0), np.zeros(0, dtype=np.int64)
    for d, rows in tree.ascending(projected):
        kth = min(bound, best_d[-1] if len(best_d) == k else np.inf)
        if d[0] > limit * kth * kth:
            break
        rows = rows[d <= limit * kth * kth]
        true = np.sqrt(((vectors[rows] - query) ** 2).sum(axis=1))
        best_d, best_r = np.concatenate((best_d, true)), np.concatenate((best_r, rows))
        if len(best_d) > k:
            cut = np.partition(best_d, k - 1)[k - 1]
            kept = best_d <= cut  # ties stay, ids decide later
            best_d, best_r = best_d[kept], best_r[kept]
        s = np.argsort(best_d, kind="stable")
        best_d, best_r = best_d[s], best_r[s]
        if len(best_d) > k and best_d[k - 1] == 0:
            break
        if len(best_d) > k:
            best_d_k = best_d[:k]
            bound = min(bound, best_d_k[-1])
    return best_r, best_d


def _usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest(table: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", stop: float = STOP, workspace: Workspace | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that `is_query` names its k nearest other rows."""
    spark = table.sparkSession
    workspace = workspace or Workspace(spark, "ann")
    rows = table.where(F.col(key).isNotNull() & _usable(vector)).select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + 0.0))  # -0.0 and 0.0 are one
    # a point for each distinct vector: its least k + 1 ids (the limit applies before the shuffle too)
    same = Window.partitionBy("v").orderBy("id")
    least = rows.select("id", "v").distinct().withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    points = least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("point", F.element_at("ids", 1)).withColumn("n", F.size("v"))
    points = workspace.save("points", points)
    counts = {r["n"]: r["count"] for r in points.groupBy("n").count().collect()}  # one for each length of vectors
    limit = chi_square_quantile(stop, DIMENSIONS)

    trees: dict[int, list[tuple[int, float]]] = {}
    for n, count in counts.items():
        cells = min(MAX_CELLS, 2 ** max(0, math.ceil(math.log2(max(1, count / CELL_ROWS)))))
        sample = points.where(F.col("n") == n).orderBy(F.xxhash64("point")).limit(SAMPLE).select("v").toPandas()["v"] if cells > 1 else []
        trees[n] = top_cells(np.stack(sample) @ projection(n), cells) if cells > 1 else []
    blocks = {n: max(1, math.ceil(c / (len(trees[n]) + 1) / BLOCK_ROWS)) for n, c in counts.items()}
    shipped = spark.sparkContext.broadcast((trees, blocks))  # MAX_CELLS splits at most for each length

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        trees, _ = shipped.value
        out = np.zeros(len(v), dtype=np.int32)
        sizes = v.map(len).to_numpy()
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            out[at] = cell_of(np.stack(v.iloc[at]) @ projection(int(n)), trees[int(n)])
        return pd.Series(out)

    per_length = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]) if blocks else F.create_map(F.lit(0), F.lit(1))
    index = workspace.save("index", points.withColumn("cell", cell("v")).withColumn("block", F.pmod(F.xxhash64("point"), per_length[F.col("n")]).cast("int")))
    asks = rows.where("asks").select("id", "v").distinct()
    queries = workspace.save("queries", asks.join(index.select("v", "point", "n", "cell"), "v").select("id", "point", "n", "cell"))
    asked = workspace.save("asked", queries.select("point").distinct().join(index.select("point", "v", "n", "cell"), "point"))

    every_block = F.explode(F.sequence(F.lit(0), per_length[F.col("n")] - 1)).alias("block")

    def found(wanted: DataFrame) -> DataFrame:
        """Searches (point, n, cell, bound) in all blocks of those cells."""

        def one(asked: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(asked) and len(here):
                vectors = np.stack(here["v"])
                directions = projection(vectors.shape[1])
                tree = KdTree(vectors @ directions)
                names = here["point"].to_numpy()
                for point, v, bound in zip(asked["point"], asked["v"], asked["bound"], strict=True):
                    v = np.asarray(v)
                    at, d = search(tree, vectors, v, v @ directions, k + 1, bound, limit)
                    order = np.lexsort((names[at], d))[: k + 1]
                    out += [(point, int(names[at[i]]), float(d[i])) for i in order]
            return pd.DataFrame(out, columns=["point", "near", "score"]).astype({"point": "int64", "near": "int64", "score": "float64"})

        targets = wanted.join(asked.select("point", "v"), "point").select("point", "v", "n", "cell", "bound", every_block)
        here = index.join(F.broadcast(wanted.select("n", "cell").distinct()), ["n", "cell"], "left_semi")  # MAX_CELLS at most for each length
        return targets.groupBy("n", "cell", "block").cogroup(here.groupBy("n", "cell", "block")).applyInPandas(one, "point long, near long, score double")

    nth = F.row_number().over(Window.partitionBy("point").orderBy("score", "near"))

    @F.pandas_udf("array<int>")
    def next_cells(v: pd.Series, own: pd.Series, bound: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        """Of the cells in ascending distance, the own one first, those from `first` to before `last` that the test leaves."""
        trees, _ = shipped.value
        known: dict[int, tuple] = {}
        out = []
        for x, c, b, lo, hi in zip(v, own, bound, first, last, strict=True):
            x = np.asarray(x)
            if len(x) not in known:
                known[len(x)] = (projection(len(x)), *cell_boxes(trees[len(x)], DIMENSIONS))
            directions, low, high = known[len(x)]
            p = x @ directions
            gap = (np.maximum(np.maximum(low - p, p - high), 0) ** 2).sum(axis=1)
            gap[c] = -1
            near = np.argsort(gap, kind="stable")[lo:hi]
            out.append([int(i) for i in near if gap[i] <= limit * b * b])
        return pd.Series(out)

    # round by round: a table of (point, cell, block, bound) to search, then the best found so far
    cells, best, lo, hi, turn = max((len(t) + 1 for t in trees.values()), default=1), None, 0, 1, 0
    while lo < cells:
        if best is None:
            bounded = asked.withColumn("bound", F.lit(float("inf")))
        else:
            bounded = asked.join(best.where(F.col("nth") == k + 1).select("point", F.col("score").alias("bound")), "point", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        wanted = bounded.withColumn("cell", F.explode(next_cells("v", "cell", "bound", F.lit(lo), F.lit(hi)))).select("point", "n", "cell", "bound")
        wanted = workspace.save(f"wanted-{turn}", wanted)
        if wanted.isEmpty():
            break
        new = found(wanted)
        best = workspace.save(f"best-{turn}", (new if best is None else new.union(best.select("point", "near", "score"))).withColumn("nth", nth).where(F.col("nth") <= k + 1))
        lo, hi, turn = hi, 4 * hi, turn + 1
    if best is None:
        best = asked.select("point", F.col("point").alias("near"), F.lit(0.0).alias("score"))  # without rows
    # a point stands for all its ids, and a query is no neighbour of its own
    named = best.select("point", "near", "score").join(index.select(F.col("point").alias("near"), "ids"), "near").select("point", "score", F.explode("ids").alias("vec_id"))
    named = named.withColumn("nth", F.row_number().over(Window.partitionBy("point").orderBy("score", "vec_id"))).where(F.col("nth") <= k + 1)
    mine = queries.select(F.col("id").alias("query_id"), "point").join(named, "point").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return mine.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
