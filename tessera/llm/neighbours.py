"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Every vector is projected to DIMS numbers by a Gaussian (2-stable) matrix: the squared projected distance over the squared true distance has a
chi-square distribution of DIMS degrees. The projections are indexed in two levels of a kd-tree: the upper splits, fitted on a bounded sample,
deal all vectors into cells; each cell is indexed whole by its own tree. A query takes its projected neighbours leaf by leaf, nearest first, and
verifies them by true distances, until the chi-square test says that a vector nearer than the k-th found would have come up by now with
probability CONFIDENCE. It starts in its own cell; the distance reached there decides by the same test which other cells it must visit. A cell of more
than PART entries is dealt by hash into parts with a tree each, all of which its queries visit: a task's memory does not follow the table's size.

Equal vectors are one entry of the index with their smallest ids (k and one more: a larger id can never be among the k nearest), so a vector that
fills a third of the table costs one entry; queries of equal vectors are searched once. Queries meet a cell in blocks of bounded size. The joins that hand
the one entry to the queries of a hot vector have one row on the other side, so Spark's skew join may split them.

Defined results: ties go to the smaller id; vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
an id or of another length than most vectors have (of equally frequent lengths the larger); rows that repeat id and vector are one row; a
candidate with the query's own id is the query's own; with fewer candidates than k all are returned; an empty table gives an empty result. Only the id
and the vector are read: further columns may have any name, those of the result too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, quoted, small_batches, stored

DIMS, CONFIDENCE, SEED = 8, 0.98, 11
#: Rows a cell is meant to have, rows of a leaf, vectors the upper splits are fitted on at most, and queries that meet a cell at once.
CELL, LEAF, SAMPLE, BLOCK = 8192, 64, 65_536, 4096
#: Entries of a cell that meet queries in one task, about.
PART = 65_536


def chi_square_cdf(x: float, dims: int) -> float:
    """For an even number of degrees."""
    term = total = 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, dims) < p else (low, mid)
    return high


def projection(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, DIMS))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, width)


def split_tree(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Median splits in heap order (children of i: 2i + 1, 2i + 2), each on the axis of the widest spread."""
    out: list[tuple[int, float]] = [(0, 0.0)] * ((1 << depth) - 1)
    todo = [(0, points)] if depth else []
    while todo:
        i, own = todo.pop()
        axis = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
        cut = float(np.median(own[:, axis])) if len(own) else 0.0
        out[i] = axis, cut
        if 2 * i + 2 < len(out):
            low = own[:, axis] <= cut
            todo += [(2 * i + 1, own[low]), (2 * i + 2, own[~low])]
    return out


def descend(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    """The cell of each point."""
    axis, cut = (np.array(x) for x in zip(*splits, strict=True)) if splits else (np.empty(0, int), np.empty(0))
    at = np.zeros(len(points), np.int64)
    while len(splits) and at.min(initial=len(splits)) < len(splits):
        open_ = at < len(splits)
        now = at[open_]
        at[open_] = 2 * now + 1 + (points[open_, axis[now]] > cut[now])
    return at - len(splits)


class Tree:
    """The leaves of a kd-tree over projected points, with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaves = points, []
        todo = [np.arange(len(points))]
        while todo:
            own = todo.pop()
            if len(own) <= leaf:
                self.leaves.append(own)
                continue
            at = points[own]
            axis = int(np.argmax(at.max(0) - at.min(0)))
            order = np.argpartition(at[:, axis], len(own) // 2)
            todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
        self.low = np.stack([points[x].min(0) for x in self.leaves])
        self.high = np.stack([points[x].max(0) for x in self.leaves])


def box_distance(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance from a point to each box."""
    return (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(1)


def search(tree: Tree, vectors: np.ndarray, keys: np.ndarray, query: np.ndarray, projected: np.ndarray, k: int, bound: float, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distances of the k nearest by (distance, key). bound: distance of the k-th that is known from elsewhere; limit: chi-square quantile."""
    away = box_distance(projected, tree.low, tree.high)
    rows, dist, kth = np.empty(0, np.int64), np.empty(0), bound
    for leaf in np.argsort(away, kind="stable"):
        if away[leaf] > limit * kth * kth:
            break
        own = tree.leaves[leaf]
        if np.isfinite(kth):
            near = ((tree.points[own] - projected) ** 2).sum(1)
            own = own[near <= limit * kth * kth]
        if not len(own):
            continue
        rows = np.r_[rows, own]
        dist = np.r_[dist, np.sqrt(((vectors[own] - query) ** 2).sum(1))]
        if len(rows) > k:
            best = np.lexsort((keys[rows], dist))[:k]
            rows, dist = rows[best], dist[best]
        if len(rows) == k:
            kth = min(bound, dist.max())
    best = np.lexsort((keys[rows], dist))
    return rows[best], dist[best]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    v = quoted(vector_col).cast("array<double>")
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter(F.coalesce(F.forall("v", lambda x: F.coalesce(fine(x), F.lit(False))) & F.exists("v", lambda x: x != 0), F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = lengths[0].width if lengths else 1
    return rows.filter(F.size("v") == width), width


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k nearest other rows."""
    rows, width = _usable(vectors, id_col, vector_col)
    first = Window.partitionBy("v").orderBy("vec_id")
    ranked = rows.distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    entries = ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("key"), "ids", "v")

    def project(batches):
        of = projection(width)
        for batch in small_batches(batches):
            p = matrix(batch.column(2), width) @ of
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), DIMS).cast(pa.list_(pa.float64()))], ["key", "ids", "v", "p"])

    entries = stored(in_batches(entries, project, "key long, ids array<long>, v array<double>, p array<double>"), "entries")
    total = entries.count()
    sample = entries.select("p", F.xxhash64("key").alias("h")).orderBy("h").limit(SAMPLE).toArrow()
    depth = min(max(0, math.ceil(math.log2(max(1, total) / CELL))), int(math.log2(SAMPLE // 16)))
    splits = split_tree(matrix(sample.column("p"), DIMS), depth)

    def place(batches):
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(descend(matrix(batch.column(3), DIMS), splits).astype(np.int32))], ["key", "ids", "v", "p", "cell"])

    cells = stored(in_batches(entries, place, "key long, ids array<long>, v array<double>, p array<double>, cell int"), "cells")
    # Queries by vector: each distinct one is an entry of the index and is searched once.
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    asked = stored(asked.join(cells.select("v", "key"), "v").select(F.col("vec_id").alias("query_id"), "key"), "queries")
    queries = cells.join(asked.select("key").distinct(), "key", "left_semi").select(F.col("key").alias("query"), F.col("v").alias("qv"), F.col("p").alias("qp"), "cell")
    sizes = {r.cell: r["count"] for r in cells.groupBy("cell").count().collect()}  # one row a cell, of which the sample allows SAMPLE / 16
    nearest_first = Window.partitionBy("query").orderBy("score", "key")
    home = _meet(cells, sizes, queries.withColumn("bound", F.lit(float("inf"))), width, k + 1)
    home = stored(home.withColumn("r", F.row_number().over(nearest_first)).filter(F.col("r") <= k + 1).drop("r"), "home")
    reached = home.groupBy("query").agg(F.count("*").alias("n"), F.max("score").alias("far"))
    reached = queries.join(reached, "query").select("query", "qv", "qp", F.col("cell").alias("own"), F.when(F.col("n") > k, F.col("far")).otherwise(float("inf")).alias("bound"))
    other = _meet(cells, sizes, _visits(reached, _boxes(cells)), width, k + 1)
    found = home.unionByName(other).withColumn("r", F.row_number().over(nearest_first)).filter(F.col("r") <= k + 1)
    by_row = Window.partitionBy("query").orderBy("score", "vec_id")
    listed = found.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(by_row)).filter(F.col("r") <= k + 1)
    answers = asked.join(listed, asked["key"] == listed["query"]).filter("vec_id <> query_id")
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _boxes(cells: DataFrame) -> list[tuple[int, list[float], list[float]]]:
    """The bounds of each cell's projections: one row a cell, of which the sample allows SAMPLE / 16."""
    sides = [f(F.col("p")[i]).alias(f"{n}{i}") for i in range(DIMS) for n, f in (("low", F.min), ("high", F.max))]
    return [(r.cell, [r[f"low{i}"] for i in range(DIMS)], [r[f"high{i}"] for i in range(DIMS)]) for r in cells.groupBy("cell").agg(*sides).collect()]


def _visits(reached: DataFrame, boxes: list[tuple[int, list[float], list[float]]]) -> DataFrame:
    """(query, qv, qp, bound, cell) for the cells other than its own that the chi-square test does not rule out."""
    limit = chi_square_quantile(CONFIDENCE, DIMS)

    def run(batches):
        names, low, high = np.array([b[0] for b in boxes], np.int32), np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes])
        for batch in small_batches(batches):
            p, own, bound = matrix(batch.column(2), DIMS), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            at, to = [], []
            for i in range(len(p)):
                go = names[(box_distance(p[i], low, high) <= limit * bound[i] ** 2) & (names != own[i])]
                at += [i] * len(go)
                to.append(go)
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(4), pa.array(np.concatenate([*to, np.empty(0, np.int32)]))], ["query", "qv", "qp", "bound", "cell"])

    return in_batches(reached, run, "query long, qv array<double>, qp array<double>, bound double, cell int")


def _meet(cells: DataFrame, sizes: dict[int, int], queries: DataFrame, width: int, k: int) -> DataFrame:
    """(query, key, ids, score): the k nearest entries of each part of the cell for each (query, cell). ``sizes``: entries by cell."""
    queries = stored(queries.select("query", "qv", "qp", "bound", "cell"), "visits")
    blocks = {r.cell: math.ceil(r["count"] / BLOCK) for r in queries.groupBy("cell").count().collect()}  # one row a cell
    schema = "query long, key long, ids array<long>, score double"
    if not blocks:
        return queries.sparkSession.createDataFrame([], schema)

    def of_cell(numbers: dict[int, int]):
        return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair)), F.col("cell")), F.lit(0))

    n, parts = of_cell(blocks), of_cell({c: math.ceil(size / PART) for c, size in sizes.items()})
    left = cells.withColumn("n", n).filter("n > 0").withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("cell", "part", "block", "key", "ids", "v", "p")
    right = queries.withColumn("block", F.pmod(F.xxhash64("query"), n).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    limit = chi_square_quantile(CONFIDENCE, DIMS)

    def run(entries: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query": [], "at": [], "score": []}
        if entries.num_rows and asked.num_rows:
            vectors, tree = matrix(entries.column("v"), width), Tree(matrix(entries.column("p"), DIMS))
            keys = entries.column("key").to_numpy()
            for q, v, p, bound in zip(asked.column("query").to_pylist(), matrix(asked.column("qv"), width), matrix(asked.column("qp"), DIMS), asked.column("bound").to_pylist(), strict=True):
                rows, dist = search(tree, vectors, keys, v, p, k, bound, limit)
                out["query"] += [q] * len(rows)
                out["at"] += rows.tolist()
                out["score"] += dist.tolist()
        part = entries.take(pa.array(out["at"], pa.int64()))
        return pa.table({"query": pa.array(out["query"], pa.int64()), "key": part.column("key"), "ids": part.column("ids"), "score": pa.array(out["score"], pa.float64())})

    by = ("cell", "part", "block")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)
