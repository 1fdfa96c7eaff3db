"""Exact top-k search by a Voronoi kNN join on integer inner products.

1. A bounded, documented sample of vectors (smallest hash of the vector) gives the pivots: the square root of the
   number of rows, between ``min_pivots`` and ``max_pivots``, so that cells grow slower than the data. Every vector goes
   to the cell of its nearest pivot.
2. One summary row per cell (rows, largest distance to the pivot, largest norm) is all that the driver sees:
   as many rows as there are pivots.
3. For query q and cell with pivot p, radius R and norm N no inner product exceeds
   ``min(q.p + |q| R, |q| N, (|q|^2 + N^2 - max(0, |q - p| - R)^2) / 2)``.
   First each query is solved in its own best cells (those of highest bound that hold k other rows); its k-th score
   there is a floor. Then it is sent only to the further cells whose bound reaches the floor.
4. Cells are cut into blocks of about ``block_rows`` rows, and so are the queries of a cell (by hash of the row): a
   cell that holds a third of all rows is many tasks. A query meets each block of its cells once, locally, by a
   matrix product; the best k of each meeting are merged by a window per query.

Scores are exact: components are integers, products run in doubles below 2**53 and in Python integers beyond;
scores beyond 64 bits are set to the end of that range.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without id; a
query meets the vectors of its own dimension (no inner product is defined with others), and each dimension of the table
is searched by itself; an empty vector has the score 0 with other empty ones. Every row is a candidate of every query but
itself: rows that repeat an id are told apart by a number, so a repeated id can be found twice, and repeated query ids
are answered once for each of their rows. Ties go to the smaller vec_id; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

OUT = "query_id long, query_row long, vec_id long, score long"
_CELLS = 1 << 22  # numbers in a matrix of vectors by pivots


def _matrix(column) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _parts(batch: pa.RecordBatch, pivots: int):
    """The batch in parts whose distances to all pivots fit in memory."""
    size = max(1, _CELLS // max(1, pivots))
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, row (a number of its own), dim and v, the integer vector, of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("double"))
    rows = vectors.where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    # an empty vector is one zero: its inner products are the empty sum
    v = F.when(F.size("embedding") > 0, whole).otherwise(F.array(F.lit(0.0)))
    return stored(rows.select("vec_id", F.monotonically_increasing_id().alias("row"), F.size("embedding").alias("dim"), v.alias("v")), "vectors")


def _bounds(q: np.ndarray, pivots: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Upper bounds (queries x cells) of the inner product with any row of a cell."""
    length = np.linalg.norm(q, axis=1, keepdims=True)
    dots = q @ pivots.T
    away = np.sqrt(np.maximum(0, length**2 + (pivots**2).sum(1) - 2 * dots))
    by_distance = (length**2 + norm**2 - np.maximum(0, away - radius) ** 2) / 2
    return np.minimum(np.minimum(dots + length * radius, length * norm), by_distance) * (1 + 1e-9) + 1e-3


def top_k(vectors: DataFrame, is_query, k: int = 5, min_pivots: int = 128, max_pivots: int = 16384, block_rows: int = 8192, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row that meets the condition is_query."""
    spark = vectors.sparkSession
    rows = usable(vectors, scale)
    found = spark.createDataFrame([], OUT)
    for dim in rows.groupBy("dim").count().orderBy("dim").collect():  # one row per dimension in the table
        n_pivots = min(max_pivots, max(min_pivots, int(dim["count"] ** 0.5)))
        found = found.union(_search(rows.where(F.col("dim") == dim["dim"]).drop("dim"), is_query, k, n_pivots, block_rows))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(rows: DataFrame, is_query, k: int, n_pivots: int, block_rows: int) -> DataFrame:
    """The k best rows, at least, of each query among rows of one dimension: query_id, query_row, vec_id, score."""
    spark = rows.sparkSession
    pivots = np.array([r["v"] for r in rows.groupBy("v").agg(F.min("row").alias("row")).orderBy(F.xxhash64("v"), "row").limit(n_pivots).collect()], np.float64)
    shared = spark.sparkContext.broadcast(pivots)  # n_pivots vectors

    def place(batches):
        p = shared.value
        square_p = (p**2).sum(1)
        for whole in batches:
            for batch in _parts(whole, len(p)):
                x = _matrix(batch.column("v"))
                square = np.maximum(0, (x**2).sum(1)[:, None] + square_p - 2 * (x @ p.T))
                cell = square.argmin(1)
                far = np.sqrt(((x - p[cell]) ** 2).sum(1))
                new = [pa.array(cell, pa.int32()), pa.array(far, pa.float64()), pa.array(np.linalg.norm(x, axis=1), pa.float64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "row", "v")), *new], names=["vec_id", "row", "v", "cell", "far", "norm"])

    placed = stored(rows.select("vec_id", "row", "v").mapInArrow(place, "vec_id long, row long, v array<double>, cell int, far double, norm double"), "cells")
    measured = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("norm").alias("norm"))
    cells_table = stored(measured.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")), "cell-summary")
    summary = cells_table.orderBy("cell").collect()  # one row per pivot
    cells, count, blocks = (np.array([r[c] for r in summary]) for c in ("cell", "n", "blocks"))
    radius, norm = (np.array([r[c] for r in summary]) * (1 + 1e-9) + 1e-6 for c in ("radius", "norm"))
    data = placed.join(F.broadcast(cells_table.select("cell", "blocks")), "cell")  # n_pivots rows
    data = data.select("vec_id", "row", "v", "cell", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"))
    queries = stored(placed.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("v").alias("q")), "queries")

    def send(floors: bool):
        """Where each query goes: its best cells that hold k others, or the rest that its floor does not exclude."""

        def run(batches):
            p = shared.value[cells]
            for whole in batches:
                for batch in _parts(whole, len(p)):
                    bound = _bounds(_matrix(batch.column("q")), p, radius, norm)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    before = np.cumsum(count[order], axis=1) - count[order]
                    home = np.zeros(bound.shape, bool)
                    np.put_along_axis(home, order, before < k + 1, axis=1)
                    go = home
                    if floors:
                        go = ~home & (bound >= np.array(batch.column("floor").to_numpy(zero_copy_only=False), np.float64)[:, None])
                    i, c = np.nonzero(go)
                    own = [batch.column(name).take(pa.array(i)) for name in ("query_id", "query_row", "q")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(cells[c], pa.int32()), pa.array(blocks[c], pa.int32())], names=["query_id", "query_row", "q", "cell", "blocks"])

        return run

    def solve(sent: DataFrame) -> DataFrame:
        """The k best rows of each block for each query that is sent to it."""
        sent = stored(sent, "sent")
        parts = stored(sent.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")), "sent-parts")  # a row per pivot at most
        many = sent.join(F.broadcast(parts), "cell").select(
            "query_id", "query_row", "q", "cell", F.pmod(F.xxhash64("query_row"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        )
        rows_here = data.join(F.broadcast(parts), "cell").select("vec_id", "row", "v", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

        def meet(left, right):
            ids, own_rows, x = np.asarray(left.column("vec_id")), np.asarray(left.column("row")), _matrix(left.column("v").combine_chunks())
            for start in range(0, right.num_rows, 1024):
                part = right.slice(start, 1024)
                q = _matrix(part.column("q").combine_chunks())
                if np.abs(x).max() * np.abs(q).max() * x.shape[1] < 2**53:
                    s = (q @ x.T).astype(np.int64)
                else:
                    s = np.array([[sum(int(a) * int(b) for a, b in zip(u, w)) for w in x] for u in q], object).reshape(len(q), len(x))
                for i, (name, row) in enumerate(zip(np.asarray(part.column("query_id")), np.asarray(part.column("query_row")))):
                    able = np.flatnonzero(own_rows != row)
                    best = able[np.lexsort((ids[able], -s[i, able]))[:k]] if s.dtype == object or len(able) <= 4 * k else _best(s[i], ids, able, k)
                    yield name, row, ids[best], s[i, best]

        def cogroup(left, right):
            found = list(meet(left, right)) if left.num_rows and right.num_rows else []
            return pa.table(
                {
                    "query_id": pa.array([int(f[0]) for f in found for _ in f[2]], pa.int64()),
                    "query_row": pa.array([int(f[1]) for f in found for _ in f[2]], pa.int64()),
                    "vec_id": pa.array([int(i) for f in found for i in f[2]], pa.int64()),
                    "score": pa.array([min(max(int(v), -(2**63)), 2**63 - 1) for f in found for v in f[3]], pa.int64()),
                }
            )

        return rows_here.groupBy("cell", "block", "part").cogroup(many.groupBy("cell", "block", "part")).applyInArrow(cogroup, OUT)

    kinds = "query_id long, query_row long, q array<double>, cell int, blocks int"
    first = stored(solve(queries.mapInArrow(send(False), kinds)), "first")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_row", F.col("score").cast("double").alias("floor"))
    floored = queries.join(kth, "query_row", "left").select("query_id", "query_row", "q", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    return first.union(solve(floored.mapInArrow(send(True), kinds)))


def _best(s: np.ndarray, ids: np.ndarray, able: np.ndarray, k: int) -> np.ndarray:
    v = s[able]
    cut = np.partition(v, len(v) - k)[len(v) - k]
    near = able[v >= cut]
    return near[np.lexsort((ids[near], -s[near]))[:k]]
