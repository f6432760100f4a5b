"""What the two vector searches share: clean input, cells of bounded size, exact distances, merging."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import only

#: Squared distances that agree to this many decimals are a tie, which the smaller id wins.
DECIMALS = 9
PARTIAL = "query_id bigint, neighbor_id bigint, d2 double"


def clean_vectors(table: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int, int]:
    """(id, v) with one row for each id, how many rows, and the number of dimensions.

    Left out: a NULL id or vector, an element that is NULL, NaN or infinite, and vectors whose length
    isn't the most frequent one (of equally frequent ones the shorter). Of rows that repeat an id the
    smallest vector stands for it.
    """
    rows = only(table, id_column, vector_column).toDF("id", "v").select(F.col("id").cast("bigint"), F.col("v").cast("array<double>"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad)
    top = rows.groupBy(F.size("v").alias("n")).agg(F.countDistinct("id").alias("c")).orderBy(F.desc("c"), "n").first()
    if top is None:
        return rows.groupBy("id").agg(F.min("v").alias("v")), 0, 0
    return rows.filter(F.size("v") == top.n).groupBy("id").agg(F.min("v").alias("v")), top.c, top.n


def is_query(ids: np.ndarray, every: int) -> np.ndarray:
    """The stated query set: ids that `every` divides, all of them where it is 1."""
    return ids % every == 0


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) for c in chunks]
    return np.concatenate(parts) if parts else np.zeros((0, dims))


def square_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise, as a plain sum of squares, so that equal vectors have distance 0."""
    return ((q - x) ** 2).sum(axis=-1)


def nearest_rows(approx: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Positions of the k smallest values and of whatever lies within `slack` of the k-th, so that
    rounding can't decide a tie."""
    finite = np.flatnonzero(np.isfinite(approx))
    if len(finite) > k:
        bound = np.partition(approx[finite], k - 1)[k - 1] + slack
        finite = finite[approx[finite] <= bound]
    return finite


def exact_best(q: np.ndarray, query_id: int, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the k nearest rows, by rounded distance and then id."""
    d2 = square_distances(x, q)
    keep = np.lexsort((ids, np.round(d2, DECIMALS)))[:k]
    return ids[keep], d2[keep]


def partial_table(queries: list[int], best: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    sizes = [len(b[0]) for b in best]
    none = np.zeros(0)
    return pa.table({
        "query_id": pa.array(np.repeat(np.asarray(queries, dtype=np.int64), sizes)),
        "neighbor_id": pa.array(np.concatenate([b[0] for b in best] or [none]).astype(np.int64)),
        "d2": pa.array(np.concatenate([b[1] for b in best] or [none]).astype(np.float64)),
    })


def merged(partial: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k best of each query over all cells."""
    order = Window.partitionBy("query_id").orderBy(F.round("d2", DECIMALS), "neighbor_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbor_id", F.round(F.sqrt("d2"), 6).alias("distance"))


def cells(total: int, cell_rows: int) -> int:
    return max(1, math.ceil(total / cell_rows))
