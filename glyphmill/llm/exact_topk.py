"""Exact top-k neighbours by multi-resolution segment statistics.

A vector is cut into 1, 4, 16, ... segments; each keeps its mean and deviation. With segments of m
elements, sum(m * ((mean_x - mean_y)^2 + (dev_x - dev_y)^2)) is a lower bound of the squared distance
that only grows with the resolution. Bounds go from coarse to fine and the exact distance is computed
for what survives, so the result is that of a full search.

1. rows are sorted into cells of bounded size by a tree over the finest statistics, fitted on a bounded
   sample; every cell keeps the box of its rows' statistics at all resolutions;
2. a query searches its own cell first, which bounds its k-th distance;
3. blocks of queries meet blocks of boxes: a query goes on to a cell only where the distance of its
   statistics to the cell's box is within its bound, again from coarse to fine;
4. a cell's rows meet the queries that reached it, in chunks of bounded size, and each query goes
   through the resolutions once more, row by row;
5. the best rows of all cells are merged for each query.

The tree decides only where a row lies; the boxes are those of all rows of a cell, so that the result
doesn't depend on the sample.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import saved
from .vectors import PARTIAL, cells, clean_vectors, exact_best, is_query, matrix, merged, nearest_rows, partial_table

_QUERIES = 256  # queries that are compared at once
#: Rows that the tree is fitted on, and leaves that it may have; the leaves of a larger table are cut by a hash of the id.
TREE_ROWS, TREE_LEAVES = 65_536, 4096
#: Queries and boxes that meet in one task.
_QUERY_BLOCK, _BOX_BLOCK = 8192, 4096


def resolutions(dims: int) -> list[int]:
    """Numbers of segments, coarse to fine, each dividing the next so that the bounds are nested."""
    out = [1]
    while out[-1] * 8 <= dims:
        out.append(out[-1] * 4)
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled by the root of their length: squared distances of
    these rows are lower bounds of those of the vectors."""
    parts = [np.arange(x.shape[1])]
    while len(parts) < segments:  # nested cuts, also where the number of dimensions isn't a multiple
        parts = [p for whole in parts for p in np.array_split(whole, 4)]
    out = np.empty((len(x), 2 * len(parts)))
    for i, p in enumerate(parts):
        root = np.sqrt(len(p))
        out[:, 2 * i] = x[:, p].mean(axis=1) * root if len(p) else 0
        out[:, 2 * i + 1] = x[:, p].std(axis=1) * root if len(p) else 0
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def search(q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its k nearest rows with another id and a squared distance of at most `bound`."""
    out = []
    levels = [(statistics(q, s), statistics(x, s)) for s in resolutions(x.shape[1])] if len(x) else []
    scale = float((q * q).sum(1).max(initial=0) + (x * x).sum(1).max(initial=0))
    slack = 1e-12 * scale + 3e-9  # rounding of the expanded squares, and the width of a tie
    for a in range(0, len(q), _QUERIES):
        part = slice(a, a + _QUERIES)
        limit = bound[part, None] + slack
        columns = np.arange(len(x))
        alive = np.ones((len(q[part]), len(x)), dtype=bool)
        for fq, fx in levels:
            if alive.sum() * 20 < alive.size:
                break  # few survivors: their exact distances cost less than another resolution
            alive &= _squares(fq[part], fx[columns]) <= limit
            used = alive.any(axis=0)
            if used.mean() < 0.7:
                columns, alive = columns[used], alive[:, used]
        dense = alive.sum() * 20 >= alive.size
        approx = np.where(alive, _squares(q[part], x[columns]), np.inf) if dense and alive.size else None
        for i in range(len(alive)):
            at = columns[nearest_rows(approx[i], k + 1, slack)] if approx is not None else columns[alive[i]]
            at = at[x_ids[at] != q_ids[a + i]]
            best = exact_best(q[a + i], q_ids[a + i], x[at], x_ids[at], k)
            near = best[1] <= bound[a + i] + slack
            out.append((best[0][near], best[1][near]))
    return out


class Tree:
    """Halves a sample at the median of its widest statistic, again and again; a row goes down to a leaf."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, math.ceil(math.log2(max(1, min(leaves, len(sample))))))
        self.column = np.zeros(1 << self.depth, dtype=np.int64)
        self.edge = np.full(1 << self.depth, np.inf)
        if len(sample):
            self._fit(sample, 1)

    def _fit(self, part: np.ndarray, node: int) -> None:
        if node >= 1 << self.depth or len(part) < 2:
            return
        column = int(part.var(axis=0).argmax())
        edge = float(np.median(part[:, column]))
        low = part[:, column] <= edge
        self.column[node], self.edge[node] = column, edge
        self._fit(part[low], 2 * node)
        self._fit(part[~low], 2 * node + 1)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.column[node]] > self.edge[node])
        return node - (1 << self.depth)


def _box(x: np.ndarray) -> np.ndarray:
    """Least and largest statistics of the rows at every resolution, end to end."""
    f = np.concatenate([statistics(x, s) for s in resolutions(x.shape[1])], axis=1)
    return np.concatenate([f.min(axis=0), f.max(axis=0)])


def reached(q: np.ndarray, bound: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Which boxes (columns) lie within the bound of each query (row)."""
    half, at = boxes.shape[1] // 2, 0
    low, high = boxes[:, :half], boxes[:, half:]
    alive = np.ones((len(q), len(boxes)), dtype=bool)
    slack = 1e-9 * (1 + float((q * q).sum(1).max(initial=0)))
    for s in resolutions(q.shape[1]):
        f = statistics(q, s)
        l, h = low[:, at : at + f.shape[1]], high[:, at : at + f.shape[1]]
        at += f.shape[1]
        for i in range(len(q)):
            on = np.flatnonzero(alive[i])
            gap = np.maximum(np.maximum(l[on] - f[i], f[i] - h[on]), 0)
            alive[i, on] = (gap * gap).sum(axis=1) <= bound[i] + slack
    return alive


def top_k(table: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", cell_rows: int = 4096, query_every: int = 1) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest other ids of every id that query_every divides.

    Euclidean distance, rounded to 6 decimals. Squared distances that agree to 9 decimals tie, and
    the smaller id comes first. Left out, as queries and as neighbours: NULL ids or vectors, vectors
    with a NULL, NaN or infinite element, and those whose length isn't the table's most frequent one.
    Rows that repeat an id count once (the smallest vector). With fewer than k other ids a query has
    fewer rows; an empty table gives none. Columns other than the two are ignored.
    """
    if k < 1 or query_every < 1:
        raise ValueError("k and query_every must be at least 1")
    rows, total, dims = clean_vectors(table, id_column, vector_column)
    spark = table.sparkSession
    if not total:
        return merged(spark.createDataFrame([], PARTIAL), k)
    rows = saved(rows)
    fine = resolutions(dims)[-1]
    leaves = min(cells(total, cell_rows), TREE_LEAVES)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(TREE_ROWS).toArrow() if leaves > 1 else None
    tree = Tree(statistics(matrix(sample.column("v"), dims), fine) if sample else np.zeros((0, 2)), leaves)
    held = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                at = held.value.leaf(statistics(matrix(batch.column("v"), dims), fine))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["id", "v", "leaf"])

    placed = saved(rows.mapInArrow(place, "id bigint, v array<double>, leaf int"))
    # a leaf of too many rows is cut further by a hash of the id; there is one row for each leaf
    cuts = placed.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / F.lit(2.0 * cell_rows)).alias("cuts"))
    cell = F.concat_ws(".", "leaf", F.pmod(F.xxhash64("id"), F.col("cuts")))
    celled = saved(placed.join(F.broadcast(cuts), "leaf").select("id", "v", cell.alias("cell")))

    def own(t: pa.Table) -> pa.Table:
        """A row for each query, and one with NULL id that has the cell's box in v."""
        x, ids = matrix(t.column("v"), dims), t.column("id").to_numpy()
        mine = np.flatnonzero(is_query(ids, query_every))
        best = search(x[mine], ids[mine], np.full(len(mine), np.inf), x, ids, k)
        bound = [float(b[1][-1]) if len(b[1]) == k else math.inf for b in best]
        return pa.table({
            "id": pa.array([*ids[mine].tolist(), None], pa.int64()),
            "v": pa.array([*x[mine].tolist(), _box(x).tolist()], pa.list_(pa.float64())),
            "cell": pa.array([t.column("cell")[0].as_py()] * (len(mine) + 1)),
            "bound": pa.array([*bound, None], pa.float64()),
            "near": pa.array([*(b[0].tolist() for b in best), None], pa.list_(pa.int64())),
            "d2": pa.array([*(b[1].tolist() for b in best), None], pa.list_(pa.float64())),
        })

    first = saved(celled.groupBy("cell").applyInArrow(own, "id bigint, v array<double>, cell string, bound double, near array<bigint>, d2 array<double>"))
    queries, boxes = first.filter("id is not null"), first.filter("id is null").select("cell", F.col("v").alias("box"))
    found = queries.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("near", "d2")).alias("n")).select("query_id", F.col("n.near").alias("neighbor_id"), F.col("n.d2").alias("d2"))
    asked, spread = queries.count(), boxes.count()
    if not asked or spread == 1:
        return merged(found, k)

    def meet(q: pa.Table, b: pa.Table) -> pa.Table:
        home, cell = (np.array(t.column("cell").to_pylist(), dtype=object) for t in (q, b))
        alive = reached(matrix(q.column("v"), dims), q.column("bound").to_numpy(), matrix(b.column("box"), width)) & (home[:, None] != cell[None])
        i, j = np.nonzero(alive)
        return pa.table({"id": q.column("id").take(pa.array(i)), "to": pa.array(cell[j].tolist(), pa.string())})

    width = 4 * sum(resolutions(dims))

    q_blocks, b_blocks = cells(asked, _QUERY_BLOCK), cells(spread, _BOX_BLOCK)
    block = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q_side = queries.select("id", "v", "cell", "bound", block("id", q_blocks).alias("qb")).withColumn("bb", every(b_blocks))
    b_side = boxes.select("cell", "box", block("cell", b_blocks).alias("b_bb")).withColumn("b_qb", every(q_blocks))
    visits = saved(q_side.groupBy("qb", "bb").cogroup(b_side.groupBy("b_qb", "b_bb")).applyInArrow(meet, "id bigint, to string"))
    chunks = visits.groupBy("to").count().select("to", F.ceil(F.col("count") / F.lit(float(_QUERY_BLOCK))).cast("int").alias("chunks"))
    going = visits.join(chunks, "to").join(queries.select("id", "v", "bound"), "id").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).select("to", "chunk", "id", "v", "bound")
    there = celled.join(chunks, celled["cell"] == chunks["to"]).select(F.col("cell"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("for_chunk"), F.col("id").alias("other"), F.col("v").alias("w"))

    def compare(q: pa.Table, x: pa.Table) -> pa.Table:
        ids = q.column("id").to_numpy()
        best = search(matrix(q.column("v"), dims), ids, q.column("bound").to_numpy(), matrix(x.column("w"), dims), x.column("other").to_numpy(), k)
        return partial_table(ids.tolist(), best)

    others = going.groupBy("to", "chunk").cogroup(there.groupBy("cell", "for_chunk")).applyInArrow(compare, PARTIAL)
    return merged(found.unionByName(others), k)


def top_k_sql(k: int = 10, table: str = "embeddings", id_column: str = "vec_id", vector_column: str = "embedding", query_every: int = 1) -> str:
    """The same by brute force, for a table whose vectors are whole and of one length."""
    return (
        f"WITH v AS (SELECT {id_column} AS id, {vector_column}::DOUBLE[] AS v FROM {table}), "
        "p AS (SELECT a.id AS query_id, b.id AS neighbor_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 "
        f"FROM v a JOIN v b ON a.id <> b.id WHERE a.id % {query_every} = 0), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 9), neighbor_id) AS rank FROM p) "
        f"SELECT query_id, rank, neighbor_id, round(sqrt(d2), 6) AS distance FROM r WHERE rank <= {k}"
    )
