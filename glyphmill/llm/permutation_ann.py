"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. It is posted in the inverted files of its
`prefix` nearest ones, with the weight prefix - position. Over a prefix, Spearman's footrule is
prefix * (prefix + 1) - 2 * sum(min(weight, weight)), so adding up the files of a query's own pivots
ranks the rows by footrule; a row that is in none of them has the largest distance there is.

Rows lie in cells by their nearest pivot, and every cell has its own inverted files. A directory holds
the largest weight of each file; a query goes to those cells only where the weights of its pivots'
files can add up to its radius. The directory has at most pivots^2 bytes, whatever the table.

Each query has a radius of its own: the footrule within which the share `rank share` of a bounded
sample lies. The sample is part of the table, so no query is left with fewer than k candidates, however
sparse its region is. The rank share is calibrated on the same sample so that `target` of the true
neighbours lie within it, apart for queries in dense and in sparse regions (by the distance of the
nearest pivot). There is no cap on candidates: all rows within the radius are reranked by exact distance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import saved
from .vectors import PARTIAL, cells, clean_vectors, exact_best, is_query, matrix, merged, nearest_rows, partial_table

#: Shares of the sample, by distance of the nearest pivot, below which a query counts to a stratum.
STRATA = (0.5, 0.75, 0.9, 0.95, 0.975)
#: Queries that meet a cell in one task.
_QUERY_BLOCK = 4096


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the prefix nearest pivots, nearest first; squared distance of the nearest) of each row."""
    out, nearest = np.zeros((len(x), prefix), dtype=np.int32), np.zeros(len(x))
    squares = (pivots * pivots).sum(1)[None]
    for a in range(0, len(x), 4096):
        part = x[a : a + 4096]
        d2 = squares - 2 * part @ pivots.T
        near = np.argpartition(d2, prefix - 1, axis=1)[:, :prefix]
        near.sort(axis=1)  # equal distances by the pivot's number
        order = np.argsort(np.take_along_axis(d2, near, 1), axis=1, kind="stable")
        out[a : a + 4096] = np.take_along_axis(near, order, 1)
        nearest[a : a + 4096] = d2.min(axis=1) + (part * part).sum(1)
    return out, nearest


class Files:
    """Inverted files of some rows: for each pivot the rows that hold it and their weights."""

    def __init__(self, perm: np.ndarray, pivots: int):
        n, self.prefix = perm.shape
        pivot = perm.ravel()
        order = np.argsort(pivot, kind="stable")
        self.rows, self.begin, self.size = (order // self.prefix).astype(np.int32), np.searchsorted(pivot[order], np.arange(pivots + 1)), n
        self.weights = (self.prefix - order % self.prefix).astype(np.int32)

    def largest(self) -> np.ndarray:
        """The largest weight of each file, 0 for an empty one."""
        out = np.zeros(len(self.begin) - 1, dtype=np.int32)
        held = np.flatnonzero(np.diff(self.begin))
        if len(held):
            out[held] = np.maximum.reduceat(self.weights, self.begin[held])
        return out

    def shared(self, perm: np.ndarray) -> np.ndarray:
        """Sum of the smaller weights over the pivots of a query, for each row."""
        total = np.zeros(self.size, dtype=np.int32)
        for position, pivot in enumerate(perm):
            a, b = self.begin[pivot], self.begin[pivot + 1]
            if a < b:  # a row is in a file once
                total[self.rows[a:b]] += np.minimum(self.weights[a:b], self.prefix - position)
        return total


class Index:
    """What the driver fits on the sample: pivots, the sample's files, and the rank share of each stratum."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, prefix: int, k: int, target: float, queries: int):
        self.pivots, self.prefix, self.k = pivots, min(prefix, len(pivots)), k
        perm, nearest = permutations(x, pivots, self.prefix)
        self.files = Files(perm, len(pivots))
        self.edges = np.quantile(nearest, STRATA)
        stratum = np.searchsorted(self.edges, nearest, side="left")
        self.share = np.ones(len(STRATA) + 1)
        squares = (x * x).sum(1)
        for s in range(len(self.share)):
            own = np.flatnonzero(stratum == s)
            own = own[np.linspace(0, len(own) - 1, min(len(own), math.ceil(queries / len(self.share)))).astype(int)] if len(own) else own
            needed = []
            for i in own:
                d2 = squares - 2 * x @ x[i]
                d2[i] = np.inf
                near = np.argsort(d2, kind="stable")[: min(k, len(x) - 1)]
                shared = self.files.shared(perm[i])
                needed += (np.searchsorted(np.sort(-shared), -shared[near], side="left") / len(x)).tolist()
            if needed:
                self.share[s] = np.sort(needed)[min(len(needed) - 1, int(target * len(needed)))]

    def radius(self, perm: np.ndarray, nearest: float) -> int:
        """Least shared weight of the query's candidates."""
        shared = self.files.shared(perm)
        rank = max(self.k, int(self.share[np.searchsorted(self.edges, nearest, side="left")] * len(shared)))
        return 0 if rank >= len(shared) else int(np.partition(shared, len(shared) - 1 - rank)[len(shared) - 1 - rank])


def neighbours(
    table: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", pivots: int = 512, prefix: int = 64, target: float = 0.98, sample_rows: int = 20_000, sample_queries: int = 600, cell_rows: int = 8192, query_every: int = 1
) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): up to k near other ids of every id that query_every divides.

    Pivots are the rows with the smallest hashes of their ids, a quarter of the table at most. Distances,
    ties, NULLs, broken vectors, repeated ids and fewer than k rows are treated as in exact_topk.top_k; an
    empty table gives none; columns other than the two are ignored. A query has k rows wherever the table
    has as many other ids. Every row is indexed; pivots, sample_rows and sample_queries bound only what
    the pivots and radii are fitted on.
    """
    if k < 1 or query_every < 1:
        raise ValueError("k and query_every must be at least 1")
    spark = table.sparkSession
    rows, total, dims = clean_vectors(table, id_column, vector_column)
    if not total:
        return merged(spark.createDataFrame([], PARTIAL), k)
    rows = saved(rows)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()  # bounded by a parameter
    x = matrix(sample.column("v"), dims)
    few = max(1, min(pivots, total // 4))
    chosen = np.unique(x, axis=0) if len(x) <= few else x[:few]
    index = Index(x, chosen, prefix, k, target, sample_queries)
    held = spark.sparkContext.broadcast(index)
    count = len(index.pivots)

    def post(batches):
        for batch in batches:
            if batch.num_rows:
                perm, _ = permutations(matrix(batch.column("v"), dims), held.value.pivots, held.value.prefix)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p.tobytes() for p in perm.astype("<i2")], pa.binary()), pa.array(perm[:, 0])], names=["id", "v", "perm", "home"])

    posted = saved(rows.mapInArrow(post, "id bigint, v array<double>, perm binary, home int"))
    # one row for each pivot at most; neighbouring small files are put together, large ones cut by a hash
    sizes = np.zeros(count, dtype=np.int64)
    for r in posted.groupBy("home").count().collect():
        sizes[r["home"]] = r["count"]
    group = np.floor(np.cumsum(np.append(0, sizes[:-1])) / cell_rows).astype(int)
    group = np.unique(group, return_inverse=True)[1]
    cuts = np.ceil(np.bincount(group, sizes) / (2.0 * cell_rows)).clip(1).astype(int)
    grouped = spark.sparkContext.broadcast((group, cuts))

    def decode(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype="<i2").reshape(-1, held.value.prefix).astype(np.int32)

    def directory(batches):
        most: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                perm, cell = decode(batch.column("perm")), grouped.value[0][np.asarray(batch.column("home"))]
                for g in np.unique(cell):
                    own = Files(perm[cell == g], count).largest()
                    most[int(g)] = np.maximum(most.get(int(g), 0), own)
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()), pa.array([m.astype("<i2").tobytes() for m in most.values()], pa.binary())], names=["cell", "most"])

    def widest(t: pa.Table) -> pa.Table:
        every = np.stack([np.frombuffer(m, dtype="<i2") for m in t.column("most").to_pylist()])
        return pa.table({"cell": t.column("cell").slice(0, 1), "most": pa.array([every.max(axis=0).tobytes()], pa.binary())})

    most = np.zeros((len(cuts), count), dtype=np.int32)  # at most pivots^2 entries
    for r in posted.mapInArrow(directory, "cell int, most binary").groupBy("cell").applyInArrow(widest, "cell int, most binary").collect():
        most[r.cell] = np.frombuffer(r.most, dtype="<i2")
    listed = spark.sparkContext.broadcast(most)

    def route(batches):
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            batch = batch.filter(pa.array(is_query(ids, query_every)))
            if not batch.num_rows:
                continue
            perm, nearest = permutations(matrix(batch.column("v"), dims), held.value.pivots, held.value.prefix)
            weight = held.value.prefix - np.arange(held.value.prefix)
            row, to, least = [], [], []
            for i in range(len(perm)):
                radius = held.value.radius(perm[i], nearest[i])
                go = np.flatnonzero(np.minimum(listed.value[:, perm[i]], weight).sum(axis=1) >= radius)
                row += [i] * len(go)
                to += go.tolist()
                least += [radius] * len(go)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), batch.column("perm").take(at), pa.array(least, pa.int32()), pa.array(to, pa.int32())], names=["id", "v", "perm", "least", "cell"])

    going = saved(posted.mapInArrow(route, "id bigint, v array<double>, perm binary, least int, cell int"))
    asked = np.zeros(len(cuts), dtype=np.int64)
    for r in going.groupBy("cell").count().collect():  # one row for each cell, as many as pivots at most
        asked[r["cell"]] = r["count"]
    chunks = np.ceil(asked / _QUERY_BLOCK).astype(int)
    # (cell, cut, chunk): each cut of a cell meets each chunk of the queries that go there
    by_cell = F.broadcast(spark.createDataFrame([(c, int(cuts[c]), int(chunks[c])) for c in range(len(cuts)) if chunks[c]], "at int, cuts int, chunks int"))
    by_home = F.broadcast(spark.createDataFrame([(p, int(g), int(cuts[g]), int(chunks[g])) for p, g in enumerate(group) if chunks[g]], "pivot int, x_cell int, cuts int, chunks int"))
    slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q_side = going.join(by_cell, F.col("cell") == F.col("at")).select("id", "v", "perm", "least", "cell", slot("chunks").alias("chunk"), upto("cuts").alias("cut"))
    x_side = posted.join(by_home, F.col("home") == F.col("pivot")).select("x_cell", slot("cuts").alias("x_cut"), upto("chunks").alias("x_chunk"), F.col("id").alias("other"), F.col("v").alias("w"), F.col("perm").alias("x_perm"))

    def compare(q: pa.Table, x: pa.Table) -> pa.Table:
        qv, xv = matrix(q.column("v"), dims), matrix(x.column("w"), dims)
        q_ids, x_ids, least = q.column("id").to_numpy(), x.column("other").to_numpy(), q.column("least").to_numpy()
        files = Files(decode(x.column("x_perm")), count)
        squares = (xv * xv).sum(1)
        best = []
        for i, perm in enumerate(decode(q.column("perm"))):
            at = np.flatnonzero(files.shared(perm) >= least[i])
            at = at[x_ids[at] != q_ids[i]]
            if len(at) > 4 * k:
                at = at[nearest_rows(squares[at] - 2 * (xv[at] @ qv[i]), k, 3e-9 + 1e-12 * float(squares.max()))]
            best.append(exact_best(qv[i], q_ids[i], xv[at], x_ids[at], k))
        return partial_table(q_ids.tolist(), best)

    partial = q_side.groupBy("cell", "cut", "chunk").cogroup(x_side.groupBy("x_cell", "x_cut", "x_chunk")).applyInArrow(compare, PARTIAL)
    return merged(partial, k)
