"""Distances and exact nearest neighbours of a stated set of queries.

Queries are read in blocks of bounded size and broadcast, one block after another; every reference row is compared with a block
where it lies, in batches, by one matrix product.  Each task keeps the k nearest so far and sends those, so what is shuffled
is k rows for each query and task, whatever the number of references.  Quantised values are integers below 2**16, so products and sums
in double precision are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Queries in a block.
QUERY_BLOCK = 4_096
#: Distances that a kernel holds at once, about.
CELLS = 4_000_000


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, exact for integers of up to 16 bits."""
    return np.rint((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries (query_id, q), in blocks; the driver holds one block at a time."""
    ids, rows = [], []
    for r in queries.select("query_id", "q").toLocalIterator():
        ids.append(r["query_id"])
        rows.append(r["q"])
        if len(ids) == size:
            yield np.array(ids, np.int64), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64)


def distances(references: DataFrame, queries: DataFrame, within: int | None = None) -> DataFrame:
    """query_id, ref_id and d for every query and reference; beyond `within`, d is null.  For small stated sets of queries."""
    schema = pa.schema([("query_id", pa.int64()), ("ref_id", pa.int64()), ("d", pa.int64())])
    context, out = references.sparkSession.sparkContext, None
    for block in query_blocks(queries):
        shared = context.broadcast(block)

        def run(batches, shared=shared):
            ids, x = shared.value
            step = max(1, CELLS // len(ids))
            for whole in batches:
                for batch in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
                    d = squared_distances(x, matrix(batch.column("q")))
                    values = pa.array(d.ravel(), mask=None if within is None else d.ravel() > within)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, batch.num_rows)), pa.array(np.tile(batch.column("ref_id").to_numpy(), len(ids))), values], schema=schema)

        part = references.select("ref_id", "q").mapInArrow(run, "query_id bigint, ref_id bigint, d bigint")
        out = part if out is None else out.union(part)
    return references.sparkSession.createDataFrame([], "query_id bigint, ref_id bigint, d bigint") if out is None else out


def smallest(query: np.ndarray, d: np.ndarray, ref: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k smallest by (d, ref)."""
    order = np.lexsort((ref, d, query))
    q = query[order]
    new = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


def near_places(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all entries that are no farther than the row's k-th smallest."""
    if d.shape[1] > k:
        return np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
    return np.nonzero(np.ones(d.shape, dtype=bool))


NEIGHBOURS = "query_id bigint, ref_id bigint, d bigint, label string"
NEIGHBOURS_SCHEMA = pa.schema([("query_id", pa.int64()), ("ref_id", pa.int64()), ("d", pa.int64()), ("label", pa.string())])


def nearest_in_tasks(references: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each task, the k nearest of its references (ref_id, q, label) to each query."""
    context, out = references.sparkSession.sparkContext, None
    for block in query_blocks(queries):
        shared = context.broadcast(block)

        def run(batches, shared=shared):
            ids, x = shared.value
            step = max(k, CELLS // len(ids))
            best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)]
            for whole in batches:
                for batch in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
                    d = squared_distances(x, matrix(batch.column("q")))
                    i, j = near_places(d, k)
                    labels = np.array(batch.column("label").to_pylist(), object)
                    every = [np.concatenate(p) for p in zip(best, (i, d[i, j], batch.column("ref_id").to_numpy()[j], labels[j]))]
                    at = smallest(*every[:3], k)
                    best = [a[at] for a in every]
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[2]), pa.array(best[1]), pa.array(best[3], pa.string())], schema=NEIGHBOURS_SCHEMA)

        part = references.select("ref_id", "q", "label").mapInArrow(run, NEIGHBOURS)
        out = part if out is None else out.union(part)
    return references.sparkSession.createDataFrame([], NEIGHBOURS) if out is None else out


def top_k(candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query by (d, ref_id), with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "ref_id"))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_exact(references: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, ref_id, d and label of the k nearest references of each query."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return top_k(nearest_in_tasks(references, queries, k), k).select("query_id", "rank", "ref_id", "d", "label")


def kth_distance(neighbours: DataFrame, k: int) -> DataFrame:
    """query_id and worst: the k-th distance, null while fewer than k were found."""
    return neighbours.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("d")).alias("worst"))
