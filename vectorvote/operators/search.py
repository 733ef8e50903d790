"""Searches of an index: a fast probe, a second one for undecided queries, and an exact search by the lists' radii.

Queries rank the broadcast centroids where they lie.  They are then broadcast in blocks, and meet the cells of their lists that can hold a
neighbour (operators.cells): lists aren't shuffled, and neither a long list nor a popular one makes a task grow.  Each task sends its k nearest only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import SearchConfig
from ..storage import kept
from .cells import BLOCK, nearest_in_tasks
from .ivf import IvfIndex
from .knn import matrix, squared_distances, top_k

#: Queries that are broadcast at once.
QUERY_SLICE = BLOCK


def probes(index: IvfIndex, queries: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """query_id, q, cluster_id, d, radius and rank: each query's lists of rank `first`..`last` by (distance to centroid, cluster_id)."""
    ids, centroids, radius = index.matrix()
    shared = queries.sparkSession.sparkContext.broadcast((ids, centroids, radius))
    last = len(ids) if last is None else min(last, len(ids))
    schema = pa.schema([("query_id", pa.int64()), ("q", pa.list_(pa.int32())), ("cluster_id", pa.int32()), ("d", pa.int64()), ("radius", pa.float64()), ("rank", pa.int32())])

    def run(batches):
        ids, centroids, radius = shared.value
        for whole in batches:
            for batch in (whole.slice(a, 2_000) for a in range(0, whole.num_rows, 2_000)):
                if last < first:
                    continue
                d = squared_distances(matrix(batch.column("q")), centroids)
                order = np.argsort(d, axis=1, kind="stable")[:, first - 1 : last]
                n = order.shape[1]
                row, at = np.repeat(np.arange(batch.num_rows), n), order.ravel()
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(take), batch.column("q").take(take), pa.array(ids[at].astype(np.int32)), pa.array(d[row, at]), pa.array(radius[at]), pa.array(np.tile(np.arange(first, first + n, dtype=np.int32), batch.num_rows))], schema=schema)

    return queries.select("query_id", F.col("q").cast("array<int>").alias("q")).mapInArrow(run, "query_id bigint, q array<int>, cluster_id int, d bigint, radius double, rank int")


def scan(index: IvfIndex, wanted: DataFrame, k: int) -> DataFrame:
    """Those of each probe's list that can be among the k nearest of a query's lists.  wanted: query_id, q, cluster_id; and worst, if the table has it:
    a distance beyond which nothing is wanted, or null."""
    worst = [F.max("worst").alias("worst")] if "worst" in wanted.columns else []
    asked = wanted.groupBy("query_id").agg(F.first("q").alias("q"), F.collect_list("cluster_id").alias("clusters"), *worst)
    return nearest_in_tasks(index.cells(), asked, k, QUERY_SLICE)


def knn_ivf(index: IvfIndex, queries: DataFrame, config: SearchConfig = SearchConfig(), adaptive: bool = True) -> DataFrame:
    """query_id, rank, ref_id, d and label: the nearest of the fast lists; undecided queries see the further lists, too."""
    k, clusters = config.k, len(index.matrix()[0])
    queries = kept(queries.select("query_id", "q"), "queries")
    fast, full = config.fast(clusters), config.full(clusters)
    first = top_k(scan(index, probes(index, queries, 1, fast), k), k)
    if not adaptive or full <= fast:
        return first.select("query_id", "rank", "ref_id", "d", "label")
    first = kept(first, "first")
    state = _state(first, k)
    vote = F.coalesce(F.col("votes"), F.lit(0)).isin(*config.undecided())
    more = vote | (F.coalesce(F.col("found"), F.lit(0)) < k) if config.probe_until_k else vote
    undecided = queries.join(state, "query_id", "left").where(more).select("query_id", "q", "worst")
    further = probes(index, undecided.select("query_id", "q"), fast + 1, full).join(undecided.select("query_id", "worst"), "query_id")
    second = scan(index, further.where(may_hold(config.compat_bound)), k)
    return top_k(first.drop("rank").union(second), k).select("query_id", "rank", "ref_id", "d", "label")


def _state(neighbours: DataFrame, k: int) -> DataFrame:
    return neighbours.groupBy("query_id").agg(F.count("*").alias("found"), F.count_if(F.col("label") == "fraud").alias("votes"), F.when(F.count("*") >= k, F.max("d")).alias("worst"))


def may_hold(compat: bool = False):
    """Whether a list can hold a neighbour that is no farther than `worst`.

    A member is at least (distance to the centroid - radius) away, and 0 if the query lies in the ball.  With compat the
    difference is squared as it is, which passes over balls that hold the query.  A hair of slack keeps equalities in.
    """
    gap = F.sqrt(F.col("d").cast("double")) - F.col("radius")
    bound = gap * gap if compat else F.pow(F.greatest(gap, F.lit(0.0)), 2)
    return F.col("worst").isNull() | (bound * (1 - 1e-9) - 1e-6 <= F.col("worst"))


def knn_bound_exact(index: IvfIndex, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Exact nearest neighbours: after the fast lists, all lists whose ball may hold a nearer one."""
    queries = kept(queries.select("query_id", "q"), "queries")
    k, fast = config.k, config.fast(len(index.matrix()[0]))
    first = kept(top_k(scan(index, probes(index, queries, 1, fast), k), k), "first")
    left = probes(index, queries, fast + 1).join(_state(first, k).select("query_id", "worst"), "query_id", "left")
    second = scan(index, left.where(may_hold()), k)
    return top_k(first.drop("rank").union(second), k).select("query_id", "rank", "ref_id", "d", "label")
