"""k-means: seeding on a bounded sample, then rounds over all points.

A round is one pass: tasks assign their points to the broadcast centroids (k is a parameter) and send one partial sum a
cluster; the driver gets k sums.  Points whose nearest centroid changed are counted in the same pass, by assigning to the
centroids before, too, so no assignment is stored between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import ConfigError, TrainConfig
from ..functions.random import bounded, unit_floats
from .knn import CELLS, matrix
from .sampling import reservoir


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centroid, the first of equals, and the squared distance."""
    place, best = np.empty(len(points), np.int64), np.empty(len(points))
    step = max(1, CELLS // max(1, len(centroids)))
    half = (centroids * centroids).sum(1)
    for a in range(0, len(points), step):
        x = points[a : a + step]
        d = half[None, :] - 2 * (x @ centroids.T)
        place[a : a + step] = d.argmin(1)
        best[a : a + step] = np.maximum(d.min(1) + (x * x).sum(1), 0)
    return place, best


def plus_plus(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k seeds: the first uniform, each further one with a chance in proportion to its squared distance from the nearest seed."""
    n = len(sample)
    chosen = [int(bounded(seed, np.array([1]), np.array([n]))[0])]
    away = ((sample - sample[chosen[0]]) ** 2).sum(1)
    for number in range(2, k + 1):
        total = away.sum()
        if total > 0:
            target = float(unit_floats(seed, np.array([number]))[0]) * total
            at = min(int(np.searchsorted(np.cumsum(away), target, "right")), n - 1)
        else:
            at = int(bounded(seed, np.array([number]), np.array([n]))[0])
        chosen.append(at)
        away = np.minimum(away, ((sample - sample[at]) ** 2).sum(1))
    return sample[chosen].astype(np.float64)


def assign(points: DataFrame, centroids: np.ndarray, column: str = "vector") -> DataFrame:
    """Adds cluster_id and d2, the squared distance to its centroid, to each row."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, d = nearest(matrix(batch.column(column)), shared.value) if batch.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int32)), pa.array(d)], names=[*batch.schema.names, "cluster_id", "d2"])

    return points.mapInArrow(run, f"{ddl}, cluster_id int, d2 double")


def sums(points: DataFrame, centroids: np.ndarray, before: np.ndarray | None, column: str = "vector") -> DataFrame:
    """cluster_id, n, changed and s (sum of the cluster's vectors): one row a cluster that has points."""
    context = points.sparkSession.sparkContext
    shared = context.broadcast((centroids, before))
    dims = centroids.shape[1]
    schema = pa.schema([("cluster_id", pa.int32()), ("n", pa.int64()), ("changed", pa.int64()), ("s", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = shared.value
        n, changed, total = np.zeros(len(now), np.int64), np.zeros(len(now), np.int64), np.zeros((len(now), dims))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(column))
            place, _ = nearest(x, now)
            moved = np.ones(len(x), bool) if old is None else nearest(x, old)[0] != place
            n += np.bincount(place, minlength=len(now))
            changed += np.bincount(place[moved], minlength=len(now))
            np.add.at(total, place, x)
        live = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(n[live]), pa.array(changed[live]), pa.array(list(total[live]), pa.list_(pa.float64()))], schema=schema)

    parts = points.select(column).mapInArrow(run, "cluster_id int, n bigint, changed bigint, s array<double>")
    return parts.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.sum("changed").alias("changed"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dims)]).alias("s"))


def lloyd_step(points: DataFrame, centroids: np.ndarray, before: np.ndarray | None = None, column: str = "vector") -> tuple[np.ndarray, int]:
    """The next centroids (an empty cluster keeps its own) and how many points changed their cluster."""
    new, changed = centroids.copy(), 0
    for r in sums(points, centroids, before, column).collect():
        new[r["cluster_id"]] = np.array(r["s"]) / r["n"]
        changed += r["changed"]
    return new, changed


@dataclass
class KMeansModel:
    centroids: np.ndarray
    rounds: int
    changed: int


def train(points: DataFrame, config: TrainConfig, order: str = "ref_id", column: str = "vector") -> KMeansModel:
    """Fits on all rows; the seeds come from a reservoir of at most config.sample rows."""
    n = points.count()
    k = min(config.clusters, n)
    if config.require_enough and n < config.clusters:
        raise ConfigError(f"{n} vectors are fewer than {config.clusters} clusters")
    if not k:
        return KMeansModel(np.zeros((0, 0)), 0, 0)
    rows = reservoir(points.select(order, column), min(config.sample, n), config.seed, order).orderBy("slot").select(column).collect()
    sample = np.array([r[column] for r in rows], np.float64)
    centroids, before, changed, done = plus_plus(sample, k, config.seed), None, n, 0
    for done in range(1, config.rounds + 1):
        new, changed = lloyd_step(points, centroids, before, column)
        before, centroids = centroids, new
        if done > config.stop_from and changed <= max(n // 10_000, config.min_changes):
            break
    return KMeansModel(centroids, done, changed)
