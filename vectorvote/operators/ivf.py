"""The inverted-file index: lists of references by their nearest centroid, with the lists' radii and places.

`centroids` has a row a cluster (their number is a parameter): cluster_id, c, size, radius, list_start, block_start.  `lists` has a row a
reference: ref_id, label, q, cluster_id, slot (place in its list), block and lane (of 8), and part, a run of PART rows of the
list.  Searches lay the lists out in cells, see operators.cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import BLOCK_LANES, DIMENSIONS, SCALE, TrainConfig
from ..functions.scalar import quantize_array
from ..sources import codec
from ..storage import kept
from . import kmeans
from .cells import Cells, arranged
from .order import numbered

PART = 4_096


@dataclass
class IvfIndex:
    centroids: DataFrame
    lists: DataFrame
    _matrix: tuple | None = None
    _cells: Cells | None = None

    def matrix(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cluster ids, quantised centroids and radii on the driver: k rows, read once."""
        if self._matrix is None:
            rows = self.centroids.orderBy("cluster_id").collect()
            c = np.array([r["c"] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, DIMENSIONS))
            self._matrix = np.array([r["cluster_id"] for r in rows], np.int64), c, np.array([r["radius"] for r in rows], np.float64)
        return self._matrix

    def cells(self) -> Cells:
        """The lists, laid out for searches when the first one asks."""
        if self._cells is None:
            self._cells = arranged(self.lists)
        return self._cells

    def save(self, path: str) -> None:
        self.centroids.write.parquet(f"{path}/centroids")
        self.lists.repartitionByRange("cluster_id", "slot").sortWithinPartitions("cluster_id", "slot").write.parquet(f"{path}/lists")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        return cls(spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/lists"))


def cluster_sizes(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_id and n for every cluster, empty ones too."""
    n = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return clusters.select("cluster_id").join(n, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"))


def list_offsets(sizes: DataFrame) -> DataFrame:
    """Adds list_start, and block_start in blocks of 8: exclusive running sums over the k clusters."""
    w = Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = F.ceil(F.col("n") / BLOCK_LANES).cast("bigint")
    return sizes.withColumn("blocks", blocks).select("cluster_id", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("list_start"), "blocks", F.coalesce(F.sum("blocks").over(w), F.lit(0)).alias("block_start"))


def radii(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.sqrt(F.max("d2")).alias("radius"))


def placed(assigned: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds slot, block and lane: each row's place in its list, by ref_id, and among the index's blocks of 8."""
    rows = numbered(assigned, "cluster_id", "ref_id")
    both = rows.join(offsets.select("cluster_id", "list_start", "block_start"), "cluster_id")
    slot = F.col("place") - F.col("list_start")
    return both.withColumn("slot", slot).withColumn("block", F.col("block_start") + F.expr(f"slot div {BLOCK_LANES}")).withColumn("lane", F.col("slot") % BLOCK_LANES).drop("place", "list_start", "block_start")


def padded_blocks(lists: DataFrame, offsets: DataFrame) -> DataFrame:
    """block, lane and ref_id, null in lanes that pad a list's last block."""
    lanes = offsets.where("blocks > 0").select(F.explode(F.sequence(F.col("block_start"), F.col("block_start") + F.col("blocks") - 1)).alias("block")).select("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BLOCK_LANES - 1).cast("bigint"))).alias("lane"))
    return lanes.join(lists.select("block", "lane", "ref_id"), ["block", "lane"], "left")


def clusters_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(centroids)], "cluster_id int, c array<int>")


def build(references: DataFrame, centroids: np.ndarray) -> IvfIndex:
    """Indexes references (ref_id, q, label) by quantised centroids."""
    clusters = clusters_table(references.sparkSession, centroids)
    if not len(centroids):
        none = references.limit(0).withColumns({"cluster_id": F.lit(0), "slot": F.lit(0).cast("bigint"), "block": F.lit(0).cast("bigint"), "lane": F.lit(0).cast("bigint"), "part": F.lit(0).cast("bigint")})
        return IvfIndex(clusters.withColumns({"n": F.lit(0).cast("bigint"), "list_start": F.lit(0).cast("bigint"), "blocks": F.lit(0).cast("bigint"), "block_start": F.lit(0).cast("bigint"), "radius": F.lit(0.0)}), none)
    assigned = kept(kmeans.assign(references.select("ref_id", "q", "label"), centroids.astype(np.float64), "q"), "assigned")
    offsets = list_offsets(cluster_sizes(assigned, clusters))
    table = clusters.join(offsets, "cluster_id").join(radii(assigned), "cluster_id", "left").withColumn("radius", F.coalesce("radius", F.lit(0.0)))
    lists = placed(assigned, offsets).drop("d2").withColumn("part", F.expr(f"slot div {PART}"))
    return IvfIndex(kept(table, "centroids"), kept(lists, "lists"))


def train_index(references: DataFrame, config: TrainConfig, scale: int = SCALE) -> IvfIndex:
    """From labelled vectors (ref_id, vector, label): trains on the vectors, quantises centroids and vectors, builds the lists."""
    model = kmeans.train(references, config)
    centroids = np.clip(np.trunc(model.centroids * scale + np.copysign(0.5, model.centroids)), -32_768, 32_767)
    return build(references.select("ref_id", quantize_array(F.col("vector"), scale).alias("q"), "label"), centroids)


def transposed(centroids: DataFrame) -> DataFrame:
    """dim, cluster_id and value, in that order: the dimension-major layout."""
    return centroids.select("cluster_id", F.posexplode("c").alias("dim", "value")).select("dim", "cluster_id", "value")


def export_binary(index: IvfIndex, path: str) -> int:
    """Writes the exchange format.  That format is one file, so this is for indexes that a machine can hold; returns its bytes."""
    _, c, r = index.matrix()
    rows = index.lists.select("cluster_id", "slot", "label", "q").orderBy("cluster_id", "slot").toPandas()
    label = np.where(rows["label"] == "fraud", codec.FRAUD_BYTE, codec.LEGIT_BYTE).astype(np.uint8)
    values = np.array(rows["q"].tolist(), "<i2").reshape(len(rows), c.shape[1])
    raw = codec.pack(c, r, rows["cluster_id"].to_numpy(np.int64), label, values)
    codec.publish_to(index.lists.sparkSession, raw, path)
    return len(raw)


def import_binary(spark: SparkSession, path: str, dims: int | None = DIMENSIONS) -> DataFrame:
    """ref_id (place in the file), cluster_id, label and q of the exchange format, decoded where Spark reads the file."""
    import pandas as pd

    def decode(frames):
        for frame in frames:
            for raw in frame["content"]:
                cluster, label, values = codec.unpack(bytes(raw), dims).rows()
                for a in range(0, len(cluster), 50_000):
                    part = slice(a, a + 50_000)
                    yield pd.DataFrame({"ref_id": np.arange(len(cluster))[part], "cluster_id": cluster[part], "label": np.where(label[part] == codec.FRAUD_BYTE, "fraud", "legit"), "q": list(values[part].astype(np.int32))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "ref_id bigint, cluster_id int, label string, q array<int>")
