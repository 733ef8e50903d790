"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are scaled to length 1, turned into CURVES random orthonormal projections of DIMS dimensions, each with a random shift, and
ordered along a Hilbert curve in each.  Every order is range-partitioned and sorted by Spark; a vector's place in it comes
from the partitions' counts.  A query is compared with all vectors whose place is within HALF of the rows before or behind
its own, in each order, on the original vectors in double precision; what the windows find is merged and ranked again.

The window is a share of the rows, not a number: on vectors without structure a smaller share loses recall in
proportion, whatever the curve.  Rows of equal vectors are one point of the orders, with the k + 1 smallest of their ids, which
is all that a ranking can use, so a vector that a third of the rows share costs no more than any other.  Nothing is fitted.
Windows are cut into tiles of TILE places; a tile holds at most TILE candidates, so no task's group grows with the data.

Defined results: null vectors, zero vectors, and vectors with a null or non-finite component take no part, nor do rows with a null
vec_id; vectors of different lengths aren't compared.  Repeated rows (equal vec_id and vector) count once.  A candidate with the
query's own vec_id is left out.  Equal scores go to the smaller vec_id.  With fewer than k candidates all are returned; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import kept
from .text import as_table

CURVES, DIMS, BITS = 20, 8, 6
HALF = 0.03
TILE = 8192
SEED = 11


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each cell (a row of integers below 2**bits) along the Hilbert curve, by Gray-code transforms of whole columns."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & below)
            x[0] = x[0] ^ np.where(set_, below, swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where(x[-1] & (1 << level), flip ^ ((1 << level) - 1), flip)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | (((v ^ flip) >> level) & 1)
    return key


def frames(size: int, curves: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The projection and the shift of each curve; the same for a given size everywhere."""
    r = np.random.default_rng(SEED)
    dims = min(DIMS, size)
    return [(np.linalg.qr(r.normal(size=(size, dims)))[0], r.uniform(0, 1, dims)) for _ in range(curves)]


def keys(unit: np.ndarray, projection: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Hilbert keys of unit vectors; the cube spans the spread that projections of unit vectors have, shifted by up to a cell's part of it."""
    dims = projection.shape[1]
    spread = min(1.0, 6 / np.sqrt(len(projection)))
    cells = ((unit @ projection) / spread + 1 + shift / 4) / 2.25 * (1 << BITS)
    return hilbert(np.clip(cells.astype(np.int64), 0, (1 << BITS) - 1).reshape(-1, dims), BITS)


def usable(embedding: Column) -> Column:
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embedding.isNotNull() & whole & F.exists(embedding, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 5, curves: int = CURVES, half: float = HALF) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row of (vec_id, embedding) for which is_query holds."""
    wide = vectors.select("embedding").schema["embedding"].dataType.elementType.typeName() == "double"
    number = np.float64 if wide else np.float32
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast(f"array<{'double' if wide else 'float'}>").alias("embedding"), is_query.alias("q"))
    rows = rows.withColumn("h", F.xxhash64("embedding"))
    # equal vectors: the k + 1 smallest ids; a limit by rank is applied before the shuffle, too
    near = F.row_number().over(Window.partitionBy("h", "embedding").orderBy("vec_id"))
    few = rows.select("vec_id", "embedding", "h").distinct().withColumn("n", near).where(F.col("n") <= k + 1)
    asked = rows.where("q").select("h", "embedding").distinct().withColumn("q", F.lit(True))
    points = few.groupBy("h", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("lead", F.element_at("ids", 1))
    points = kept(points.join(asked, ["h", "embedding"], "left").withColumn("q", F.coalesce("q", F.lit(False))), "points")

    schema = pa.schema([("size", pa.int32()), ("curve", pa.int32()), ("key", pa.int64()), ("h", pa.int64()), ("lead", pa.int64()), ("q", pa.bool_()), ("v", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 1024) for a in range(0, whole.num_rows, 1024)):
                column = batch.column("embedding")
                size = np.asarray(column.value_lengths())
                for n in np.unique(size):
                    own = batch.filter(pa.array(size == n))
                    m = np.asarray(own.column("embedding").flatten(), number).reshape(-1, n)
                    unit = m.astype(np.float64)
                    unit /= np.abs(unit).max(1)[:, None]  # very large or small components don't overflow
                    unit /= np.linalg.norm(unit, axis=1)[:, None]
                    raw = pa.array([x.tobytes() for x in m], pa.binary())
                    for c, (projection, shift) in enumerate(frames(int(n), curves)):
                        yield as_table(schema, size=np.full(len(m), n), curve=np.full(len(m), c), key=keys(unit, projection, shift), h=own.column("h"), lead=own.column("lead"), q=own.column("q"), v=raw)

    ddl = "size int, curve int, key bigint, h bigint, lead bigint, q boolean, v binary"
    order = ("size", "curve", "key", "h", "lead")
    sorted_rows = points.select("h", "lead", "q", "embedding").mapInArrow(place, ddl).repartitionByRange(*order).sortWithinPartitions(*order)

    def number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            tag = list(zip(batch.column("size").to_pylist(), batch.column("curve").to_pylist()))
            index = np.empty(len(tag), np.int64)
            for i, x in enumerate(tag):
                at, last = (at + 1, last) if x == last else (0, x)
                index[i] = at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(tag), part, np.int32)), pa.array(index)], names=[*batch.schema.names, "part", "at"])

    ranked = kept(sorted_rows.mapInArrow(number_rows, ddl + ", part int, at bigint"), "curves")
    counts = ranked.groupBy("size", "curve", "part").agg(F.count("*").alias("n"))
    one = Window.partitionBy("size", "curve")
    offsets = counts.select("size", "curve", "part", (F.sum("n").over(one.orderBy("part")) - F.col("n")).alias("base"), F.ceil(F.sum("n").over(one) * half).alias("w"))
    placed = ranked.join(offsets, ["size", "curve", "part"]).withColumn("pos", F.col("base") + F.col("at")).drop("part", "at", "key", "base")
    tile = lambda c: F.floor(c / TILE)
    candidates = placed.withColumn("tile", tile(F.col("pos"))).withColumn("asks", F.lit(False))
    queries = placed.where("q").withColumn("tile", F.explode(F.sequence(tile(F.greatest(F.col("pos") - F.col("w"), F.lit(0))), tile(F.col("pos") + F.col("w"))))).withColumn("asks", F.lit(True))
    both = candidates.unionByName(queries).select("size", "curve", "tile", "asks", "pos", "w", "h", "lead", "v")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        ask, cand = group[asks], group[~asks]
        if not len(ask) or not len(cand):
            return pd.DataFrame({c: [] for c in ("qh", "ql", "h", "lead", "score")})
        x, y = (np.frombuffer(b"".join(g["v"]), number).reshape(len(g), -1).astype(np.float64) for g in (ask, cand))
        x, y = (m / np.abs(m).max(1)[:, None] for m in (x, y))
        nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        out = []
        for a in range(0, len(x), 256):
            score = (x[a : a + 256] / nx[a : a + 256, None]) @ (y / ny[:, None]).T
            far = np.abs(ask["pos"].to_numpy()[a : a + 256, None] - cand["pos"].to_numpy()[None, :]) > ask["w"].to_numpy()[a : a + 256, None]
            score[far] = -9
            # a few more than needed: the exact score, below, breaks near-ties; then equal scores by the smaller id
            take = min(len(y), k + 4)
            best = np.argpartition(-score, take - 1, axis=1)[:, :take]
            i = np.repeat(np.arange(len(score)), take)
            j = best.ravel()
            good = score[i, j] > -9
            i, j = i[good] + a, j[good]
            exact = (x[i] * y[j]).sum(1) / (nx[i] * ny[j])
            out.append(pd.DataFrame({"qh": ask["h"].to_numpy()[i], "ql": ask["lead"].to_numpy()[i], "h": cand["h"].to_numpy()[j], "lead": cand["lead"].to_numpy()[j], "score": exact}))
        return pd.concat(out)

    found = both.groupBy("size", "curve", "tile").applyInPandas(compare, "qh bigint, ql bigint, h bigint, lead bigint, score double")
    merged = found.groupBy("qh", "ql", "h", "lead").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("qh", "ql").orderBy(F.desc("score"), "lead"))
    best = merged.withColumn("n", rank).where(F.col("n") <= k + 1)
    named = best.join(points.select("h", "lead", "ids"), ["h", "lead"]).select("qh", "ql", "score", F.explode("ids").alias("vec_id"))
    lists = named.groupBy("qh", "ql").agg(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("d"), "vec_id"))).alias("found"))
    asks = rows.where("q").select(F.col("vec_id").alias("query_id"), "h", "embedding").distinct().join(points.select("h", "embedding", "lead"), ["h", "embedding"]).select("query_id", F.col("h").alias("qh"), F.col("lead").alias("ql"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    each = asks.join(lists, ["qh", "ql"]).select("query_id", F.posexplode(others).alias("n", "x"))
    return each.select("query_id", (F.col("n") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.d")).alias("score"))


def op8_hilbert_knn(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every vector whose vec_id is divisible by 50, against all vectors; see the module for cases."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable] = {"op8_hilbert_knn": op8_hilbert_knn}
