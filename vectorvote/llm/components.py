"""Connected components of a large graph: local contraction, least roots and jumps.

Edges point from a node to a smaller one.  A task contracts its edges, EDGES at a time, to stars: each node to the least one it
reaches in them.  The number of tasks follows the number of edges, so a graph of up to EDGES edges is one contraction.  In a larger
one, rounds follow: nodes that several stars hold keep the least root and link the other roots to it (one shuffle, sorted, streamed),
and then every node jumps to its root's root (a join in which a root of very many nodes is spread over tasks).  The driver sees
one yes or no a round; the edges of a round are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .shared import kept

EDGES = 500_000
#: A key is hot that more than one in HOT_SHARE rows have (and over HOT_LEAST); there are fewer than HOT_SHARE such keys.
HOT_SHARE, HOT_LEAST = 1000, 500


def hot_least(rows: int) -> int:
    return max(HOT_LEAST, rows // HOT_SHARE)


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, least: int, hot: DataFrame | None = None) -> DataFrame:
    """left, joined (left outer) with right, which has one row a key.  Keys of more than `least` rows are dealt to as many tasks as they have
    `least` rows, by a hash of the column `by`.  `hot`: those keys with their number of rows, n; found here if not given."""
    if hot is None:
        hot = left.groupBy(key).agg(F.count("*").alias("n"))
    hot = F.broadcast(hot.where(F.col("n") > least).select(key, F.expr(f"cast(n div {least} + 1 as int)").alias("__salts")))
    one = F.lit(1)
    salted = left.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__salts", one)).cast("int")).drop("__salts")
    dealt = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", one) - 1))).drop("__salts")
    return salted.join(dealt, [key, "__salt"], "left").drop("__salt")


def stars(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(node, least node it reaches) for every node of the edges that isn't itself the least."""
    names = pa.concat_arrays([a, b]).dictionary_encode()
    order = pc.sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[names.indices.to_numpy()]
    x, y, root = place[: len(a)], place[len(a) :], np.arange(len(order))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(root)))
    return names.dictionary.take(pa.array(order[moved])), names.dictionary.take(pa.array(order[root[moved]]))


def _contract(edges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            a, b = stars(*(rows.column(c).combine_chunks() if isinstance(rows.column(c), pa.ChunkedArray) else rows.column(c) for c in "ab"))
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for whole in batches:
            for batch in (whole.slice(at, edges) for at in range(0, whole.num_rows, edges)):
                if n + batch.num_rows > edges:
                    yield out()
                    held, n = [], 0
                held.append(batch)
                n += batch.num_rows
        if n:
            yield out()

    return run


def _least_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) sorted: of each a the first goes on; each other root b is linked to the first one, and is `loose`."""
    node = root = None
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        out_a, out_b, loose = [], [], []
        for x, y in zip(a, b):
            if x != node:
                node, root, before = x, y, None
                out_a.append(x), out_b.append(y), loose.append(False)
            elif y != root and y != before:
                out_a.append(y), out_b.append(root), loose.append(True)
                before = y
        yield pa.RecordBatch.from_arrays([pa.array(out_a, batch.schema.field("a").type), pa.array(out_b, batch.schema.field("b").type), pa.array(loose, pa.bool_())], names=["a", "b", "loose"])


def components(edges: DataFrame, rounds: int = 60, task_edges: int = EDGES) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node that can be reached."""
    kind = edges.schema["a"].dataType.simpleString()
    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    for _ in range(rounds):
        n = now.count()
        tasks = -(-n // task_edges)
        contracted = now.coalesce(max(1, tasks)).mapInArrow(_contract(task_edges), f"a {kind}, b {kind}")
        if tasks <= 1:
            now = kept(contracted, "stars")
            break
        ranked = contracted.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_least_roots, f"a {kind}, b {kind}, loose boolean")
        now = kept(ranked, "stars")
        up = now.where("not loose").select(F.col("a").alias("b"), F.col("b").alias("up"))
        jumped = spread_join(now, up, "b", "a", hot_least(n)).select("a", F.coalesce("up", "b").alias("b"), (F.col("loose") | F.col("up").isNotNull()).alias("open"))
        jumped = kept(jumped, "jumps")
        now = jumped.select("a", "b")
        if jumped.where("open").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
