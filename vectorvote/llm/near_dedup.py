"""Near-duplicates by an LSH forest of MinHash signatures, confirmed on full shingle sets.

1. Each text becomes the set of its distinct shingles of `words` words (64-bit hashes), a 128-bit identity of that set, and a
   signature of TREES x DEPTH one-byte minima.  Texts with equal sets are one node from here on.
2. Tree t orders all nodes by the DEPTH bytes of its part of the signature.  Each order is range-partitioned and sorted by
   Spark, ties by node, so a region of any size is spread over tasks.  Candidates are the neighbours with the longest common
   prefix: in a region (nodes that share MIN_DEPTH bytes) of up to REGION nodes every pair is one; in a larger region the
   depth adapts: each node meets its NEAR next nodes, which share the deepest prefixes, and all nodes of its subregion that
   is small enough.  What parts neighbours at the ends of partitions is made good by a second pass over those ends.
3. Rows of the orders carry a sketch, two bits of each minimum.  Neighbours whose sketches agree in clearly too few places (more
   than 4 standard deviations below the threshold) are no candidates.
4. Links are confirmed on full sets, from the whole texts, in two passes over the orders: first of each node its most similar
   neighbour in each order; then all neighbours that still are in different components.  Pairs inside a component can't change
   the result and aren't compared.

5. Regions of over REGION nodes that still hold several components are settled exactly, whatever their size: their nodes' shingles
   are ordered by how common they are, and nodes that share one of their rarest shingles, as all pairs above the threshold do, are
   compared unless their sizes and the shingles' places rule it out.  So the limits of step 2 lose no link.

A node's name is the place of its first document in the order of doc_id, so a component's least node names its smallest doc_id.
Components come from local contraction (see `components`).  No link, set or component is collected on the driver.

Defined results: words are split at ASCII white space, A-Z lower-cased.  Null, empty or wordless text has an empty set, however many there are: it is
linked with nothing, and is its own component.  With fewer than `words` words the whole sequence is the one shingle.
Repeated rows have equal sets, so they are linked.  A component's id is its smallest doc_id; nulls are passed over, unless
all are null.  A very long text is handled whole; its signature needs memory in proportion to its words.  An empty table gives an
empty result; extra columns pass through `keep_first`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import components, hot_least, spread_join
from .shared import kept
from .text import BLANK_WORDS, U64, Words, as_table, flat, mix, slices, windows

TREES, DEPTH, MIN_DEPTH = 16, 8, 4
REGION, NEAR = 16, 15
#: Rows at the ends of partitions that one task pairs, about.
END_ROWS = 200_000
_rng = np.random.default_rng(20240229)
_FLIP = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)[:, None]
_FACTOR = (_rng.integers(0, 1 << 62, TREES * DEPTH, dtype=np.uint64) * U64(2) + U64(1))[:, None]


def signature(s: np.ndarray) -> np.ndarray:
    """One byte for each hash function: of its minimum over the set, the low bits of a mix."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, U64)
    for at in range(0, len(s), 2048):
        least = np.minimum(least, ((s[None, at : at + 2048] ^ _FLIP) * _FACTOR).min(1))
    return (mix(least) & U64(255)).astype(np.uint8)


def identity(s: np.ndarray) -> bytes:
    """128 bits that tell a set from others."""
    with np.errstate(over="ignore"):
        return np.array([mix(s).sum(dtype=U64), mix(s ^ U64(0xA5A5A5A5DEADBEEF)).sum(dtype=U64) + U64(len(s))], ">u8").tobytes()


def sets(buf: np.ndarray, offs: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    w = Words(buf, offs, BLANK_WORDS)
    h = w.hashes()
    grams = windows(h, words)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            yield windows(h[a:b], b - a) ^ U64(b - a)
        else:
            yield h[:0]


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, node (identity of the set; null if empty) and sig."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n, node, sig = [], [], []
                for s in sets(*flat(batch.column("text")), words):
                    n.append(len(s))
                    node.append(identity(s) if len(s) else None)
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield as_table(schema, doc_id=batch.column("doc_id"), th=batch.column("th"), n_shingles=n, node=node, sig=sig)

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id bigint, th bigint, n_shingles bigint, node binary, sig binary")


def neighbours(label: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate places (i, j), i < j, in one sorted order of labels; `fresh` marks where another tree begins."""
    n, tree = len(label), np.cumsum(fresh)
    here, reach = np.arange(n), None
    open_ = np.ones(n, dtype=bool)  # not yet in a region that is small enough
    for depth in range(MIN_DEPTH, DEPTH + 1):
        top = label >> U64(8 * (DEPTH - depth))
        new = np.concatenate([[True], (top[1:] != top[:-1]) | (tree[1:] != tree[:-1])])
        region = np.cumsum(new) - 1
        left = np.concatenate([np.flatnonzero(new)[1:], [n]])[region] - here
        if reach is None:
            reach = np.minimum(left, NEAR + 1)
        small = open_ & (np.bincount(region)[region] <= REGION)
        reach[small] = np.maximum(reach, left)[small]
        open_ &= ~small
    pairs = [(i, i + step) for step in range(1, REGION) for i in [np.flatnonzero(reach > step)]]
    return np.concatenate([i for i, _ in pairs]), np.concatenate([j for _, j in pairs])


#: 128 fields of two bits, as unsigned integers.
SKETCH = TREES * DEPTH // 4
_LOW_BITS = U64(0x5555555555555555)


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each byte of signatures (a row each), packed."""
    two = (sig & np.uint8(3)).reshape(len(sig), -1, 4)
    return (two[..., 0] | two[..., 1] << 2 | two[..., 2] << 4 | two[..., 3] << 6).astype(np.uint8)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The similarity that sketches (rows of SKETCH bytes) suggest: a quarter of the fields agree by chance."""
    differ = np.ascontiguousarray(x).view(U64) ^ np.ascontiguousarray(y).view(U64)
    fields = np.bitwise_count((differ | differ >> U64(1)) & _LOW_BITS).sum(1, dtype=np.int64)
    return (1 - fields / (SKETCH * 4) - 0.25) / 0.75


def floor_of(threshold: float) -> float:
    """4 standard deviations of an estimate below the threshold."""
    p = 0.25 + 0.75 * threshold
    return threshold - 4 * (p * (1 - p) / (SKETCH * 4)) ** 0.5 / 0.75


_ROW = "tree int, label bigint, node binary, sketch binary, root binary"


def _label_rows(nodes: DataFrame) -> DataFrame:
    """(tree, label, node, sketch, root): the labels of every node in all trees, as signed numbers of the same order."""
    schema = pa.schema([("tree", pa.int32()), ("label", pa.int64()), ("node", pa.binary()), ("sketch", pa.binary()), ("root", pa.binary())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                raw = b"".join(batch.column("sig").to_pylist())
                label = (np.frombuffer(raw, ">u8").reshape(batch.num_rows, TREES).astype(U64) ^ U64(1 << 63)).view(np.int64)
                sketch = pa.array([x.tobytes() for x in sketches(np.frombuffer(raw, np.uint8).reshape(batch.num_rows, -1))], pa.binary())
                rows = pa.array(np.repeat(np.arange(len(label)), TREES))
                yield as_table(schema, tree=np.tile(np.arange(TREES, dtype=np.int32), len(label)), label=label.ravel(), node=batch.column("node").take(rows), sketch=sketch.take(rows), root=batch.column("root").take(rows))

    return nodes.select("node", "sig", "root").mapInArrow(run, _ROW)


_CAND = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("est", pa.float64()), ("tree", pa.int32()), ("label", pa.int64()), ("sketch", pa.binary()), ("root", pa.binary())])
_CAND_DDL = "a binary, b binary, est double, tree int, label bigint, sketch binary, root binary"


def _ends(rows: pa.RecordBatch) -> pa.RecordBatch:
    n = rows.num_rows
    return as_table(_CAND, a=rows.column("node"), b=pa.nulls(n, pa.binary()), est=pa.nulls(n, pa.float64()), tree=rows.column("tree"), label=rows.column("label"), sketch=rows.column("sketch"), root=rows.column("root"))


def _pairs_of(part: pa.RecordBatch, old: int, floor: float, best: bool) -> pa.RecordBatch:
    """Candidates of sorted rows that have different roots, of which the first `old` were paired among themselves before; with
    `best`, of each row the most similar one."""
    tree, label = part.column("tree").to_numpy(), part.column("label").to_numpy()
    i, j = neighbours(label.view(U64) ^ U64(1 << 63), np.concatenate([[False], np.diff(tree) != 0]))
    root = np.frombuffer(b"".join(part.column("root").to_pylist()), ">u8").reshape(len(label), 2)
    sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(len(label), SKETCH)
    good = (j >= old) & (root[i] != root[j]).any(1)
    i, j = i[good], j[good]
    est = estimate(sketch[i], sketch[j])
    good = est >= floor
    if best:
        end, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
        order = np.lexsort((pair, -np.where(good, est, -1)[pair], end))
        first = order[np.concatenate([[True], np.diff(end[order]) != 0])] if len(order) else order
        good &= np.isin(np.arange(len(i)), pair[first])
    i, j, n = i[good], j[good], int(good.sum())
    node = part.column("node")
    none = {c: pa.nulls(n, _CAND.field(c).type) for c in ("tree", "label", "sketch", "root")}
    return as_table(_CAND, a=node.take(pa.array(i)), b=node.take(pa.array(j)), est=est[good], **none)


def _pair_rows(floor: float, best: bool):
    """Pairs of a sorted partition; and, with b null, the rows near its ends, where neighbours are elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fresh = batch.slice(at, 20_000)
                part = fresh if held is None else pa.Table.from_batches([held, fresh]).combine_chunks().to_batches()[0]
                yield _pairs_of(part, part.num_rows - fresh.num_rows, floor, best)
                if head < REGION:
                    first = fresh.slice(0, REGION - head)
                    head += first.num_rows
                    yield _ends(first)
                held = part.slice(max(0, part.num_rows - REGION))
        if held is not None:
            yield _ends(held)

    return run


def candidates(nodes: DataFrame, threshold: float, best: bool) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes (node, sig, root) of different roots that are neighbours in an order and may be
    similar enough; with `best`, of each node the most similar one in each order."""
    order, pair = ("tree", "label", "node"), _pair_rows(floor_of(threshold), best)
    rows, parts, found = _label_rows(nodes).repartitionByRange(*order), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), []
    while True:  # the rows near the ends of partitions meet in an order of their own, until that is one partition
        got = kept(rows.sortWithinPartitions(*order).mapInArrow(pair, _CAND_DDL), "neighbours")
        found.append(got.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        if parts == 1:
            break
        ends = got.where("b is null").select("tree", "label", F.col("a").alias("node"), "sketch", "root").distinct()
        parts = -(-parts * 2 * REGION // END_ROWS)
        rows = ends.repartition(1) if parts == 1 else ends.repartitionByRange(parts, *order)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.where("a <> b").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        last, kept_set = None, None
        for whole in batches:
            for batch in slices(whole, "tb"):
                a, ta = batch.column("a"), batch.column("ta")
                good = np.zeros(batch.num_rows, dtype=bool)
                for i, sb in enumerate(sets(*flat(batch.column("tb")), words)):
                    if (name := a[i].as_py()) != last:
                        last, kept_set = name, next(sets(*flat(ta.slice(i, 1)), words))
                    both = len(np.intersect1d(kept_set, sb, assume_unique=True))
                    good[i] = 100 * both >= percent * (len(kept_set) + len(sb) - both)
                yield as_table(schema, a=a, b=batch.column("b")).filter(pa.array(good))

    a, b = (texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def _first() -> Column:
    """The smallest (doc_id, th) of a group's rows, a null doc_id last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")


_SIGN = -(1 << 63)


def _key() -> Column:
    """16 bytes in the order of `first`: whether doc_id is null, doc_id, and what th has in its upper 56 bits."""
    wide = lambda x: F.lpad(F.hex(x), 16, "0")
    number = wide(F.coalesce("first.doc_id", F.lit(0)).bitwiseXOR(F.lit(_SIGN)))
    return F.unhex(F.concat(F.when(F.col("first.none"), "01").otherwise("00"), number, F.substring(wide(F.col("first.th")), 1, 14)))


def _doc_id(key: str) -> Column:
    """The doc_id of a key; null if that has none."""
    number = F.conv(F.hex(F.substring(key, 2, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(_SIGN))
    return F.when(F.hex(F.substring(key, 1, 1)) == "00", number)


def _texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents, all columns, with the columns of rows (id, th, ...) of equal doc_id and text; repeated rows once."""
    both = docs.withColumn("__th", F.xxhash64("text")).join(rows.withColumnsRenamed({"id": "__id", "th": "__rth"}), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__rth")))
    return both.dropDuplicates(["__id", "__rth"]).drop("__id", "__rth", "__th")


#: Counters of how common shingles are; shingles that share one only make the order less apt.
COUNTERS = 1 << 16


def _crowded(nodes: DataFrame) -> DataFrame:
    """The nodes (node, sig, root) that share MIN_DEPTH bytes of an order with more than REGION - 1 others, not all of one root."""
    rows = _label_rows(nodes).select("tree", F.shiftright("label", 8 * (DEPTH - MIN_DEPTH)).alias("top"), "node", "root")
    region = rows.groupBy("tree", "top").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most"))
    return rows.join(region.where((F.col("n") > REGION) & (F.col("least") < F.col("most"))), ["tree", "top"]).select("node", "root").distinct()


def _rare_pairs(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of texts (node, root, text) of different roots: all that reach the threshold, and few others."""

    def count(batches):
        for whole in batches:
            n = np.zeros(COUNTERS, np.int64)
            for batch in slices(whole, "text"):
                for s in sets(*flat(batch.column("text")), words):
                    n += np.bincount((s % U64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["slot", "n"])

    counted = texts.select("text").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    common = np.zeros(COUNTERS, np.int64)
    common[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    common = texts.sparkSession.sparkContext.broadcast(common)
    schema = pa.schema([("g", pa.int64()), ("node", pa.binary()), ("root", pa.binary()), ("n", pa.int64()), ("place", pa.int64())])

    def rarest(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                grams, size, place, row = [], [], [], []
                for k, s in enumerate(sets(*flat(batch.column("text")), words)):
                    n = len(s)
                    first = n + percent * n // -100 + 1
                    order = np.lexsort((s, common.value[(s % U64(COUNTERS)).astype(np.int64)]))[:first]
                    grams.append(s[order].view(np.int64))
                    size.append(np.full(first, n))
                    place.append(np.arange(first))
                    row.append(np.full(first, k))
                rows = pa.array(np.concatenate(row))
                yield as_table(schema, g=np.concatenate(grams), node=batch.column("node").take(rows), root=batch.column("root").take(rows), n=np.concatenate(size), place=np.concatenate(place))

    rare = kept(texts.select("node", "root", "text").mapInArrow(rarest, "g bigint, node binary, root binary, n bigint, place bigint"), "rare")
    x, y = (rare.select("g", *(F.col(c).alias(c + k) for c in ("node", "root", "n", "place"))) for k in "xy")
    # of the smaller set the places that a shared shingle has at the latest
    y = y.where(f"placey <= ny - ceil(2 * {percent} * ny / {100 + percent})")
    larger = (F.col("nx") > F.col("ny")) | (F.col("nx") == F.col("ny")) & (F.col("nodex") > F.col("nodey"))
    enough = F.expr(f"least(nx - placex, ny - placey) * {100 + percent} >= {percent} * (nx + ny)")
    pairs = x.join(y, "g").where(larger & enough & (F.col("rootx") != F.col("rooty")))
    return pairs.select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct()


def _texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, one text for each."""
    owners = nodes.join(wanted, "node").select("node", F.col("first.doc_id").alias("id"), F.col("first.th").alias("th"))
    return kept(_texts(docs.select("doc_id", "text"), owners).select("node", "text"), "texts")


def _linked(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) for the nodes of confirmed links.

    First each node's most similar neighbour in each order is confirmed, which makes most components whole.  Then all
    neighbours that still are in different components; and then all pairs of the regions that were too large.
    """
    roots = None
    for step in ("best", "all", "crowded"):
        if roots is None:
            named = nodes.withColumn("root", F.col("node"))
        else:
            named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if step == "crowded":
            crowded = kept(_crowded(named), "crowded")
            if crowded.isEmpty():
                break
            texts = _texts_of(docs, nodes, crowded.select("node"))
            pairs = kept(_rare_pairs(texts.join(crowded, "node"), words, percent), "candidates")
            if pairs.isEmpty():
                break
        else:
            pairs = kept(candidates(named, percent / 100, step == "best"), "candidates")
            texts = _texts_of(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        links = kept(confirmed(pairs, texts, words, percent), "links")
        if step == "crowded" and links.isEmpty():
            break
        edges = links if roots is None else links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = kept(components(edges), "roots")
    return roots


def _clustered(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signatures, and the distinct sets: ident, node (a key by their first document), copies and root, the least node of the component."""
    signed = kept(signatures(docs, words).withColumnRenamed("node", "ident"), "signatures")
    groups = signed.where("ident is not null").groupBy("ident").agg(_first(), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    nodes = kept(groups.withColumn("node", _key()), "nodes")
    final = _linked(docs, nodes, words, percent)
    return signed, nodes.drop("sig").join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))


def cluster(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, th, n_shingles and component_id, a row for each document."""
    signed, named = _clustered(docs, words, percent)
    named = kept(named.select("ident", "copies", "root"), "named")
    rows = signed.where("ident is not null").select("doc_id", "th", "n_shingles", "ident")
    # back to the documents; the documents of a set of very many copies meet it in several tasks
    found = spread_join(rows, named.drop("copies"), "ident", "doc_id", hot_least(signed.count()), named.select("ident", F.col("copies").alias("n")))
    out = found.select("doc_id", "th", "n_shingles", _doc_id("root").alias("component_id"))
    return out.union(signed.where("ident is null").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns: of each component the row of its smallest doc_id, and those with empty sets; repeated rows once."""
    signed, named = _clustered(docs, words, percent)
    first = named.where("root = node").select(F.col("first.doc_id").alias("id"), F.col("first.th").alias("th"))
    single = signed.where("ident is null").select(F.col("doc_id").alias("id"), "th").distinct()
    return _texts(docs, first.union(single)).select(*docs.columns)


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.8 or more; see the module for cases."""
    found = cluster(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES: dict[str, Callable] = {"op4_near_dedup": op4_near_dedup}
ORACLE = {
    "op4_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[p : p + 3] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n, hash(list(g ORDER BY g)) AS h FROM s GROUP BY doc_id
), c AS (
  SELECT h, n, min(doc_id) AS doc_id FROM n GROUP BY h, n
), i AS (
  SELECT hash(g) AS g, doc_id, n FROM s JOIN c USING (doc_id)
), e AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM i x JOIN i y ON x.g = y.g AND x.doc_id <> y.doc_id AND 10 * x.n >= 8 * y.n AND 10 * y.n >= 8 * x.n
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), m AS (
  SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.m, d.doc_id) AS component_id, coalesce(m.m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON n.h = c.h AND n.n = c.n LEFT JOIN m ON c.doc_id = m.doc_id
"""
}
