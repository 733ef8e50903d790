"""Benchmark decontamination with an FM-index per training shard.

A shard is an Arrow batch of documents.  Its words are mapped to the benchmark's vocabulary; maximal runs of such
words, long enough for the shortest window, become the shard's sequence (a word that no benchmark item has can't be part
of an occurrence).  The index over that sequence is a Burrows-Wheeler transform held in a wavelet matrix, with the suffix
positions sampled at every SAMPLE-th place.  All windows of the benchmark are searched backwards at once, one wavelet
rank a step; each occurrence is located by walking to the next sampled position.  Spans of occurrences are merged and
can be removed.

The benchmark is read in blocks of at most BLOCK_ITEMS items and about BLOCK_WORDS words (or one item), each broadcast by itself; the driver
and a Python worker hold one block at a time, whatever the benchmark's size, and the hits of all blocks are merged.  What the
broadcasts take on an executor's disk grows with the benchmark.  Documents are never shuffled.

Defined results: null or empty text has no words and no hits; null or empty item text has no window.  An item of
fewer than `size` words is one window.  Items of equal text are all listed.  Equal item_ids count once.  Repeated rows get
equal results.  With an empty benchmark nothing is hit; an empty table of documents gives an empty result.  A very long text is a
shard by itself, handled whole, with memory in proportion to its words.  Extra columns pass through `remove`.
Words are compared by a 64-bit hash of their lower-cased bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import ALNUM_WORDS, Words, as_table, flat, slices

SIZE = 10
SAMPLE = 8
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000


class Windows:
    """The distinct windows of one block of items, over a vocabulary of word hashes."""

    def __init__(self, items: list[tuple], size: int = SIZE):
        self.items = [i for i, _ in items]
        buf, offs = flat(pa.array([t or "" for _, t in items], pa.large_string()))
        words = Words(buf, offs, ALNUM_WORDS)
        h = words.hashes()
        self.vocab = np.unique(h)
        ids = np.searchsorted(self.vocab, h) + 2  # 0 ends the sequence, 1 parts runs
        found: dict[bytes, list[int]] = {}
        for k in range(len(items)):
            own = ids[words.first[k] : words.first[k + 1]].astype(np.int32)
            n = min(size, len(own))
            for at in range(len(own) - n + 1 if n else 0):
                owners = found.setdefault(own[at : at + n].tobytes(), [])
                if not owners or owners[-1] != k:
                    owners.append(k)
        self.length = np.array([len(w) // 4 for w in found], np.int64)
        self.words = np.zeros((len(found), size), np.int32)  # right-aligned
        for r, w in enumerate(found):
            self.words[r, size - len(w) // 4 :] = np.frombuffer(w, np.int32)
        self.shortest = int(self.length.min()) if found else 0
        self.owner_at = np.concatenate([[0], np.cumsum([len(v) for v in found.values()])]).astype(np.int64)
        self.owners = np.array([i for v in found.values() for i in v], np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; t ends with its only smallest symbol."""
    rank = t.astype(np.int64)
    n, step = len(t), 1
    order = np.argsort(rank, kind="stable")
    while True:
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(rank[order]) != 0)])
        if new.max() == n - 1:
            return order
        rank = new
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = rank * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        step *= 2


class WaveletMatrix:
    """access and rank over a sequence of small integers; every call works on whole arrays."""

    def __init__(self, t: np.ndarray):
        self.bits = max(1, int(t.max()).bit_length()) if len(t) else 1
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (t >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(t) - int(bit.sum()))
            t = np.concatenate([t[bit == 0], t[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros_like(at)
        for k, ones in enumerate(self.ones):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            at = np.where(bit == 1, self.zeros[k] + ones[at], at - ones[at])
            low = np.where(bit == 1, self.zeros[k] + ones[low], low - ones[low])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for k, ones in enumerate(self.ones):
            bit = ones[at + 1] - ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + ones[at], at - ones[at])
        return symbol


class FMIndex:
    def __init__(self, t: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(t)
        self.bwt = WaveletMatrix(t[order - 1].astype(np.int64))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=int(t.max()) + 1))])
        self.marked = order % sample == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.sampled = order[self.marked]
        self.n = len(t)

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.bwt.rank(symbol, at)

    def search(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the right-aligned patterns."""
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.n)
        live = np.arange(len(words))
        for k in range(words.shape[1]):
            live = live[(length[live] > k) & (low[live] < high[live])]
            symbol = words[live, words.shape[1] - 1 - k].astype(np.int64)
            inside = symbol < len(self.before) - 1
            low[live[~inside]] = high[live[~inside]] = 0
            live, symbol = live[inside], symbol[inside]
            low[live], high[live] = self._step(symbol, low[live]), self._step(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows."""
        out = np.empty(len(rows), np.int64)
        left, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.marked[rows]
            out[left[done]] = self.sampled[self.mark_rank[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            rows = self._step(self.bwt.access(rows), rows)
            steps += 1
        return out


class Shard:
    """The runs of benchmark words of one batch, as one sequence, with the place of each of its words in the batch."""

    def __init__(self, w: Windows):
        self.w, self.words, self.place, self.doc = w, [], [], []

    def add(self, h: np.ndarray, doc: np.ndarray, base: int) -> None:
        vocab = self.w.vocab
        if not len(h) or not self.w.shortest:
            return
        at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
        known = vocab[at] == h
        first = known.copy()
        first[1:] &= ~known[:-1] | (doc[1:] != doc[:-1])
        last = known.copy()
        last[:-1] &= ~known[1:] | (doc[1:] != doc[:-1])
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        long = end - start >= self.w.shortest
        start, end = start[long], end[long]
        if not len(start):
            return
        size = end - start
        flat_at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        cut = np.cumsum(size)  # a parting symbol after each run
        self.words.append(np.insert(at[flat_at] + 2, cut, 1))
        self.place.append(np.insert(flat_at + base, cut, -1))
        self.doc.append(np.insert(doc[flat_at], cut, -1))

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, document and window of every occurrence."""
        none = np.zeros(0, np.int64)
        if not self.words:
            return none, none, none
        t = np.concatenate([*self.words, [0]])
        index = FMIndex(t)
        low, high = index.search(self.w.words, self.w.length)
        n = high - low
        window = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at = index.locate(rows)
        return np.concatenate([*self.place, [-1]])[at], np.concatenate([*self.doc, [-1]])[at], window


def benchmark_blocks(benchmark: DataFrame, size: int = SIZE, block_items: int = BLOCK_ITEMS, block_words: int = BLOCK_WORDS) -> list:
    """Broadcasts of Windows, each of a bounded number of items and words; the driver holds one block at a time."""
    context = benchmark.sparkSession.sparkContext
    blocks, items, words = [], [], 0
    rows = benchmark.select("item_id", "text").dropDuplicates().orderBy("item_id", "text").toLocalIterator()
    for row in rows:
        n = len(row["text"] or "") // 2 + 1
        if items and (len(items) >= block_items or words + n > block_words):
            blocks.append(context.broadcast(Windows(items, size)))
            items, words = [], 0
        items.append((row["item_id"], row["text"]))
        words += n
    if items:
        blocks.append(context.broadcast(Windows(items, size)))
    return blocks


EMPTY = hashlib.sha256(b"").hexdigest()


_held: tuple[object, Windows | None] = (None, None)


def _windows(block) -> Windows:
    """A block's windows; a worker keeps those of the last block it used."""
    global _held
    if _held[0] is not block:
        _held = (None, None)
        path = getattr(block, "_path", None)  # loading by path doesn't keep the value beside the broadcast
        _held = (block, block.load_from_path(path) if path else block.value)
    return _held[1]


def _scan(batch: pa.RecordBatch, blocks: list):
    """Per document: words, and of those hit; the item_ids; and the merged byte spans of hit words, with the document of each."""
    n = batch.num_rows
    n_words, base, byte0, row0 = np.zeros(n, np.int64), 0, 0, 0
    starts, ends, parts = [], [], []
    for part in slices(batch, "text"):
        buf, offs = flat(part.column("text"))
        words = Words(buf, offs, ALNUM_WORDS)
        h = words.hashes()
        n_words[row0 : row0 + part.num_rows] = np.diff(words.first)
        parts.append((h, words.of() + row0, base))
        starts.append((words.start + byte0).astype(np.int64))
        ends.append((words.end + byte0).astype(np.int64))
        base, byte0, row0 = base + len(h), byte0 + len(buf), row0 + part.num_rows
    items: dict[int, set] = {}
    place, docs = [], []
    for block in blocks:
        w = _windows(block)
        shard = Shard(w)
        for h, doc, first in parts:
            shard.add(h, doc, first)
        at, doc, window = shard.hits()
        if not len(at):
            continue
        span = w.length[window]
        place.append(np.repeat(at - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum()))
        docs.append(np.repeat(doc, span))
        for pair in np.unique(doc * (len(w.length) + 1) + window):
            d, k = divmod(int(pair), len(w.length) + 1)
            own = items.setdefault(d, set())
            own.update(w.items[i] for i in w.owners[w.owner_at[k] : w.owner_at[k + 1]])
    n_hit = np.zeros(n, np.int64)
    spans = (np.zeros(0, np.int64),) * 3
    if place:
        at, first = np.unique(np.concatenate(place), return_index=True)
        doc = np.concatenate(docs)[first]
        n_hit = np.bincount(doc, minlength=n)
        opens = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc) != 0)]))
        closes = np.concatenate([opens[1:], [len(at)]]) - 1
        spans = (doc[opens], np.concatenate(starts)[at[opens]], np.concatenate(ends)[at[closes]])
    return n_words, n_hit, items, spans


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards: batches of at most 16 MB of text, or one document."""
    for batch in batches:
        yield from slices(batch, "text", 16 << 20)


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as text, sorted), spans (start and end in bytes of UTF-8), contaminated."""
    blocks = benchmark_blocks(benchmark, size, block_items)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("spans", span)])

    def run(batches):
        for batch in _batches(batches):
            n_words, n_hit, items, (doc, start, end) = _scan(batch, blocks)
            offs = flat(batch.column("text"))[1]
            named = [sorted(map(str, items.get(i, ()))) for i in range(batch.num_rows)]
            spans = [[] for _ in named]
            for d, s, e in zip(doc, start, end):
                spans[d].append({"start": int(s - offs[d]), "end": int(e - offs[d])})
            yield as_table(schema, doc_id=batch.column("doc_id"), n_words=n_words, n_hit=n_hit, n_items=[len(x) for x in named], items=named, spans=spans)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>").withColumn("contaminated", F.col("n_hit") > 0)


def remove(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents, all columns, without the spans that occur in the benchmark; documents of which no word is left go."""
    blocks = benchmark_blocks(benchmark, size)
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for batch in _batches(batches):
            n_words, n_hit, _, (doc, start, end) = _scan(batch, blocks)
            column = batch.column("text")
            if len(doc):
                offs = flat(column)[1]
                texts = column.to_pylist()
                for d in np.unique(doc):
                    raw, out, at = texts[d].encode(), [], 0
                    for s, e in zip(start[doc == d] - offs[d], end[doc == d] - offs[d]):
                        out.append(raw[at:s])
                        at = e
                    texts[d] = b"".join([*out, raw[at:]]).decode()
                column = pa.array(texts, pa.string())
            touched = pa.array(n_hit > 0)
            left = pa.array((n_hit == 0) | (n_hit < n_words))
            arrays = [column if x == "text" else batch.column(x) for x in names]
            yield pa.RecordBatch.from_arrays([*arrays, touched], names=[*names, "__touched"]).filter(left)

    out = docs.mapInArrow(run, fields + ", __touched boolean")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__touched"), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.drop("__touched")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Words, hits and benchmark items of every document; see the module for cases."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = report(docs, items)
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable] = {"op3_decontaminate": op3_decontaminate}
ORACLE = {
    "op3_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, w[p : p + least(len(w), 10) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM bw WHERE len(w) > 0)
), dg AS (
  SELECT doc_id, p, m, w[p : p + m - 1] AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM dw, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)
), hit AS (
  SELECT DISTINCT doc_id, p, dg.m, item_id FROM dg JOIN iw ON dg.g = iw.g
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM hit)) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1
)
SELECT dw.doc_id, coalesce(len(w), 0) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered c ON dw.doc_id = c.doc_id LEFT JOIN named n ON dw.doc_id = n.doc_id
"""
}
