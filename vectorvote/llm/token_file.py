"""Token ids as static range-ANS files.

Documents are ordered by doc_id, encoded, and written in sections of about SECTION ids.  A section has one frequency table, which
its blocks share, and blocks of about BLOCK ids; a block holds whole documents and can be decoded alone.  In a block
LANES coders are interleaved, symbol i going to lane i % LANES, so each step codes a row of symbols at once.  Every CHECK_STEPS steps
the lanes' states and the place in the stream are kept as a checkpoint, from which decoding can begin, and a block ends
with the CRC-32 of its ids.

Files: Parquet as the container, written by Spark's commit protocol to the shared folder, a row for each section: `part` and
`section` in doc_id order, `n_tokens`, `doc_ids` and `sizes` (ids of each document), `symbols` and `weights` (the table), `blocks`
(binary).  A block is little-endian: magic, ids, lanes, steps between checkpoints, words, checkpoints, CRC-32 (7 unsigned 32-bit
integers); the final states (64 bits a lane); each checkpoint's place (32 bits) and states; the stream of 32-bit words.

Tokens: a text is cut at ASCII white space, which no token of this vocabulary crosses; distinct chunks are encoded once.  Added tokens
in a text are what the library makes of them.

Defined results: null text counts as empty and has just the end id; a null doc_id sorts first; rows of equal doc_id
are ordered by a hash of the text, then any way (their rows are equal).  An empty table gives empty files and
no rows.  A very long text is a block of its own, in memory in proportion to its ids.  Extra columns are ignored.  A damaged block raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .pieces import Cache
from .shared import scratch
from .text import BLANK_WORDS, LOWER, U64, Words, as_table, flat, slices

VOCABULARY = "word_bpe_49k.json"
END = 2
PRECISION = 20
LANES = 2048
CHECK_STEPS = 64
BLOCK, SECTION = 1 << 18, 1 << 21
#: Chunks that the library encodes in one line.
LINE = 200
MAGIC = 0x31534E52
_HEAD = struct.Struct("<7I")
_LOW = 1 << 31


def weights(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies that sum to 2**precision, at least 1 each, close to the counts in proportion."""
    total, size = int(counts.sum()), 1 << precision
    w = np.maximum(1, counts.astype(np.int64) * (size - len(counts)) // total)
    rest = size - int(w.sum())
    w[int(np.argmax(counts))] += rest  # not negative: floors and a unit for each symbol stay below the size
    return w


class Table:
    def __init__(self, symbols: np.ndarray, weight: np.ndarray, precision: int = PRECISION):
        self.symbols, self.precision = np.asarray(symbols, np.int64), precision
        self.weight = np.asarray(weight, U64)
        self.start = np.concatenate([[0], np.cumsum(weight)[:-1]]).astype(U64)
        self.slot: np.ndarray | None = None
        self.place = np.zeros(int(self.symbols.max()) + 1, np.int32)
        self.place[self.symbols] = np.arange(len(self.symbols))

    def slots(self) -> np.ndarray:
        if self.slot is None:
            self.slot = np.repeat(np.arange(len(self.weight), dtype=np.int32), self.weight.astype(np.int64))
        return self.slot


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, check: int = CHECK_STEPS) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n))
    index = table.place[ids]
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW, U64)
    words, checkpoints, written = [], [], 0
    shift, bits = U64(32), U64(table.precision)
    top = U64((_LOW >> table.precision) << 32)
    for step in range(steps - 1, -1, -1):
        own = index[step * lanes : (step + 1) * lanes]
        w, x = table.weight[own], state[: len(own)]
        full = x >= top * w
        if full.any():
            words.append((x[full] & U64(0xFFFFFFFF)).astype("<u4"))
            written += len(words[-1])
            x = np.where(full, x >> shift, x)
        q = x // w
        state[: len(own)] = (q << bits) + (x - q * w) + table.start[own]
        if step and step % check == 0:
            checkpoints.append((written, state.astype("<u8").tobytes()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    marks = b"".join(struct.pack("<I", written - w) + s for w, s in reversed(checkpoints))
    head = _HEAD.pack(MAGIC, n, lanes, check, len(stream), len(checkpoints), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
    return head + state.astype("<u8").tobytes() + marks + stream.tobytes()


def decode_block(data: bytes, table: Table, checkpoint: int = 0) -> np.ndarray:
    """The ids of a block; from checkpoint k > 0, those from step k * (steps between checkpoints) on."""
    if len(data) < _HEAD.size:
        raise ValueError("block is cut short")
    magic, n, lanes, check, size, marks, crc = _HEAD.unpack_from(data)
    if magic != MAGIC or len(data) != _HEAD.size + 8 * lanes + marks * (4 + 8 * lanes) + 4 * size:
        raise ValueError("no block, or cut short")
    at, place, step = _HEAD.size, 0, 0
    if checkpoint:
        at += 8 * lanes + (checkpoint - 1) * (4 + 8 * lanes)
        place, step = struct.unpack_from("<I", data, at)[0], checkpoint * check
        at += 4
    state = np.frombuffer(data, "<u8", lanes, at).astype(U64)
    stream = np.frombuffer(data, "<u4", size, len(data) - 4 * size)
    slots, mask, bits = table.slots(), U64((1 << table.precision) - 1), U64(table.precision)
    out = np.empty(n - step * lanes, np.int64)
    for s in range(step, -(-n // lanes)):
        count = min(lanes, n - s * lanes)
        x = state[:count]
        slot = x & mask
        index = slots[slot.astype(np.int64)]
        out[(s - step) * lanes : (s - step) * lanes + count] = index
        x = table.weight[index] * (x >> bits) + slot - table.start[index]
        low = x < U64(_LOW)
        need = int(low.sum())
        if need:
            if place + need > size:
                raise ValueError("block is damaged")
            x[low] = (x[low] << U64(32)) | stream[place : place + need].astype(U64)
            place += need
        state[:count] = x
    if place != size or (state != U64(_LOW)).any():  # the lanes end where encoding began
        raise ValueError("block is damaged")
    ids = table.symbols[out]
    if not checkpoint and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("block is damaged")
    return ids


class WordTokenizer:
    """The library's encoding of whole texts, through distinct chunks between ASCII white space."""

    MARK = "\x01"

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: added tokens, which the library finds in a text before it looks for words; a document that holds one in any case goes to it whole
        self.added = [LOWER[np.frombuffer(t.content.encode(), np.uint8)].tobytes() for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.mark = self.library.encode(self.MARK, add_special_tokens=False).ids
        self.cache = Cache(self.encode_chunks)

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks go to the library in lines, parted by a mark; the chunks of a line that holds the mark's own token go alone."""
        texts = [c.decode() for c in chunks]
        ids: list[np.ndarray] = []
        size = np.empty(len(texts), np.int64)
        (mark,) = self.mark
        starts = range(0, len(texts), LINE)
        lines = [f" {self.MARK} ".join(texts[at : at + LINE]) for at in starts]
        for at, line in zip(starts, self.library.encode_batch_fast(lines, add_special_tokens=False)):
            part, got = texts[at : at + LINE], np.array(line.ids, np.int32)
            cut = np.flatnonzero(got == mark)
            if len(cut) == len(part) - 1:
                size[at : at + len(part)] = np.diff(np.concatenate([[-1], cut, [len(got)]])) - 1
                ids.append(np.delete(got, cut))
            else:
                alone = [self.library.encode(t, add_special_tokens=False).ids for t in part]
                size[at : at + len(part)] = [len(x) for x in alone]
                ids.append(np.array([i for x in alone for i in x], np.int32))
        return np.concatenate(ids), size

    def encode(self, buf: np.ndarray, offs: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice's documents, the end id after each, and the number of ids of each document."""
        words = Words(buf, offs, BLANK_WORDS)
        whole = self._with_added(words.low, offs)
        ids, size = self.cache.ids(words.hashes(), words.low, words.start, words.end)
        total = np.concatenate([[0], np.cumsum(size)])[words.first]
        if len(whole):
            parts = np.split(ids, total[1:-1])
            for d in whole.tolist():
                parts[d] = np.array(self.library.encode(buf[offs[d] : offs[d + 1]].tobytes().decode(), add_special_tokens=False).ids, np.int32)
            ids, total = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return np.insert(ids, total[1:], end), np.diff(total) + 1

    def _with_added(self, low: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The documents of a slice that hold the content of an added token."""
        raw, found = low.tobytes(), set()
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                found.add(int(np.searchsorted(offs, at, "right")) - 1)
                at = raw.find(content, at + 1)
        return np.array(sorted(found), np.int64)


_loaded: dict[str, WordTokenizer] = {}


def loaded(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def _section(part: int, number: int, docs: list, sizes: list, ids: list) -> dict:
    """A section's row, from the ids of its documents."""
    every, size = np.concatenate(ids), np.concatenate(sizes)
    counts = np.bincount(every)
    symbols = np.flatnonzero(counts)
    table = Table(symbols, weights(counts[symbols]))
    ends = np.cumsum(size)
    blocks, at, doc = [], 0, 0
    while doc < len(size):  # blocks end with a document
        to = max(doc + 1, int(np.searchsorted(ends, at + BLOCK, "right")))
        blocks.append(encode_block(every[at : ends[to - 1]], table))
        at, doc = int(ends[to - 1]), to
    return {"part": part, "section": number, "n_tokens": len(every), "doc_ids": pa.concat_arrays(docs).to_pylist(), "sizes": size, "symbols": symbols, "weights": table.weight.astype(np.int64), "blocks": blocks}


FILE_SCHEMA = "part int, section int, n_tokens bigint, doc_ids array<bigint>, sizes array<bigint>, symbols array<int>, weights array<int>, blocks array<binary>"
_FILE = pa.schema([("part", pa.int32()), ("section", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("symbols", pa.list_(pa.int32())), ("weights", pa.list_(pa.int32())), ("blocks", pa.list_(pa.binary()))])


def write(docs: DataFrame, folder: str, path: str | None = None, section: int = SECTION) -> None:
    """Encodes the documents' texts and writes the files to a folder."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, number = loaded(path), TaskContext.get().partitionId(), 0
        names, sizes, ids, held = [], [], [], 0
        rows = (lambda: as_table(_FILE, **{k: [v] for k, v in _section(part, number, names, sizes, ids).items()}))
        for whole in batches:
            for batch in slices(whole, "text"):
                own, size = tokenizer.encode(*flat(batch.column("text")))
                names.append(batch.column("doc_id"))
                sizes.append(size)
                ids.append(own)
                held += len(own)
                if held >= section:
                    yield rows()
                    names, sizes, ids, held, number = [], [], [], 0, number + 1
        if held:
            yield rows()

    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text", tie.alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.parquet(folder)


def read(spark, folder: str, keep_ids: bool = True) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, with keep_ids, ids."""
    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    # places of the sections: a running sum in each part, on top of one over the parts' totals
    sections = files.select("part", "section", "n_tokens")
    totals = sections.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("section")) - F.col("n_tokens")
    starts = sections.select("part", "section", inner.alias("inner")).join(parts, "part").select("part", "section", (F.col("inner") + F.col("part_start")).alias("section_start"))
    fields = [("part", pa.int32()), ("section", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep_ids else [])]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                table = Table(np.asarray(row["symbols"].values), np.asarray(row["weights"].values, np.int64))
                sizes = np.asarray(row["sizes"].values)
                ids = np.concatenate([decode_block(b.as_py(), table) for b in row["blocks"].values])
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]
                lists = {"ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))} if keep_ids else {}
                yield as_table(schema, part=np.full(len(sizes), row["part"].as_py()), section=np.full(len(sizes), row["section"].as_py()), doc_id=row["doc_ids"].values, at=ends - sizes, n_tokens=sizes, ids_crc32=crc, **lists)

    out = files.mapInArrow(run, "part int, section int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)
    joined = out.join(starts, ["part", "section"])
    return joined.select("doc_id", (F.col("section_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def op10_token_file(spark, sf_dir: str) -> DataFrame:
    """Writes every document's ids and reads the files back; see the module for cases."""
    folder = scratch(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read(spark, folder, keep_ids=False)


QUERIES: dict[str, Callable] = {"op10_token_file": op10_token_file}
