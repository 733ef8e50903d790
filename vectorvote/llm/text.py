"""Flat byte kernels that the corpus operators share.

Texts stay in the contiguous UTF-8 buffer that Arrow delivers.  Words, hashes and windows are
computed over that buffer with NumPy, so there is no per-word Python work.  Batches are cut into
slices of bounded bytes first; a single document larger than the bound forms a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words as [^\x20\x09-\x0D]+
BLANK_WORDS = np.ones(256, dtype=bool)
BLANK_WORDS[[32, *range(9, 14)]] = False
#: Words as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True

def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into row slices of at most `limit` text bytes (one row at least)."""
    _, offs = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        to = min(to, at + 4096)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a slice: lower-cased bytes, start and end of each word, and where each document's words begin."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, kind: np.ndarray):
        self.low = LOWER[buf]
        inside = kind[self.low]
        n = len(buf)
        cut = np.zeros(n + 1, dtype=bool)
        cut[offs] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | cut[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: words of document d are first[d] .. first[d+1]
        self.first = np.searchsorted(self.start, offs)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's lower-cased bytes."""
        return span_hashes(self.low, self.start, self.end)

    def of(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` word hashes (length len(h) - size + 1, or 0)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, dtype=U64)
    for k in range(size):
        out = out * U64(0x9FB21C651E98DF25) + h[k : k + n]
    return mix(out)


#: Longer ranges are hashed and compared one by one.
SHORT = 64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
_STEP, _KEY = U64(0x9FB21C651E98DF25), (U64(0x2545F4914F6CDD1D), U64(0xD1342543DE82EF95))


def words_of(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a little-endian number; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range of buf; `key` picks one of two independent functions.

    Blocks of eight bytes go through a chain that is mixed after every block, so no sum of blocks cancels out; ranges of over
    SHORT bytes are hashed by keyed BLAKE2b.
    """
    size = end - start
    h = mix(size.astype(U64) + _KEY[key])
    eight = words_of(buf)
    live, at, left = np.arange(len(start)), start, size
    for _ in range(SHORT // 8):
        h[live] = mix((h[live] ^ (eight[at] & _MASK[np.minimum(left, 8)])) * _STEP + _KEY[1 - key])
        more = left > 8
        if not more.any():
            break
        live, at, left = live[more], at[more] + 8, left[more] - 8
    salt = int(_KEY[key]).to_bytes(8, "little")
    for k in np.flatnonzero(size > SHORT).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(buf[start[k] : end[k]].tobytes(), digest_size=8, key=salt).digest(), "little")
    return h


def equal_spans(x: np.ndarray, x_start: np.ndarray, y: np.ndarray, y_start: np.ndarray, size: np.ndarray, x_eight: np.ndarray | None = None) -> np.ndarray:
    """Whether the ranges of `size` bytes from x_start in x and from y_start in y hold the same bytes; x_eight: words_of(x), if there."""
    same = np.ones(len(size), dtype=bool)
    ex, ey = words_of(x) if x_eight is None else x_eight, words_of(y)
    live, left = np.arange(len(size)), size
    for step in range(SHORT // 8):
        differ = ((ex[x_start[live] + 8 * step] ^ ey[y_start[live] + 8 * step]) & _MASK[np.minimum(left, 8)]) != 0
        same[live[differ]] = False
        more = (left > 8) & ~differ
        if not more.any():
            break
        live, left = live[more], left[more] - 8
    for k in np.flatnonzero(same & (size > SHORT)).tolist():
        same[k] = (x[x_start[k] : x_start[k] + size[k]] == y[y_start[k] : y_start[k] + size[k]]).all()
    return same


def as_table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch with the given columns in the schema's order and types."""
    arrays = []
    for field in schema:
        value = columns[field.name]
        if isinstance(value, pa.ChunkedArray):
            value = value.combine_chunks()
        arrays.append(value.cast(field.type) if isinstance(value, pa.Array) else pa.array(value, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
