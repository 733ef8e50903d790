"""The binary index format IVF2, for exchange with other programs.  The engine's own tables are Parquet.

Little-endian, nothing trailing: magic "IVF2"; n, k and dims (u32); centroids f32[dims][k]; radii f32[k]; block_offsets
u32[k + 1]; labels u8[8 * blocks] (0 fraud, 1 legit, 255 pad); values i16[blocks][dims][8], pads 32767.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

import numpy as np

from ..config import BLOCK_LANES

#: Fixed values of the format.
MAGIC, FRAUD_BYTE, LEGIT_BYTE, PAD_BYTE, PAD_VALUE = b"IVF2", 0, 1, 255, 32_767


class IndexFormatError(ValueError):
    pass


@dataclass
class BinaryIndex:
    n: int
    centroids: np.ndarray  # (k, dims)
    radii: np.ndarray
    block_offsets: np.ndarray
    labels: np.ndarray  # (blocks, 8)
    values: np.ndarray  # (blocks, dims, 8)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cluster, label byte and values of each vector, pads left out, in stored order."""
        cluster = np.repeat(np.arange(len(self.radii)), np.diff(self.block_offsets))
        live = self.labels != PAD_BYTE
        return np.repeat(cluster, BLOCK_LANES)[live.ravel()], self.labels[live], self.values.transpose(0, 2, 1)[live]


def pack(centroids: np.ndarray, radii: np.ndarray, cluster: np.ndarray, label: np.ndarray, values: np.ndarray) -> bytes:
    """The format's bytes for rows that are ordered by cluster."""
    k, dims = centroids.shape
    size = np.bincount(cluster, minlength=k)
    blocks = -(-size // BLOCK_LANES)
    offsets = np.concatenate([[0], np.cumsum(blocks)])
    slot = np.arange(len(cluster)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[:-1] * BLOCK_LANES, size)
    labels = np.full(offsets[-1] * BLOCK_LANES, PAD_BYTE, np.uint8)
    lanes = np.full((offsets[-1] * BLOCK_LANES, dims), PAD_VALUE, "<i2")
    labels[slot], lanes[slot] = label, values
    body = [centroids.T.astype("<f4"), radii.astype("<f4"), offsets.astype("<u4"), labels, lanes.reshape(-1, BLOCK_LANES, dims).transpose(0, 2, 1)]
    return b"".join([MAGIC, struct.pack("<3I", len(cluster), k, dims), *(np.ascontiguousarray(x).tobytes() for x in body)])


def unpack(raw: bytes, dims: int | None = None) -> BinaryIndex:
    if raw[:4] != MAGIC:
        raise IndexFormatError("magic is missing")
    if len(raw) < 16:
        raise IndexFormatError("cut short")
    n, k, width = struct.unpack_from("<3I", raw, 4)
    if dims is not None and width != dims:
        raise IndexFormatError(f"{width} dimensions, not {dims}")
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        size = np.dtype(kind).itemsize * count
        if at + size > len(raw):
            raise IndexFormatError("cut short")
        at += size
        return np.frombuffer(raw, kind, count, at - size)

    centroids = take("<f4", width * k).reshape(width, k).T
    radii, offsets = take("<f4", k), take("<u4", k + 1).astype(np.int64)
    if (np.diff(offsets) < 0).any() or offsets[0]:
        raise IndexFormatError("block offsets must rise from 0")
    blocks = int(offsets[-1])
    labels = take("u1", blocks * BLOCK_LANES).reshape(-1, BLOCK_LANES)
    values = take("<i2", blocks * BLOCK_LANES * width).reshape(-1, width, BLOCK_LANES)
    if at != len(raw):
        raise IndexFormatError("trailing bytes")
    if int((labels != PAD_BYTE).sum()) != n:
        raise IndexFormatError("labels don't match the number of vectors")
    return BinaryIndex(n, centroids, radii, offsets, labels, values)


def publish(raw: bytes, path: str) -> None:
    """Writes beside the target, then renames, so that a reader sees an old or a new whole file."""
    folder, name = os.path.split(os.path.abspath(path))
    beside = os.path.join(folder, f".{name}.tmp.{os.getpid()}")
    try:
        with open(beside, "wb") as f:
            f.write(raw)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.remove(beside)


def publish_to(spark, raw: bytes, path: str) -> None:
    """The same in any store that Spark can write to."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = hadoop.Path(target.getParent(), f".{target.getName()}.tmp.{os.getpid()}")
    store.mkdirs(target.getParent())
    out = store.create(beside, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()
    # one step, so that a reader finds the old file or the new one
    overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, target, overwrite)
