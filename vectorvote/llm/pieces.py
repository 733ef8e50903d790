"""Token ids of whole texts from the ids of their distinct chunks.

A text is cut where a chunk's tokens can't depend on its neighbours.  Chunks are found by 64-bit hashes of their bytes, and a
hit counts only if the bytes are equal; each distinct chunk is encoded once and kept in a cache of bounded size, which a
Python worker reuses.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .text import equal_spans, words_of

#: Ids that the cache of one worker holds at most; beyond, it starts anew.
CACHE_IDS = 6_000_000


class Cache:
    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_IDS):
        """encode: texts of distinct chunks to their ids, one after another, and the number of ids of each."""
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)
        #: the bytes of each key's chunk: all bytes, where each begins, and how many it has
        self.raw = np.zeros(0, np.uint8)
        self.eight = words_of(self.raw)
        self.raw_at, self.raw_size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, hashes: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks buf[start:end], and the number of ids of each chunk."""
        if not len(hashes):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        chunk = lambda k: buf[start[k] : end[k]].tobytes()
        if not known.all():
            if len(self.store) > self.limit or len(self.raw) > 16 * self.limit:
                self._clear()
                known[:] = False
            new, whole = first[~known], buf.tobytes()
            texts = [whole[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())]
            ids, size = self.encode(texts)
            raw_size = np.array([len(t) for t in texts], np.int64)
            keys = np.concatenate([self.keys, distinct[~known]])
            order = np.argsort(keys, kind="stable")
            joined = lambda old, size, base: np.concatenate([old, base + np.cumsum(size) - size])[order]
            self.keys = keys[order]
            self.at, self.raw_at = joined(self.at, size, len(self.store)), joined(self.raw_at, raw_size, len(self.raw))
            self.size, self.raw_size = (np.concatenate(x)[order] for x in ((self.size, size), (self.raw_size, raw_size)))
            self.store = np.concatenate([self.store, ids.astype(np.int32)])
            self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(texts), np.uint8)])
            self.eight = words_of(self.raw)
            place = np.searchsorted(self.keys, distinct)
        place = place[inverse]
        at, size = self.at[place], self.size[place]
        same = self.raw_size[place] == end - start
        same[same] = equal_spans(self.raw, self.raw_at[place[same]], buf, start[same], (end - start)[same], self.eight)
        other = np.flatnonzero(~same)  # equal hashes of unequal chunks: these are encoded by themselves
        store = self.store
        if len(other):
            ids, size[other] = self.encode([chunk(k) for k in other.tolist()])
            at[other] = len(store) + np.cumsum(size[other]) - size[other]
            store = np.concatenate([store, ids.astype(np.int32)])
        total = np.cumsum(size)
        return store[np.repeat(at - np.concatenate([[0], total[:-1]]), size) + np.arange(total[-1])], size
