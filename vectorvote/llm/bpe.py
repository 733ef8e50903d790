"""Byte-level BPE with DuckDB recursive queries in each partition.

Encoding: a text is cut before each run of ASCII white space that follows other characters (no match of the pre-token pattern
crosses such a place), distinct chunks are split by the pattern, and the distinct pieces become token-position rows,
a row for each byte.  A recursive query joins neighbouring rows with the merge table and contracts each piece's leftmost
pair of minimum rank, until no piece has a pair left.  A piece that is itself a token is one token from the start.
Decoding: rows (document, position, id) join the vocabulary, and an ordered aggregation joins the bytes.

Pieces of more than LONG_PIECE bytes take the recursion's steps as statements, which contract all places of the least rank at once (as many
rounds as different ranks, not as many as contractions) and keep the last round only.  A piece of more than HUGE_PIECE bytes may
need thousands of rounds; the same contraction runs on it with a heap (figures in the README).  Decoding works on IDS
ids at a time.  The ranks file is read by path in each worker, as a file of the installed library; its size doesn't grow with data.

Defined results: null text counts as empty: no ids, empty decoding.  Repeated rows give equal rows; an empty table gives none;
extra columns are ignored.  Ties between pairs of equal rank go to the leftmost.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import Cache
from .text import BLANK_WORDS, as_table, flat, slices, span_hashes

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces of more bytes than this are contracted by rounds of their own; beyond HUGE_PIECE, with a heap.
LONG_PIECE, HUGE_PIECE = 64, 512
#: Bytes of pieces that one query contracts, chunks that are looked up at once, and ids that one decoding query joins, at most.
BYTES, CHUNKS, IDS = 600_000, 1_000_000, 500_000

RECURSION = """
WITH RECURSIVE s AS (
  SELECT w, pos, tok, FALSE AS done FROM start_rows
  UNION ALL (
    WITH p AS (
      SELECT w, pos, tok, lead(tok) OVER v AS nxt, lag(pos) OVER v AS prv FROM s WHERE NOT done WINDOW v AS (PARTITION BY w ORDER BY pos)
    ), m AS (
      SELECT p.w, p.pos, p.tok, p.prv, merges.tok * 1048576 + p.pos AS pick FROM p LEFT JOIN merges ON merges.l = p.tok AND merges.r = p.nxt
    ), b AS (
      SELECT w, min(pick) AS pick FROM m GROUP BY w
    )
    SELECT m.w, m.pos, CASE WHEN m.pos = b.pick % 1048576 THEN (b.pick // 1048576)::INTEGER ELSE m.tok END, b.pick IS NULL
    FROM m JOIN b ON m.w = b.w WHERE b.pick IS NULL OR m.prv IS DISTINCT FROM b.pick % 1048576
  )
)
SELECT w, tok FROM s WHERE done ORDER BY w, pos
"""
#: One round on long pieces, of which only the last round is kept: a row for each piece's least rank, then all rows after it.  Places of that rank
#: follow each other only where they overlap; of such a run every second one is contracted, as from left to right; of a rank that
#: may be followed by a lower one, only the first.
LEAST = """
CREATE OR REPLACE TEMP TABLE ranked AS
  SELECT p.w, p.pos, p.tok, p.i, merges.tok AS rank
  FROM (SELECT w, pos, tok, lead(tok) OVER v AS nxt, row_number() OVER v AS i FROM long_rows WINDOW v AS (PARTITION BY w ORDER BY pos)) p
  LEFT JOIN merges ON merges.l = p.tok AND merges.r = p.nxt
"""
CONTRACT = """
CREATE OR REPLACE TEMP TABLE long_rows AS
  WITH best AS (SELECT w, min(rank) AS rank FROM ranked GROUP BY w),
  hit AS (SELECT w, i, rank, i - row_number() OVER (PARTITION BY w ORDER BY i) AS run, row_number() OVER (PARTITION BY w ORDER BY i) AS k FROM ranked JOIN best USING (w, rank)),
  pick AS (
    SELECT hit.w, hit.i, hit.rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY i) AS place FROM hit) hit LEFT JOIN unsafe ON unsafe.tok = hit.rank
    WHERE place % 2 = 1 AND (unsafe.tok IS NULL OR k = 1)
  )
  SELECT ranked.w, ranked.pos, coalesce(pick.rank, ranked.tok) AS tok
  FROM ranked LEFT JOIN pick ON pick.w = ranked.w AND pick.i = ranked.i
  ANTI JOIN pick gone ON gone.w = ranked.w AND gone.i = ranked.i - 1
"""
DECODE = "SELECT d, string_agg(v.b, '' ORDER BY p) AS t FROM id_rows JOIN vocabulary v ON v.tok = id_rows.tok GROUP BY d"

#: White space beyond ASCII, in UTF-8, and controls that some engines count as white space.
_ODD_SPACE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *(b"\xe2\x80" + bytes([k]) for k in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\x1c", b"\x1d", b"\x1e", b"\x1f"]


class Bpe:
    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        # \s of the pattern is Unicode's White_Space, which has no U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self._table("merges", l=pa.array(left, pa.int32()), r=pa.array(right, pa.int32()), tok=pa.array(merged, pa.int64()))
        early = {part for part, rank in [*zip(left, merged), *zip(right, merged)] if part > rank and len(self.bytes_of[part]) > 1}
        self._table("unsafe", tok=pa.array(sorted(early), pa.int64()))
        tokens = sorted(self.bytes_of)
        self._table("vocabulary", tok=pa.array(tokens, pa.int32()), b=pa.array([self.bytes_of[t].decode("latin-1") for t in tokens]))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.cache = Cache(self.encode_chunks)

    def _table(self, name: str, **columns) -> None:
        rows = pa.table(columns)
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _heap(self, piece: bytes) -> list[int]:
        """The contraction for one long piece: a heap of (rank, place), with places linked left and right."""
        tok = [self.ranks[bytes([b])] for b in piece]
        n = len(tok)
        part = [piece[i : i + 1] for i in range(n)]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = right[i]
            if j < n and (rank := self.ranks.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (rank, i, len(part[i]), len(part[j])))

        for i in range(n - 1):
            push(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if tok[i] < 0 or j >= n or len(part[i]) != a or len(part[j]) != b:
                continue
            part[i] += part[j]
            tok[i], tok[j] = rank, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return [t for t in tok if t >= 0]

    def _rows(self, pieces: list[bytes]) -> pa.Table:
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        pos = (np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        return pa.table({"w": np.repeat(np.arange(len(pieces), dtype=np.int32), size), "pos": pos, "tok": self.byte_ids[raw]})

    def _recursion(self, pieces: list[bytes]) -> dict:
        self.db.register("start_rows", self._rows(pieces))
        got = self.db.execute(RECURSION).fetchnumpy()
        self.db.unregister("start_rows")
        return got

    def _rounds(self, pieces: list[bytes]) -> dict:
        self.db.register("incoming", self._rows(pieces))
        self.db.execute("CREATE OR REPLACE TEMP TABLE long_rows AS SELECT * FROM incoming")
        self.db.unregister("incoming")
        while self.db.execute(LEAST) and self.db.execute("SELECT count(rank) FROM ranked").fetchone()[0]:
            self.db.execute(CONTRACT)
        return self.db.execute("SELECT w, tok FROM long_rows ORDER BY w, pos").fetchnumpy()

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list = [None] * len(pieces)
        short, long = [], []
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[k] = [rank]
            elif len(piece) > HUGE_PIECE:
                out[k] = self._heap(piece)
            else:
                (long if len(piece) > LONG_PIECE else short).append(k)
        for work, contract in ((short, self._recursion), (long, self._rounds)):
            size = np.cumsum([0, *(len(pieces[k]) for k in work)])
            at = 0
            while at < len(work):
                to = max(at + 1, int(np.searchsorted(size, size[at] + BYTES, "right")) - 1)
                some, at = work[at:to], to
                got = contract([pieces[k] for k in some])
                ends = np.searchsorted(got["w"], np.arange(len(some) + 1)).tolist()
                tokens = np.asarray(got["tok"]).tolist()
                for r, k in enumerate(some):
                    out[k] = tokens[ends[r] : ends[r + 1]]
        return out

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.split(c.decode()) for c in chunks]
        pieces = list(dict.fromkeys(p for s in split for p in s))
        ids = dict(zip(pieces, self.encode_pieces([p.encode() for p in pieces])))
        flat_ids: list[int] = []
        size = np.empty(len(chunks), np.int64)
        for k, s in enumerate(split):
            before = len(flat_ids)
            for p in s:
                flat_ids += ids[p]
            size[k] = len(flat_ids) - before
        return np.array(flat_ids, np.int32), size

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice's documents, and where each document's ids begin (one more entry than documents)."""
        n = len(buf)
        ink = BLANK_WORDS[buf]
        cut = np.zeros(n + 1, dtype=bool)
        cut[1:n] = ink[:-1] & ~ink[1:]
        raw = buf.tobytes()
        for needle in _ODD_SPACE:  # such documents are one chunk each
            at = raw.find(needle)
            while at >= 0:
                d = int(np.searchsorted(offs, at, "right")) - 1
                cut[offs[d] : offs[d + 1]] = False
                at = raw.find(needle, int(offs[d + 1]))
        cut[offs] = True
        cut[n] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        ids, size = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for at in range(0, len(start), CHUNKS):
            a, b = start[at : at + CHUNKS], end[at : at + CHUNKS]
            base = int(a[0])
            own, many = self.cache.ids(span_hashes(buf[base : b[-1]], a - base, b - base), buf[base : b[-1]], a - base, b - base)
            ids.append(own), size.append(many)
        total = np.cumsum(np.concatenate(size))
        return np.concatenate(ids), total[np.searchsorted(start, offs)]

    def decoded(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(document, bytes) from the documents' ids, in order; a document that is cut into several queries comes in parts."""
        for at in range(0, len(ids), IDS):
            part = ids[at : at + IDS].astype(np.int32)
            d = (np.searchsorted(first, np.arange(at, at + len(part)), "right") - 1).astype(np.int32)
            self.db.register("id_rows", pa.table({"d": d, "p": np.arange(len(part), dtype=np.int32), "tok": part}))
            rows = sorted(self.db.execute(DECODE).fetchall())
            self.db.unregister("id_rows")
            for k, text in rows:
                yield k, text.encode("latin-1")

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The bytes of each document, from its ids."""
        out: list[list[bytes]] = [[] for _ in first[1:]]
        for k, part in self.decoded(ids, first):
            out[k].append(part)
        return [b"".join(x) for x in out]

    def digests(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The SHA-256 of each document's decoded bytes."""
        own = [hashlib.sha256() for _ in first[1:]]
        for k, part in self.decoded(ids, first):
            own[k].update(part)
        return [x.hexdigest() for x in own]


_loaded: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """This worker's tables for a ranks file."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(path, pattern)
    return _loaded[path, pattern]


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (with keep_ids), n_tokens, ids_sha256 and decoded_sha256, the last after decoding the ids again."""
    if path is None or pattern is None:
        path, pattern = _vocabulary()
    fields = [("doc_id", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep_ids else []), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, first = bpe.encode(*flat(batch.column("text")))
                own = [hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(first[:-1], first[1:])]
                back = bpe.digests(ids, first)
                lists = {"ids": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))} if keep_ids else {}
                yield as_table(schema, doc_id=batch.column("doc_id"), n_tokens=np.diff(first), ids_sha256=own, decoded_sha256=back, **lists)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, " + "ids array<int>, " * keep_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; see the module for cases."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)


QUERIES: dict[str, Callable] = {"op1_bpe": op1_bpe}
