"""Language-model scores by a weighted backoff automaton that is never in one place.

Model.  Tokens are words and one end for each text.  With c and N counted over the training documents, V distinct tokens:

    P1(w)     = (max(c(w) - D, 0) + D * V / (V + 1)) / N              every unseen token gets D * V / (V + 1) / N
    P(w | h)  = (c(hw) - D) / c(h) + L(h) * P1(w)                     where the arc hw is kept
    P(w | h)  = L(h) * P1(w)                                          else, by the failure arc of h
    L(h)      = 1 - sum over kept arcs hw of (c(hw) - D) / c(h)

States are the empty history and every trained word; every trained pair hw is an arc.  (With min_pair > 1, pairs that occur less often
aren't.)  A text is read once from left to right: the state is the token before; the arc's weight is added, or the failure arc's and the unigram arc's.

Execution.  Texts are packed into chunks of bounded size, written once.  Each chunk sends its distinct tokens (then pairs), packed and
sorted, to the parts of the key space; a part adds up what all chunks sent, and answers each chunk in the order of its
question.  The parts number the tokens, so a pair is the numbers of its two, and what the arcs take of each history's weight goes from
the parts of the pairs back to those of the tokens, which answer each chunk once more.  So counts cover the whole corpus, each chunk gets just the piece of the automaton that its texts touch, and a
frequent token is one entry a chunk.  Nothing is broadcast.  A chunk asks a part only for keys that it has, so there are at most as
many packed rows as chunks' distinct keys: their number and their bytes grow with the input and no faster.  A pair is no more
frequent than either word, so words that were never trained ask for none.

Defined results: null text counts as empty: one token, the end.  A null doc_id is never held out.  Repeated rows count as often as they
occur and have equal scores.  Without training documents N = V = 0, base_score = 0, and score = 0.  An empty table gives an
empty result; extra columns are ignored.  A very long text is a chunk by itself, in memory in proportion to its tokens.  Tokens are told apart by 64-bit hashes of their lower-cased bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import kept
from .text import BLANK_WORDS, SLICE_BYTES, U64, Words, as_table, flat, mix, slices

MODULUS, HELD = 7, 2
DISCOUNT, MIN_PAIR = 0.75, 1
CHUNK_BYTES = 12 << 20
#: Keys that one part adds up, about.
PART_KEYS = 1_500_000
END_KEY = U64(0x0E0D0F0E0D0F0E0D)


def _pack(a: np.ndarray) -> bytes:
    """An array of unsigned integers, split into byte planes and compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=U64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, np.uint64), dtype=np.uint64)


_CHUNK = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("offs", pa.list_(pa.int64())), ("text", pa.binary())])
_CHUNK_DDL = "chunk bigint, doc_ids array<bigint>, held array<boolean>, offs array<bigint>, text binary"


def chunks(docs: DataFrame, held: str) -> DataFrame:
    """Rows of up to CHUNK_BYTES of text: documents' ids, which are held out, and the compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        part, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text", CHUNK_BYTES):
                buf, offs = flat(batch.column("text"))
                raw = zstandard.ZstdCompressor(level=3).compress(buf.tobytes())
                yield as_table(_CHUNK, chunk=[(part << 32) + number], doc_ids=[batch.column("doc_id").to_pylist()], held=[batch.column("held").to_pylist()], offs=[offs], text=[raw])
                number += 1

    rows = docs.select("doc_id", F.expr(held).alias("held"), "text")
    return rows.mapInArrow(run, _CHUNK_DDL)


class Chunk:
    """Tokens of a chunk: the key of each, end tokens included, and where each document's begin."""

    def __init__(self, row: dict):
        import zstandard

        self.ids, self.held = row["doc_ids"], np.array([bool(x) for x in row["held"]], dtype=bool)
        offs = np.asarray(row["offs"], np.int64)
        buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(1, int(offs[-1]))), np.uint8) if offs[-1] else np.zeros(0, np.uint8)
        keys, counts, d = [], [], 0
        while d < len(self.ids):
            to = max(d + 1, int(np.searchsorted(offs, offs[d] + SLICE_BYTES, "right")) - 1)
            w = Words(buf[offs[d] : offs[to]], offs[d : to + 1] - offs[d], BLANK_WORDS)
            keys.append(np.insert(w.hashes(), w.first[1:], END_KEY))
            counts.append(np.diff(w.first) + 1)
            d = to
        self.keys = np.concatenate(keys)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        self.train = np.repeat(~self.held, np.diff(self.first))
        self.distinct, self.index = np.unique(self.keys, return_inverse=True)

    def token_counts(self) -> np.ndarray:
        return np.bincount(self.index, weights=self.train, minlength=len(self.distinct)).astype(np.uint32)

    def pairs(self, often: np.ndarray, number: np.ndarray, parts: int):
        """Distinct pairs of neighbouring tokens of one document that are both `often`, sorted by part: their keys (the history's number
        above the token's), where each part's begin, their training counts; and each pair's places."""
        inner = np.ones(len(self.keys), dtype=bool)
        inner[self.first[:-1]] = False
        place = np.flatnonzero(inner)
        place = place[often[self.index[place]] & often[self.index[place - 1]]]
        own = number[self.index]
        keys, index = np.unique(own[place - 1] << U64(32) | own[place], return_inverse=True)
        part = (mix(keys) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        index = where[index]
        counts = np.bincount(index, weights=self.train[place], minlength=len(keys)).astype(np.uint32)
        return keys[order], np.searchsorted(part[order], np.arange(parts + 1)), counts, place, index


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of the parts, equal ranges of the key space, begins in sorted keys."""
    edges = np.array([(k << 64) // parts for k in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


_ASK = "part int, chunk bigint, keys binary, counts binary"
_ASK_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = "kind string, chunk bigint, part int, counts binary, numbers binary, mass binary, tokens bigint, types bigint"


def _questions(chunk: int, keys: np.ndarray, cut: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each part of the key space: keys[cut[p] : cut[p + 1]], which are sorted, and their counts."""
    rows = np.flatnonzero(np.diff(cut)).tolist()
    part = lambda a, pack, p: pack(a[cut[p] : cut[p + 1]])
    return as_table(_ASK_ARROW, part=rows, chunk=[chunk] * len(rows), keys=[part(keys, _pack_sorted, p) for p in rows], counts=[part(counts, _pack, p) for p in rows])


def _add_up(least: int, discount: float, parts: int, pairs: bool):
    """For one part of the key space: totals over all chunks, and the answer to each chunk.  Tokens that occur `least` times or more
    are numbered; pairs that occur less often count as none, and of the others goes to the part of each history what they take."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        every = [_unpack_sorted(x) for x in group["keys"]]
        sizes = np.array([len(x) for x in every])
        distinct, index = np.unique(np.concatenate(every), return_inverse=True)
        total = np.bincount(index, weights=np.concatenate([_unpack(x, np.uint32) for x in group["counts"]]), minlength=len(distinct)).astype(np.int64)
        if pairs:
            total[total < least] = 0
        answer = np.minimum(total, (1 << 63) - 1).astype(np.uint64)[index]
        number = np.cumsum(total >= least, dtype=np.uint64)
        if not pairs and (int(number[-1]) + 1) * parts >> 32:
            raise ValueError("too many distinct tokens for numbers of 32 bits")
        ends = np.cumsum(sizes)
        part = group["part"].iloc[0]
        numbers = lambda a, b: None if pairs else _pack_sorted(number[index[a:b]])
        rows = [("answer", c, part, _pack(answer[e - n : e]), numbers(e - n, e), None, None, None) for c, n, e in zip(group["chunk"], sizes, ends)]
        rows.append(("total", None, part, None, None, None, int(total.sum()), int((total > 0).sum())))
        if pairs:
            seen = total > 0
            names, place = np.unique(distinct[seen] >> U64(32), return_inverse=True)
            mass = np.bincount(place, weights=total[seen] - discount, minlength=len(names))
            home = (names % U64(parts)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            names, mass, cut = names[order] // U64(parts), mass[order], np.searchsorted(home[order], np.arange(parts + 1))
            rows += [("mass", None, int(p), None, _pack_sorted(names[cut[p] : cut[p + 1]]), _pack(mass[cut[p] : cut[p + 1]]), None, None) for p in np.flatnonzero(np.diff(cut))]
        names = ["kind", "chunk", "part", "counts", "numbers", "mass", "tokens", "types"]
        whole = {"chunk", "tokens", "types"}  # nullable integers, never by way of floats
        return pd.DataFrame({x: pd.array(v, "Int64") if x in whole else v for x, v in zip(names, map(list, zip(*rows)))})

    return run


_MASS = "kind string, chunk bigint, part int, counts binary"


def _masses(key, asked: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
    """For one part of the tokens: what the kept arcs of each token that a chunk asked for take, in the order of the question."""
    own = [_unpack_sorted(x).astype(np.int64) for x in asked["numbers"]]
    mass = np.zeros(1 + max((int(x[-1]) for x in own), default=0))
    for numbers, taken in zip(said["numbers"], said["mass"]):
        mass[_unpack_sorted(numbers).astype(np.int64)] += _unpack(taken, np.float64)
    return pd.DataFrame({"kind": "mass", "chunk": asked["chunk"], "part": asked["part"], "counts": [_pack(mass[x]) for x in own]})


def _totals(answers: pd.DataFrame, kind: type = np.uint64, to: type = np.int64) -> np.ndarray:
    order = np.argsort(answers["part"].to_numpy())
    return np.concatenate([_unpack(answers["counts"].iloc[k], kind) for k in order]).astype(to) if len(order) else np.zeros(0, to)


def _numbers(answers: pd.DataFrame, parts: int) -> np.ndarray:
    """The number of each token of a chunk, of which parts make every parts-th; those of rare tokens mean nothing."""
    at = answers.sort_values("part")
    return np.concatenate([np.zeros(0, U64), *(_unpack_sorted(x) * U64(parts) + U64(p) for x, p in zip(at["numbers"], at["part"]))])


class Automaton:
    """The piece of the automaton that one chunk's texts touch, with its weights in log10."""

    def __init__(self, chunk: Chunk, count: np.ndarray, tokens: int, types: int, mass: np.ndarray, pair_count: np.ndarray, pair_history: np.ndarray, pair_token: np.ndarray, discount: float):
        rest = discount * types / (types + 1)
        self.unigram = np.log10((np.maximum(count - discount, 0) + rest) / max(tokens, 1)) if tokens else np.zeros(len(count))
        # a state for each token; failure weight L(h)
        left = 1 - mass / np.maximum(count, 1)
        self.failure = np.log10(np.maximum(left, 1e-300))
        # arcs of the states
        self.kept = pair_count > 0
        h, w = pair_history, pair_token
        chance = np.maximum(pair_count - discount, 0) / np.maximum(count[h], 1) + left[h] * 10.0 ** self.unigram[w]
        self.arc = np.where(self.kept, np.log10(np.maximum(chance, 1e-300)), 0.0)

    def traverse(self, chunk: Chunk, place: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Log-probability of each document: the weights along its path, from the empty history."""
        weight = self.unigram[chunk.index]
        inner = np.ones(len(weight), dtype=bool)
        inner[chunk.first[:-1]] = False
        on = np.flatnonzero(inner)
        weight[on] += self.failure[chunk.index[on - 1]]
        arc = self.kept[pair]
        weight[place[arc]] = self.arc[pair[arc]]
        return np.add.reduceat(weight, chunk.first[:-1]) if len(weight) else np.zeros(0)


_OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, held: str, discount: float = DISCOUNT, min_pair: int = MIN_PAIR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.  `held` is an SQL condition on a row's doc_id."""
    spark = docs.sparkSession
    packed = kept(chunks(docs, held), "texts")
    size = packed.select(F.sum(F.element_at("offs", -1)).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // (PART_KEYS * 24)), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def ask_tokens(batches):
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                c = Chunk(row)
                yield _questions(row["chunk"], c.distinct, _cuts(c.distinct, parts), c.token_counts())

    tokens_said = kept(packed.mapInArrow(ask_tokens, _ASK).groupBy("part").applyInPandas(_add_up(min_pair, discount, parts, False), _ANSWER), "tokens")
    n = tokens_said.where("kind = 'total'").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    tokens, types = int(n["n"] or 0), int(n["v"] or 0)
    often = max(1, min_pair)  # a pair with a rarer token is too rare
    answers = tokens_said.where("kind = 'answer'").select("kind", "chunk", "part", "counts", "numbers")

    def ask_pairs(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c: [] for c in _ASK_ARROW.names})
        c = Chunk(left.iloc[0].to_dict())
        count = _totals(right)
        keys, cut, counts, _, _ = c.pairs(count >= often, _numbers(right, parts), parts)
        return _questions(int(key[0]), keys, cut, counts).to_pandas()

    questions = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(ask_pairs, _ASK)
    pairs_said = kept(questions.groupBy("part").applyInPandas(_add_up(min_pair, discount, parts, True), _ANSWER), "pairs")
    said = pairs_said.where("kind = 'mass'").select("part", "numbers", "mass")
    masses = answers.select("part", "chunk", "numbers").groupBy("part").cogroup(said.groupBy("part")).applyInPandas(_masses, _MASS)
    more = masses.union(pairs_said.where("kind = 'answer'").select(F.lit("pair").alias("kind"), "chunk", "part", "counts")).withColumn("numbers", F.lit(None).cast("binary"))

    def finish(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names_out = [x.split()[0] for x in _OUT.split(", ")]
        if not len(left):
            return pd.DataFrame({c: [] for c in names_out})
        c = Chunk(left.iloc[0].to_dict())
        own, mass, pair = (right[right["kind"] == kind] for kind in ("answer", "mass", "pair"))
        count = _totals(own)
        keys, _, _, place, index = c.pairs(count >= often, _numbers(own, parts), parts)
        pair_count = _totals(pair)
        first = np.zeros(len(keys), np.int64)
        first[index] = place
        model = Automaton(c, count, tokens, types, np.where(count >= often, _totals(mass, np.float64, np.float64), 0), pair_count, c.index[first - 1], c.index[first], discount)
        base = np.log10((count + 1) / (tokens + types + 1))[c.index]
        return pd.DataFrame(
            {
                "doc_id": pd.array(c.ids, "Int64"),
                "held_out": c.held,
                "n_tokens": np.diff(c.first),
                "n_known": np.add.reduceat((count > 0)[c.index].astype(np.int64), c.first[:-1]),
                "train_tokens": tokens,
                "base_score": np.add.reduceat(base, c.first[:-1]),
                "score": model.traverse(c, place, index),
            }
        )

    return packed.groupBy("chunk").cogroup(answers.union(more).groupBy("chunk")).applyInPandas(finish, _OUT)


def op6_ngram_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of every document; see the module for cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, f"coalesce(crc32(cast(doc_id as string)) % {MODULUS} = {HELD}, false)")


QUERIES: dict[str, Callable] = {"op6_ngram_lm": op6_ngram_lm}
