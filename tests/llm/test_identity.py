"""Words, lines and chunks are told apart even where sums of their bytes' multiples are equal, or their hashes are."""

import hashlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from vectorvote.llm import bpe, decontaminate, line_dedup, near_dedup, ngram_lm, pieces, text, token_file

#: A Thue-Morse word and its complement: all polynomial sums of theirs modulo 2**64 with an odd base are equal.
ONE = "".join("ab"[k.bit_count() & 1] for k in range(1024))
TWO = "".join("ba"[k.bit_count() & 1] for k in range(1024))


def test_hashes():
    words = [ONE, TWO, "a", "b", "", "a\0", "\0a", "x" * 63, "x" * 64, "x" * 65, "x" * 64 + "y", *("w%07d" % k for k in range(5000))]
    raw = "".join(words).encode()
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    buf = np.frombuffer(raw, np.uint8)
    for key in (0, 1):
        assert len(set(text.span_hashes(buf, start, end, key).tolist())) == len(words)
    moved = np.frombuffer(b"??" + raw, np.uint8)
    assert (text.span_hashes(moved, start + 2, end + 2) == text.span_hashes(buf, start, end)).all()
    same = text.equal_spans(buf, start, moved, start + 2, end - start)
    assert same.all()
    assert not text.equal_spans(buf, start[:1], buf, start[1:2], np.array([1024]))[0]


def test_equal_hashes_of_unequal_chunks():
    cache = pieces.Cache(lambda chunks: (np.array([b for c in chunks for b in c], np.int32), np.array([len(c) for c in chunks])), limit=50)
    r = np.random.default_rng(1)
    for _ in range(30):
        chunks = [bytes(r.integers(97, 100, int(r.integers(1, 5))).astype(np.uint8)) * int(r.integers(1, 30)) for _ in range(40)]
        size = np.array([len(c) for c in chunks])
        end = np.cumsum(size)
        ids, n = cache.ids((size % 3).astype(np.uint64), np.frombuffer(b"".join(chunks), np.uint8), end - size, end)
        assert n.tolist() == size.tolist() and ids.astype(np.uint8).tobytes() == b"".join(chunks)


def test_operators(spark):
    docs = spark.createDataFrame([(1, ONE), (2, TWO), (3, f"x {ONE} y"), (4, f"x {TWO} y")], "doc_id long, text string")
    got = {r.doc_id: r.decoded_sha256 for r in bpe.encode(docs).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in docs.collect()}

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(token_file.VOCABULARY))
    own = token_file.loaded(P.path(token_file.VOCABULARY))
    raw = [t.encode() for _, t in docs.collect()]
    ids, n = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert ids.tolist() == [i for x in raw for i in [*library.encode(x.decode(), add_special_tokens=False).ids, 2]]

    items = spark.createDataFrame([(9, ONE)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.report(docs, items).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}
    assert {r.doc_id: r.component_id for r in near_dedup.cluster(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    lines = spark.createDataFrame([(1, f"p\n{ONE}\nq"), (2, f"p\n{TWO}\nq"), (3, f"p\n{TWO}\nq")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(lines, report=True).collect()} == {1: 0, 2: 0, 3: 3}
    known = ngram_lm.score(docs, "doc_id in (2, 4)").agg(F.sum(F.when(F.col("held_out"), F.col("n_known")))).first()[0]
    assert known == 4  # two ends, x and y: the other word was never trained
