import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from vectorvote.llm import bpe


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(2)
    bits = ["a", "the ", " of", "ing", "'s", "'ll", "  ", "\n", "\t", "\n\n ", "é", "ñez", "123", "4", "!?", "日本", " ", "　", " ", "\x1c", "\x85", "x" * 70, "😀", "<|endoftext|>", "\r\n", "ﬁ", "é", "Ⅷ", "\x0b"]
    out = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(600)]
    return [*out, "", " ", "a" * 5000, "ab" * 3000, "thequickbrown" * 400, " " * 3000 + "x"]


def test_encode_like_the_library():
    enc, own = reference(), bpe.loaded(*bpe._vocabulary())
    all_texts = texts()
    raw = [t.encode() for t in all_texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    ids, first = own.encode(np.frombuffer(b"".join(raw), np.uint8), offs)
    for k, t in enumerate(all_texts):
        assert ids[first[k] : first[k + 1]].tolist() == enc.encode_ordinary(t), repr(t[:80])
    assert own.decode(ids, first) == raw


def test_pieces_by_recursion_and_by_heap():
    own = bpe.loaded(*bpe._vocabulary())
    r = random.Random(4)
    pieces = ["".join(r.choice("abcdefghie ntrsö") for _ in range(r.randint(2, 60))).encode() for _ in range(300)]
    pieces += [("".join(r.choice(some) for _ in range(r.randint(66, 900)))).encode() for some in ("abcdefghie ntrsö", "ab", "=", "日本語の", "thequickbrown") for _ in range(8)]
    pieces = [p for p in pieces if len(p) <= bpe.HUGE_PIECE and p not in own.ranks]
    assert own.encode_pieces(pieces) == [own._heap(p) for p in pieces]


def test_ranks_that_lower_ones_follow(tmp_path):
    """A vocabulary in which contracting a pair may bring up a lower rank."""
    tokens = [bytes([b]) for b in range(256)] + [b"aba", b"ab", b"abab", b"ba", b"bab"]
    (tmp_path / "r").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    own = bpe.Bpe(str(tmp_path / "r"), P.PATTERN)
    r = random.Random(1)
    pieces = ["".join(r.choice("ab") for _ in range(r.randint(2, n))).encode() for n in (30, 200) for _ in range(60)]
    assert own.encode_pieces(pieces) == [[own.ranks[p]] if p in own.ranks else own._heap(p) for p in pieces]


def test_a_very_long_text():
    enc, own = reference(), bpe.loaded(*bpe._vocabulary())
    t = " ".join(f"word{k % 5000} été {k}" for k in range(160_000))
    raw = t.encode()
    ids, first = own.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert ids.tolist() == enc.encode_ordinary(t) and len(ids) > bpe.IDS
    assert own.digests(ids, first) == [hashlib.sha256(raw).hexdigest()]


def test_rows(spark):
    enc = reference()
    rows = [(1, None), (2, ""), (3, "one two two"), (3, "one two two"), (None, "é  x " * 20_000)]
    df = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id long, text string, ids array<int>")
    got = sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids[:5]) for r in bpe.encode(df).collect())))
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids[:5]))
    assert got == sorted(map(str, want))
    assert bpe.encode(df.limit(0)).count() == 0
