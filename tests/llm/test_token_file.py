import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from vectorvote.llm import token_file as tf


@pytest.mark.parametrize("n", [1, 5, 300, 5000])
def test_block(n):
    r = np.random.default_rng(n)
    ids = np.sort(r.zipf(1.3, n) % 400)[r.permutation(n)]
    symbols, counts = np.unique(ids, return_counts=True)
    table = tf.Table(symbols, tf.weights(counts))
    assert int(table.weight.sum()) == 1 << tf.PRECISION
    data = tf.encode_block(ids, table, lanes=16, check=8)
    assert (tf.decode_block(data, table) == ids).all()
    steps = -(-n // min(16, n))
    for k in range(1, (steps - 1) // 8 + 1):
        assert (tf.decode_block(data, table, k) == ids[k * 8 * 16 :]).all()
    with pytest.raises(ValueError):
        tf.decode_block(data[:-1], table)
    if n > 100:
        bad = bytearray(data)
        bad[-3] ^= 5
        with pytest.raises(ValueError):
            tf.decode_block(bytes(bad), table)


def library():
    t = Tokenizer.from_file(P.path(tf.VOCABULARY))
    return t


def test_round_trip(spark, tmp_path):
    lib = library()
    r = np.random.default_rng(0)
    bits = ["It's", "ÉTÉ", "naïve", "日本語", "\x0b", " ", "\n\t", "a\x01b", "<|endoftext|>", "<|EndOfText|>", "b<|startoftext|>c", "x1y2", "***", "ß", "ﬁ", "İ", "Σας", " ", "é", "​", "\x01", "\x0c"]
    rows = [(int(k), "".join(r.choice([*bits, " "]) for _ in range(40))) for k in r.permutation(60)]
    rows += [(200, "<|startoftext|>"), (201, "<|startof"), (202, "text|> x"), (100, None), (101, ""), (102, "long word " * 30_000), (7, "same id"), (7, "same id"), (None, "null id")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, start int").repartition(3)
    tf.write(df, str(tmp_path / "t"), section=3000)
    got = tf.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [x.doc_id for x in got] == sorted((x[0] for x in rows), key=lambda v: -1 if v is None else v)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(lib.encode(t or "", add_special_tokens=False).ids + [tf.END])
    at = 0
    for x in got:
        assert x.ids in want[x.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(x.ids), zlib.crc32(np.array(x.ids, "<u4").tobytes()))
        at += x.n_tokens
    assert len(got) == len(rows)
    tf.write(df.limit(0), str(tmp_path / "e"))
    assert tf.read(spark, str(tmp_path / "e")).count() == 0
