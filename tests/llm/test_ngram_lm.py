import math
import zlib
from collections import Counter

import numpy as np
import pytest

from vectorvote.llm import ngram_lm as lm

HELD = "coalesce(crc32(cast(doc_id as string)) % 7 = 2, false)"


def brute(rows, discount, least):
    texts = [([w.lower() for w in (t or "").split()] + [None], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    c = Counter(w for t, held in texts if not held for w in t)
    n, v = sum(c.values()), len(c)
    often = set(c)
    pairs = Counter(p for t, held in texts if not held for p in zip(t, t[1:]) if p[0] in often and p[1] in often)
    pairs = {p: k for p, k in pairs.items() if k >= least}
    p1 = lambda w: (max(c[w] - discount, 0) + discount * v / (v + 1)) / n
    left = {h: 1 - sum(k - discount for p, k in pairs.items() if p[0] == h) / c[h] for h in often}
    p2 = lambda h, w: ((pairs[h, w] - discount) / c[h] if (h, w) in pairs else 0) + left.get(h, 1) * p1(w)
    # a proper distribution: all seen tokens and the unseen mass
    for h in list(often)[:5]:
        assert abs(sum(p2(h, w) for w in c) + left[h] * p1("never seen") - 1) < 1e-9
    out = []
    for (i, _), (t, held) in zip(rows, texts):
        s = math.log10(p1(t[0])) + sum(math.log10(p2(h, w)) for h, w in zip(t, t[1:]))
        out.append((i, held, len(t), sum(w in c for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), s))
    return out


@pytest.mark.parametrize("min_pair", [1, 2])
def test_against_brute_force(spark, min_pair):
    r = np.random.default_rng(3)
    vocab = ["the", "The", "of", "é", "x1", "a.", *(f"r{k}" for k in range(50))]
    rows = [(k, " ".join(r.choice(vocab, int(r.integers(0, 40)), p=np.r_[[0.1] * 6, [0.008] * 50]))) for k in range(80)]
    rows += [(100, None), (101, ""), (102, "the of " * 30_000), (3, rows[3][1]), (None, "the of null"), (103, "\t never-seen \x0b the")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, score int").repartition(3)
    got = lm.score(df, HELD, min_pair=min_pair).collect()
    want = brute(rows, lm.DISCOUNT, min_pair)
    name = lambda x: (str(x[0]), x[2], round(x[5], 3))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=name), sorted(want, key=name)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=1e-6)


def test_no_training_and_empty(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    (x,) = lm.score(df, HELD).collect()
    assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) == (True, 3, 0, 0, 0.0, 0.0)
    assert lm.score(df.limit(0), HELD).count() == 0


def test_rare_words_are_states(spark):
    # three occurrences in over 400,000 tokens: below 1e-5 of them
    rows = [(100, "the of " * 200_000), *((k, f"rare{k % 5} pair{k % 5} the rare{k % 5}") for k in range(20))]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), HELD).collect()
    want = {w[0]: w[6] for w in brute(rows, lm.DISCOUNT, lm.MIN_PAIR)}
    assert {g.doc_id: g.score for g in got} == pytest.approx(want, abs=1e-6)
