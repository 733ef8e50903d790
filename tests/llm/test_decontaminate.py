import re

import numpy as np

from vectorvote.llm import decontaminate as d


def test_index():
    r = np.random.default_rng(3)
    for size in (1, 2, 50, 400):
        t = np.concatenate([r.integers(1, 5, size), [0]])
        fm = d.FMIndex(t, 4)
        for m in (1, 2, 3):
            p = r.integers(1, 6, (40, 3)).astype(np.int32)
            low, high = fm.search(p, np.full(40, m))
            for k in range(40):
                want = [i for i in range(size) if list(t[i : i + m]) == list(p[k, 3 - m :])]
                assert sorted(fm.locate(np.arange(low[k], high[k]))) == want


def words(t):
    t = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def test_against_brute_force(spark):
    r = np.random.default_rng(1)
    vocab = ["a", "B", "cé", "d1", "e", "zz"]
    text = lambda n: " ".join(r.choice(vocab, n))
    items = [(k, text(int(n))) for k, n in enumerate([12, 15, 3, 1, 0, 11])] + [(3, None), (7, "Only! four, plain-words")]
    items[3] = (3, "q")
    docs = [(k, text(int(r.integers(0, 60)))) for k in range(30)] + [(90, None), (91, ""), (92, "x " * 40_000 + "ONLY four?PLAIN words" + " x" * 9), (92, "x q"), (None, items[0][1] + " tail")]
    df = spark.createDataFrame([(*x, "s", 5) for x in docs], "doc_id long, text string, items string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    grams = [(i, w[p : p + min(10, len(w))]) for i, t in items for w in [words(t)] for p in range(max(len(w) - 9, min(1, len(w))))]
    for i, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for item, g in grams:
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    ids.add(item)
        want[(i, len(w))] = (len(hit), sorted(map(str, ids)))
    got = {(x.doc_id, x.n_words): (x.n_hit, list(x["items"])) for x in d.report(df, bench).collect()}
    assert got == want
    many = {(x.doc_id, x.n_words): (x.n_hit, list(x["items"])) for x in d.report(df, bench, block_items=1).collect()}  # a block for each item
    assert many == want
    clean = {(x.doc_id, x.text) for x in d.remove(df, bench).where("doc_id is null or doc_id >= 90").collect()}
    assert clean == {(90, None), (91, ""), (92, "x " * 40_000 + " x" * 9), (92, "x "), (None, " tail")}
    assert d.report(df, bench.limit(0)).where("contaminated").count() == 0
    assert d.remove(df.limit(0), bench).count() == 0


def test_a_worker_holds_one_block_and_long_texts_are_whole(spark):
    import pyarrow as pa

    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(30)]
    blocks = d.benchmark_blocks(spark.createDataFrame(items, "item_id long, text string"), block_items=4)
    assert len(blocks) == 8
    text = " ".join(["filler", "words"] * 200_000 + [t for _, t in items])
    n_words, n_hit, found, _ = d._scan(pa.RecordBatch.from_pydict({"text": [text, None]}), blocks)
    assert (n_words.tolist(), n_hit.tolist(), found) == ([400_360, 0], [360, 0], {0: set(range(30))})
    assert d._held[0] is blocks[-1] and len(d._held[1].items) <= 4
