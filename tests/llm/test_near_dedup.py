import numpy as np
import pytest

from vectorvote.llm import near_dedup as nd
from vectorvote.llm.components import components, spread_join


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 480)] + [(500, k) for k in range(501, 560)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    assert {x.node: x.root for x in components(df).collect()} == root
    # tasks that see few edges each need rounds
    assert {x.node: x.root for x in components(df, task_edges=40).collect()} == root
    assert components(df.limit(0)).count() == 0


def test_hot_keys_are_spread(spark):
    left = spark.createDataFrame([(k, k % 7 if k % 3 else 100) for k in range(900)], "k long, key long")
    right = spark.createDataFrame([(k, -k) for k in (0, 1, 2, 3, 100)], "key long, v long")
    got = {x.k: (x.key, x.v) for x in spread_join(left, right, "key", "k", 50).collect()}
    assert got == {k: (key, {0: 0, 1: -1, 2: -2, 3: -3, 100: -100}.get(key)) for k, key in ((k, k % 7 if k % 3 else 100) for k in range(900))}


def test_node_names_follow_doc_id(spark):
    ids = [None, -(1 << 63), -5, -1, 0, 3, 1 << 40, (1 << 63) - 1]
    rows = spark.createDataFrame([(i, 7) for i in ids], "doc_id long, th long").groupBy("doc_id").agg(nd._first()).withColumn("key", nd._key())
    got = rows.select("key", nd._doc_id("key").alias("i")).orderBy("key").collect()
    assert [x.i for x in got] == [*ids[1:], None] and all(len(x.key) == 16 for x in got)


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for _ in range(len(rows)):
        before = list(comp)
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            break
    ids = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in set(comp)}
    return [(rows[k][0], len(sets[k]), ids[comp[k]]) for k in range(len(rows))]


@pytest.mark.parametrize("words", [4, 5])
def test_against_brute_force(spark, words):
    r = np.random.default_rng(words)
    vocab = [f"w{k}" for k in range(60)]
    rows, base = [], [list(r.choice(vocab, int(n))) for n in r.integers(8, 120, 12)]
    for k in range(160):
        t = list(base[int(r.integers(0, len(base)))])
        for _ in range(int(r.integers(0, 4))):
            t[int(r.integers(0, len(t)))] = "x%d" % r.integers(0, 9)
        rows.append((int(k), " ".join(t)))
    rows += [(900, None), (901, ""), (902, "  \n"), (903, "a b"), (904, "A\tb"), (905, "b a"), (5, rows[5][1]), (None, rows[7][1]), (None, "only null here again and again"), (906, "long " * 9000 + "tail"), (907, "long " * 9000 + "tail")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, root int")
    want = sorted(map(str, brute(rows, words, 80)))
    got = nd.cluster(df, words, 80)
    assert sorted(str((x.doc_id, x.n_shingles, x.component_id)) for x in got.collect()) == want
    stay = nd.keep_first(df, words, 80)
    assert stay.columns == df.columns
    ids = [x.doc_id for x in stay.collect()]
    full = brute(rows, words, 80)
    assert sorted(map(str, ids)) == sorted(map(str, [*{i for i, n, c in full if n and i is not None and i == c}, 900, 901, 902, None]))
    assert nd.cluster(df.limit(0)).count() == 0


def test_pairs_in_a_large_region(spark):
    # texts that share a template, at a Jaccard similarity of 0.7 or so; every one has a partner, at 0.85 or so
    shared = " ".join(f"t{k}" for k in range(250))
    rows = []
    for k in range(400):
        own = [f"a{k}x{i}" for i in range(45)]
        rows += [(2 * k, f"{shared} {' '.join(own)}"), (2 * k + 1, f"{shared} {' '.join(own[:25])} {' '.join(f'b{k}x{i}' for i in range(20))}")]
    got = {x.doc_id: x.component_id for x in nd.cluster(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == {i: i // 2 * 2 for i in got}
