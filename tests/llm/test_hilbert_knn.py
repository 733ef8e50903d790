import numpy as np
from pyspark.sql import functions as F

from vectorvote.llm import hilbert_knn as hk


def test_curve():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hk.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()  # each step goes to a neighbouring cell


def brute(rows, k=5):
    live = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            live[i, tuple(v)] = np.array(v, np.float32).astype(float)
    out = {}
    for (i, v), x in live.items():
        if i % 50 == 0:
            s = sorted((-(x @ y) / np.sqrt((x @ x) * (y @ y)), j) for (j, w), y in live.items() if j != i and len(w) == len(v))
            out[i] = [(j, -d) for d, j in s[:k]]
    return out


def test_against_brute_force(spark):
    r = np.random.default_rng(0)
    rows = [(k, r.normal(size=16).astype(np.float32).tolist()) for k in range(1500)]
    same = r.normal(size=16).astype(np.float32).tolist()
    rows += [(2000 + k, same) for k in range(200)] + [(1, rows[1][1]), (50, rows[50][1])]  # a hot vector and repeated rows
    rows += [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] * 16), (3150, [1.0, None] * 8), (3200, [float("inf")] * 16), (None, rows[3][1]), (3250, [1.0, 2.0]), (3251, [2.0, 1.0])]
    df = spark.createDataFrame([(*x, 3) for x in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = {}
    for x in hk.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute(rows)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [x[0] for x in found] == list(range(1, len(found) + 1))
        exact = dict(want[q])
        hits += sum(j in exact for _, j, _ in found)
        assert all(abs(exact[j] - s) < 1e-12 for _, j, s in found if j in exact)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert [j for _, j, _ in got[2050]] == [2000, 2001, 2002, 2003, 2004]
    assert [j for _, j, _ in got[3250]] == [3251]
    assert hk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
