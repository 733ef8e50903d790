import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorvote.config import NormalizationConfig, SearchConfig, TrainConfig
from vectorvote.engine import Engine, EngineError
from vectorvote.operators import ivf, kmeans, knn, sampling, score, search
from vectorvote.operators.order import numbered
from vectorvote.functions.random import bounded


def frames(spark, points, labels, queries):
    refs = spark.createDataFrame([(i, [int(x) for x in p], l) for i, (p, l) in enumerate(zip(points, labels))], "ref_id long, q array<int>, label string").repartition(3)
    asks = spark.createDataFrame([(i, [int(x) for x in p]) for i, p in enumerate(queries)], "query_id long, q array<int>")
    return refs, asks


def brute(points, queries, k):
    return {i: [(int(d), int(j)) for d, j in sorted(zip(((points - q) ** 2).sum(1), range(len(points))))[:k]] for i, q in enumerate(queries)}


def as_dict(rows):
    out = {}
    for r in rows.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.d, r.ref_id))
    return out


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(4)
    centres = r.integers(-8000, 8000, (12, 14))
    points = np.clip(centres[r.integers(0, 12, 900)] + r.normal(0, 900, (900, 14)).astype(int), -10000, 10000)
    points[100:140] = points[100]  # ties across rank k
    labels = np.where(r.integers(0, 3, 900) == 0, "fraud", "legit").tolist()
    return points, labels, np.vstack([points[:25] + 30, points[100:101], centres[:4]]), points[r.choice(900, 12, replace=False)]


def test_exact(spark, clustered):
    points, labels, queries, _ = clustered
    refs, asks = frames(spark, points, labels, queries)
    want = brute(points, queries, 5)
    assert as_dict(knn.knn_exact(refs, asks, 5)) == want
    assert as_dict(knn.knn_exact(refs.repartition(7), asks, 5)) == want
    assert as_dict(knn.knn_exact(refs.limit(3), asks, 5)).keys() == want.keys()
    assert knn.knn_exact(refs, asks.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        knn.knn_exact(refs, asks, 0)


def test_wide_distances_do_not_overflow():
    a, b = np.full((1, 14), 5000.0), np.full((1, 14), -5000.0)
    assert knn.squared_distances(a, b)[0, 0] == 1_400_000_000
    q = np.arange(100, 1500, 100.0)[None]
    assert knn.squared_distances(q, q + 50)[0, 0] == 35_000


def test_threshold_keeps_equality(spark):
    q = [list(range(100, 1500, 100))]
    refs, asks = frames(spark, np.array(q) + 50, ["fraud"], q)
    assert [knn.distances(refs, asks, within=t).first()["d"] for t in (30_000, 35_000, 40_000)] == [None, 35_000, 35_000]


def test_index_searches(spark, clustered):
    points, labels, queries, centroids = clustered
    refs, asks = frames(spark, points, labels, queries)
    index = ivf.build(refs, centroids)
    assert index.centroids.agg(F.sum("n")).first()[0] == 900
    want = brute(points, queries, 5)
    every = SearchConfig(nprobe=12, fast_nprobe=12)
    assert as_dict(search.knn_ivf(index, asks, every)) == want
    assert as_dict(search.knn_bound_exact(index, asks, SearchConfig(nprobe=12, fast_nprobe=1))) == want
    got = as_dict(search.knn_ivf(index, asks, SearchConfig(nprobe=6, fast_nprobe=2)))
    hits = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hits >= 0.8 * 5 * len(want)
    # what the second phase adds never loses a neighbour of the first
    fast = as_dict(search.knn_ivf(index, asks, SearchConfig(nprobe=6, fast_nprobe=2), adaptive=False))
    assert all(got[i][j] <= fast[i][j] for i in got for j in range(len(fast[i])))


def test_bound_inside_a_ball(spark):
    """The query lies deep in a large ball whose centroid is farther than another list's."""
    points = np.array([[0, 0], [20, 0], [-20, 0], [9, 0], [100, 0], [101, 0], [102, 0], [14, 8], [15, 8]])
    refs, asks = frames(spark, points, ["legit"] * 9, [[10, 0]])
    index = ivf.build(refs, np.array([[0, 0], [14, 8], [101, 0]]))
    want = brute(points, np.array([[10, 0]]), 3)
    assert as_dict(search.knn_bound_exact(index, asks, SearchConfig(nprobe=3, fast_nprobe=1, k=3))) == want


def test_votes_and_few_candidates(spark):
    near = spark.createDataFrame([(1, "fraud")] * 3 + [(1, "legit")] * 2 + [(2, "fraud"), (2, "legit")], "query_id long, label string")
    got = {r.query_id: r for r in score.respond(score.classify(spark.createDataFrame([(1,), (2,), (3,)], "query_id long"), near)).collect()}
    assert (got[1].votes, got[1].approved, got[1].status) == (3, False, 200)  # 3 of 5 is denied
    assert (got[2].found, got[2].fraud_score, got[2].approved) == (2, 0.5, True)
    assert (got[3].found, got[3].approved, got[3].status) == (0, None, 503) and "error" in json.loads(got[3].body)


def test_reservoir_like_the_sequential_one(spark):
    n, size, seed = 700, 37, 12345
    want = list(range(size))
    for i in range(size, n):
        j = int(bounded(seed, np.array([i - size + 1]), np.array([i + 1]))[0])
        if j < size:
            want[j] = i
    rows = spark.range(n).select((F.col("id") * 10).alias("key")).repartition(5)
    got = sampling.reservoir(rows, size, seed, "key").orderBy("slot").collect()
    assert [r.key // 10 for r in got] == want and [r.slot for r in got] == list(range(size))
    assert sorted(r.place for r in numbered(rows, "key").collect()) == list(range(n))


def test_kmeans(spark):
    r = np.random.default_rng(0)
    centres = np.array([[0, 0], [10, 0], [0, 10.0]])
    x = np.vstack([c + r.normal(0, 0.3, (80, 2)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ref_id long, vector array<double>")
    model = kmeans.train(df, TrainConfig(clusters=3, sample=100))
    assert np.abs(np.sort(model.centroids.round(), 0) - np.sort(centres, 0)).max() <= 0.5 and model.changed <= 8
    # an empty cluster keeps its centroid, and ties go to the first
    far = np.array([[0.0, 0], [0, 0], [900, 900]])
    new, changed = kmeans.lloyd_step(df, far)
    assert (new[2] == far[2]).all() and (new[1] == far[1]).all() and changed == 240
    assert len(kmeans.train(df.limit(0), TrainConfig(clusters=3)).centroids) == 0
    with pytest.raises(ValueError):
        kmeans.train(df.limit(2), TrainConfig.offline(clusters=3))
    same = np.zeros((5, 2))
    assert kmeans.plus_plus(same, 3, 1).shape == (3, 2)


def sequential_draws(seed):
    """The generator, number by number."""
    from vectorvote.functions import random

    mask = (1 << 64) - 1
    while True:
        seed = (seed + random.GAMMA) & mask
        z = seed
        z = ((z ^ (z >> 30)) * random.FIRST) & mask
        z = ((z ^ (z >> 27)) * random.SECOND) & mask
        yield z ^ (z >> 31)


def test_seeds_and_rounds_one_by_one(spark):
    """k-means++ seed by seed and Lloyd's rounds point by point, in plain Python, against the operators."""
    r = np.random.default_rng(8)
    points = (r.normal(size=(150, 3)) + 4 * r.integers(0, 4, (150, 1))).tolist()
    seed, k = 1234, 5

    def away(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    draw = sequential_draws(seed)
    chosen = [next(draw) % 150]
    for _ in range(k - 1):
        near = [min(away(p, points[c]) for c in chosen) for p in points]
        target, total = np.float32(next(draw) >> 40) / np.float32(1 << 24), 0.0
        target = float(target) * sum(near)
        for i, d in enumerate(near):
            total += d
            if total > target:
                break
        chosen.append(i)
    assert kmeans.plus_plus(np.array(points), k, seed).tolist() == [points[c] for c in chosen]

    order = list(range(150))  # a reservoir as large as the table holds the rows in their order
    centroids, before, rounds, changed = [points[c] for c in chosen], None, 0, 150
    for rounds in range(1, 26):
        now = [min(range(k), key=lambda c: (away(points[i], centroids[c]), c)) for i in order]
        changed = sum(a != b for a, b in zip(now, before)) if before else 150
        groups = [[points[i] for i in order if now[i] == c] for c in range(k)]
        centroids = [[sum(x) / len(g) for x in zip(*g)] if g else centroids[c] for c, g in enumerate(groups)]
        before = now
        if rounds > 1 and changed <= 8:
            break
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "ref_id long, vector array<double>").repartition(3)
    model = kmeans.train(df, TrainConfig(clusters=k, seed=seed))
    assert (model.rounds, model.changed) == (rounds, changed) and np.allclose(model.centroids, centroids, atol=1e-9)


def test_empty_index(spark, tmp_path):
    """An index of nothing can be built, saved, exported and searched; it answers that it is not available."""
    refs, asks = frames(spark, np.zeros((0, 14)), [], [[1] * 14, [2] * 14])
    vectors = spark.createDataFrame([], "ref_id long, vector array<float>, label string")
    index = ivf.train_index(vectors, TrainConfig(clusters=4))
    index.save(str(tmp_path / "empty"))
    for own in (index, ivf.IvfIndex.load(spark, str(tmp_path / "empty"))):
        for found in (search.knn_ivf(own, asks), search.knn_bound_exact(own, asks)):
            got = score.respond(score.classify(asks, found)).collect()
            assert [(x.found, x.votes, x.status) for x in got] == [(0, 0, 503)] * 2
    assert ivf.export_binary(index, str(tmp_path / "e.bin")) > 0 and ivf.import_binary(spark, str(tmp_path / "e.bin")).count() == 0
    assert knn.knn_exact(refs, asks, 5).count() == 0


def test_many_queries_of_one_list_are_sliced(spark, clustered, monkeypatch):
    points, labels, queries, centroids = clustered
    monkeypatch.setattr(search, "QUERY_SLICE", 4)
    refs, asks = frames(spark, points, labels, queries)
    index = ivf.build(refs, centroids)
    assert as_dict(search.knn_ivf(index, asks, SearchConfig(nprobe=12, fast_nprobe=12))) == brute(points, queries, 5)
    assert as_dict(search.knn_bound_exact(index, asks, SearchConfig(nprobe=12, fast_nprobe=1))) == brute(points, queries, 5)


def test_engine_and_stream(spark, tmp_path):
    from tests.test_scalar import request
    from vectorvote.streaming.score import read_stream, score_stream

    r = np.random.default_rng(2)
    refs = spark.createDataFrame([(i, r.random(14).astype(np.float32).tolist(), "fraud" if i % 3 == 0 else "legit") for i in range(300)], "ref_id long, vector array<float>, label string")
    config = NormalizationConfig(10_000, 12, 10, 1_440, 1_000, 20, 10_000)
    engine = Engine.train(refs, config, {"5411": 0.15}, TrainConfig(clusters=6, rounds=3), SearchConfig(nprobe=6, fast_nprobe=2))
    assert engine.reference_count() == 300 and engine.is_ready()
    bad = request(id="bad", transaction={"amount": 1.0, "installments": 1, "requested_at": "not-a-timestamp"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(x) for x in (request(id="a"), bad, request(id="b", last_transaction={"timestamp": "2026-03-11T18:40:00Z", "km_from_current": 5.0}))))
    score_stream(engine, read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {x.id: x for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (got["bad"].status, json.loads(got["bad"].body)["error"]) == (400, "invalid timestamp: not-a-timestamp")
    for k in "ab":
        assert 0 <= got[k].fraud_score <= 1 and got[k].approved == (got[k].fraud_score < 0.6) and json.loads(got[k].body)["approved"] == got[k].approved
    engine.index.save(str(tmp_path / "index"))
    again = ivf.IvfIndex.load(spark, str(tmp_path / "index"))
    assert ivf.export_binary(again, str(tmp_path / "x.bin")) == 16 + 56 * 6 + 4 * 6 + 4 * 7 + 232 * again.centroids.agg(F.sum("blocks")).first()[0]
    with pytest.raises(EngineError):
        Engine.train(refs.limit(4), config, {}, TrainConfig(clusters=2))


def test_build_and_load(spark, tmp_path):
    from vectorvote import build
    from vectorvote.config import ConfigError

    r = np.random.default_rng(7)
    rows = [{"vector": [round(float(x), 4) for x in r.random(14)], "label": "fraud" if i % 4 == 0 else "legit"} for i in range(120)]
    (tmp_path / "refs.json").write_text(json.dumps(rows))
    build.main([str(tmp_path / "refs.json"), str(tmp_path / "index"), "--clusters", "4", "--rounds", "3", "--binary", str(tmp_path / "i.bin")])
    (tmp_path / "normalization.json").write_text(json.dumps({f: 10.0 for f in NormalizationConfig.__dataclass_fields__}))
    (tmp_path / "mcc_risk.json").write_text(json.dumps({"5411": 0.15}))
    engine = Engine.load(spark, str(tmp_path), str(tmp_path / "index"), SearchConfig(nprobe=4, fast_nprobe=4))
    assert engine.reference_count() == 120
    got = engine.classify_knn(spark.createDataFrame([(1, rows[0]["vector"])], "query_id long, vector array<float>")).first()
    x = np.round(np.array([q["vector"] for q in rows], np.float32) * 10000)
    near = np.lexsort((np.arange(120), ((x - x[0]) ** 2).sum(1)))[:5]
    assert (got.found, got.votes) == (5, sum(k % 4 == 0 for k in near))
    back = ivf.import_binary(spark, str(tmp_path / "i.bin"))
    assert back.count() == 120 and back.where("label = 'fraud'").count() == 30
    (tmp_path / "mcc_risk.json").write_text("[]")
    with pytest.raises(ConfigError):
        Engine.load(spark, str(tmp_path), str(tmp_path / "index"))
