"""The driver's queries over the library's operators.  Each takes (spark, sf_dir)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import FRAUD, LEGIT, NormalizationConfig, SearchConfig, TrainConfig
from ..engine import Engine
from ..functions import features, scalar
from ..operators import cells, ivf, kmeans, knn, sampling, score, search
from ..sources.readers import decode_requests, encode_response, request_error
from ..storage import kept, scratch
from ..streaming.score import read_stream, score_stream
from . import requests as rq

#: Ranges that suit the test events; values of ours.
NORMALIZATION = NormalizationConfig(500, 12, 10, 1_440, 1_000, 20, 100)
RISK = {"5411": 0.15, "5912": 0.2, "7801": 0.8}
SEEDS, ROUNDS, K = 16, 3, 5
#: One neighbour more than wanted, as a query's own row is left out.  The test vectors have no clusters, so most lists must be probed for a recall of 0.9.
CONFIG = SearchConfig(nprobe=14, fast_nprobe=12, k=K + 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, q (quantised) and label of the embeddings; labels below 3 play fraud."""
    label = F.when(F.col("label") < 3, FRAUD).otherwise(LEGIT)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_id"), scalar.quantize_array(F.col("embedding")).alias("q"), label.alias("label"))


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors as references, and those whose id is divisible by 100 as queries."""
    rows = vectors(spark, sf_dir)
    return rows, rows.where("ref_id % 100 = 0").select(F.col("ref_id").alias("query_id"), "q")


def others(neighbours: DataFrame) -> DataFrame:
    """The K nearest without a query's own row."""
    return knn.top_k(neighbours.where("ref_id <> query_id").drop("rank"), K).select("query_id", "rank", "ref_id", "d", "label")


def seeds(spark: SparkSession, sf_dir: str) -> np.ndarray:
    rows = vectors(spark, sf_dir).where(F.col("ref_id") < SEEDS).orderBy("ref_id").select("q").collect()
    return np.array([r["q"] for r in rows], np.float64)


def trained(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Quantised centroids after ROUNDS rounds of k-means over all vectors, from the first SEEDS vectors; whole numbers, so SQL gets the same."""
    c, points = seeds(spark, sf_dir), kept(vectors(spark, sf_dir), "points")
    for _ in range(ROUNDS):
        c, _ = kmeans.lloyd_step(points, c, c, "q")
        c = np.trunc(c + np.copysign(0.5, c))
    return c


def index(spark: SparkSession, sf_dir: str) -> ivf.IvfIndex:
    return ivf.build(split(spark, sf_dir)[0], trained(spark, sf_dir))


def empty_index(spark, sf_dir):
    """Answers of an index without references: none found, no votes, status 503."""
    own = ivf.build(vectors(spark, sf_dir).limit(0), np.zeros((0, 0)))
    queries = split(spark, sf_dir)[1]
    got = score.respond(score.classify(queries, search.knn_ivf(own, queries, CONFIG)))
    return got.select("query_id", "found", "votes", "approved", "status")


def quantize_embeddings(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("ref_id").alias("vec_id"), F.posexplode("q").alias("dim", "q"))


def _few(spark, sf_dir):
    return split(spark, sf_dir)[1]


def l2_pairs(spark, sf_dir):
    return knn.distances(vectors(spark, sf_dir), _few(spark, sf_dir))


def l2_threshold(spark, sf_dir):
    return knn.distances(vectors(spark, sf_dir), _few(spark, sf_dir), within=170_000_000)


def l2_neighbours(spark, sf_dir):
    """Distances of each vector to the one with the next id, in floating point and quantised."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", scalar.quantize_array(F.col("embedding")).alias("q"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"), F.col("q").alias("q2"))
    both = rows.join(after, "vec_id")
    return both.select("vec_id", F.round(scalar.l2_squared(F.col("embedding"), F.col("e2")), 6).alias("l2"), scalar.l2_within(F.col("q"), F.col("q2"), F.lit(200_000_000)).alias("within"))


def knn_exact(spark, sf_dir):
    return others(knn.knn_exact(*split(spark, sf_dir), K + 1))


def knn_classify(spark, sf_dir):
    return score.classify(split(spark, sf_dir)[1], knn_exact(spark, sf_dir)).drop("error")


def kth_distance(spark, sf_dir):
    return knn.kth_distance(knn_exact(spark, sf_dir), K)


def nearest_centroid(spark, sf_dir):
    got = kmeans.assign(vectors(spark, sf_dir), seeds(spark, sf_dir), "q")
    return got.select(F.col("ref_id").alias("vec_id"), "cluster_id", F.col("d2").cast("bigint").alias("d"))


def cluster_sizes(spark, sf_dir):
    c = seeds(spark, sf_dir)
    return ivf.cluster_sizes(kmeans.assign(vectors(spark, sf_dir), c, "q"), ivf.clusters_table(spark, c))


def cluster_sums(spark, sf_dir):
    got = kmeans.sums(vectors(spark, sf_dir), seeds(spark, sf_dir), None, "q")
    return got.select("cluster_id", "n", F.posexplode("s").alias("dim", "s")).withColumn("s", F.col("s").cast("bigint"))


def lloyd_step(spark, sf_dir):
    new, _ = kmeans.lloyd_step(vectors(spark, sf_dir), seeds(spark, sf_dir), None, "q")
    rows = [(i, j, round(float(x), 6)) for i, c in enumerate(new) for j, x in enumerate(c)]
    return spark.createDataFrame(rows, "cluster_id int, dim int, value double")


def assignment_changes(spark, sf_dir):
    points, before = vectors(spark, sf_dir), seeds(spark, sf_dir)
    after, _ = kmeans.lloyd_step(points, before, None, "q")
    return kmeans.sums(points, after, before, "q").agg(F.sum("changed").alias("changed"), F.sum("n").alias("n"))


def cluster_radii(spark, sf_dir):
    return ivf.radii(kmeans.assign(vectors(spark, sf_dir), seeds(spark, sf_dir), "q")).select("cluster_id", F.round("radius", 6).alias("radius"))


def list_offsets(spark, sf_dir):
    return index(spark, sf_dir).centroids.select("cluster_id", "n", "list_start")


def block_offsets(spark, sf_dir):
    return index(spark, sf_dir).centroids.select("cluster_id", "blocks", "block_start")


def lane_placement(spark, sf_dir):
    return index(spark, sf_dir).lists.select("ref_id", "cluster_id", "slot", "block", "lane")


def padded_blocks(spark, sf_dir):
    own = index(spark, sf_dir)
    return ivf.padded_blocks(own.lists, own.centroids)


def centroids_transposed(spark, sf_dir):
    return ivf.transposed(index(spark, sf_dir).centroids)


def probe_lists(spark, sf_dir):
    return search.probes(index(spark, sf_dir), split(spark, sf_dir)[1], 1, CONFIG.nprobe).select("query_id", "rank", "cluster_id", "d")


def ivf_fast(spark, sf_dir):
    return others(search.knn_ivf(index(spark, sf_dir), split(spark, sf_dir)[1], CONFIG, adaptive=False))


def ivf_adaptive(spark, sf_dir):
    return others(search.knn_ivf(index(spark, sf_dir), split(spark, sf_dir)[1], CONFIG))


def bound_pruned_knn(spark, sf_dir):
    return others(search.knn_bound_exact(index(spark, sf_dir), split(spark, sf_dir)[1], CONFIG))


def ivf_recall(spark, sf_dir):
    found = ivf_adaptive(spark, sf_dir).select("query_id", "ref_id", F.lit(1).alias("hit"))
    exact = knn_exact(spark, sf_dir).select("query_id", "ref_id")
    return exact.join(found, ["query_id", "ref_id"], "left").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))


def classify_ivf(spark, sf_dir):
    return score.classify(split(spark, sf_dir)[1], ivf_adaptive(spark, sf_dir)).drop("error")


def _wide(c):
    return F.round(c.cast("double"), 6)


def feature_clamp(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", _wide(scalar.clamp_ratio(F.col("o_totalprice"), 250_000)).alias("amount"))


def amount_vs_avg(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    mean = orders.groupBy(F.col("o_custkey").alias("c")).agg((F.sum("cents").cast("double") / F.count("*") / 100).alias("mean"))
    both = orders.join(mean, F.col("o_custkey") == F.col("c"))
    return both.select("o_orderkey", _wide(scalar.amount_vs_average(F.col("o_totalprice"), F.col("mean"), 10)).alias("ratio"))


def time_features(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", _wide(scalar.divide(scalar.f32(F.hour(ts)), scalar.f32(23))).alias("hour_of_day"), _wide(scalar.divide(scalar.f32(F.weekday(ts)), scalar.f32(6))).alias("day_of_week"))


def minutes_since_last(spark, sf_dir):
    rows = rq.derived(table(spark, sf_dir, "events"))
    last = F.when(F.col("last_micros").isNotNull(), F.struct(rq.iso(F.col("last_micros")).alias("timestamp"), F.lit(0.0).alias("km_from_current")))
    rows = rows.withColumn("last", last).withColumn("then", scalar.parse_utc(F.col("last.timestamp")))
    minutes, _ = features.since_last(F.col("last"), F.col("then"), F.timestamp_micros("micros"), NORMALIZATION)
    return rows.select("event_id", _wide(minutes).alias("minutes"))


def known_merchant(spark, sf_dir):
    rows = rq.requests(table(spark, sf_dir, "events"))
    return rows.select("event_id", features.unknown_merchant(F.col("customer.known_merchants"), F.col("merchant.id")).cast("int").alias("unknown_merchant"))


def mcc_risk_lookup(spark, sf_dir):
    rows = rq.requests(table(spark, sf_dir, "events"))
    got = features.with_mcc_risk(rows, F.col("merchant.mcc"), features.mcc_table(spark, RISK))
    return got.select("event_id", F.col("merchant.mcc").alias("mcc"), _wide(F.col("mcc_risk")).alias("mcc_risk"))


def event_vectors(spark, sf_dir) -> DataFrame:
    return features.vectorize(rq.requests(table(spark, sf_dir, "events")), NORMALIZATION, RISK).select("event_id", "vector")


def vectorize_events(spark, sf_dir):
    rows = event_vectors(spark, sf_dir).select("event_id", F.posexplode_outer("vector").alias("dim", "value"))  # outer: no filter that evaluates the vector once more
    return rows.select("event_id", "dim", _wide(F.col("value")).alias("value"))


def request_json_roundtrip(spark, sf_dir):
    rows = rq.requests(table(spark, sf_dir, "events"))
    names = [x.strip().split()[0] for x in ("id", "transaction", "customer", "merchant", "terminal", "last_transaction")]
    sent = rows.select(F.to_json(F.struct(*names)).alias("value"))
    got = decode_requests(sent).drop("value")
    c = F.col
    return got.select(
        c("id").cast("bigint").alias("event_id"), c("transaction.amount").alias("amount"), c("transaction.installments").alias("installments"), c("customer.tx_count_24h").alias("tx_24h"), F.size("customer.known_merchants").alias("n_known"),
        c("merchant.mcc").alias("mcc"), c("terminal.is_online").alias("is_online"), c("last_transaction.km_from_current").alias("km"), request_error().isNull().alias("valid"),
    )


def timestamp_validation(spark, sf_dir):
    rows = rq.requests(table(spark, sf_dir, "events"))
    now = F.col("transaction.requested_at")
    kind = F.col("event_id") % 5
    broken = F.when(kind == 1, "not-a-timestamp").when(kind == 2, F.substring(now, 1, 10)).when(kind == 3, F.substring(now, 1, 19)).when(kind == 4, F.concat(F.substring(now, 1, 19), F.lit("+02:00"))).otherwise(now)
    rows = rows.withColumn("transaction", F.col("transaction").withField("requested_at", broken))
    sent = rows.withColumn("error", request_error())
    answered = score.respond(sent.withColumn("approved", F.lit(True)).withColumn("fraud_score", F.lit(0.0)))
    return answered.select("event_id", "status", "error", F.hour(scalar.parse_utc(F.col("transaction.requested_at"))).alias("utc_hour"))


def response_encode(spark, sf_dir):
    got = knn_classify(spark, sf_dir)
    return got.select("query_id", encode_response(F.col("approved"), F.col("fraud_score")).alias("body"))


def _labelled(rows: DataFrame, *more: str) -> DataFrame:
    """ref_id, vector and label of events with vectors; every third plays fraud."""
    return rows.select(F.col("event_id").alias("ref_id"), "vector", F.when(F.col("event_id") % 3 == 0, FRAUD).otherwise(LEGIT).alias("label"), *more)


def score_events(spark, sf_dir):
    rows = kept(_labelled(event_vectors(spark, sf_dir)).select("ref_id", scalar.quantize_array(F.col("vector")).alias("q"), "label"), "events")
    queries = kept(rows.where("ref_id % 100 = 0").select(F.col("ref_id").alias("query_id"), "q"), "queries")
    return score.classify(queries, others(cells.knn_cells(rows, queries, K + 1))).drop("error")


def stream_score(spark, sf_dir):
    """The same through the engine: an index over all labelled events, and those whose id is divisible by 100 as a stream of JSON files.  The
    engine can't know a request's own event, which so counts among its neighbours."""
    names = [x.strip().split()[0] for x in ("id", "transaction", "customer", "merchant", "terminal", "last_transaction")]
    sent = F.when(F.col("event_id") % 100 == 0, F.to_json(F.struct(*names)))  # beside the vectors, so that the features are derived once
    rows = kept(_labelled(features.vectorize(rq.requests(table(spark, sf_dir, "events")).withColumn("value", sent), NORMALIZATION, RISK), "value"), "events")
    engine = Engine.train(rows.drop("value"), NORMALIZATION, RISK, TrainConfig(clusters=8, rounds=4), SearchConfig(nprobe=8, fast_nprobe=8, k=K))
    folder = scratch(spark, "stream")
    rows.where("ref_id % 100 = 0").select("value").write.text(f"{folder}/in")
    score_stream(engine, read_stream(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    got = spark.read.schema("id string, approved boolean, fraud_score float, status int, body string").parquet(f"{folder}/out/batch=*")
    return got.select(F.col("id").cast("bigint").alias("event_id"), "approved", _wide(F.col("fraud_score")).alias("fraud_score"), "status")


def reservoir_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id")
    return sampling.reservoir(rows, 200, 42, "event_id").select("slot", "event_id")


def _float_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector"))


def kmeans_train(spark, sf_dir):
    model = kmeans.train(_float_vectors(spark, sf_dir), TrainConfig(clusters=SEEDS))
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.centroids)], "cluster_id int, centroid array<double>")


def kmeans_pp(spark, sf_dir):
    config = TrainConfig(clusters=SEEDS)
    rows = sampling.reservoir(_float_vectors(spark, sf_dir), config.sample, config.seed, "ref_id").orderBy("slot").collect()
    seeds_ = kmeans.plus_plus(np.array([r["vector"] for r in rows], np.float64), config.clusters, config.seed)
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(seeds_)], "cluster_id int, centroid array<double>")


def index_roundtrip(spark, sf_dir):
    """The exchange format, written and read back: the lists as they were."""
    own = index(spark, sf_dir)
    path = f"{scratch(spark, 'exchange')}/index.bin"
    ivf.export_binary(own, path)
    dims = len(own.matrix()[1][0])
    return kept(ivf.import_binary(spark, path, dims), "imported").select("ref_id", "cluster_id", "label", F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a * 3 % 1_000_003 + x).alias("digest"))


NAMES = (
    "quantize_embeddings l2_pairs l2_threshold l2_neighbours knn_exact knn_classify kth_distance nearest_centroid cluster_sizes cluster_sums lloyd_step assignment_changes cluster_radii list_offsets block_offsets lane_placement"
    " padded_blocks centroids_transposed probe_lists ivf_fast ivf_adaptive bound_pruned_knn ivf_recall classify_ivf feature_clamp amount_vs_avg time_features minutes_since_last known_merchant mcc_risk_lookup vectorize_events"
    " request_json_roundtrip timestamp_validation response_encode score_events stream_score reservoir_sample kmeans_train kmeans_pp index_roundtrip empty_index"
).split()
QUERIES = {name: globals()[name] for name in NAMES}
