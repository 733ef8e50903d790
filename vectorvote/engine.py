"""The engine: configuration, an index, and scoring of batches and streams of requests."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import SCALE, NormalizationConfig, SearchConfig, TrainConfig
from .functions.features import vectorize
from .functions.scalar import quantize_array
from .operators import ivf, score, search
from .sources.readers import load_mcc_risk, read_references, request_error
from .storage import kept


class EngineError(RuntimeError):
    pass


@dataclass
class Engine:
    normalization: NormalizationConfig
    risk: dict[str, float]
    index: ivf.IvfIndex
    config: SearchConfig = field(default_factory=SearchConfig)

    def __post_init__(self):
        if self.reference_count() < self.config.k:
            raise EngineError(f"the index needs at least {self.config.k} references")

    @classmethod
    def load(cls, spark: SparkSession, resources: str, index: str, config: SearchConfig | None = None) -> Engine:
        """From the folder of normalization.json and mcc_risk.json, and a saved index."""
        return cls(NormalizationConfig.load(f"{resources}/normalization.json"), load_mcc_risk(f"{resources}/mcc_risk.json"), ivf.IvfIndex.load(spark, index), config or SearchConfig.from_env())

    @classmethod
    def train(cls, references: DataFrame, normalization: NormalizationConfig, risk: dict[str, float], train: TrainConfig = TrainConfig(), config: SearchConfig = SearchConfig()) -> Engine:
        """From labelled vectors (ref_id, vector, label)."""
        return cls(normalization, risk, ivf.train_index(references, train), config)

    @classmethod
    def train_from_json(cls, spark: SparkSession, path: str, normalization: NormalizationConfig, risk: dict[str, float], train: TrainConfig = TrainConfig(), config: SearchConfig = SearchConfig()) -> Engine:
        return cls.train(read_references(spark, path), normalization, risk, train, config)

    def reference_count(self) -> int:
        return self.index.centroids.agg(F.sum("n")).first()[0] or 0

    def is_ready(self) -> bool:
        return self.reference_count() >= self.config.k

    def classify_knn(self, vectors: DataFrame) -> DataFrame:
        """found, votes, fraud_score and approved of vectors (query_id, vector)."""
        queries = vectors.select("query_id", quantize_array(F.col("vector"), SCALE).alias("q"))
        return score.classify(queries, search.knn_ivf(self.index, queries, self.config), self.config.threshold)

    def score_batch(self, requests: DataFrame) -> DataFrame:
        """id, approved, fraud_score, status and body for request rows; bad requests get their error, not an exception."""
        rows = requests.withColumn("error", request_error()).withColumn("query_id", F.xxhash64("id", F.to_json(F.struct("transaction", "customer", "merchant", "terminal", "last_transaction"))))
        vector = F.when(F.col("error").isNull(), F.col("vector")).alias("vector")
        rows = kept(vectorize(rows, self.normalization, self.risk).select("id", "query_id", "error", vector), "requests")
        scored = self.classify_knn(rows.where("error is null").select("query_id", "vector").dropDuplicates(["query_id"])).withColumnRenamed("error", "unavailable")
        both = rows.select("id", "query_id", "error").join(scored, "query_id", "left").withColumn("error", F.coalesce("error", "unavailable"))
        return score.respond(both).select("id", "approved", F.col("fraud_score").cast("float").alias("fraud_score"), "status", "body")
