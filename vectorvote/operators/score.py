"""Votes, scores and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.readers import encode_error, encode_response

UNAVAILABLE = "no neighbours"


def classify(queries: DataFrame, neighbours: DataFrame, threshold: float = 0.6) -> DataFrame:
    """query_id, found, votes, fraud_score (votes / found) and approved (below the threshold), a row for every query; with an error where nothing was found."""
    votes = neighbours.groupBy("query_id").agg(F.count("*").alias("found"), F.count_if(F.col("label") == "fraud").alias("votes"))
    zero = F.lit(0).cast("bigint")
    every = queries.select("query_id").join(votes, "query_id", "left").select("query_id", F.coalesce("found", zero).alias("found"), F.coalesce("votes", zero).alias("votes"))
    score = F.try_divide(F.col("votes").cast("double"), F.col("found").cast("double"))
    return every.withColumn("fraud_score", score).withColumn("approved", F.col("fraud_score") < threshold).withColumn("error", F.when(F.col("found") == 0, UNAVAILABLE))


def respond(scored: DataFrame) -> DataFrame:
    """Adds status (200; 400 for a bad request, 503 without neighbours) and body."""
    status = F.when(F.col("error").isNull(), 200).when(F.col("error") == UNAVAILABLE, 503).otherwise(400)
    body = F.when(F.col("error").isNull(), encode_response(F.col("approved"), F.col("fraud_score"))).otherwise(encode_error(F.col("error")))
    return scored.withColumn("status", status).withColumn("body", body)
