"""Requests and references from JSON, with validation per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import DIMENSIONS, FRAUD, LEGIT, ConfigError, load_json
from ..functions.scalar import parse_utc
from .schemas import REFERENCE, REQUEST, REQUIRED

#: Largest unsigned 32-bit integer.
U32_MAX = 4_294_967_295


def decode_requests(rows: DataFrame, column: str = "value") -> DataFrame:
    """Adds a request's columns, parsed from a JSON string; unknown keys are ignored."""
    parsed = rows.withColumn("__request", F.from_json(column, REQUEST))
    return parsed.select(*[c for c in rows.columns], "__request.*")


def request_error() -> Column:
    """Why a request can't be scored, or null."""
    c = F.col
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | c(name).isNull()
    last = c("last_transaction")
    missing = missing | F.exists(c("customer.known_merchants"), lambda x: x.isNull())
    missing = missing | (last.isNotNull() & (last["timestamp"].isNull() | last["km_from_current"].isNull()))
    unsigned = c("transaction.installments").between(0, U32_MAX) & c("customer.tx_count_24h").between(0, U32_MAX)
    bad = lambda t: F.concat(F.lit("invalid timestamp: "), t)
    when, then = c("transaction.requested_at"), last["timestamp"]
    return (
        F.when(F.coalesce(missing, F.lit(True)), "missing or mistyped field")
        .when(~unsigned, "count out of range")
        .when(parse_utc(when).isNull(), bad(when))
        .when(then.isNotNull() & parse_utc(then).isNull(), bad(then))
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of JSON files, a request a line or an array of them, with an `error` column."""
    return spark.read.schema(REQUEST).option("multiLine", True).json(path).withColumn("error", request_error())


def reference_error(dimensions: int = DIMENSIONS) -> Column:
    v, label = F.col("vector"), F.col("label")
    return F.when(v.isNull() | (F.size(v) != dimensions) | F.exists(v, lambda x: x.isNull()), "vector must have all its numbers").when(label.isNull() | ~label.isin(FRAUD, LEGIT), "label must be fraud or legit")


def read_references(spark: SparkSession, path: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Labelled vectors of JSON arrays, gzipped or not: ref_id (rising in a file's order), vector and label, all rows valid or an error when
    it runs.  Spark parses an array in one pass, one task a file, without holding it; several files are read in parallel."""
    rows = spark.read.schema(REFERENCE).option("multiLine", True).json(path)
    wrong = reference_error(dimensions)
    valid = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("array<float>")).otherwise(F.col("vector"))
    return rows.select(F.monotonically_increasing_id().alias("ref_id"), valid.alias("vector"), "label")


def load_mcc_risk(path: str) -> dict[str, float]:
    raw = load_json(path)
    if not isinstance(raw, dict) or not all(isinstance(v, (int, float)) for v in raw.values()):
        raise ConfigError(f"{path}: must map categories to numbers")
    return {k: float(v) for k, v in raw.items()}


def encode_response(approved: Column, fraud_score: Column) -> Column:
    return F.to_json(F.struct(approved.alias("approved"), fraud_score.cast("float").alias("fraud_score")))


def encode_error(error: Column) -> Column:
    return F.to_json(F.struct(error.alias("error")))
