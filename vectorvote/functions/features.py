"""The 14 features of a scoring request, from its nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import UNKNOWN_MCC_RISK, NormalizationConfig
from .scalar import amount_vs_average, bool_to_unit, clamp, clamp_ratio, divide, f32, parse_utc, whole_seconds

#: Order of the vector.
FEATURES = ("amount", "installments", "amount_vs_avg", "hour_of_day", "day_of_week", "minutes_since_last_tx", "km_from_last_tx", "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_avg_amount")
MISSING = -1.0


def unknown_merchant(known: Column, merchant: Column) -> Column:
    return F.when(F.coalesce(F.array_contains(known, merchant), F.lit(False)), f32(0)).otherwise(f32(1))


def since_last(last: Column, then: Column, now: Column, config: NormalizationConfig) -> tuple[Column, Column]:
    """Minutes and kilometres since the last transaction, which was at the instant `then`; both -1 without one."""
    minutes = divide(whole_seconds(now, then).cast("float"), f32(60))
    share = f32(0) if config.max_minutes <= 0 else clamp(divide(minutes, f32(config.max_minutes)))
    none = last.isNull()
    return F.when(none, f32(MISSING)).otherwise(share), F.when(none, f32(MISSING)).otherwise(clamp_ratio(last["km_from_current"], config.max_km))


def mcc_table(spark, risk: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted((k, float(v)) for k, v in risk.items()), "mcc string, risk double")


def with_mcc_risk(rows: DataFrame, mcc: Column, risk: dict[str, float] | DataFrame, name: str = "mcc_risk") -> DataFrame:
    """Adds the risk of each row's merchant category, UNKNOWN_MCC_RISK where it isn't listed.

    A dict is a configuration of bounded size and becomes a map literal; a table is joined, as Spark sees fit by its size.
    """
    if isinstance(risk, dict):
        pairs = [x for k, v in sorted(risk.items()) for x in (F.lit(k), f32(v))]
        found = F.try_element_at(F.create_map(*pairs), mcc) if pairs else F.lit(None).cast("float")
        return rows.withColumn(name, F.coalesce(found, f32(UNKNOWN_MCC_RISK)))
    table = risk.select(F.col("mcc").alias("__mcc"), F.col("risk").cast("float").alias("__risk"))
    return rows.join(table, mcc == F.col("__mcc"), "left").withColumn(name, F.coalesce("__risk", f32(UNKNOWN_MCC_RISK))).drop("__mcc", "__risk")


def vectorize(requests: DataFrame, config: NormalizationConfig, risk: dict[str, float] | DataFrame, column: str = "vector") -> DataFrame:
    """Adds `vector`, an array of 14 floats, to rows with the columns of a request."""
    c = F.col
    # each instant is parsed once, in a projection that stays, as its columns are named several times
    parsed = requests.withColumns({"__now": parse_utc(c("transaction.requested_at")), "__then": parse_utc(c("last_transaction.timestamp"))})
    now = c("__now")
    minutes, km = since_last(c("last_transaction"), c("__then"), now, config)
    rows = with_mcc_risk(parsed, c("merchant.mcc"), risk, "__risk_of_mcc")
    vector = F.array(
        clamp_ratio(c("transaction.amount"), config.max_amount),
        clamp_ratio(c("transaction.installments"), config.max_installments),
        amount_vs_average(c("transaction.amount"), c("customer.avg_amount"), config.amount_vs_avg_ratio),
        divide(f32(F.hour(now)), f32(23)),
        divide(f32(F.weekday(now)), f32(6)),
        minutes,
        km,
        clamp_ratio(c("terminal.km_from_home"), config.max_km),
        clamp_ratio(c("customer.tx_count_24h"), config.max_tx_count_24h),
        bool_to_unit(c("terminal.is_online")),
        bool_to_unit(c("terminal.card_present")),
        unknown_merchant(c("customer.known_merchants"), c("merchant.id")),
        c("__risk_of_mcc"),
        clamp_ratio(c("merchant.avg_amount"), config.max_merchant_avg_amount),
    )
    return rows.withColumn(column, vector).drop("__risk_of_mcc", "__now", "__then")
