"""Scoring requests derived from an event stream: what a request holds about its customer comes from the customer's earlier events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Categories that we give to the event types; others have none.
MCC_OF = {"click": "5411", "purchase": "7801", "refund": "7802", "view": "5912"}


DAY = 86_400_000_000


def derived(events: DataFrame) -> DataFrame:
    """Adds to each event: micros, last_micros (the user's event before), tx_24h (events in the 24 hours before), avg_before (mean
    value of the user's earlier events, 0 without) and known (whether the user had an event of this type before).

    Windows are over one day of one user, so a user with a large share of all events is spread over as many groups as days.  What a day
    needs of the days before comes as rows of totals, a row for each user, day and type at most, pre-aggregated before any shuffle; and the
    day before joins in for the 24 hours.  Events of equal time go by event_id; those without a time stand before all others.
    """
    cents = F.round(F.col("value") * 100).cast("bigint")  # whole numbers: a running sum is the same in any order
    rows = events.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("__day", F.floor(F.col("micros") / DAY)).withColumn("__cents", cents)

    of_type = rows.groupBy("user_id", "__day", "event_type").agg(F.sum("__cents").alias("s"), F.count("__cents").alias("c"), F.max("micros").alias("m"))
    of_day = of_type.groupBy("user_id", "__day").agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.max("m").alias("m"))
    earlier = Window.partitionBy("user_id").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    totals = of_day.select("user_id", "__day", F.sum("s").over(earlier).alias("__s"), F.sum("c").over(earlier).alias("__c"), F.max("m").over(earlier).alias("__m"))
    seen = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("__day")) > 1
    types = of_type.select("user_id", "__day", "event_type", seen.alias("__seen"))

    # each event in its own day, and without its cents in the next one
    own = F.col("__own")
    rows = rows.withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False))))
    rows = rows.withColumn("__day", F.col("__day") + F.when(own, 0).otherwise(1)).where(own | F.col("__day").isNotNull())
    every = rows.unionByName(totals, allowMissingColumns=True).unionByName(types, allowMissingColumns=True)

    group = Window.partitionBy("user_id", "__day")
    before = group.orderBy("micros", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    day = group.orderBy("micros").rangeBetween(-DAY, -1)
    same = Window.partitionBy("user_id", "__day", "event_type")
    same_before = same.orderBy("micros", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    mine = F.when(own, F.col("__cents"))
    sums = F.coalesce(F.sum(mine).over(before), F.lit(0)) + F.coalesce(F.max("__s").over(group), F.lit(0))
    counts = F.count(mine).over(before) + F.coalesce(F.max("__c").over(group), F.lit(0))
    return (
        every.withColumn("last_micros", F.coalesce(F.max("micros").over(before), F.max("__m").over(group)))
        .withColumn("tx_24h", F.when(F.col("micros").isNotNull(), F.count("__own").over(day)).otherwise(0))
        .withColumn("avg_before", F.coalesce(F.try_divide(sums.cast("double"), counts.cast("double")) / 100, F.lit(0.0)))
        .withColumn("known", F.coalesce(F.max("__seen").over(same), F.lit(False)) | (F.count(F.when(own, 1)).over(same_before) > 0))
        .where(own)
        .drop("__day", "__own", "__cents", "__s", "__c", "__m", "__seen")
    )


def mcc_of(event_type: Column) -> Column:
    pairs = [F.lit(x) for kv in sorted(MCC_OF.items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), event_type), F.lit("none"))


def iso(micros: Column) -> Column:
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def requests(events: DataFrame) -> DataFrame:
    """event_id and the nested columns of a request for each event."""
    rows = derived(events)
    cents = F.round(F.col("value") * 100).cast("bigint")
    by_type = events.groupBy(F.col("event_type").alias("__type")).agg((F.try_divide(F.sum(cents).cast("double"), F.count(cents).cast("double")) / 100).alias("type_avg"))
    rows = rows.join(by_type, rows["event_type"].eqNullSafe(F.col("__type")), "left")
    km = lambda step, top: (F.col("event_id") * step % top).cast("double")
    return rows.select(
        "event_id",
        F.col("event_id").cast("string").alias("id"),
        F.struct(F.abs("value").alias("amount"), (F.col("event_id") % 12 + 1).alias("installments"), iso(F.col("micros")).alias("requested_at")).alias("transaction"),
        F.struct(F.col("avg_before").alias("avg_amount"), F.col("tx_24h").alias("tx_count_24h"), F.when(F.col("known"), F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("known_merchants")).alias("customer"),
        F.struct(F.col("event_type").alias("id"), mcc_of(F.col("event_type")).alias("mcc"), F.coalesce("type_avg", F.lit(0.0)).alias("avg_amount")).alias("merchant"),
        F.struct((F.col("event_id") % 2 == 0).alias("is_online"), (F.col("event_id") % 3 == 0).alias("card_present"), km(7, 1200).alias("km_from_home")).alias("terminal"),
        F.when(F.col("last_micros").isNotNull(), F.struct(iso(F.col("last_micros")).alias("timestamp"), km(3, 900).alias("km_from_current"))).alias("last_transaction"),
    )
