"""Scoring of request streams: each micro-batch is scored as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..sources.readers import decode_requests


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Requests from the files of a folder, a JSON object a line, as they come."""
    return decode_requests(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)).drop("value")


def score_stream(engine: Engine, requests: DataFrame, output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes a response for each request, in a folder for each batch, so that a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        engine.score_batch(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
