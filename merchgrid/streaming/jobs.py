"""Incremental jobs: decision-log counts and rolling traffic signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from merchgrid.functions.common import ratio
from merchgrid.operators.signals import opportunity_gap
from merchgrid.sources.readers import DECISION_SCHEMA
from merchgrid.sources.sinks import write_run_json


def decision_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Decision log as a stream of JSON files."""
    return spark.readStream.schema(DECISION_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def outcome_counts(decisions: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Decisions per window, vendor and outcome (R1); works on a stream and on a table alike."""
    if decisions.isStreaming:
        decisions = decisions.withWatermark("timestamp", late)
    return decisions.groupBy(F.window("timestamp", every), "vendor", "outcome").agg(F.count(F.lit(1)).alias("decisions")).select(
        F.col("window.start").alias("window_start"), "vendor", "outcome", "decisions")


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def rolling_signals(events: DataFrame, key: str = "product_id", length: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sessions, conversion, revenue and opportunity gap per sliding window (R2)."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    seen = F.count_if(F.col("event_type").isin("view", "click"))
    bought = F.count_if(F.col("event_type") == "purchase")
    agg = events.groupBy(F.window("ts", length, slide), key).agg(
        seen.alias("sessions"), bought.alias("orders"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).alias("revenue"))
    rate = F.least(F.lit(1.0), ratio(F.col("orders"), F.col("sessions")))
    return agg.select(
        F.col("window.start").alias("window_start"), key, "sessions", "orders", "revenue", rate.alias("conversion_rate"),
        opportunity_gap(F.col("sessions"), rate).alias("opportunity_gap"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available and stop; ``checkpoint`` lies in the shared folder of the deployment."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_stream(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Records of a stream as JSON lines, each once (K12): every micro-batch owns the partition of its number.

    A batch that runs again after a failure replaces what it wrote before, as the files of a batch are
    fixed in the checkpoint before it runs.  Readers of ``path`` see whole batches only.  Without ``every`` all that is there is taken and the query ends.
    """
    def write(batch: DataFrame, number: int) -> None:
        write_run_json(batch.withColumn("batch", F.lit(number)), path, "batch")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
