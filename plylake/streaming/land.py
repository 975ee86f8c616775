"""Topics to date-partitioned landing tables: each micro-batch is read and parsed once, and lands once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from plylake.operators.events import split_messages, with_event_date
from plylake.schemas import TOPICS
from plylake.sources.landing import TopicSource, read_topic


def append_files(
    stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = None, **trigger
) -> StreamingQuery:
    """Append a stream to Parquet. Default trigger: work off what is there, then stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return (writer.partitionBy(partition_by) if partition_by else writer).start()


def batch_name(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """Names a micro-batch for good: its number and the id that the checkpoint gives the query."""
    query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
    return f"{query}-{batch_id}"


def write_batch(raw: DataFrame, topic: str, root: str, batch: str) -> None:
    """Lands one batch of messages into three tables: rows, quarantine, and a row of counts.

    The messages are parsed once and kept while the tables are written.  Each table has a partition for the batch, which
    is replaced: a batch that is handled again after a failure leaves the tables as they were.
    """
    parsed = split_messages(raw, topic).persist()
    try:
        good, bad = parsed.where("good IS NOT NULL"), parsed.where("bad IS NOT NULL")
        rows = with_event_date(good.select("good.*").withColumn("ingested_at", F.current_timestamp()), topic)
        left = bad.select(F.col("bad").alias("value"), F.current_timestamp().alias("ingested_at"))
        counts = parsed.agg(F.count("*").alias("messages"), F.count("good").alias("landed"), F.count("bad").alias("quarantined"))
        for table, path, by in ((rows, topic, ["date"]), (left, f"_quarantine/{topic}", []), (counts, f"_batches/{topic}", [])):
            writer = table.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy(*by, "batch").parquet(f"{root}/{path}")
    finally:
        parsed.unpersist()


def land(
    spark: SparkSession, source: TopicSource, topic: str, root: str, checkpoints: str, **trigger
) -> StreamingQuery:
    """Land one topic: good rows under ``root/topic``, the others under ``root/_quarantine/topic``.

    ``root/_batches/topic`` has the numbers of messages, landed and quarantined rows of every micro-batch.
    """
    checkpoint = f"{checkpoints}/{topic}"

    def write(raw: DataFrame, batch_id: int) -> None:
        write_batch(raw, topic, root, batch_name(raw.sparkSession, checkpoint, batch_id))

    stream = read_topic(spark, source, topic).writeStream.foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def land_all(spark: SparkSession, source: TopicSource, root: str, checkpoints: str, **trigger) -> None:
    """Land every topic, each with its own query and checkpoint, and wait for all of them."""
    running = [land(spark, source, topic, root, checkpoints, **trigger) for topic in TOPICS]
    for query in running:
        query.awaitTermination()
