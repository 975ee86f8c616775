"""Readers of topics, landing tables and newline-JSON exports."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plylake.schemas import EVALS, GAMES, GAME_EXPORT, LANDED, MOVE_EVENTS


@dataclass(frozen=True)
class TopicSource:
    """Where topics come from: ``kafka`` with broker options, or ``text`` files under ``root/topic``."""

    format: str = "kafka"
    root: str = ""
    options: Mapping[str, str] = field(default_factory=dict)


def read_topic(spark: SparkSession, source: TopicSource, topic: str) -> DataFrame:
    """Stream of raw messages, text in ``value``, from the earliest offset."""
    reader = spark.readStream.format(source.format)
    if source.format == "kafka":
        return (
            reader.option("startingOffsets", "earliest")
            .option("failOnDataLoss", "false")
            .options(**source.options)
            .option("subscribe", topic)
            .load()
            .select("value")
        )
    return reader.schema("value string").options(**source.options).load(f"{source.root}/{topic}")


def read_landing(
    spark: SparkSession, root: str, topic: str, date: str | None = None, slack_days: int = 0
) -> DataFrame:
    """A landing table; ``date`` prunes to the day's partition and ``slack_days`` on each side."""
    # the batch partitions of the landing job are no column of the table
    df = spark.read.schema(LANDED[topic]).parquet(f"{root}/{topic}").select(*LANDED[topic].fieldNames())
    if date is None:
        return df
    day = F.to_date(F.lit(date))
    return df.where(F.col("date").between(F.date_sub(day, slack_days), F.date_add(day, slack_days)))


def read_quarantine(spark: SparkSession, root: str, topic: str) -> DataFrame:
    """What could not be landed: the message and when it came."""
    return spark.read.schema("value string, ingested_at timestamp").parquet(f"{root}/_quarantine/{topic}").select("value", "ingested_at")


def read_batches(spark: SparkSession, root: str, topic: str) -> DataFrame:
    """Numbers of messages, landed and quarantined rows of every micro-batch."""
    return spark.read.schema("messages long, landed long, quarantined long, batch string").parquet(f"{root}/_batches/{topic}")


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    """The published fact. The explicit schema keeps ``date`` text, which inference would turn to DATE."""
    return spark.read.schema(MOVE_EVENTS).parquet(path)


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """The published game table, which reports at game grain read instead of the fact."""
    return spark.read.schema(GAMES).parquet(path)


def read_evals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVALS).parquet(path)


def read_exports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Newline-JSON exports: the good rows, and the lines that do not parse or lack an id."""
    schema = StructType([*GAME_EXPORT.fields, StructField("_bad", StringType())])
    text = spark.read.text(path).where(F.trim("value") != "")
    game = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"})
    both = F.array(F.struct("value", game.alias("g")))

    def good(x: Column) -> Column:
        return F.coalesce(x["g"]["_bad"].isNull() & x["g"]["id"].isNotNull(), F.lit(False))

    return (
        text.select(F.inline(F.transform(F.filter(both, good), lambda x: x["g"]))).drop("_bad"),
        text.select(F.explode(F.transform(F.filter(both, lambda x: ~good(x)), lambda x: x["value"])).alias("value")),
    )
