"""Tracking of players that turn up in game starts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

KNOWN_PLAYERS = "player_id string, first_seen timestamp, last_seen timestamp"


def players_of(starts: DataFrame) -> DataFrame:
    ids = F.array_compact(F.array_distinct(F.array("white_id", "black_id")))
    return starts.select(F.explode(ids).alias("player_id")).where(F.col("player_id") != "")


def new_players(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct candidates that are not tracked yet."""
    return candidates.select("player_id").distinct().join(known.select("player_id"), "player_id", "left_anti")


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """The tracked players; none before the first batch has written the table."""
    try:
        return spark.read.schema(KNOWN_PLAYERS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], KNOWN_PLAYERS)


def discover_players(starts: DataFrame, known_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append unseen players of a stream of starts to the table at ``known_path``.

    The table is the state: a micro-batch that runs again finds its players already there.
    """

    def flush(batch: DataFrame, _: int) -> None:
        now = F.current_timestamp()
        fresh = new_players(batch, read_known(batch.sparkSession, known_path)).select(
            "player_id", now.alias("first_seen"), now.alias("last_seen")
        )
        if not fresh.isEmpty():
            fresh.hint("rebalance").write.mode("append").parquet(known_path)

    return (
        players_of(starts)
        .writeStream.foreachBatch(flush)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )
