"""Writers of the fact table and of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from plylake.operators.games import games_from_events
from plylake.schemas import GAMES, MOVE_EVENTS


def publish(df: DataFrame, path: str) -> None:
    """Replace exactly the dates present in ``df``; other dates stay. Running a date again changes nothing.

    The rebalance hint gathers a date's rows and lets adaptive execution split a large date over
    several writers.
    """
    (
        df.hint("rebalance", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("date")
        .parquet(path)
    )


def publish_games(fact: DataFrame, path: str, dates: Sequence[str] | None = None) -> None:
    """Keeps the game table next to the fact: one row per game, by date.

    After ``dates`` of the fact were replaced, only those are read and replaced here; None takes all.  A date that has no
    game any more keeps its old games, as dynamic overwrite knows only dates that have rows.
    """
    changed = fact if dates is None else fact.where(F.col("date").isin(list(dates)))
    publish(games_from_events(changed).select(*GAMES.fieldNames()), path)


def publish_table(df: DataFrame, name: str) -> None:
    """The same for a catalog table with row-level partition overwrite."""
    df.writeTo(name).overwritePartitions()


def ensure_table(spark: SparkSession, name: str, using: str = "parquet") -> None:
    columns = ", ".join(
        f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in MOVE_EVENTS.fields
    )
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {using} "
        "OPTIONS (compression 'zstd') PARTITIONED BY (date)"
    )


def refresh(spark: SparkSession, name: str) -> None:
    spark.catalog.refreshTable(name)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)
