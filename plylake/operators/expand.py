"""Building the move-event fact: join at game grain first, expand to half-moves last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plylake.operators.positions import FLAGS, captures, gives_check, positioned_plies
from plylake.schemas import MOVE_EVENTS


def tokens(moves: Column) -> Column:
    return F.filter(F.split(moves, r"\s+"), lambda t: t != "")


def explode_moves(games: DataFrame) -> DataFrame:
    """One row per movetext token: 1-based ``move_number``, mover, token and the clock at its index."""
    return (
        games.select("*", F.posexplode(tokens(F.col("moves"))).alias("pos", "move"))
        .withColumn("move_number", F.col("pos") + 1)
        .withColumn("whose_moved", F.when(F.col("pos") % 2 == 0, "white").otherwise("black"))
        .withColumn("clock_remaining", F.get("clocks", F.col("pos")))
        .drop("pos", "moves", "clocks")
    )


def token_plies(games: DataFrame) -> DataFrame:
    """Plies without positions: the token stands for the move; check and capture are what it says."""
    plies = explode_moves(games).withColumn("fen", F.lit(None).cast("string"))
    return plies.withColumns({"is_check": gives_check(F.col("move")), "is_capture": captures(F.col("move")), "truncated": F.lit(False)})


def latest(df: DataFrame, *keys: str) -> DataFrame:
    """The last landed row per key. Map tasks cut to one row per key before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("ingested_at"), F.xxhash64(*df.columns))
    return df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")


def build_move_events(
    exports: DataFrame,
    starts: DataFrame,
    ends: DataFrame,
    date: str | None = None,
    slack_days: int = 0,
    positions: DataFrame | None = None,
) -> DataFrame:
    """Exports joined to their start and end, one row per half-move.

    ``date`` builds one day and prunes all three inputs to their partitions; None builds every day.
    ``slack_days`` also finds starts and ends that were landed under a neighbouring date.  Repeated
    messages count once.  With ``positions`` (see ``operators.positions``) plies have coordinates and FEN, and a game
    ends where its positions end.  ``is_check``, ``is_capture`` and ``truncated`` follow the fact's columns.
    """
    keys = ["game_id", "date"] if date is None else ["game_id"]
    exports = exports.withColumnRenamed("id", "game_id")
    if date is not None:
        day = F.to_date(F.lit(date))
        near = F.col("date").between(F.date_sub(day, slack_days), F.date_add(day, slack_days))
        exports, starts, ends = exports.where(F.col("date") == day), starts.where(near), ends.where(near)

    games = latest(
        exports.select("game_id", "moves", "clocks", "opening", "clock", "speed", "perf", "variant", "date",
                       "ingested_at"),
        "game_id",
    ).drop("ingested_at")
    players = latest(
        starts.select("game_id", "white_id", "white_rating", "white_title", "black_id", "black_rating",
                      "black_title", "tournament_id", "date", "ingested_at"),
        *keys,
    ).withColumnsRenamed({"date": "start_date", "ingested_at": "start_at"})
    results = latest(
        ends.select("game_id", "winner", F.col("status").alias("end_status"), "date", "ingested_at"), *keys
    ).withColumnsRenamed({"date": "end_date", "ingested_at": "end_at"})

    def close(side: str) -> Column:
        return F.abs(F.datediff(side, "date")) <= slack_days

    joined = games.join(players, "game_id").where(close("start_date")).join(results, "game_id").where(close("end_date"))
    if date is None and slack_days:
        newest = Window.partitionBy("game_id").orderBy(
            F.desc("start_at"), F.desc("start_date"), F.desc("end_at"), F.desc("end_date")
        )
        joined = joined.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1)
    flat = joined.select(
        "*",
        F.col("opening.eco").alias("opening_eco"),
        F.col("opening.name").alias("opening_name"),
        F.col("clock.initial").alias("clock_initial"),
        F.col("clock.increment").alias("clock_increment"),
        F.col("date").cast("string").alias("day"),
    )
    keep = [c for c in MOVE_EVENTS.fieldNames() if c in flat.columns and c != "date"]
    games = flat.select(*keep, "moves", "clocks", "day")
    plies = token_plies(games) if positions is None else positioned_plies(games, positions)
    return plies.withColumnRenamed("day", "date").select(*MOVE_EVENTS.fieldNames(), *FLAGS)
