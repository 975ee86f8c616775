"""Game-grain views of the move-event fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def result_of(winner: Column, color: Column) -> Column:
    return F.when(winner.isNull(), "draw").when(winner == color, "win").otherwise("loss")


def games_from_events(
    events: DataFrame, unique: bool = False, statuses_excluded: Sequence[str] = ()
) -> DataFrame:
    """One row per game, taken from its first ply; repeated rows of a game do not count twice.

    ``unique=True`` saves the shuffle by game where the fact is known to hold every ply once, as
    ``publish`` leaves it.  ``statuses_excluded`` drops games such as aborted ones, which would
    otherwise count as drawn.
    """
    first = events.where(F.col("move_number") == 1)
    if statuses_excluded:
        first = first.where(~F.coalesce(F.col("end_status").isin(*statuses_excluded), F.lit(False)))
    return first if unique else first.dropDuplicates(["game_id"])


def perspective(games: DataFrame) -> DataFrame:
    """One row per game and player: own colour, opponent, both ratings and the result.

    A player who meets themselves is counted once, as white.
    """

    def side(color: str, other: str):
        return F.struct(
            F.col(f"{color}_id").alias("player_id"),
            F.lit(color).alias("color"),
            F.col(f"{other}_id").alias("opponent_id"),
            F.col(f"{color}_rating").alias("my_rating"),
            F.col(f"{other}_rating").alias("opp_rating"),
        )

    white, black = side("white", "black"), side("black", "white")
    sides = F.when(F.col("white_id") == F.col("black_id"), F.array(white)).otherwise(F.array(white, black))
    return (
        games.select("*", F.inline(sides))
        .where(F.col("player_id").isNotNull())
        .withColumn("result", result_of(F.col("winner"), F.col("color")))
    )


def for_player(df: DataFrame, player_id: str | None) -> DataFrame:
    """The single-player call of a population-wide operator."""
    return df if player_id is None else df.where(F.col("player_id") == player_id)


def games_of(games: DataFrame, player_id: str | None) -> DataFrame:
    """Cut to the player's games before the sides are expanded, so the filter reaches the scan."""
    if player_id is None:
        return games
    return games.where((F.col("white_id") == player_id) | (F.col("black_id") == player_id))
