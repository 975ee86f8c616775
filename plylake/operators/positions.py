"""Positions as an input table: joined to movetext at game grain, so that plies carry coordinates and FEN.

``positions`` holds game_id, move_number, uci and fen: the move in coordinates and the position before it.  One row past
a game's last move, with a NULL uci, holds the position after it.  Whoever produces the table knows the rules of the
game; here a game is played as far as its positions go without a gap, and the rest of its movetext is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Columns that plies have besides those of the fact's schema.
FLAGS = ("is_check", "is_capture", "truncated")


def tokens(moves: Column) -> Column:
    return F.filter(F.split(F.coalesce(moves, F.lit("")), r"\s+"), lambda t: t != "")


def gives_check(token: Column) -> Column:
    """Whether the movetext token says check or mate."""
    return token.rlike(r"[+#][!?]*$")


def captures(token: Column) -> Column:
    return token.contains("x")


def placed(positions: DataFrame) -> DataFrame:
    """(game_id, places): a game's positions in order of move, the last of repeated numbers; a game's length bounds them."""
    one = positions.where(F.col("uci").isNotNull()).groupBy("game_id", "move_number").agg(F.max(F.struct("uci", "fen")).alias("at"))
    return one.groupBy("game_id").agg(
        F.array_sort(F.collect_list(F.struct("move_number", F.col("at.uci").alias("uci"), F.col("at.fen").alias("fen")))).alias("places")
    )


def positioned_plies(games: DataFrame, positions: DataFrame) -> DataFrame:
    """One row per half-move that has its position: ``move``, ``fen`` before it, flags from the token.

    ``truncated`` says that the game's movetext goes on beyond its positions.  The join is one row for each game, and the
    plies are made from it without a shuffle.
    """
    joined = games.join(placed(positions), "game_id", "left")
    line, places = tokens(F.col("moves")), F.coalesce("places", F.array().cast("array<struct<move_number:int,uci:string,fen:string>>"))
    whole = F.filter(places, lambda p, i: p["move_number"] == i + 1)  # ascending, so a gap ends it
    pairs = F.slice(F.arrays_zip(line.alias("token"), places.alias("at")), F.lit(1), F.least(F.size(line), F.size(whole)))
    rows = joined.withColumn("truncated", F.size(whole) < F.size(line)).select("*", F.posexplode(pairs).alias("pos", "ply"))
    out = (
        rows.withColumn("move_number", F.col("pos") + 1)
        .withColumn("move", F.col("ply.at.uci"))
        .withColumn("fen", F.col("ply.at.fen"))
        .withColumn("whose_moved", F.when(F.col("pos") % 2 == 0, "white").otherwise("black"))
        .withColumn("is_check", gives_check(F.col("ply.token")))
        .withColumn("is_capture", captures(F.col("ply.token")))
    )
    if "clocks" in games.columns:
        out = out.withColumn("clock_remaining", F.get("clocks", F.col("pos"))).drop("clocks")
    return out.drop("pos", "ply", "places", "moves")


def live_board(states: DataFrame, positions: DataFrame) -> DataFrame:
    """Board columns of live states whose ``moves`` is the cumulative coordinate list; batch, or a stream with a static table.

    Adds the last move, the position after it and whether the side to move is in check (``in_check`` of the table, false
    where the table has no such column).  A state beyond the known positions has NULL for its position.
    """
    line = tokens(F.col("moves"))
    check = F.col("in_check") if "in_check" in positions.columns else F.lit(False)
    after = positions.select("game_id", (F.col("move_number") - 1).alias("_played"), "fen", check.alias("is_check"))
    known = states.withColumn("_played", F.size(line)).withColumn("move", F.try_element_at(line, F.lit(-1)))
    return known.join(after, ["game_id", "_played"], "left").withColumn("is_check", F.coalesce("is_check", F.lit(False))).drop("_played", "moves")
