"""Per-player reports, each answered for all players in one pass.

``player_id`` narrows a report to one player.  All of them are hash aggregates with a map-side part,
so a player who holds a large share of the rows arrives at the final stage as a few partial rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plylake.functions.columns import SERVING_PHASES, mover_id, percent, phase, seconds
from plylake.operators.games import (
    for_player, games_from_events, games_of, perspective, result_of,
)

REFERENCE, CORRECTED = "reference", "corrected"


def check_semantics(semantics: str) -> None:
    if semantics not in (REFERENCE, CORRECTED):
        raise ValueError(f"semantics must be {REFERENCE!r} or {CORRECTED!r}, not {semantics!r}")


def _sides(games: DataFrame, player_id: str | None) -> DataFrame:
    return for_player(perspective(games_of(games, player_id)), player_id)


def _count_result(result: str) -> Column:
    return F.count_if(F.col("result") == result)


def _win_rates(df: DataFrame, *keys: str) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("games"), _count_result("win").alias("wins"))
        .withColumn("win_rate_pct", percent(F.col("wins"), F.col("games")))
    )


def player_overview(games: DataFrame, player_id: str | None = None) -> DataFrame:
    """Games, wins, losses, draws and mean own rating by speed."""
    return (
        _sides(games, player_id)
        .groupBy("player_id", "speed")
        .agg(
            F.count("*").alias("total_games"),
            _count_result("win").alias("wins"),
            _count_result("loss").alias("losses"),
            _count_result("draw").alias("draws"),
            F.round(F.avg("my_rating"), 0).alias("avg_rating"),
        )
    )


def player_totals(games: DataFrame, player_id: str | None = None, semantics: str = REFERENCE) -> DataFrame:
    """Totals over all speeds.

    The reference form weights per-speed averages that were already rounded; the corrected form takes
    the mean over the games.
    """
    check_semantics(semantics)
    if semantics == REFERENCE:
        by_speed = player_overview(games, player_id)
        rating = F.sum(F.col("avg_rating") * F.col("total_games")) / F.sum("total_games")
        counts = [F.sum(c).alias(c) for c in ("total_games", "wins", "losses", "draws")]
    else:
        by_speed = _sides(games, player_id)
        rating = F.avg("my_rating")
        counts = [F.count("*").alias("total_games")] + [
            _count_result(r).alias(c) for r, c in (("win", "wins"), ("loss", "losses"), ("draw", "draws"))
        ]
    return (
        by_speed.groupBy("player_id")
        .agg(*counts, F.bround(rating, 0).alias("avg_rating"))
        .withColumn("win_pct", F.bround(F.col("wins") * 100.0 / F.col("total_games").cast("double"), 1))
    )


def time_pressure(
    events: DataFrame, player_id: str | None = None, semantics: str = REFERENCE, limit_cs: int = 1000
) -> DataFrame:
    """Results with little time on the clock against results with enough.

    The reference form looks at the clock after the first ply only; the corrected form at the player's
    lowest own clock of the game.
    """
    check_semantics(semantics)
    if semantics == REFERENCE:
        base = _sides(games_from_events(events), player_id).where(F.col("clock_remaining").isNotNull())
        base = base.select("player_id", "result", F.col("clock_remaining").alias("clock"))
    else:
        own = games_of(events, player_id).where(F.col("clock_remaining").isNotNull()).select(
            "game_id", "winner", "clock_remaining", "white_id", mover_id().alias("player_id")
        )
        base = (
            for_player(own.where(F.col("player_id").isNotNull()), player_id)
            .groupBy("game_id", "player_id")
            .agg(
                F.min("clock_remaining").alias("clock"),
                F.max("winner").alias("winner"),
                F.max(F.when(F.col("white_id") == F.col("player_id"), "white").otherwise("black")).alias("color"),
            )
            .withColumn("result", result_of(F.col("winner"), F.col("color")))
        )
    return (
        base.withColumn("pressure", F.when(F.col("clock") < limit_cs, "under_10s").otherwise("normal"))
        .groupBy("player_id", "pressure")
        .agg(
            F.count("*").alias("games"),
            _count_result("win").alias("wins"),
            seconds(F.avg("clock")).alias("avg_clock_s"),
        )
        .withColumn("win_rate_pct", percent(F.col("wins"), F.col("games")))
    )


def opening_stats(
    games: DataFrame, player_id: str | None = None, top_n: int = 10, min_games: int = 2
) -> DataFrame:
    """The player's ``top_n`` openings by games played; at most a few thousand openings per player are ranked."""
    rank = Window.partitionBy("player_id").orderBy(F.desc("games"), "opening_eco", "opening_name")
    return (
        _win_rates(
            _sides(games.where(F.col("opening_eco").isNotNull()), player_id),
            "player_id", "opening_eco", "opening_name",
        )
        .where(F.col("games") >= min_games)
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= top_n)
    )


def clock_by_phase(
    events: DataFrame,
    player_id: str | None = None,
    semantics: str = REFERENCE,
    bounds: tuple[int, int] = SERVING_PHASES,
) -> DataFrame:
    """Mean and lowest clock and the number of moves per phase; corrected form: own plies only."""
    check_semantics(semantics)
    plies = games_of(events, player_id).where(F.col("clock_remaining").isNotNull())
    if semantics == REFERENCE:
        owners = F.array_compact(F.array_distinct(F.array("white_id", "black_id")))
        owned = plies.select(F.explode(owners).alias("player_id"), "move_number", "clock_remaining")
    else:
        owned = plies.select(mover_id().alias("player_id"), "move_number", "clock_remaining").where(
            F.col("player_id").isNotNull()
        )
    return (
        for_player(owned, player_id)
        .groupBy("player_id", phase(F.col("move_number"), bounds).alias("phase"))
        .agg(
            seconds(F.avg("clock_remaining")).alias("avg_clock_s"),
            seconds(F.min("clock_remaining")).alias("min_clock_s"),
            F.count("*").alias("move_count"),
        )
    )


def by_color(games: DataFrame, player_id: str | None = None) -> DataFrame:
    return _win_rates(_sides(games, player_id), "player_id", "color")


def vs_rating(games: DataFrame, player_id: str | None = None, margin: int = 100) -> DataFrame:
    """Results by opponent strength; an unknown rating falls into ``equal_rated``."""
    mine, theirs = F.col("my_rating"), F.col("opp_rating")
    cls = (
        F.when(theirs < mine - margin, "lower_rated")
        .when(theirs > mine + margin, "higher_rated")
        .otherwise("equal_rated")
    )
    return _win_rates(
        _sides(games, player_id).withColumn("opponent_class", cls), "player_id", "opponent_class"
    )


def daily_volume(events: DataFrame) -> DataFrame:
    return events.groupBy("date").agg(
        F.countDistinct("game_id").alias("games"), F.count("*").alias("moves")
    )


def recent_games(games: DataFrame, player_id: str | None = None, limit: int = 10) -> DataFrame:
    """The latest games of each player.

    ``row_number() <= limit`` lets Spark cut every map task to ``limit`` rows per player before the
    shuffle, so a heavy player does not fill one task.
    """
    latest = Window.partitionBy("player_id").orderBy(F.desc("date"), "game_id")
    return (
        _sides(games, player_id)
        .withColumn("rank", F.row_number().over(latest))
        .where(F.col("rank") <= limit)
        .select(
            "player_id", "rank", "game_id", F.col("opponent_id").alias("opponent"), "my_rating",
            "opp_rating", "opening_eco", "opening_name", "speed", "winner", "result", "end_status", "date",
        )
    )


def game_replay(events: DataFrame, game_id: str | None = None) -> DataFrame:
    """The plies of one game in order; without ``game_id`` those of all games."""
    picked = events if game_id is None else events.where(F.col("game_id") == game_id)
    return picked.select(
        "game_id", "move_number", "whose_moved", "move", "fen",
        seconds(F.col("clock_remaining")).alias("clock_s"),
        "white_id", "black_id", "white_rating", "black_rating", "opening_name", "speed", "winner",
        "end_status",
    ).orderBy("game_id", "move_number")


def merge_top_lists(*lists: DataFrame) -> DataFrame:
    """Union of ranked player lists without repeats, in order of first appearance."""
    tagged = [
        df.select("id", F.lit(n).alias("list_no"), F.col("rank").cast("int").alias("rank"))
        for n, df in enumerate(lists)
    ]
    merged = reduce(DataFrame.unionByName, tagged)
    return (
        merged.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min(F.struct("list_no", "rank")).alias("first_seen"))
        .select("id", "first_seen.list_no", "first_seen.rank")
    )
