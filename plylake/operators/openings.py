"""Opening book lookup and opening statistics over all players."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plylake.functions.columns import percent
from plylake.operators.expand import tokens


def opening_lookup(games: DataFrame, book: DataFrame) -> DataFrame:
    """Opening of each game: the book line with the most plies that its moves begin with.

    ``games``: game_id, moves.  ``book``: prefix (tokens joined by blanks), ply, eco, name.  A game is looked
    up under the lengths that book lines have, so no length is fixed here.  A book small enough is broadcast
    by the optimizer; then the group by game has its map-side part before any shuffle.
    """
    held = [r[0] for r in book.select(F.size(F.split("prefix", " "))).distinct().collect()]  # one row per length
    line = tokens(F.col("moves"))
    lengths = F.filter(F.array(*[F.lit(n) for n in sorted(held)]).cast("array<int>"), lambda n: n <= F.size(line))
    prefixes = games.select("game_id", line.alias("line"), F.explode_outer(lengths).alias("n")).select(
        "game_id", F.array_join(F.slice("line", 1, F.col("n")), " ").alias("prefix")
    )
    found = F.max_by(F.struct("eco", "name", "ply"), "ply")
    return (
        prefixes.join(book, "prefix", "left")
        .groupBy("game_id")
        .agg(found.alias("o"))
        .select("game_id", F.col("o.eco").alias("opening_eco"), F.col("o.name").alias("opening_name"),
                F.col("o.ply").alias("opening_ply"))
    )


def _outcomes():
    return [
        F.count("*").alias("games"),
        F.count_if(F.col("winner") == "white").alias("white_wins"),
        F.count_if(F.col("winner").isNull()).alias("draws"),
        F.count_if(F.col("winner") == "black").alias("black_wins"),
    ]


def eco_rollup(games: DataFrame) -> DataFrame:
    """Outcomes per code, per family A to E, and overall; ``level`` is 0, 1 and 3 for the three."""
    coded = games.where(F.col("opening_eco").isNotNull()).select(
        F.substring("opening_eco", 1, 1).alias("family"), F.col("opening_eco").alias("eco"), "winner"
    )
    return coded.rollup("family", "eco").agg(F.grouping_id().cast("int").alias("level"), *_outcomes())


def opening_by_band(games: DataFrame, width: int = 200) -> DataFrame:
    """Plays and outcome shares per speed, rating band and opening."""
    mean = (F.col("white_rating") + F.col("black_rating")) / 2
    band = (F.floor(mean / width) * width).cast("int").alias("band")
    out = games.where(F.col("opening_eco").isNotNull() & mean.isNotNull()).groupBy(
        "speed", band, "opening_eco", "opening_name"
    ).agg(*_outcomes())
    for side in ("white_wins", "draws", "black_wins"):
        out = out.withColumn(side.replace("_wins", "").replace("draws", "draw") + "_pct",
                             percent(F.col(side), F.col("games")))
    return out.drop("white_wins", "draws", "black_wins")


def next_moves(events: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` moves played after each ply of an opening, with their share of the games.

    Counts are made first; a window then sees one row per distinct move.
    """
    counted = (
        events.where(F.col("opening_eco").isNotNull())
        .groupBy("opening_eco", "opening_name", (F.col("move_number") - 1).alias("after_ply"), "move")
        .agg(F.count("*").alias("n"))
    )
    spot = Window.partitionBy("opening_eco", "opening_name", "after_ply")
    return (
        counted.withColumn("share_pct", percent(F.col("n"), F.sum("n").over(spot)))
        .withColumn("rank", F.row_number().over(spot.orderBy(F.desc("n"), "move")))
        .where(F.col("rank") <= top)
    )


def rating_band(width: int = 200):
    """The lower end of the band that the mean rating of both players is in."""
    mean = (F.col("white_rating") + F.col("black_rating")) / 2
    return (F.floor(mean / width) * width).cast("int")


def next_after_opening(events: DataFrame, opening_plies: DataFrame, top: int = 3, width: int = 200) -> DataFrame:
    """The ``top`` moves that follow the opening, per speed, rating band and opening.

    ``opening_plies`` holds the length of each game's opening line (game_id, opening_ply).  The join names one ply of a
    game, so a single row per game is counted; a game that ends with its opening has none.
    """
    spot = ["speed", "band", "opening_eco", "opening_name"]
    after = opening_plies.select("game_id", (F.col("opening_ply") + 1).alias("move_number"))
    counted = (
        events.where(F.col("opening_eco").isNotNull())
        .select("game_id", "move_number", "move", "speed", rating_band(width).alias("band"), "opening_eco", "opening_name")
        .where(F.col("band").isNotNull())
        .join(after, ["game_id", "move_number"])
        .groupBy(*spot, "move")
        .agg(F.count("*").alias("n"))
    )
    here = Window.partitionBy(*spot)
    return (
        counted.withColumn("share_pct", percent(F.col("n"), F.sum("n").over(here)))
        .withColumn("rank", F.row_number().over(here.orderBy(F.desc("n"), "move")))
        .where(F.col("rank") <= top)
    )


def stat_chunks(bands: DataFrame, nexts: DataFrame, width: int = 200) -> DataFrame:
    """One sentence per opening, speed and band, for text retrieval, with the moves that follow there."""
    spot = ["speed", "band", "opening_eco", "opening_name"]
    listed = (
        nexts.groupBy(*spot)
        .agg(F.array_sort(F.collect_list(F.struct(
            "rank", F.format_string("%s (%.1f%%)", "move", "share_pct").alias("text")))).alias("top"))
        .select(*spot, F.array_join(F.transform("top", lambda x: x["text"]), ", ").alias("nexts"))
    )
    return bands.join(listed, spot, "left").select(
        "opening_eco", "speed", "band",
        F.format_string(
            "%s at %s rating %d-%d: played %d times, White won %.1f%%, drawn %.1f%%, Black won %.1f%%. "
            "Most frequent next moves: %s",
            "opening_name", "speed", "band", F.col("band") + width, "games", "white_pct", "draw_pct", "black_pct",
            F.coalesce("nexts", F.lit("none")),
        ).alias("chunk"),
    )
