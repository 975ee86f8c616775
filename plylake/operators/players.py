"""Player and game dimensions, similar players, rating trend, and checks of stated numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plylake.functions.columns import blank_to_null, event_timestamp
from plylake.operators.expand import latest, tokens
from plylake.operators.games import perspective


def dim_players(starts: DataFrame) -> DataFrame:
    """First and last sight and the latest title of every player in the starts."""
    moment = event_timestamp(F.col("timestamp")).alias("ts")
    sides = F.array(*[
        F.struct(F.col(f"{c}_id").alias("player_id"), F.col(f"{c}_title").alias("title")) for c in ("white", "black")
    ])
    titled_at = F.when(F.col("title").isNotNull(), F.struct("ts", "title"))
    return (
        starts.select(moment, F.inline(sides))
        .where(blank_to_null(F.col("player_id")).isNotNull())
        .groupBy("player_id")
        .agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_seen_at"),
             F.max(titled_at)["title"].alias("title"))
    )


def dim_games(starts: DataFrame, ends: DataFrame, exports: DataFrame) -> DataFrame:
    """One row per started game with its end and, once exported, its opening and length."""
    begun = latest(starts, "game_id").select(
        "game_id", "white_id", "black_id", "white_rating", "black_rating", "white_title", "black_title", "speed",
        "rated", "variant", "source", "tournament_id", event_timestamp(F.col("timestamp")).alias("started_at"),
    )
    ended = latest(ends, "game_id").select(
        "game_id", "winner", "status", event_timestamp(F.col("timestamp")).alias("ended_at")
    )
    played = latest(exports.withColumnRenamed("id", "game_id"), "game_id").select(
        "game_id", F.col("opening.eco").alias("opening_eco"), F.col("opening.name").alias("opening_name"),
        F.size(tokens(F.col("moves"))).alias("total_moves"),
    )
    return begun.join(ended, "game_id", "left").join(played, "game_id", "left")


def similar_players(games: DataFrame, k: int = 5, width: int = 100) -> DataFrame:
    """The ``k`` players nearest in rating within the same speed and rating band, lower ids first on ties.

    Players are never paired with each other.  Per rating only the ``k + 1`` first ids can matter, so
    the neighbours are found between the at most ``width`` ratings of a band and handed to the players.
    """
    current = (
        perspective(games)
        .where(F.col("my_rating").isNotNull())
        .groupBy("player_id", "speed")
        .agg(F.max_by("my_rating", F.struct("date", "game_id")).alias("rating"))
        .withColumn("band", (F.floor(F.col("rating") / width) * width).cast("int"))
    )
    first_ids = Window.partitionBy("speed", "rating").orderBy("player_id")
    per_rating = (
        current.withColumn("_n", F.row_number().over(first_ids))
        .where(F.col("_n") <= k + 1)
        .groupBy("speed", "band", "rating")
        .agg(F.collect_list("player_id").alias("ids"))
    )
    other = per_rating.select("speed", "band", F.col("rating").alias("other_rating"), F.explode("ids").alias("other_id"))
    nearest = Window.partitionBy("speed", "rating").orderBy("difference", "other_id")
    neighbours = (
        per_rating.drop("ids")
        .join(other, ["speed", "band"])
        .withColumn("difference", F.abs(F.col("other_rating") - F.col("rating")))
        .withColumn("_n", F.row_number().over(nearest))
        .where(F.col("_n") <= k + 1)
        .groupBy("speed", "rating")
        .agg(F.array_sort(F.collect_list(F.struct("difference", "other_id", "other_rating"))).alias("near"))
    )
    others = F.slice(F.filter("near", lambda x: x["other_id"] != F.col("player_id")), 1, k)
    return (
        current.join(neighbours, ["speed", "rating"])
        .select("player_id", "speed", "band", "rating", F.posexplode(others).alias("pos", "o"))
        .select("player_id", "speed", "band", "rating", (F.col("pos") + 1).alias("rank"),
                F.col("o.other_id").alias("similar_id"), F.col("o.other_rating").alias("similar_rating"))
    )


def scope_filter(
    games: DataFrame, speeds: tuple[str, ...] = ("bullet", "blitz", "rapid"), low: int = 800, high: int = 2000
) -> DataFrame:
    """Player-games within the studied speeds and own ratings."""
    return perspective(games.where(F.col("speed").isin(*speeds))).where(F.col("my_rating").between(low, high))


def rating_trend(games: DataFrame, min_games: int = 5, edge: float = 0.5) -> DataFrame:
    """Least-squares slope of the own rating per day."""
    day = F.datediff(F.to_date("date"), F.lit("1970-01-01").cast("date"))
    return (
        perspective(games)
        .groupBy("player_id", "speed")
        .agg(F.count("my_rating").alias("games"), F.round(F.regr_slope("my_rating", day), 6).alias("slope"))
        .where(F.col("games") >= min_games)
        .withColumn("trend", F.when(F.col("slope") > edge, "improving")
                    .when(F.col("slope") < -edge, "declining").otherwise("flat"))
    )


def rating_change(games: DataFrame, days: int = 30) -> DataFrame:
    """Own rating in a player's last game less that in their first game of the last ``days`` days.

    Days are summarised first, so the window sees one row per player and day.
    """
    daily = (
        perspective(games)
        .where(F.col("my_rating").isNotNull())
        .groupBy("player_id", F.to_date("date").alias("day"))
        .agg(F.min_by("my_rating", "game_id").alias("first"), F.max_by("my_rating", "game_id").alias("last"))
    )
    last_day = F.max("day").over(Window.partitionBy("player_id"))
    return (
        daily.withColumn("_until", last_day)
        .where(F.datediff("_until", "day") <= days)
        .groupBy("player_id")
        .agg(F.min_by("first", "day").alias("rating_before"), F.max_by("last", "day").alias("rating_after"))
        .withColumn("change", F.col("rating_after") - F.col("rating_before"))
    )


def claim_accuracy(claims: DataFrame, facts: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Per metric: how many stated numbers have a computed one at all, and how many are close to it.

    Both sides: metric, key, value; ``facts`` holds one row per metric and key.
    """
    matched = claims.join(facts.withColumnRenamed("value", "fact"), ["metric", "key"], "left")
    close = F.abs(F.col("value") - F.col("fact")) <= tolerance
    return (
        matched.groupBy("metric")
        .agg(F.count("*").alias("claims"), F.count("fact").alias("grounded"), F.count_if(close).alias("accurate"))
        .withColumn("grounded_share", F.round(F.col("grounded").cast("double") / F.col("claims"), 6))
        .withColumn("accurate_share", F.round(F.col("accurate").cast("double") / F.nullif(F.col("grounded"), F.lit(0)), 6))
    )


def detection_quality(labels: DataFrame) -> DataFrame:
    """Precision and recall of ``predicted`` against ``actual`` (booleans, NULL counts as false)."""
    said, true = F.coalesce("predicted", F.lit(False)), F.coalesce("actual", F.lit(False))
    return labels.agg(
        F.count_if(said & true).alias("hits"), F.count_if(said).alias("said"), F.count_if(true).alias("present")
    ).select(
        "hits", "said", "present",
        F.round(F.col("hits").cast("double") / F.nullif(F.col("said"), F.lit(0)), 6).alias("precision"),
        F.round(F.col("hits").cast("double") / F.nullif(F.col("present"), F.lit(0)), 6).alias("recall"),
    )


def similar_positions(vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The ``k`` stored positions nearest to one query vector by cosine; one scan and a top-k."""
    given = F.array(*[F.lit(float(x)) for x in query])
    stored = F.transform("embedding", lambda x: x.cast("double"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    norm = sum(float(x) ** 2 for x in query) ** 0.5
    cosine = dot(stored, given) / F.nullif(F.sqrt(dot(stored, stored)) * F.lit(norm), F.lit(0.0))
    return (
        vectors.select("vec_id", "label", F.round(cosine, 6).alias("similarity"))
        .orderBy(F.desc_nulls_last("similarity"), "vec_id")
        .limit(k)
    )
