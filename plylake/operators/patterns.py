"""Behaviour over many games."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plylake.functions.columns import LIVE_PHASES, clock_bucket, mover_id, percent, phase, seconds
from plylake.operators.games import perspective, result_of
from plylake.operators.ordered import with_previous, with_running_count


def time_spent_from_fact(events: DataFrame) -> DataFrame:
    """Centiseconds used per ply: the mover's clock two plies ago, less this one, plus the increment."""
    in_game = Window.partitionBy("game_id").orderBy("move_number")
    used = F.lag("clock_remaining", 2).over(in_game) - F.col("clock_remaining")
    return events.withColumn("time_spent_cs", used + F.coalesce("clock_increment", F.lit(0)) * 100)


def own_plies(events: DataFrame) -> DataFrame:
    """Plies under the id and colour of the player who made them."""
    return events.withColumn("player_id", mover_id()).where(F.col("player_id").isNotNull())


def fact_moves(events: DataFrame, low_clock_cs: int = 1000) -> DataFrame:
    """Move table: mover, live phase, time used, pressure, the position after the move.

    ``is_check`` and ``is_capture`` are kept where the events have them.
    """
    flags = [c for c in ("is_check", "is_capture") if c in events.columns]
    in_game = Window.partitionBy("game_id").orderBy("move_number")
    return time_spent_from_fact(events).select(
        "game_id", "move_number", mover_id().alias("player_id"), F.col("move").alias("move_uci"),
        F.lead("fen").over(in_game).alias("fen_after"), "clock_remaining", "time_spent_cs",
        (F.col("clock_remaining") < low_clock_cs).alias("time_pressure"),
        phase(F.col("move_number"), LIVE_PHASES).alias("game_phase"), *flags,
    )


def error_profile(judged: DataFrame, error: int = 100) -> DataFrame:
    """A player's errors by phase, own clock and colour: rate, share of all their errors, weakest phase."""
    cells = (
        own_plies(judged)
        .where(F.col("loss").isNotNull() & F.col("clock_remaining").isNotNull())
        .groupBy(
            "player_id", F.col("whose_moved").alias("color"), phase(F.col("move_number")).alias("phase"),
            clock_bucket(F.col("clock_remaining")).alias("clock"),
        )
        .agg(F.count("*").alias("plies"), F.count_if(F.col("loss") >= error).alias("errors"))
    )
    # at most phases x buckets x colours rows per player from here on
    player, by_phase = Window.partitionBy("player_id"), Window.partitionBy("player_id", "phase")
    rate = F.sum("errors").over(by_phase).cast("double") / F.sum("plies").over(by_phase)
    return (
        cells.withColumn("_rate", rate)
        .withColumn("error_rate", F.round(F.col("errors").cast("double") / F.col("plies"), 6))
        .withColumn("share_of_errors", F.round(
            F.col("errors").cast("double") / F.nullif(F.sum("errors").over(player), F.lit(0)), 6))
        .withColumn("weak_phase", F.col("_rate") == F.max("_rate").over(player))
        .drop("_rate")
    )


def phase_clocks(events: DataFrame) -> DataFrame:
    """Lowest own clock per player, game and phase, with the result of the game."""
    return (
        own_plies(events)
        .where(F.col("clock_remaining").isNotNull())
        .groupBy("game_id", "player_id", phase(F.col("move_number")).alias("phase"))
        .agg(
            F.min("clock_remaining").alias("lowest_cs"),
            F.max("winner").alias("winner"),
            F.max(F.when(F.col("white_id") == F.col("player_id"), "white").otherwise("black")).alias("color"),
        )
        .select("game_id", "player_id", "phase", clock_bucket(F.col("lowest_cs"), (15, 30)).alias("clock"),
                result_of(F.col("winner"), F.col("color")).alias("result"))
    )


def win_by_clock_phase(events: DataFrame) -> DataFrame:
    return (
        phase_clocks(events)
        .groupBy("player_id", "phase", "clock")
        .agg(F.count("*").alias("games"), F.count_if(F.col("result") == "win").alias("wins"))
        .withColumn("win_pct", percent(F.col("wins"), F.col("games")))
    )


def weakness_ranking(games: DataFrame, events: DataFrame, min_games: int = 5, top: int = 3) -> DataFrame:
    """Where a player loses more games than their overall loss rate explains, the ``top`` places."""
    theirs, mine = F.col("opp_rating"), F.col("my_rating")
    labels = F.array(
        F.struct(F.lit("all").alias("kind"), F.lit("").alias("label")),
        F.struct(F.lit("opening").alias("kind"), F.concat_ws(" ", "opening_eco", "color").alias("label")),
        F.struct(F.lit("opponent").alias("kind"), F.when(theirs < mine - 100, "lower_rated")
                 .when(theirs > mine + 100, "higher_rated").otherwise("equal_rated").alias("label")),
    )
    by_game = perspective(games).select("player_id", "result", "opening_eco", F.inline(labels)).where(
        (F.col("kind") != "opening") | F.col("opening_eco").isNotNull()
    )
    by_clock = phase_clocks(events).select(
        "player_id", "result", F.lit("clock").alias("kind"), F.concat_ws(" ", "phase", "clock").alias("label")
    )
    counted = (
        by_game.drop("opening_eco")
        .unionByName(by_clock)
        .groupBy("player_id", "kind", "label")
        .agg(F.count("*").alias("games"), F.count_if(F.col("result") == "loss").alias("losses"))
    )
    player = Window.partitionBy("player_id")  # a few thousand labels per player at most
    base = F.max(F.when(F.col("kind") == "all", F.col("losses").cast("double") / F.col("games"))).over(player)
    worst = Window.partitionBy("player_id").orderBy(F.desc("impact"), "kind", "label")
    return (
        counted.withColumn("impact", F.round(F.col("losses") - F.col("games") * base, 6))
        .where((F.col("kind") != "all") & (F.col("games") >= min_games))
        .withColumn("rank", F.row_number().over(worst))
        .where(F.col("rank") <= top)
    )


def drill_positions(judged: DataFrame, error: int = 100, clock_cs: int = 1500, top: int = 7) -> DataFrame:
    """Missed better moves with little time left, the costliest ``top`` per player."""
    costliest = Window.partitionBy("player_id").orderBy(F.desc("loss"), "date", "game_id", "move_number")
    return (
        own_plies(judged)
        .where((F.col("move") != F.col("best_move")) & (F.col("loss") >= error) & (F.col("clock_remaining") < clock_cs))
        .withColumn("rank", F.row_number().over(costliest))
        .where(F.col("rank") <= top)
        .select("player_id", "rank", "game_id", "date", "move_number", "fen", "move", "best_move", "loss",
                seconds(F.col("clock_remaining")).alias("clock_s"))
    )


def drill_summary(attempts: DataFrame, drills: DataFrame) -> DataFrame:
    """Outcome of practice sessions, in total and by the time that was given.

    ``attempts``: session_id, game_id, move_number, player_id, answer, seconds.
    """
    graded = attempts.join(
        drills.select("player_id", "game_id", "move_number", "best_move", "clock_s"),
        ["player_id", "game_id", "move_number"],
    ).select(
        "session_id",
        F.when(F.col("answer").isNull(), "skipped")
        .when(F.col("answer") != F.col("best_move"), "wrong")
        .when(F.col("seconds") <= F.col("clock_s"), "in_time")
        .otherwise("late").alias("outcome"),
        F.when(F.col("clock_s") < 10, "<10").when(F.col("clock_s") <= 15, "10-15").otherwise(">15").alias("given"),
    )
    # rollup would emit the session total as given = NULL; name it instead
    return (
        graded.select("session_id", "outcome", F.explode(F.array("given", F.lit("all"))).alias("given"))
        .groupBy("session_id", "given")
        .agg(
            F.count("*").alias("attempts"),
            *[F.count_if(F.col("outcome") == o).alias(o) for o in ("in_time", "late", "wrong", "skipped")],
        )
        .withColumn("accuracy_pct", percent(F.col("in_time"), F.col("attempts")))
    )


def repeat_errors(judged: DataFrame, error: int = 100) -> DataFrame:
    """Each error with its count so far in the player's month and opening."""
    errors = (
        own_plies(judged)
        .where((F.col("loss") >= error) & F.col("opening_eco").isNotNull() & F.col("date").isNotNull())
        .select("player_id", "opening_eco", F.substring("date", 1, 7).alias("month"), "date", "game_id",
                "move_number", "loss")
    )
    return with_running_count(errors, ["player_id", "opening_eco", "month"], "date", ["game_id", "move_number"])


def tilt(games: DataFrame, events: DataFrame, streak: int = 3) -> DataFrame:
    """Time per move in games right after ``streak`` losses in a row, against the player's other games."""
    results = perspective(games).select("player_id", "game_id", "date", "result")
    before = with_previous(results, ["player_id"], "date", ["game_id"], "result", streak)
    flagged = before.select(
        "player_id", "game_id",
        ((F.size("previous") == streak) & F.forall("previous", lambda r: r == "loss")).alias("tilted"),
    )
    pace = (
        own_plies(time_spent_from_fact(events))
        .groupBy("game_id", "player_id")
        .agg(F.sum("time_spent_cs").alias("spent"), F.count("time_spent_cs").alias("timed"))
    )

    def mean(of_tilted: bool):
        pick = F.col("tilted") == of_tilted
        spent, timed = (F.sum(F.when(pick, F.col(c))) for c in ("spent", "timed"))
        return spent.cast("double") / F.nullif(timed, F.lit(0))

    return (
        pace.join(flagged, ["game_id", "player_id"])
        .groupBy("player_id")
        .agg(F.count_if("tilted").alias("tilt_games"), mean(True).alias("_t"), mean(False).alias("_o"))
        .select("player_id", "tilt_games", F.round("_t", 6).alias("tilt_cs"), F.round("_o", 6).alias("other_cs"),
                F.round(F.col("_t") / F.nullif(F.col("_o"), F.lit(0.0)), 6).alias("ratio"))
    )


def book_exit(events: DataFrame, factor: float = 3.0, from_own_ply: int = 4) -> DataFrame:
    """Per game and side the first own ply that took ``factor`` times the mean of the earlier ones."""
    side = Window.partitionBy("game_id", "whose_moved").orderBy("move_number")
    earlier = F.avg("time_spent_cs").over(side.rowsBetween(Window.unboundedPreceding, -1))
    return (
        time_spent_from_fact(events)
        .withColumn("own_ply", F.row_number().over(side))
        .withColumn("_mean", earlier)
        .where((F.col("own_ply") >= from_own_ply) & (F.col("_mean") > 0)
               & (F.col("time_spent_cs") >= factor * F.col("_mean")))
        .groupBy("game_id", "whose_moved")
        .agg(F.min("move_number").alias("exit_ply"), F.max(mover_id()).alias("player_id"))
    )


def pressure_threshold(
    judged: DataFrame, error: int = 100, step_s: int = 5, min_plies: int = 20, factor: float = 1.5
) -> DataFrame:
    """Clock below which a player's error rate leaves their own normal, and their own loss cuts.

    The threshold is the upper end of the highest ``step_s`` bucket that stands out.  Losses are counted
    per value first, so the exact percentiles work on a short list per player.
    """
    plies = own_plies(judged).where(F.col("loss").isNotNull())
    buckets = (
        plies.where(F.col("clock_remaining").isNotNull())
        .groupBy("player_id", F.floor(F.col("clock_remaining") / (step_s * 100)).alias("bucket"))
        .agg(F.count("*").alias("plies"), F.count_if(F.col("loss") >= error).alias("errors"))
    )
    player = Window.partitionBy("player_id")
    base = F.sum("errors").over(player).cast("double") / F.sum("plies").over(player)
    stands_out = (F.col("plies") >= min_plies) & (F.col("errors").cast("double") / F.col("plies") > factor * F.col("_base"))
    threshold = (
        buckets.withColumn("_base", base)
        .groupBy("player_id")
        .agg(
            F.round(F.max("_base"), 6).alias("error_rate"),
            ((F.max(F.when(stands_out, F.col("bucket"))) + 1) * step_s).cast("int").alias("threshold_s"),
        )
    )
    cuts = (
        plies.where(F.col("loss") > 0)
        .groupBy("player_id", "loss")
        .agg(F.count("*").alias("n"))
        .groupBy("player_id")
        .agg(F.percentile("loss", [0.75, 0.9, 0.97], F.col("n")).alias("p"))
        .select("player_id", *[F.round(F.get("p", F.lit(i)), 6).alias(c)
                               for i, c in enumerate(("inaccuracy_cut", "mistake_cut", "blunder_cut"))])
    )
    return threshold.join(cuts, "player_id", "left")
