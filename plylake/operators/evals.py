"""Position evaluations: joining them to plies, judging moves, curves and per-game digests.

Windows here are per game; the rules of the game bound their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from plylake.functions.columns import (
    mover_id, mover_sign, position_key, seconds, severity, win_probability as probability,
)
from plylake.operators.stats import CORRECTED, REFERENCE, check_semantics

def in_game() -> WindowSpec:
    return Window.partitionBy("game_id").orderBy("move_number")


def frequent_positions(events: DataFrame, k: int = 1000, buckets: int = 64) -> DataFrame:
    """Up to ``k`` of the most frequent positions, from mergeable sketches of fixed size.

    Positions are hashed to ``buckets``, so the sketches of all map tasks meet in that many tasks and
    not in one.  A sketch may miss a position or rank it wrongly; it only decides which join a
    position takes.
    """
    per_bucket = -(-2 * k // buckets)
    tops = (
        events.select(position_key(F.col("fen")).alias("position"))
        .where(F.col("position").isNotNull())
        .groupBy(F.pmod(F.xxhash64("position"), F.lit(buckets)).alias("bucket"))
        .agg(F.expr(f"approx_top_k(position, {per_bucket}, {4 * per_bucket})").alias("top"))
    )
    return (
        tops.select(F.inline("top")).orderBy(F.desc("count"), "item").limit(k).select(F.col("item").alias("hot_position"))
    )


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the optimizer's size estimate is within the session's broadcast threshold."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


def attach_evals(events: DataFrame, evals: DataFrame, hot_keys: int | None = None) -> DataFrame:
    """Left join of plies to evaluations on the position; ``evals`` holds one row per position.

    Early positions occur in most games, so a shuffle on the position would send them to one task.
    An ``evals`` table of broadcast size is never shuffled against.  Beyond that the evaluations of the
    ``hot_keys`` (default 1000) most frequent positions are broadcast, their number being the bound,
    and only the other plies are shuffled.  0 leaves it all to the optimizer.
    """
    columns = ["cp", "mate", "best_move", "evaluated"]
    keyed = events.withColumn("position", position_key(F.col("fen")))
    known = evals.select(
        position_key(F.col("fen")).alias("position"), "cp", "mate", "best_move", F.lit(True).alias("evaluated")
    )
    if hot_keys is None:
        hot_keys = 0 if fits_broadcast(known) else 1000
    if not hot_keys:
        return keyed.join(known, "position", "left").drop("position")
    hot = frequent_positions(events, hot_keys)
    hot_evals = F.broadcast(
        hot.join(known, hot.hot_position == known.position, "left").select(
            "hot_position", *[F.col(c).alias(f"hot_{c}") for c in columns]
        )
    )
    tagged = keyed.join(hot_evals, keyed.position == hot_evals.hot_position, "left")
    from_hot = [F.col(f"hot_{c}").alias(c) for c in columns]
    done = tagged.where(F.col("hot_position").isNotNull()).select(*events.columns, *from_hot)
    # naming the hot columns here too keeps both branches on the same broadcast
    either = [F.coalesce(f"hot_{c}", c).alias(c) for c in columns]
    rest = tagged.where(F.col("hot_position").isNull()).join(known, "position", "left")
    return done.unionByName(rest.select(*events.columns, *either))


def positions_to_eval(events: DataFrame, evals: DataFrame) -> DataFrame:
    """Positions that occur and have no evaluation yet."""
    seen = events.select(position_key(F.col("fen")).alias("position")).where(F.col("position").isNotNull())
    known = evals.select(position_key(F.col("fen")).alias("position"))
    return seen.distinct().join(known, "position", "left_anti")


def judge_moves(
    evaluated: DataFrame, semantics: str = CORRECTED, cuts: tuple[int, int, int] = (50, 100, 200)
) -> DataFrame:
    """Class of each ply by its evaluation change.

    Reference form: previous row's score minus this one's, the same for both colours.  Corrected form:
    the mover's loss from this position to the next one, NULL on the last ply.
    """
    check_semantics(semantics)
    if semantics == REFERENCE:
        delta = F.col("cp") - F.lag("cp").over(in_game())
        judged = evaluated.withColumn("eval_delta", delta).withColumn("loss", -F.col("eval_delta"))
    else:
        judged = evaluated.withColumn("eval_delta", F.lead("cp").over(in_game()) - F.col("cp")).withColumn(
            "loss", -mover_sign() * F.col("eval_delta")
        )
    return judged.withColumn("classification", severity(F.col("loss"), cuts))


def judgement_columns(judged: DataFrame) -> DataFrame:
    return judged.select(
        "game_id", "move_number", "whose_moved", "move", F.col("cp").alias("eval_cp"), "eval_delta",
        "best_move", "classification", seconds(F.col("clock_remaining")).alias("clock_s"),
    )


def game_judgement(judged: DataFrame) -> DataFrame:
    def count_of(name: str) -> Column:
        return F.count_if(F.col("classification") == name)

    return judged.groupBy("game_id").agg(
        count_of("blunder").alias("blunders"),
        count_of("mistake").alias("mistakes"),
        count_of("inaccuracy").alias("inaccuracies"),
        F.count("*").alias("total_moves"),
        F.coalesce(F.max("winner"), F.lit("draw")).alias("result"),
    )


def eval_curve(evaluated: DataFrame, mate_cp: int = 3000) -> DataFrame:
    """Score in pawns per evaluated ply; a mate counts as plus or minus ``mate_cp``, no score as 0."""
    cp = (
        F.when(F.col("mate") > 0, mate_cp)
        .when(F.col("mate").isNotNull(), -mate_cp)
        .otherwise(F.coalesce("cp", F.lit(0)))
    )
    return evaluated.where(F.col("evaluated")).select(
        "game_id", "move_number", (cp.cast("double") / 100.0).alias("eval")
    )


def eval_swings(curve: DataFrame, big: float = 2.0, small: float = 0.5) -> DataFrame:
    swing = F.abs(F.col("eval") - F.lag("eval", 1, 0.0).over(in_game()))
    return curve.withColumn("swing", F.round(swing, 6)).withColumn(
        "color", F.when(F.col("swing") > big, "red").when(F.col("swing") > small, "green").otherwise("blue")
    )


def win_probability(evaluated: DataFrame, slope: float = 0.00368208) -> DataFrame:
    """White's chance before and after each move, and the chance the mover gave away."""
    now = probability(F.col("cp"), F.col("mate"), slope)
    return evaluated.withColumn("_p", now).select(
        "game_id", "move_number",
        F.round("_p", 6).alias("white_chance"),
        F.round(F.lead("_p").over(in_game()), 6).alias("white_chance_after"),
        F.round(mover_sign() * (F.col("_p") - F.lead("_p").over(in_game())), 6).alias("chance_lost"),
    )


def turning_point(judged: DataFrame, decisive: int = 200) -> DataFrame:
    """Per game the move with the greatest loss; the earliest on ties."""
    worst = F.max_by(
        F.struct("move_number", "whose_moved", mover_id().alias("player_id"), "loss"),
        F.struct("loss", -F.col("move_number")),
    )
    return (
        judged.where(F.col("loss").isNotNull())
        .groupBy("game_id")
        .agg(worst.alias("w"))
        .select(
            "game_id", "w.move_number", (F.col("w.move_number") - 1).alias("ply_before"), "w.whose_moved",
            "w.player_id", "w.loss", (F.col("w.loss") >= decisive).alias("decisive"),
        )
    )


def winning_not_won(evaluated: DataFrame, edge: int = 200) -> DataFrame:
    """Player-games that reached more than ``edge`` for the player and were not won."""
    sides = F.array(
        F.struct(F.col("white_id").alias("player_id"), F.lit("white").alias("color"), F.col("cp").alias("own_cp")),
        F.struct(F.col("black_id").alias("player_id"), F.lit("black").alias("color"), (-F.col("cp")).alias("own_cp")),
    )
    return (
        evaluated.where(F.abs("cp") > edge)
        .select("game_id", "move_number", "winner", F.inline(sides))
        .where((F.col("own_cp") > edge) & F.col("player_id").isNotNull())
        .where(F.col("winner").isNull() | (F.col("winner") != F.col("color")))
        .groupBy("game_id", "player_id", "color")
        .agg(
            F.min("move_number").alias("first_ply"),
            F.max("own_cp").alias("best_cp"),
            F.when(F.max("winner").isNull(), "draw").otherwise("loss").alias("result"),
        )
    )


def game_digest(evaluated: DataFrame) -> DataFrame:
    """One text per game: header, result and a line per ply with its evaluation."""
    # The wording and number formats below are the format of the digest.
    score = (
        F.when(F.col("mate").isNotNull(), F.format_string("Mate in %d", F.abs("mate")))
        .when(F.col("cp").isNotNull(), F.format_string("%+.2f", F.col("cp") / 100.0))
        .otherwise("?")
    )
    line = F.format_string(
        "  Move %d (%s) %s: eval=%s",
        "move_number", F.upper(F.substring("whose_moved", 1, 1)), "move", score,
    )

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    header = F.struct(
        F.concat(F.lit("Players: "), text("white_id"), F.lit(" (White, "), text("white_rating"),
                 F.lit(") vs "), text("black_id"), F.lit(" (Black, "), text("black_rating"), F.lit(")")).alias("players"),
        F.concat(F.lit("Opening: "), text("opening_name"), F.lit(" ("), text("opening_eco"),
                 F.lit("), Speed: "), text("speed")).alias("opening"),
        F.concat(F.lit("Result: "), F.coalesce(F.concat(F.initcap("winner"), F.lit(" wins")), F.lit("Draw"))).alias("result"),
    )
    return (
        evaluated.groupBy("game_id")
        .agg(
            F.min(header).alias("h"),
            F.array_sort(F.collect_list(F.struct("move_number", line.alias("line")))).alias("lines"),
        )
        .select(
            "game_id",
            F.concat_ws(
                "\n",
                F.concat(F.lit("Game ID: "), F.col("game_id")), "h.players", "h.opening", "h.result", F.lit(""),
                F.lit("Move-by-move evaluations (centipawns, positive = White advantage):"),
                F.transform("lines", lambda x: x["line"]),
            ).alias("digest"),
        )
    )
