"""Operators over the live stream of game states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plylake.functions.columns import LIVE_PHASES, clock_in_seconds, fullmove_number, phase
from plylake.operators.ordered import with_previous

FEATURES = [
    "game_id", "event_id", "ts", "ply", "move_number", "game_phase", "whose_moved", "white_clock",
    "black_clock", "time_pressure", "time_spent_s",
]
_STATELESS = FEATURES[:-1]
_SCHEMA = (
    "game_id string, event_id bigint, ts timestamp, ply int, move_number int, game_phase string, "
    "whose_moved string, white_clock int, black_clock int, time_pressure boolean, time_spent_s int"
)


def ply_of(moves: Column) -> Column:
    """Ply from a cumulative, space-separated move list."""
    return F.size(F.filter(F.split(F.coalesce(moves, F.lit("")), r"\s+"), lambda m: m != "")).cast("int")


def live_columns(states: DataFrame, low_clock_s: int = 10) -> DataFrame:
    """Everything about a live state that needs no earlier one."""
    return states.select(
        "game_id", "event_id", "ts", "ply",
        fullmove_number(F.col("ply")).alias("move_number"),
        phase(F.col("ply"), LIVE_PHASES).alias("game_phase"),
        F.when(F.col("ply") % 2 == 1, "white").otherwise("black").alias("whose_moved"),
        clock_in_seconds(F.coalesce("wc", F.lit(0))).alias("white_clock"),
        clock_in_seconds(F.coalesce("bc", F.lit(0))).alias("black_clock"),
    ).withColumn("time_pressure", (F.col("white_clock") < low_clock_s) | (F.col("black_clock") < low_clock_s))


def time_spent(states: DataFrame) -> DataFrame:
    """Batch form: seconds since the mover's clock in the previous state of the game.

    NULL without a previous state or where its clock is 0.  Live ids may recur over a long time, so the
    look-back runs day by day with a carry.
    """
    live = live_columns(states).withColumn("_clocks", F.struct("white_clock", "black_clock"))
    dated = live.withColumn("_day", F.to_date("ts"))
    seen = with_previous(dated, ["game_id"], "_day", ["ts", "event_id"], "_clocks", 1, "_previous")
    before = F.get("_previous", F.lit(0))
    white = F.col("whose_moved") == "white"
    now = F.when(white, F.col("white_clock")).otherwise(F.col("black_clock"))
    then = F.when(white, before["white_clock"]).otherwise(before["black_clock"])
    return seen.withColumn("time_spent_s", F.nullif(then, F.lit(0)) - now).select(*FEATURES)


def _advance(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    batch = pd.concat(list(rows))
    batch = batch.iloc[np.lexsort((batch["event_id"].to_numpy(), batch["ts"].to_numpy()))]
    white, black = (batch[c].to_numpy(dtype="float64") for c in ("white_clock", "black_clock"))
    last = state.get if state.exists else (np.nan, np.nan)
    whites_turn = (batch["whose_moved"] == "white").to_numpy()
    then = np.where(whites_turn, np.append(last[0], white[:-1]), np.append(last[1], black[:-1]))
    spent = np.where(then == 0, np.nan, then) - np.where(whites_turn, white, black)
    state.update((int(white[-1]), int(black[-1])))
    yield batch.assign(time_spent_s=pd.array(spent, dtype="Float64").astype("Int32"))[FEATURES]


def live_features(states: DataFrame) -> DataFrame:
    """Streaming form of ``time_spent``; the state of a game is its two last clocks.

    Rows of one micro-batch are put in time order; across micro-batches the previous state is the one
    handled last.  Nothing is dropped: a late row counts when it comes, and a game's two clocks are kept
    however long its next move takes.  A task holds one game's rows of one trigger: give the source
    its rate option (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``), which is the bound on them.
    """
    return (
        live_columns(states)
        .groupBy("game_id")
        .applyInPandasWithState(_advance, _SCHEMA, "w int, b int", "append", GroupStateTimeout.NoTimeout)
    )


def new_games(states: DataFrame, remember: str | None = None) -> DataFrame:
    """First sight of each game id.

    Every id is remembered, as one key of state each.  With ``remember`` (longer than any game lasts) an id is
    forgotten that long after it was seen.
    """
    if remember is None:
        return states.dropDuplicates(["game_id"])
    return states.withWatermark("ts", remember).dropDuplicatesWithinWatermark(["game_id"])
