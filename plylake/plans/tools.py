"""Named reports with declared parameters, and read-only SQL over the fact."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession, functions as F

from plylake.functions.columns import position_key
from plylake.operators import evals as ev, stats
from plylake.operators.games import games_from_events, games_of

Tool = Callable[..., DataFrame]


def tools(events: DataFrame, evals: DataFrame, game_table: DataFrame | None = None) -> dict[str, Tool]:
    """The reports a caller may run by name, bound to a fact table and its evaluations.

    With a published game table (``sinks.publish_games``) the reports at game grain do not read the fact.
    """

    def games(player_id: str) -> DataFrame:
        if game_table is not None:
            return games_of(game_table, player_id)
        # cut to the player before repeats are removed, so that the filter reaches the scan
        return games_from_events(games_of(events, player_id))

    def get_player_overview(player_id: str) -> DataFrame:
        return stats.player_overview(games(player_id), player_id).orderBy("total_games", "speed", ascending=[False, True])

    def get_time_pressure_stats(player_id: str, semantics: str = stats.REFERENCE) -> DataFrame:
        return stats.time_pressure(events, player_id, semantics)

    def get_opening_stats(player_id: str, top_n: int = 10, min_games: int = 2) -> DataFrame:
        return stats.opening_stats(games(player_id), player_id, top_n, min_games).orderBy("rank")

    def get_clock_usage_by_phase(player_id: str, semantics: str = stats.REFERENCE) -> DataFrame:
        return stats.clock_by_phase(events, player_id, semantics).orderBy("phase")

    def get_performance_by_color(player_id: str) -> DataFrame:
        return stats.by_color(games(player_id), player_id)

    def get_performance_vs_rating(player_id: str, margin: int = 100) -> DataFrame:
        return stats.vs_rating(games(player_id), player_id, margin)

    def get_recent_games(player_id: str, limit: int = 10) -> DataFrame:
        return stats.recent_games(games(player_id), player_id, limit).orderBy("rank")

    def analyze_game(game_id: str, semantics: str = stats.REFERENCE) -> DataFrame:
        one_game = events.where(events.game_id == game_id)
        if one_game.isEmpty():
            raise LookupError(f"no game {game_id!r}")
        # the game's own positions, no more than it has plies, cut the evaluations before anything else
        here = one_game.select(position_key(F.col("fen")).alias("_here")).distinct()
        wanted = evals.join(F.broadcast(here), position_key(evals.fen) == F.col("_here"), "left_semi")
        judged = ev.judge_moves(ev.attach_evals(one_game, F.broadcast(wanted), hot_keys=0), semantics)
        return ev.judgement_columns(judged).orderBy("move_number")

    found = [
        get_player_overview, get_time_pressure_stats, get_opening_stats, get_clock_usage_by_phase,
        get_performance_by_color, get_performance_vs_rating, get_recent_games, analyze_game,
    ]
    return {tool.__name__: tool for tool in found}


def declarations(registry: Mapping[str, Tool]) -> dict[str, dict[str, dict]]:
    """Parameters of every tool: type, whether required, default."""
    out: dict[str, dict[str, dict]] = {}
    for name, tool in registry.items():
        out[name] = {
            p.name: {"type": str(p.annotation), "required": p.default is p.empty,
                     "default": None if p.default is p.empty else p.default}
            for p in inspect.signature(tool).parameters.values()
        }
    return out


def run_tool(registry: Mapping[str, Tool], name: str, **args) -> DataFrame:
    if name not in registry:
        raise KeyError(f"unknown tool {name!r}; known are {', '.join(sorted(registry))}")
    inspect.signature(registry[name]).bind(**args)
    return registry[name](**args)


def run_sql(spark: SparkSession, text: str, cap: int | None = None, args: Mapping | None = None) -> DataFrame:
    """The rows of a query over the registered views; values go in as named ``args``.

    The text is read as a subquery, which can hold nothing that writes.  With ``cap`` at most that many rows come.
    """
    try:
        rows = spark.sql(f"SELECT * FROM (\n{text.strip().rstrip(';')}\n)", args=dict(args or {}))
    except ParseException as error:
        raise ValueError("only SELECT queries are allowed") from error
    return rows if cap is None else rows.limit(cap)
