"""Named queries: every operator run over the driver's whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plylake import fixtures as fx
from plylake.functions import columns as col_fn
from plylake.operators import evals as ev, events, expand, openings, patterns, players, positions, stats, vector_index
from plylake.operators.games import games_from_events, perspective as sides_of
from plylake.plans import tools
from plylake.session import scratch_path, ship_package
from plylake.sources import dumps, landing, sinks
from plylake.streaming import discover, land, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games_from_events(fx.move_events(spark, sf_dir))


@query
def move_events(spark, sf_dir):
    return fx.move_events(spark, sf_dir)


@query
def games(spark, sf_dir):
    return _games(spark, sf_dir).drop("fen", "move")


@query
def perspective(spark, sf_dir):
    return sides_of(_games(spark, sf_dir)).select(
        "game_id", "player_id", "color", "opponent_id", "my_rating", "opp_rating", "result", "speed", "date"
    )


@query
def player_overview(spark, sf_dir):
    return stats.player_overview(_games(spark, sf_dir))


@query
def player_totals(spark, sf_dir):
    return stats.player_totals(_games(spark, sf_dir))


@query
def player_totals_corrected(spark, sf_dir):
    return stats.player_totals(_games(spark, sf_dir), semantics=stats.CORRECTED)


@query
def time_pressure(spark, sf_dir):
    return stats.time_pressure(fx.move_events(spark, sf_dir))


@query
def time_pressure_own(spark, sf_dir):
    return stats.time_pressure(fx.move_events(spark, sf_dir), semantics=stats.CORRECTED)


@query
def opening_stats(spark, sf_dir):
    return stats.opening_stats(_games(spark, sf_dir))


@query
def clock_by_phase(spark, sf_dir):
    return stats.clock_by_phase(fx.move_events(spark, sf_dir))


@query
def clock_by_phase_own(spark, sf_dir):
    return stats.clock_by_phase(fx.move_events(spark, sf_dir), semantics=stats.CORRECTED)


@query
def by_color(spark, sf_dir):
    return stats.by_color(_games(spark, sf_dir))


@query
def vs_rating(spark, sf_dir):
    return stats.vs_rating(_games(spark, sf_dir))


@query
def daily_volume(spark, sf_dir):
    return stats.daily_volume(fx.move_events(spark, sf_dir))


@query
def recent_games(spark, sf_dir):
    return stats.recent_games(_games(spark, sf_dir))


@query
def game_replay(spark, sf_dir):
    return stats.game_replay(fx.move_events(spark, sf_dir))


@query
def merge_top_lists(spark, sf_dir):
    seen = fx.table(spark, sf_dir, "events")
    lists = [
        seen.where(F.col("event_type") == kind)
        .groupBy(F.col("user_id").cast("string").alias("id"))
        .agg(F.min("event_id").alias("rank"))
        for kind in ("click", "view", "purchase", "signup", "error")
    ]
    return stats.merge_top_lists(*lists)


# ---------------------------------------------------------------------------- evaluations


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.attach_evals(fx.move_events(spark, sf_dir), fx.evals(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.judge_moves(_evaluated(spark, sf_dir), stats.CORRECTED)


@query
def attach_evals(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("game_id", "move_number", "fen", "cp", "mate", "best_move")


@query
def positions_to_eval(spark, sf_dir):
    return ev.positions_to_eval(fx.move_events(spark, sf_dir), fx.evals(spark, sf_dir, missing="p_size = 1"))


@query
def judge_moves(spark, sf_dir):
    return ev.judgement_columns(ev.judge_moves(_evaluated(spark, sf_dir), stats.REFERENCE))


@query
def judge_moves_corrected(spark, sf_dir):
    return ev.judgement_columns(_judged(spark, sf_dir))


@query
def game_judgement(spark, sf_dir):
    return ev.game_judgement(ev.judge_moves(_evaluated(spark, sf_dir), stats.REFERENCE))


@query
def eval_curve(spark, sf_dir):
    return ev.eval_curve(_evaluated(spark, sf_dir))


@query
def eval_swings(spark, sf_dir):
    return ev.eval_swings(ev.eval_curve(_evaluated(spark, sf_dir)))


@query
def eval_label(spark, sf_dir):
    return fx.evals(spark, sf_dir).select("fen", col_fn.eval_label(F.col("cp")).alias("label"))


@query
def opening_label(spark, sf_dir):
    return _games(spark, sf_dir).select(
        "game_id", col_fn.opening_label(F.col("opening_eco"), F.col("opening_name")).alias("label")
    )


@query
def game_digest(spark, sf_dir):
    return ev.game_digest(_evaluated(spark, sf_dir))


@query
def win_probability(spark, sf_dir):
    return ev.win_probability(_evaluated(spark, sf_dir))


@query
def turning_point(spark, sf_dir):
    return ev.turning_point(_judged(spark, sf_dir))


@query
def winning_not_won(spark, sf_dir):
    return ev.winning_not_won(_evaluated(spark, sf_dir))


# ---------------------------------------------------------------------------- landing and the fact


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.decode(fx.start_messages(spark, sf_dir), "game_start")


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.decode(fx.end_messages(spark, sf_dir), "game_end")


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.decode(fx.export_messages(spark, sf_dir), "moves")


@query
def decode_starts(spark, sf_dir):
    return _starts(spark, sf_dir).drop("ingested_at")


@query
def event_date(spark, sf_dir):
    return _exports(spark, sf_dir).select("id", "date")


@query
def decode_props(spark, sf_dir):
    props = F.from_json("props", "k int").alias("p")
    return fx.table(spark, sf_dir, "events").select("event_id", props).select("event_id", "p.k")


@query
def route_starts(spark, sf_dir):
    return events.route_events(events.parse_status_events(fx.status_messages(spark, sf_dir)))[0]


@query
def route_ends(spark, sf_dir):
    return events.route_events(events.parse_status_events(fx.status_messages(spark, sf_dir)))[1]


@query
def explode_moves(spark, sf_dir):
    return expand.explode_moves(_exports(spark, sf_dir)).select(
        F.col("id").alias("game_id"), "move_number", "move", "whose_moved", "clock_remaining",
        F.col("opening.eco").alias("opening_eco"), F.col("clock.increment").alias("clock_increment"),
    )


def _built(spark: SparkSession, sf_dir: str, slack_days: int, positions: DataFrame | None = None) -> DataFrame:
    return expand.build_move_events(
        _exports(spark, sf_dir), _starts(spark, sf_dir), _ends(spark, sf_dir), slack_days=slack_days, positions=positions
    )


@query
def build_move_events(spark, sf_dir):
    return _built(spark, sf_dir, 0, fx.export_positions(spark, sf_dir))


@query
def build_move_events_midnight(spark, sf_dir):
    return _built(spark, sf_dir, 1)


@query
def scan_partition(spark, sf_dir):
    """Landing write and the read of every date back, by games per date."""
    root = scratch_path(spark, "landing")
    _starts(spark, sf_dir).hint("rebalance", "date").write.partitionBy("date").parquet(f"{root}/game_start")
    return landing.read_landing(spark, root, "game_start").groupBy("date").agg(
        F.count("*").alias("starts"), F.countDistinct("game_id").alias("games")
    )


@query
def publish_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "fact")
    fact = fx.move_events(spark, sf_dir).withColumn("date", F.concat(F.substring("date", 1, 7), F.lit("-01")))
    sinks.publish(fact, path)
    sinks.publish(fact, path)
    return landing.read_fact(spark, path)


@query
def published_games(spark, sf_dir):
    """The game table after every January was replaced in the fact, by games that White won."""
    fact_path, games_path = scratch_path(spark, "fact"), scratch_path(spark, "games")
    fact = fx.move_events(spark, sf_dir).withColumn("date", F.concat(F.substring("date", 1, 7), F.lit("-01")))
    sinks.publish(fact, fact_path)
    sinks.publish_games(landing.read_fact(spark, fact_path), games_path)
    january = fact.where("substr(date, 6, 2) = '01'").withColumn("winner", F.lit("white"))
    sinks.publish(january, fact_path)
    dates = [r.date for r in january.select("date").distinct().collect()]  # one for each January
    sinks.publish_games(landing.read_fact(spark, fact_path), games_path, dates)
    return landing.read_games(spark, games_path)


@query
def read_exports(spark, sf_dir):
    """Newline-JSON exports of every game, with lines that are no export among them."""
    path = scratch_path(spark, "exports")
    fx.export_messages(spark, sf_dir).unionByName(fx.broken_messages(spark, sf_dir)).write.text(path)
    return landing.read_exports(spark, path)[0].select("id", "moves", "clocks", "status", F.col("opening.eco").alias("eco"))


@query
def csv_roundtrip(spark, sf_dir):
    path, overview = scratch_path(spark, "csv"), stats.player_overview(_games(spark, sf_dir))
    sinks.write_csv(overview, path)
    return spark.read.csv(path, header=True, schema=overview.schema)


@query
def export_requests(spark, sf_dir):
    """Ended games without an export, as request lists; compared by the ids they hold."""
    lists = events.export_requests(_ends(spark, sf_dir), _exports(spark, sf_dir))
    return lists.select(F.explode("ids").alias("game_id"), (F.size("ids") <= 300).alias("fits"))


@query
def new_players(spark, sf_dir):
    known = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("player_id"))
    return discover.new_players(discover.players_of(_starts(spark, sf_dir)), known)


@query
def replay(spark, sf_dir):
    """Movetext joined to its positions; every seventh game has a token without one."""
    games = fx.knight_games(spark, sf_dir)
    known = fx.knight_positions(games).where("cast(game_id as long) % 7 <> 0 OR move_number <= 8")
    return positions.positioned_plies(games.select("game_id", "moves"), known)


@query
def live_board(spark, sf_dir):
    games = fx.knight_games(spark, sf_dir)
    return positions.live_board(games.select("game_id", F.col("live_moves").alias("moves")), fx.knight_positions(games))


# ---------------------------------------------------------------------------- streams


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = fx.table(spark, sf_dir, "events").schema
    # one file per trigger bounds what a trigger holds of a single game
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1)
    return fx.live_events(reader.parquet(sf_dir))


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    root = scratch_path(spark, name)
    land.append_files(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """The landing tables of the starts, good and broken ones, in two files and so in two micro-batches."""
    root = scratch_path(spark, "topics")
    for messages in (fx.start_messages(spark, sf_dir), fx.broken_messages(spark, sf_dir)):
        messages.write.mode("append").text(f"{root}/in/game_start")
    source = landing.TopicSource("text", f"{root}/in", {"maxFilesPerTrigger": "1"})
    land.land(spark, source, "game_start", f"{root}/out", f"{root}/checkpoints").awaitTermination()
    return f"{root}/out"


@query
def land_events(spark, sf_dir):
    return landing.read_landing(spark, _landed(spark, sf_dir), "game_start").drop("ingested_at")


@query
def land_quarantine(spark, sf_dir):
    return landing.read_quarantine(spark, _landed(spark, sf_dir), "game_start").select("value")


@query
def land_counts(spark, sf_dir):
    """What the batches report, next to what the tables hold."""
    root = _landed(spark, sf_dir)
    reported = landing.read_batches(spark, root, "game_start").agg(*[F.sum(c).alias(c) for c in ("messages", "landed", "quarantined")])
    held = landing.read_landing(spark, root, "game_start").agg(F.count("*").alias("n"), F.lit("landed").alias("kind"))
    kept = landing.read_quarantine(spark, root, "game_start").agg(F.count("*").alias("n"), F.lit("quarantined").alias("kind"))
    told = reported.select(F.inline(F.array(
        F.struct(F.col("landed").alias("reported"), F.lit("landed").alias("kind"), "messages"),
        F.struct(F.col("quarantined").alias("reported"), F.lit("quarantined").alias("kind"), "messages"),
    )))
    return told.join(held.unionByName(kept), "kind").select("kind", "messages", "reported", F.col("n").alias("held"))


@query
def time_spent(spark, sf_dir):
    return live.time_spent(fx.live_events(fx.table(spark, sf_dir, "events")))


@query
def live_features(spark, sf_dir):
    return _drained(spark, live.live_features(_event_stream(spark, sf_dir)), "live")


@query
def new_games(spark, sf_dir):
    stream = live.new_games(_event_stream(spark, sf_dir)).select("game_id")
    return _drained(spark, stream, "new-games")


@query
def discover_players(spark, sf_dir):
    root = scratch_path(spark, "players")
    fx.start_messages(spark, sf_dir).write.text(f"{root}/in/game_start")
    source = landing.TopicSource("text", f"{root}/in", {"maxFilesPerTrigger": "1"})
    starts = events.decode(landing.read_topic(spark, source, "game_start"), "game_start")
    discover.discover_players(starts, f"{root}/known", f"{root}/checkpoint", availableNow=True).awaitTermination()
    return discover.read_known(spark, f"{root}/known").select("player_id")


@query
def time_spent_fact(spark, sf_dir):
    return patterns.time_spent_from_fact(fx.move_events(spark, sf_dir)).select(
        "game_id", "move_number", "whose_moved", "clock_remaining", "time_spent_cs"
    )


@query
def run_sql(spark, sf_dir):
    """Mean rating, shortest clock and share of drawn games by speed and month, asked in SQL."""
    fx.move_events(spark, sf_dir).createOrReplaceTempView("move_events")
    return tools.run_sql(spark, """
        SELECT speed, left(date, 7) AS month, count(*) AS games, round(avg(white_rating + black_rating) / 2, 3) AS mean_rating,
               min(clock_remaining) AS least_clock, round(count_if(winner IS NULL) / count(*), 6) AS drawn_share
        FROM move_events WHERE move_number = 1 GROUP BY speed, left(date, 7)""")


# ---------------------------------------------------------------------------- documented analytics


@query
def dim_players(spark, sf_dir):
    starts, _ = events.route_events(events.parse_status_events(fx.status_messages(spark, sf_dir)))
    return players.dim_players(starts)


@query
def dim_games(spark, sf_dir):
    return players.dim_games(_starts(spark, sf_dir), _ends(spark, sf_dir), _exports(spark, sf_dir)).select(
        "game_id", "white_id", "black_id", "speed", "rated", "winner", "status", "opening_eco", "opening_name",
        "total_moves", "started_at", "ended_at",
    )


@query
def fact_moves(spark, sf_dir):
    return patterns.fact_moves(fx.move_events(spark, sf_dir))


@query
def opening_lookup(spark, sf_dir):
    games = _exports(spark, sf_dir).select(F.col("id").alias("game_id"), "moves")
    return openings.opening_lookup(games, fx.opening_book(spark, sf_dir))


@query
def eco_rollup(spark, sf_dir):
    return openings.eco_rollup(_games(spark, sf_dir))


@query
def opening_by_band(spark, sf_dir):
    return openings.opening_by_band(_games(spark, sf_dir))


@query
def next_moves(spark, sf_dir):
    return openings.next_moves(fx.move_events(spark, sf_dir))


def _next_after_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openings.next_after_opening(fx.move_events(spark, sf_dir), fx.opening_plies(spark, sf_dir))


@query
def next_after_opening(spark, sf_dir):
    return _next_after_opening(spark, sf_dir)


@query
def stat_chunks(spark, sf_dir):
    return openings.stat_chunks(openings.opening_by_band(_games(spark, sf_dir)), _next_after_opening(spark, sf_dir))


@query
def error_profile(spark, sf_dir):
    return patterns.error_profile(_judged(spark, sf_dir))


@query
def similar_players(spark, sf_dir):
    return players.similar_players(_games(spark, sf_dir))


@query
def win_by_clock_phase(spark, sf_dir):
    return patterns.win_by_clock_phase(fx.move_events(spark, sf_dir))


@query
def weakness_ranking(spark, sf_dir):
    return patterns.weakness_ranking(_games(spark, sf_dir), fx.move_events(spark, sf_dir))


@query
def drill_positions(spark, sf_dir):
    return patterns.drill_positions(_judged(spark, sf_dir))


@query
def drill_summary(spark, sf_dir):
    drills = patterns.drill_positions(_judged(spark, sf_dir))
    attempts = drills.selectExpr(
        "concat('s', player_id) as session_id", "player_id", "game_id", "move_number",
        "case when move_number % 4 = 0 then null when move_number % 4 = 1 then 'x' else best_move end as answer",
        "cast(move_number % 16 as double) as seconds",
    )
    return patterns.drill_summary(attempts, drills)


@query
def repeat_errors(spark, sf_dir):
    return patterns.repeat_errors(_judged(spark, sf_dir))


@query
def tilt(spark, sf_dir):
    return patterns.tilt(_games(spark, sf_dir), fx.move_events(spark, sf_dir))


@query
def book_exit(spark, sf_dir):
    return patterns.book_exit(fx.move_events(spark, sf_dir))


@query
def pressure_threshold(spark, sf_dir):
    return patterns.pressure_threshold(_judged(spark, sf_dir))


@query
def similar_positions(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings")
    pasted = vectors.orderBy("vec_id").first()["embedding"]  # stands for the position a user pastes
    return players.similar_positions(vectors, pasted)


@query
def similar_positions_all(spark, sf_dir):
    """The five nearest vectors of every vector whose id is divisible by 100, by an index over all vectors."""
    vectors, path = fx.table(spark, sf_dir, "embeddings"), scratch_path(spark, "vector-index")
    vector_index.build_index(vectors, path)
    return vector_index.nearest(spark, path, vectors.where("vec_id % 100 = 0"))


@query
def claim_accuracy(spark, sf_dir):
    totals = stats.player_totals(_games(spark, sf_dir))
    facts = totals.selectExpr("player_id as key", "stack(2, 'games', cast(total_games as double), 'win_pct', win_pct) as (metric, value)")
    claims = fx.table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey % 60 as string) as key", "if(c_custkey % 2 = 0, 'games', 'win_pct') as metric",
        "cast(20 + c_custkey % 45 as double) as value",
    )
    return players.claim_accuracy(claims, facts, tolerance=5.0)


@query
def detection_quality(spark, sf_dir):
    """Blunders by the reference form against those by the corrected form, judged in one pass."""
    blunder = F.col("classification") == "blunder"
    said = ev.judge_moves(_evaluated(spark, sf_dir), stats.REFERENCE).withColumn("predicted", blunder)
    return players.detection_quality(ev.judge_moves(said, stats.CORRECTED).withColumn("actual", blunder))


@query
def rating_change(spark, sf_dir):
    return players.rating_change(_games(spark, sf_dir))


@query
def backfill_union(spark, sf_dir):
    history = dumps.backfill_games(_exports(spark, sf_dir))
    return dumps.backfill_union(_built(spark, sf_dir, 0), history).select(
        "game_id", "move_number", "move", "white_id", "white_rating", "winner", "date", "opening_ply",
        "white_rating_diff",
    )


@query
def read_pgn(spark, sf_dir):
    path = scratch_path(spark, "pgn")
    fx.pgn_records(spark, sf_dir).write.text(path)
    return dumps.read_pgn(spark, path).drop("opening_ply", "tournament_id")


@query
def best_evals(spark, sf_dir):
    return dumps.best_evals(fx.eval_lines(spark, sf_dir))


@query
def scope_filter(spark, sf_dir):
    return players.scope_filter(_games(spark, sf_dir), ("bullet", "blitz"), 1300, 1700).select(
        "game_id", "player_id", "speed", "my_rating", "result"
    )


@query
def rating_trend(spark, sf_dir):
    return players.rating_trend(_games(spark, sf_dir))
