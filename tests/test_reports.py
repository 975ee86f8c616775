"""Report boundaries and the settled quirks, on rows written by hand."""

import pytest
from pyspark.sql import functions as F

from builders import facts
from plylake.functions import columns as c
from plylake.operators import stats
from plylake.operators.games import games_from_events, perspective


def one(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    found = df.collect()
    assert len(found) == 1
    return found[0]


def test_results_add_up_and_duplicates_change_nothing(spark):
    events = facts(
        spark, {}, {"game_id": "g2", "winner": "black"}, {"game_id": "g3", "winner": None},
        {"game_id": "g4", "white_id": "b", "black_id": "w", "winner": "black"},
    )
    got = one(stats.player_overview(games_from_events(events)), player_id="w")
    assert (got.total_games, got.wins, got.losses, got.draws) == (4, 2, 1, 1)
    twice = stats.player_overview(games_from_events(events.unionAll(events)))
    assert one(twice, player_id="w") == got


def test_unique_fact_and_excluded_statuses(spark):
    events = facts(spark, {}, {"game_id": "g2", "winner": None, "end_status": "aborted"}, {"game_id": "g3", "end_status": None})
    assert games_from_events(events, unique=True).count() == 3
    kept = games_from_events(events, statuses_excluded=["aborted", "noStart"])
    assert sorted(r.game_id for r in kept.collect()) == ["g1", "g3"]


def test_self_play_counts_once_as_white(spark):
    games = games_from_events(facts(spark, {"black_id": "w"}))
    assert [(r.player_id, r.color, r.result) for r in perspective(games).collect()] == [("w", "white", "win")]


def test_unknown_player_is_left_out(spark):
    games = games_from_events(facts(spark, {"black_id": None}))
    assert [r.player_id for r in perspective(games).collect()] == ["w"]


@pytest.mark.parametrize(
    "mine, theirs, expected",
    [(1500, 1400, "equal_rated"), (1500, 1399, "lower_rated"), (1500, 1600, "equal_rated"),
     (1500, 1601, "higher_rated"), (None, 1600, "equal_rated")],
)
def test_opponent_class_boundaries(spark, mine, theirs, expected):
    games = games_from_events(facts(spark, {"white_rating": mine, "black_rating": theirs}))
    assert one(stats.vs_rating(games, "w")).opponent_class == expected


@pytest.mark.parametrize("clock, expected", [(999, "under_10s"), (1000, "normal")])
def test_time_pressure_boundary(spark, clock, expected):
    assert one(stats.time_pressure(facts(spark, {"clock_remaining": clock}), "w")).pressure == expected


def test_time_pressure_semantics(spark):
    events = facts(spark, {}, {"move_number": 2, "clock_remaining": 500}, {"move_number": 3, "clock_remaining": 900})
    reference = stats.time_pressure(events)
    assert {(r.player_id, r.pressure) for r in reference.collect()} == {("w", "normal"), ("b", "normal")}
    own = stats.time_pressure(events, semantics=stats.CORRECTED)
    assert {(r.player_id, r.avg_clock_s) for r in own.collect()} == {("w", 9.0), ("b", 5.0)}
    with pytest.raises(ValueError):
        stats.time_pressure(events, semantics="other")


def test_clock_by_phase_semantics(spark):
    events = facts(spark, {"clock_remaining": 1000}, {"move_number": 2, "clock_remaining": 3000},
                   {"move_number": 11, "clock_remaining": None}, {"move_number": 31, "clock_remaining": 700})
    both = one(stats.clock_by_phase(events, "w"), phase="opening")
    own = one(stats.clock_by_phase(events, "w", stats.CORRECTED), phase="opening")
    assert (both.avg_clock_s, both.move_count, own.avg_clock_s, own.move_count) == (20.0, 2, 10.0, 1)
    assert {r.phase for r in stats.clock_by_phase(events, "w").collect()} == {"opening", "endgame"}


@pytest.mark.parametrize(
    "ply, serving, live",
    [(10, "opening", "opening"), (11, "middlegame", "opening"), (20, "middlegame", "opening"),
     (21, "middlegame", "middlegame"), (30, "middlegame", "middlegame"), (31, "endgame", "middlegame"),
     (60, "endgame", "middlegame"), (61, "endgame", "endgame")],
)
def test_phase_scales(spark, ply, serving, live):
    row = spark.range(1).select(c.phase(F.lit(ply)).alias("s"), c.phase(F.lit(ply), c.LIVE_PHASES).alias("l")).first()
    assert (row.s, row.l) == (serving, live)


def test_opening_stats_minimum_and_limit(spark):
    games = games_from_events(facts(
        spark, {}, {"game_id": "g2"}, {"game_id": "g3", "opening_eco": "B20"},
        {"game_id": "g4", "opening_eco": "D00"}, {"game_id": "g5", "opening_eco": "D00"},
        {"game_id": "g6", "opening_eco": None},
    ))
    got = stats.opening_stats(games, "w").orderBy("rank").collect()
    assert [(r.opening_eco, r.games) for r in got] == [("C50", 2), ("D00", 2)]
    assert [r.opening_eco for r in stats.opening_stats(games, "w", top_n=1, min_games=1).collect()] == ["C50"]


def test_recent_games_ties_by_game_id(spark):
    games = games_from_events(facts(spark, *[{"game_id": f"g{i}"} for i in (3, 1, 2)]))
    got = stats.recent_games(games, "w", limit=2).orderBy("rank").collect()
    assert [r.game_id for r in got] == ["g1", "g2"]


def test_totals_round_half_even_in_reference_form(spark):
    games = games_from_events(facts(spark, {"white_rating": 1500}, {"game_id": "g2", "speed": "rapid", "white_rating": 1501}))
    assert one(stats.player_totals(games, "w")).avg_rating == 1500.0


def test_merge_top_lists_keeps_first_sight(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2), (None, 3)], "id string, rank int")
    got = stats.merge_top_lists(a, b).orderBy("list_no", "rank").collect()
    assert [(r.id, r.list_no) for r in got] == [("x", 0), ("y", 0), ("z", 1)]


@pytest.mark.parametrize(
    "cp, text",
    [(None, "unknown"), (301, "+3.0 — White is winning"), (300, "+3.0 — Balanced"), (-300, "-3.0 — Balanced"),
     (-301, "-3.0 — Black is winning"), (0, "+0.0 — Balanced"), (-205, "-2.0 — Balanced"), (25, "+0.2 — Balanced")],
)
def test_eval_label(spark, cp, text):
    assert spark.range(1).select(c.eval_label(F.lit(cp).cast("int"))).first()[0] == text


@pytest.mark.parametrize("raw, expected", [(1000, 1000), (1001, 1), (60999, 60), (0, 0), (None, None)])
def test_clock_unit_guess(spark, raw, expected):
    assert spark.range(1).select(c.clock_in_seconds(F.lit(raw).cast("int"))).first()[0] == expected


def test_small_columns(spark):
    row = spark.range(1).select(
        c.position_key(F.lit("p w KQkq - 0 1")).alias("k"), c.fullmove_number(F.lit(3)).alias("m"),
        c.opening_label(F.lit("B90"), F.lit("Sicilian Defense: Najdorf Variation")).alias("o"),
        c.clock_bucket(F.lit(1999)).alias("b"), c.clock_bucket(F.lit(3000)).alias("top"),
        c.event_timestamp(F.lit("no time")).alias("t"),
    ).first()
    assert tuple(row) == ("p w KQkq -", 2, "B90 — Sicilian Defense: Najdorf", "10-20", ">=30", None)
