"""Patterns over many games: hand-made cases and brute force."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from builders import evals, facts
from plylake.operators import evals as ev, openings, patterns, players
from plylake.operators.games import games_from_events


@pytest.fixture(scope="module")
def many_games(spark):
    """Few players, one of them in most games, dates and ratings with many ties."""
    rnd = random.Random(3)
    changes = []
    for i in range(300):
        changes.append({
            "game_id": f"g{i:03d}", "white_id": rnd.choice(["hero"] * 5 + ["p1", "p2"]), "black_id": f"q{rnd.randint(1, 40):02d}",
            "white_rating": rnd.choice([1500, 1510, 1599, 1600, None]), "black_rating": rnd.choice([1500, 1505, 1590, 1601]),
            "winner": rnd.choice(["white", "black", None]), "date": f"2026-0{rnd.randint(1, 3)}-{rnd.randint(1, 28):02d}",
            "speed": rnd.choice(["blitz", "rapid"]),
        })
    return facts(spark, *changes)


def sides(events):
    for r in events.collect():
        for color, me, mine in (("white", r.white_id, r.white_rating), ("black", r.black_id, r.black_rating)):
            yield r, color, me, mine


def test_similar_players_equals_all_pairs(spark, many_games):
    latest = {}
    for r, _, me, mine in sides(many_games):
        if mine is not None:
            key = (me, r.speed)
            latest[key] = max(latest.get(key, ("", "", 0)), (r.date, r.game_id, mine))
    ratings = {k: v[2] for k, v in latest.items()}
    for k in (1, 5):
        want = set()
        for (me, speed), mine in ratings.items():
            near = sorted((abs(o - mine), who) for (who, s), o in ratings.items()
                          if s == speed and who != me and o // 100 == mine // 100)
            want |= {(me, speed, i + 1, who) for i, (_, who) in enumerate(near[:k])}
        got = players.similar_players(games_from_events(many_games), k)
        assert {(r.player_id, r.speed, r["rank"], r.similar_id) for r in got.collect()} == want


def test_tilt_equals_brute_force(spark, many_games):
    plies = many_games.select("*", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("m")).withColumns({
        "move_number": F.col("m"), "whose_moved": F.when(F.col("m") % 2 == 1, "white").otherwise("black"),
        "clock_remaining": F.lit(9000) - F.pmod(F.hash("game_id", "m"), F.lit(500)) - F.col("m") * 300,
    }).drop("m").cache()
    clocks = {(r.game_id, r.move_number): r.clock_remaining for r in plies.collect()}
    played = sorted((me, r.date, r.game_id, color, r.winner) for r, color, me, _ in sides(many_games))
    want = {}
    for me, group in groupby(played, key=lambda x: x[0]):
        history, tilt_s, tilt_n, other_s, other_n, tilted = [], 0, 0, 0, 0, 0
        for _, _, game, color, winner in group:
            hot = len(history) >= 3 and all(h == "loss" for h in history[-3:])
            spent = [clocks[game, m - 2] - clocks[game, m] for m in range(3, 7) if (m % 2 == 1) == (color == "white")]
            tilted += hot
            tilt_s, tilt_n = (tilt_s + sum(spent), tilt_n + len(spent)) if hot else (tilt_s, tilt_n)
            other_s, other_n = (other_s, other_n) if hot else (other_s + sum(spent), other_n + len(spent))
            history.append("draw" if winner is None else "win" if winner == color else "loss")
        want[me] = (tilted, round(tilt_s / tilt_n, 6) if tilt_n else None, round(other_s / other_n, 6) if other_n else None)
    got = patterns.tilt(games_from_events(many_games), plies).collect()
    assert {r.player_id: (r.tilt_games, r.tilt_cs, r.other_cs) for r in got} == want
    assert any(v[0] for v in want.values())


def test_time_spent_uses_the_movers_clock(spark):
    events = facts(spark, *[{"move_number": i + 1, "clock_remaining": c, "clock_increment": 2}
                            for i, c in enumerate([3000, 2900, 2500, None, 2400])])
    got = patterns.time_spent_from_fact(events).orderBy("move_number").collect()
    assert [r.time_spent_cs for r in got] == [None, None, 700, None, 300]


def test_book_exit(spark):
    clocks = [6000, 6000, 5900, 5900, 5800, 5800, 5700, 5700, 5400, 5600]  # white uses 1 s three times, then 3 s
    events = facts(spark, *[{"move_number": i + 1, "clock_remaining": c} for i, c in enumerate(clocks)])
    got = [(r.whose_moved, r.exit_ply, r.player_id) for r in patterns.book_exit(events).collect()]
    assert got == [("white", 9, "w")]


def test_drills_and_summary(spark):
    events = facts(spark, *[{"move_number": i + 1, "fen": f"p{i}", "clock_remaining": c}
                            for i, c in enumerate([1499, 5000, 900, 5000, 1500, 5000])])
    table = evals(spark, *[(f"p{i}", cp, None, "best") for i, cp in enumerate([300, 100, 100, 0, 0, -500])])
    drills = patterns.drill_positions(ev.judge_moves(ev.attach_evals(events, table)))
    assert [(r.move_number, r.loss, r.clock_s) for r in drills.orderBy("rank").collect()] == [(1, 200, 15.0), (3, 100, 9.0)]
    attempts = spark.createDataFrame(
        [("s", "w", "g1", 1, "best", 15.0), ("s", "w", "g1", 3, "best", 9.5), ("s", "w", "g1", 3, None, 1.0), ("s", "w", "g1", 3, "bad", 1.0)],
        "session_id string, player_id string, game_id string, move_number int, answer string, seconds double")
    got = {r.given: (r.attempts, r.in_time, r.late, r.wrong, r.skipped, r.accuracy_pct)
           for r in patterns.drill_summary(attempts, drills).collect()}
    assert got == {"all": (4, 1, 1, 1, 1, 25.0), "10-15": (1, 1, 0, 0, 0, 100.0), "<10": (3, 0, 1, 1, 1, 0.0)}


def test_opening_lookup_takes_the_longest_line(spark):
    book = spark.createDataFrame([("e4 c5", 2, "B20", "Sicilian"), ("e4 c5 Nf3 d6", 4, "B50", "Sicilian, d6"), ("d4", 1, "A40", "d4")],
                                 "prefix string, ply int, eco string, name string")
    games = spark.createDataFrame([("a", "e4 c5 Nf3 d6 d4"), ("b", "e4 c5 Nc3"), ("c", "e4 e5"), ("d", ""), ("e", None), ("f", "d4")],
                                  "game_id string, moves string")
    got = {r.game_id: (r.opening_eco, r.opening_ply) for r in openings.opening_lookup(games, book).collect()}
    assert got == {"a": ("B50", 4), "b": ("B20", 2), "c": (None, None), "d": (None, None), "e": (None, None), "f": ("A40", 1)}


def test_next_moves_and_chunks(spark):
    moves = ["e2e4"] * 3 + ["d2d4"] * 2 + ["c2c4", "g1f3"]
    events = facts(spark, *[{"game_id": f"g{i}", "move": m} for i, m in enumerate(moves)])
    got = openings.next_moves(events).orderBy("rank").collect()
    assert [(r.move, r.n, r.share_pct) for r in got] == [("e2e4", 3, 42.9), ("d2d4", 2, 28.6), ("c2c4", 1, 14.3)]
    bands = openings.opening_by_band(games_from_events(events))
    plies = spark.createDataFrame([(f"g{i}", 0) for i in range(7)], "game_id string, opening_ply int")
    assert openings.stat_chunks(bands, openings.next_after_opening(events, plies)).first().chunk == (
        "Italian Game at blitz rating 1400-1600: played 7 times, White won 100.0%, drawn 0.0%, Black won 0.0%. "
        "Most frequent next moves: e2e4 (42.9%), d2d4 (28.6%), c2c4 (14.3%)")


def test_next_moves_are_those_after_each_games_own_opening(spark):
    """Openings of different lengths, two speeds, and a game that ends with its opening."""
    line = [{"game_id": f"g{g}", "move_number": n, "move": f"m{g}{n}", "speed": "blitz" if g < 2 else "rapid"} for g in range(4) for n in range(1, 5)]
    events = facts(spark, *line)
    plies = spark.createDataFrame([("g0", 1), ("g1", 3), ("g2", 2), ("g3", 4)], "game_id string, opening_ply int")
    got = {(r.speed, r.move, r.n, r.share_pct, r.rank) for r in openings.next_after_opening(events, plies).collect()}
    assert got == {("blitz", "m02", 1, 50.0, 1), ("blitz", "m14", 1, 50.0, 2), ("rapid", "m23", 1, 100.0, 1)}


def test_rating_trend_and_change(spark):
    events = facts(spark, *[{"game_id": f"g{i}", "date": f"2026-01-{1 + i * 7:02d}", "white_rating": 1500 + 7 * i} for i in range(5)])
    trend = {r.player_id: (r.slope, r.trend) for r in players.rating_trend(games_from_events(events)).collect()}
    assert trend == {"w": (1.0, "improving"), "b": (0.0, "flat")}
    change = {r.player_id: r.change for r in players.rating_change(games_from_events(events), days=14).collect()}
    assert change == {"w": 14, "b": 0}


def test_similar_positions(spark):
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [2.0, 2.0]), (3, 1, [-1.0, 0.0]), (4, 1, [0.0, 0.0])],
                                    "vec_id bigint, label int, embedding array<float>")
    got = players.similar_positions(vectors, [1.0, 0.0], k=4).collect()
    assert [(r.vec_id, r.similarity) for r in got] == [(1, 1.0), (2, 0.707107), (3, -1.0), (4, None)]


def test_claims(spark):
    facts_ = spark.createDataFrame([("win", "a", 50.0), ("win", "b", 40.0)], "metric string, key string, value double")
    claims = spark.createDataFrame([("win", "a", 50.4), ("win", "b", 41.0), ("win", "c", 1.0)], "metric string, key string, value double")
    got = players.claim_accuracy(claims, facts_).first()
    assert (got.claims, got.grounded, got.accurate, got.grounded_share) == (3, 2, 1, 0.666667)


def test_opening_lookup_has_no_longest_line(spark):
    line = [f"m{i}" for i in range(44)]
    games = spark.createDataFrame([("g", " ".join(line))], "game_id string, moves string")
    book = spark.createDataFrame(
        [(" ".join(line[:n]), n, f"A{n}", "x") for n in (10, 40)], "prefix string, ply int, eco string, name string"
    )
    assert openings.opening_lookup(games, book).first().opening_ply == 40
