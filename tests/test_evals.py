import pytest
from pyspark.sql import functions as F

from builders import evals, facts
from plylake.operators import evals as ev, stats


def game(spark, cps, **more):
    """A game whose position at ply i has the i-th score."""
    events = facts(spark, *[{"move_number": i + 1, "fen": f"p{i}", **more} for i in range(len(cps))])
    table = evals(spark, *[(f"p{i}", cp, None, "m") for i, cp in enumerate(cps)])
    return ev.attach_evals(events, table)


@pytest.mark.parametrize("drop, expected", [(49, "good"), (50, "inaccuracy"), (99, "inaccuracy"), (100, "mistake"),
                                            (199, "mistake"), (200, "blunder"), (-400, "good")])
def test_severity_boundaries(spark, drop, expected):
    got = ev.judge_moves(game(spark, [0, -drop, 0]), stats.CORRECTED).where("move_number = 1").first()
    assert (got.loss, got.classification) == (drop, expected)


def test_semantics_differ_by_colour_and_row(spark):
    scores = game(spark, [0, 300, 0])
    reference = ev.judge_moves(scores, stats.REFERENCE).orderBy("move_number").collect()
    corrected = ev.judge_moves(scores, stats.CORRECTED).orderBy("move_number").collect()
    assert [r.classification for r in reference] == [None, "good", "blunder"]
    assert [r.loss for r in corrected] == [-300, -300, None]


def test_missing_score_gives_no_class(spark):
    got = ev.judge_moves(game(spark, [0, None, -300]), stats.REFERENCE).orderBy("move_number").collect()
    assert [r.classification for r in got] == [None, None, None]


def test_curve_and_swings(spark):
    events = facts(spark, *[{"move_number": i + 1, "fen": f"p{i}"} for i in range(5)])
    table = evals(spark, ("p0", 40, None, "m"), ("p1", None, 3, "m"), ("p3", None, -2, "m"), ("p4", None, None, "m"))
    got = ev.eval_swings(ev.eval_curve(ev.attach_evals(events, table))).orderBy("move_number").collect()
    assert [(r.move_number, r.eval, r.color) for r in got] == [
        (1, 0.4, "blue"), (2, 30.0, "red"), (4, -30.0, "red"), (5, 0.0, "red")]


@pytest.mark.parametrize("hot_keys", [None, 0, 2, 1000])
def test_hot_position_gives_the_same_rows(spark, hot_keys):
    """One position holds most plies; the join strategy must not show in the result."""
    events = spark.range(3000).select(
        F.concat(F.lit("g"), F.col("id")).alias("game_id"), F.lit(1).alias("move_number"),
        F.when(F.col("id") % 3 > 0, "start w KQkq - 0 1").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("fen"),
    ).union(spark.createDataFrame([("n", 1, None)], "game_id string, move_number int, fen string"))
    table = evals(spark, ("start w KQkq -", 20, None, "e2e4"), ("p3", -5, None, "x"), ("p9999", 1, None, "y"))
    got = ev.attach_evals(events, table, hot_keys)
    assert got.count() == 3001
    assert got.where("cp = 20").count() == 2000
    assert [tuple(r) for r in got.where("cp = -5").select("game_id", "best_move").collect()] == [("g3", "x")]
    assert got.where("evaluated").count() == 2001


def test_size_check_picks_the_join(spark):
    events = spark.range(10).selectExpr("concat('g', id) as game_id", "1 as move_number", "concat('p', id) as fen")
    small = spark.range(10).selectExpr("concat('p', id) as fen", "1 as cp", "null as mate", "'m' as best_move")

    def sketched():
        return "approx_top_k" in ev.attach_evals(events, small)._jdf.queryExecution().optimizedPlan().toString()

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert not sketched()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert sketched()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_positions_to_eval_is_distinct_and_anti(spark):
    events = facts(spark, {"fen": "a w - - 0 1"}, {"move_number": 2, "fen": "a w - - 5 9"}, {"move_number": 3, "fen": "b w - -"})
    table = evals(spark, ("b w - -", 1, None, "m"))
    assert [r.position for r in ev.positions_to_eval(events, table).collect()] == ["a w - -"]


def test_turning_point_takes_earliest_on_ties(spark):
    got = ev.turning_point(ev.judge_moves(game(spark, [0, -200, -200, -400, -400]))).first()
    assert (got.move_number, got.ply_before, got.loss, got.decisive) == (1, 0, 200, True)


def test_winning_not_won(spark):
    got = ev.winning_not_won(game(spark, [0, 200, 201, 350, -500], winner=None)).orderBy("color").collect()
    assert [(r.color, r.first_ply, r.best_cp, r.result) for r in got] == [("black", 5, 500, "draw"), ("white", 3, 350, "draw")]


def test_win_probability(spark):
    events = facts(spark, {"fen": "p0"}, {"move_number": 2, "fen": "p1"})
    table = evals(spark, ("p0", 0, None, "m"), ("p1", None, -1, "m"))
    got = ev.win_probability(ev.attach_evals(events, table)).orderBy("move_number").collect()
    assert [(r.white_chance, r.chance_lost) for r in got] == [(0.5, 0.5), (0.0, None)]


def test_digest_text(spark):
    events = facts(spark, {"fen": "p0", "opening_name": None}, {"move_number": 2, "fen": "p1", "move": "e7e5"})
    table = evals(spark, ("p0", 25, None, "m"), ("p1", None, -4, "m"))
    text = ev.game_digest(ev.attach_evals(events.withColumn("opening_name", F.lit(None).cast("string")), table)).first().digest
    assert text.split("\n") == [
        "Game ID: g1", "Players: w (White, 1500) vs b (Black, 1500)", "Opening: None (C50), Speed: blitz",
        "Result: White wins", "", "Move-by-move evaluations (centipawns, positive = White advantage):",
        "  Move 1 (W) e2e4: eval=+0.25", "  Move 2 (B) e7e5: eval=Mate in 4"]
