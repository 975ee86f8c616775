"""Small hand-written fact rows."""

from plylake.schemas import MOVE_EVENTS

DEFAULTS = dict(
    game_id="g1", move_number=1, move="e2e4", fen="f", whose_moved=None, clock_remaining=5000, opening_eco="C50",
    opening_name="Italian Game", clock_initial=300, clock_increment=0, speed="blitz", perf="blitz", variant="standard",
    white_id="w", white_rating=1500, white_title=None, black_id="b", black_rating=1500, black_title=None,
    tournament_id=None, winner="white", end_status="mate", date="2026-01-01",
)


def facts(spark, *changes):
    out = []
    for change in changes:
        row = {**DEFAULTS, **change}
        if row["whose_moved"] is None:
            row["whose_moved"] = "white" if row["move_number"] % 2 else "black"
        out.append(tuple(row[name] for name in MOVE_EVENTS.fieldNames()))
    return spark.createDataFrame(out, MOVE_EVENTS)


def evals(spark, *rows):
    """(fen, cp, mate, best_move)"""
    from plylake.schemas import EVALS

    return spark.createDataFrame(list(rows), EVALS)
