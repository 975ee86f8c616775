"""Explicit schemas of the landing topics, the move-event fact and the derived tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in cols])


OPENING = _struct(("eco", S), ("name", S), ("ply", I))
CLOCK = _struct(("initial", I), ("increment", I))

GAME_START = _struct(
    ("game_id", S), ("timestamp", S), ("speed", S), ("rated", B), ("variant", S),
    ("white_id", S), ("white_rating", I), ("white_title", S),
    ("black_id", S), ("black_rating", I), ("black_title", S),
    ("source", S), ("tournament_id", S),
)

GAME_END = _struct(("game_id", S), ("timestamp", S), ("winner", S), ("status", S))

# Nested parts are typed here, so they are parsed once; a bad one becomes NULL and the row stays.
GAME_EXPORT = _struct(
    ("id", S), ("rated", B), ("variant", S), ("speed", S), ("perf", S),
    ("createdAt", L), ("lastMoveAt", L), ("status", S), ("source", S), ("winner", S),
    ("moves", S), ("clocks", T.ArrayType(I)), ("pgn", S), ("clock", CLOCK), ("players", S),
    ("opening", OPENING),
)

TOPICS = {"game_start": GAME_START, "moves": GAME_EXPORT, "game_end": GAME_END}

_LANDED = (T.StructField("ingested_at", T.TimestampType(), True), T.StructField("date", T.DateType(), True))
LANDED = {topic: T.StructType(schema.fields + list(_LANDED)) for topic, schema in TOPICS.items()}

MOVE_EVENTS = T.StructType(
    [T.StructField("game_id", S, False)]
    + list(
        _struct(
            ("move_number", I), ("move", S), ("fen", S), ("whose_moved", S), ("clock_remaining", I),
            ("opening_eco", S), ("opening_name", S), ("clock_initial", I), ("clock_increment", I),
            ("speed", S), ("perf", S), ("variant", S),
            ("white_id", S), ("white_rating", I), ("white_title", S),
            ("black_id", S), ("black_rating", I), ("black_title", S),
            ("tournament_id", S), ("winner", S), ("end_status", S), ("date", S),
        ).fields
    )
)

#: Columns of a ply; the others are those of its game.
PLY_COLUMNS = ("move_number", "move", "fen", "whose_moved", "clock_remaining")
GAMES = T.StructType([f for f in MOVE_EVENTS.fields if f.name not in PLY_COLUMNS])

EVALS = _struct(("fen", S), ("cp", I), ("mate", I), ("best_move", S))

_USER = _struct(("id", S), ("title", S))
_SIDE = _struct(("userId", S), ("id", S), ("user", _USER), ("rating", I), ("title", S))
STATUS_EVENT = _struct(
    ("id", S), ("timestamp", S), ("statusName", S), ("status", S), ("speed", S), ("rated", B),
    ("variant", S), ("source", S), ("tournament", _struct(("id", S))), ("winner", S),
    ("players", _struct(("white", _SIDE), ("black", _SIDE))),
)

LIVE_STATE = _struct(
    ("game_id", S), ("event_id", L), ("ts", T.TimestampType()), ("moves", S), ("wc", I), ("bc", I)
)
