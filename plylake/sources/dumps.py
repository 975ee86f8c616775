"""Bulk sources: finished-game exports with all game columns, PGN dumps, evaluation dumps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plylake.functions.columns import blank_to_null, position_key
from plylake.operators.events import parsed_rows
from plylake.operators.expand import latest, token_plies
from plylake.schemas import MOVE_EVENTS

_SIDE = "struct<user: struct<id: string, title: string>, rating: int, ratingDiff: int>"
PLAYERS = f"struct<white: {_SIDE}, black: {_SIDE}>"
EVAL_LINE = (
    "fen string, evals array<struct<pvs: array<struct<cp: int, mate: int, line: string>>, knodes: bigint, depth: int>>"
)

# Estimated game length in seconds (initial + 40 increments) below which a speed ends.
SPEED_LIMITS = (("ultraBullet", 30), ("bullet", 180), ("blitz", 480), ("rapid", 1500))
BACKFILL_ONLY = ["opening_ply", "white_rating_diff", "black_rating_diff"]


def backfill_games(exports: DataFrame) -> DataFrame:
    """Per-player history exports, which carry players and result themselves, as one row per game."""
    sides = exports.withColumn("_p", F.from_json("players", PLAYERS))

    def side(color: str) -> list[Column]:
        base = f"_p.{color}"
        return [
            F.col(f"{base}.user.id").alias(f"{color}_id"), F.col(f"{base}.rating").alias(f"{color}_rating"),
            F.col(f"{base}.user.title").alias(f"{color}_title"),
            F.col(f"{base}.ratingDiff").alias(f"{color}_rating_diff"),
        ]

    # a game is in the history of both of its players
    return latest(sides, "id").select(
        F.col("id").alias("game_id"), "moves", "clocks",
        F.col("opening.eco").alias("opening_eco"), F.col("opening.name").alias("opening_name"),
        F.col("opening.ply").alias("opening_ply"),
        F.col("clock.initial").alias("clock_initial"), F.col("clock.increment").alias("clock_increment"),
        "speed", "perf", "variant", *side("white"), *side("black"),
        F.lit(None).cast("string").alias("tournament_id"), "winner", F.col("status").alias("end_status"),
        F.col("date").cast("string").alias("date"),
    )


def history_events(games: DataFrame, expand: Callable[[DataFrame], DataFrame] = token_plies) -> DataFrame:
    """Move events of history games, in the fact's columns plus those only a backfill has."""
    extra = [c for c in BACKFILL_ONLY if c in games.columns]
    return expand(games).select(*MOVE_EVENTS.fieldNames(), *extra)


def backfill_union(events: DataFrame, games: DataFrame, expand: Callable[[DataFrame], DataFrame] = token_plies) -> DataFrame:
    """The fact plus the history games it does not hold yet; the check is made at game grain."""
    held = events.where(F.col("move_number") == 1).select("game_id")
    missing = games.join(held, "game_id", "left_anti")
    return events.unionByName(history_events(missing, expand), allowMissingColumns=True)


# The tags that are read.
TAGS = (
    "Site", "White", "Black", "Result", "UTCDate", "Date", "WhiteElo", "BlackElo", "WhiteRatingDiff", "BlackRatingDiff",
    "WhiteTitle", "BlackTitle", "ECO", "Opening", "TimeControl", "Termination", "Variant",
)


_TAG_LINE = r'(?m)^\[\w+ ".*"\][ \t]*$'


def _tag(name: str) -> Column:
    start = f'[{name} "'
    line = F.filter("tags", lambda t: t.startswith(start))
    text = F.transform(line, lambda t: F.replace(
        F.rtrim(t).substr(F.lit(len(start) + 1), F.length(F.rtrim(t)) - len(start) - 2), F.lit('\\"'), F.lit('"')))
    return F.get(F.filter(text, lambda t: ~t.isin("", "?", "-")), F.lit(0)).alias(f"t_{name}")


def _main_line(movetext: Column) -> Column:
    """Tokens of the main line: moves, each with ``@h:mm:ss`` behind it where it has a clock.

    Comments, NAGs, glyphs, move numbers and the result are left out, and variations however deep they are nested.
    """
    text = F.regexp_replace(movetext, r"\{[^}]*?\[%clk (\d+:\d{1,2}:\d{1,2}(?:\.\d+)?)\][^}]*\}", " @$1 ")
    text = F.regexp_replace(text, r"\{[^}]*\}|;[^\n]*|\$\d+|[!?]+", " ")
    text = F.regexp_replace(text, r"([()])", " $1 ")
    words = F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, r"^\d+\.+", ""))
    words = F.filter(words, lambda t: ~t.isin("", "1-0", "0-1", "1/2-1/2", "*"))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, t: Column) -> Column:
        depth = state["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        keep = (state["depth"] <= 0) & ~t.isin("(", ")")
        return F.struct(
            F.greatest(depth, F.lit(0)).alias("depth"),
            F.when(keep, F.array_append(state["kept"], t)).otherwise(state["kept"]).alias("kept"),
        )

    nested = F.contains(text, F.lit("("))
    return F.when(nested, F.aggregate(words, start, step, lambda state: state["kept"])).otherwise(
        F.filter(words, lambda t: t != ")")
    )


def _moves(line: Column) -> Column:
    return F.array_join(F.filter(line, lambda t: ~t.startswith("@")), " ")


def _clocks(line: Column) -> Column:
    """Clock of every move in hundredths, up to the last that has one; NULL for a move without one."""
    def centis(text: Column) -> Column:
        h, m, s = (F.split(F.substr(text, F.lit(2)), ":")[i].cast("double") for i in range(3))
        return F.round((h * 3600 + m * 60 + s) * 100).cast("int")

    pairs = F.filter(F.arrays_zip(line.alias("t"), F.slice(line, 2, F.size(line)).alias("n")), lambda p: ~p["t"].startswith("@"))
    found = F.transform(pairs, lambda p: F.when(p["n"].startswith("@"), centis(p["n"])))
    last = F.array_max(F.transform(found, lambda c, i: F.when(c.isNotNull(), i + 1)))
    return F.slice(found, 1, F.coalesce(last, F.lit(0)))


def _speed(initial: Column, increment: Column) -> Column:
    length = initial + 40 * increment
    out = F.when(length.isNull(), "correspondence")
    for name, limit in SPEED_LIMITS:
        out = out.when(length < limit, name)
    return out.otherwise("classical")


def parse_pgn(records: DataFrame) -> DataFrame:
    """PGN records in ``record`` as history games; only built-in text functions, no Python.

    A record without a site gets an id from its text; only text without any tag is no record.
    """
    record = F.replace("record", F.lit("\r\n"), F.lit("\n"))
    # one generator row per record, so that the split is made once and not for every tag
    parts = F.array(F.struct(
        F.regexp_extract_all(record, F.lit(_TAG_LINE), F.lit(0)).alias("tags"),
        F.regexp_replace(record, _TAG_LINE, " ").alias("movetext"), record.alias("record"),
    ))
    tagged = records.select(F.inline(parts)).where(F.size("tags") > 0).select(
        F.explode(F.array(F.struct(_main_line(F.col("movetext")).alias("line"), F.sha2("record", 256).alias("digest")))).alias("_m"),
        *[_tag(name) for name in TAGS],
    ).select("_m.line", "_m.digest", *[f"t_{name}" for name in TAGS])
    control = F.split("t_TimeControl", r"\+")
    timed = tagged.select(
        "*", *[F.get(control, F.lit(i)).try_cast("int").alias(c) for i, c in enumerate(("initial", "increment"))]
    ).withColumn("speed", _speed(F.col("initial"), F.col("increment")))

    def side(color: str) -> list[Column]:
        tag = f"t_{color}"
        return [
            F.lower(tag).alias(f"{color.lower()}_id"), F.col(f"{tag}Elo").try_cast("int").alias(f"{color.lower()}_rating"),
            F.col(f"{tag}Title").alias(f"{color.lower()}_title"),
            F.col(f"{tag}RatingDiff").try_cast("int").alias(f"{color.lower()}_rating_diff"),
        ]

    return timed.select(
        F.coalesce(
            blank_to_null(F.substring_index("t_Site", "/", -1)), F.concat(F.lit("pgn-"), F.substring("digest", 1, 16))
        ).alias("game_id"),
        _moves(F.col("line")).alias("moves"), _clocks(F.col("line")).alias("clocks"),
        F.col("t_ECO").alias("opening_eco"), F.col("t_Opening").alias("opening_name"),
        F.lit(None).cast("int").alias("opening_ply"),
        F.col("initial").alias("clock_initial"), F.col("increment").alias("clock_increment"),
        "speed", F.col("speed").alias("perf"),
        F.lower(F.coalesce("t_Variant", F.lit("standard"))).alias("variant"), *side("White"), *side("Black"),
        F.lit(None).cast("string").alias("tournament_id"),
        F.when(F.col("t_Result") == "1-0", "white").when(F.col("t_Result") == "0-1", "black").alias("winner"),
        F.lower("t_Termination").alias("end_status"),
        F.translate(F.coalesce("t_UTCDate", "t_Date"), ".", "-").alias("date"),
    )


def read_pgn(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """PGN files, one record per game.

    Plain files split by bytes.  A compressed file is one stream, so name ``partitions`` to spread its
    records before they are parsed.
    """
    separator = "\n[Event "
    rows = spark.read.option("lineSep", separator).text(path)
    if partitions:
        rows = rows.repartition(partitions)
    whole = F.when(F.ltrim("value").startswith("[Event "), F.col("value")).otherwise(F.concat(F.lit("[Event "), "value"))
    return parse_pgn(rows.where(F.trim("value") != "").select(whole.alias("record")))


def best_evals(lines: DataFrame) -> DataFrame:
    """Evaluation-dump lines (JSON in ``value``) as one row per position.

    The deepest evaluation wins, then the one with more nodes; of its lines the first counts.
    """
    parsed = parsed_rows(lines, EVAL_LINE, lambda e: e["fen"].isNotNull())
    ranked = F.array_max(F.transform("evals", lambda x: F.struct(x["depth"], x["knodes"], F.get(x["pvs"], F.lit(0)).alias("pv"))))
    return (
        parsed.select(position_key(F.col("fen")).alias("fen"), ranked.alias("best"))
        .groupBy("fen")
        .agg(F.max("best").alias("b"))
        .select("fen", F.col("b.pv.cp").alias("cp"), F.col("b.pv.mate").alias("mate"),
                F.substring_index("b.pv.line", " ", 1).alias("best_move"))
    )


def read_eval_dump(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    lines = spark.read.text(path)
    return best_evals(lines.repartition(partitions) if partitions else lines)
