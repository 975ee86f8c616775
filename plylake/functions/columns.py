"""Column expressions shared by the operators; all of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The two phase scales in use, as (last opening ply, last middlegame ply).
LIVE_PHASES = (20, 60)
SERVING_PHASES = (10, 30)


def phase(ply: Column, bounds: tuple[int, int] = SERVING_PHASES) -> Column:
    return (
        F.when(ply <= bounds[0], "opening").when(ply <= bounds[1], "middlegame").otherwise("endgame")
    )


def position_key(fen: Column) -> Column:
    """First four fields of a FEN; the two move counters would tell equal positions apart."""
    return F.substring_index(fen, " ", 4)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, as DOUBLE, half up."""
    return F.round(part.cast("double") * 100.0 / whole.cast("double"), digits)


def seconds(centis: Column, digits: int = 1) -> Column:
    return F.round(centis.cast("double") / 100.0, digits)


def fullmove_number(ply: Column) -> Column:
    """Full-move counter of the position after ``ply`` half-moves."""
    return (F.floor(ply / 2) + 1).cast("int")


def clock_in_seconds(raw: Column, threshold: int = 1000) -> Column:
    """Unit guess for live clocks: above the threshold the value is taken for milliseconds."""
    return F.when(raw > threshold, F.floor(raw / 1000)).otherwise(raw).cast("int")


def clock_bucket(clock_cs: Column, edges_s: tuple[int, ...] = (10, 20, 30)) -> Column:
    """Label of the clock range, e.g. ``<10``, ``10-20``, ``>=30`` (seconds)."""
    out = F.when(clock_cs < edges_s[0] * 100, f"<{edges_s[0]}")
    for low, high in zip(edges_s, edges_s[1:]):
        out = out.when(clock_cs < high * 100, f"{low}-{high}")
    return out.when(clock_cs.isNotNull(), f">={edges_s[-1]}")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def event_timestamp(text: Column) -> Column:
    """ISO text to TIMESTAMP; bad text gives NULL under ANSI mode as well."""
    return text.try_cast("timestamp")


def win_probability(cp: Column, mate: Column, slope: float = 0.00368208) -> Column:
    """White's winning chance from a centipawn score (published logistic form); a mate is 0 or 1."""
    return (
        F.when(mate > 0, F.lit(1.0))
        .when(mate.isNotNull(), F.lit(0.0))
        .when(cp.isNotNull(), F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(slope) * cp)))
    )


def eval_label(cp: Column, edge: int = 300) -> Column:
    # The label texts. format_number rounds the exact binary value; format_string would round its decimal text half up
    pawns = F.call_function("format_number", cp / 100.0, F.lit("0.0"))
    signed = F.when(cp >= 0, F.concat(F.lit("+"), pawns)).otherwise(pawns)
    return (
        F.when(cp.isNull(), "unknown")
        .when(cp > edge, F.concat(signed, F.lit(" — White is winning")))
        .when(cp < -edge, F.concat(signed, F.lit(" — Black is winning")))
        .otherwise(F.concat(signed, F.lit(" — Balanced")))
    )


def opening_label(eco: Column, name: Column, width: int = 25) -> Column:
    return F.concat_ws(" — ", eco, F.substring(name, 1, width))


def severity(loss: Column, cuts: tuple[int, int, int] = (50, 100, 200)) -> Column:
    """Class of a centipawn loss; NULL where the loss is unknown."""
    return (
        F.when(loss >= cuts[2], "blunder")
        .when(loss >= cuts[1], "mistake")
        .when(loss >= cuts[0], "inaccuracy")
        .when(loss.isNotNull(), "good")
    )


def mover_id() -> Column:
    return F.when(F.col("whose_moved") == "white", F.col("white_id")).otherwise(F.col("black_id"))


def mover_sign() -> Column:
    return F.when(F.col("whose_moved") == "white", 1).otherwise(-1)
