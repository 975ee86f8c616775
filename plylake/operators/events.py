"""Landing-side operators: decode, date and route raw messages. All work on batch and stream alike."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from plylake.functions.columns import blank_to_null, event_timestamp
from plylake.schemas import STATUS_EVENT, TOPICS


def id_column(topic: str) -> str:
    return "id" if topic == "moves" else "game_id"


def parsed_rows(raw: DataFrame, schema: StructType | str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Columns of the JSON text in ``value``; with ``keep``, only of the messages it is true for.

    Each text is parsed once: a filter on the parsed columns would be pushed below the projection and
    parse again for every column it names, so the test is made inside the generator.
    """
    message = F.array(F.from_json(F.col("value").cast("string"), schema))
    return raw.select(F.inline(F.filter(message, keep) if keep else message))


def event_moment(row: Callable[[str], Column], topic: str) -> Column:
    """Time of a message: ``createdAt`` (ms) for exports, the ISO ``timestamp`` otherwise."""
    return F.timestamp_millis(row("createdAt")) if topic == "moves" else event_timestamp(row("timestamp"))


def with_event_date(df: DataFrame, topic: str) -> DataFrame:
    return df.withColumn("date", F.to_date(event_moment(F.col, topic)))


def _usable(topic: str) -> Callable[[Column], Column]:
    def test(message: Column) -> Column:
        has_id = blank_to_null(message.getField(id_column(topic))).isNotNull()
        return F.coalesce(has_id & event_moment(message.getField, topic).isNotNull(), F.lit(False))

    return test


def decode(raw: DataFrame, topic: str) -> DataFrame:
    """Typed rows of the messages in ``value``, with ``ingested_at`` and ``date``."""
    rows = parsed_rows(raw, TOPICS[topic], _usable(topic))
    return with_event_date(rows.withColumn("ingested_at", F.current_timestamp()), topic)


def undecodable(raw: DataFrame, topic: str) -> DataFrame:
    """The messages ``decode`` leaves out (no JSON, no id, no usable time), for a quarantine table."""
    text = F.col("value").cast("string")
    usable = _usable(topic)
    both = F.array(F.struct(text.alias("value"), F.from_json(text, TOPICS[topic]).alias("d")))
    bad = F.transform(F.filter(both, lambda x: ~usable(x["d"])), lambda x: x["value"])
    return raw.select(F.explode(bad).alias("value"), F.current_timestamp().alias("ingested_at"))


def split_messages(raw: DataFrame, topic: str) -> DataFrame:
    """One row per message: ``good``, its typed fields, or ``bad``, the text that ``decode`` leaves out; parsed once."""
    text, usable = F.coalesce(F.col("value").cast("string"), F.lit("")), _usable(topic)
    both = F.array(F.struct(text.alias("value"), F.from_json(text, TOPICS[topic]).alias("d")))
    sides = F.transform(both, lambda x: F.struct(F.when(usable(x["d"]), x["d"]).alias("good"), F.when(~usable(x["d"]), x["value"]).alias("bad")))
    return raw.select(F.inline(sides))


def parse_status_events(raw: DataFrame) -> DataFrame:
    return parsed_rows(raw, STATUS_EVENT)


def _object_or_text(column: str, path: str) -> Column:
    """A field sent as an object by some producers and as plain text by others."""
    inner = F.when(F.col(column).startswith("{"), F.get_json_object(column, path))
    return F.coalesce(inner, F.when(~F.col(column).startswith("{"), F.col(column)))


def status_name() -> Column:
    return F.coalesce(blank_to_null(F.col("statusName")), _object_or_text("status", "$.name"))


def _first_of(*names: str) -> Column:
    return F.coalesce(*[blank_to_null(F.col(n)) for n in names])


def route_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split status events into game starts and game ends; others and rows without id are left out."""
    named = events.where(blank_to_null(F.col("id")).isNotNull()).withColumn("_status", status_name())

    def side(color: str) -> list[Column]:
        base = f"players.{color}"
        return [
            _first_of(f"{base}.userId", f"{base}.user.id", f"{base}.id").alias(f"{color}_id"),
            F.col(f"{base}.rating").alias(f"{color}_rating"),
            _first_of(f"{base}.title", f"{base}.user.title").alias(f"{color}_title"),
        ]

    starts = named.where(F.col("_status") == "started").select(
        F.col("id").alias("game_id"), "timestamp", "speed", "rated",
        _object_or_text("variant", "$.key").alias("variant"),
        *side("white"), *side("black"), "source", F.col("tournament.id").alias("tournament_id"),
    )
    ends = named.where(~F.col("_status").isin("created", "started")).select(
        F.col("id").alias("game_id"), "timestamp", "winner", F.col("_status").alias("status")
    )
    return starts, ends


def resolve_batch_date(arg: str | None, today: date) -> str:
    """The date of a daily build: the argument if it lies before ``today``, else yesterday."""
    if arg is None or arg >= today.isoformat():
        return (today - timedelta(days=1)).isoformat()
    return arg


def export_requests(ends: DataFrame, exports: DataFrame, n: int = 300, buckets: int = 64) -> DataFrame:
    """Ended games whose export is missing, in lists of at most ``n`` ids.

    Ids are numbered inside a hash bucket, so no window holds all of them; raise ``buckets`` with the
    backlog.
    """
    missing = ends.select("game_id").distinct().join(
        exports.select(F.col("id").alias("game_id")), "game_id", "left_anti"
    )
    bucket = F.pmod(F.hash("game_id"), F.lit(buckets))
    inside = Window.partitionBy("bucket").orderBy("game_id")
    return (
        missing.withColumn("bucket", bucket)
        .withColumn("chunk", F.floor((F.row_number().over(inside) - 1) / n).cast("int"))
        .groupBy("bucket", "chunk")
        .agg(F.sort_array(F.collect_list("game_id")).alias("ids"))
    )
