"""Ordered look-back over keys that may hold a large share of all rows.

A window partitioned by such a key would run in one task.  Here the key is cut into chunks that follow
the order (for games: their date), the window runs inside a chunk, and what a chunk needs from earlier
ones is carried over from a small per-chunk summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def with_previous(
    df: DataFrame, key: list[str], chunk: str, order: list[str], value: str, n: int, name: str = "previous"
) -> DataFrame:
    """Add ``name``: the ``value`` of the last ``n`` rows of the key before this one, oldest first.

    The order is ``(chunk, *order)``.  Every chunk that exists has at least one row, so the ``n``
    chunks before hold every row that can be reached.
    """
    part = [*key, chunk]
    inside = Window.partitionBy(*part).orderBy(*order)
    from_end = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order])
    tails = (
        df.select(*part, *order, F.struct(F.col(value).alias("v")).alias("_v"))
        .withColumn("_back", F.row_number().over(from_end))
        .where(F.col("_back") <= n)
        .groupBy(*part)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("at"), "_v"))).alias("_tail"))
        .select(*part, F.transform("_tail", lambda x: x["_v"]).alias("_tail"))
    )
    before = Window.partitionBy(*key).orderBy(chunk).rowsBetween(-n, -1)
    carries = tails.select(*part, F.flatten(F.collect_list("_tail").over(before)).alias("_carry"))
    here = df.withColumn(
        "_here", F.collect_list(F.struct(F.col(value).alias("v"))).over(inside.rowsBetween(-n, -1))
    )
    both = F.concat(F.coalesce("_carry", F.array().cast(_carry_type(df, value))), "_here")
    joined = here.join(carries, part, "left").withColumn("_both", both)
    last = F.slice("_both", F.greatest(F.size("_both") - n + 1, F.lit(1)), n)
    return joined.withColumn(name, F.transform(last, lambda x: x["v"])).drop("_here", "_carry", "_both")


def _carry_type(df: DataFrame, value: str) -> str:
    return f"array<struct<v:{df.schema[value].dataType.simpleString()}>>"


def with_running_count(
    df: DataFrame, key: list[str], chunk: str, order: list[str], name: str = "nth"
) -> DataFrame:
    """Add ``name``: the 1-based position of the row within its key in the order ``(chunk, *order)``."""
    part = [*key, chunk]
    earlier = Window.partitionBy(*key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carries = (
        df.groupBy(*part)
        .agg(F.count("*").alias("_n"))
        .select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*part).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(inside))
        .join(carries, part)
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_rn", "_before")
    )
