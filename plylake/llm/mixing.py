"""Mixing sources to target weights by capped water-filling.

The mix has ``share`` times the words of all documents.  It is dealt to the sources by weight; a source is clamped at
``epochs`` times its own words and what it leaves is dealt again to the others by weight, until none is above its cap.
A source's whole epochs go to all its documents; the fraction goes to its documents in a seeded random order until the
words are reached, so each source meets its target to within one document.

Sizes are summed in Spark.  The driver sees three numbers for each round of clamping, whatever the number of sources;
random order is a range partitioning on (source, hash), so a large source is spread over tasks.

Defined results: a null text has size 0; a null source is a source of its own, after all others; a source without words
has target 0 and takes nothing; an empty table gives no rows; repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plylake.llm.common import WORD, running_totals, stored


def sized(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, dice) of every row, stored."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), key)).alias("dice"),
        ),
        "mix-sizes",
    )


def source_targets(rows: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """(source, source_size, target, clamped), stored; weights repeat over the sources by code point, null last."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running_totals(sums, [F.col("source").asc_nulls_last()], F.lit(1), "mix-sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = stored(
        placed.select(
            "source", "source_size", F.get(cycle, (F.col("before") % len(weights)).cast("int")).alias("w"),
            (F.col("source_size") * float(epochs)).alias("cap"),
        ),
        "mix-weights",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    want, level = total * share, 0.0
    while True:
        above = F.col("w") * F.lit(level) > F.col("cap")
        capped, free = sources.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))
        ).first()
        raised = (want - capped) / free if free else level
        if raised <= level:
            break
        level = raised
    target = F.col("w") * F.lit(level)
    return stored(
        sources.select(
            "source", "source_size", F.least(target, "cap").alias("target"), (target >= F.col("cap")).alias("clamped")
        ),
        "mix-targets",
    )


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken."""
    rows = sized(docs, seed, id_col, text_col, source_col)
    targets = source_targets(rows, weights, share, epochs)
    order = [F.col("source").asc_nulls_last(), F.col("dice"), F.col("doc_id")]
    placed = running_totals(rows, order, F.col("size"), "mix-order")
    firsts = running_totals(targets, [F.col("source").asc_nulls_last()], F.col("source_size"), "mix-firsts").withColumnRenamed(
        "before", "source_start"
    )
    joined = placed.join(firsts.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    whole = F.when(F.col("clamped"), F.lit(epochs)).otherwise(F.floor(F.col("target") / F.col("source_size")))
    part = F.col("target") - F.col("whole") * F.col("source_size")
    inside = F.col("before") - F.col("source_start")
    extra = ~F.col("clamped") & (2 * inside + F.col("size") <= 2 * part)
    copies = F.when(F.col("source_size") == 0, 0).otherwise(F.col("whole") + extra.cast("int"))
    return (
        joined.withColumn("whole", F.when(F.col("source_size") == 0, 0).otherwise(whole).cast("int"))
        .withColumn("copies", copies.cast("int"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def take(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated as often as the mix takes them.

    Rows that share an id are one document here: each of them is repeated as that id's first row.
    """
    plan = (
        mix(docs, weights, share, epochs, seed, id_col, text_col, source_col)
        .where("copies > 0")
        .groupBy(F.col("doc_id").alias("of")).agg(F.min("copies").alias("copies"))
    )
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    return (
        whole.join(plan, F.col("id").eqNullSafe(F.col("of")))
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select("row.*")
    )
