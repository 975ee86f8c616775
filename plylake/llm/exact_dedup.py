"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries summary (the mergeable frequent-items aggregate ``approx_top_k``) names digests that may be frequent;
one exact count over those verifies them and finds the row that stays of each.  These winners, at most ``heavy`` rows,
are broadcast: rows that lose to one of them are settled in the map tasks.  All other rows, and the winners
themselves, go through an ordinary shuffle by digest, in which no group is large any more.

Defined results: a null text is the empty text; empty texts are equal to each other; a null id sorts after all others;
of rows that repeat the id and the text that stay, one stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plylake.llm.common import SPACE_CLASS, id_and_text, stored


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", ""), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, digest) of every row, stored: all later steps read this and no text."""
    rows = id_and_text(docs, id_col, text_col)
    return stored(
        rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), text_digest(F.col("text")).alias("digest")),
        "exact-digests",
    )


def heavy_winners(rows: DataFrame, heavy: int = 1000, tracked: int = 4096) -> DataFrame:
    """(digest, win_id, win_chars, win_size) of at most ``heavy`` frequent digests, exactly counted.

    A digest of more than a few rows in ``tracked`` of the input is always among them.
    """
    named = rows.agg(F.expr(f"approx_top_k(digest, {heavy}, {tracked})").alias("top")).selectExpr("inline(top)")
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id")))
    return (
        rows.join(F.broadcast(named.select(F.col("item").alias("digest"))), "digest", "left_semi")
        .groupBy("digest")
        .agg(best.alias("best"), F.count("*").alias("win_size"))
        .where("win_size > 1")
        .select("digest", F.col("best.doc_id").alias("win_id"), (-F.col("best.col1")).alias("win_chars"), "win_size")
    )


def split_by_winner(rows: DataFrame, winners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that lose to a broadcast winner, all other rows)."""
    joined = rows.join(F.broadcast(winners), "digest", "left")
    wins = F.col("doc_id").eqNullSafe(F.col("win_id")) & (F.col("n_chars") == F.col("win_chars"))
    return joined.where(F.col("win_size").isNotNull() & ~wins), joined.where(F.col("win_size").isNull() | wins)


def _in_group() -> object:
    return Window.partitionBy("digest").orderBy(F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs, id_col, text_col)
    winners = stored(heavy_winners(rows, heavy), "exact-winners")
    lost, rest = split_by_winner(rows, winners)
    settled = lost.select(
        "doc_id", F.col("win_id").alias("keep_id"), F.col("win_size").alias("group_size"), F.lit(False).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    shuffled = rest.select(
        "doc_id",
        F.first("doc_id").over(_in_group()).alias("keep_id"),
        F.coalesce("win_size", F.count("*").over(Window.partitionBy("digest"))).alias("group_size"),
        (F.row_number().over(_in_group()) == 1).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return settled.unionByName(shuffled)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1000) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    winners = stored(heavy_winners(digests(docs, id_col, text_col), heavy), "exact-winners")
    whole = docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
        text_digest(F.col(text_col)).alias("digest"),
    )
    _, rest = split_by_winner(whole, winners)
    return rest.withColumn("place", F.row_number().over(_in_group())).where("place = 1").select("row.*")
