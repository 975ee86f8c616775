"""Helpers of the training-data operators: stored intermediates, ordered running totals, components.

Every intermediate goes to the shared folder of ``plylake.session.scratch_path`` as Parquet, which both cuts the
lineage and survives lost executors.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plylake.session import scratch_path, ship_package

#: The white space of the operators' word definition: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go as soon as the query ends, not when the driver happens to collect garbage.

    For chains of stored tables, each read from its files: no later query reads an earlier one's shuffle.
    """
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


_kept: dict[Hashable, object] = {}


def kept_in_worker(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in this Python worker between tasks; what another key left there goes first."""
    if key not in _kept:
        drop_kept()
        _kept[key] = make()
    return _kept[key]


def drop_kept() -> None:
    """Frees what earlier tasks kept: workers are reused, and a stage need not run beside the tables of the one before."""
    if _kept:
        _kept.clear()
        gc.collect()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that are read, so that no other column can clash; a null text is the empty one."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def lots(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Slices of an array of texts with at most so many bytes, or one text."""
    upto, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, size + (int(upto[at - 1]) if at else 0), "right")))
        yield texts.slice(at, end - at)
        at = end


def dealt(pieces: pa.Array, bounds: np.ndarray, look_up: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """For each two neighbouring bounds, what ``look_up`` gives for the pieces between, joined; distinct pieces are looked up once."""
    if not len(pieces):
        return [b""] * (len(bounds) - 1)
    keys = pieces.dictionary_encode()
    found = pa.array(look_up(keys.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
    _, cuts, data = found.take(keys.indices).buffers()
    cuts = np.frombuffer(cuts, np.int64)[bounds].tolist()
    return [data[a:b].to_pybytes() for a, b in zip(cuts, cuts[1:])]


def running_totals(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over all earlier rows in the global order.

    Rows are range-partitioned and stored with their partition's number; the sums of the partitions (one row each,
    so as many as there are partitions) give each partition its start.  No task sees more than its own range.
    """
    ranged = stored(
        df.withColumn("__v", value.cast("long")).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()),
        name,
    )
    sums = ranged.groupBy("__part").agg(F.sum("__v").alias("__sum"))
    starts = sums.select(
        "__part",
        F.coalesce(
            F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__start"),
    )
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
        .join(F.broadcast(starts), "__part")
        .withColumn("before", F.col("__start") + F.col("__in"))
        .drop("__v", "__part", "__in", "__start")
    )


def _all_stars(links: DataFrame) -> bool:
    """Whether every id of ``links`` (a above b) has one link upwards at most, and none if others link to it."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR (up = 1 AND down = 1)").count() == 0


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root) for every id in ``edges`` (a, b): root is the smallest id that it can reach.

    Links point from the larger id to the smaller.  A round first lifts each link's end to the least id above it, then
    hangs all that an id links to on the least of them; neither adds a row.  It ends when only stars are left.  A hub
    is a skewed join side and never a collected group.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _all_stars(now):
        above = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        lifted = now.join(above, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        least = lifted.groupBy("a").agg(F.min("b").alias("m"))
        hung = lifted.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = stored(hung.distinct(), name)
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("id"), "root").distinct())
