"""An index of position vectors by cells, and exact nearest neighbours for many query vectors.

Fitting: spherical k-means on a sample of ``sample`` vectors at most gives up to ``most_cells`` directions; every vector is
put in the cell of its nearest direction.  The index is two Parquet tables: the vectors with their cells, and the cells
with their direction, size and width (the largest angle from the direction to a member).

Search: each query looks into its ``probes`` nearest cells, which gives it a provisional k-th best similarity.  A cell can
hold a better vector only if the angle from the query to the cell's direction, less the cell's width, allows it; the
cells that may are looked into next.  So the result is that of comparing with every vector, and the index decides the cost
alone.  Queries and members of a cell meet in blocks of bounded size, so neither a large cell nor many queries on one
cell meet in one task.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Rows of either side in a block.
BLOCK = 2048
DIGITS = 6


def _units(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def unit_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, unit, kept columns) of the vectors that have a direction: not null, finite and not all zero."""
    doubles = F.transform(vector_col, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select(F.col(id_col).alias("id"), *keep, doubles.alias("v"), norm.alias("norm"))
    finite = (F.col("norm") > 0) & ~F.isnan("norm") & (F.col("norm") < float("inf"))
    return rows.where(finite).select("id", *keep, F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def fit_directions(units: DataFrame, most_cells: int = 256, sample: int = 16_384, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Directions of the cells, about one for each hundred sampled vectors; bounded by the two limits."""
    count = units.count()
    share = min(1.0, 1.2 * sample / max(1, count))
    drawn = units.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)).select("unit").limit(sample)
    table = drawn.toArrow().column("unit").combine_chunks()
    if not len(table):
        return np.zeros((0, 1))
    rows = _units(table)
    k = max(1, min(most_cells, len(rows) // 100))
    centers = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        nearest = (rows @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, rows)
        size = np.linalg.norm(sums, axis=1)
        centers = sums[size > 1e-9] / size[size > 1e-9][:, None]
    return centers


def build_index(vectors: DataFrame, path: str, keep: tuple[str, ...] = ("label",), **fit: int) -> None:
    """Writes the index of ``vectors`` to ``path``/vectors and ``path``/cells; every vector with a direction is in it."""
    units = unit_vectors(vectors, keep=keep)
    directions = vectors.sparkSession.sparkContext.broadcast(fit_directions(units, **fit))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cosine = _units(batch.column("unit")) @ directions.value.T
                cell = cosine.argmax(axis=1)
                near = np.clip(cosine[np.arange(len(cell)), cell], -1, 1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.arccos(near))], names=[*batch.schema.names, "cell", "angle"]
                )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema)
    units.mapInArrow(assign, f"{kinds}, cell int, angle double").write.mode("overwrite").parquet(os.path.join(path, "vectors"))
    stored = vectors.sparkSession.read.parquet(os.path.join(path, "vectors"))
    sizes = stored.groupBy("cell").agg(F.count("*").alias("size"), F.max("angle").alias("width"))
    rows = [(i, row.tolist()) for i, row in enumerate(directions.value)]
    named = vectors.sparkSession.createDataFrame(rows, "cell int, direction array<double>")
    named.join(F.broadcast(sizes), "cell").coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "cells"))


def _in_blocks(asked: DataFrame, members: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(query, id, label, similarity) of the ``k`` best of each block, for (query, own, unit, cell) asked."""
    loads = asked.groupBy("cell").agg(F.count("*").alias("asks")).join(F.broadcast(sizes), "cell")
    cuts = loads.select("cell", F.ceil(F.col("asks") / BLOCK).cast("int").alias("nq"), F.ceil(F.col("size") / BLOCK).cast("int").alias("nm"))
    left = asked.join(F.broadcast(cuts), "cell").select(
        "query", "own", "unit", "cell", F.pmod(F.xxhash64("query"), F.col("nq")).cast("int").alias("q"),
        F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("m"),
    )
    right = members.join(F.broadcast(cuts), "cell").select(
        "id", "label", F.col("unit").alias("other"), "cell", F.pmod(F.xxhash64("id"), F.col("nm")).cast("int").alias("m"),
        F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"),
    )

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(a) and len(b):
            scores = np.round(_units(a.column("unit").combine_chunks()) @ _units(b.column("other").combine_chunks()).T, DIGITS)
            ids, labels = b.column("id").to_numpy(), b.column("label").to_pylist()
            for query, own, score in zip(a.column("query").to_pylist(), a.column("own").to_pylist(), scores):
                score = np.where(ids == own, -9.0, score)
                cut = np.partition(score, -k)[-k] if len(score) > k else -8.0
                some = np.flatnonzero((score >= cut) & (score > -8))
                for j in some[np.lexsort((ids[some], -score[some]))][:k].tolist():
                    out.append((query, int(ids[j]), labels[j], float(score[j])))
        columns = list(zip(*out)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), b.schema.field("label").type, pa.float64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query", "id", "label", "similarity"])

    label = dict(members.dtypes)["label"]
    keys = ["cell", "q", "m"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"query long, id long, label {label}, similarity double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, probes: int = 4, exact: bool = True) -> DataFrame:
    """The ``k`` indexed vectors nearest to each query by cosine: query_id, rank, vec_id, label, similarity.

    ``queries``: vec_id, embedding.  A vector of the query's own id is left out.  Similarities are rounded to six digits and
    ties stand in order of id.  Without ``exact`` only the ``probes`` nearest cells are looked into.
    """
    members = spark.read.parquet(os.path.join(path, "vectors")).select("id", "label", "unit", "cell")
    cells = spark.read.parquet(os.path.join(path, "cells"))
    sizes = cells.select("cell", "size")
    shape = cells.orderBy("cell").toArrow()  # bounded by most_cells
    if not len(shape):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, label int, similarity double")
    known = spark.sparkContext.broadcast(
        (shape.column("cell").to_numpy(), _units(shape.column("direction").combine_chunks()), shape.column("width").to_numpy())
    )
    asking = unit_vectors(queries).select(F.col("id").alias("query"), F.col("id").alias("own"), "unit")

    def probe(first: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, directions, width = known.value
            for batch in batches:
                if not len(batch):
                    continue
                cosine = np.clip(_units(batch.column("unit")) @ directions.T, -1, 1)
                nearby = np.zeros(cosine.shape, bool)
                order = np.argsort(-cosine, axis=1, kind="stable")[:, :probes]
                np.put_along_axis(nearby, order, True, axis=1)
                if not first:  # what the nearest cells leave open
                    most = np.cos(np.maximum(0, np.arccos(cosine) - width))
                    reached = batch.column("reached").to_numpy(zero_copy_only=False)
                    nearby = ~nearby & (most >= reached[:, None] - 2 * 10.0 ** -DIGITS)
                row, cell = np.nonzero(nearby)
                taken = batch.select(["query", "own", "unit"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(numbers[cell])], names=["query", "own", "unit", "cell"])
        return run

    schema = "query long, own long, unit array<double>, cell int"
    found = _top(_in_blocks(asking.mapInArrow(probe(True), schema), members, sizes, k), k)
    if exact:
        reached = found.groupBy("query").agg(F.when(F.count("*") == k, F.min("similarity")).otherwise(-2.0).alias("reached"))
        left = asking.join(reached, "query", "left").withColumn("reached", F.coalesce("reached", F.lit(-2.0)))
        more = _in_blocks(left.mapInArrow(probe(False), schema), members, sizes, k)
        found = _top(found.drop("rank").unionByName(more), k)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "label", "similarity")
