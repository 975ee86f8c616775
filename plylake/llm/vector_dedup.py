"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, exact links.

1. Equal vectors of a label are one item with a weight (copies meet in a map-side aggregate).
2. Spherical k-means, fitted on a bounded sample, gives centroids; an item belongs to the cell of its label and nearest
   centroid.  It also visits each cell whose border it is near: if two items are within the chord d of each other and in
   different cells, one of them is within d/2 of the plane between the two centroids.  So no pair is lost at a border.
3. A large cell is thinned first.  Some of its items, at most ``LEADERS``, lead; items within half the linking angle of a
   leader form a ball, of which all pairs are linked without being looked at.  A ball counts as one item with a radius.
4. A cell's items meet in blocks of about ``CHUNK`` of its own with as many of its own or of its visitors.  Where the two
   radii leave it open whether members link, the members themselves are compared in blocks.
5. Each block gives only counts of links and a spanning forest; components are searched over the forests' edges.

Nothing here is approximate: cells, sample and leaders decide the cost alone.  A link is cosine >= 0.98 in double
precision of the vectors divided by their lengths.

Defined results: a null label, a null, empty or zero vector, and a vector with null or non-finite components link with
nothing; vectors of different length do not link; rows that share an id are vectors of their own under that id, and a
component's id is the smallest of its ids; a null id comes last; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plylake.llm.common import components, drop_kept, stored
from plylake.llm.near_dedup import NO_ID, Forest, _groups

CHUNK = 1024
LEADERS = 32
#: Bounds of the k-means: rows of the sample, centroids, rounds.
SAMPLE, MOST_CELLS, ROUNDS = 16_384, 2048, 8
#: Items a cell should hold, about.
CELL = 1000
SLACK = 1e-9


def unit_rows(flat: pa.Array) -> np.ndarray:
    """The vectors of a list column, divided by their lengths, in double precision."""
    values = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(flat), -1)
    return values / np.sqrt((values * values).sum(axis=1))[:, None]


def _vectors(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def items_of(embeddings: DataFrame) -> DataFrame:
    """(item, label, dim, vec, weight, least id) of the distinct vectors that can link; stored, so that numbers stay."""
    ok = (F.size("embedding") > 0) & F.col("label").isNotNull()
    ok &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok &= F.exists("embedding", lambda x: x != 0)
    # scaled by the largest component, so that no square overflows or vanishes; minus zero becomes zero
    doubles = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    usable = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), F.when(ok, doubles).alias("vec")).where("vec IS NOT NULL")
    same = usable.groupBy("label", "vec").agg(F.count("*").alias("weight"), F.min(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID))).alias("least"))
    scaled = F.transform("vec", lambda x: x / F.array_max(F.transform("vec", lambda y: F.abs(y))))
    return stored(same.select(
        F.monotonically_increasing_id().alias("item"), "label", F.size("vec").alias("dim"), "vec", scaled.alias("scaled"), "weight", "least",
    ), "vector-items")


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """``k`` unit centroids of unit ``rows`` at most; equal centroids are one."""
    dice = np.random.default_rng(seed)
    centroids = rows[np.sort(dice.choice(len(rows), min(k, len(rows)), replace=False))]
    for _ in range(rounds):
        cell = np.concatenate([np.argmax(rows[a:a + 4096] @ centroids.T, axis=1) for a in range(0, len(rows), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, rows)
        length = np.sqrt((sums * sums).sum(axis=1))
        used = length > 1e-6
        centroids = sums[used] / length[used][:, None]
    return np.unique(centroids, axis=0)


def fit_cells(items: DataFrame) -> dict[int, np.ndarray]:
    """Centroids by vector length, for the 8 most common lengths; the sample has ``SAMPLE`` rows at most."""
    sizes = items.groupBy("dim", "label").count().groupBy("dim").agg(F.sum("count").alias("rows"), F.max("count").alias("most"))
    out = {}
    for dim, rows, most in sizes.orderBy(F.desc("rows"), "dim").limit(8).collect():
        k = min(MOST_CELLS, -(-most // CELL))
        if k > 1:
            share = min(1.0, 1.2 * SAMPLE / rows)
            drawn = items.where(F.col("dim") == dim).where(F.pmod(F.xxhash64("item", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
            sample = drawn.select("scaled").limit(SAMPLE).toArrow().column("scaled").combine_chunks()
            out[dim] = spherical_kmeans(unit_rows(sample), k)
    return out


def assigned(items: DataFrame, cells: dict[int, np.ndarray]) -> DataFrame:
    """(item, label, dim, cell, unit, weight) of all items; stored."""
    shared = items.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                unit = unit_rows(some.column("scaled"))
                nearest = np.zeros(len(unit), np.int32)
                if dim in shared.value:
                    nearest = np.argmax(unit @ shared.value[dim].T, axis=1).astype(np.int32)
                columns = [some.column("item"), some.column("label"), some.column("dim"), pa.array(nearest), _vectors(unit), some.column("weight")]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "label", "dim", "cell", "unit", "weight"])

    rows = items.select("item", "label", "dim", "scaled", "weight")
    return stored(rows.mapInArrow(run, "item long, label string, dim int, cell int, unit array<double>, weight long"), "vector-cells")


def balls(rows: DataFrame, chord: float) -> DataFrame:
    """(unit of comparison, item, ...): ``ball`` is the leading item of the item's ball, its own if it is in none; stored.

    Only cells with more than 4 x ``CHUNK`` items have leaders, each an item of the cell drawn by a hash.
    """
    key = ["label", "dim", "cell"]
    large = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 4 * CHUNK)
    dice = F.struct(F.xxhash64("item", F.lit(9)).alias("d"), "item")
    drawn = rows.join(large, key).where(F.pmod(F.xxhash64("item", F.lit(8)), F.col("n")) < 2 * LEADERS)  # about 2 * LEADERS a cell
    lead = drawn.groupBy(*key).agg(F.slice(F.sort_array(F.collect_list(F.struct(dice.alias("d"), "item", "unit"))), 1, LEADERS).alias("led"))
    near = 0.4999 * chord

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            ids, led = batch.column("item").to_pylist(), batch.column("led").to_pylist()
            mine, radius = list(ids), [0.0] * len(ids)
            for i, leaders in enumerate(led):
                if not leaders:
                    continue
                unit = np.array(batch.column("unit")[i].as_py())
                names, heads = [], np.empty((0, len(unit)))
                for one in leaders:  # a leader within another's ball does not lead
                    at = np.array(one["unit"])
                    if not len(heads) or ((heads - at) ** 2).sum(axis=1).min() > near * near:
                        names.append(one["item"])
                        heads = np.vstack([heads, at])
                away = np.sqrt(((heads - unit) ** 2).sum(axis=1))
                j = int(away.argmin())
                if away[j] <= near:
                    mine[i], radius[i] = names[j], float(away[j])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("item", "label", "dim", "cell", "unit", "weight")), pa.array(mine, pa.int64()), pa.array(radius, pa.float64())],
                names=["item", "label", "dim", "cell", "unit", "weight", "ball", "away"],
            )

    joined = rows.join(lead.select(*key, F.transform("led", lambda x: F.struct(x["item"].alias("item"), x["unit"].alias("unit"))).alias("led")), key, "left")
    return stored(
        joined.select("item", *key, "unit", "weight", "led").mapInArrow(
            run, "item long, label string, dim int, cell int, unit array<double>, weight long, ball long, away double"
        ), "vector-balls",
    )


def visits(units: DataFrame, cells: dict[int, np.ndarray], chord: float) -> DataFrame:
    """(ball, label, dim, home, at, unit, radius, weight, goes): a row for the home cell and for each cell visited; stored.

    ``goes`` lists the cells visited.  A ball of radius r goes where its centre is within chord / 2 + r of the border.
    """
    shared = units.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            unit_of, homes, radii, dims = batch.column("unit"), batch.column("cell").to_numpy(), batch.column("radius").to_numpy(), batch.column("dim").to_numpy()
            goes: list[list[int]] = []
            for i in range(len(batch)):
                found = shared.value.get(int(dims[i]))
                if found is None:
                    goes.append([])
                    continue
                home = found[homes[i]]
                unit = np.array(unit_of[i].as_py())
                gap = unit @ home - found @ unit
                width = np.sqrt(((found - home) ** 2).sum(axis=1))
                near = gap <= (chord / 2 + radii[i] + SLACK) * width
                near[homes[i]] = False
                goes.append(np.flatnonzero(near).tolist())
            columns = [*(batch.column(c) for c in batch.schema.names), pa.array(goes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "goes"])

    found = units.mapInArrow(run, "ball long, label string, dim int, cell int, unit array<double>, radius double, weight long, goes array<int>")
    return stored(found.withColumn("at", F.explode(F.concat(F.array("cell"), "goes"))), "vector-visits")


def dealt(rows: DataFrame, key: list[str], own: Column) -> DataFrame:
    """Deals rows to blocks: chunks of the key's own rows meet each other and each chunk of the rest, once.

    Adds ``block`` and ``side`` (0 first chunk, 1 second, 2 both: the chunk with itself).
    """
    sizes = rows.groupBy(*key).agg(
        F.ceil(F.count(F.when(own, 1)) / CHUNK).cast("int").alias("n0"), F.ceil(F.count(F.when(~own, 1)) / CHUNK).cast("int").alias("n1")
    ).where("n0 > 0")
    chunked = rows.join(sizes, key).withColumn("own", own)
    chunked = chunked.withColumn("c", F.pmod(F.xxhash64("ball"), F.when(F.col("own"), F.col("n0")).otherwise(F.col("n1"))).cast("int"))
    first, rest = F.sequence(F.lit(0), F.col("n0") - 1), F.col("n0") + F.col("c")
    pair = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    with_own = F.transform(first, lambda i: pair(F.least(i, F.col("c")), F.greatest(i, F.col("c")), F.when(i == F.col("c"), 2).when(i < F.col("c"), 1).otherwise(0)))
    with_rest = F.transform(F.sequence(F.lit(1), F.col("n1")), lambda j: pair(F.col("c"), F.col("n0") + j - 1, F.lit(0)))
    places = F.when(F.col("own"), F.when(F.col("n1") > 0, F.concat(with_own, with_rest)).otherwise(with_own)).otherwise(
        F.transform(first, lambda i: pair(i, rest, F.lit(1)))
    )
    return chunked.withColumn("p", F.explode(places)).withColumn("block", F.xxhash64(*key, "p.i", "p.j")).withColumn("side", F.col("p.side")).drop("p", "c", "n0", "n1", "own")


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    side = group.column("side").to_numpy()
    alone = bool((side == 2).all())
    return (np.flatnonzero(side != 1), np.flatnonzero(side != 0), alone)


def _found(links: list[tuple[int, int]], counts: dict[int, int], open_pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    """Rows of kind 0 (a link of the forest), 1 (links of a unit), 2 (an open pair)."""
    rows = [(0, a, b) for a, b in links] + [(1, a, n) for a, n in counts.items()] + [(2, a, b) for a, b in open_pairs]
    kind, a, b = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])


def compare_units(batches: Iterable[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """What the units of each block say: a pair counts in the cell that both rules name first."""
    drop_kept()
    chord = np.sqrt(2 - 2 * cosine)
    for group in _groups(batches, "block"):
        left, right, alone = _sides(group)
        if not len(left) or not len(right):
            continue
        ids, weight, radius = (group.column(c).to_numpy() for c in ("ball", "weight", "radius"))
        home, at = group.column("cell").to_numpy(), group.column("at").to_numpy()
        unit = np.array(group.column("unit").combine_chunks().flatten().to_numpy()).reshape(len(ids), -1)
        cos = unit[left] @ unit[right].T
        reach = radius[left][:, None] + radius[right][None, :]
        near = cos >= cosine if not reach.any() else cos >= 1 - ((chord + reach + SLACK) ** 2) / 2
        if alone:
            near &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        a, b = np.nonzero(near)
        if len(a):  # a visitor from cell h meets this cell's item; if that item visits h too, the lower of the two cells counts
            goes = group.column("goes").to_pylist()
            keep = [
                home[right[j]] == at[right[j]] or at[right[j]] < home[right[j]] or home[right[j]] not in goes[left[i]]
                for i, j in zip(a.tolist(), b.tolist())
            ]
            a, b = a[keep], b[keep]
        away = np.sqrt(np.maximum(0, 2 - 2 * cos[a, b]))
        both = reach[a, b]
        sure = np.where(both > 0, away + both <= chord - SLACK, cos[a, b] >= cosine)
        a, b = left[a], right[b]
        counts: dict[int, int] = {}
        for one, other in ((a, b), (b, a)):
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, one[sure], weight[other[sure]])
            for i in np.flatnonzero(total).tolist():
                counts[int(ids[i])] = counts.get(int(ids[i]), 0) + int(total[i])
        forest = Forest(list(range(len(ids))))
        links = [(int(ids[i]), int(ids[j])) for i, j in zip(a[sure].tolist(), b[sure].tolist()) if forest.join(i, j)]
        yield _found(links, counts, [(int(ids[i]), int(ids[j])) for i, j in zip(a[~sure].tolist(), b[~sure].tolist())])


def compare_members(batches: Iterable[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """The same for the single items of two units that were left open."""
    drop_kept()
    for group in _groups(batches, "block"):
        left, right, _ = _sides(group)
        if not len(left) or not len(right):
            continue
        ids, weight = group.column("item").to_numpy(), group.column("weight").to_numpy()
        unit = np.array(group.column("unit").combine_chunks().flatten().to_numpy()).reshape(len(ids), -1)
        near = unit[left] @ unit[right].T >= cosine
        counts = {int(ids[i]): int(n) for i, n in zip(left, near @ weight[right]) if n}
        counts |= {int(ids[i]): int(n) for i, n in zip(right, weight[left] @ near) if n}
        forest = Forest(list(range(len(ids))))
        links = [(int(ids[left[i]]), int(ids[right[j]])) for i, j in zip(*np.nonzero(near)) if forest.join(int(left[i]), int(right[j]))]
        yield _found(links, counts, [])


FOUND = "kind int, a long, b long"


def near_vectors(embeddings: DataFrame, cosine: float = 0.98) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept."""
    chord = float(np.sqrt(2 - 2 * cosine))
    items = items_of(embeddings)
    cells = fit_cells(items)
    members = balls(assigned(items, cells), chord)
    units = members.groupBy("ball", "label", "dim", "cell").agg(
        F.max(F.when(F.col("item") == F.col("ball"), F.col("unit"))).alias("unit"), F.max("away").alias("radius"), F.sum("weight").alias("weight")
    ).select("ball", "label", "dim", "cell", "unit", "radius", "weight")
    went = visits(units, cells, chord)
    blocks = dealt(went, ["label", "dim", "at"], F.col("cell") == F.col("at")).select("block", "side", "ball", "cell", "at", "unit", "radius", "weight", "goes")
    found = stored(
        blocks.repartition("block").sortWithinPartitions("block").mapInArrow(lambda rows: compare_units(rows, cosine), FOUND), "vector-found"
    )

    open_pairs = found.where("kind = 2").select("a", "b")
    parts = members.groupBy("ball").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n"))
    crossed = open_pairs.join(parts.select(F.col("ball").alias("a"), F.col("n").alias("na")), "a").join(parts.select(F.col("ball").alias("b"), F.col("n").alias("nb")), "b")
    crossed = crossed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    block = F.xxhash64("a", "b", "i", "j").alias("block")
    chunked = members.join(parts, "ball").withColumn("c", F.pmod(F.xxhash64("item"), F.col("n")).cast("int")).select("ball", "c", "item", "unit", "weight")
    sides = crossed.select(block, F.lit(0).alias("side"), F.col("a").alias("ball"), F.col("i").alias("c")).unionByName(
        crossed.select(block, F.lit(1).alias("side"), F.col("b").alias("ball"), F.col("j").alias("c"))
    ).join(chunked, ["ball", "c"])
    closer = stored(
        sides.select("block", "side", "item", "unit", "weight").repartition("block").sortWithinPartitions("block")
        .mapInArrow(lambda rows: compare_members(rows, cosine), FOUND), "vector-closer",
    )

    of_units = found.where("kind = 1").groupBy(F.col("a").alias("ball")).agg(F.sum("b").alias("out"))
    of_items = closer.where("kind = 1").groupBy(F.col("a").alias("item")).agg(F.sum("b").alias("more"))
    edges = found.where("kind = 0").select("a", "b").unionByName(closer.where("kind = 0").select("a", "b"))
    edges = edges.unionByName(members.where("item <> ball").select(F.col("item").alias("a"), F.col("ball").alias("b")))
    roots = components(edges, "vector-components").withColumnRenamed("id", "item")
    counted = members.select("item", "ball").join(units.select("ball", (F.col("weight") - 1).alias("within")), "ball").join(of_units, "ball", "left")
    counted = counted.join(of_items, "item", "left").join(roots, "item", "left").select(
        "item", (F.col("within") + F.coalesce("out", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "item").alias("root"),
    )
    whole = stored(items.select("item", "label", "vec", "least").join(counted, "item"), "vector-counted")
    least = whole.groupBy("root").agg(F.min("least").alias("component"))
    known = whole.join(least, "root").select(F.col("label").alias("of"), "vec", "n_links", "component")

    doubles = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("of"), doubles.alias("vec"))
    out = rows.join(known, ["of", "vec"], "left")
    name = F.nullif(F.coalesce("component", F.col("vec_id")), F.lit(NO_ID))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.col("vec_id").eqNullSafe(name).alias("kept"),
    )
