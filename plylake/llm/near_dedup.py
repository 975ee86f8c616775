"""Near-duplicate detection by min-max hashing, with exact confirmation.

Of each of 64 permutations of the shingles both the minimum and the maximum is kept, so 64 hash evaluations give 128
signature values.  32 bands of four values each make buckets; a pair of Jaccard similarity 0.8 misses all of them with
probability 5e-8.  What follows confirms without ever listing a bucket's or a group's pairs:

1. Equal sets are one item from here on (copies meet in a map-side aggregate).
2. Each bucket's members are compared with its smallest member by signature.  Members that do not resemble it are
   compared with all other members of the bucket, in blocks of at most about a thousand rows.  A pair passes at an
   estimate of 0.62 (a pair of 0.8 fails that with probability 1e-6) and sizes in ratio.  Only what connects is emitted.
3. The connected items, a coarse cluster, get their full sets from the texts.  A cluster is cut into chunks, to each of
   which three of its items are added; a chunk's sets are intersected exactly through postings.  Items outside the cluster's largest component are then compared with all its chunks.
4. Components over the confirmed links.

Defined results: a null text is the empty text; a text without words has an empty set, links with nothing and is its own
component; a text with fewer words than a shingle has one shingle, the whole of it; rows that share an id are one
document; a null id stands last and its component is null only if all of it is; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plylake.llm.common import components, drop_kept, id_and_text, stored

U = np.uint64
NO_ID = (1 << 63) - 1
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U, count=len(words))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole if it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    factors = odd_numbers(k, 11)
    width = min(n, k)
    out = np.zeros(n - width + 1, U)
    for i in range(width):
        out += hashes[i:i + len(out)] * factors[i]
    return mix(out + U(width))


def shingle_set(text: str, k: int) -> np.ndarray:
    """The text's distinct shingle hashes, sorted; words are parted by ASCII white space, A-Z are lower-cased."""
    return np.unique(shingle_hashes(word_hashes(text.encode().translate(LOWER).split()), k))


class MinMax:
    """Signatures: per permutation the minimum and the maximum of the permuted hashes."""

    def __init__(self, permutations: int = 64, rows: int = 4) -> None:
        self.factors, self.rows = odd_numbers(permutations, 5)[:, None], rows

    def signatures(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of (min, max) values for each run of ``hashes`` that begins at ``starts``."""
        sig = np.empty((len(starts), 2 * len(self.factors)), U)
        for p, factor in enumerate(self.factors[:, 0]):
            seen = hashes * factor
            seen ^= seen >> U(32)
            sig[:, 2 * p], sig[:, 2 * p + 1] = np.minimum.reduceat(seen, starts), np.maximum.reduceat(seen, starts)
        return sig

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The same for one set, in blocks that stay in the cache."""
        low, high = np.full(len(self.factors), ~U(0)), np.zeros(len(self.factors), U)
        for at in range(0, len(hashes), 1024):
            seen = self.factors * hashes[at:at + 1024]
            seen ^= seen >> U(32)
            low, high = np.minimum(low, seen.min(axis=1)), np.maximum(high, seen.max(axis=1))
        return np.stack([low, high], axis=1).reshape(1, -1)

    def bands(self, sig: np.ndarray) -> np.ndarray:
        """Bucket keys: one for each ``rows`` signature values, different from band to band."""
        cut = sig.reshape(len(sig), -1, self.rows)
        keys = (cut * odd_numbers(self.rows, 3)).sum(axis=2, dtype=U)
        return mix(keys + odd_numbers(cut.shape[1], 4)).view(np.int64)

    @staticmethod
    def short(sig: np.ndarray) -> np.ndarray:
        """Eight bits of each value, to estimate similarity from."""
        return (mix(sig) >> U(56)).astype(np.uint8)


def item_sketches(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, ha, hb, bands, sig) of every row, stored; ha and hb are a 128-bit hash of the set."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        maker = MinMax()
        for batch in batches:
            out: list[tuple] = []
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = shingle_set(text.as_py(), k)
                if not len(found):
                    out.append((name, 0, 0, 0, None, None))
                    continue
                sig = maker.signature(found)
                ha, hb = np.array([mix(found).sum(dtype=U), mix(found ^ U(0x5851F42D4C957F2D)).sum(dtype=U)]).view(np.int64).tolist()
                out.append((name, len(found), ha, hb, maker.bands(sig)[0].tolist(), maker.short(sig).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "n", "ha", "hb", "bands", "sig"])

    rows = id_and_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    return stored(rows.mapInArrow(run, "id long, n long, ha long, hb long, bands array<long>, sig binary"), "near-sketches")


def _groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of equal ``key`` in sorted batches."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([held, now]).combine_chunks() if held is not None and len(held) else now
        keys = now.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield now.slice(a, b - a)
        held = now.slice(cuts[-1])
    if held is not None and len(held):
        yield held


class Forest:
    """Union by smallest label over the rows of a block; equal start labels are connected."""

    def __init__(self, labels: list) -> None:
        first: dict = {}
        self.parent = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def _resemble(sizes: np.ndarray, sigs: np.ndarray, n: int, sig: np.ndarray, least: int, ratio: float) -> np.ndarray:
    close = (sigs == sig).sum(axis=1) >= least
    return close & (np.minimum(sizes, n) >= ratio * np.maximum(sizes, n) - 1e-9)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _blocks(members: DataFrame, key: str) -> DataFrame:
    """Deals (key, id, rest: bool, ...) to blocks in which each ``rest`` row meets every other row of its key.

    Rest rows and others are cut into chunks of about CHUNK rows by a hash; a block is a chunk of rest rows with
    another chunk, so a row is repeated once for each chunk it has to meet.
    """
    sizes = members.groupBy(key).agg(
        F.ceil(F.sum(F.col("rest").cast("int")) / CHUNK).cast("int").alias("nr"),
        F.ceil(F.sum((~F.col("rest")).cast("int")) / CHUNK).cast("int").alias("no"),
    )
    dealt = members.join(sizes.where("nr > 0"), key)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("nr")).otherwise(F.col("no"))).cast("int")
    first = F.sequence(F.lit(0), F.col("nr") - 1)
    met = F.when(
        F.col("rest"),
        F.concat(
            F.transform(first, lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j"))),
            F.when(F.col("no") > 0, F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda j: F.struct(F.col("own").alias("i"), (F.col("nr") + j).alias("j"))))
            .otherwise(F.array().cast("array<struct<i:int,j:int>>")),
        ),
    ).otherwise(F.transform(first, lambda i: F.struct(i.alias("i"), (F.col("nr") + F.col("own")).alias("j"))))
    placed = dealt.withColumn("own", own).withColumn("met", F.explode(met))
    return placed.withColumn("block", F.xxhash64(key, "met.i", "met.j")).drop("own", "met", "nr", "no", key)


def coarse_clusters(items: DataFrame, least: int, ratio: float, name: str) -> DataFrame:
    """(id, root) of the items (id, n, bands, sig) that resemble others; nothing for the rest."""
    spread = items.select("id", F.explode("bands").alias("bucket"))
    hubs = spread.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    stars = stored(spread.join(hubs, "bucket").where("id <> hub"), f"{name}-stars")
    looks = items.select("id", "n", "sig")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            a, b = (np.array([np.frombuffer(s, np.uint8) for s in batch.column(c).to_pylist()]) for c in ("sig", "other"))
            alike = ((a == b).sum(axis=1) >= least) & (np.minimum(n, m) >= ratio * np.maximum(n, m) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("id"), pa.array(alike)], names=["hub", "id", "alike"])

    pairs = stars.select("hub", "id").distinct().join(looks, "id")
    pairs = pairs.join(looks.select(F.col("id").alias("hub"), F.col("n").alias("m"), F.col("sig").alias("other")), "hub")
    judged = stored(pairs.select("hub", "id", "n", "sig", "m", "other").mapInArrow(compare, "hub long, id long, alike boolean"), f"{name}-judged")

    members = stars.where("size > 2").join(judged, ["hub", "id"]).select("bucket", "id", (~F.col("alike")).alias("rest"))
    unlike = members.groupBy("bucket").agg(F.max("rest").alias("some")).where("some").select("bucket")
    crossed = _blocks(members.join(unlike, "bucket").join(looks, "id"), "bucket")

    def cross(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in _groups(batches, "block"):
            ids, rest = group.column("id").to_pylist(), group.column("rest").to_pylist()
            sizes, sigs = group.column("n").to_numpy(), np.array([np.frombuffer(s, np.uint8) for s in group.column("sig").to_pylist()])
            forest = Forest(ids)
            for i in (i for i, r in enumerate(rest) if r):
                for j in np.flatnonzero(_resemble(sizes, sigs, sizes[i], sigs[i], least, ratio)).tolist():
                    if forest.join(i, j):
                        found.append((ids[i], ids[j]))
            if len(found) > 10_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    more = crossed.repartition("block").sortWithinPartitions("block").mapInArrow(cross, "a long, b long")
    edges = judged.where("alike").select(F.col("hub").alias("a"), F.col("id").alias("b")).unionByName(more)
    return stored(components(edges, f"{name}-coarse"), f"{name}-clusters")


def links_in_block(ids: list[int], sets: list[np.ndarray], labels: list, rest: list[bool], threshold: float) -> list[tuple[int, int]]:
    """Links from each row of a block to the smallest id that it is connected with; one row stands for each label.

    Intersections are exact and go through postings.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, dense, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(dense, kind="stable")
    posted, begins = owner[order], np.concatenate(([0], np.cumsum(counts)))
    ends = np.cumsum(sizes)
    forest = Forest(labels)
    given = {forest.root(i) for i in range(len(ids))}
    for i in (i for i, r in enumerate(rest) if r):
        mine = dense[ends[i] - sizes[i]:ends[i]]
        mine = mine[counts[mine] > 1]
        if not len(mine):
            continue
        many = counts[mine]
        at = np.repeat(begins[mine] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        common = np.bincount(posted[at], minlength=len(sets))
        near = common >= threshold * (sizes + sizes[i] - common) - 1e-9
        near[i] = False
        for j in np.flatnonzero(near).tolist():
            forest.join(i, j)
    least: dict[int, int] = {}
    for i in given:
        root = forest.root(i)
        least[root] = min(ids[i], least.get(root, ids[i]))
    return [(ids[i], least[forest.root(i)]) for i in given if ids[i] != least[forest.root(i)]]


def _confirm(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    drop_kept()
    found: list[tuple[int, int]] = []
    for group in _groups(batches, "block"):
        ids, labels, rest = (group.column(c).to_pylist() for c in ("id", "label", "rest"))
        found += links_in_block(ids, [np.frombuffer(s, U) for s in group.column("set").to_pylist()], labels, rest, threshold)
        if len(found) > 10_000:
            yield _edges(found)
            found = []
    yield _edges(found)


def confirmed_components(members: DataFrame, threshold: float, name: str) -> DataFrame:
    """(id, root) over the exact links among the stored members (cluster, id, set) of coarse clusters."""
    def confirm(blocks: DataFrame) -> DataFrame:
        rows = blocks.select("block", "id", "label", "rest", "set").repartition("block").sortWithinPartitions("block")
        return rows.mapInArrow(lambda batches: _confirm(batches, threshold), "a long, b long")

    dice = F.struct(F.xxhash64("id").alias("d"), "id")
    shape = members.groupBy("cluster").agg(
        F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.array(F.min("id"), F.min(dice)["id"], F.max(dice)["id"]).alias("pivots")
    )
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    own = F.array(F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int"))
    placed = members.join(shape, "cluster").withColumn("chunk", F.explode(F.when(F.array_contains("pivots", F.col("id")), every).otherwise(own)))
    chunks = placed.select(
        F.xxhash64("cluster", "chunk").alias("block"), "id", F.col("id").alias("label"), F.lit(True).alias("rest"), "set"
    )
    near = stored(confirm(chunks), f"{name}-links")
    roots = stored(components(near, f"{name}-parts"), f"{name}-roots")

    large = members.join(shape.where("chunks > 1").select("cluster"), "cluster").join(roots, "id", "left")
    large = large.withColumn("label", F.coalesce("root", "id")).drop("root")
    main = large.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = large.join(main, "cluster").withColumn("rest", F.col("label") != F.col("main"))
    far = confirm(_blocks(rest.select("cluster", "id", "label", "rest", "set"), "cluster"))
    known = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))
    return stored(components(known.unionByName(far), f"{name}-all"), f"{name}-components")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    sketches = item_sketches(docs, words)
    same = ["n", "ha", "hb"]
    classes = stored(
        sketches.where("n > 0").groupBy(*same).agg(F.min(F.struct("id", "bands", "sig")).alias("first")).select(*same, "first.*"),
        "near-classes",
    )
    clusters = coarse_clusters(classes, int(2 * 64 * 0.62 * threshold / 0.8), threshold, "near")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), words).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("id"), pa.array(found, pa.binary())], names=["cluster", "id", "set"])

    texts = id_and_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text").where("text <> ''")
    members = texts.join(clusters, "id").select(F.col("root").alias("cluster"), "id", "text").mapInArrow(sets, "cluster long, id long, set binary")
    roots = confirmed_components(stored(members, "near-sets"), threshold, "near")
    known = sketches.select("id", *same).join(classes.select(*same, F.col("id").alias("rep")), same, "left")
    known = known.withColumn("rep", F.coalesce("rep", "id")).join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    name = F.nullif(F.coalesce("root", "rep"), F.lit(NO_ID))
    return known.select(
        F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), name.alias("component_id"),
        (F.col("id") == F.coalesce("root", "rep")).alias("kept"),
    )


def keep_one(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` of which no other row of their group stays, with all their columns."""
    stay = near_duplicates(docs, words, threshold).where("kept").select(F.col("doc_id").alias("of")).distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    return whole.join(stay, F.col("id").eqNullSafe(F.col("of")), "left_semi").select("row.*")
