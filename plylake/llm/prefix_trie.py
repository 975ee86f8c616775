"""The prefix trie of conversations, with subtree totals by time-forward processing.

A conversation is a sequence of turns (role, text); every distinct sequence of first turns is a node.

1. Each turn of a rebuilt conversation gets four 32-bit hashes of its place and content; their running sums name the
   prefix that ends there (128 bits and more).  Running sums are taken over key ranges, so that one very long conversation
   is spread over tasks like any other rows.
2. Nodes are one aggregate over these names, combined before the shuffle: a first turn that a third of all conversations
   share is one row for each map task.  A node is known from here on by its smallest member and its depth, as one member
   passes through one node of each depth.
3. Nodes are cut into shards, ranges of (smallest member, depth).  A parent's key is always below its children's.  Within
   a shard, Spark sorts the nodes in reverse level order and one sweep passes every node's total to its parent through a
   priority queue that spills; a total whose parent lies in another shard leaves the shard.
4. Across shards, the totals that left travel from shard root to shard root by joins until none is on its way, and a last
   sweep within the shards adds what arrived.  A path crosses each shard once at most, so there are at most as many rounds
   as shards, and in practice a few.

The queue keeps ``QUEUE`` messages in memory and writes more of them as sorted runs to unnamed temporary files of the task
(like Spark's own sorts); they vanish with the task, and no other task reads them.

Defined results: a null role or text is the empty one; a null turn stands first; turns of one conversation with the same
number stand in order of role, then of the MD5 of their text; repeated rows are turns of their own; rows without conv_id
name no conversation and are left out; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plylake.llm.common import WORD, drop_kept, stored

LANES = [f"k{i}" for i in range(4)]
NODE = ["depth", *LANES]
QUEUE = 200_000
IDS_A_PIECE = 10_000
#: Nodes a shard holds, about.
SHARD = 200_000


class SpillingQueue:
    """A priority queue of tuples; what is beyond ``most`` in memory is kept as sorted runs on disk."""

    def __init__(self, most: int = QUEUE) -> None:
        self.most, self.heap, self.runs, self.spilled = most, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        self.heap.sort()
        for at in range(0, len(self.heap), 1000):
            pickle.dump(self.heap[at:at + 1000], file)
        file.seek(0)
        run = self._read(file)
        heapq.heappush(self.runs, (next(run), self.spilled, run))
        self.heap, self.spilled = [], self.spilled + 1

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def first(self) -> tuple | None:
        """The smallest item, which stays."""
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, number, run = self.runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, run))
            return item
        return heapq.heappop(self.heap)


def running_within(df: DataFrame, key: str, order: Sequence[Column], values: Sequence[str], name: str) -> DataFrame:
    """Adds ``before_<value>``, the sum over the key's earlier rows, and ``place``, their number; stored.

    Rows are dealt by ranges of (key, order), so a key may reach over several partitions; only the sums of keys that do
    (two a partition at most) are carried over.
    """
    ranged = stored(df.repartitionByRange(F.col(key), *order).withColumn("__part", F.spark_partition_id()), f"{name}-ranges")
    parts = ranged.groupBy("__part", key).agg(F.count("*").alias("__n"), *[F.sum(v).alias(f"__{v}") for v in values])
    spanning = parts.groupBy(key).agg(F.count("*").alias("__in")).where("__in > 1").select(key)
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.join(F.broadcast(spanning), key).select(
        "__part", key, *[F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__c_{v}") for v in ("n", *values)]
    )
    inside = Window.partitionBy("__part", key).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    carry = lambda v: F.coalesce(F.col(f"__c_{v}"), F.lit(0))
    summed = ranged.withColumns({
        "place": F.row_number().over(inside) - 1, **{f"before_{v}": F.coalesce(F.sum(v).over(before), F.lit(0)) for v in values},
    }).join(F.broadcast(carried), ["__part", key], "left")
    return summed.withColumns({
        "place": F.col("place").cast("long") + carry("n"), **{f"before_{v}": F.col(f"before_{v}") + carry(v) for v in values},
    }).drop("__part", "__c_n", *[f"__c_{v}" for v in values])


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, words) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.md5(text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv, at, role, digest, words) of the rebuilt conversations, and every conversation's (conv, length).

    A conversation takes its first h = crc32(conv) % ``heads`` turns from the conversation that its block of ids begins
    with; what is handed on is at most ``heads`` - 1 turns for each conversation.
    """
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    placed = running_within(turns, "conv", order, [], "turns").select("conv", "place", "role", "digest", "words")
    convs = stored(placed.groupBy("conv").agg(F.count("*").alias("own")), "conversations")
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads))
    base = F.col("conv") - F.col("conv") % block
    taken = convs.select("conv", "own", h.alias("h"), base.alias("base"))
    first = placed.where(F.col("place") < heads - 1).where(F.col("conv") % block == 0)
    given = first.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "role", "digest", "words"))).alias("given"))
    taken = taken.join(given, "base", "left").withColumn("given", F.slice(F.coalesce("given", F.array().cast("array<struct<place:bigint,role:string,digest:string,words:bigint>>")), F.lit(1), F.col("h").cast("int")))
    headed = taken.select("conv", F.explode("given").alias("t")).select("conv", F.col("t.place").alias("at"), "t.role", "t.digest", "t.words")
    # the number of turns handed on: as many as h, or as the block's first conversation has
    shift = taken.select("conv", "h", F.size("given").cast("long").alias("got"))
    own = placed.where(F.col("place") >= F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads)))
    short = shift.where("got < h")  # rare: the block has no first conversation, or a short one
    own = own.withColumn("h", h).join(short.select("conv", "got"), "conv", "left")
    own = own.select("conv", (F.col("place") - F.col("h") + F.coalesce("got", "h")).alias("at"), "role", "digest", "words")
    lengths = taken.select("conv", (F.size("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("length"))
    return own.unionByName(headed), lengths


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, lanes, parent's lanes, words) of each first d > 0 turns of each conversation; stored."""
    one, two = (F.xxhash64("at", "role", "digest", F.lit(seed)) for seed in (1, 2))
    low = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    hashed = turns.withColumns({"__one": one, "__two": two}).select(
        "conv", "at", "words", low("__one").alias("t0"), F.shiftrightunsigned("__one", 32).alias("t1"),
        low("__two").alias("t2"), F.shiftrightunsigned("__two", 32).alias("t3"),
    )
    summed = running_within(hashed, "conv", [F.asc("at")], ["t0", "t1", "t2", "t3"], "prefixes")
    return stored(summed.select(
        "conv", (F.col("place") + 1).alias("depth"), "words", *[(F.col(f"before_t{i}") + F.col(f"t{i}")).alias(f"k{i}") for i in range(4)],
        *[F.col(f"before_t{i}").alias(f"p{i}") for i in range(4)],
    ), "prefixes")


def _ends_digest(pieces: DataFrame) -> DataFrame:
    """(depth, lanes, ends_sha256) from pieces of joined ids, taken in order; a piece at a time is in memory."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        now, state = None, None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in (*NODE, "ids")]
            for *node, ids in zip(*columns):
                if node != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _table(done, (*NODE, "ends_sha256"))
        if now is not None:
            yield _table([(*now, state.hexdigest())], (*NODE, "ends_sha256"))

    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "part", "piece")
    return dealt.select(*NODE, "ids").mapInArrow(run, ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string")


def _table(rows: list[tuple], names: Sequence[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def ends_of(ends: DataFrame) -> DataFrame:
    """(depth, lanes, ends_sha256) from rows (depth, lanes, conv): one for each conversation, at its last node.

    Ids are sorted by ranges and joined to pieces of ten thousand, so the task that hashes a node at which a third of all
    conversations end reads few rows, one after another.
    """
    ranged = stored(ends.repartitionByRange(*NODE, "conv").withColumn("part", F.spark_partition_id()), "ends")
    number = F.row_number().over(Window.partitionBy("part", *NODE).orderBy("conv")) - 1
    cut = ranged.withColumn("piece", F.floor(number / IDS_A_PIECE))
    pieces = cut.groupBy("part", "piece", *NODE).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    )
    return _ends_digest(pieces)


def trie_nodes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, words, ends_sha256) of every node; stored."""
    rows = prefixes(turns)
    top = rows.groupBy("conv").agg(F.max(F.struct(*NODE)).alias("last"))
    ends = ends_of(
        top.select("last.*", "conv").unionByName(
            lengths.where("length = 0").select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(k) for k in LANES], "conv")
        )
    )
    nodes = rows.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        *[F.max(f"p{i}").alias(f"p{i}") for i in range(4)],
    )
    root = lengths.groupBy().agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(
        zero.alias("depth"), *[zero.alias(k) for k in LANES], "conv_id", "n_convs", zero.alias("words"),
        *[F.lit(None).cast("long").alias(f"p{i}") for i in range(4)],
    )
    nodes = stored(nodes.unionByName(root), "trie-named")
    up = [(F.col("depth") - 1).alias("depth"), *[F.col(f"p{i}").alias(f"k{i}") for i in range(4)]]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    # children of one parent may be many: an equal-key join, of which adaptive execution splits the skewed side
    above = nodes.select("conv_id", (F.col("depth") + 1).alias("depth"), *[F.col(f"k{i}").alias(f"p{i}") for i in range(4)])
    named = nodes.join(above.withColumnRenamed("conv_id", "parent_conv_id"), ["depth", *[f"p{i}" for i in range(4)]], "left")
    named = named.join(children, NODE, "left").join(ends, NODE, "left")
    return stored(named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "words",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    ), "trie-nodes")


def sharded(nodes: DataFrame, shard_nodes: int = SHARD) -> DataFrame:
    """Adds ``shard``, a range of (conv_id, depth), and ``inside``, whether the parent is in the same one; stored."""
    count = -(-max(1, nodes.count()) // shard_nodes)
    parts = max(count, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(nodes.repartitionByRange(parts, "conv_id", "depth").withColumn("shard", F.spark_partition_id()), "trie-ranges")
    bounds = ranged.groupBy("shard").agg(F.min(F.struct("conv_id", "depth")).alias("lowest"))  # a row for each shard
    parent = F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    return stored(
        ranged.join(F.broadcast(bounds), "shard").withColumn("inside", F.coalesce(parent >= F.col("lowest"), F.lit(False))).drop("lowest"),
        "trie-shards",
    )


SWEPT = ["shard", "conv_id", "depth", "parent_conv_id", "inside", "saved", "leaves"]


def sweep(batches: Iterable[pa.RecordBatch], whole: bool, most: int = QUEUE) -> Iterator[pa.RecordBatch]:
    """Time-forward: rows in reverse level order of each shard; ``saved`` and ``leaves`` become those of the subtree.

    ``whole`` asks for every row; otherwise only shard roots come out, whose parents are elsewhere.
    """
    drop_kept()
    queue, at_shard = SpillingQueue(most), None
    for batch in batches:
        shards, convs, depths, parents, inside, saved, leaves = (batch.column(c).to_pylist() for c in SWEPT)
        out_saved, out_leaves, keep = [], [], []
        for i, (shard, conv, depth, parent) in enumerate(zip(shards, convs, depths, parents)):
            if shard != at_shard:
                queue, at_shard = SpillingQueue(most), shard
            s, n, key = saved[i], leaves[i], (-depth, conv)
            while (first := queue.first()) is not None and first[:2] == key:
                _, _, more_s, more_n = queue.pop()
                s, n = s + more_s, n + more_n
            if inside[i]:
                queue.push((1 - depth, parent, s, n))
            out_saved.append(s)
            out_leaves.append(n)
            if whole or not inside[i]:
                keep.append(i)
        columns = [*batch.columns]
        columns[batch.schema.get_field_index("saved")] = pa.array(out_saved, pa.int64())
        columns[batch.schema.get_field_index("leaves")] = pa.array(out_leaves, pa.int64())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).take(pa.array(keep, pa.int64()))


def _swept(rows: DataFrame, whole: bool) -> DataFrame:
    sorted_ = rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "conv_id")
    return sorted_.mapInArrow(lambda batches: sweep(batches, whole), rows.schema)


def shard_roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each path within a shard, the shard root above it: rows in ascending order of (shard, conv_id).

    A path is what one smallest member has in one shard; its memory is a pair of numbers for each path of the shard.
    """
    drop_kept()
    root: dict[int, tuple[int, int]] = {}
    at_shard = None
    for batch in batches:
        out = []
        for shard, conv, depth, last, parent, inside in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "depth", "last", "parent_conv_id", "inside"))):
            if shard != at_shard:
                root, at_shard = {}, shard
            root[conv] = root[parent] if inside else (conv, depth)
            out.append((conv, depth, last, *root[conv]))
        yield _table(out, ("conv_id", "depth", "last", "root_conv", "root_depth"))


def arrivals(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, more_saved, more_leaves): what each node gets from subtrees in other shards; stored."""
    leaving = stored(
        _swept(rows, whole=False).where("parent_conv_id IS NOT NULL").groupBy(
            F.col("conv_id").alias("root_conv"), F.col("depth").alias("root_depth"), F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("at"),
        ).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")), "trie-leaving",
    )
    first = rows.groupBy("shard", "conv_id").agg(
        F.min(F.struct("depth", "parent_conv_id", "inside")).alias("top"), F.max("depth").alias("last")
    ).select("shard", "conv_id", "top.*", "last")
    paths = first.repartition("shard").sortWithinPartitions("shard", "conv_id").mapInArrow(
        shard_roots, "conv_id long, depth long, last long, root_conv long, root_depth long"
    )
    onward = leaving.select("root_conv", "root_depth", F.col("conv_id").alias("next_conv"), F.col("at").alias("next_at"))
    targets = leaving.select("conv_id", "at").distinct()
    steps = stored(
        targets.join(paths, "conv_id").where("at BETWEEN depth AND last").join(onward, ["root_conv", "root_depth"])
        .select("conv_id", "at", "next_conv", "next_at"), "trie-steps",
    )
    travelling = stored(leaving.groupBy("conv_id", "at").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")), "trie-travelling")
    arrived = travelling
    while not travelling.isEmpty():
        moved = travelling.join(steps, ["conv_id", "at"]).groupBy(F.col("next_conv").alias("conv_id"), F.col("next_at").alias("at"))
        travelling = stored(moved.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")), "trie-travelling")
        arrived = arrived.unionByName(travelling)
    return arrived.groupBy("conv_id", F.col("at").alias("depth")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))


def prefix_trie(conversations: DataFrame, block: int = 20, heads: int = 4, shard_nodes: int = SHARD) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations."""
    turns, lengths = rebuilt(turns_of(conversations), block, heads)
    nodes = sharded(trie_nodes(turns, lengths), shard_nodes)
    rows = nodes.withColumns({"saved": (F.col("n_convs") - 1) * F.col("words"), "leaves": (F.col("n_children") == 0).cast("long")})
    more = arrivals(rows.select(*SWEPT))
    full = rows.join(more, ["conv_id", "depth"], "left").withColumns({
        "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)),
    }).drop("more_saved", "more_leaves")
    return _swept(full, whole=True).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )
