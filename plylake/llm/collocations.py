"""Phrase collocations by SON partitioning, united level by level, with exact counts.

1. Shards of at most ``shard_words`` words are mined completely, level by level (words, then phrases of two words, and so
   on: a phrase can only be frequent where its first and its last words are).
2. What shards find is united after words, after pairs and after the longer phrases: a shard reports every phrase, whose
   shorter ones are known to be frequent in all shards together, with its count.  No shard holds anything back, so the sums
   of the reports are the exact counts, by words and not by a hash, and nothing is counted twice.
3. What is known to be frequent is a bit map of 2^27 hash positions (16 MB at any size).  Hashes that meet can only add
   reports, whose sums then fall short of the support.
4. Scores, cuts and absorption are joins over the frequent phrases.

A shard's memory is bounded by its words, and one text is cut into pieces of a megabyte before it is split into words.  A
shard reports at most its different phrases, however many shards there are and however small the support is beside them;
so reports grow with the input.  The shuffle files of a union go before the next one begins.

Defined results: a null text is the empty text; a null language is ``und``; rows with equal texts all count; a null id
does not matter, as ids are not read; other columns are not read; an empty table gives no rows.  Words may be of any
length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plylake.llm.common import drop_kept, shuffles_freed, stored
from plylake.llm.near_dedup import mix, odd_numbers, word_hashes

U = np.uint64
#: A-Z to a-z; what parts pieces to a line feed; a tab to a space.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
LONGEST = 5
BITS = 27
STRETCH = 4096
PIECE = 1 << 20
#: Phrases of so many words are united together.
UNIONS = (range(1, 2), range(2, 3), range(3, LONGEST + 1))


class Words(dict):
    """Numbers of words; 0 is no word (what stands between two spaces), 1 the border of a piece."""

    def __init__(self) -> None:
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def of_text(self, text: bytes) -> list[np.ndarray]:
        """The numbers of a text's words, with a border after its last word."""
        out, at, text = [], 0, text.translate(FOLD)
        while at < len(text):
            end = at + PIECE
            while end < len(text) and text[end] not in b" \n":
                end += 1
            parts = text[at:end].replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self.__getitem__, parts), np.int32, len(parts))
            out.append(ids[ids > 0])
            at = end
        out.append(np.ones(1, np.int32))
        return out


class Shard:
    """Word numbers by language, of some documents."""

    def __init__(self) -> None:
        self.words, self.parts, self.size, self.n_bytes = Words(), {}, 0, 0

    def add(self, lang: str, text: bytes) -> None:
        arrays = self.words.of_text(text)
        self.parts.setdefault(lang, []).extend(arrays)
        self.size += sum(map(len, arrays))
        self.n_bytes += len(text)

    def languages(self) -> Iterator[tuple[str, np.ndarray]]:
        for lang in list(self.parts):
            yield lang, np.concatenate(self.parts.pop(lang))


def shards(batches: Iterable[pa.RecordBatch], most_words: int) -> Iterator[Shard]:
    """The batches' rows (lang, text) as shards of about ``most_words`` words."""
    shard = Shard()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            shard.add(lang, text.as_py().encode())
            if shard.size >= most_words:
                yield shard
                shard = Shard()
    if shard.n_bytes:
        yield shard


Test = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places, every key's number and the counts of the distinct keys."""
    order = np.argsort(keys, kind="stable").astype(np.int32)
    keys = keys[order]
    new = np.empty(len(keys), bool)
    new[0] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    del keys
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    starts = np.flatnonzero(new)
    return order[starts], number, np.diff(starts, append=len(order))


def levels(ids: np.ndarray, size: int, test: Test, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, first places, counts) of the phrases of k words that pass ``test`` (k, first places, counts).

    A phrase is looked at only where both its parts of k - 1 words have passed.  Phrases are told apart by the number of
    their first part and their last word, so no two different ones meet.
    """
    at = np.flatnonzero(ids > 1).astype(np.int32)
    keys = ids[at].astype(np.int64)
    for k in range(1, longest + 1):
        if not len(at):
            return
        first, number, counts = numbered(keys)
        good = test(k, at[first], counts)
        yield k, at[first[good]], counts[good]
        if k == longest:
            return
        del first, counts
        passed = good[number]
        at, number = at[passed], number[passed]
        alive = np.zeros(len(ids) + 1, bool)
        alive[at] = True
        follows = alive[at + 1]
        at, number = at[follows], number[follows]
        keys = number.astype(np.int64) * size + ids[np.minimum(at + k, len(ids) - 1)]


def phrase_hashes(lang: str, ids: np.ndarray, at: np.ndarray, k: int, hashes: np.ndarray) -> np.ndarray:
    """Hashes of the phrases of ``k`` words at the places ``at``."""
    total = np.full(len(at), xxhash.xxh3_64_intdigest(lang.encode(), k), U)
    for i, factor in enumerate(odd_numbers(k, 17)):
        total += hashes[ids[at + i]] * factor
    return mix(total)


class BitMap:
    """A set of hashes by their highest ``BITS`` bits: all that were put in are in it, and a few more."""

    def __init__(self) -> None:
        self.bits = np.zeros(1 << (BITS - 3), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        place = hashes >> U(64 - BITS)
        np.bitwise_or.at(self.bits, place >> U(3), np.left_shift(1, (place & U(7)).astype(np.uint8), dtype=np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> U(64 - BITS)
        return (self.bits[place >> U(3)] >> (place & U(7)).astype(np.uint8) & 1).astype(bool)

    def rows(self) -> pa.RecordBatch:
        """(bucket, bits): the stretches of 4 kB that are not empty."""
        cut = self.bits.reshape(-1, STRETCH)
        full = np.flatnonzero(cut.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array([cut[i].tobytes() for i in full], pa.binary())], names=["bucket", "bits"]
        )


def joined(maps: DataFrame) -> BitMap:
    """The union of the tasks' maps: at most 2^12 rows of 4 kB reach the driver."""
    whole = BitMap()
    for row in maps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).toLocalIterator():
        whole.bits[row["bucket"] * STRETCH:(row["bucket"] + 1) * STRETCH] = np.frombuffer(row["bits"], np.uint8)
    return whole


def reports(batches: Iterable[pa.RecordBatch], known: Callable[[], BitMap], lengths: range, shard_words: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) by shard of the phrases of ``lengths`` words whose shorter ones are ``known`` as far as those were united.

    With words, the empty phrase counts them all.
    """
    drop_kept()
    for shard in shards(batches, shard_words):
        spelled, hashes, frequent = pa.array(list(shard.words), pa.binary()), word_hashes(list(shard.words)), known()
        sizes = np.array(pc.binary_length(spelled), np.int64) + 1
        for lang, ids in shard.languages():
            def test(k: int, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
                return frequent.holds(phrase_hashes(lang, ids, at, k, hashes)) if k < lengths[0] else np.ones(len(at), bool)

            if 1 in lengths:
                yield _counted(lang, pa.array([b""], pa.binary()), np.array([(ids > 1).sum()]))
            for k, at, counts in levels(ids, len(spelled), test, lengths[-1]):
                if k not in lengths:
                    continue
                parts = np.cumsum(sum(sizes[ids[at + i]] for i in range(k))) // PIECE  # of about a megabyte of phrases
                cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(at)]
                for a, b in zip(cuts, cuts[1:]):
                    words = [spelled.take(pa.array(ids[at[a:b] + i])) for i in range(k)]
                    yield _counted(lang, pc.binary_join_element_wise(*words, b" "), counts[a:b])


def _counted(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(lang, pa.string()), len(phrases)), phrases.cast(pa.string()), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "f"]
    )


def maps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bit map of a task's phrases (lang, phrase), as (bucket, bits)."""
    found = BitMap()
    for batch in batches:
        alike: dict[tuple[str, int], list[bytes]] = {}
        for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
            words = phrase.encode().split(b" ")
            alike.setdefault((lang, len(words)), []).extend(words)
        for (lang, k), words in alike.items():
            found.add(phrase_hashes(lang, np.arange(len(words)), np.arange(0, len(words), k), k, word_hashes(words)))
    yield found.rows()


def phrase_counts(texts: DataFrame, support: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of up to five words with f >= support, and (lang, n); both stored."""
    spark, known, united = texts.sparkSession, BitMap(), []

    def union(lengths: range) -> DataFrame:
        shared = spark.sparkContext.broadcast(known)
        reported = texts.mapInArrow(lambda rows: reports(rows, lambda: shared.value, lengths, shard_words), "lang string, phrase string, f long")
        summed = reported.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= support) | (F.col("phrase") == ""))
        with shuffles_freed(spark):
            return stored(summed, f"phrase-counts-{lengths[0]}")

    for lengths in UNIONS:
        united.append(union(lengths))
        if lengths is not UNIONS[-1]:
            known.bits |= joined(united[-1].where("phrase <> ''").select("lang", "phrase").mapInArrow(maps, "bucket int, bits binary")).bits
    totals = stored(united[0].where("phrase = ''").select("lang", F.col("f").alias("n")), "phrase-totals")
    return reduce(DataFrame.unionByName, united).where("phrase <> ''"), totals


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase of two words or more, by its lowest-scoring cut.

    A very common first word makes a skewed side of an equal-key join, which adaptive execution splits.
    """
    words = F.split("phrase", " ")
    phrases = counts.withColumn("words", words).where(F.size("words") > 1)
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("tail"),
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    found = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    # a <= l and a <= r, so a score is at most 1000 * n / support and fits a long; the products have up to 37 digits
    score = F.expr("(1000 * (cast(a AS decimal(18,0)) * cast(n AS decimal(18,0)))) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    best = found.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, support: int = 100, top: int = 2000, shard_words: int = 6_000_000) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counts, totals = phrase_counts(texts.where("text <> ''"), support, shard_words)
    words = F.split("phrase", " ")
    longer = counts.withColumn("words", words).where(F.size("words") > 2)
    inner = longer.select(
        "lang", "f", F.explode(F.array(
            F.array_join(F.slice("words", F.lit(1), F.size("words") - 1), " "), F.array_join(F.slice("words", F.lit(2), F.size("words") - 1), " "),
        )).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = scored(counts, totals).join(inner, ["lang", "phrase"], "left").where("around IS NULL OR around < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
