"""Substring dedup: passages that repeat across and within documents.

Two kinds of units are looked at, both over whole texts:

* Paragraphs: lines of ``paragraph`` words or more and, in ``whole_repeats``, runs of shorter lines that no empty line
  parts, joined up to ``paragraph`` words.  Min-max signatures of their shingles are banded for high recall (a
  pair of similarity 0.8 is missed by all 16 bands with probability 2.2e-4); colliding paragraphs are confirmed by exact Jaccard similarity
  (see ``near_dedup``).  Lines and runs under ``paragraph`` words repeat, in ``whole_repeats``, when their words are the same.
* Windows of ``window`` words that start at anchors chosen by content: the least shingle hash of each ``stride`` places in a
  row.  A passage of ``window + stride`` words or more always holds an anchored window, wherever it stands in a paragraph.
  Windows repeat when their words are the same.  ``whole_repeats`` extends each repeated stretch word by word to the ends
  of its match, so such a passage is reported whole.  Windows serve what the paragraphs leave: one that lies
  ``stride`` words or more inside a span that they already remove is not looked at, neither as a repeat nor as the
  occurrence that stays.  Keys are counted first; a window is kept only if its key is there more than once.

Units that repeat form components; of each component the occurrence in the document with the smallest id, then the
earliest, stays.  The others' spans are merged per document: that is what to remove.

Words are parted by ASCII white space and compared with A-Z lower-cased.  Defined results: null, empty and short texts
have no units and no rows; windows of fewer than four different words, and paragraphs that are, are left out (runs of one word); rows that share
an id are one document; rows with a null id are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plylake.llm.common import drop_kept, id_and_text, shuffles_freed, stored
from plylake.llm.near_dedup import LOWER, MinMax, U, coarse_clusters, confirmed_components, mix, odd_numbers, shingle_hashes, word_hashes

#: 32 permutations have 64 min-max values, which are 16 bands of four.
SHINGLE, PERMUTATIONS, ROWS = 5, 32, 4


def line_words(text: str) -> list[list[bytes]]:
    """The words of each line."""
    return [line.split() for line in text.encode().translate(LOWER).split(b"\n")]


def joined_lines(lines: list[list[bytes]], paragraph: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, words) of the paragraphs, and of the lines and runs of lines that are shorter than one.

    A run of short lines ends at a longer or an empty line.  It is cut after a line with which ``paragraph`` words are
    reached; what is left behind the last cut belongs to the paragraph before it.  No two paragraphs share a word.
    """
    whole: list[tuple[int, int]] = []
    short: list[tuple[int, int]] = []
    start = begin = cuts = held = 0  # of the run: its first word, paragraphs and lines so far
    place = 0  # where the open paragraph starts

    def close() -> None:
        if cuts and start > place:
            whole[-1] = (whole[-1][0], start - whole[-1][0])
        elif not cuts and held > 1:
            short.append((begin, start - begin))

    for line in lines:
        n = len(line)
        if not 0 < n < paragraph:
            close()
            if n:
                whole.append((start, n))
            start += n
            begin, place, cuts, held = start, start, 0, 0
            continue
        short.append((start, n))
        start, held = start + n, held + 1
        if start - place >= paragraph:
            whole.append((place, start - place))
            place, cuts = start, cuts + 1
    close()
    return whole, short


@cache
def _odd_up_to(bits: int, seed: int) -> np.ndarray:
    return odd_numbers(1 << bits, seed)


def _odd(n: int, seed: int) -> np.ndarray:
    """``odd_numbers``, whose first ones are the same for every ``n``, made once for each power of two."""
    return _odd_up_to(n.bit_length(), seed)[:n]


def _varied(words: np.ndarray) -> bool:
    """Whether there are four different words; mostly the first eight say so."""
    return len(set(words[:8].tolist())) > 3 or len(set(words.tolist())) > 3


def anchors(hashes: np.ndarray, window: int, stride: int, shingles: np.ndarray | None = None) -> np.ndarray:
    """Word places at which a window starts: the least (then first) shingle hash of each ``stride`` places."""
    n = len(hashes) - max(window, SHINGLE) + 1
    if n < 1:
        return np.zeros(0, np.int64)
    values = (shingle_hashes(hashes, SHINGLE) if shingles is None else shingles)[:n]
    if n <= stride:
        return np.array([int(values.argmin())])
    views = np.lib.stride_tricks.sliding_window_view(values, stride)
    at = views.argmin(axis=1) + np.arange(len(views))  # never goes back
    return at[np.append(True, at[1:] != at[:-1])]


def windows_of(hashes: np.ndarray, window: int, stride: int, shingles: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the anchored windows; ``shingles``: the shingle hashes of the same words, if they are at hand."""
    at = anchors(hashes, window, stride, shingles)
    if not len(at):
        return at, np.zeros(0, U)
    words = hashes[at[:, None] + np.arange(window)]
    ordered = np.sort(words, axis=1)
    varied = (ordered[:, 1:] != ordered[:, :-1]).sum(axis=1) >= 3
    return at[varied], _window_keys(words[varied], window)


def _window_keys(words: np.ndarray, window: int) -> np.ndarray:
    """Keys of rows of ``window`` word hashes."""
    return mix((words * _odd(window, 21)).sum(axis=1, dtype=U))


def _run_keys(hashes: np.ndarray, runs: list[tuple[int, int]]) -> np.ndarray:
    """Keys of runs (start, words) of words: equal for equal words in equal order."""
    starts, sizes = np.array(runs, np.int64).T
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    order = _odd(int(sizes.max()), 61)
    return mix(np.add.reduceat(mix(hashes[np.repeat(starts, sizes) + places]) * order[places], ends - sizes) + sizes.astype(U))


#: Windows (kind 0) come packed, a row for each document: ``at`` holds their starts, ``keys`` their keys.
UNITS = "kind int, doc_id long, start int, words int, key long, bands array<long>, sig binary, at binary, keys binary"


def _units(batches: Iterable[pa.RecordBatch], window: int, stride: int, paragraph: int, joined_too: bool) -> Iterator[pa.RecordBatch]:
    """The windows (kind 0) of every document, its paragraphs (kind 1) and, on demand, shorter lines and runs (kind 2)."""
    drop_kept()
    maker = MinMax(PERMUTATIONS, ROWS)
    names = ["kind", "doc_id", "start", "words", "key", "bands", "sig", "at", "keys"]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())

    def made(**columns: object) -> pa.RecordBatch:
        n = len(columns["kind"])
        return pa.RecordBatch.from_arrays([pa.array(columns[c]).cast(k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

    for batch in batches:
        packed: list[tuple[int, bytes, bytes]] = []
        runs: list[tuple[int, int, int]] = []
        keys: list[np.ndarray] = []
        rows: list[tuple[int, int, int]] = []
        shingles: list[np.ndarray] = []
        for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            lines = line_words(text.as_py())
            hashes = word_hashes([w for line in lines for w in line])
            all_shingles = shingle_hashes(hashes, SHINGLE)  # a paragraph's are a stretch of them
            at, key = windows_of(hashes, window, stride, all_shingles)
            if len(at):
                packed.append((name, at.astype("<i4").tobytes(), key.astype("<u8").tobytes()))
            if joined_too:
                whole, short = joined_lines(lines, paragraph)
                short = [(a, k) for a, k in short if _varied(hashes[a:a + k])]
            else:
                ends = np.cumsum([len(line) for line in lines]).tolist()
                whole, short = [(b - len(line), len(line)) for line, b in zip(lines, ends) if len(line) >= paragraph], []
            for start, k in whole:
                if _varied(hashes[start:start + k]):
                    rows.append((name, start, k))
                    inside = k >= SHINGLE
                    shingles.append(all_shingles[start:start + k - SHINGLE + 1] if inside else shingle_hashes(hashes[start:start + k], SHINGLE))
            if short:
                runs += [(name, a, k) for a, k in short]
                keys.append(_run_keys(hashes, short))
        if packed:
            of, starts, of_keys = zip(*packed)
            yield made(kind=[0] * len(packed), doc_id=of, at=starts, keys=of_keys)
        if runs:
            of, starts, sizes = zip(*runs)
            yield made(kind=[2] * len(runs), doc_id=of, start=starts, words=sizes, key=np.concatenate(keys).view(np.int64))
        if rows:
            sizes = np.array([len(s) for s in shingles])
            joined = np.concatenate(shingles)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            sig = maker.signatures(joined, starts)
            order = odd_numbers(int(sizes.max()), 31)
            places = np.arange(len(joined)) - np.repeat(starts, sizes)
            key = mix(np.add.reduceat(mix(joined) * order[places], starts)).view(np.int64)
            of, first, n = zip(*rows)
            yield made(
                kind=[1] * len(rows), doc_id=of, start=first, words=n, key=key,
                bands=maker.bands(sig).tolist(), sig=[s.tobytes() for s in maker.short(sig)],
            )


def _open_windows(batches: Iterable[pa.RecordBatch], window: int, stride: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, key) of the packed windows that do not lie ``stride`` words inside one of the document's ``gone`` spans.

    A match that reaches beyond a span needs the windows up to ``stride`` words inside of it: it may hold no other.
    """
    for batch in batches:
        for name, at, keys, gone in zip(*(batch.column(c) for c in ("doc_id", "at", "keys", "gone"))):
            start, key = np.frombuffer(at.as_py(), "<i4"), np.frombuffer(keys.as_py(), "<i8")
            spans = sorted((g["a"], g["b"]) for g in gone.as_py() or [])
            if spans:
                begins, ends = np.array(spans).T
                place = np.searchsorted(begins, start - stride, "right") - 1
                there = (place < 0) | (start + window + stride > ends[np.maximum(place, 0)])
                start, key = start[there], key[there]
            columns = [pa.array(np.full(len(start), name.as_py(), np.int64)), pa.array(start), pa.array(key)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "key"])


def _paragraph_components(paragraphs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(key, root): a component for every class of equal paragraphs that resembles another."""
    classes = paragraphs.groupBy(F.col("key").alias("id")).agg(
        F.min(F.struct("doc_id", "start", F.col("words").cast("long").alias("n"), "bands", "sig")).alias("first")
    ).select("id", "first.*")
    classes = stored(classes, "repeat-classes")
    clusters = coarse_clusters(classes.select("id", "n", "bands", "sig"), int(2 * PERMUTATIONS * 0.45), 0.0, "repeat")
    wanted = classes.join(clusters, "id").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "id", "root")).alias("parts"))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, parts in zip(batch.column("text"), batch.column("parts").to_pylist()):
                hashes = word_hashes(text.as_py().encode().translate(LOWER).split())
                for part in parts:
                    if part["start"] < len(hashes):
                        found = np.unique(shingle_hashes(hashes[part["start"]:part["start"] + part["n"]], SHINGLE))
                        out.append((part["root"], part["id"], found.tobytes()))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["cluster", "id", "set"])

    rows = texts.join(wanted, "doc_id").select("text", "parts").mapInArrow(sets, "cluster long, id long, set binary")
    return confirmed_components(stored(rows, "repeat-sets"), threshold, "repeat").withColumnRenamed("id", "key")


def repeats(docs: DataFrame, window: int = 30, stride: int = 20, paragraph: int = 50, threshold: float = 0.8) -> DataFrame:
    """The spans of repeated paragraphs and anchored windows, as they are: a passage's ends may stay (see ``whole_repeats``).

    Columns: doc_id, start_word, end_word (exclusive), n_words, keep_doc_id.  ``keep_doc_id`` is the document in which the
    passage (the first of several that were merged) stays; it may be the same document.
    """
    units = _stored_units(_texts(docs), window, stride, paragraph, False)
    lines = _line_spans(_texts(docs), units, threshold)
    return merged(lines.unionByName(_later(_repeated_windows(units, lines, window, stride), window).drop("key")))


def whole_repeats(docs: DataFrame, window: int = 30, stride: int = 20, paragraph: int = 50, threshold: float = 0.8) -> DataFrame:
    """The spans to remove, in the columns of ``repeats``, with every passage extended to its whole match and short lines looked at too."""
    texts = _texts(docs)
    with shuffles_freed(docs.sparkSession):
        units = _stored_units(texts, window, stride, paragraph, True)
        lines = _line_spans(texts, units, threshold)
        again = _repeated_windows(units, lines, window, stride)
        spans = stored(_later(again, window), "repeat-spans")
        ends = _ends(texts, again, spans, window, stride)
    return merged(lines.unionByName(spans.drop("key")).unionByName(ends))


def _texts(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).where("doc_id IS NOT NULL AND text <> ''")


def _stored_units(texts: DataFrame, window: int, stride: int, paragraph: int, joined_too: bool) -> DataFrame:
    return stored(texts.mapInArrow(lambda batches: _units(batches, window, stride, paragraph, joined_too), UNITS), "repeat-units")


def _line_spans(texts: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """The spans (doc_id, a, b, keep) of paragraphs, short lines and runs that repeat an earlier one."""
    paragraphs = units.where("kind = 1")
    roots = _paragraph_components(paragraphs, texts, threshold)
    near = paragraphs.select("key", "doc_id", "start", "words").join(roots, "key", "left")
    named = units.where("kind = 2").select("kind", F.col("key").alias("root"), "doc_id", "start", "words").unionByName(
        near.select(F.lit(1).alias("kind"), F.coalesce("root", "key").alias("root"), "doc_id", "start", "words")
    )
    keepers = named.groupBy("kind", "root").agg(F.min(F.struct("doc_id", "start")).alias("keep"), F.count("*").alias("n")).where("n > 1")
    spans = named.join(keepers, ["kind", "root"]).where("doc_id <> keep.doc_id OR start <> keep.start")
    return stored(spans.select("doc_id", F.col("start").alias("a"), (F.col("start") + F.col("words")).alias("b"), F.col("keep.doc_id").alias("keep")), "repeat-lines")


def _repeated_windows(units: DataFrame, lines: DataFrame, window: int, stride: int) -> DataFrame:
    """(key, doc_id, start) of the windows with a key that is there twice, of those that are not deep inside of ``lines``."""
    gone = merged(lines).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))).alias("gone"))
    packed = units.where("kind = 0").select("doc_id", "at", "keys").join(gone, "doc_id", "left")
    windows = stored(packed.mapInArrow(lambda batches: _open_windows(batches, window, stride), "doc_id long, start int, key long"), "repeat-open")
    twice = windows.groupBy("key").count().where("count > 1").select("key")
    return stored(windows.join(twice, "key"), "repeat-windows")


def _later(windows: DataFrame, window: int) -> DataFrame:
    """The spans (key, doc_id, a, b, keep) of windows that repeat an earlier one."""
    keepers = windows.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("keep"))
    return windows.join(keepers, "key").where("doc_id <> keep.doc_id OR start <> keep.start").select(
        "key", "doc_id", F.col("start").alias("a"), (F.col("start") + window).alias("b"), F.col("keep.doc_id").alias("keep")
    )


def _stretches(hashes: np.ndarray, at: np.ndarray, key: np.ndarray, window: int, most: int, side: int) -> tuple[np.ndarray, ...]:
    """(place in ``at``, words, key) of every window with the 1, 2, ... ``most`` words after it (side 1) or before it (side 0)."""
    step = np.arange(most)
    place = at[:, None] + (window + step if side else -1 - step)
    there = (place >= 0) & (place < len(hashes))
    words = np.where(there, hashes[np.clip(place, 0, len(hashes) - 1)], U(0))
    grown = mix(key[:, None] + np.cumsum(words * _odd(most, 41 + side), axis=1, dtype=U) + _odd(most, 51 + side))
    i, j = np.nonzero(there)
    return i, j + 1, grown[i, j]


def _ends(texts: DataFrame, windows: DataFrame, spans: DataFrame, window: int, stride: int) -> DataFrame:
    """Spans (doc_id, a, b, keep) that reach from the outermost windows of each repeated stretch to the ends of its match.

    Beyond its outermost anchored windows a match has fewer than ``stride`` words at either end.  Every occurrence of such
    a window gives a key for the window with 1, 2, ... of the words next to it; the longest of them that an earlier
    occurrence has too is the match's end.  All earlier occurrences count, not only the one that stays.
    """
    order = Window.partitionBy("doc_id").orderBy("a")
    apart = spans.select("doc_id", "a", "key").distinct()
    far = F.lag("a").over(order), F.lead("a").over(order)
    outer = apart.select(
        "key", F.coalesce(F.col("a") - far[0] > window, F.lit(True)).alias("left"), F.coalesce(far[1] - F.col("a") > window, F.lit(True)).alias("right")
    ).groupBy("key").agg(F.max("left").alias("left"), F.max("right").alias("right")).where("left OR right")
    wanted = windows.select("key", "doc_id", "start").distinct().join(outer, "key").groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "key", "left", "right")).alias("at")
    )

    def grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "doc_id", "start", "side", "more"], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        for batch in batches:
            for name, text, rows in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("at")):
                hashes = word_hashes(text.as_py().encode().translate(LOWER).split())
                rows = [r for r in rows.as_py() if r["start"] + window <= len(hashes)]
                if not rows:
                    continue
                key = np.array([r["key"] for r in rows], np.int64).view(U)
                own = _window_keys(hashes[np.array([r["start"] for r in rows])[:, None] + np.arange(window)], window)
                rows = [r for r, same in zip(rows, (own == key).tolist()) if same]  # rows that share an id have several texts
                for side, part in enumerate(([r for r in rows if r["left"]], [r for r in rows if r["right"]])):
                    at, key = np.array([r["start"] for r in part], np.int64), np.array([r["key"] for r in part], np.int64).view(U)
                    if len(at):
                        i, more, grown = _stretches(hashes, at, key, window, stride - 1, side)
                        columns = (grown.view(np.int64), np.full(len(i), name), at[i], np.full(len(i), side), more)
                        yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], names=names)

    if stride < 2:
        return spans.limit(0).select("doc_id", "a", "b", "keep")
    rows = texts.join(wanted, "doc_id").select("doc_id", "text", "at").mapInArrow(grow, "key long, doc_id long, start int, side int, more int")
    rows = stored(rows, "repeat-ends")
    first = rows.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("keep"), F.count("*").alias("n")).where("n > 1")
    longer = rows.join(first, "key").where("doc_id <> keep.doc_id OR start <> keep.start")
    best = longer.groupBy("doc_id", "start", "side").agg(F.max(F.struct("more", "keep")).alias("best"))
    more = F.col("best.more")
    return best.select(
        "doc_id", F.when(F.col("side") == 0, F.col("start") - more).otherwise(F.col("start")).alias("a"),
        F.when(F.col("side") == 1, F.col("start") + window + more).otherwise(F.col("start") + window).alias("b"), F.col("best.keep.doc_id").alias("keep"),
    )


def merged(spans: DataFrame) -> DataFrame:
    """Joins spans (doc_id, a, b, keep) of a document that overlap or touch."""
    order = Window.partitionBy("doc_id").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.withColumn("new", F.coalesce(F.col("a") > before, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("doc_id", "part").agg(
        F.min("a").alias("start_word"), F.max("b").alias("end_word"), F.min_by("keep", F.struct("a", "b", "keep")).alias("keep_doc_id")
    ).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "keep_doc_id")
