"""Token-id files in Simple-8b: word-aligned packing with escapes and block offsets.

A 64-bit word has a 4-bit selector on top and as many ids of equal width as fit in the 60 bits below; an id over 60 bits
stands in full in the word after an escape selector.  Ids are packed in blocks; a segment's offsets say at which word
each block starts, so blocks decode on their own, each selector's words at once in numpy.

The file format is Parquet, one row for each segment of whole documents: shard, segment, first (ids of the shard before
it), doc_ids, lengths, offsets, words.  Documents are dealt to shards by ranges of their id and encoded in id order in
their shard; Spark's writer commits each task's file, so a lost executor repeats only its shard.  Starts across shards
come from the shards' sums when the files are read.

Defined results: a null text is the empty text (the end id alone); a null doc_id stands last; rows that share an id are
documents of their own, in any order; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import ChainMap
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from plylake.llm.bpe import Generations
from plylake.llm.common import dealt, id_and_text, kept_in_worker, lots
from plylake.session import scratch_path

#: Fixed values of Simple-8b: ids in a word by selector; each takes 60 // ids bits.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
_TAKES = np.array([*COUNTS, 1, 1])
_BITS = np.array([*(60 // count for count in COUNTS), 0, 0], np.uint64)
_MASKS = np.array([*((1 << 60 // count) - 1 for count in COUNTS), (1 << 64) - 1, (1 << 64) - 1], np.uint64)
_SMALL = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)
#: Words with a selector in a block.
BLOCK = 1024
SEGMENT = 65_536
FILE = "shard int, segment int, first long, doc_ids array<long>, lengths array<long>, offsets array<int>, words binary"


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    if int(ids.max()) < len(_SMALL):
        return _SMALL[ids]
    high = (ids >> np.uint64(32)).astype(np.uint32)
    if not high.any():
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low).astype(np.uint8)


def _fits(ids: np.ndarray) -> np.ndarray:
    """For each place, the selector that packs most of the ids from there on (ESCAPE if the first is too large)."""
    reach = _widths(ids)
    best, span, least = np.full(len(ids), ESCAPE, np.uint8), 1, int(reach.min())
    for selector in range(len(COUNTS) - 1, -1, -1):
        count = COUNTS[selector]
        if count > len(ids) or least > 60 // count:
            break
        while span < count:  # reach[i]: the widest of ids[i : i + span]
            add = min(span, count - span)
            reach = np.maximum(reach[:-add], reach[add:])
            span += add
        np.copyto(best[:len(reach)], np.uint8(selector), where=reach <= 60 // count)
    return best


def _starts(takes: np.ndarray) -> np.ndarray:
    """Where the words start, if one from each place on takes so many ids: leaps of 16 words, then those between."""
    n, starts, at = len(takes), [], 0
    leaps = [np.append(np.minimum(np.arange(n) + takes, n), n)]
    for _ in range(4):
        leaps.append(leaps[-1][leaps[-1]])
    far = memoryview(leaps.pop())
    while at < n:
        starts.append(at)
        at = far[at]
    starts = np.array(starts)
    for leap in reversed(leaps):
        starts = np.stack((starts, leap[starts]), 1).ravel()
    return starts[starts < n]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all words of the ids, unsigned 64-bit; places of those that begin a block)."""
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n, best = len(ids), _fits(ids)
    starts = _starts(_TAKES[best])
    selectors = best[starts]
    escaped = selectors == ESCAPE
    places = np.arange(len(starts)) + np.cumsum(escaped) - escaped
    counts = _TAKES[selectors]
    shifts = (np.arange(n) - np.repeat(starts, counts)).astype(np.uint64) * np.repeat(_BITS[selectors], counts)
    packed = np.bitwise_or.reduceat(ids << shifts, starts)
    words = np.zeros(len(starts) + int(escaped.sum()), np.uint64)
    words[places] = selectors.astype(np.uint64) << np.uint64(60)
    words[places + escaped] |= packed  # an id that escapes stands in the word behind
    return words, places[::BLOCK]


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of one block of words."""
    tops = (words >> np.uint64(60)).astype(np.uint8)
    if (tops == ESCAPE).any():  # a word after an escape is an id, whatever its top bits
        plain, at = np.ones(len(words), bool), 0
        for at in np.flatnonzero(tops == ESCAPE):
            if plain[at]:
                plain[at + 1] = False
        heads = np.flatnonzero(plain)
    else:
        heads = np.arange(len(words))
    selectors = tops[heads]
    counts = _TAKES[selectors]
    firsts = np.cumsum(counts) - counts
    shifts = (np.arange(int(counts.sum())) - np.repeat(firsts, counts)).astype(np.uint64) * np.repeat(_BITS[selectors], counts)
    return (np.repeat(words[heads + (selectors == ESCAPE)], counts) >> shifts) & np.repeat(_MASKS[selectors], counts)


def blocks(words: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The ids of a segment, block by block: each is decoded from its offset to the next one's, by itself."""
    for a, b in zip(offsets, [*offsets[1:], len(words)]):
        yield unpack(words[a:b])


_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "'<")
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
_WHITE = b"\x09\x0a\x0b\x0c\x0d\x20"
_KIND = bytes(
    _SPACE if c in _WHITE else _DIGIT if c in b"0123456789" else _LETTER if c > 127 or bytes((c,)).isalpha() else _MARK for c in range(256)
)
_ODD = bytes(c > 127 or c in b"'<" for c in range(256))  # bytes that may keep their part whole
_LATIN = 0xC3  # first byte of the letters of Latin-1, but for two signs
_LOWER = bytes(range(256)).lower()
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
#: Bytes of text that are looked up together, and that are cut at once.
TOGETHER, CUT = 1 << 22, 1 << 20


def _pieces(text: bytes) -> tuple[np.ndarray, pa.Array]:
    """(where each piece of UTF-8 text starts, the pieces): what stands between white space, cut further where it is plain.

    Plain parts hold ASCII without apostrophes and ``<``, and the letters of Latin-1: their pieces are lower-cased runs of
    letters, digits, and runs of marks.  The text ends with white space.
    """
    data = np.frombuffer(text, np.uint8)
    kind = np.frombuffer(text.translate(_KIND), np.uint8)
    cut = np.ones(len(kind), bool)
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    cut |= kind == _DIGIT
    starts = np.flatnonzero(cut)
    space = kind[starts] == _SPACE
    low = np.frombuffer(text.translate(_LOWER, _WHITE), np.uint8).copy()
    odd = np.flatnonzero(np.frombuffer(text.translate(_ODD), bool))
    byte, before = data[odd], data[odd - 1]
    odd = odd[(byte != _LATIN) & ((before != _LATIN) | (byte == 0x97) | (byte == 0xB7))]
    latin = np.flatnonzero(low == _LATIN) + 1
    low[latin[(low[latin] < 0x9F) & (low[latin] != 0x97)]] += 0x20
    whole = None
    if len(odd):
        gaps = np.flatnonzero(space)
        part = np.searchsorted(starts[gaps], odd)  # how many runs of white space stand before
        part = part[np.diff(part, prepend=-1) > 0]
        first, last = np.where(part > 0, gaps[part - 1] + 1, 0), gaps[part]
        whole = np.zeros(len(starts), bool)
        whole[first] = True
        more = last - first > 1
        step = np.zeros(len(starts), np.int8)
        step[first[more] + 1], step[last[more]] = 1, -1
        kept = np.cumsum(step, dtype=np.int8) == 0
        starts, space, whole = starts[kept], space[kept], whole[kept]
    word = ~space
    lengths = np.diff(starts, append=len(text))[word]
    if whole is not None:
        low = np.where(np.repeat(whole[word], lengths), np.frombuffer(text.translate(None, _WHITE), np.uint8), low)
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return starts[word], pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(low))


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, lower-cases, and parts letters, digits and other marks.

    Texts are cut into pieces that the tokenizer encodes apart from each other, many texts at once; each distinct piece
    is looked up once and remembered, in bounded memory.  Parts between white space that are not plain (see ``_pieces``) are
    pieces as they stand.  Of those, a word with ASCII marks behind it is cut once it is new, if its normal form has only
    letters (a letter whose lower case or normal form holds a combining mark is left to the library with its whole part).
    New words are encoded in one call of the library and told apart by the tokens that end a word; all else is encoded by
    itself.
    """

    def __init__(self, definition: str, word_end: str = "</w>", tables: int = 500_000) -> None:
        self.tokenizer = Tokenizer.from_str(definition)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(word_end) for i in range(size)])
        self.plain = Tokenizer.from_str(definition)  # for plain words, which are their own normal form
        self.plain.normalizer, self.plain.pre_tokenizer = None, Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.parts = Generations(lambda part: self._ids(part).tobytes(), tables)

    def _ids(self, text: str, tokenizer: Tokenizer | None = None) -> np.ndarray:
        (found,) = (tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, dtype="<u4")

    def _letters(self, words: list[str]) -> set[str]:
        """Those words that are all letters to the tokenizer, that is, once it has lower-cased and normalised them."""
        normal = self.tokenizer.normalizer.normalize_str
        forms = normal(" ".join(words)).split(" ")
        if len(forms) != len(words):  # white space of other kinds stands within words
            forms = map(normal, words)
        return {word for word, form in zip(words, forms) if form.isalpha()}

    def _learned(self, words: list[str], tokenizer: Tokenizer) -> dict[str, bytes]:
        """The ids of words that are encoded together."""
        found: dict[str, bytes] = {}
        for at in range(0, len(words), 2000):
            some = words[at:at + 2000]
            ids = self._ids(" ".join(some), tokenizer)
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(cuts) == len(some) + 1:
                data = ids.tobytes()
                found.update({word: data[a:b] for word, a, b in zip(some, cuts, cuts[1:])})
        return found

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of new pieces."""
        found = self._learned([piece for piece in pieces if _PLAIN(piece)], self.plain)
        parts = [piece for piece in pieces if not piece.isascii() and piece not in found]
        heads = [part.rstrip(_MARKS) for part in parts]
        letters = self._letters([word for word in heads if word.isalpha()])
        words = self._learned(list(self.parts.lacks(letters)), self.tokenizer)
        ids = ChainMap(words, found, self.parts)
        found.update({
            part: ids[word] + (ids[part[len(word):]] if len(word) < len(part) else b"")
            for part, word in zip(parts, heads) if word in letters
        })
        return words | found | {piece: self._ids(piece).tobytes() for piece in pieces if piece not in found}

    def _found(self, pieces: list[str]) -> list[bytes]:
        return self.parts.get_all(pieces, self._new)

    def packed(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = []
        for lot in lots(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), TOGETHER):
            lines = pc.binary_join_element_wise(lot, "\n", "")
            starts, pieces, ends, done = [], [], np.frombuffer(lines.buffers()[1], np.int32)[:len(lines) + 1], 0
            while done < len(lines):
                at = int(ends[done])
                done = max(done + 1, int(np.searchsorted(ends, at + CUT, "right")) - 1)
                places, some = _pieces(lines.buffers()[2][at:int(ends[done])].to_pybytes())
                starts.append(places + at)
                pieces.append(some)
            out += dealt(pa.concat_arrays(pieces), np.searchsorted(np.concatenate(starts), ends), self._found)
        return out


def _encoder(definition: str) -> WordEncoder:
    return kept_in_worker(("words", hash(definition)), lambda: WordEncoder(definition))


def _segment(shard: int, number: int, first: int, docs: list, lengths: list[int], ids: list[bytes]) -> pa.RecordBatch:
    words, offsets = pack(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.uint64))
    values = (
        ([shard], pa.int32()), ([number], pa.int32()), ([first], pa.int64()), ([docs], pa.list_(pa.int64())),
        ([lengths], pa.list_(pa.int64())), ([offsets.tolist()], pa.list_(pa.int32())), ([words.astype("<u8").tobytes()], pa.binary()),
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in values], names=["shard", "segment", "first", "doc_ids", "lengths", "offsets", "words"]
    )


def write_shards(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, segment: int = SEGMENT, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encodes all documents into token-id files under ``path``, in ascending id."""
    with open(tokenizer_path, encoding="utf-8") as source:
        shared = docs.sparkSession.sparkContext.broadcast(source.read())
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = _encoder(shared.value), TaskContext.get().partitionId()
        number = first = held = 0
        names: list = []
        lengths: list[int] = []
        ids: list[bytes] = []
        for batch in batches:
            for name, packed in zip(batch.column("doc_id").to_pylist(), own.packed(batch.column("text"))):
                ids.append(packed + end)
                names.append(name)
                lengths.append(len(ids[-1]) // 4)
                held += lengths[-1]
                if held >= segment:
                    yield _segment(shard, number, first, names, lengths, ids)
                    number, first, held, names, lengths, ids = number + 1, first + held, 0, [], [], []
        if names:
            yield _segment(shard, number, first, names, lengths, ids)

    order = F.col("doc_id").asc_nulls_last()
    id_and_text(docs, id_col, text_col).repartitionByRange(order).sortWithinPartitions(order).mapInArrow(run, FILE).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The segments of token-id files, each with ``start``: ids of all segments before it."""
    files = spark.read.schema(FILE).parquet(path)
    sums = files.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each shard
    return files.join(F.broadcast(starts), "shard").withColumn("start", F.col("base") + F.col("first")).drop("base", "first")


def document_digests(segments: DataFrame) -> DataFrame:
    """One row per document of decoded segments: doc_id, start, n_tokens, ids_crc32."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], dtype="<u8")
                ids = b"".join(block.astype("<u4").tobytes() for block in blocks(words, row["offsets"]))
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crcs = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["start"]), pa.array(lengths), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("doc_ids", "lengths", "offsets", "words", "start").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes the token-id files to the shared folder and returns what they hold, by document."""
    path = scratch_path(docs.sparkSession, "token-shards")
    write_shards(docs, path, tokenizer_path, end_id)
    return document_digests(read_shards(docs.sparkSession, path))
