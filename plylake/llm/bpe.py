"""Byte-level BPE as a finite-state transducer, determinised as texts need it; streaming decode.

A BPE encoding is the one sequence of tokens that spells the text and in which every two neighbours are *stable*: no
merge across their border comes up while the two are built from bytes.  That makes encoding a regular relation: a
non-deterministic transducer reads bytes of a token, and emits the token where it ends if it is stable after the last
one.  ``Transducer`` determinises it lazily: a state is the set of open hypotheses (last emitted token, tokens held
back, bytes of the unfinished token), a step reads one byte, drops hypotheses that no token continues, and emits what
all that are left agree on.  A hypothesis is at most the longest token behind, so output lags by a bounded number of
bytes.  States, steps and whole pieces are kept in tables of bounded size that are emptied when full.

Each match of the split pattern runs by itself.  Decoding feeds ids in blocks to an incremental UTF-8 state machine that
holds back at most three bytes of an unfinished character.

Defined results: a null text is the empty text (no ids, SHA-256 of no bytes); repeated rows give repeated results; an
empty table gives no rows; bytes that are not UTF-8 raise when a stream is closed or contradicted.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plylake.llm.common import dealt, id_and_text, kept_in_worker, lots

#: A space beside other white space; such texts are split by the pattern alone.
_RUNS = re.compile(r" (?:(?<=\s )|(?=\s))").search
#: The same in bytes: ASCII white space, and the first two bytes of longer characters some of which are white space.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_WIDE = np.zeros(1 << 16, bool)
_WIDE[[0xE19A, 0xE280, 0xE281, 0xE380]] = True
#: Bytes of text that are cut and looked up together.
TOGETHER = 1 << 22
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
# Code points that the ``regex`` module's tables call letters or numbers and the library's older ones (Unicode 16) do not.
NEWER = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24
1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F
2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
_NEWER = re.compile("[" + "".join("-".join(chr(int(end, 16)) for end in part.split("-")) for part in NEWER.split()) + "]")


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a rank file (base64 and rank on each line)."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Merges:
    """How each token is put together, and which two tokens are stable side by side."""

    def __init__(self, tokens: list[bytes], max_pairs: int = 150_000) -> None:
        self.tokens, self.max_pairs = tokens, max_pairs
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.inner = {b: b for b in {t[:n] for t in self.rank for n in range(1, len(t))}}  # what a longer token begins with
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._stable: dict[tuple[int, int], bool] = {}

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one: its bytes merged by lower ranks only."""
        parts = [bytes([b]) for b in self.tokens[token]]
        while len(parts) > 2:
            ranked = [(self.rank.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, at = min(ranked)
            if best >= token:
                raise ValueError(f"token {token} is not a merge of two lower ones")
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """(symbol, rank of the merge that ends it) along one edge of the token, the token itself first."""
        known = self._right if right else self._left
        if token not in known:
            line, ends, now = [], len(self.tokens), token
            while True:
                line.append((now, ends))
                if len(self.tokens[now]) == 1:
                    break
                now, ends = self.halves(now)[right], now
            known[token] = line
        return known[token]

    def stable(self, first: int, second: int) -> bool:
        """No merge joins the two: of each pair of edge symbols that stand side by side at some time, the merge comes
        too late.  At equal rank the merge further left goes first."""
        key = (first, second)
        found = self._stable.get(key)
        if found is None:
            if len(self._stable) > self.max_pairs:
                self._stable.clear()
            found = True
            for a, a_ends in self.edge(first, True):
                for b, b_ends in self.edge(second, False):
                    joined = self.rank.get(self.tokens[a] + self.tokens[b])
                    if joined is not None and joined < a_ends and joined <= b_ends:
                        found = False
            self._stable[key] = found
        return found


class Transducer:
    """Encodes one piece at a time."""

    def __init__(self, tokens: list[bytes], max_steps: int = 450_000) -> None:
        self.merges = Merges(tokens, max(150_000, max_steps // 3))
        self.max_steps = max_steps
        self._reset()

    def _reset(self) -> None:
        start = ((None, (), b""),)
        self.states: list[tuple] = [start]
        self.number = {start: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Next state and emitted tokens: the subset construction for one byte."""
        merges, added, after = self.merges, bytes((byte,)), []
        rank, inner, stable = merges.rank.get, merges.inner.get, merges.stable
        for last, held, open_bytes in self.states[state]:
            grown = open_bytes + added
            token = rank(grown)
            if token is not None:
                before = held[-1] if held else last
                if before is None or stable(before, token):
                    after.append((None, (*held, token), b""))  # the last emitted token only matters to those that hold back none
            kept = inner(grown)  # one copy for all states
            if kept is not None:
                after.append((last, held, kept))
        agreed = after[0][1]
        n = len(agreed)
        for _, held, _ in after:
            if not n:
                break
            while held[:n] != agreed[:n]:
                n -= 1
        if n:
            emitted = agreed[:n]
            nxt = tuple([(None if len(held) > n else emitted[-1], held[n:], open_bytes) for _, held, open_bytes in after])
        else:
            emitted, nxt = (), tuple(after)
        number = self.number.setdefault(nxt, len(self.states))
        if number == len(self.states):
            self.states.append(nxt)
        return number, emitted

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        if len(self.steps) > self.max_steps:
            self._reset()
        ids, state, steps = [], 0, self.steps
        for byte in piece:
            step = steps.get(state << 8 | byte)
            if step is None:
                step = steps[state << 8 | byte] = self._step(state, byte)
            state, emitted = step
            if emitted:
                ids.extend(emitted)
        ids.extend(next((held for _, held, open_bytes in self.states[state] if not open_bytes), ()))
        return ids


def packed_ids(ids: list[int]) -> bytes:
    """The ids as little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Generations(dict):
    """Memo of ``make`` in two generations of at most ``limit`` entries each; keys over ``longest`` are not kept."""

    def __init__(self, make: Callable[[str], bytes], limit: int = 150_000, longest: int = 64) -> None:
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value

    def lacks(self, keys: Iterable[str]) -> Iterator[str]:
        """Those keys that are in neither generation; a set's difference would walk through the tables instead."""
        return filterfalse(self.older.__contains__, filterfalse(self.__contains__, keys))

    def put_all(self, values: dict[str, bytes]) -> None:
        """As ``put``, with more than ``limit`` entries at most until the next call."""
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self.update(values if max(map(len, values), default=0) <= self.longest else {k: v for k, v in values.items() if len(k) <= self.longest})


    def get_all(self, keys: list[str], make_all: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
        """The values of distinct keys; ``make_all`` gives those of the new ones, and none is dropped before it is used."""
        found = list(map(self.get, keys))
        rest = [at for at, value in enumerate(found) if value is None]
        more = {key: self.older[key] for key in (keys[at] for at in rest) if key in self.older}
        more |= make_all([keys[at] for at in rest if keys[at] not in more])
        for at in rest:
            found[at] = more[keys[at]]
        self.put_all(more)
        return found


class Utf8Stream:
    """Decodes bytes that come in blocks; state: the bytes of an unfinished character."""

    def __init__(self) -> None:
        self.rest = b""

    @staticmethod
    def _open_tail(data: bytes) -> int:
        """How many of the last bytes begin a character that is not finished."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                need = 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        cut = len(data) - self._open_tail(data)
        self.rest = data[cut:]
        return data[:cut].decode()

    def close(self) -> None:
        if self.rest:
            raise ValueError("the ids end within a character")


def decode(tokens: list[bytes] | pa.Array, ids: np.ndarray, block: int = 65_536) -> Iterator[str]:
    """The text of the ids, block by block."""
    stream, tokens = Utf8Stream(), tokens if isinstance(tokens, pa.Array) else pa.array(tokens, pa.large_binary())
    for at in range(0, len(ids), block):
        yield stream.feed((tokens.take(pa.array(ids[at:at + block])).buffers()[2] or b"").to_pybytes())
    stream.close()


def _single_spaces(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where spaces stand that have no other white space beside them within their text (nor, to be brief, some other marks)."""
    text = np.concatenate((data, np.zeros(2, np.uint8)))
    at = np.flatnonzero(data == 32)
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    first, last = edge[at], edge[at + 1]
    bad = (_WHITE[text[at - 1]] & ~first) | (_WHITE[text[at + 1]] & ~last)
    wide = np.flatnonzero((text[at - 1] > 127) & ~first)  # a character of two bytes is white space only from C2 on
    one, two, three = (text[at[wide] - back] for back in (1, 2, 3))
    bad[wide] |= np.where(two > 0xBF, two == 0xC2, _WIDE[three.astype(np.uint16) << 8 | two])
    wide = np.flatnonzero((text[at + 1] > 127) & ~last)
    one, two = (text[at[wide] + ahead] for ahead in (1, 2))
    bad[wide] |= (one == 0xC2) | _WIDE[one.astype(np.uint16) << 8 | two]
    return at[~bad]


class Codec:
    """Encoder and decoder of whole texts for one vocabulary and split pattern.

    With ``by_space`` (true for patterns that never match across the start of a single space between two other
    characters) texts are first cut there; a cut-off part is encoded once and remembered.  Many texts are cut at once, and
    each distinct part of them is looked up once.
    """

    def __init__(self, tokens: list[bytes], pattern: str, by_space: bool = True, tables: int = 150_000) -> None:
        matcher = regex.compile(pattern)
        self.tokens, self.split, self.find, self.by_space = tokens, matcher.findall, matcher.finditer, by_space
        self.transducer = Transducer(tokens, 3 * tables)
        self.pieces = Generations(lambda p: packed_ids(self.transducer.encode(p.encode())), tables)
        self.parts = Generations(self._split, tables)
        self.spelled = pa.array(tokens, pa.large_binary())

    def _split(self, text: str) -> bytes:
        if not text.isascii() and _NEWER.search(text):  # split as if a symbol stood at each of them
            parts = (text[m.start():m.end()] for m in self.find(_NEWER.sub("\N{SNOWMAN}", text)))
            return b"".join(map(self.pieces.__getitem__, parts))
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not self.by_space or _RUNS(text):
            return self._split(text)
        first, *parts = text.split(" ")
        return self._split(first) + b"".join([self.parts[" " + part] for part in parts])

    def packed_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The same of many texts."""
        if not self.by_space:
            yield from (self._split(text.as_py()) for text in texts)
            return
        for lot in lots(texts, TOGETHER):
            ends = np.frombuffer(lot.buffers()[1], np.int32)[lot.offset:lot.offset + len(lot) + 1]
            text = lot.buffers()[2][int(ends[0]):int(ends[-1])] if ends[-1] else pa.py_buffer(b"")
            ends = ends - ends[0]
            data = np.frombuffer(text, np.uint8)
            cuts = np.union1d(_single_spaces(data, ends), ends).astype(np.int32)
            parts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), text)
            yield from dealt(parts, np.searchsorted(cuts, ends), self._found)

    def _found(self, parts: list[str]) -> list[bytes]:
        return self.parts.get_all(parts, lambda new: dict(zip(new, map(self._split, new))))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()

    def digests(self, packed: bytes) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the packed ids, SHA-256 of the text decoded from them)."""
        back = hashlib.sha256()
        for part in decode(self.spelled, np.frombuffer(packed, dtype="<u4")):
            back.update(part.encode())
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), back.hexdigest()


def codec(tokens: list[bytes], pattern: str, tables: int = 150_000) -> Codec:
    """The worker's codec, kept between tasks."""
    key = ("bpe", hash(tuple(tokens[-256:])) ^ len(tokens), pattern, tables)
    return kept_in_worker(key, lambda: Codec(tokens, pattern, tables=tables))


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", tables: int = 300_000,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The rank file is read once on the driver and sent to the workers; its size does not depend on the data.  ``tables``
    bounds what a worker remembers (its memory and speed, never the result).
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern, tables)
        for batch in batches:
            found = list(map(own.digests, own.packed_all(batch.column("text"))))
            columns = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.string(), pa.string())))]
            if found:
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, OUT)


def token_ids(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            ids = pa.array([np.frombuffer(p, dtype="<i4") for p in own.packed_all(batch.column("text"))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")
