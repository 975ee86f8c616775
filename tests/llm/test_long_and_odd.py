"""Texts that are long in one respect, and letters that change under normalisation."""

from __future__ import annotations

import collections
import math
import random
import re
import time

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from plylake.llm import secret_scan, token_shards


@pytest.mark.parametrize(
    ("text", "n_base"),
    [
        ("a-" * 20_000, 0), ("A_" * 20_000, 0), ("Ab3x9Kq+" * 131_072, 0), ("token=abcdefgh1 " * 100_000, 100_000),
        (("0123456789abcdef" * 2 + " ") * 30_000, 30_000), ("token=abcdefgh1 Zx9Qw8Er7Ty6Ui5Op4As3 " * 20_000, 20_000),
    ],
)
def test_secret_scan_of_long_texts_is_linear(spark, text, n_base):
    docs = spark.createDataFrame([(1, text), (2, "password = hunter2hunter2 and some ordinary words")], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in secret_scan.scan(docs).selectExpr("doc_id", "size(base) AS n", "base_line").collect()}
    assert rows[1].n == n_base and rows[2].base_line == "assign:0:25"
    assert time.time() - began < 120  # a quadratic walk takes many minutes


def plain_markov(texts, margin):
    """Markov spans from the definition, with models of all texts."""
    base = re.compile(secret_scan.ANY_BASE.replace("(?i)", "", 1), re.I)
    hits, ordinary = [], []
    spans = []
    for text in texts:
        found = []
        for kind, pattern, group, least in ((0, secret_scan.ASSIGN, 2, 8), (1, secret_scan.ACCESS, 0, 1), (2, secret_scan.HEX, 0, 1)):
            pattern, flags = (pattern.replace("(?i)", ""), re.I) if kind == 0 else (pattern, 0)
            for m in re.finditer(pattern, text, flags):
                if len(m[group]) >= least:
                    found.append((m.start(), kind, m.end(), m[group]))
        spans.append(sorted(found))
        hits += [s[3] for s in found]
        ordinary += re.findall(r"(?<![A-Za-z0-9+/_=-])(?:[A-Z]?[a-z]+(?:[_-][a-z]+)*|[A-Z]+(?:_[A-Z]+)*|[0-9]+)(?![A-Za-z0-9+/_=-])", base.sub(" ", text))
    counts = collections.Counter()
    for is_random, strings in ((True, hits), (False, ordinary)):
        for s in strings:
            for a, b in zip(s, s[1:]):
                if a in secret_scan.SYMBOLS and b in secret_scan.SYMBOLS:
                    counts[is_random, a + b] += 1
    model = secret_scan.ratios(counts)
    n = len(secret_scan.SYMBOLS)
    out = []
    for text, found in zip(texts, spans):
        mine = []
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text):
            score = sum(model[secret_scan.SYMBOLS.index(a) * n + secret_scan.SYMBOLS.index(b)] for a, b in zip(m[0], m[0][1:]))
            if score >= margin and not any(s < m.end() and m.start() < e for s, _, e, _ in found):
                mine.append((m.start(), m.end()))
        out.append(mine)
    return out


def test_markov_spans_equal_plain_python(spark):
    dice = random.Random(8)
    key = lambda n: "".join(dice.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789", k=n))
    texts = []
    for i in range(120):
        parts = [dice.choice(["the quick", "MAX_SIZE", "snake_case_name", "1234", f"token = {key(24)}", key(30), f"SG.{key(22)}.{key(43)}", "café", "some-long-hyphenated-ordinary-words"]) for _ in range(dice.randint(0, 9))]
        texts.append(dice.choice([" ", "; ", "\n"]).join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(secret_scan.scan(docs).selectExpr("doc_id", "filter(spans, s -> s.kind = 3) AS m").collect())
    got = [[(s.start, s.end) for s in r.m] for r in rows]
    want = plain_markov(texts, 10.0)
    assert got == want and sum(map(len, want)) > 100


def test_dotted_keys_are_scored_part_by_part(spark):
    dice = random.Random(3)
    key = lambda n: "".join(dice.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789", k=n))
    rows = [(i, f"secret = {key(40)} and plain words about nothing in particular") for i in range(60)]
    dotted = f"SG.{key(22)}.{key(43)}"
    found = secret_scan.scan(spark.createDataFrame([*rows, (99, dotted)], "doc_id long, text string")).where("doc_id = 99").first()
    assert [(s.start, s.end) for s in found.spans] == [(3, 25), (26, 69)]


def test_random_model_learns_from_rare_secrets(spark):
    """One document in a thousand holds a secret, and the sample of all documents is smaller than that."""
    rows = [(i, f"ordinary words number {i}") for i in range(3000)] + [(10_000 + i, f"token = Qz{i}Xv9Kw7Yj2Rq8") for i in range(3)]
    counts = secret_scan.pair_counts(spark.createDataFrame(rows, "doc_id long, text string"), sample_docs=50)
    assert counts[True, "Xv"] == 3


def test_token_ids_equal_the_library_after_normalisation():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as source:
        definition = source.read()
    library, own = Tokenizer.from_str(definition), token_shards.WordEncoder(definition)
    changing = [c for c in map(chr, range(0x80, 0x30000)) if c.isalpha() and not library.normalizer.normalize_str(c).isalpha()]
    assert "İ" in changing and "ךּ" in changing
    dice = random.Random(2)
    texts = [f"{a}{c}{b}" for c in changing for a in ("", "a", "x ") for b in ("", "!", "^b", "y, z", "'s")]
    alphabet = "abzÉéßİıΣςﬁ̈́Å한글日本'<^>!.,-_ 09" + "".join(changing)
    texts += ["".join(dice.choices(alphabet, k=dice.randint(1, 12))) for _ in range(20_000)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert own.packed(texts) == want


def test_parts_share_one_bounded_table_and_equal_the_library():
    """A piece is a part that is not cut: one table holds both, and stays right when it is emptied all the time."""
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as source:
        definition = source.read()
    library, own, dice = Tokenizer.from_str(definition), token_shards.WordEncoder(definition, tables=300), random.Random(12)
    words = ["Word", "wOrd", "word", "ÉTÉ", "été", "naïve", "漢字", "H\u0331", "straße", "a1b2", "x-y", "<|endoftext|>", "it's", "a\u00a0b", "é\u2003é", "", "z" * 80, "ü" * 80]
    marks = [*"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "...", "\r", "\x0b", "\u0301", "…", "7"]
    texts = [f"{w}{m}{dice.choice(words)} {dice.choice(marks)}{w} {w}{m}" for w in words for m in marks]
    texts += [" ".join("".join(dice.choices("abcdeABCéÉ", k=5)) + dice.choice(["", ",", "."]) for _ in range(200)) for _ in range(20)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    got = [own.packed(texts[at:at + 7]) for at in range(0, len(texts), 7)]
    assert [ids for some in got for ids in some] == want == own.packed(texts)
    before = len(own.parts)
    own.packed(["brandnew brandnew, Brandnew"])
    assert own.parts["brandnew"] == own.parts["Brandnew"] and len(own.parts) <= max(before, 300) + 3


def test_each_distinct_plain_piece_is_looked_up_once(monkeypatch):
    """Case and marks make no new entries, Latin-1 included; texts cut and looked up in small lots give the library's ids."""
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as source:
        definition = source.read()
    library, own, dice = Tokenizer.from_str(definition), token_shards.WordEncoder(definition), random.Random(8)
    own.packed(["Été été, ÉTÉ!\tété", "", "(Word) word,WORD"])
    assert set(own.parts) == {"été", ",", "!", "(", "word", ")"}
    monkeypatch.setattr(token_shards, "TOGETHER", 300)
    monkeypatch.setattr(token_shards, "CUT", 100)
    own = token_shards.WordEncoder(definition, tables=20)
    alphabet = [chr(c) for c in range(256)] + [*"aàÀ×÷ßÿÞ \t\n\r,.'<1" * 9, "\u0301", "H\u0331", "\u0178", "\u3000", "漢", "<|endoftext|>"]
    texts = ["".join(dice.choices(alphabet, k=dice.choice((0, 1, 5, 400)))) for _ in range(1500)]
    assert own.packed(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert own.packed([]) == [] and own.packed(["", " "]) == [b"", b""]


def test_blocks_decode_by_themselves():
    dice = np.random.default_rng(4)
    ids = np.concatenate([dice.integers(0, 50_000, 40_000), dice.integers(0, 1 << 62, 3000), np.zeros(5000, np.int64)]).astype(np.uint64)
    words, offsets = token_shards.pack(ids)
    parts = list(token_shards.blocks(words, offsets.tolist()))
    assert len(parts) == len(offsets) > 10 and (np.concatenate(parts) == ids).all()
    assert (token_shards.unpack(words[offsets[3]:offsets[4]]) == parts[3]).all()
    assert math.isclose(sum(map(len, parts)), len(ids))
