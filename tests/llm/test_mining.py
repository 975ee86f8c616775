"""Collocations, vector near-dedup and the prefix trie against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plylake.llm import collocations, prefix_trie, vector_dedup

# ---- collocations


def plain_collocations(rows, support, top):
    """Straight from the definition: every phrase of every text is counted."""
    counts, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    frequent = {key: f for key, f in counts.items() if f >= support and len(key[1]) > 1}
    out = []
    for (lang, phrase), a in frequent.items():
        inside = any(
            other == lang and len(longer) > len(phrase) and f >= a
            and any(longer[i:i + len(phrase)] == phrase for i in range(len(longer)))
            for (other, longer), f in frequent.items()
        )
        if not inside:
            cuts = [
                (1000 * a * total[lang] // (counts[lang, phrase[:k]] * counts[lang, phrase[k:]]), k, counts[lang, phrase[:k]], counts[lang, phrase[k:]])
                for k in range(1, len(phrase))
            ]
            score, _, left, right = min(cuts)
            out.append((lang, -score, -a, " ".join(phrase).encode(), left, right))
    out.sort()
    ranks = collections.Counter()
    result = []
    for lang, score, a, phrase, left, right in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.append((lang, ranks[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return result


def collocation_rows(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, lang, 1) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, n long")
    found = collocations.collocations(docs.repartition(3), **options).collect()
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found)


@pytest.mark.parametrize("shard_words", [40, 10_000])
def test_collocations_match_the_definition(spark, shard_words):
    dice = random.Random(4)
    words = ["A", "b", "c,", "é", "Ünd", "x.y", "d\te", "f\x0bg", "日本", "b\r\nc"]
    rows = [(" ".join(dice.choices(words, [9, 7, 3, 2, 1, 1, 1, 1, 1, 1], k=dice.randint(0, 60))), dice.choice(["en", "de", None, "und"])) for _ in range(60)]
    rows += [(None, "en"), ("", "en"), (" \t ", None), ("a " * 300, "en"), ("the quick brown fox jumps " * 9, "de")] * 2
    assert collocation_rows(spark, rows, support=6, top=15, shard_words=shard_words) == sorted(plain_collocations(rows, 6, 15))


def test_collocations_of_long_texts_and_words(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PIECE", 64)  # texts are cut into pieces of words; phrases reach over the cuts
    numbers = collocations.Words()
    text = b"One two three four five. " * 50 + b"w" * 1000 + b" end"
    ids = np.concatenate(numbers.of_text(text))
    spelled = list(numbers)
    pieces = b" ".join(spelled[i] for i in ids).split(b"\n")
    assert [p.strip() for p in pieces if p.strip()] == [b"one two three four five"] * 50 + [b"w" * 1000 + b" end"]
    long = "x" * 200_000
    rows = [(f"{long} tail", "en")] * 3
    assert [r[2:4] for r in collocation_rows(spark, rows, support=3)] == [(f"{long} tail", 3)]


def test_collocations_of_an_empty_table(spark):
    assert collocation_rows(spark, [], support=2) == []
    assert collocation_rows(spark, [(None, None), ("", "en")], support=2) == []


def test_what_a_shard_holds_back_is_within_its_allowance():
    """Every frequent phrase is kept however its occurrences lie in shards."""
    dice = random.Random(1)
    for _ in range(200):
        support, sizes = dice.randint(1, 120), [dice.randint(1, 1000) for _ in range(dice.randint(1, 60))]
        allowed = [support * b // (2 * sum(sizes)) for b in sizes]
        counts = [a + dice.choice([0, 0, 0, 1, 2, 9]) for a in allowed]
        beyond = sum(c - a for c, a in zip(counts, allowed) if c > a)
        assert sum(counts) < support or 2 * beyond >= support


def test_shards_hold_nothing_back_and_reports_grow_with_them():
    """Sums of the reports are exact counts, however many shards there are; equal shards report equally many rows."""
    text = "a b c a b d, " * 30 + "rare pair"
    words, pairs = collections.Counter(), collections.Counter()
    for piece in text.split(","):
        words.update(piece.split())
        pairs.update(zip(piece.split(), piece.split()[1:]))
    known = collocations.BitMap()
    known.bits[:] = 255
    for lengths, exact in ((range(1, 2), words), (range(2, 3), {" ".join(p): f for p, f in pairs.items()})):
        for n in (1, 2, 50):
            batch = pa.RecordBatch.from_pylist([{"lang": "en", "text": text}] * n)
            rows = [r for b in collocations.reports([batch], lambda: known, lengths, 1) for r in b.to_pylist() if r["phrase"]]
            sums = collections.Counter()
            for r in rows:
                sums[r["phrase"]] += r["f"]
            assert sums == {p: n * f for p, f in exact.items()} and len(rows) == n * len(exact)


def test_a_phrase_spread_thin_over_many_shards(spark):
    rows = [(f"w{i} thin ice x{i}", "en") for i in range(60)]
    assert collocation_rows(spark, rows, support=60, shard_words=1) == [("en", 1, "thin ice", 60, 60, 60, 240, 4000)]


# ---- vectors


def plain_links(rows, cosine=0.98):
    links = collections.defaultdict(set)
    usable = []
    for i, (_, vec, label) in enumerate(rows):
        ok = label is not None and vec and all(x is not None and math.isfinite(x) for x in vec) and any(vec)
        usable.append(np.array(vec, float) / max(abs(x) for x in vec) if ok else None)
    for i, a in enumerate(usable):
        for j, b in enumerate(usable[:i]):
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2]:
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    seen, component = set(), {}
    for i in range(len(rows)):
        if i not in seen:
            group, todo = set(), [i]
            while todo:
                at = todo.pop()
                if at not in group:
                    group.add(at)
                    todo += links[at]
            seen |= group
            names = [rows[j][0] for j in group if rows[j][0] is not None]
            for j in group:
                component[j] = min(names, default=None)
    return sorted(((rows[i][0], len(links[i]), component[i], rows[i][0] == component[i]) for i in range(len(rows))), key=repr)


def vector_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, item string")
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(df).collect()), key=repr)


def test_vectors_at_borders_and_in_balls(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CHUNK", 30)
    monkeypatch.setattr(vector_dedup, "CELL", 40)
    dice = np.random.default_rng(2)
    free = dice.normal(size=(400, 3))
    tight = dice.normal(size=8) + dice.normal(size=(250, 8)) * 0.02
    loose = dice.normal(size=8) + dice.normal(size=(150, 8)) * 0.1
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(free)]
    rows += [(1000 + i, x.tolist(), 7) for i, x in enumerate(np.concatenate([tight, loose, tight[:40]]))]
    assert vector_rows(spark, rows) == plain_links(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [-0.0, 5.0], 3), (13, [0.0, 5.0], 3),
        (14, [1e200, 1e200], 4), (15, [1e-200, 1e-200], 4), (2, [0.0, 1.0], 1), (None, [1.0, 0.001], 1), (None, [3.0, -7.0], 9), (3, [1.0, 0.0], 2),
    ]
    assert vector_rows(spark, rows) == plain_links(rows)
    assert vector_rows(spark, []) == []
    assert vector_rows(spark, [(5, None, 1)]) == [(5, 0, 5, True)]


def test_kmeans_is_spherical_and_bounded():
    rows = np.random.default_rng(0).normal(size=(500, 5))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    centroids = vector_dedup.spherical_kmeans(rows, 12)
    assert len(centroids) <= 12 and np.allclose(np.linalg.norm(centroids, axis=1), 1)
    assert len(vector_dedup.spherical_kmeans(rows[:1].repeat(50, axis=0), 12)) == 1


# ---- the trie


def plain_trie(rows, block=20, heads=4):
    conv = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append(((0, 0) if t is None else (1, t), r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    for c in conv:
        conv[c].sort(key=lambda y: y[:3])
    full = {}
    for c in list(conv):
        h, base = zlib.crc32(str(c).encode()) % heads, c - int(math.fmod(c, block))
        full[c] = [(y[1], y[3]) for y in conv.get(base, [])[:h] + conv[c][h:]]
    nodes, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    out, leaves, saved = [], {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = own + sum(saved[q] for q in kids[k])
        leaves[k] = sum(leaves[q] for q in kids[k]) or 1
        ends = ",".join(str(c) for c in sorted(c for c in nodes[k] if len(full[c]) == len(k)))
        parent = min(nodes[k[:-1]]) if k else None
        out.append((min(nodes[k]), len(k), parent, len(nodes[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie_rows(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth long")
    found = prefix_trie.prefix_trie(df.repartition(5), **options).collect()
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found)


def test_trie_matches_plain_python(spark):
    dice = random.Random(3)
    rows = []
    for c in [*range(0, 130), 400, 401, 405, 1003, -3, -20, -25]:
        for t in range(dice.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, dice.choice(["user", "assistant"]), dice.choice(["hi there", "a b c", "x", ""])))
    rows += [(64, t, "user", f"turn {t // 3}") for t in range(20, 420)] + [(84, t, "user", f"turn {t // 3}") for t in range(20, 420)]
    rows += [(7, None, None, None), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (7, 2, "bot", "tie"), (None, 1, "user", "nobody")]
    dice.shuffle(rows)
    assert trie_rows(spark, rows) == plain_trie(rows)
    assert trie_rows(spark, rows, shard_nodes=7) == plain_trie(rows)  # paths are cut, totals cross many shards


def test_trie_of_equal_and_empty_conversations(spark):
    rows = [(c, t, "user", "same words here") for c in range(20, 90) for t in range(3)]
    assert trie_rows(spark, rows, shard_nodes=1) == plain_trie(rows)
    assert trie_rows(spark, []) == []
    lonely = [(41, 0, "user", "a"), (43, 0, None, None)]  # no conversation 40: what crc32 takes from it is nothing
    assert trie_rows(spark, lonely) == plain_trie(lonely)


def test_hot_node_is_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_A_PIECE", 7)
    rows = [(c, 0, "user", "x") for c in range(500)]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_queue_spills_and_keeps_order():
    dice = random.Random(5)
    queue, kept = prefix_trie.SpillingQueue(most=10), []
    for _ in range(3000):
        if dice.random() < 0.6 or not kept:
            item = (dice.randint(0, 50), dice.randint(0, 5), dice.randint(0, 9), 1)
            queue.push(item)
            kept.append(item)
        else:
            kept.sort()
            assert queue.first() == kept[0] and queue.pop() == kept.pop(0)
    assert queue.spilled > 10
    assert [queue.pop() for _ in range(len(kept))] == sorted(kept) and queue.first() is None


def test_running_sums_over_ranges(spark):
    df = spark.range(300).select((F.col("id") % 3 == 0).cast("long").alias("key"), "id", (F.col("id") * 7 % 11).alias("v"))
    rows = prefix_trie.running_within(df.repartition(6), "key", [F.asc("id")], ["v"], "t").collect()
    for key in (0, 1):
        mine = sorted((r for r in rows if r.key == key), key=lambda r: r.id)
        assert [r.place for r in mine] == list(range(len(mine)))
        assert [r.before_v for r in mine] == [sum(x.v for x in mine[:i]) for i in range(len(mine))]
