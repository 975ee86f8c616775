"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

A text's subwords are the 2, 3 and 4 byte runs of its lower-cased UTF-8 that have white space at most at their ends,
hashed to 2^15 buckets.  The text's vector is the mean of its subwords' embeddings; a linear softmax over it gives the
languages.  Embeddings and softmax are trained by stochastic gradient descent in numpy, on the driver, over bucket
counts of a bounded sample: ``per_lang`` documents of each language (smallest id hashes).  Every fourth of them is held back
to fit the softmax's temperature.

A document is rejected by either of two measures.  Its margin is the log-odds of the best language: a text between
languages has a small one.  Its fit is the mean log-likelihood of its subwords in the best language (shares of buckets in
that language's learned documents, a tenth of the mass spread evenly): a language that was not learned, or random letters, fits none.
Both cuts are calibrated on all labelled documents that nothing was learned from (and those held back), save the held-out
fold: Spark counts both measures in steps of 1/1000, and the driver gets a count for each step, so many as the model's
scores can reach, whatever the input.  The lower tail beyond a tenth is taken as exponential, and the cut is where ``miss``
of documents of learned languages lie below.  Too few documents to measure ``miss`` by counting thus give a lower cut, not
a higher one.

Prediction reads whole texts.  As everything after the hashing is linear, a worker only sums one row of language
scores for each subword.

Defined results: a null text, and one without a letter, is ``und`` with score 0 and is rejected; so is every text if no
document has a label; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plylake.llm.common import drop_kept

BUCKETS = 1 << 15
WIDTH = 16
OUT = "doc_id long, lang_pred string, score double, rejected boolean"
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket occurs in a text."""
    data = np.frombuffer(f" {text} ".lower().encode(), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), 1 << 20):  # blocks that overlap by a run, for bounded memory
        block, found = data[at:at + (1 << 20) + 3], []
        space, code = _SPACE[block], np.where(_SPACE[block], 32, block).astype(np.uint32)
        for n in (2, 3, 4):
            m = min(len(block) - n + 1, 1 << 20)
            if m <= 0:
                continue
            mixed = np.full(m, n, np.uint32)
            for i in range(n):
                mixed = (mixed ^ code[i:i + m]) * np.uint32(0x01000193)
            mixed = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
            if n > 2:
                inner = space[1:m + 1] | space[n - 2:n - 2 + m]
                mixed = mixed[~inner]
            found.append(mixed)
        if found:
            counts += np.bincount(np.concatenate(found), minlength=BUCKETS)
    return counts


class Model:
    """Language scores and log-likelihoods by bucket, biases, temperature and the cuts of the two measures."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, chances: np.ndarray, heat: float = 1.0) -> None:
        self.langs, self.table, self.bias, self.chances, self.heat = langs, table, bias, chances, heat
        self.least_margin, self.least_fit = -np.inf, np.full(len(langs), -np.inf)

    def measure(self, counts: np.ndarray) -> tuple[int, float, float, float]:
        """(best language, its probability, its log-odds, how well the subwords fit it)."""
        at = np.flatnonzero(counts)
        share = counts[at] / max(counts.sum(), 1)
        z = (share @ self.table[at] + self.bias) / self.heat
        best = int(z.argmax())
        rest = np.delete(z, best)
        margin = float(z[best] - np.logaddexp.reduce(rest)) if len(rest) else np.inf
        return best, float(_softmax(z)[best]), margin, float(share @ self.chances[at, best])

    def judge(self, counts: np.ndarray) -> tuple[str, float, bool]:
        """(language, score, whether the text is rejected)."""
        best, score, margin, fit_ = self.measure(counts)
        return self.langs[best], score, bool(margin < self.least_margin or fit_ < self.least_fit[best])


def tail_cut(values: np.ndarray, miss: float, tail: float = 0.1, times: np.ndarray | None = None) -> float:
    """The value below which a share of ``miss`` lies, the values under their ``tail`` quantile taken as exponential.

    ``times``: how often each value is there (once).
    """
    times = np.ones(len(values), np.int64) if times is None else times
    there = np.isfinite(values) & (times > 0)
    values, times = values[there], times[there]
    if not len(values):
        return -np.inf
    order = np.argsort(values, kind="stable")
    values, times = values[order], times[order]
    ends = np.cumsum(times)
    place = (int(ends[-1]) - 1) * tail  # the quantile lies between the values at the places around it
    low, high = (float(values[np.searchsorted(ends, at, "right")]) for at in (math.floor(place), math.ceil(place)))
    start = low + (high - low) * (place - math.floor(place))
    below = values < start
    return start - float(np.average(start - values[below], weights=times[below])) * float(np.log(tail / miss)) if below.any() else start


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 2.0, seed: int = 7) -> tuple[Model, list[int]] | None:
    """A model from (lang, buckets, counts) of the sample, and the rows that were held back; None without rows."""
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    back = {int(i) for i in order[::4]} if len(rows) >= 8 else set()
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    linear, bias = rng.normal(0, 0.1, (WIDTH, len(langs))), np.zeros(len(langs))
    learned = [int(i) for i in order if int(i) not in back]
    total = epochs * len(learned)
    turns = np.concatenate([rng.permutation(learned) for _ in range(epochs)])
    for step, turn in enumerate(turns):
        lang, at, n = rows[int(turn)]
        if not len(at):
            continue
        share = n / n.sum()
        mean = share @ embed[at]
        wrong = _softmax(mean @ linear + bias)
        wrong[langs.index(lang)] -= 1
        now = rate * (1 - step / total)
        embed[at] -= now * np.outer(share, linear @ wrong) * min(len(at), 200)
        linear -= now * 0.1 * np.outer(mean, wrong)
        bias -= now * 0.01 * wrong
    chances = np.zeros((BUCKETS, len(langs)))
    for i in learned:
        lang, at, n = rows[i]
        chances[at, langs.index(lang)] += n / max(n.sum(), 1)
    chances = np.log(0.9 * chances / np.maximum(chances.sum(axis=0), 1) + 0.1 / BUCKETS)
    model = Model(langs, embed @ linear, bias, chances)
    logits, truth = [], []
    for i in sorted(back):
        lang, at, n = rows[i]
        logits.append(n @ model.table[at] / max(n.sum(), 1) + bias)
        truth.append(langs.index(lang))
    if logits:
        z, y = np.array(logits), np.array(truth)
        heats = np.geomspace(0.05, 20, 60)
        model.heat = float(min(heats, key=lambda h: -np.log(_softmax(z / h)[np.arange(len(y)), y] + 1e-12).mean()))
    return model, sorted(back)


#: Steps of a measure that are counted apart, to a unit.
STEPS = 1000


def counted(best: np.ndarray, margin: np.ndarray, fits: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(0 for margins or 1 for fits, best language, step, documents) of some documents' finite measures."""
    out = []
    for which, values in enumerate((margin, fits)):
        there = np.isfinite(values)
        pairs = np.column_stack([best[there], np.floor(values[there] * STEPS).astype(np.int64)])
        rows, n = np.unique(pairs, axis=0, return_counts=True)
        out += [(which, int(k), int(step), int(c)) for (k, step), c in zip(rows, n)]
    return out


def calibrate(model: Model, steps: list[tuple[int, int, int, int]], miss: float = 0.001) -> None:
    """Sets the cuts from the counts (see ``counted``) of documents that nothing was learned from; half of ``miss`` for each measure."""
    which, best, step, times = np.array(steps, np.int64).reshape(-1, 4).T
    values, fits = step / STEPS, which == 1
    model.least_margin = tail_cut(values[~fits], miss / 2, times=times[~fits])
    for k in range(len(model.langs)):
        own = fits & (best == k)
        own = own if times[own].sum() >= 20 else fits
        model.least_fit[k] = tail_cut(values[own], miss / 2, times=times[own])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether an id belongs to the fold that is never learned from; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, per_lang: int = 250, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", miss: float = 0.001,
) -> Model | None:
    """Fits a model on ``per_lang`` labelled documents of each language outside the held-out fold, calibrated on all others there."""
    dice = F.xxhash64(F.col(id_col).cast("long"))
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    ranked = labelled.select(F.col(lang_col).cast("string").alias("lang"), dice.alias("dice")).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang").orderBy("dice"))
    )
    ends = ranked.where(F.col("place") <= per_lang).groupBy("lang").agg(F.max("dice").alias("last"))  # a row for each language
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), dice.alias("dice"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(ends), "lang")
    picked = rows.where("dice <= last").select("lang", "dice", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            out: list[tuple] = []
            for lang, dice, text in zip(*(batch.column(n).to_pylist() for n in ("lang", "dice", "text"))):
                counts = subword_counts(text)
                at = np.flatnonzero(counts)
                out.append((lang, dice, at.astype("<i4").tobytes(), counts[at].astype("<i8").tobytes()))
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "dice", "at", "n"])

    found = picked.mapInArrow(run, "lang string, dice long, at binary, n binary").orderBy("lang", "dice", "at").collect()
    seen: dict[str, int] = {}
    sample = []
    for r in found:
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= per_lang:
            sample.append((r["lang"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i8").astype(float)))
    made = fit(sample)
    if made is None:
        return None
    model, back = made
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        own = shared.value
        for batch in batches:
            found = [own.measure(subword_counts(t.as_py())) for t in batch.column("text") if has_letter(t.as_py())]
            if found:
                best, _, margin, fits = (np.array(c) for c in zip(*found))
                columns = zip(*counted(best, margin, fits))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["which", "best", "step", "n"])

    further = rows.where("dice > last").select("text").mapInArrow(measure, "which long, best long, step long, n long")
    measured = [tuple(r) for r in further.groupBy("which", "best", "step").agg(F.sum("n")).collect()]
    for i in back:
        _, at, n = sample[i]
        counts = np.bincount(at, n, BUCKETS)
        if counts.any():
            best, _, margin, fits = model.measure(counts)
            measured += counted(np.array([best]), np.array([margin]), np.array([fits]))
    calibrate(model, measured, miss)
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, rejected; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        own = shared.value
        for batch in batches:
            langs, scores, gone = [], [], []
            for text in batch.column("text"):
                lang, score, out = judge(own, text.as_py())
                langs.append(lang)
                scores.append(score)
                gone.append(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gone, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(run, OUT)


_LETTER = re.compile(r"[^\W\d_]").search


def has_letter(text: str) -> bool:
    return bool(_LETTER(text)) or any(c.isalpha() for c in text)


def judge(model: Model | None, text: str | None) -> tuple[str, float, bool]:
    """(language or ``und``, score, rejected) of one text."""
    if model is None or text is None or not has_letter(text):
        return "und", 0.0, True
    return model.judge(subword_counts(text))


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; only texts go to the Python workers, and flags come back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_kept()
        own = shared.value
        for batch in batches:
            yield pa.array([not judge(own, t.as_py())[2] for t in batch], pa.bool_())

    return docs.where(known(F.col(text_col)))
