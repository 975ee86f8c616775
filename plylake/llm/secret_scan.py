"""Secret scan: fixed patterns, and character Markov models for what they miss, in DataFrame functions only.

Spans of a pattern come from one split and one extraction of the same pattern: the gaps' and the matches' lengths give
the offsets, in code points.  Rows without a trace of a pattern skip both.  Further spans: a run of 20 or more token
characters is compared under two first-order models, random strings and ordinary identifiers, and is a span when its
log-likelihood ratio reaches ``margin`` and it touches no base span.

The models are character-pair counts of labelled samples: what the base patterns match is random, in at most
``sample_docs`` of the documents that have a match; words, joined words, capitals and numbers are ordinary, in at most
``sample_docs`` of all documents (those with the smallest id hashes).  So the random model does not thin out where secrets
are rare.  The driver holds one count for each pair of the 67 symbols, whatever the input.

Time is linear in a text's length: strings are split into characters once, and lists grow in chunks that are joined at the
end.  Patterns over long runs are possessive, as the regular expressions of the JVM go one call deeper for each turn of a
group that may be tried again.  Dots part runs, so each part of a dotted key is scored for itself.

Defined results: a null text is the empty text, without spans; without training strings of a class its model is
uniform; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plylake.llm.common import id_and_text

#: The three base patterns, the first two in forms that only match what is long enough.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_TRACE = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ASSIGN_LEAST = 8
#: Whether a text has any base span.
ANY_BASE = f"{ASSIGN[:-2]}{{{ASSIGN_LEAST},}})|{ACCESS}|{HEX}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Strings of the class "ordinary identifiers": words, words joined by _ or -, capitals, numbers.
ORDINARY = r"(?<![A-Za-z0-9+/_=-])(?:[A-Z]?[a-z]++(?:[_-][a-z]++)*+|[A-Z]++(?:_[A-Z]++)*+|[0-9]++)(?![A-Za-z0-9+/_=-])"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "markov")
#: Items that a list grows by before lists are joined.
CHUNK = 256
SPAN = "array<struct<start:bigint,kind:int,end:bigint,what:string>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value, which is worked out once however often it is used in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], close: Callable[[Column], Column]) -> Column:
    """The spans that ``step`` (carry, item) -> (carry, spans) and ``close`` (carry) -> spans give, in one list.

    The list grows within chunks of 256 items and over the chunks, so m items cost some 128 m copies and not m * m / 2.
    """
    none = F.array().cast(SPAN)

    def inner(state: Column, x: Column) -> Column:
        carry, new = step(state["carry"], x)
        return F.struct(carry.alias("carry"), F.concat(state["list"], new).alias("list"))

    def outer(state: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, F.struct(state["carry"].alias("carry"), none.alias("list")), inner)
        return _bound(done, lambda d: F.struct(d["carry"].alias("carry"), F.concat(state["lists"], F.array(d["list"])).alias("lists")))

    def chunks(all_items: Column) -> Column:
        last = F.floor((F.size(all_items) - 1) / CHUNK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(all_items, c * CHUNK + 1, CHUNK))
        begin = F.struct(start.alias("carry"), F.array().cast(f"array<{SPAN}>").alias("lists"))
        return F.aggregate(cut, begin, outer, lambda s: F.concat(F.flatten(s["lists"]), close(s["carry"])))

    return _bound(items, lambda x: F.when(F.size(x) > 0, chunks(x)).otherwise(none))


def _spans(text: Column, pattern: str, kind: int, trace: Column, group: int = 0, least: int = 1) -> Column:
    """Spans (start, kind, end, what) of the matches; ``what`` is the group, and is ``least`` characters or longer."""
    found, what = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), what.alias("what"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = (start + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("long")
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["what"].alias("what"))
        keep = x["hit"].isNotNull() & (F.length(x["what"]) >= least)
        return end, F.when(keep, F.array(one)).otherwise(F.array().cast(SPAN))

    none = F.array().cast(SPAN)
    return F.when(trace, _folded(steps, F.lit(0).cast("long"), step, lambda at: none)).otherwise(none)


def _apart(base: Column, runs: Column) -> Column:
    """The runs that overlap no base span: one walk over both, in order of start.

    The carry is how far the base spans reach and the last run, which the next base span may still overlap.
    """
    none = F.array().cast(SPAN)

    def step(carry: Column, x: Column) -> tuple[Column, Column]:
        is_run = x["kind"] == 3
        clash = F.exists(carry["open"], lambda r: x["start"] < r["end"])
        reach = F.when(is_run, carry["reach"]).otherwise(F.greatest(carry["reach"], x["end"]))
        now = F.when(is_run, F.when(carry["reach"] <= x["start"], F.array(x)).otherwise(none)).otherwise(F.when(clash, none).otherwise(carry["open"]))
        out = F.when(is_run, carry["open"]).otherwise(none)
        return F.struct(reach.alias("reach"), now.alias("open")), out

    begin = F.struct(F.lit(0).cast("long").alias("reach"), none.alias("open"))
    return _folded(F.array_sort(F.concat(base, runs)), begin, step, lambda carry: carry["open"])


def base_spans(text: Column) -> Column:
    """All base spans of a text, in order of start and kind."""
    return F.array_sort(
        F.concat(
            _spans(text, ASSIGN, 0, text.rlike(ASSIGN_TRACE), 2, ASSIGN_LEAST),
            _spans(text, ACCESS, 1, text.contains("AKIA")),
            _spans(text, HEX, 2, text.rlike(HEX)),
        )
    )


def pair_counts(docs: DataFrame, sample_docs: int = 4000) -> dict[tuple[bool, str], int]:
    """Counts of adjacent symbols: (random string?, pair) -> count."""
    rows = id_and_text(docs)
    dice = F.xxhash64("doc_id")

    def drawn(some: DataFrame) -> DataFrame:
        cut = some.select(dice.alias("d")).orderBy("d").limit(sample_docs).agg(F.max("d")).first()[0]
        return some.where(dice <= F.lit(cut))

    hits = F.transform(base_spans(F.col("text")), lambda s: s["what"])
    plain = F.regexp_extract_all(F.regexp_replace("text", ANY_BASE, " "), F.lit(ORDINARY), F.lit(0))
    strings = drawn(rows.where(F.col("text").rlike(ANY_BASE))).select(F.lit(True).alias("random"), F.explode(hits).alias("s")).union(
        drawn(rows).select(F.lit(False).alias("random"), F.explode(plain).alias("s"))
    )
    chars = F.split("s", "")
    two = F.zip_with(F.slice(chars, F.lit(1), F.length("s") - 1), F.slice(chars, F.lit(2), F.length("s") - 1), lambda a, b: F.concat(a, b))
    pairs = strings.where("length(s) > 1").select("random", F.explode(two).alias("pair"))
    clean = pairs.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$"))
    return {(r["random"], r["pair"]): r["count"] for r in clean.groupBy("random", "pair").count().collect()}


def ratios(counts: dict[tuple[bool, str], int], smooth: float = 4.0) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for every pair, in the order of SYMBOLS x SYMBOLS.

    Pairs are smoothed with ``smooth`` symbols dealt as the model's symbols are, and those with one of each symbol.
    """
    logs = {}
    for random in (True, False):
        single = {b: 1 + sum(counts.get((random, a + b), 0) for a in SYMBOLS) for b in SYMBOLS}
        every = sum(single.values())
        for a in SYMBOLS:
            seen = sum(counts.get((random, a + b), 0) for b in SYMBOLS)
            for b in SYMBOLS:
                logs[random, a + b] = math.log((counts.get((random, a + b), 0) + smooth * single[b] / every) / (seen + smooth))
    return [logs[True, a + b] - logs[False, a + b] for a in SYMBOLS for b in SYMBOLS]


def _score(string: Column, model: Column) -> Column:
    """The log-likelihood ratio of a string of symbols."""
    places = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)

    def step(state: Column, b: Column) -> Column:
        pair = F.get(model, state["a"] * len(SYMBOLS) + b)
        return F.struct(b.alias("a"), (state["sum"] + F.when((state["a"] >= 0) & (b >= 0), pair).otherwise(0.0)).alias("sum"))

    return F.aggregate(places, F.struct(F.lit(-1).alias("a"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, margin: float = 10.0, sample_docs: int = 4000) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans (arrays of start, kind, end, what), and their lines."""
    values = ",".join(f"{v:.6f}" for v in ratios(pair_counts(docs, sample_docs)))
    model = F.split(F.lit(values), ",").cast("array<double>")
    text = F.col("text")
    rows = id_and_text(docs).select(
        "doc_id", base_spans(text).alias("base"), _spans(text, RUN, 3, text.rlike(RUN)).alias("runs")
    )
    random = F.filter("runs", lambda r: _score(r["what"], model) >= margin)
    apart = _apart(F.col("base"), random)
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", apart)).alias("spans")).select(
        "doc_id", "base", "spans", _line(F.col("base")).alias("base_line"), _line(F.col("spans")).alias("line")
    )
