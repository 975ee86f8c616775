"""I-Match document fingerprints with randomised lexicon subsets, in DataFrame functions only.

Terms are the lower-cased runs of letters and digits, hashed to 64 bits.  Their document frequencies are counted over
all documents in 2^18 hash cells; the lexicon is the cells whose inverse document frequency lies in the band, a bit map
of fixed size (32 kB), so it does not grow with the data.  A document keeps its distinct terms of the lexicon, sorted.
Four scales of randomised lexicon subsets, eight subsets each (a term is in a given subset with probability 1/8, 1/32,
1/128 or 1/512), are hashed one by one: the coarse ones tell short documents apart, the fine ones survive edits of long
ones.  A fingerprint is these 32 hashes of 8 hex digits, ``-`` for a subset that the document has no term of; likeness
is the share of equal hashes among the subsets that either document has terms of.

Defined results: a null text is the empty text; a text without a term of the lexicon is hashed whole in all places, so
it is like equal texts only; equal texts have equal fingerprints; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plylake.llm.common import id_and_text, running_totals, stored

CELLS = 1 << 18
SCALES = (8, 32, 128, 512)
PARTS, DIGITS = 8, 8
#: The band: terms of 0.3 % to 20 % of the documents.
IDF_BAND = (math.log(1 / 0.2), math.log(1 / 0.003))


def terms(text: Column) -> Column:
    """The distinct hashed terms of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _cell(term: Column) -> Column:
    return F.pmod(term, F.lit(CELLS))


def lexicon(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> Column:
    """The bit map of the cells in the band, as a constant; counts are over all documents."""
    rows = id_and_text(docs)
    n = rows.count()
    df = (
        rows.select(F.explode(F.array_distinct(F.transform(terms(F.col("text")), _cell))).alias("cell"))
        .groupBy("cell").agg(F.count("*").alias("df"))
    )
    idf = F.log(F.lit(float(max(n, 1))) / F.col("df"))
    bits = (
        df.where(idf.between(*band))
        .groupBy(F.shiftright("cell", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits"))
    )
    known = {r["word"]: r["bits"] for r in bits.collect()}  # one row for each 64 of the 2^18 cells at most
    return F.split(F.lit(",".join(str(known.get(i, 0)) for i in range(CELLS >> 6))), ",").cast("array<bigint>")


def kept_terms(text: Column, lex: Column) -> Column:
    """The document's distinct lexicon terms, sorted; the whole text's hash if there is none."""
    def inside(t: Column) -> Column:
        cell = _cell(t)
        return F.getbit(F.get(lex, F.shiftright(cell, 6).cast("int")), (cell % 64).cast("int")) == 1

    return F.array_sort(F.filter(terms(text), inside))


def fingerprint(kept: Column, text: Column) -> Column:
    """32 subset hashes of the kept terms in one string."""
    def digits(values: Column) -> Column:
        return F.substring(F.lpad(F.lower(F.hex(F.xxhash64(values))), 16, "0"), 1, DIGITS)

    parts = []
    for scale in SCALES:
        def place(t: Column, scale: int = scale) -> Column:
            return F.pmod(F.xxhash64(t, F.lit(scale)), F.lit(scale))

        few = F.transform(F.filter(kept, lambda t: place(t) < PARTS), lambda t: F.struct(place(t).alias("p"), t.alias("t")))
        parts.append(
            F.array_join(
                F.transform(
                    F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda j: F.transform(F.filter(few, lambda x: x["p"] == j), lambda x: x["t"])),
                    lambda mine: F.when(F.size(mine) > 0, digits(mine)).otherwise("-" * DIGITS),
                ),
                "",
            )
        )
    whole = F.repeat(digits(F.array(F.xxhash64(text, F.lit("whole")))), len(SCALES) * PARTS)
    return F.when(F.size(kept) > 0, F.concat(*parts)).otherwise(whole)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subset hashes among those that are not empty in both."""
    same, used = F.lit(0), F.lit(0)
    for i in range(len(SCALES) * PARTS):
        x, y = (F.substring(c, i * DIGITS + 1, DIGITS) for c in (a, b))
        has = (x != "-" * DIGITS) | (y != "-" * DIGITS)
        used, same = used + has.cast("int"), same + (has & (x == y)).cast("int")
    return F.when(used > 0, same / used).otherwise(F.lit(1.0)).cast("double")


def fingerprints(docs: DataFrame, lex: Column) -> DataFrame:
    """(doc_id, text, fingerprint) of every row."""
    rows = id_and_text(docs).select("doc_id", "text", kept_terms(F.col("text"), lex).alias("kept"))
    return rows.select("doc_id", "text", fingerprint(F.col("kept"), F.col("text")).alias("fingerprint"))


def next_in_order(ids: DataFrame) -> DataFrame:
    """(doc_id, k, next_id) for distinct ids: the next lower id, and the highest one after the lowest."""
    placed = stored(running_totals(ids, [F.col("doc_id").desc_nulls_last()], F.lit(1), "imatch-order"), "imatch-places")
    n = placed.count()
    after = placed.select(F.col("before").alias("place"), F.col("doc_id").alias("next_id"))
    return placed.withColumn("place", (F.col("before") + 1) % max(n, 1)).join(after, "place").select("doc_id", "k", "next_id")


def compare(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the text with its last third replaced by the start of the next document, in descending id; the
    next document sends only as many characters as are needed.  Rows that share an id share the next document; of
    several texts that such an id has, the least start is sent.  Null ids stand last.
    """
    lex = lexicon(docs, band)
    rows = fingerprints(docs, lex)
    third = F.floor(F.char_length("text") / 3).cast("int")
    links = next_in_order(id_and_text(docs).groupBy("doc_id").agg(F.max(third).alias("k"))).withColumnRenamed("doc_id", "of")
    sent = (
        rows.join(links, rows["doc_id"].eqNullSafe(links["next_id"]))
        .groupBy("of")
        .agg(F.min(F.struct(F.substring("text", F.lit(1), F.col("k")).alias("head"), "fingerprint")).alias("sent"))
        .select("of", F.col("sent.head").alias("head"), F.col("sent.fingerprint").alias("next_fingerprint"))
    )
    kept = F.substring("text", F.lit(1), F.char_length("text") - third)
    pairs = rows.join(sent, rows["doc_id"].eqNullSafe(sent["of"])).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
        F.concat(kept, F.substring("head", F.lit(1), third)).alias("edited"),
    )
    pairs = pairs.withColumn("kept", kept_terms(F.col("edited"), lex))
    done = pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint",
        fingerprint(F.col("kept"), F.col("edited")).alias("edited_fingerprint"),
    )
    return done.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
