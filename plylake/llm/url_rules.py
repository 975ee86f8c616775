"""URL filter: allow and block rules as intervals over reversed-host keys, matched by a sorted sweep.

A host's key is its labels in reverse, each followed by ``/``; the hosts under a rule are exactly the keys that start
with the rule's key, one interval, and two intervals are nested or apart.  Urls and rules are dealt to ranges of the
sorted key (cut from a bounded sample; the cuts move rows, never results).  The url's path and id extend the key that is
cut, so one host may fill many ranges; a rule goes to each range that its interval meets.  Within a range a sweep
in key order keeps the stack of open rules.  Of the fitting rules the longest (host and path together) wins, then the
longer host, then block.

Defined results: a url that is null or has no ``://`` has empty host and path and gets the default; rules with a null
host, path or verdict fit nothing; repeated rules count once; an empty table of urls gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUT = "page_id long, host string, path string, rule string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse, each with ``/`` after it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def _cuts(rows: DataFrame, ranges: int, seed: int) -> list[str]:
    """At most ``ranges - 1`` cut points, from a sample of about 50 keys for each range."""
    n = rows.count()
    if not n:
        return []
    picked = rows.select("full").sample(min(1.0, 50.0 * ranges / n), seed).orderBy("full").limit(100 * ranges).collect()
    keys = [r[0] for r in picked]
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


class Sweep:
    """The open rules at one place of the sorted keys, innermost last."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[int, dict[str, tuple]]]] = []

    def move(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, rank: tuple, label: str, verdict: str) -> None:
        self.move(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}))
        at = self.stack[-1][1].setdefault(len(path), {})
        at[path] = max(at.get(path, rank + (label, verdict)), rank + (label, verdict))

    def best(self, key: str, path: str) -> tuple | None:
        self.move(key)
        found = [
            rules[path[:n]] for _, by_length in self.stack for n, rules in by_length.items()
            if n <= len(path) and path[:n] in rules
        ]
        return max(found) if found else None


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    sweep, place = Sweep(), None
    for batch in batches:
        out: dict[str, list] = {"page_id": [], "host": [], "path": [], "rule": [], "verdict": []}
        names = ("bucket", "key", "kind", "page_id", "host", "path", "rule", "verdict")
        for bucket, key, kind, page, host, path, rule, verdict in zip(*(batch.column(n).to_pylist() for n in names)):
            if bucket != place:
                sweep, place = Sweep(), bucket
            if kind == 0:
                sweep.open(key, path, (len(host) + len(path), len(host), verdict == "block"), rule, verdict)
                continue
            found = sweep.best(key, path)
            for name, value in zip(out, (page, host, path, found and found[3], found[4] if found else default)):
                out[name].append(value)
        kinds = {"page_id": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.string())) for n, v in out.items()], names=list(out))


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", seed: int = 1,
) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; ``rules`` has host, path and verdict (allow or block)."""
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn(
        "key", host_key(F.col("host"))
    )
    urls = urls.withColumn(
        "full", F.concat("key", F.lit("\0"), "path", F.lit("\0"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    )
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(urls, ranges, seed)

    @F.pandas_udf("int")
    def bucket_of(full: pd.Series) -> pd.Series:
        return full.map(lambda x: bisect.bisect_right(cuts, x)).astype("int32")

    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select("host", "path", "verdict")
    known = known.distinct().withColumn("key", host_key(F.col("host")))
    first, last = bucket_of("key"), bucket_of(F.concat("key", F.lit("\U0010ffff")))
    events = known.select(
        F.explode(F.sequence(first, last)).alias("bucket"), "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"),
        "host", "path", F.concat("host", "path").alias("rule"), "verdict",
    ).unionByName(
        urls.select(
            bucket_of("full").alias("bucket"), "key", F.lit(1).alias("kind"), "page_id", "host", "path",
            F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
        )
    )
    swept = events.repartition(ranges, "bucket").sortWithinPartitions("bucket", "key", "kind")
    return swept.mapInArrow(lambda batches: _sweep(batches, default), OUT)
