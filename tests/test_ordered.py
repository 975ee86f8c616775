"""Look-back over chunks against one plain window, on a key that holds most rows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from plylake.operators.ordered import with_previous, with_running_count


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(5)
    data = [
        (rnd.choice(["hot"] * 8 + ["a", "b"]), f"2026-01-{rnd.randint(1, 9):02d}", i, rnd.choice(["win", "loss", None]))
        for i in range(600)
    ]
    data.append(("single", "2026-01-01", 9999, "win"))
    return spark.createDataFrame(data, "k string, day string, n int, v string").repartition(5)


@pytest.mark.parametrize("n", [1, 3, 7])
def test_previous_equals_plain_window(skewed, n):
    got = with_previous(skewed, ["k"], "day", ["n"], "v", n)
    plain = Window.partitionBy("k").orderBy("day", "n").rowsBetween(-n, -1)
    want = skewed.withColumn("w", F.transform(F.collect_list(F.struct("v")).over(plain), lambda x: x["v"]))
    both = got.join(want.select("n", "w"), "n")
    assert both.count() == 601
    assert both.where(~F.col("previous").eqNullSafe(F.col("w"))).count() == 0


def test_running_count_equals_plain_window(skewed):
    got = with_running_count(skewed, ["k"], "day", ["n"])
    want = skewed.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("day", "n")))
    both = got.join(want.select("n", "w"), "n")
    assert both.count() == 601
    assert both.where("nth <> w").count() == 0


def test_rows_meet_by_chunk_and_not_by_key(skewed):
    """The frame itself is shuffled on key and chunk; only the per-chunk summary is shuffled on the key."""
    plan = with_running_count(skewed, ["k"], "day", ["n"])._jdf.queryExecution().executedPlan().toString()
    by_key = [line for line in plan.split("\n") if "hashpartitioning(k#" in line and "day#" not in line]
    assert len(by_key) == 1
