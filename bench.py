"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, or ``all``).
Every query runs to completion with all its columns (noop sink), after two warm-up queries.
"""

from __future__ import annotations

import json
import os
import time

import pyarrow.parquet as pq

from plylake.plans.catalog import QUERIES
from plylake.session import local_session

HEADLINE = [
    "player_overview", "time_pressure_own", "opening_stats", "clock_by_phase", "vs_rating", "recent_games",
    "judge_moves_corrected", "attach_evals", "game_digest", "error_profile", "tilt", "repeat_errors",
    "build_move_events", "replay", "similar_positions_all", "land_events", "time_spent", "live_features", "similar_players", "next_moves",
    "read_pgn",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session("bench", cpus, int(cpus))
    for name in ("daily_volume", "game_judgement"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    # every order with lines is one PGN record
    orders = pq.read_metadata(f"{sf_dir}/orders.parquet").num_rows
    rates = {}
    if "read_pgn" in seconds:
        rates["pgn_write_and_parse_orders_per_sec"] = round(orders / seconds["read_pgn"])
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rates": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
