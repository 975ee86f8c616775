"""Raw messages to the fact: bad input, repeats, midnight, replays of a date."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from plylake.operators import events as e, expand
from plylake.operators.positions import live_board, positioned_plies
from plylake.sources import dumps, landing, sinks
from plylake.streaming.land import land, land_all


def messages(spark, *items):
    texts = [(i if isinstance(i, str) else json.dumps(i),) for i in items]
    return spark.createDataFrame(texts, "value string")


def start(gid="g1", when="2026-01-01T10:00:00+00:00", **more):
    return {"game_id": gid, "timestamp": when, "white_id": "w", "black_id": "b", "white_rating": 1500,
            "black_rating": None, **more}


def end(gid="g1", when="2026-01-01T10:20:00+00:00", winner="white", status="mate"):
    return {"game_id": gid, "timestamp": when, "winner": winner, "status": status}


def export(gid="g1", created=1767261600000, moves="e4 e5 Nf3", **more):
    return {"id": gid, "createdAt": created, "moves": moves, "clocks": [300, 299], "speed": "blitz", "perf": "blitz",
            "variant": "standard", "opening": {"eco": "C40", "name": "King's Knight Opening", "ply": 3},
            "clock": {"initial": 300, "increment": 2}, **more}


def build(spark, exports, starts, ends, **how):
    return expand.build_move_events(
        e.decode(messages(spark, *exports), "moves"), e.decode(messages(spark, *starts), "game_start"),
        e.decode(messages(spark, *ends), "game_end"), **how)


def test_bad_messages_go_to_quarantine(spark):
    raw = messages(spark, start(), "no json", start(gid=None), start(gid=""), start(gid="g2", when="yesterday"), {"x": 1})
    assert [r.game_id for r in e.decode(raw, "game_start").collect()] == ["g1"]
    assert e.undecodable(raw, "game_start").count() == 5


def test_bad_nested_part_keeps_the_row(spark):
    raw = messages(spark, export(opening="oops", clock=None), export(gid="g2", clocks=None))
    got = {r.id: r for r in e.decode(raw, "moves").collect()}
    assert got["g1"].opening is None and got["g1"].clock is None and got["g1"].moves == "e4 e5 Nf3"
    assert got["g2"].clocks is None and got["g2"].date == date(2026, 1, 1)


FIRST = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
SECOND = "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1"


def places(spark, *rows):
    return spark.createDataFrame(list(rows), "game_id string, move_number int, uci string, fen string")


def test_fact_rows(spark):
    known = places(spark, ("g1", 1, "e2e4", FIRST), ("g1", 2, "e7e5", SECOND), ("g1", 3, "g1f3", "third"), ("g1", 4, None, "after"))
    got = build(spark, [export()], [start()], [end()], date="2026-01-01", positions=known).orderBy("move_number").collect()
    assert [(r.move_number, r.move, r.whose_moved, r.clock_remaining) for r in got] == [
        (1, "e2e4", "white", 300), (2, "e7e5", "black", 299), (3, "g1f3", "white", None)]
    assert got[1].fen == SECOND and not any(r.truncated for r in got)
    assert (got[0].opening_eco, got[0].clock_initial, got[0].winner, got[0].date, got[0].black_rating) == (
        "C40", 300, "white", "2026-01-01", None)


def test_repeats_count_once_and_the_latest_wins(spark):
    old = e.decode(messages(spark, start(white_title="FM")), "game_start").withColumn(
        "ingested_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    new = e.decode(messages(spark, start(white_title="IM"), start(white_title="IM")), "game_start")
    for date_ in ("2026-01-01", None):
        got = expand.build_move_events(
            e.decode(messages(spark, export(), export()), "moves"), old.unionByName(new),
            e.decode(messages(spark, end(), end()), "game_end"), date=date_).collect()
        assert [(r.move_number, r.white_title) for r in sorted(got)] == [(1, "IM"), (2, "IM"), (3, "IM")]


@pytest.mark.parametrize("date_", ["2026-01-01", None])
def test_midnight_needs_slack(spark, date_):
    parts = ([export(created=1767311940000)], [start(when="2026-01-01T23:59:00Z")], [end(when="2026-01-02T00:01:00Z")])
    assert build(spark, *parts, date=date_).count() == 0
    assert build(spark, *parts, date=date_, slack_days=1).count() == 3


def test_blank_moves_and_illegal_tail(spark):
    games = [export(moves="  "), export(gid="g2", moves="e4 e5 Ke3 d6"), export(gid="g3", moves=None)]
    known = places(spark, ("g1", 1, "x", "y"), ("g2", 1, "e2e4", FIRST), ("g2", 2, "e7e5", SECOND))
    got = build(spark, games, [start(g) for g in ("g1", "g2", "g3")], [end(g) for g in ("g1", "g2", "g3")], positions=known)
    assert {(r.game_id, r.move, r.truncated) for r in got.collect()} == {("g2", "e2e4", True), ("g2", "e7e5", True)}


def test_publish_replaces_only_its_dates(spark, tmp_path):
    path = str(tmp_path / "fact")
    day1 = build(spark, [export()], [start()], [end()])
    day2 = day1.withColumn("date", F.lit("2026-01-02"))
    for df in (day1, day2, day2, day1.where("move_number = 1")):
        sinks.publish(df, path)
    got = landing.read_fact(spark, path)
    assert dict(got.schema["date"].jsonValue())["type"] == "string"
    assert sorted((r["date"], r["count"]) for r in got.groupBy("date").count().collect()) == [("2026-01-01", 1), ("2026-01-02", 3)]
    plan = got.where("date = '2026-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_land_all_is_exactly_once_and_incremental(spark, tmp_path):
    root = tmp_path / "in"
    for topic, lines in (("game_start", [start(), "bad"]), ("moves", [export()]), ("game_end", [end()])):
        (root / topic).mkdir(parents=True)
        (root / topic / "1.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    source = landing.TopicSource("text", str(root))
    out, checkpoints = str(tmp_path / "out"), str(tmp_path / "checkpoints")
    for _ in range(2):
        land_all(spark, source, out, checkpoints)
    (root / "game_start" / "2.json").write_text(json.dumps(start("g2", "2026-01-03T00:00:00Z")))
    land_all(spark, source, out, checkpoints)
    assert landing.read_landing(spark, out, "game_start").count() == 2
    assert landing.read_landing(spark, out, "game_start", "2026-01-02").count() == 0
    assert landing.read_landing(spark, out, "game_start", "2026-01-02", slack_days=1).count() == 2
    assert spark.read.parquet(f"{out}/_quarantine/game_start").count() == 1
    fact = expand.build_move_events(*(landing.read_landing(spark, out, t) for t in ("moves", "game_start", "game_end")))
    assert fact.count() == 3


def test_a_batch_that_is_handled_again_adds_nothing(spark, tmp_path):
    """The commit of the last batch is lost, as when the driver dies after writing: the batch runs again."""
    folder = tmp_path / "in" / "game_start"
    folder.mkdir(parents=True)
    source = landing.TopicSource("text", str(tmp_path / "in"), {"maxFilesPerTrigger": "1"})
    out, checkpoints = str(tmp_path / "out"), tmp_path / "checkpoints"
    for n in range(3):
        lines = [json.dumps(start(f"g{n}")), json.dumps(start(f"h{n}", f"2026-01-0{n + 2}T00:00:00Z")), f"bad {n}"]
        (folder / f"{n}.json").write_text("\n".join(lines))
        land(spark, source, "game_start", out, str(checkpoints)).awaitTermination()

    def held():
        rows = landing.read_landing(spark, out, "game_start").collect()
        counts = landing.read_batches(spark, out, "game_start").collect()
        return (sorted((r.game_id, str(r.date)) for r in rows), sorted(r.value for r in landing.read_quarantine(spark, out, "game_start").collect()),
                sorted((r.messages, r.landed, r.quarantined) for r in counts))

    before = held()
    assert len(before[0]) == 6 and before[1] == ["bad 0", "bad 1", "bad 2"] and before[2] == [(3, 2, 1)] * 3
    for name in ("2", ".2.crc"):
        (checkpoints / "game_start" / "commits" / name).unlink(missing_ok=True)
    land(spark, source, "game_start", out, str(checkpoints)).awaitTermination()
    assert held() == before
    land(spark, source, "game_start", out, str(tmp_path / "other")).awaitTermination()  # another query lands for itself
    assert len(held()[0]) == 12


def test_a_landing_query_reads_its_topic_once(spark, tmp_path):
    (tmp_path / "in" / "game_start").mkdir(parents=True)
    (tmp_path / "in" / "game_start" / "1.json").write_text(json.dumps(start()))
    query = land(spark, landing.TopicSource("text", str(tmp_path / "in")), "game_start", str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert len(query.lastProgress["sources"]) == 1 and query.lastProgress["sources"][0]["numInputRows"] == 1


def test_route_events(spark):
    side = {"userId": "", "user": {"id": "u1", "title": "GM"}, "id": "i1", "rating": 1500, "title": ""}
    base = {"id": "g1", "timestamp": "2026-01-01T00:00:00Z", "players": {"white": side, "black": {"id": "i2"}}}
    raw = messages(
        spark, {**base, "statusName": "started", "variant": {"key": "standard"}, "tournament": {"id": "t"}},
        {**base, "id": "g2", "statusName": "created"}, {**base, "id": "g3", "statusName": ""},
        {**base, "id": "g4", "statusName": "mate", "winner": "black"}, {**base, "id": "", "statusName": "started"},
        {**base, "id": "g5", "status": {"id": 30, "name": "resign"}}, {**base, "id": "g6", "status": "draw"},
    )
    starts, ends = e.route_events(e.parse_status_events(raw))
    got = starts.collect()
    assert [(r.game_id, r.variant, r.white_id, r.white_title, r.black_id, r.tournament_id) for r in got] == [
        ("g1", "standard", "u1", "GM", "i2", "t")]
    assert sorted((r.game_id, r.winner, r.status) for r in ends.collect()) == [
        ("g4", "black", "mate"), ("g5", None, "resign"), ("g6", None, "draw")]


@pytest.mark.parametrize("arg, expected", [(None, "2026-01-09"), ("2026-01-10", "2026-01-09"), ("2027-01-01", "2026-01-09"),
                                           ("2026-01-05", "2026-01-05")])
def test_batch_date(arg, expected):
    assert e.resolve_batch_date(arg, date(2026, 1, 10)) == expected


def test_export_requests_are_bounded_and_whole(spark):
    ends = spark.range(1000).selectExpr("concat('g', id) as game_id")
    exports = spark.createDataFrame([("g5",)], "id string")
    lists = [r.ids for r in e.export_requests(ends.union(ends), exports, n=7, buckets=4).collect()]
    assert max(map(len, lists)) == 7
    assert sorted(x for ids in lists for x in ids) == sorted(f"g{i}" for i in range(1000) if i != 5)


def test_read_exports(spark, tmp_path):
    path = tmp_path / "games.ndjson"
    path.write_text("\n".join([json.dumps(export()), "", "{broken", json.dumps({"moves": "e4"})]))
    good, bad = landing.read_exports(spark, str(path))
    assert [(r.id, r.opening.eco, r.clocks) for r in good.collect()] == [("g1", "C40", [300, 299])]
    assert bad.count() == 2


def test_ensure_table_is_idempotent(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS plytest LOCATION '" + str(tmp_path / "db") + "'")
    for _ in range(2):
        sinks.ensure_table(spark, "plytest.fact")
    sinks.refresh(spark, "plytest.fact")
    assert spark.table("plytest.fact").columns[-1] == "date"
    spark.sql("DROP DATABASE plytest CASCADE")


def test_csv_download(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, "a,b")], "n int, s string"), str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()] == [("1", "a,b")]


def test_positions_end_a_game(spark):
    """A gap, a missing game, repeated rows, more positions than moves, and flags from the tokens."""
    games = spark.createDataFrame(
        [("all", "e4 d5 exd5 Qxd5+"), ("gap", "e4 d5 exd5"), ("none", "e4"), ("blank", ""), ("null", None), ("mate", "f3 e5 g4 Qh4#!?")],
        "game_id string, moves string")
    rows = [("all", n, f"m{n}", f"p{n}") for n in range(1, 6)] + [("all", 2, "m2", "p2"), ("blank", 1, None, "p1"), ("other", 1, "x", "y")]
    rows += [("gap", 1, "m1", "p1"), ("gap", 3, "m3", "p3")] + [("mate", n, f"m{n}", None) for n in range(1, 5)]
    got = positioned_plies(games, places(spark, *rows)).collect()
    by = {g: sorted((r.move_number, r.move, r.fen, r.whose_moved) for r in got if r.game_id == g) for g in {r.game_id for r in got}}
    assert set(by) == {"all", "gap", "mate"} and by["gap"] == [(1, "m1", "p1", "white")]
    assert by["all"] == [(n, f"m{n}", f"p{n}", "white" if n % 2 else "black") for n in range(1, 5)]
    assert {(r.game_id, r.truncated) for r in got} == {("all", False), ("gap", True), ("mate", False)}
    flags = {(r.game_id, r.move_number): (r.is_check, r.is_capture) for r in got}
    assert [flags["all", n] for n in range(1, 5)] == [(False, False), (False, False), (False, True), (True, True)]
    assert flags["mate", 4] == (True, False)


def test_live_board_finds_the_position_after_the_last_move(spark):
    states = spark.createDataFrame([("g", "e2e4 e7e5"), ("g", ""), ("g", None), ("g", "a b c d"), ("h", "e2e4")], "game_id string, moves string")
    known = places(spark, ("g", 1, "e2e4", FIRST), ("g", 2, "e7e5", SECOND), ("g", 3, None, "third")).selectExpr("*", "move_number = 3 AS in_check")
    got = sorted((r.game_id, r.move, r.fen, r.is_check) for r in live_board(states, known).na.fill("-").collect())
    assert got == [("g", "-", FIRST, False), ("g", "-", FIRST, False), ("g", "d", "-", False), ("g", "e7e5", "third", True), ("h", "e2e4", "-", False)]


def test_pgn_reader(spark, tmp_path):
    text = (
        '[Event "Rated Blitz game"]\n[Site "https://example.org/abcd1234"]\n[White "Ann"]\n[Black "Bob \\"B\\""]\n'
        '[Result "1-0"]\n[UTCDate "2026.01.31"]\n[WhiteElo "1500"]\n[BlackElo "?"]\n[WhiteRatingDiff "+5"]\n'
        '[ECO "C20"]\n[Opening "King\'s Pawn"]\n[TimeControl "180+2"]\n[Termination "Normal"]\n\n'
        "1. e4 { [%eval 0.2] [%clk 0:03:00] } e5?! $6 { [%clk 0:02:58.5] } (1... c5 (1... e6) 2. Nf3) 2. Nf3 ; tail\n 1-0\n\n"
        '[Event "Casual"]\n[Site "https://example.org/zzzz9999"]\n[White "C"]\n[Black "D"]\n[Result "1/2-1/2"]\n'
        '[Date "2026.02.01"]\n[TimeControl "-"]\n\n1. d4 1/2-1/2\n'
    )
    (tmp_path / "a.pgn").write_text(text)
    a, b = dumps.read_pgn(spark, str(tmp_path / "a.pgn"), partitions=2).orderBy("game_id").collect()
    assert (a.game_id, a.moves, a.clocks) == ("abcd1234", "e4 e5 Nf3", [18000, 17850])
    assert (a.white_id, a.black_id, a.white_rating, a.black_rating, a.white_rating_diff) == ("ann", 'bob "b"', 1500, None, 5)
    assert (a.speed, a.clock_initial, a.clock_increment, a.winner, a.end_status, a.date) == (
        "blitz", 180, 2, "white", "normal", "2026-01-31")
    assert (b.moves, b.winner, b.speed, b.clock_initial, b.date) == ("d4", None, "correspondence", None, "2026-02-01")
    rows = dumps.history_events(dumps.read_pgn(spark, str(tmp_path / "a.pgn"))).where("game_id = 'abcd1234'").orderBy("move_number")
    assert [(r.move, r.clock_remaining) for r in rows.collect()] == [("e4", 18000), ("e5", 17850), ("Nf3", None)]


def test_eval_dump(spark, tmp_path):
    lines = [
        {"fen": "a w - - 0 1", "evals": [{"pvs": [{"cp": 1, "line": "e2e4 e7e5"}], "knodes": 5, "depth": 10},
                                         {"pvs": [{"mate": -3, "line": "d2d4"}], "knodes": 1, "depth": 20}]},
        {"fen": "a w - -", "evals": [{"pvs": [{"cp": 9, "line": "c2c4"}], "knodes": 2, "depth": 20}]},
    ]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    got = dumps.read_eval_dump(spark, str(tmp_path / "e.jsonl")).collect()
    assert [tuple(r) for r in got] == [("a w - -", 9, None, "c2c4")]


def test_pgn_nesting_line_ends_and_clocks(spark, tmp_path):
    """Six nested variations with clocks of their own, CRLF, no blank line, no site, a move without a clock."""
    nested = "( d4 " * 6 + "{ [%clk 0:00:01] } " + ") " * 6
    first = f'[Event "x"]\n[Site "https://e.org/g1"]\n\n1. e4 {{ [%clk 0:01:00.5] }} {nested}1... e5 2. Nf3 {{ [%eval 0.2] [%clk 0:00:58] }} 1-0\n'
    second = '[Event "y"]\n[White "ann"]\n1. d4 d5 *\n'
    (tmp_path / "a.pgn").write_bytes((first + "\n" + second).replace("\n", "\r\n").encode())
    (tmp_path / "b.pgn").write_text(first.replace("g1", "g2"))
    got = {r.game_id: r for r in dumps.read_pgn(spark, str(tmp_path)).collect()}
    assert len(got) == 3
    for name in ("g1", "g2"):
        assert (got[name].moves, got[name].clocks) == ("e4 e5 Nf3", [6050, None, 5800])
    other = next(r for n, r in got.items() if n.startswith("pgn-"))
    assert (other.moves, other.clocks, other.white_id) == ("d4 d5", [], "ann")
