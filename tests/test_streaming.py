"""Streams against their batch form, over several files and restarts."""

import pytest

from plylake import fixtures as fx
from plylake.plans import tools
from plylake.streaming import discover, live
from plylake.streaming.land import append_files

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """The events in time order, cut into files that arrive one per trigger."""
    path = tmp_path_factory.mktemp("events")
    pdf = spark.read.parquet(f"{SF_DIR}/events.parquet").toPandas().sort_values(["ts", "event_id"], ignore_index=True)
    step = -(-len(pdf) // 4)
    for i in range(4):
        part = spark.createDataFrame(pdf.iloc[i * step:(i + 1) * step], spark.read.parquet(f"{SF_DIR}/events.parquet").schema)
        part.coalesce(1).write.parquet(f"{path}/{i}")
    return str(path)


def stream_of(spark, path):
    schema = spark.read.parquet(f"{SF_DIR}/events.parquet").schema
    return fx.live_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*"))


def test_live_features_equal_batch(spark, split_events, tmp_path, rows):
    stream = live.live_features(stream_of(spark, split_events))
    append_files(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    want = live.time_spent(fx.live_events(fx.table(spark, SF_DIR, "events")))
    assert rows(got, *live.FEATURES) == rows(want, *live.FEATURES)


def test_long_game_spans_arrow_batches(spark, tmp_path, rows):
    """A game with more rows in a trigger than an Arrow batch holds."""
    states = spark.range(25000).selectExpr(
        "if(id % 50 = 0, 'other', 'long') as game_id", "id as event_id", "timestamp_seconds(1700000000 + id * 7919 % 25013) as ts",
        "cast(id % 90 + 1 as int) as ply", "cast(id * 31 % 700 as int) as wc", "cast(id * 17 % 600 as int) as bc")
    states.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.live_features(spark.readStream.schema(states.schema).parquet(str(tmp_path / "in")))
    append_files(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert rows(got, *live.FEATURES) == rows(live.time_spent(states), *live.FEATURES)


def test_time_spent_rules(spark):
    states = spark.createDataFrame(
        [("g", 1, 1, 100, 90), ("g", 2, 2, 100, 0), ("g", 3, 3, 95, 0), ("g", 4, 4, 95, 5), ("h", 5, 1, 9, 50)],
        "game_id string, event_id bigint, ply int, wc int, bc int",
    ).selectExpr("*", "timestamp_seconds(event_id) as ts")
    got = {r.event_id: (r.time_spent_s, r.time_pressure, r.move_number) for r in live.time_spent(states).collect()}
    assert got == {1: (None, False, 1), 2: (90, True, 2), 3: (5, True, 2), 4: (None, True, 3), 5: (None, True, 1)}


def test_ply_of_cumulative_moves(spark):
    df = spark.createDataFrame([("e2e4 e7e5",), ("",), (None,)], "m string")
    assert [r[0] for r in df.select(live.ply_of(df.m)).collect()] == [2, 0, 0]


def test_new_games_equal_distinct(spark, split_events, tmp_path):
    stream = live.new_games(stream_of(spark, split_events)).select("game_id")
    append_files(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = [r.game_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) == fx.table(spark, SF_DIR, "events").select("user_id").distinct().count()


def test_discovery_adds_each_player_once(spark, tmp_path):
    source = str(tmp_path / "in")
    starts = "white_id string, black_id string"
    known, checkpoint = str(tmp_path / "known"), str(tmp_path / "ck")
    for batch in ([("a", "b"), ("a", None), ("", "b")], [("b", "c"), ("c", "c")]):
        spark.createDataFrame(batch, starts).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(starts).parquet(source)
        discover.discover_players(stream, known, checkpoint, availableNow=True).awaitTermination()
    got = spark.read.schema(discover.KNOWN_PLAYERS).parquet(known).collect()
    assert sorted(r.player_id for r in got) == ["a", "b", "c"]
    assert all(r.first_seen == r.last_seen for r in got)


def test_tools(spark):
    events, evals = fx.move_events(spark, SF_DIR), fx.evals(spark, SF_DIR)
    registry = tools.tools(events, evals)
    assert len(registry) == 8
    assert tools.declarations(registry)["get_opening_stats"]["top_n"] == {"type": "int", "required": False, "default": 10}
    overview = tools.run_tool(registry, "get_player_overview", player_id="7").collect()
    assert overview and {r.player_id for r in overview} == {"7"}
    for name in registry:
        args = {"game_id": "3"} if name == "analyze_game" else {"player_id": "7"}
        assert tools.run_tool(registry, name, **args).count() > 0
    with pytest.raises(KeyError):
        tools.run_tool(registry, "drop_everything")
    with pytest.raises(TypeError):
        tools.run_tool(registry, "get_recent_games", player="7")


def test_sql_surface(spark):
    fx.move_events(spark, SF_DIR).createOrReplaceTempView("move_events")
    every = fx.move_events(spark, SF_DIR).count()
    assert tools.run_sql(spark, "select game_id as limit_name from move_events;").count() == every > 500
    assert tools.run_sql(spark, "select game_id from move_events -- all", cap=500).count() == 500
    capped = tools.run_sql(spark, "WITH x AS (SELECT * FROM move_events LIMIT 3) SELECT * FROM x WHERE white_id <> :who",
                           args={"who": "x' OR '1'='1"})
    assert capped.count() == 3
    spark.range(3).createOrReplaceTempView("written")
    hidden = "WITH c AS (SELECT 1 AS id) INSERT INTO written SELECT id FROM c"
    for bad in ("DROP TABLE move_events", "  ", "insert into x select 1", hidden, "select 1) ; drop view written --"):
        with pytest.raises(ValueError):
            tools.run_sql(spark, bad)


def test_nothing_is_forgotten_between_far_events(spark, tmp_path, rows):
    """A game with days between its two states, other games' events in between, one file a trigger."""
    schema = "game_id string, event_id bigint, ts timestamp, ply int, wc int, bc int"
    source = str(tmp_path / "in")
    for day, game in enumerate(("slow", "b", "c", "d", "slow")):
        spark.createDataFrame([(game, day, day, 1 + day % 2, 600 - day, 500 - day)], schema.replace("timestamp", "int")).selectExpr(
            "game_id", "event_id", "timestamp_seconds(1700000000 + ts * 90000L) AS ts", "ply", "wc", "bc"
        ).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    append_files(live.live_features(stream), str(tmp_path / "f"), str(tmp_path / "fc")).awaitTermination()
    got = spark.read.schema(live.live_features(stream).schema).parquet(str(tmp_path / "f"))
    assert rows(got, *live.FEATURES) == rows(live.time_spent(spark.read.parquet(source)), *live.FEATURES)
    append_files(live.new_games(stream).select("game_id"), str(tmp_path / "n"), str(tmp_path / "nc")).awaitTermination()
    assert sorted(r.game_id for r in spark.read.parquet(str(tmp_path / "n")).collect()) == ["b", "c", "d", "slow"]
