"""Shape of the physical plans: pruned scans, no Python where none is needed, no whole-key tasks."""

import pytest

from plylake.operators import expand, stats
from plylake.operators.games import games_from_events
from plylake.plans import tools
from plylake.plans.catalog import QUERIES
from plylake.sources import landing, sinks
from plylake import fixtures as fx

SF_DIR = "/root/testdata/sf0.001"
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas")
RUNS_A_JOB = {"scan_partition", "publish_roundtrip", "published_games", "read_exports", "csv_roundtrip", "land_events", "land_quarantine", "land_counts", "live_features", "new_games", "discover_players",
              "read_pgn", "similar_positions", "similar_positions_all"}


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataValueLength", 2000)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def fact(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fact") / "t")
    sinks.publish(fx.move_events(spark, SF_DIR), path)
    return landing.read_fact(spark, path)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNS_A_JOB))
def test_no_report_runs_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert [p for p in PYTHON if p in text] == []
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_reports_read_few_columns_and_push_filters(spark, fact):
    text = plan(tools.run_tool(tools.tools(fact, fx.evals(spark, SF_DIR)), "get_player_overview", player_id="7"))
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "fen" not in schema and "opening_name" not in schema
    assert "EqualTo(move_number,1)" in text and "Or(EqualTo(white_id,7),EqualTo(black_id,7))" in text


def test_date_filter_prunes_partitions(fact):
    text = plan(stats.daily_volume(fact.where("date = '1995-01-01'")))
    assert "PartitionFilters: [isnotnull(date" in text


def test_recent_games_cuts_before_the_shuffle(fact):
    text = plan(stats.recent_games(games_from_events(fact)))
    assert text.count("WindowGroupLimit") == 2


def test_explode_is_above_the_joins(spark):
    from plylake.plans.catalog import _ends, _exports, _starts

    text = plan(expand.build_move_events(
        _exports(spark, SF_DIR), _starts(spark, SF_DIR), _ends(spark, SF_DIR), date="1995-01-01"))
    lines = text.split("\n")
    explode = next(i for i, line in enumerate(lines) if "posexplode" in line)
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert explode < join


def test_reports_at_game_grain_do_not_read_the_fact(spark, fact, tmp_path):
    sinks.publish_games(fact, str(tmp_path / "games"))
    registry = tools.tools(fact, fx.evals(spark, SF_DIR), landing.read_games(spark, str(tmp_path / "games")))
    plain = tools.tools(fact, fx.evals(spark, SF_DIR))
    for name in ("get_player_overview", "get_opening_stats", "get_performance_by_color", "get_performance_vs_rating", "get_recent_games"):
        report = tools.run_tool(registry, name, player_id="7")
        assert "/games" in plan(report) and "/fact" not in plan(report), name
        assert sorted(map(str, report.collect())) == sorted(map(str, tools.run_tool(plain, name, player_id="7").collect()))


def test_one_game_does_not_shuffle_the_evaluations(spark, fact):
    registry = tools.tools(fact, fx.evals(spark, SF_DIR))
    text = plan(tools.run_tool(registry, "analyze_game", game_id="3"))
    assert "SortMergeJoin" not in text and "LeftSemi" in text
    with pytest.raises(LookupError):
        tools.run_tool(registry, "analyze_game", game_id="no such game")
