"""The driver's tables re-read in our schemas, so that every operator runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plylake import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def move_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plies from line items, ten orders to a game; every order of a game has a say in its columns.

    The first order gives White, result, date and opening, the last one Black, and all of them the ratings.  The order
    side is one row for each game before the join, and the join key is the window key, so line items are shuffled once
    for both.
    """
    games = (
        table(spark, sf_dir, "orders")
        .groupBy(F.expr("cast(cast(floor(o_orderkey / 10) as bigint) as string)").alias("game_id"))
        .agg(*[F.min_by(c, "o_orderkey").alias(c) for c in ("o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")],
             F.max_by("o_custkey", "o_orderkey").alias("last_custkey"),
             F.expr("sum(cast(floor(o_totalprice) as bigint))").alias("paid"),
             F.expr("sum(cast(floor(o_totalprice / 7) as bigint))").alias("paid_7th"))
    )
    plies = table(spark, sf_dir, "lineitem").selectExpr(
        "cast(cast(floor(l_orderkey / 10) as bigint) as string) as game_id",
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        "l_quantity",
    )
    in_game = Window.partitionBy("game_id").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        "l_quantity",
    )
    joined = (
        plies.join(games, "game_id")
        .withColumn("move_number", F.row_number().over(in_game))
        .withColumn("gid", F.col("game_id").cast("bigint"))
    )
    columns = {
        "move": "cast(l_suppkey % 10 as string)",
        "fen": "cast(l_partkey as string)",
        "whose_moved": "case when move_number % 2 = 1 then 'white' else 'black' end",
        "clock_remaining": "case when l_linenumber = 7 then null else cast(l_quantity * 100 as int) end",
        "opening_eco": "case when o_orderpriority = '4-NOT SPECIFIED' then null "
                       "else concat('C', substr(o_orderpriority, 1, 1), '0') end",
        "opening_name": "case when o_orderpriority = '4-NOT SPECIFIED' then null "
                        "else substr(o_orderpriority, 3) end",
        "clock_initial": "case when gid % 3 = 0 then 60 when gid % 3 = 1 then 300 else 600 end",
        "clock_increment": "cast(gid % 3 as int)",
        "speed": "case when gid % 3 = 0 then 'bullet' when gid % 3 = 1 then 'blitz' else 'rapid' end",
        "perf": "case when gid % 3 = 0 then 'bullet' when gid % 3 = 1 then 'blitz' else 'rapid' end",
        "variant": "'standard'",
        "white_id": "cast(o_custkey % 50 as string)",
        "white_rating": "cast(1200 + paid % 800 as int)",
        "white_title": "case when o_custkey % 10 = 0 then 'GM' else null end",
        "black_id": "cast((last_custkey * 7 + gid) % 50 as string)",
        "black_rating": "cast(1200 + paid_7th % 800 as int)",
        "black_title": "cast(null as string)",
        "tournament_id": "case when gid % 20 = 0 then 't1' else null end",
        "winner": "case when o_orderstatus = 'F' then 'white' when o_orderstatus = 'O' then 'black' "
                  "else null end",
        "end_status": "case when o_orderstatus = 'F' then 'mate' when o_orderstatus = 'O' then 'resign' "
                      "else 'draw' end",
        "date": "cast(cast(o_orderdate as date) as string)",
    }
    shaped = joined.selectExpr(
        "game_id", "move_number", *[f"{text} as {name}" for name, text in columns.items()]
    )
    return shaped.select(*schemas.MOVE_EVENTS.fieldNames())


def opening_plies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of each game's opening line: two to six plies, by the number of the game."""
    return table(spark, sf_dir, "orders").selectExpr("cast(floor(o_orderkey / 10) as bigint) as gid").distinct().selectExpr(
        "cast(gid as string) as game_id", "cast(2 + gid % 5 as int) as opening_ply"
    )


def evals(spark: SparkSession, sf_dir: str, missing: str = "false") -> DataFrame:
    """An evaluation for each part, except those that the condition ``missing`` names."""
    return table(spark, sf_dir, "part").where(f"NOT ({missing})").selectExpr(
        "cast(p_partkey as string) as fen",
        "case when p_size = 50 then null "
        "else cast(cast(floor(p_retailprice * 10) as bigint) % 801 - 400 as int) end as cp",
        "case when p_size = 50 then case when p_partkey % 2 = 0 then 3 else -2 end else null end as mate",
        "cast(p_partkey % 10 as string) as best_move",
    )


def live_events(df: DataFrame) -> DataFrame:
    """Shape event rows (batch or stream) as live game states."""
    return df.selectExpr(
        "cast(user_id as string) as game_id",
        "event_id",
        "cast(ts as timestamp) as ts",
        "case when event_type = 'signup' then 'started' when event_type = 'error' then 'resign' end "
        "as status_name",
        "cast(floor(value) as int) as wc",
        "cast(floor(value / 2) as int) as bc",
        "cast(event_id % 80 + 1 as int) as ply",
    )


def status_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw status event per event row, with every id spelling and both forms of nested fields."""
    side = (
        "named_struct('userId', case when event_id % 4 = {shift} then concat('u', user_id) "
        "when event_id % 4 = 3 then '' end,"
        "'user', named_struct('id', case when event_id % 4 = 1 then concat('n', user_id) end, 'title', 'IM'),"
        "'id', concat('i', user_id), 'rating', cast(1000 + event_id % 900 as int),"
        "'title', case when event_id % 5 = 0 then 'GM' else '' end)"
    )
    return table(spark, sf_dir, "events").selectExpr(
        "case when event_id % 97 = 0 then 'not json' else to_json(named_struct("
        "'id', case when event_id % 89 = 0 then '' else concat('g', event_id) end,"
        "'timestamp', date_format(cast(ts as timestamp), \"yyyy-MM-dd'T'HH:mm:ss'Z'\"),"
        "'statusName', case event_type when 'signup' then 'started' when 'click' then 'created' "
        "when 'error' then 'resign' when 'view' then '' end,"
        "'status', case when event_type = 'purchase' then 'draw' end,"
        "'speed', 'blitz', 'rated', event_id % 2 = 0, 'variant', 'standard', 'source', 'pool',"
        "'winner', case when event_id % 2 = 0 then 'white' end,"
        "'tournament', case when event_id % 10 = 0 then named_struct('id', 't1') end,"
        f"'players', named_struct('white', {side.format(shift=0)}, 'black', {side.format(shift=2)}))) end as value"
    )


def start_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game_start message (JSON text in ``value``) per order; every fifth is sent twice."""
    orders = table(spark, sf_dir, "orders")
    return orders.unionAll(orders.where("o_orderkey % 5 = 0")).selectExpr(
        "to_json(named_struct("
        "'game_id', cast(o_orderkey as string),"
        "'timestamp', concat(cast(cast(date_trunc('month', o_orderdate) as date) as string), 'T23:59:30Z'),"
        "'speed', case when o_orderkey % 2 = 0 then 'blitz' else 'rapid' end,"
        "'rated', o_orderkey % 3 = 0, 'variant', 'standard',"
        "'white_id', cast(o_custkey % 50 as string),"
        "'white_rating', cast(1200 + cast(floor(o_totalprice) as bigint) % 800 as int),"
        "'black_id', cast((o_custkey * 7 + o_orderkey) % 50 as string),"
        "'black_rating', cast(1200 + cast(floor(o_totalprice / 7) as bigint) % 800 as int),"
        "'source', 'pool')) as value"
    )


def broken_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A game_start message per event that cannot be landed: no JSON, no time, or no id."""
    return table(spark, sf_dir, "events").selectExpr(
        "case event_id % 3 when 0 then concat('not json ', event_id) when 1 then concat('{\"game_id\": \"', event_id, '\"}') "
        "else concat('{\"timestamp\": \"2026-01-01T00:00:00Z\", \"n\": ', event_id, '}') end as value"
    )


def end_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game_end message per order; every third game ends after UTC midnight."""
    return table(spark, sf_dir, "orders").selectExpr(
        "to_json(named_struct("
        "'game_id', cast(o_orderkey as string),"
        "'timestamp', case when o_orderkey % 3 = 0 "
        "then concat(cast(date_add(cast(date_trunc('month', o_orderdate) as date), 1) as string), 'T00:10:00Z') "
        "else concat(cast(cast(date_trunc('month', o_orderdate) as date) as string), 'T23:59:50Z') end,"
        "'winner', case when o_orderstatus = 'F' then 'white' when o_orderstatus = 'O' then 'black' end,"
        "'status', case when o_orderstatus = 'P' then 'draw' else 'mate' end)) as value"
    )


def export_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One export message per order that has line items: its moves are the line items' tokens."""
    games = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct(
            "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"
        ))).alias("lines"))
    )
    orders = table(spark, sf_dir, "orders")
    return orders.join(games, orders.o_orderkey == games.l_orderkey).selectExpr(
        "to_json(named_struct("
        "'id', cast(o_orderkey as string), 'rated', o_orderkey % 3 = 0, 'variant', 'standard',"
        "'speed', case when o_orderkey % 2 = 0 then 'blitz' else 'rapid' end,"
        "'perf', case when o_orderkey % 2 = 0 then 'blitz' else 'rapid' end,"
        "'createdAt', unix_millis(cast(date_trunc('month', o_orderdate) as timestamp)) + 86370000,"
        "'status', case when o_orderstatus = 'P' then 'draw' else 'mate' end,"
        "'winner', case when o_orderstatus = 'F' then 'white' when o_orderstatus = 'O' then 'black' end,"
        "'players', named_struct('white', named_struct('user', named_struct('id', cast(o_custkey % 50 as string)),"
        "'rating', cast(1200 + cast(floor(o_totalprice) as bigint) % 800 as int),"
        "'ratingDiff', cast(o_orderkey % 21 - 10 as int)), 'black', named_struct("
        "'user', named_struct('id', cast((o_custkey * 7 + o_orderkey) % 50 as string)))),"
        "'moves', concat_ws(' ', transform(lines, x -> cast(x.l_suppkey % 10 as string))),"
        "'clocks', transform(slice(lines, 1, 5), x -> cast(x.l_quantity * 100 as int)),"
        "'clock', named_struct('initial', 300, 'increment', cast(o_orderkey % 3 as int)),"
        "'opening', case when o_orderpriority <> '4-NOT SPECIFIED' then named_struct("
        "'eco', concat('C', substr(o_orderpriority, 1, 1), '0'), 'name', substr(o_orderpriority, 3),"
        "'ply', 4) end)) as value"
    )


def knight_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal movetext per game, one token per line item.

    Each side's kingside knight goes out (to the f or h file, as the line item says) and comes back;
    every seventh game has an unplayable token at ply 9.
    """
    plies = table(spark, sf_dir, "lineitem").selectExpr(
        "cast(floor(l_orderkey / 10) as bigint) as gid", "l_orderkey", "l_linenumber", "l_partkey",
        "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity",
    )
    lines = plies.groupBy("gid").agg(
        F.array_sort(F.collect_list(F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"
        ))).alias("lines")
    )
    out = "if(lines[i - {back}].l_suppkey % 2 = 0, 'f', 'h')"
    now, before = out.format(back=0), out.format(back=2)
    san = (
        "case when gid % 7 = 0 and i = 8 then 'Qa9' when i % 4 = 2 then 'Ng1' when i % 4 = 3 then 'Ng8' "
        f"when i % 4 = 0 then concat('N', {now}, '3') else concat('N', {now}, '6') end"
    )
    uci = (
        f"case i % 4 when 0 then concat('g1', {now}, '3') when 1 then concat('g8', {now}, '6') "
        f"when 2 then concat({before}, '3g1') else concat({before}, '6g8') end"
    )
    white, black = (f"if(lines[i - {{back}}].l_suppkey % 2 = 0, '{f}', '{h}')" for f, h in (("5N2", "7N"), ("5n2", "7n")))
    fen = (
        "concat('rnbqkb', if(i % 4 in (2, 3), '1r', 'nr'), '/pppppppp/', "
        f"case i % 4 when 2 then {black.format(back=1)} when 3 then {black.format(back=2)} else '8' end, '/8/8/', "
        f"case i % 4 when 1 then {white.format(back=1)} when 2 then {white.format(back=2)} else '8' end, '/PPPPPPPP/RNBQKB', "
        "if(i % 4 in (1, 2), '1R', 'NR'), if(i % 2 = 0, ' w', ' b'), ' KQkq - ', i, ' ', cast(floor(i / 2) as int) + 1)"
    )
    return lines.selectExpr(
        "cast(gid as string) as game_id",
        f"concat_ws(' ', transform(lines, (x, i) -> {san})) as moves",
        f"concat_ws(' ', transform(lines, (x, i) -> {uci})) as live_moves",
        f"transform(sequence(0, size(lines)), i -> struct(i + 1 as move_number, if(i < size(lines), {uci}, null) as uci, "
        f"{fen} as fen)) as places",
    )


def knight_positions(games: DataFrame) -> DataFrame:
    """The positions table of ``knight_games``, with the position after the last move."""
    return games.select("game_id", F.inline("places"))


def export_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the exported games: the part stands for the position; every seventh game ends after three."""
    line = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"
    )
    numbered = table(spark, sf_dir, "lineitem").withColumn("move_number", F.row_number().over(line))
    return numbered.where("l_orderkey % 7 <> 0 OR move_number < 4").selectExpr(
        "cast(l_orderkey as string) as game_id", "move_number", "concat('u', l_suppkey % 10) as uci", "cast(l_partkey as string) as fen"
    )


def opening_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book line per part: the digits of its key are the moves."""
    return table(spark, sf_dir, "part").selectExpr(
        "trim(regexp_replace(cast(p_partkey as string), '(.)', '$1 ')) as prefix",
        "length(cast(p_partkey as string)) as ply",
        "concat('B', lpad(cast(p_partkey % 100 as string), 2, '0')) as eco",
        "p_name as name",
    )


def pgn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One PGN record per order with line items: tags, clocks, a glyph, a comment and a variation."""
    games = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct(
            "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"
        ))).alias("lines"))
    )
    result = "case o_orderstatus when 'F' then '1-0' when 'O' then '0-1' else '1/2-1/2' end"
    return table(spark, sf_dir, "orders").join(games, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(
        "concat('[Event \"Rated game\"]\n[Site \"https://example.org/g', o_orderkey, '\"]\n[White \"Player', o_custkey % 50,"
        "'\"]\n[Black \"Player', (o_custkey * 7 + o_orderkey) % 50, '\"]\n[Result \"', " + result + ","
        "'\"]\n[UTCDate \"', date_format(o_orderdate, 'yyyy.MM.dd'), '\"]\n[WhiteElo \"',"
        "1200 + cast(floor(o_totalprice) as bigint) % 800, '\"]\n[BlackElo \"?\"]\n[WhiteRatingDiff \"',"
        "if(o_orderkey % 21 >= 10, '+', ''), o_orderkey % 21 - 10, '\"]\n',"
        "if(o_orderkey % 9 = 0, '[BlackTitle \"IM\"]\n', ''),"
        "if(o_orderpriority <> '4-NOT SPECIFIED', concat('[ECO \"C', substr(o_orderpriority, 1, 1), '0\"]\n[Opening \"',"
        "substr(o_orderpriority, 3), '\"]\n'), ''),"
        "'[TimeControl \"60+', o_orderkey % 12, '\"]\n[Termination \"Normal\"]\n\n',"
        "array_join(transform(lines, (x, i) -> concat(cast(floor(i / 2) + 1 as string), if(i % 2 = 0, '. ', '... '),"
        "'Nf', x.l_suppkey % 10, if(i = 0, '!? $1 ', ' '), '{ [%clk 0:00:', lpad(cast(cast(x.l_quantity as int) as string), 2, '0'),"
        "'] }', if(i = 1, ' (2. Nf3 (2. e4) Nf6)', ''))), ' '), ' ', " + result + ", '\n') as value"
    )


def eval_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation-dump lines; every position has lines of several depths."""
    return table(spark, sf_dir, "part").selectExpr(
        "to_json(named_struct('fen', cast(p_partkey % 1000 as string), 'evals', array("
        "named_struct('pvs', array(named_struct('cp', p_size, 'line', 'e2e4 e7e5')), 'knodes', p_partkey, 'depth', p_partkey % 30),"
        "named_struct('pvs', array(named_struct('cp', -p_size, 'line', 'd2d4 d7d5')), 'knodes', p_partkey * 2, 'depth', cast(15 as bigint))"
        "))) as value"
    )
