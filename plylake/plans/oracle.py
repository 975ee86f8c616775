"""The same queries as SQL text for DuckDB, written from the definitions and not from the Spark code."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Shared table expressions, in order of dependence.
CTES = {
    "ev": """
  SELECT CAST(gid AS VARCHAR) AS game_id, gid, move_number,
    CAST(l_suppkey % 10 AS VARCHAR) AS move, CAST(l_partkey AS VARCHAR) AS fen,
    CASE WHEN move_number % 2 = 1 THEN 'white' ELSE 'black' END AS whose_moved,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity * 100 AS INT) END AS clock_remaining,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
         ELSE concat('C', substr(o_orderpriority, 1, 1), '0') END AS opening_eco,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE substr(o_orderpriority, 3) END AS opening_name,
    CAST(CASE WHEN gid % 3 = 0 THEN 60 WHEN gid % 3 = 1 THEN 300 ELSE 600 END AS INT) AS clock_initial,
    CAST(gid % 3 AS INT) AS clock_increment,
    CASE WHEN gid % 3 = 0 THEN 'bullet' WHEN gid % 3 = 1 THEN 'blitz' ELSE 'rapid' END AS speed,
    CASE WHEN gid % 3 = 0 THEN 'bullet' WHEN gid % 3 = 1 THEN 'blitz' ELSE 'rapid' END AS perf,
    'standard' AS variant,
    CAST(o_custkey % 50 AS VARCHAR) AS white_id,
    CAST(1200 + paid % 800 AS INT) AS white_rating,
    CASE WHEN o_custkey % 10 = 0 THEN 'GM' ELSE NULL END AS white_title,
    CAST((last_custkey * 7 + gid) % 50 AS VARCHAR) AS black_id,
    CAST(1200 + paid_7th % 800 AS INT) AS black_rating,
    CAST(NULL AS VARCHAR) AS black_title,
    CASE WHEN gid % 20 = 0 THEN 't1' ELSE NULL END AS tournament_id,
    CASE WHEN o_orderstatus = 'F' THEN 'white' WHEN o_orderstatus = 'O' THEN 'black' ELSE NULL END AS winner,
    CASE WHEN o_orderstatus = 'F' THEN 'mate' WHEN o_orderstatus = 'O' THEN 'resign' ELSE 'draw' END AS end_status,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date
  FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY gid ORDER BY l_orderkey, l_linenumber, l_partkey,
        l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS INT) AS move_number
    FROM (SELECT *, CAST(floor(l_orderkey / 10) AS BIGINT) AS gid FROM lineitem) JOIN (
      SELECT CAST(floor(o_orderkey / 10) AS BIGINT) AS gid, arg_min(o_custkey, o_orderkey) AS o_custkey,
        arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_orderdate, o_orderkey) AS o_orderdate,
        arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, arg_max(o_custkey, o_orderkey) AS last_custkey,
        CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS paid,
        CAST(sum(CAST(floor(o_totalprice / 7) AS BIGINT)) AS BIGINT) AS paid_7th
      FROM orders GROUP BY 1) USING (gid)
  )""",
    "g": "SELECT * FROM ev WHERE move_number = 1",
    "p": """
  SELECT *, CASE WHEN winner IS NULL THEN 'draw' WHEN winner = color THEN 'win' ELSE 'loss' END AS result
  FROM (
    SELECT g.*, white_id AS player_id, 'white' AS color, black_id AS opponent_id,
           white_rating AS my_rating, black_rating AS opp_rating FROM g
    UNION ALL
    SELECT g.*, black_id, 'black', white_id, black_rating, white_rating FROM g WHERE white_id <> black_id
  )""",
    "own": """
  SELECT *, CASE WHEN whose_moved = 'white' THEN white_id ELSE black_id END AS player_id FROM ev""",
    "evals": """
  SELECT CAST(p_partkey AS VARCHAR) AS fen,
    CAST(CASE WHEN p_size = 50 THEN NULL
         ELSE CAST(floor(p_retailprice * 10) AS BIGINT) % 801 - 400 END AS INT) AS cp,
    CAST(CASE WHEN p_size = 50 THEN CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE -2 END ELSE NULL END AS INT) AS mate,
    CAST(p_partkey % 10 AS VARCHAR) AS best_move, TRUE AS evaluated
  FROM part""",
    "ee": "SELECT ev.*, cp, mate, best_move, evaluated FROM ev LEFT JOIN evals USING (fen)",
}

USES = {"g": ["ev"], "p": ["ev", "g"], "own": ["ev"], "ee": ["ev", "evals"]}


def cte(name: str, text: str, *uses: str) -> None:
    """Add a shared table expression."""
    CTES[name] = text
    USES[name] = list(uses)


def _needs(name: str) -> list[str]:
    out: list[str] = []
    for used in USES.get(name, []):
        out += [n for n in _needs(used) + [used] if n not in out]
    return out


def oracle(name: str, text: str, *uses: str) -> None:
    names: list[str] = []
    for used in uses:
        names += [n for n in _needs(used) + [used] if n not in names]
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    ORACLES[name] = (f"WITH {head}\n" if names else "") + text


WINS = "CAST(sum(CASE WHEN result = 'win' THEN 1 ELSE 0 END) AS BIGINT)"
LOSSES = "CAST(sum(CASE WHEN result = 'loss' THEN 1 ELSE 0 END) AS BIGINT)"
DRAWS = "CAST(sum(CASE WHEN result = 'draw' THEN 1 ELSE 0 END) AS BIGINT)"
RATE = f"round(CAST({WINS} AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE), 1)"

oracle("move_events", "SELECT * EXCLUDE (gid) FROM ev", "ev")
oracle("games", "SELECT * EXCLUDE (gid, fen, move) FROM g", "g")
oracle("perspective", """SELECT game_id, player_id, color, opponent_id, my_rating, opp_rating, result, speed, date
FROM p""", "p")

OVERVIEW = f"""SELECT player_id, speed, count(*) AS total_games, {WINS} AS wins, {LOSSES} AS losses,
  {DRAWS} AS draws, round(avg(my_rating), 0) AS avg_rating FROM p GROUP BY player_id, speed"""
oracle("player_overview", OVERVIEW, "p")
cte("overview", OVERVIEW, "p")
cte("pt", """SELECT player_id, CAST(sum(total_games) AS BIGINT) AS total_games,
  CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(losses) AS BIGINT) AS losses, CAST(sum(draws) AS BIGINT) AS draws,
  round_even(sum(avg_rating * total_games) / CAST(sum(total_games) AS DOUBLE), 0) AS avg_rating,
  round_even(CAST(sum(wins) AS DOUBLE) * 100.0 / CAST(sum(total_games) AS DOUBLE), 1) AS win_pct
FROM overview GROUP BY player_id""", "overview")
oracle("player_totals", "SELECT * FROM pt", "pt")
oracle("player_totals_corrected", f"""SELECT player_id, count(*) AS total_games, {WINS} AS wins, {LOSSES} AS losses,
  {DRAWS} AS draws, round_even(avg(my_rating), 0) AS avg_rating,
  round_even(CAST({WINS} AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE), 1) AS win_pct
FROM p GROUP BY player_id""", "p")
oracle("time_pressure", f"""SELECT player_id, CASE WHEN clock_remaining < 1000 THEN 'under_10s' ELSE 'normal' END AS pressure,
  count(*) AS games, {WINS} AS wins, {RATE} AS win_rate_pct,
  round(avg(clock_remaining) / 100.0, 1) AS avg_clock_s
FROM p WHERE clock_remaining IS NOT NULL GROUP BY ALL""", "p")
oracle("time_pressure_own", f"""SELECT player_id, CASE WHEN clock < 1000 THEN 'under_10s' ELSE 'normal' END AS pressure,
  count(*) AS games, {WINS} AS wins, {RATE} AS win_rate_pct, round(avg(clock) / 100.0, 1) AS avg_clock_s
FROM (SELECT p.player_id, p.result, min(own.clock_remaining) AS clock
      FROM p JOIN own ON own.game_id = p.game_id AND own.player_id = p.player_id
      WHERE own.clock_remaining IS NOT NULL GROUP BY p.game_id, p.player_id, p.result)
GROUP BY ALL""", "p", "own")
oracle("opening_stats", f"""SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY player_id ORDER BY games DESC, opening_eco, opening_name) AS INT) AS rank
  FROM (SELECT player_id, opening_eco, opening_name, count(*) AS games, {WINS} AS wins, {RATE} AS win_rate_pct
        FROM p WHERE opening_eco IS NOT NULL GROUP BY ALL HAVING count(*) >= 2))
WHERE rank <= 10""", "p")
PHASE = "CASE WHEN move_number <= 10 THEN 'opening' WHEN move_number <= 30 THEN 'middlegame' ELSE 'endgame' END"
CLOCKS = f"""{PHASE} AS phase, round(avg(clock_remaining) / 100.0, 1) AS avg_clock_s,
  round(CAST(min(clock_remaining) AS DOUBLE) / 100.0, 1) AS min_clock_s, count(*) AS move_count"""
oracle("clock_by_phase", f"""SELECT player_id, {CLOCKS} FROM (
    SELECT white_id AS player_id, * FROM ev UNION ALL SELECT black_id, * FROM ev WHERE black_id <> white_id)
WHERE clock_remaining IS NOT NULL GROUP BY player_id, phase""", "ev")
oracle("clock_by_phase_own", f"""SELECT player_id, {CLOCKS} FROM own WHERE clock_remaining IS NOT NULL
GROUP BY player_id, phase""", "own")
oracle("by_color", f"""SELECT player_id, color, count(*) AS games, {WINS} AS wins, {RATE} AS win_rate_pct
FROM p GROUP BY player_id, color""", "p")
oracle("vs_rating", f"""SELECT player_id, CASE WHEN opp_rating < my_rating - 100 THEN 'lower_rated'
    WHEN opp_rating > my_rating + 100 THEN 'higher_rated' ELSE 'equal_rated' END AS opponent_class,
  count(*) AS games, {WINS} AS wins, {RATE} AS win_rate_pct FROM p GROUP BY ALL""", "p")
oracle("daily_volume", """SELECT date, count(DISTINCT game_id) AS games, count(*) AS moves
FROM ev GROUP BY date""", "ev")
oracle("recent_games", """SELECT * FROM (SELECT player_id,
  CAST(row_number() OVER (PARTITION BY player_id ORDER BY date DESC, game_id) AS INT) AS rank, game_id,
  opponent_id AS opponent, my_rating, opp_rating, opening_eco, opening_name, speed, winner, result, end_status, date
FROM p) WHERE rank <= 10""", "p")
oracle("game_replay", """SELECT game_id, move_number, whose_moved, move, fen,
  round(CAST(clock_remaining AS DOUBLE) / 100.0, 1) AS clock_s, white_id, black_id, white_rating, black_rating,
  opening_name, speed, winner, end_status FROM ev""", "ev")
oracle("merge_top_lists", """SELECT id, list_no, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY list_no, rank) AS n FROM (
    SELECT CAST(user_id AS VARCHAR) AS id,
      CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS INT) AS list_no,
      CAST(min(event_id) AS INT) AS rank
    FROM events GROUP BY ALL))
WHERE n = 1""")

# ---------------------------------------------------------------------------- evaluations

oracle("attach_evals", "SELECT game_id, move_number, fen, cp, mate, best_move FROM ee", "ee")
oracle("positions_to_eval", """SELECT DISTINCT fen AS position FROM ev WHERE fen NOT IN (
  SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size <> 1)""", "ev")


def _class(drop: str) -> str:
    return (f"CASE WHEN {drop} >= 200 THEN 'blunder' WHEN {drop} >= 100 THEN 'mistake' "
            f"WHEN {drop} >= 50 THEN 'inaccuracy' WHEN {drop} IS NOT NULL THEN 'good' END")


cte("jr", f"""SELECT *, {_class('-eval_delta')} AS classification FROM (
  SELECT *, cp - lag(cp) OVER (PARTITION BY game_id ORDER BY move_number) AS eval_delta FROM ee)""", "ee")
cte("jc", f"""SELECT *, {_class('loss')} AS classification FROM (
  SELECT *, CAST(CASE WHEN whose_moved = 'white' THEN cp - nxt ELSE nxt - cp END AS INT) AS loss, nxt - cp AS eval_delta
  FROM (SELECT *, lead(cp) OVER (PARTITION BY game_id ORDER BY move_number) AS nxt,
               CASE WHEN whose_moved = 'white' THEN white_id ELSE black_id END AS player_id FROM ee))""", "ee")
JUDGED = """SELECT game_id, move_number, whose_moved, move, cp AS eval_cp, eval_delta, best_move, classification,
  round(CAST(clock_remaining AS DOUBLE) / 100.0, 1) AS clock_s FROM """
oracle("judge_moves", JUDGED + "jr", "jr")
oracle("judge_moves_corrected", JUDGED + "jc", "jc")
oracle("game_judgement", """SELECT game_id, count(*) FILTER (classification = 'blunder') AS blunders,
  count(*) FILTER (classification = 'mistake') AS mistakes,
  count(*) FILTER (classification = 'inaccuracy') AS inaccuracies, count(*) AS total_moves,
  coalesce(any_value(winner), 'draw') AS result FROM jr GROUP BY game_id""", "jr")
cte("curve", """SELECT game_id, move_number, CAST(CASE WHEN mate > 0 THEN 3000 WHEN mate < 0 THEN -3000
  ELSE coalesce(cp, 0) END AS DOUBLE) / 100.0 AS eval FROM ee WHERE evaluated""", "ee")
oracle("eval_curve", "SELECT * FROM curve", "curve")
oracle("eval_swings", """SELECT *, CASE WHEN swing > 2.0 THEN 'red' WHEN swing > 0.5 THEN 'green' ELSE 'blue' END AS color
FROM (SELECT *, round(abs(eval - lag(eval, 1, 0.0) OVER (PARTITION BY game_id ORDER BY move_number)), 6) AS swing
      FROM curve)""", "curve")
oracle("eval_label", """SELECT fen, CASE WHEN cp IS NULL THEN 'unknown'
  WHEN cp > 300 THEN concat('+', printf('%.1f', cp / 100.0), ' — White is winning')
  WHEN cp < -300 THEN concat(printf('%.1f', cp / 100.0), ' — Black is winning')
  ELSE concat(CASE WHEN cp >= 0 THEN '+' ELSE '' END, printf('%.1f', cp / 100.0), ' — Balanced') END AS label
FROM evals""", "evals")
oracle("opening_label", """SELECT game_id, CASE WHEN opening_eco IS NULL THEN ''
  ELSE opening_eco || ' — ' || substr(opening_name, 1, 25) END AS label FROM g""", "g")
oracle("game_digest", """SELECT game_id, concat('Game ID: ', game_id, chr(10), 'Players: ', any_value(white_id), ' (White, ',
    any_value(white_rating), ') vs ', any_value(black_id), ' (Black, ', any_value(black_rating), ')', chr(10),
    'Opening: ', coalesce(any_value(opening_name), 'None'), ' (', coalesce(any_value(opening_eco), 'None'),
    '), Speed: ', any_value(speed), chr(10),
    'Result: ', CASE any_value(winner) WHEN 'white' THEN 'White wins' WHEN 'black' THEN 'Black wins' ELSE 'Draw' END,
    chr(10), chr(10), 'Move-by-move evaluations (centipawns, positive = White advantage):', chr(10),
    string_agg(concat('  Move ', move_number, ' (', upper(whose_moved[1]), ') ', move, ': eval=',
      CASE WHEN mate IS NOT NULL THEN concat('Mate in ', abs(mate))
           WHEN cp IS NOT NULL THEN concat(CASE WHEN cp >= 0 THEN '+' ELSE '' END, printf('%.2f', cp / 100.0))
           ELSE '?' END), chr(10) ORDER BY move_number)) AS digest
FROM ee GROUP BY game_id""", "ee")
cte("chance", """SELECT *, CASE WHEN mate > 0 THEN 1.0::DOUBLE WHEN mate IS NOT NULL THEN 0.0::DOUBLE
  ELSE 1.0::DOUBLE / (1.0 + exp(-0.00368208::DOUBLE * cp)) END AS ch FROM ee""", "ee")
oracle("win_probability", """SELECT game_id, move_number, round(ch, 6) AS white_chance, round(nxt, 6) AS white_chance_after,
  round(CASE WHEN whose_moved = 'white' THEN ch - nxt ELSE nxt - ch END, 6) AS chance_lost
FROM (SELECT *, lead(ch) OVER (PARTITION BY game_id ORDER BY move_number) AS nxt FROM chance)""", "chance")
oracle("turning_point", """SELECT game_id, move_number, move_number - 1 AS ply_before, whose_moved, player_id, loss,
  loss >= 200 AS decisive
FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY loss DESC, move_number) AS n
      FROM jc WHERE loss IS NOT NULL) WHERE n = 1""", "jc")
oracle("winning_not_won", """SELECT game_id, player_id, color, min(move_number) AS first_ply, max(own_cp) AS best_cp,
  CASE WHEN any_value(winner) IS NULL THEN 'draw' ELSE 'loss' END AS result
FROM (SELECT game_id, move_number, winner, white_id AS player_id, 'white' AS color, cp AS own_cp FROM ee
      UNION ALL SELECT game_id, move_number, winner, black_id, 'black', -cp FROM ee)
WHERE own_cp > 200 AND (winner IS NULL OR winner <> color) GROUP BY game_id, player_id, color""", "ee")

# ---------------------------------------------------------------------------- landing and the fact

cte("starts", """SELECT CAST(o_orderkey AS VARCHAR) AS game_id,
  concat(CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR), 'T23:59:30Z') AS timestamp,
  CASE WHEN o_orderkey % 2 = 0 THEN 'blitz' ELSE 'rapid' END AS speed, o_orderkey % 3 = 0 AS rated,
  'standard' AS variant, CAST(o_custkey % 50 AS VARCHAR) AS white_id,
  CAST(1200 + CAST(floor(o_totalprice) AS BIGINT) % 800 AS INT) AS white_rating,
  CAST(NULL AS VARCHAR) AS white_title, CAST((o_custkey * 7 + o_orderkey) % 50 AS VARCHAR) AS black_id,
  CAST(1200 + CAST(floor(o_totalprice / 7) AS BIGINT) % 800 AS INT) AS black_rating,
  CAST(NULL AS VARCHAR) AS black_title, 'pool' AS source, CAST(NULL AS VARCHAR) AS tournament_id,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS date
FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 5 = 0)""")
oracle("decode_starts", "SELECT * FROM starts", "starts")
oracle("land_events", "SELECT * FROM starts", "starts")
cte("broken", """SELECT CASE event_id % 3 WHEN 0 THEN concat('not json ', event_id) WHEN 1 THEN concat('{"game_id": "', event_id, '"}')
  ELSE concat('{"timestamp": "2026-01-01T00:00:00Z", "n": ', event_id, '}') END AS value FROM events""")
oracle("land_quarantine", "SELECT value FROM broken", "broken")
oracle("land_counts", """SELECT kind, (SELECT count(*) FROM starts) + (SELECT count(*) FROM broken) AS messages, n AS reported, n AS held
FROM (SELECT 'landed' AS kind, count(*) AS n FROM starts UNION ALL SELECT 'quarantined', count(*) FROM broken)""", "starts", "broken")
oracle("event_date", """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
oracle("decode_props", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events")
cte("raw", """SELECT *, CASE event_type WHEN 'signup' THEN 'started' WHEN 'click' THEN 'created' WHEN 'error' THEN 'resign'
  WHEN 'purchase' THEN 'draw' END AS st FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0""")
cte("rs", """SELECT concat('g', event_id) AS game_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
  'blitz' AS speed, event_id % 2 = 0 AS rated, 'standard' AS variant,
  concat(CASE event_id % 4 WHEN 0 THEN 'u' WHEN 1 THEN 'n' ELSE 'i' END, user_id) AS white_id,
  CAST(1000 + event_id % 900 AS INT) AS white_rating, CASE WHEN event_id % 5 = 0 THEN 'GM' ELSE 'IM' END AS white_title,
  concat(CASE event_id % 4 WHEN 2 THEN 'u' WHEN 1 THEN 'n' ELSE 'i' END, user_id) AS black_id,
  CAST(1000 + event_id % 900 AS INT) AS black_rating, CASE WHEN event_id % 5 = 0 THEN 'GM' ELSE 'IM' END AS black_title,
  'pool' AS source, CASE WHEN event_id % 10 = 0 THEN 't1' END AS tournament_id
FROM raw WHERE st = 'started'""", "raw")
oracle("route_starts", "SELECT * FROM rs", "rs")
oracle("route_ends", """SELECT concat('g', event_id) AS game_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
  CASE WHEN event_id % 2 = 0 THEN 'white' END AS winner, st AS status
FROM raw WHERE st NOT IN ('started', 'created')""", "raw")
cte("tok", """SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_shipdate, l_extendedprice, l_quantity) AS INT) AS move_number FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
cte("exp", """SELECT CAST(o_orderkey AS VARCHAR) AS game_id, move_number, CAST(l_suppkey % 10 AS VARCHAR) AS move,
  CAST(NULL AS VARCHAR) AS fen, CASE WHEN move_number % 2 = 1 THEN 'white' ELSE 'black' END AS whose_moved,
  CAST(CASE WHEN move_number <= 5 THEN l_quantity * 100 END AS INT) AS clock_remaining,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN concat('C', substr(o_orderpriority, 1, 1), '0') END AS opening_eco,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN substr(o_orderpriority, 3) END AS opening_name,
  CAST(300 AS INT) AS clock_initial, CAST(o_orderkey % 3 AS INT) AS clock_increment,
  CASE WHEN o_orderkey % 2 = 0 THEN 'blitz' ELSE 'rapid' END AS speed, o_orderkey, o_orderstatus,
  CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS date, o_custkey, o_totalprice,
  o_orderdate, l_partkey, count(*) OVER (PARTITION BY o_orderkey) AS plies FROM tok""", "tok")
oracle("explode_moves", """SELECT game_id, move_number, move, whose_moved, clock_remaining, opening_eco, clock_increment
FROM exp""", "exp")
def _built(move: str, fen: str, truncated: str) -> str:
    return f"""SELECT e.game_id, move_number, {move} AS move, {fen} AS fen, whose_moved, clock_remaining, opening_eco, opening_name,
  clock_initial, clock_increment, e.speed, e.speed AS perf, 'standard' AS variant, white_id, white_rating, white_title, black_id,
  black_rating, black_title, tournament_id,
  CASE WHEN o_orderstatus = 'F' THEN 'white' WHEN o_orderstatus = 'O' THEN 'black' END AS winner,
  CASE WHEN o_orderstatus = 'P' THEN 'draw' ELSE 'mate' END AS end_status, e.date,
  FALSE AS is_check, FALSE AS is_capture, {truncated} AS truncated
FROM exp e JOIN (SELECT DISTINCT * FROM starts) s ON s.game_id = e.game_id"""


oracle("build_move_events", _built("concat('u', move)", "CAST(l_partkey AS VARCHAR)", "o_orderkey % 7 = 0 AND plies > 3")
       + " WHERE o_orderkey % 3 <> 0 AND NOT (o_orderkey % 7 = 0 AND move_number > 3)", "exp", "starts")
oracle("build_move_events_midnight", _built("move", "fen", "FALSE"), "exp", "starts")
oracle("scan_partition", "SELECT date, count(*) AS starts, count(DISTINCT game_id) AS games FROM starts GROUP BY date", "starts")
oracle("publish_roundtrip", "SELECT * EXCLUDE (gid, date), concat(substr(date, 1, 7), '-01') AS date FROM ev", "ev")
oracle("published_games", """SELECT * EXCLUDE (gid, date, winner, move_number, move, fen, whose_moved, clock_remaining), concat(substr(date, 1, 7), '-01') AS date,
  CASE WHEN substr(date, 6, 2) = '01' THEN 'white' ELSE winner END AS winner FROM g""", "g")
oracle("read_exports", """SELECT game_id AS id, string_agg(move, ' ' ORDER BY move_number) AS moves,
  list(clock_remaining ORDER BY move_number) FILTER (move_number <= 5) AS clocks,
  CASE WHEN any_value(o_orderstatus) = 'P' THEN 'draw' ELSE 'mate' END AS status, any_value(opening_eco) AS eco
FROM exp GROUP BY game_id""", "exp")
oracle("csv_roundtrip", "SELECT * FROM overview", "overview")
oracle("export_requests", """SELECT CAST(o_orderkey AS VARCHAR) AS game_id, TRUE AS fits FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
cte("seen", "SELECT DISTINCT white_id AS player_id FROM starts UNION SELECT DISTINCT black_id FROM starts", "starts")
oracle("new_players", "SELECT player_id FROM seen WHERE player_id NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)",
       "seen")
oracle("discover_players", "SELECT player_id FROM seen", "seen")
oracle("replay", """SELECT CAST(gid AS VARCHAR) AS game_id, ply + 1 AS move_number,
  CASE ply % 4 WHEN 0 THEN 'g1' || out_to || '3' WHEN 1 THEN 'g8' || out_to || '6' WHEN 2 THEN w || '3g1' ELSE b || '6g8' END AS move,
  concat('rnbqkb', CASE WHEN ply % 4 IN (2, 3) THEN '1r' ELSE 'nr' END, '/pppppppp/',
    CASE WHEN ply % 4 NOT IN (2, 3) THEN '8' WHEN b = 'f' THEN '5n2' ELSE '7n' END, '/8/8/',
    CASE WHEN ply % 4 NOT IN (1, 2) THEN '8' WHEN w = 'f' THEN '5N2' ELSE '7N' END, '/PPPPPPPP/RNBQKB',
    CASE WHEN ply % 4 IN (1, 2) THEN '1R' ELSE 'NR' END, CASE WHEN ply % 2 = 0 THEN ' w' ELSE ' b' END,
    ' KQkq - ', ply, ' ', ply // 2 + 1) AS fen,
  CASE WHEN ply % 2 = 0 THEN 'white' ELSE 'black' END AS whose_moved, FALSE AS is_check, FALSE AS is_capture,
  gid % 7 = 0 AND plies > 8 AS truncated
FROM (SELECT *, CASE ply % 4 WHEN 1 THEN lag(out_to, 1) OVER g WHEN 2 THEN lag(out_to, 2) OVER g ELSE NULL END AS w,
             CASE ply % 4 WHEN 2 THEN lag(out_to, 1) OVER g WHEN 3 THEN lag(out_to, 2) OVER g ELSE NULL END AS b
      FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'f' ELSE 'h' END AS out_to,
                   CAST(row_number() OVER (PARTITION BY gid ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                        l_shipdate, l_extendedprice, l_quantity) - 1 AS INT) AS ply, count(*) OVER (PARTITION BY gid) AS plies
            FROM (SELECT *, CAST(floor(l_orderkey / 10) AS BIGINT) AS gid FROM lineitem))
      WINDOW g AS (PARTITION BY gid ORDER BY ply))
WHERE NOT (gid % 7 = 0 AND ply >= 8)""")

oracle("live_board", """SELECT CAST(gid AS VARCHAR) AS game_id,
  CASE n % 4 WHEN 1 THEN 'g1' || outs[n] || '3' WHEN 2 THEN 'g8' || outs[n] || '6' WHEN 3 THEN outs[n - 2] || '3g1'
    ELSE outs[n - 2] || '6g8' END AS move,
  concat('rnbqkb', CASE WHEN n % 4 IN (2, 3) THEN '1r' ELSE 'nr' END, '/pppppppp/',
    CASE n % 4 WHEN 2 THEN black_out[outs[n]] WHEN 3 THEN black_out[outs[n - 1]] ELSE '8' END, '/8/8/',
    CASE n % 4 WHEN 1 THEN upper(black_out[outs[n]]) WHEN 2 THEN upper(black_out[outs[n - 1]]) ELSE '8' END,
    '/PPPPPPPP/RNBQKB', CASE WHEN n % 4 IN (1, 2) THEN '1R' ELSE 'NR' END, CASE WHEN n % 2 = 0 THEN ' w' ELSE ' b' END,
    ' KQkq - ', n, ' ', n // 2 + 1) AS fen, FALSE AS is_check
FROM (SELECT CAST(floor(l_orderkey / 10) AS BIGINT) AS gid, count(*) AS n,
        list(CASE WHEN l_suppkey % 2 = 0 THEN 'f' ELSE 'h' END ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
             l_shipdate, l_extendedprice, l_quantity) AS outs, MAP {'f': '5n2', 'h': '7n'} AS black_out
      FROM lineitem GROUP BY gid)""")

# ---------------------------------------------------------------------------- streams

cte("live", """SELECT CAST(user_id AS VARCHAR) AS game_id, event_id, ts, CAST(event_id % 80 + 1 AS INT) AS ply,
  CAST(floor(value) AS INT) AS white_clock, CAST(floor(value / 2) AS INT) AS black_clock,
  CASE WHEN event_id % 2 = 0 THEN 'white' ELSE 'black' END AS whose_moved FROM events""")
LIVE = """SELECT game_id, event_id, ts, ply, CAST(ply // 2 + 1 AS INT) AS move_number,
  CASE WHEN ply <= 20 THEN 'opening' WHEN ply <= 60 THEN 'middlegame' ELSE 'endgame' END AS game_phase, whose_moved,
  white_clock, black_clock, white_clock < 10 OR black_clock < 10 AS time_pressure,
  CASE WHEN whose_moved = 'white' THEN nullif(pw, 0) - white_clock ELSE nullif(pb, 0) - black_clock END AS time_spent_s
FROM (SELECT *, lag(white_clock) OVER g AS pw, lag(black_clock) OVER g AS pb FROM live
      WINDOW g AS (PARTITION BY game_id ORDER BY ts, event_id))"""
oracle("time_spent", LIVE, "live")
oracle("live_features", LIVE, "live")
oracle("new_games", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS game_id FROM events")
oracle("time_spent_fact", """SELECT game_id, move_number, whose_moved, clock_remaining,
  lag(clock_remaining, 2) OVER (PARTITION BY game_id ORDER BY move_number) - clock_remaining + clock_increment * 100 AS time_spent_cs
FROM ev""", "ev")

oracle("run_sql", """SELECT speed, substr(date, 1, 7) AS month, count(*) AS games, round(avg(white_rating + black_rating) / 2, 3) AS mean_rating,
  min(clock_remaining) AS least_clock, round(count(*) FILTER (winner IS NULL) / count(*), 6) AS drawn_share
FROM g GROUP BY ALL""", "g")

# ---------------------------------------------------------------------------- documented analytics

oracle("dim_players", """SELECT player_id, min(ts) AS created_at, max(ts) AS last_seen_at,
  arg_max(title, (ts, title)) AS title
FROM (SELECT white_id AS player_id, white_title AS title, CAST(timestamp AS TIMESTAMP) AS ts FROM rs
      UNION ALL SELECT black_id, black_title, CAST(timestamp AS TIMESTAMP) FROM rs) GROUP BY player_id""", "rs")
oracle("dim_games", """SELECT s.game_id, white_id, black_id, speed, rated,
  CASE WHEN o_orderstatus = 'F' THEN 'white' WHEN o_orderstatus = 'O' THEN 'black' END AS winner,
  CASE WHEN o_orderstatus = 'P' THEN 'draw' ELSE 'mate' END AS status,
  CASE WHEN total_moves > 0 AND o_orderpriority <> '4-NOT SPECIFIED' THEN concat('C', substr(o_orderpriority, 1, 1), '0') END AS opening_eco,
  CASE WHEN total_moves > 0 AND o_orderpriority <> '4-NOT SPECIFIED' THEN substr(o_orderpriority, 3) END AS opening_name,
  total_moves, CAST(s.timestamp AS TIMESTAMP) AS started_at,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(s.date AS TIMESTAMP) + INTERVAL 1 DAY + INTERVAL 10 MINUTE
       ELSE CAST(s.date AS TIMESTAMP) + INTERVAL 86390 SECOND END AS ended_at
FROM (SELECT DISTINCT * FROM starts) s JOIN orders ON CAST(o_orderkey AS VARCHAR) = s.game_id
LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS INT) AS total_moves FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""", "starts")
oracle("fact_moves", """SELECT game_id, move_number, CASE WHEN whose_moved = 'white' THEN white_id ELSE black_id END AS player_id,
  move AS move_uci, lead(fen) OVER g AS fen_after, clock_remaining,
  lag(clock_remaining, 2) OVER g - clock_remaining + clock_increment * 100 AS time_spent_cs,
  clock_remaining < 1000 AS time_pressure,
  CASE WHEN move_number <= 20 THEN 'opening' WHEN move_number <= 60 THEN 'middlegame' ELSE 'endgame' END AS game_phase
FROM ev WINDOW g AS (PARTITION BY game_id ORDER BY move_number)""", "ev")
cte("lines", """SELECT game_id, move_number, string_agg(move, ' ') OVER (PARTITION BY game_id ORDER BY move_number) AS prefix
FROM exp""", "exp")
cte("book", """SELECT trim(regexp_replace(CAST(p_partkey AS VARCHAR), '(.)', '\\1 ', 'g')) AS prefix,
  length(CAST(p_partkey AS VARCHAR)) AS ply, concat('B', lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0')) AS eco, p_name AS name
FROM part""")
oracle("opening_lookup", """SELECT game_id, arg_max(eco, ply) AS opening_eco, arg_max(name, ply) AS opening_name,
  CAST(max(ply) AS INT) AS opening_ply FROM lines LEFT JOIN book USING (prefix) GROUP BY game_id""", "lines", "book")
OUTCOMES = """count(*) AS games, count(*) FILTER (winner = 'white') AS white_wins,
  count(*) FILTER (winner IS NULL) AS draws, count(*) FILTER (winner = 'black') AS black_wins"""
oracle("eco_rollup", f"""SELECT substr(opening_eco, 1, 1) AS family, opening_eco AS eco,
  CAST(grouping(substr(opening_eco, 1, 1), opening_eco) AS INT) AS level, {OUTCOMES}
FROM g WHERE opening_eco IS NOT NULL GROUP BY ROLLUP (substr(opening_eco, 1, 1), opening_eco)""", "g")
cte("bands", f"""SELECT speed, band, opening_eco, opening_name, games,
  round(CAST(white_wins AS DOUBLE) * 100.0 / CAST(games AS DOUBLE), 1) AS white_pct,
  round(CAST(draws AS DOUBLE) * 100.0 / CAST(games AS DOUBLE), 1) AS draw_pct,
  round(CAST(black_wins AS DOUBLE) * 100.0 / CAST(games AS DOUBLE), 1) AS black_pct
FROM (SELECT speed, CAST(floor((white_rating + black_rating) / 2 / 200) * 200 AS INT) AS band, opening_eco,
        opening_name, {OUTCOMES} FROM g WHERE opening_eco IS NOT NULL GROUP BY ALL)""", "g")
oracle("opening_by_band", "SELECT * FROM bands", "bands")
cte("nm", """SELECT * FROM (
  SELECT *, round(CAST(n AS DOUBLE) * 100.0 / CAST(sum(n) OVER (PARTITION BY opening_eco, opening_name, after_ply) AS DOUBLE), 1) AS share_pct,
    CAST(row_number() OVER (PARTITION BY opening_eco, opening_name, after_ply ORDER BY n DESC, move) AS INT) AS rank
  FROM (SELECT opening_eco, opening_name, CAST(move_number - 1 AS INT) AS after_ply, move, count(*) AS n
        FROM ev WHERE opening_eco IS NOT NULL GROUP BY ALL)) WHERE rank <= 3""", "ev")
oracle("next_moves", "SELECT * FROM nm", "nm")
cte("nao", """SELECT * FROM (
  SELECT *, round(CAST(n AS DOUBLE) * 100.0 / CAST(sum(n) OVER (PARTITION BY speed, band, opening_eco, opening_name) AS DOUBLE), 1) AS share_pct,
    CAST(row_number() OVER (PARTITION BY speed, band, opening_eco, opening_name ORDER BY n DESC, move) AS INT) AS rank
  FROM (SELECT speed, CAST(floor((white_rating + black_rating) / 2 / 200) * 200 AS INT) AS band, opening_eco, opening_name, move, count(*) AS n
        FROM ev WHERE opening_eco IS NOT NULL AND move_number = 3 + gid % 5 GROUP BY ALL)) WHERE rank <= 3""", "ev")
oracle("next_after_opening", "SELECT * FROM nao", "nao")
oracle("stat_chunks", """SELECT b.opening_eco, b.speed, b.band, concat(b.opening_name, ' at ', b.speed, ' rating ', b.band, '-', b.band + 200,
  ': played ', games, ' times, White won ', printf('%.1f', white_pct), '%, drawn ', printf('%.1f', draw_pct),
  '%, Black won ', printf('%.1f', black_pct), '%. Most frequent next moves: ', coalesce(nexts, 'none')) AS chunk
FROM bands b LEFT JOIN (
  SELECT speed, band, opening_eco, opening_name, string_agg(concat(move, ' (', printf('%.1f', share_pct), '%)'), ', ' ORDER BY rank) AS nexts
  FROM nao GROUP BY ALL) n ON n.opening_eco = b.opening_eco AND n.opening_name = b.opening_name AND n.speed = b.speed AND n.band = b.band""", "bands", "nao")
cte("cells", f"""SELECT player_id, whose_moved AS color, {PHASE} AS phase,
  CASE WHEN clock_remaining < 1000 THEN '<10' WHEN clock_remaining < 2000 THEN '10-20' WHEN clock_remaining < 3000 THEN '20-30'
       ELSE '>=30' END AS clock, count(*) AS plies, count(*) FILTER (loss >= 100) AS errors
FROM jc WHERE loss IS NOT NULL AND clock_remaining IS NOT NULL GROUP BY ALL""", "jc")
oracle("error_profile", """SELECT player_id, color, phase, clock, plies, errors, round(errors / plies, 6) AS error_rate,
  round(errors / nullif(sum(errors) OVER (PARTITION BY player_id), 0), 6) AS share_of_errors,
  pr = max(pr) OVER (PARTITION BY player_id) AS weak_phase
FROM (SELECT *, sum(errors) OVER (PARTITION BY player_id, phase) / sum(plies) OVER (PARTITION BY player_id, phase) AS pr
      FROM cells)""", "cells")
cte("cur", "SELECT player_id, speed, arg_max(my_rating, (date, game_id)) AS rating FROM p GROUP BY ALL", "p")
oracle("similar_players", """SELECT * FROM (SELECT a.player_id, a.speed, CAST(a.rating // 100 * 100 AS INT) AS band, a.rating,
  CAST(row_number() OVER (PARTITION BY a.player_id, a.speed ORDER BY abs(a.rating - b.rating), b.player_id) AS INT) AS rank,
  b.player_id AS similar_id, b.rating AS similar_rating
FROM cur a JOIN cur b ON a.speed = b.speed AND a.rating // 100 = b.rating // 100 AND a.player_id <> b.player_id)
WHERE rank <= 5""", "cur")
cte("pc", f"""SELECT o.game_id, o.player_id, {PHASE} AS phase, any_value(p.result) AS result,
  CASE WHEN min(o.clock_remaining) < 1500 THEN '<15' WHEN min(o.clock_remaining) < 3000 THEN '15-30' ELSE '>=30' END AS clock
FROM own o JOIN p ON p.game_id = o.game_id AND p.player_id = o.player_id
WHERE o.clock_remaining IS NOT NULL GROUP BY 1, 2, 3""".replace("move_number", "o.move_number"), "own", "p")
oracle("win_by_clock_phase", f"""SELECT player_id, phase, clock, count(*) AS games, {WINS} AS wins, {RATE} AS win_pct
FROM pc GROUP BY player_id, phase, clock""", "pc")
oracle("weakness_ranking", """SELECT * FROM (
  SELECT player_id, kind, label, games, losses, impact,
    CAST(row_number() OVER (PARTITION BY player_id ORDER BY impact DESC, kind, label) AS INT) AS rank
  FROM (SELECT l.*, round(losses - games * base, 6) AS impact
    FROM (SELECT player_id, kind, label, count(*) AS games, count(*) FILTER (result = 'loss') AS losses FROM (
            SELECT player_id, result, 'opening' AS kind, opening_eco || ' ' || color AS label FROM p WHERE opening_eco IS NOT NULL
            UNION ALL SELECT player_id, result, 'opponent', CASE WHEN opp_rating < my_rating - 100 THEN 'lower_rated'
              WHEN opp_rating > my_rating + 100 THEN 'higher_rated' ELSE 'equal_rated' END FROM p
            UNION ALL SELECT player_id, result, 'clock', phase || ' ' || clock FROM pc) GROUP BY ALL HAVING count(*) >= 5) l
    JOIN (SELECT player_id, count(*) FILTER (result = 'loss') / count(*) AS base FROM p GROUP BY 1) b
      ON b.player_id = l.player_id))
WHERE rank <= 3""", "p", "pc")
cte("drills", """SELECT player_id, rank, game_id, date, move_number, fen, move, best_move, loss,
  round(CAST(clock_remaining AS DOUBLE) / 100.0, 1) AS clock_s
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY player_id ORDER BY loss DESC, date, game_id, move_number) AS INT) AS rank
      FROM jc WHERE move <> best_move AND loss >= 100 AND clock_remaining < 1500) WHERE rank <= 7""", "jc")
oracle("drill_positions", "SELECT * FROM drills", "drills")
oracle("drill_summary", """SELECT session_id, given, count(*) AS attempts, count(*) FILTER (outcome = 'in_time') AS in_time,
  count(*) FILTER (outcome = 'late') AS late, count(*) FILTER (outcome = 'wrong') AS wrong,
  count(*) FILTER (outcome = 'skipped') AS skipped,
  round(CAST(count(*) FILTER (outcome = 'in_time') AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE), 1) AS accuracy_pct
FROM (SELECT concat('s', player_id) AS session_id, CASE move_number % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN 'wrong'
        ELSE CASE WHEN move_number % 16 <= clock_s THEN 'in_time' ELSE 'late' END END AS outcome,
        unnest([CASE WHEN clock_s < 10 THEN '<10' WHEN clock_s <= 15 THEN '10-15' ELSE '>15' END, 'all']) AS given
      FROM drills) GROUP BY session_id, given""", "drills")
oracle("repeat_errors", """SELECT player_id, opening_eco, substr(date, 1, 7) AS month, date, game_id, move_number, loss,
  row_number() OVER (PARTITION BY player_id, opening_eco, substr(date, 1, 7) ORDER BY date, game_id, move_number) AS nth
FROM jc WHERE loss >= 100 AND opening_eco IS NOT NULL""", "jc")
cte("ts", """SELECT *, CASE WHEN whose_moved = 'white' THEN white_id ELSE black_id END AS player_id,
  lag(clock_remaining, 2) OVER (PARTITION BY game_id ORDER BY move_number) - clock_remaining + clock_increment * 100 AS spent
FROM ev""", "ev")
oracle("tilt", """SELECT player_id, count(*) FILTER (tilted) AS tilt_games,
  round(sum(s) FILTER (tilted) / sum(n) FILTER (tilted), 6) AS tilt_cs,
  round(sum(s) FILTER (NOT tilted) / sum(n) FILTER (NOT tilted), 6) AS other_cs,
  round((sum(s) FILTER (tilted) / sum(n) FILTER (tilted)) / (sum(s) FILTER (NOT tilted) / sum(n) FILTER (NOT tilted)), 6) AS ratio
FROM (SELECT player_id, game_id, count(*) OVER w = 3 AND count(*) FILTER (result = 'loss') OVER w = 3 AS tilted
      FROM p WINDOW w AS (PARTITION BY player_id ORDER BY date, game_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) t
JOIN (SELECT game_id, player_id, sum(spent) AS s, count(spent) AS n FROM ts GROUP BY ALL) USING (game_id, player_id)
GROUP BY player_id""", "p", "ts")
oracle("book_exit", """SELECT game_id, whose_moved, min(move_number) AS exit_ply, any_value(player_id) AS player_id
FROM (SELECT *, row_number() OVER w AS own_ply, avg(spent) OVER (PARTITION BY game_id, whose_moved ORDER BY move_number
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean
      FROM ts WINDOW w AS (PARTITION BY game_id, whose_moved ORDER BY move_number))
WHERE own_ply >= 4 AND mean > 0 AND spent >= 3 * mean GROUP BY game_id, whose_moved""", "ts")
oracle("pressure_threshold", """SELECT t.player_id, error_rate, threshold_s, inaccuracy_cut, mistake_cut, blunder_cut
FROM (SELECT player_id, round(max(base), 6) AS error_rate,
        CAST((max(CASE WHEN plies >= 20 AND errors / plies > 1.5 * base THEN bucket END) + 1) * 5 AS INT) AS threshold_s
      FROM (SELECT *, sum(errors) OVER (PARTITION BY player_id) / sum(plies) OVER (PARTITION BY player_id) AS base
            FROM (SELECT player_id, clock_remaining // 500 AS bucket, count(*) AS plies, count(*) FILTER (loss >= 100) AS errors
                  FROM jc WHERE loss IS NOT NULL AND clock_remaining IS NOT NULL GROUP BY ALL)) GROUP BY player_id) t
LEFT JOIN (SELECT player_id, round(quantile_cont(loss, 0.75), 6) AS inaccuracy_cut, round(quantile_cont(loss, 0.9), 6) AS mistake_cut,
             round(quantile_cont(loss, 0.97), 6) AS blunder_cut FROM jc WHERE loss > 0 GROUP BY player_id) c
ON c.player_id = t.player_id""", "jc")
oracle("similar_positions", """SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
    CAST((SELECT arg_min(embedding, vec_id) FROM embeddings) AS DOUBLE[])), 6) AS similarity
FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 5""")
oracle("similar_positions_all", """SELECT query_id, CAST(rank AS INT) AS rank, vec_id, label, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS similarity
    FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id))
WHERE rank <= 5""")
oracle("claim_accuracy", """SELECT metric, count(*) AS claims, count(fact) AS grounded,
  count(*) FILTER (abs(value - fact) <= 5.0) AS accurate, round(count(fact) / count(*), 6) AS grounded_share,
  round(count(*) FILTER (abs(value - fact) <= 5.0) / nullif(count(fact), 0), 6) AS accurate_share
FROM (SELECT c_custkey % 60 AS k, CASE WHEN c_custkey % 2 = 0 THEN 'games' ELSE 'win_pct' END AS metric,
        20 + c_custkey % 45 AS value,
        CASE WHEN c_custkey % 2 = 0 THEN CAST(total_games AS DOUBLE) ELSE win_pct END AS fact
      FROM customer LEFT JOIN pt ON player_id = CAST(c_custkey % 60 AS VARCHAR)) GROUP BY metric""", "pt")
oracle("detection_quality", """SELECT hits, said, present, round(hits / nullif(said, 0), 6) AS precision, round(hits / nullif(present, 0), 6) AS recall
FROM (SELECT count(*) FILTER (a.classification = 'blunder' AND b.classification = 'blunder') AS hits,
        count(*) FILTER (a.classification = 'blunder') AS said, count(*) FILTER (b.classification = 'blunder') AS present
      FROM jr a JOIN jc b ON a.game_id = b.game_id AND a.move_number = b.move_number)""", "jr", "jc")
oracle("rating_change", """SELECT player_id, arg_min(my_rating, (date, game_id)) AS rating_before,
  arg_max(my_rating, (date, game_id)) AS rating_after,
  arg_max(my_rating, (date, game_id)) - arg_min(my_rating, (date, game_id)) AS change
FROM (SELECT *, max(date) OVER (PARTITION BY player_id) AS until FROM p)
WHERE CAST(until AS DATE) - CAST(date AS DATE) <= 30 GROUP BY player_id""", "p")
oracle("backfill_union", """SELECT game_id, move_number, move, CAST(o_custkey % 50 AS VARCHAR) AS white_id,
  CAST(1200 + CAST(floor(o_totalprice) AS BIGINT) % 800 AS INT) AS white_rating,
  CASE WHEN o_orderstatus = 'F' THEN 'white' WHEN o_orderstatus = 'O' THEN 'black' END AS winner, date,
  CAST(CASE WHEN o_orderkey % 3 = 0 AND opening_eco IS NOT NULL THEN 4 END AS INT) AS opening_ply,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 21 - 10 END AS INT) AS white_rating_diff FROM exp""", "exp")
oracle("read_pgn", """SELECT concat('g', o_orderkey) AS game_id,
  string_agg(concat('Nf', l_suppkey % 10), ' ' ORDER BY move_number) AS moves,
  list(CAST(l_quantity AS INT) * 100 ORDER BY move_number) AS clocks,
  CASE WHEN any_value(o_orderpriority) <> '4-NOT SPECIFIED' THEN concat('C', substr(any_value(o_orderpriority), 1, 1), '0') END AS opening_eco,
  CASE WHEN any_value(o_orderpriority) <> '4-NOT SPECIFIED' THEN substr(any_value(o_orderpriority), 3) END AS opening_name,
  CAST(60 AS INT) AS clock_initial, CAST(o_orderkey % 12 AS INT) AS clock_increment,
  CASE WHEN o_orderkey % 12 < 3 THEN 'bullet' WHEN o_orderkey % 12 < 11 THEN 'blitz' ELSE 'rapid' END AS speed,
  CASE WHEN o_orderkey % 12 < 3 THEN 'bullet' WHEN o_orderkey % 12 < 11 THEN 'blitz' ELSE 'rapid' END AS perf,
  'standard' AS variant, concat('player', any_value(o_custkey) % 50) AS white_id,
  CAST(1200 + CAST(floor(any_value(o_totalprice)) AS BIGINT) % 800 AS INT) AS white_rating,
  CAST(NULL AS VARCHAR) AS white_title, CAST(o_orderkey % 21 - 10 AS INT) AS white_rating_diff,
  concat('player', (any_value(o_custkey) * 7 + o_orderkey) % 50) AS black_id, CAST(NULL AS INT) AS black_rating,
  CASE WHEN o_orderkey % 9 = 0 THEN 'IM' END AS black_title, CAST(NULL AS INT) AS black_rating_diff,
  CASE any_value(o_orderstatus) WHEN 'F' THEN 'white' WHEN 'O' THEN 'black' END AS winner, 'normal' AS end_status,
  CAST(CAST(any_value(o_orderdate) AS DATE) AS VARCHAR) AS date
FROM tok GROUP BY o_orderkey""", "tok")
oracle("best_evals", """SELECT fen, arg_max(cp, (depth, nodes)) AS cp, CAST(NULL AS INT) AS mate, arg_max(best, (depth, nodes)) AS best_move
FROM (SELECT CAST(p_partkey % 1000 AS VARCHAR) AS fen, CAST(p_size AS INT) AS cp, p_partkey % 30 AS depth, p_partkey AS nodes, 'e2e4' AS best FROM part
      UNION ALL SELECT CAST(p_partkey % 1000 AS VARCHAR), CAST(-p_size AS INT), 15, p_partkey * 2, 'd2d4' FROM part) GROUP BY fen""")
oracle("scope_filter", """SELECT game_id, player_id, speed, my_rating, result FROM p
WHERE speed IN ('bullet', 'blitz') AND my_rating BETWEEN 1300 AND 1700""", "p")
oracle("rating_trend", """SELECT *, CASE WHEN slope > 0.5 THEN 'improving' WHEN slope < -0.5 THEN 'declining' ELSE 'flat' END AS trend
FROM (SELECT player_id, speed, count(*) AS games,
        round(regr_slope(my_rating, CAST(date AS DATE) - DATE '1970-01-01'), 6) AS slope
      FROM p GROUP BY ALL HAVING count(*) >= 5)""", "p")
