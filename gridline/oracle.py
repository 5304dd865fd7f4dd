"""Independent SQL for the registered queries, written for DuckDB on the order tables."""

from __future__ import annotations

_STAR = r"""
li AS (
  SELECT l_suppkey AS sk, CAST(year(l_shipdate) AS INT) AS yr, CAST(month(l_shipdate) AS INT) AS rd,
         l_quantity AS q, l_linestatus AS ls, l_returnflag AS rf
  FROM lineitem),
ag AS (
  SELECT sk, yr, rd, SUM(q) AS qty, COUNT(*) AS n,
         SUM(CASE WHEN ls = 'O' THEN q END) AS oq,
         SUM(CASE WHEN rf = 'R' THEN q ELSE 0 END) AS rq
  FROM li GROUP BY sk, yr, rd),
pos AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY yr, rd ORDER BY qty DESC, sk) AS p,
            ROW_NUMBER() OVER (PARTITION BY yr, rd ORDER BY n DESC, sk) AS g
  FROM ag),
fx_results AS (
  SELECT CAST(yr * 100 + rd AS INT) AS "raceId", sk AS "driverId", s_nationkey AS "constructorId",
         CASE WHEN rq * 2 > qty THEN 2 ELSE 1 END AS "statusId", CAST(p AS INT) AS "positionOrder",
         CASE WHEN p % 7 = 0 THEN '\N' ELSE CAST(g AS VARCHAR) END AS grid,
         CAST(CASE p WHEN 1 THEN 25 WHEN 2 THEN 18 WHEN 3 THEN 15 WHEN 4 THEN 12 WHEN 5 THEN 10 WHEN 6 THEN 8
              WHEN 7 THEN 6 WHEN 8 THEN 4 WHEN 9 THEN 2 WHEN 10 THEN 1 ELSE 0 END AS DOUBLE) AS points,
         n AS laps
  FROM pos LEFT JOIN supplier ON s_suppkey = sk),
fx_races AS (
  SELECT DISTINCT CAST(yr * 100 + rd AS INT) AS "raceId", yr AS year, rd AS round, rd AS "circuitId",
         'Race ' || rd AS name, make_date(yr, rd, 1) AS date
  FROM ag),
fx_drivers AS (
  SELECT s_suppkey AS "driverId",
         split_part(s_name, '#', 1) || ' ' || split_part(s_name, '#', 2) AS driver_name FROM supplier),
fx_constructors AS (SELECT n_nationkey AS "constructorId", n_name AS constructor_name FROM nation),
fx_circuits AS (SELECT DISTINCT rd AS "circuitId", 'Circuit ' || rd AS circuit_name FROM ag),
fx_status AS (SELECT * FROM (VALUES (1, 'Finished'), (2, 'Retired')) AS t("statusId", status)),
fx_quali AS (
  SELECT CAST(yr * 100 + rd AS INT) AS "raceId", sk AS "driverId",
         CAST(ROW_NUMBER() OVER (PARTITION BY yr, rd ORDER BY oq DESC, sk) AS INT) AS quali_position
  FROM ag WHERE oq IS NOT NULL),
master AS (
  SELECT r.*, ra.year, ra.round, ra."circuitId", ra.name, ra.date, d.driver_name, c.constructor_name,
         ci.circuit_name, st.status, q.quali_position
  FROM fx_results r
  LEFT JOIN fx_races ra USING ("raceId")
  LEFT JOIN fx_drivers d USING ("driverId")
  LEFT JOIN fx_constructors c USING ("constructorId")
  LEFT JOIN fx_circuits ci ON ci."circuitId" = ra."circuitId"
  LEFT JOIN fx_status st ON st."statusId" = r."statusId"
  LEFT JOIN fx_quali q ON q."raceId" = r."raceId" AND q."driverId" = r."driverId"),
cleaned AS (
  SELECT "raceId", "driverId", "constructorId", "statusId", "circuitId", year, round, date, name, driver_name,
         constructor_name, circuit_name, status,
         CAST("positionOrder" AS DOUBLE) AS "positionOrder",
         COALESCE(TRY_CAST(NULLIF(grid, '\N') AS DOUBLE), 20) AS grid,
         COALESCE(points, 0) AS points, CAST(laps AS DOUBLE) AS laps,
         COALESCE(CAST(quali_position AS DOUBLE), 20) AS quali_position,
         CAST("positionOrder" AS INT) AS final_position
  FROM master),
rowsx AS (
  SELECT *, CASE WHEN final_position = 1 THEN 1 ELSE 0 END AS is_winner,
         CASE WHEN final_position = 1 THEN 1 ELSE 0 END AS win_flag,
         CASE WHEN final_position <= 3 THEN 1 ELSE 0 END AS is_podium,
         CASE WHEN status <> 'Finished' THEN 1 ELSE 0 END AS is_dnf,
         grid - final_position AS positions_gained
  FROM cleaned)"""

_DRIVER = """,
drv0 AS (
  SELECT *,
    AVG(final_position) OVER l3 AS avg_finish_last_3, AVG(final_position) OVER l5 AS rolling_avg_finish,
    CAST(SUM(is_dnf) OVER l5 AS BIGINT) AS rolling_dnfs, AVG(points) OVER l3 AS rolling_points_last_3,
    SUM(points) OVER cu AS cumulative_points, CAST(SUM(win_flag) OVER cu AS BIGINT) AS cumulative_wins,
    CAST(SUM(is_dnf) OVER cu AS BIGINT) AS cumulative_dnfs,
    CAST(SUM(win_flag) OVER l5 AS BIGINT) AS rolling_wins_last_5,
    AVG(quali_position) OVER l3 AS avg_quali_last_3, AVG(positions_gained) OVER l5 AS avg_positions_gained,
    MIN(final_position) OVER cu AS best_finish_so_far,
    CAST(ROW_NUMBER() OVER (PARTITION BY "driverId", year ORDER BY round) AS INT) AS races_completed,
    CASE WHEN COUNT(final_position) OVER l5 > 1 THEN STDDEV_SAMP(final_position) OVER l5 END AS finish_position_stddev,
    CAST(SUM(is_podium) OVER cu AS BIGINT) AS podiums
  FROM rowsx
  WINDOW l3 AS (PARTITION BY "driverId", year ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
         l5 AS (PARTITION BY "driverId", year ORDER BY round ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
         cu AS (PARTITION BY "driverId", year ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
drv AS (
  SELECT *, rolling_dnfs AS dnfs_last_5,
    rolling_points_last_3 / (rolling_avg_finish + 1) AS momentum_score,
    1 / (finish_position_stddev + 1) AS consistency_score,
    podiums / races_completed AS podium_rate, cumulative_wins / races_completed AS win_rate,
    1 - cumulative_dnfs / races_completed AS reliability_score
  FROM drv0)"""

_HISTORY = """,
hist AS (
  SELECT *,
    COUNT(*) OVER (PARTITION BY "driverId" ORDER BY date, "raceId"
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS career_races,
    AVG(final_position) OVER v AS avg_finish_at_circuit, CAST(SUM(win_flag) OVER v AS BIGINT) AS wins_at_circuit
  FROM {source}
  WINDOW v AS (PARTITION BY "driverId", "circuitId" ORDER BY date, "raceId"
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

_TEAM = """,
team AS (
  SELECT *, constructor_rolling_points / (round + 1) AS constructor_momentum
  FROM (
    SELECT *,
      SUM(points) OVER (PARTITION BY "constructorId", year ORDER BY round, "driverId"
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS constructor_cumulative_points,
      AVG(points) OVER (PARTITION BY "constructorId", year ORDER BY round, "driverId"
                        ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS constructor_rolling_points,
      AVG(points) OVER w AS constructor_avg_points,
      CAST(SUM(win_flag) OVER w AS BIGINT) AS constructor_total_wins,
      AVG(is_podium) OVER w AS constructor_podium_rate
    FROM {source}
    WINDOW w AS (PARTITION BY "constructorId", year)))"""

_SEASON = """,
sea AS (
  SELECT *, CASE WHEN season_rank = 1 THEN 1 ELSE 0 END AS is_champion,
         total_races - round AS races_remaining, leader_points - cumulative_points AS gap_to_leader
  FROM (
    SELECT *, CAST(DENSE_RANK() OVER (PARTITION BY year ORDER BY season_total_points DESC) AS INT) AS season_rank
    FROM (
      SELECT *, MAX(cumulative_points) OVER (PARTITION BY "driverId", year) AS season_total_points,
             MAX(round) OVER (PARTITION BY year) AS total_races,
             MAX(cumulative_points) OVER (PARTITION BY year, round) AS leader_points
      FROM {source})))"""

_FULL = (
    _STAR + _DRIVER + _HISTORY.format(source="drv") + _TEAM.format(source="hist")
    + _SEASON.format(source="team")
    + """,
feat AS (SELECT *, CAST("driverId" AS VARCHAR) AS driver_id, is_champion AS won_championship FROM sea)"""
)


def star(select: str) -> str:
    return f"WITH {_STAR.strip()}\n{select}"


def driver(select: str) -> str:
    return f"WITH {_STAR.strip()}{_DRIVER}\n{select}"


def history(select: str) -> str:
    return f"WITH {_STAR.strip()}{_HISTORY.format(source='rowsx')}\n{select}"


def team(select: str) -> str:
    return f"WITH {_STAR.strip()}{_TEAM.format(source='rowsx')}\n{select}"


def season(select: str) -> str:
    return f"WITH {_STAR.strip()}{_DRIVER}{_SEASON.format(source='drv')}\n{select}"


def full(select: str, more: str = "") -> str:
    return f"WITH {_FULL.strip()}{more}\n{select}"


def columns(names: list[str], rounded: set[str] | list[str] = ()) -> str:
    """Select list, the given columns rounded to six places."""
    return ", ".join(f'ROUND("{n}", 6) AS "{n}"' if n in rounded else f'"{n}"' for n in names)


# Sequences in long form: three CTEs on top of the feature rows.

def sequences(source: str, features: list[str]) -> str:
    """seq: first five entries of each driver-season with at least three; val: values in long form."""
    values = " UNION ALL ".join(
        f"SELECT driver_id, year, step, '{f}' AS feature, CAST(COALESCE({f}, 0) AS DOUBLE) AS value FROM seq"
        for f in features
    )
    return f""",
seq0 AS (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY driver_id, year ORDER BY round) AS INT) AS step FROM {source}),
seq AS (
  SELECT * FROM (
    SELECT *, COUNT(*) OVER (PARTITION BY driver_id, year) AS entries FROM seq0 WHERE step <= 5)
  WHERE entries >= 3),
val AS ({values})"""


def padded_values(features: list[str]) -> str:
    names = ", ".join(f"('{f}')" for f in features)
    return f""",
pad AS (
  SELECT k.driver_id, k.year, s.step, f.feature, COALESCE(v.value, 0.0) AS value
  FROM (SELECT DISTINCT driver_id, year FROM seq) k
  CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS s(step)
  CROSS JOIN (VALUES {names}) AS f(feature)
  LEFT JOIN val v ON v.driver_id = k.driver_id AND v.year = k.year AND v.step = s.step AND v.feature = f.feature)"""


# One deterministic score per driver-season: share of the best total after the fifth entry.
SCORED = """,
fifth AS (
  SELECT driver_id, driver_name, year, won_championship AS label, cumulative_points,
         ROW_NUMBER() OVER (PARTITION BY driver_id, year ORDER BY round) AS entry,
         LEAST(5, COUNT(*) OVER (PARTITION BY driver_id, year)) AS last
  FROM feat),
scored AS (
  SELECT driver_id, driver_name, year, label,
         ROUND(cumulative_points / (CASE WHEN MAX(cumulative_points) OVER (PARTITION BY year) = 0 THEN 1
               ELSE MAX(cumulative_points) OVER (PARTITION BY year) END), 6) AS prob
  FROM fifth WHERE entry = last AND last >= 3)"""
