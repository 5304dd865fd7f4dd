"""Rolling, cumulative, career, venue, team and season-standing features.

``rows`` is a scan of clean race rows (see ``race_rows``), normally a staged
table. Ordered features go through ``ordered_groups``: plain windows while
every group fits one task, ordered blocks for the groups that do not.

Group sizes and season standings are taken from ``scan`` where it is given: the
written table behind ``rows``, so that they cost narrow scans and no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag
from ..operators.groups import all_ordered_groups, ordered_groups
from ..operators.joins import left_join_null_safe, lookup, pinned
from ..operators.places import dense_ranks
from ..operators.running import add_all, add_running, before, last, peak, row_number, so_far, whole
from ..sources.scratch import staged

# Last sort keys, so that rows tied on race order keep one defined order.
TIE_BREAK = ["raceId", "resultId", "constructorId", "positionOrder", "quali_position"]


def _order(rows: DataFrame, *columns: str) -> list[str]:
    return [*columns, *[c for c in TIE_BREAK if c in rows.columns and c not in columns]]


CAREER = {"career_races": before("count")}
VENUE = {
    "avg_finish_at_circuit": before("avg", "final_position"),
    "wins_at_circuit": before("sum", "win_flag"),
}
DRIVER_SEASON = {
    "avg_finish_last_3": last(3, "avg", "final_position"),
    "rolling_avg_finish": last(5, "avg", "final_position"),
    "rolling_dnfs": last(5, "sum", "is_dnf"),
    "rolling_points_last_3": last(3, "avg", "points"),
    "rolling_wins_last_5": last(5, "sum", "win_flag"),
    "avg_quali_last_3": last(3, "avg", "quali_position"),
    "avg_positions_gained": last(5, "avg", "positions_gained"),
    "finish_position_stddev": last(5, "stddev", "final_position"),
    "cumulative_points": so_far("sum", "points"),
    "cumulative_wins": so_far("sum", "win_flag"),
    "cumulative_dnfs": so_far("sum", "is_dnf"),
    "cumulative_podiums": so_far("sum", "is_podium"),
    "best_finish_so_far": so_far("min", "final_position"),
    "races_completed": row_number(),
}
SEASON_TOTAL = {"season_total_points": peak("points")}
TEAM_SEASON = {
    "constructor_cumulative_points": so_far("sum", "points"),
    "constructor_rolling_points": last(5, "avg", "points"),
    "constructor_avg_points": whole("avg", "points"),
    "constructor_total_wins": whole("sum", "win_flag"),
    "constructor_podium_rate": whole("avg", "is_podium"),
}


def career_form(rows: DataFrame) -> DataFrame:
    """Races before this one in the driver's career. [W17]"""
    groups = ordered_groups(rows, ["driverId"], _order(rows, "date"))
    return add_running(rows, groups, CAREER)


def venue_form(rows: DataFrame) -> DataFrame:
    """The driver's earlier results at the same venue. [W22, W23]"""
    groups = ordered_groups(rows, ["driverId", "circuitId"], _order(rows, "date"))
    return add_running(rows, groups, VENUE)


def driver_form(rows: DataFrame) -> DataFrame:
    """Form of the driver within the season, and the scores built on it. [W1-W15, P13-P16]"""
    groups = ordered_groups(rows, ["driverId", "year"], _order(rows, "round"))
    return _driver_scores(add_running(rows, groups, DRIVER_SEASON))


def _driver_scores(rows: DataFrame) -> DataFrame:
    done = F.col("races_completed")
    rows = rows.withColumns({
        "dnfs_last_5": F.col("rolling_dnfs"),
        "momentum_score": F.col("rolling_points_last_3") / (F.col("rolling_avg_finish") + 1),
        "consistency_score": 1 / (F.col("finish_position_stddev") + 1),
        "podium_rate": F.col("cumulative_podiums") / done,
        "win_rate": F.col("cumulative_wins") / done,
        "reliability_score": 1 - F.col("cumulative_dnfs") / done,
    })
    return rows.drop("cumulative_podiums")


def driver_level(rows: DataFrame) -> DataFrame:
    """Career, venue and season form of drivers.

    All three partition by the driver, career first, so data without big groups is shuffled
    once, by driver, for all windows. Big groups of the three are looked for in one pass, and cut
    together: one shuffle for each split, one written table, two scans of it. [W24]
    """
    splits = [(["driverId"], _order(rows, "date")), (["driverId", "circuitId"], _order(rows, "date")),
              (["driverId", "year"], _order(rows, "round"))]
    groups = all_ordered_groups(rows, splits)
    return _driver_scores(add_all(rows, list(zip(groups, [CAREER, VENUE, DRIVER_SEASON | SEASON_TOTAL]))))


def team_form(rows: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Form of the constructor within the season; team-mates ordered by driver. [W16, W18-W21, P17, N2]"""
    scan = rows if scan is None else scan
    groups = ordered_groups(scan, ["constructorId", "year"], _order(scan, "round", "driverId"))
    return add_running(rows, groups, TEAM_SEASON).withColumn(
        "constructor_momentum", F.col("constructor_rolling_points") / (F.col("round") + 1)
    )


def season_length(rows: DataFrame) -> DataFrame:
    """[A1]"""
    return rows.groupBy("year").agg(F.max("round").alias("total_races"))


def with_races_remaining(rows: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """[J7, P18]"""
    lengths = season_length(rows if scan is None else scan)
    return lookup(rows, lengths, ["year"]).withColumn(
        "races_remaining", F.col("total_races") - F.col("round")
    )


def round_leaders(rows: DataFrame) -> DataFrame:
    """Most points held by a driver present in each round. [W27, N7]

    Aggregated and joined back: a window would put each whole round into one task.
    """
    return rows.groupBy("year", "round").agg(F.max("cumulative_points").alias("leader_points"))


def with_gap_to_leader(rows: DataFrame, leaders: DataFrame | None = None) -> DataFrame:
    """Points behind the leader of the round. [P19]"""
    leaders = round_leaders(rows) if leaders is None else leaders
    return lookup(rows, leaders, ["year", "round"], nulls_match=True).withColumn(
        "gap_to_leader", F.col("leader_points") - F.col("cumulative_points")
    )


def season_ranks(rows: DataFrame) -> DataFrame:
    """Dense rank of every driver's points total within the season. [W25]

    Totals are aggregates of narrow rows, one for each driver-season, and their ranks come from
    places in one order of the distinct totals: no window holds a season.
    """
    totals = rows.groupBy("driverId", "year").agg(F.max("season_total_points").alias("_by")).withColumn("_by", -F.col("_by"))
    totals = staged(totals, "season-totals")
    ranks = dense_ranks(totals, ["year"], F.col("_by"), "season_rank")
    return left_join_null_safe(totals, ranks, ["year", "_by"]).select("driverId", "year", "season_rank")


def with_season_ranks(rows: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Season rank of the row's driver. [W25]"""
    return lookup(rows, season_ranks(rows if scan is None else scan), ["driverId", "year"], nulls_match=True)


def with_champions(rows: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Champion flag: the driver's total is the season's greatest; equal totals share a title. [W24, W26, N6]

    The greatest total is one row for each season, so the rows are not shuffled for it.
    """
    best = (rows if scan is None else scan).groupBy("year").agg(F.max("season_total_points").alias("_best"))
    ranked = lookup(rows, best, ["year"], nulls_match=True)
    return ranked.withColumn("is_champion", flag(F.col("season_total_points") == F.col("_best"))).drop("_best")


def season_level(rows: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Champion, races remaining and gap to the leader on driver-level rows."""
    leaders = pinned(round_leaders(rows if scan is None else scan))
    return with_gap_to_leader(with_races_remaining(with_champions(rows, scan), scan), leaders)


def with_labels(rows: DataFrame) -> DataFrame:
    """Text id and target copy. [P20]"""
    return rows.withColumns({
        "driver_id": F.col("driverId").cast("string"),
        "won_championship": F.col("is_champion"),
    })
