"""Registered queries and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import oracle as sql
from .fixed import CHAMP_FEATURE_SET, RACE_FEATURE_SET, RACE_MODEL_FEATURES, SEQUENCE_FEATURES
from .functions.columns import share_of
from .operators import scoring
from .operators.joins import lookup
from .operators.medians import exact_medians
from .operators.ranking import first_rows
from .operators.sequences import (
    Scaler, build_sequences, long_form, padded, season_counts, sequence_counts, sequence_rows, split_name,
)
from .plans import features, form, race_model, race_rows, reports, season_model
from .plans.season_star import TRAIN_CUTOFF, VALIDATION_YEARS, clean_rows, star_tables
from .session import GROUP_ROWS_KEY, scratch_dir
from .sources.landing import (
    QUALIFYING, RACE, complete_sessions, landing_keys, manifest, read_landing, refresh, taken_records, to_fetch, write_landing,
)
from .sources.scratch import staged, staged_once
from .sources.sinks import export_csv, published, reexport_csv, reused, rewrite_features, write_features, write_parquet
from .sources.tables import missing_inputs, read_csv, read_features

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

KEYS = ["driverId", "year", "round"]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn
    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, for comparison across engines."""
    return df.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@contextmanager
def small_groups(spark: SparkSession, rows: int) -> Iterator[None]:
    """Cut groups above ``rows`` rows, so that the block path runs on test data."""
    before = spark.conf.get(GROUP_ROWS_KEY, None)
    spark.conf.set(GROUP_ROWS_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(GROUP_ROWS_KEY) if before is None else spark.conf.set(GROUP_ROWS_KEY, before)


def _season_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finished feature table, computed once per session, as later jobs read it."""
    return staged_once(spark, f"season:{sf_dir}", lambda: features.season_rows(clean_rows(spark, sf_dir)))


def _driver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_once(spark, f"driver:{sf_dir}", lambda: form.driver_level(clean_rows(spark, sf_dir)))


def _champ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.champ_features(_season_rows(spark, sf_dir))


# Inputs, joins, cleaning.

_RESULTS = ["raceId", "driverId", "constructorId", "statusId", "positionOrder", "grid", "points", "laps"]
_MASTER = [*_RESULTS, "year", "round", "circuitId", "name", "date", "driver_name", "constructor_name",
           "circuit_name", "status", "quali_position"]
_FLAGS = ["is_winner", "win_flag", "is_podium", "is_dnf", "positions_gained"]


@query(sql.star(f"SELECT {sql.columns(_RESULTS)} FROM fx_results"))
def season_results_fixture(spark, sf_dir):
    return star_tables(spark, sf_dir)["results"].select(_RESULTS)


@query(sql.star(f"SELECT {sql.columns(_MASTER)} FROM master"))
def master_join(spark, sf_dir):
    return race_rows.joined_results(star_tables(spark, sf_dir)).select(_MASTER)


@query(sql.star(f'SELECT {sql.columns(_MASTER)}, final_position FROM cleaned'))
def clean_sentinels_fill(spark, sf_dir):
    joined = race_rows.joined_results(star_tables(spark, sf_dir))
    return race_rows.clean(joined).select(*_MASTER, "final_position")


@query(sql.star("""SELECT "raceId", "driverId",
  COALESCE(TRY_CAST(CASE WHEN "positionOrder" % 5 = 0 THEN '\\N' WHEN "positionOrder" % 5 = 1 THEN 'fast' WHEN "positionOrder" % 5 = 2 THEN '2' || laps || '.5'
    WHEN "positionOrder" % 5 = 3 THEN CAST(laps AS VARCHAR) END AS DOUBLE), 0) AS "fastestLapSpeed", TRY_CAST(CASE WHEN laps % 2 = 0 THEN '\\N' ELSE ' 7' END AS DOUBLE) AS laps
  FROM master"""))
def clean_speeds(spark, sf_dir):
    """Sentinels, unreadable and missing speeds become 0; a column without a default stays null."""
    n, laps = F.col("positionOrder") % 5, F.col("laps").cast("string")
    speed = F.when(n == 0, "\\N").when(n == 1, "fast").when(n == 2, F.concat(F.lit("2"), laps, F.lit(".5"))).when(n == 3, laps)
    rows = star_tables(spark, sf_dir)["results"].withColumns({"fastestLapSpeed": speed, "laps": F.when(F.col("laps") % 2 == 0, "\\N").otherwise(" 7")})
    return race_rows.clean(rows).select("raceId", "driverId", "fastestLapSpeed", "laps")


@query(sql.star(f"SELECT {sql.columns(_MASTER)} FROM master"))
def dedup_rows(spark, sf_dir):
    """Every result and every qualifying row twice; dedup restores the join."""
    tables = star_tables(spark, sf_dir)
    twice = {t: tables[t].union(tables[t]) for t in ("results", "qualifying")}
    return race_rows.joined_results(race_rows.distinct_inputs(tables | twice)).select(_MASTER)


@query(sql.star(f'SELECT "driverId", year, round, {sql.columns(_FLAGS)}, 0 AS wet_race FROM rowsx'))
def basic_flags(spark, sf_dir):
    rows = race_rows.race_rows(star_tables(spark, sf_dir))
    return rows.select(*KEYS, *_FLAGS, "wet_race")


# Driver, venue and team form.

_ROLLING = ["avg_finish_last_3", "rolling_avg_finish", "rolling_dnfs", "rolling_points_last_3",
            "rolling_wins_last_5", "dnfs_last_5", "avg_quali_last_3", "avg_positions_gained"]
_CUMULATIVE = ["cumulative_points", "cumulative_wins", "cumulative_dnfs", "best_finish_so_far", "races_completed"]
_CONSISTENCY = ["finish_position_stddev", "consistency_score", "momentum_score"]
_RATES = ["podium_rate", "win_rate", "reliability_score"]
_VENUE = ["avg_finish_at_circuit", "wins_at_circuit"]
_TEAM_SEQ = ["constructor_cumulative_points", "constructor_rolling_points", "constructor_momentum"]
_TEAM_ALL = ["constructor_avg_points", "constructor_total_wins", "constructor_podium_rate"]


def _sql_columns(names: list[str]) -> str:
    return f"{sql.columns(KEYS)}, {sql.columns(names, names)}"


def _register_form(name: str, build, names: list[str], text: str, block_rows: int = 40) -> None:
    """A form query, and the same query with its groups cut into blocks."""

    def plain(spark, sf_dir):
        return rounded(build(clean_rows(spark, sf_dir)).select(*KEYS, *names))

    def in_blocks(spark, sf_dir):
        rows = clean_rows(spark, sf_dir)
        with small_groups(spark, block_rows):
            return rounded(build(rows).select(*KEYS, *names))

    QUERIES[name], ORACLE[name] = plain, text
    QUERIES[f"{name}_in_blocks"], ORACLE[f"{name}_in_blocks"] = in_blocks, text


_DRIVER_ALL = [*_ROLLING, *_CUMULATIVE, *_CONSISTENCY, *_RATES]
_register_form("driver_form", form.driver_form, _DRIVER_ALL, sql.driver(f"SELECT {_sql_columns(_DRIVER_ALL)} FROM drv"), 5)
_register_form("career_history", form.career_form, ["career_races"], sql.history(f"SELECT {_sql_columns(['career_races'])} FROM hist"))
_register_form("circuit_history", form.venue_form, _VENUE, sql.history(f"SELECT {_sql_columns(_VENUE)} FROM hist"), 3)
_register_form("constructor_form", form.team_form, [*_TEAM_SEQ, *_TEAM_ALL], sql.team(f"SELECT {_sql_columns([*_TEAM_SEQ, *_TEAM_ALL])} FROM team"))


def _driver_columns(names):
    return lambda spark, sf_dir: rounded(form.driver_form(clean_rows(spark, sf_dir)).select(*KEYS, *names))


def _team_columns(names):
    return lambda spark, sf_dir: rounded(form.team_form(clean_rows(spark, sf_dir)).select(*KEYS, *names))


for _name, _cols in {
    "driver_rolling": _ROLLING, "driver_cumulative": _CUMULATIVE,
    "driver_consistency": _CONSISTENCY, "driver_rates": _RATES,
}.items():
    QUERIES[_name] = _driver_columns(_cols)
    ORACLE[_name] = sql.driver(f"SELECT {_sql_columns(_cols)} FROM drv")

for _name, _cols in {"constructor_rolling": _TEAM_SEQ, "constructor_season": _TEAM_ALL}.items():
    QUERIES[_name] = _team_columns(_cols)
    ORACLE[_name] = sql.team(f"SELECT {_sql_columns(_cols)} FROM team")


# Season standings.

_CHAMPIONS = ["season_total_points", "season_rank", "is_champion"]


@query(sql.season(f"SELECT {_sql_columns(_CHAMPIONS)} FROM sea"))
def season_champions(spark, sf_dir):
    rows = form.with_season_ranks(form.with_champions(_driver_rows(spark, sf_dir)))
    return rounded(rows.select(*KEYS, *_CHAMPIONS))


@query(sql.season('SELECT DISTINCT "driverId", year, season_rank FROM sea'))
def season_ranks(spark, sf_dir):
    return form.season_ranks(_driver_rows(spark, sf_dir))


@query(sql.star(f'''SELECT {sql.columns(KEYS)}, MAX(round) OVER (PARTITION BY year) AS total_races,
  MAX(round) OVER (PARTITION BY year) - round AS races_remaining FROM rowsx'''))
def races_remaining(spark, sf_dir):
    rows = form.with_races_remaining(clean_rows(spark, sf_dir))
    return rows.select(*KEYS, "total_races", "races_remaining")


@query(sql.season(f"SELECT {_sql_columns(['leader_points', 'gap_to_leader'])} FROM sea"))
def gap_to_leader(spark, sf_dir):
    return rounded(form.with_gap_to_leader(_driver_rows(spark, sf_dir)).select(*KEYS, "leader_points", "gap_to_leader"))


# Feature sets and summaries.

_DOUBLES = {
    "rolling_avg_finish", "rolling_points_last_3", "momentum_score", "consistency_score", "podium_rate",
    "win_rate", "reliability_score", "avg_finish_last_3", "constructor_avg_points",
    "constructor_rolling_points", "constructor_momentum", "avg_finish_at_circuit",
}


@query(sql.full(f"SELECT {sql.columns(CHAMP_FEATURE_SET, _DOUBLES)} FROM feat"))
def champ_features(spark, sf_dir):
    return rounded(_champ(spark, sf_dir))


@query(sql.full(f"SELECT {sql.columns(CHAMP_FEATURE_SET, _DOUBLES)} FROM feat"))
def champ_features_in_blocks(spark, sf_dir):
    """Career, venue, season and team groups all cut."""
    rows = clean_rows(spark, sf_dir)
    with small_groups(spark, 5):
        return rounded(features.champ_features(features.season_rows(rows)))


@query(sql.full(f"SELECT {sql.columns(RACE_FEATURE_SET, _DOUBLES)} FROM feat"))
def race_features(spark, sf_dir):
    return rounded(features.race_features(_season_rows(spark, sf_dir)))


_PROFILED = [c for c in CHAMP_FEATURE_SET if c not in ("driver_id", "driver_name", "constructor_name", "circuit_name")]


@query(sql.full("SELECT " + ", ".join(f'ROUND(AVG("{c}"), 6) AS "{c}_mean"' for c in _PROFILED) + " FROM feat"))
def feature_profile(spark, sf_dir):
    return rounded(features.profile(_champ(spark, sf_dir)))


# The columns that a season row has by its definition; the profile of the job covers each of them.
_NUMERIC = [
    "year", "driverId", "raceId", "statusId", "constructorId", "positionOrder", "grid", "points", "laps", "circuitId", "round",
    "quali_position", "final_position", *_FLAGS, "career_races", *_VENUE, *_ROLLING, *_CUMULATIVE, *_CONSISTENCY, *_RATES, *_TEAM_SEQ, *_TEAM_ALL,
    "season_total_points", "is_champion", "total_races", "races_remaining", "leader_points", "gap_to_leader", "won_championship",
]


@query(sql.full("SELECT 0.0::DOUBLE AS wet_race_mean, " + ", ".join(f'ROUND(AVG("{c}"), 6) AS "{c}_mean"' for c in _NUMERIC) + " FROM feat"))
def season_rows_profile(spark, sf_dir):
    """Means of every numeric column of the finished rows, as the feature job returns them."""
    return rounded(features.profile(_season_rows(spark, sf_dir)))


@query(sql.star("""SELECT constructor_name, ROUND(AVG(points), 6) AS avg_points,
  CAST(SUM(win_flag) AS BIGINT) AS total_wins, ROUND(AVG(is_podium), 6) AS podium_rate
  FROM rowsx GROUP BY constructor_name"""))
def constructor_dominance(spark, sf_dir):
    return rounded(features.constructor_dominance(clean_rows(spark, sf_dir)))


@query(sql.star("""SELECT driver_name, CAST(SUM(win_flag) AS BIGINT) AS wins, ROUND(AVG(is_winner), 6) AS win_rate,
  ROUND(AVG(points), 6) AS avg_points FROM rowsx GROUP BY driver_name"""))
def driver_statistics(spark, sf_dir):
    return rounded(features.driver_statistics(clean_rows(spark, sf_dir)))


@query(sql.star("""SELECT circuit_name, ROUND(AVG(is_dnf), 6) AS avg_dnf_rate,
  ROUND(AVG(positions_gained), 6) AS avg_overtakes FROM rowsx GROUP BY circuit_name"""))
def circuit_statistics(spark, sf_dir):
    return rounded(features.circuit_statistics(clean_rows(spark, sf_dir)))


# Chart data.

_NAMES = ["000000007", "000000042", "000000005"]
_TEAMS = ["NATION_3", "NATION_8", "NATION_10", "NATION_22"]


@query(sql.driver(f"""SELECT year, round, driver_name, ROUND(rolling_avg_finish, 6) AS rolling_avg_finish FROM drv
  WHERE year = (SELECT MAX(year) FROM drv)
    AND ({" OR ".join(f"contains(driver_name, '{n}')" for n in _NAMES)})"""))
def driver_momentum(spark, sf_dir):
    return rounded(reports.driver_momentum(_champ(spark, sf_dir), _NAMES))


@query(sql.star(f"""SELECT constructor_name, ROUND(AVG(points), 6) AS avg_points,
  CAST(SUM(CASE WHEN final_position = 1 THEN 1 ELSE 0 END) AS BIGINT) AS total_wins
  FROM rowsx WHERE constructor_name IN ({", ".join(f"'{n}'" for n in _TEAMS)}) GROUP BY constructor_name"""))
def constructor_compare(spark, sf_dir):
    return rounded(reports.constructor_compare(_champ(spark, sf_dir), _TEAMS))


@query(sql.driver(""", cur AS (
  SELECT round, driver_name, POW(cumulative_points / (CASE WHEN m = 0 THEN 1 ELSE m END), 2) AS prob
  FROM (SELECT *, MAX(cumulative_points) OVER (PARTITION BY year, round) AS m FROM drv
        WHERE year = (SELECT MAX(year) FROM drv))),
best AS (
  SELECT driver_name FROM cur GROUP BY driver_name ORDER BY MAX(prob) DESC, driver_name LIMIT 6)
SELECT round, driver_name, ROUND(prob, 6) AS championship_probability
FROM cur WHERE driver_name IN (SELECT driver_name FROM best)"""))
def title_probability_curves(spark, sf_dir):
    return rounded(reports.title_probability_curves(_champ(spark, sf_dir)))


@query(sql.star("""SELECT circuit_name, ROUND(AVG(is_dnf), 6) AS dnf_rate FROM rowsx
  GROUP BY circuit_name ORDER BY AVG(is_dnf) DESC, circuit_name LIMIT 12"""))
def top_dnf_circuits(spark, sf_dir):
    return rounded(reports.top_dnf_circuits(features.circuit_statistics(_season_rows(spark, sf_dir))))


@query(sql.star("""SELECT circuit_name, ROUND(AVG(is_dnf), 6) AS dnf_rate FROM rowsx
  GROUP BY circuit_name ORDER BY AVG(is_dnf) DESC, circuit_name LIMIT 5"""))
def worst_dnf_circuits(spark, sf_dir):
    """Fewer venues than there are."""
    return rounded(reports.top_dnf_circuits(features.circuit_statistics(_season_rows(spark, sf_dir)), 5))


# Sequences.

_LONG = "driver_id, year, step, feature, ROUND(value, 6) AS value"
_SPLIT = f"""CASE WHEN year > {TRAIN_CUTOFF} THEN 'test' WHEN year > {TRAIN_CUTOFF - VALIDATION_YEARS}
  THEN 'validation' ELSE 'train' END"""


def _sequences(champ: DataFrame) -> DataFrame:
    return build_sequences(sequence_rows(champ))


@query(sql.full(f"SELECT {_LONG} FROM val", sql.sequences("feat", SEQUENCE_FEATURES)))
def season_sequences(spark, sf_dir):
    return rounded(long_form(_sequences(_champ(spark, sf_dir))))


@query(sql.full("SELECT driver_id, year, driver_name, won_championship AS label FROM seq WHERE step = 1", sql.sequences("feat", SEQUENCE_FEATURES)))
def sequence_names(spark, sf_dir):
    """The name and the label that a sequence takes over."""
    return _sequences(_champ(spark, sf_dir)).select("driver_id", "year", "driver_name", "label")


_SHORT_SEASONS = sql.sequences("(SELECT * REPLACE (year * 10 + (round - 1) // 4 AS year) FROM feat)", SEQUENCE_FEATURES)


@query(sql.full(f"SELECT {_LONG} FROM pad", _SHORT_SEASONS + sql.padded_values(SEQUENCE_FEATURES)))
def padded_sequences(spark, sf_dir):
    """Sequences of seasons of four rounds each, made of all rows; they have one to four entries."""
    short = _champ(spark, sf_dir).withColumn("year", F.expr("year * 10 + (round - 1) div 4").cast("int"))
    return rounded(long_form(padded(_sequences(short))))


# DuckDB keeps the sign when a small negative number rounds to zero; Spark does not. Both mean 0.
@query(sql.full(f"""SELECT driver_id, year, step, feature, {_SPLIT} AS split,
  CASE WHEN value = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS value
  FROM (SELECT p.driver_id, p.year, p.step, p.feature, ROUND((p.value - s.mean) / (s.std + 1e-8), 5) AS value
  FROM pad p JOIN (SELECT feature, AVG(value) AS mean, STDDEV_POP(value) AS std FROM pad
                   WHERE year <= {TRAIN_CUTOFF - VALIDATION_YEARS} GROUP BY feature) s ON s.feature = p.feature)""",
  sql.sequences("feat", SEQUENCE_FEATURES) + sql.padded_values(SEQUENCE_FEATURES)))
def normalised_sequences(spark, sf_dir):
    rows = season_model.padded_sequences(_champ(spark, sf_dir), TRAIN_CUTOFF, VALIDATION_YEARS)
    scaler = Scaler.fit(rows.filter("split = 'train'"), len(SEQUENCE_FEATURES))
    scaled = long_form(rows.withColumn("sequence", scaler.apply(F.col("sequence"))))
    split = split_name(F.col("year"), TRAIN_CUTOFF, VALIDATION_YEARS)
    return scaled.withColumns({"split": split, "value": F.round("value", 5)})


@query(sql.full(f"""SELECT {_SPLIT} AS split, COUNT(*) AS sequences, CAST(SUM(won_championship) AS BIGINT) AS champions
  FROM seq WHERE step = 1 GROUP BY 1""", sql.sequences("feat", SEQUENCE_FEATURES)))
def sequence_split_counts(spark, sf_dir):
    split = split_name(F.col("year"), TRAIN_CUTOFF, VALIDATION_YEARS).alias("split")
    return _sequences(_champ(spark, sf_dir)).groupBy(split).agg(
        F.count("*").alias("sequences"), F.sum("label").alias("champions")
    )


@query(sql.full("""SELECT COUNT(*) AS sequences, CAST(SUM(won_championship) AS BIGINT) AS champions
  FROM seq WHERE step = 1""", sql.sequences("feat", SEQUENCE_FEATURES)))
def sequence_totals(spark, sf_dir):
    return sequence_counts(_sequences(_champ(spark, sf_dir)))


@query(sql.full("""SELECT CAST(SUM(n) AS BIGINT) AS row_count, COUNT(*) AS seasons,
  CAST(SUM(c) AS BIGINT) AS champion_seasons
  FROM (SELECT year, COUNT(*) AS n, MAX(won_championship) AS c FROM feat GROUP BY year)"""))
def season_totals(spark, sf_dir):
    return season_counts(sequence_rows(_champ(spark, sf_dir)))


@query(sql.star(f"""SELECT COUNT(*) AS rows, COUNT(*) FILTER (is_winner = 1) AS winners,
  COUNT(*) FILTER (year <= {TRAIN_CUTOFF}) AS train_rows, COUNT(*) FILTER (year > {TRAIN_CUTOFF}) AS test_rows
  FROM rowsx"""))
def split_counts(spark, sf_dir):
    race = features.race_features(_season_rows(spark, sf_dir))
    return race_model.row_counts(race_model.model_rows(race), TRAIN_CUTOFF)


# Evaluation on deterministic scores.

def scored_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each driver-season of three entries or more: share of the best total after the last of its first five."""
    champ = _champ(spark, sf_dir).withColumnRenamed("won_championship", "label")
    entries = first_rows(champ, ["driver_id", "year"], ["round"], 5, "entry")
    last = F.max_by(F.struct("driver_name", "label", "cumulative_points"), "entry").alias("last")
    fifth = entries.groupBy("driver_id", "year").agg(last, F.max("entry").alias("n")).filter("n >= 3").select("driver_id", "year", "last.*")
    best = fifth.groupBy("year").agg(F.max("cumulative_points").alias("best"))
    return lookup(fifth, best, ["year"]).select(
        "driver_id", "driver_name", "year", "label",
        F.round(share_of(F.col("cumulative_points"), F.col("best")), 6).alias("prob"),
    )


_PICKS = """,
picks AS (
  SELECT p.year, p.driver_name AS predicted, COALESCE(a.driver_name, '?') AS actual, ROUND_EVEN(p.prob, 3) AS prob,
         CASE WHEN p.driver_name = COALESCE(a.driver_name, '?') THEN 1 ELSE 0 END AS correct
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY year ORDER BY prob DESC, driver_id) AS n FROM scored) p
  LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY year ORDER BY driver_id) AS n FROM scored
             WHERE label = 1) a ON a.year = p.year AND a.n = 1
  WHERE p.n = 1)"""


@query(sql.full("SELECT * FROM picks", sql.SCORED + _PICKS))
def champion_picks(spark, sf_dir):
    return scoring.champion_picks(scored_seasons(spark, sf_dir))


@query(sql.full("SELECT year, prob, correct FROM picks", sql.SCORED + _PICKS))
def season_pick_bars(spark, sf_dir):
    return reports.season_pick_bars(scoring.champion_picks(scored_seasons(spark, sf_dir)))


@query(sql.full("SELECT ROUND(AVG(correct), 6) AS accuracy FROM picks", sql.SCORED + _PICKS))
def pick_accuracy(spark, sf_dir):
    return rounded(scoring.pick_accuracy(scoring.champion_picks(scored_seasons(spark, sf_dir))))


def _sql_top_k(k: int) -> str:
    return f"""SELECT {k} AS k, ROUND(COALESCE(AVG(hit), 0), 6) AS accuracy FROM (
  SELECT a.year, MAX(CASE WHEN t.driver_name = a.driver_name THEN 1 ELSE 0 END) AS hit
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY year ORDER BY driver_id) AS n FROM scored WHERE label = 1) a
  JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY year ORDER BY prob DESC, driver_id) AS n FROM scored) t
    ON t.year = a.year AND t.n <= {k}
  WHERE a.n = 1 GROUP BY a.year)"""


@query(sql.full(f"{_sql_top_k(3)} UNION ALL {_sql_top_k(5)}", sql.SCORED))
def top_k_accuracy(spark, sf_dir):
    scored = scored_seasons(spark, sf_dir)
    return rounded(scoring.top_k_accuracy(scored, 3).union(scoring.top_k_accuracy(scored, 5)))


_AUC = """SELECT ROUND((SUM(CASE WHEN label = 1 THEN r END) - MAX(p) * (MAX(p) + 1) / 2.0)
  / (MAX(p) * (MAX(c) - MAX(p))), 6) AS auc
  FROM (SELECT label, RANK() OVER (ORDER BY prob) + (COUNT(*) OVER (PARTITION BY prob) - 1) / 2.0 AS r,
               SUM(label) OVER () AS p, COUNT(*) OVER () AS c FROM scored)"""


@query(sql.full(_AUC, sql.SCORED))
def auc_exact(spark, sf_dir):
    return rounded(scoring.exact_auc(scored_seasons(spark, sf_dir)))


@query(sql.full(_AUC, sql.SCORED))
def auc_exact_in_blocks(spark, sf_dir):
    scored = scored_seasons(spark, sf_dir)
    with small_groups(spark, 10):
        return rounded(scoring.exact_auc(scored))


@query(sql.full("""SELECT MIN(prob) AS min_prob, MAX(prob) AS max_prob, ROUND(AVG(prob), 6) AS mean_prob
  FROM scored""", sql.SCORED))
def score_summary(spark, sf_dir):
    return rounded(scoring.score_summary(scored_seasons(spark, sf_dir)))


@query(sql.full("""SELECT driver_id, driver_name, year, prob FROM scored
  ORDER BY prob DESC, driver_id, year LIMIT 5""", sql.SCORED))
def highest_scores(spark, sf_dir):
    return scoring.highest_scores(scored_seasons(spark, sf_dir))


@query(sql.full("""SELECT tp, fp, fn, tn, ROUND((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  ROUND(((tp + fn) * CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END
       + (tn + fp) * CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2 * tn / (2 * tn + fp + fn) END)
       / (tp + fp + fn + tn), 6) AS f1
  FROM (SELECT COUNT(*) FILTER (label = 1 AND prob >= 0.5) AS tp,
               COUNT(*) FILTER (label = 0 AND prob >= 0.5) AS fp,
               COUNT(*) FILTER (label = 1 AND prob < 0.5) AS fn,
               COUNT(*) FILTER (label = 0 AND prob < 0.5) AS tn FROM scored)""", sql.SCORED))
def classification_metrics(spark, sf_dir):
    scored = scored_seasons(spark, sf_dir).withColumn("prediction", (F.col("prob") >= 0.5).cast("double"))
    return rounded(scoring.classification_metrics(scored))


# Models.

@query(sql.full(" UNION ALL ".join(f"""
  SELECT '{c}' AS feature, ROUND((SELECT MIN(v) FROM (
           SELECT {c} AS v, ROW_NUMBER() OVER (ORDER BY {c}) AS n, COUNT(*) OVER () AS c
           FROM feat WHERE {c} IS NOT NULL) WHERE 2 * n >= c), 6) AS median,
         COUNT(*) FILTER ({c} IS NULL) AS missing FROM feat""" for c in RACE_MODEL_FEATURES)))
def imputed_median(spark, sf_dir):
    rows = race_model.model_rows(features.race_features(_season_rows(spark, sf_dir)))
    return rounded(_medians(rows))


def _medians(rows: DataFrame) -> DataFrame:
    missing = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("missing")) for c in RACE_MODEL_FEATURES
    ]))
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in RACE_MODEL_FEATURES])
    return exact_medians(rows, RACE_MODEL_FEATURES).join(counts.select(missing.alias("m")).select("m.*"), "feature")


@query(ORACLE["imputed_median"])
def imputed_median_in_blocks(spark, sf_dir):
    rows = race_model.model_rows(features.race_features(_season_rows(spark, sf_dir)))
    with small_groups(spark, 20):
        return rounded(_medians(rows))


_MODELS: dict[tuple[str, str], PipelineModel] = {}


def _race_model(spark: SparkSession, sf_dir: str) -> tuple[PipelineModel, DataFrame]:
    """The forest and its test rows; trained once per session."""
    rows = race_model.model_rows(features.race_features(_season_rows(spark, sf_dir)))
    train, test = race_model.temporal_split(rows, TRAIN_CUTOFF)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        with reused(race_model.training_rows(train)) as kept:
            _MODELS[key] = race_model.fit(kept)
    return _MODELS[key], test


@query()
def race_winner_scores(spark, sf_dir):
    return reports.ordered_race_predictions(_race_scores(spark, sf_dir))


@query()
def race_winner_metrics(spark, sf_dir):
    return race_model.evaluate(_race_scores(spark, sf_dir))


def _race_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the test seasons, scored once per session."""
    def build() -> DataFrame:
        model, test = _race_model(spark, sf_dir)
        return race_model.predictions(model.transform(test))
    return race_model.in_order(staged_once(spark, f"race-scores:{sf_dir}", build))


@query(sql.full(f"""SELECT year, round, driver_name, constructor_name, CAST(is_winner AS DOUBLE) AS is_winner,
  true AS agrees, true AS likelier_class, true AS in_order FROM feat WHERE year > {TRAIN_CUTOFF}"""))
def race_winner_agreement(spark, sf_dir):
    """Every prediction against the forest's nodes walked as expressions: probability, class and order of the rows."""
    model, test = _race_model(spark, sf_dir)
    scored = _race_scores(spark, sf_dir).select("*", F.monotonically_increasing_id().alias("at"))
    scored = staged(scored, "race-scores-in-order")
    ids = ["year", "round", "driver_name", "constructor_name", "is_winner"]
    nth = Window.partitionBy(*ids).orderBy("winner_probability")
    own = race_model.compiled_scores(model, test).withColumn("nth", F.row_number().over(nth)).withColumnRenamed("winner_probability", "own")
    both = scored.withColumn("nth", F.row_number().over(nth)).join(own, [*ids, "nth"], "full")
    later = Window.partitionBy("year").orderBy("at")
    return both.select(
        *ids, F.coalesce(F.abs(F.col("own") - F.col("winner_probability")) < 1e-9, F.lit(False)).alias("agrees"),
        ((F.col("own") > 0.5 + 1e-9) == (F.col("prediction") == 1)).alias("likelier_class"),
        (F.lag("winner_probability", 1, 2.0).over(later) >= F.col("winner_probability")).alias("in_order"))


@query(sql.full(" UNION ALL ".join(f"""
  SELECT '{c}' AS feature, ROUND((SELECT MIN(v) FROM (
           SELECT {c} AS v, ROW_NUMBER() OVER (ORDER BY {c}) AS n, COUNT(*) OVER () AS c
           FROM feat WHERE {c} IS NOT NULL AND year <= {TRAIN_CUTOFF}) WHERE 2 * n >= c), 6) AS median""" for c in RACE_MODEL_FEATURES)))
def forest_medians(spark, sf_dir):
    """What the forest fills in for missing values: the exact medians of the training rows."""
    fitted = _race_model(spark, sf_dir)[0].stages[0].surrogateDF
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("median")) for c in RACE_MODEL_FEATURES]))
    return rounded(fitted.select(pairs.alias("p")).select("p.*"))


@query(sql.full(f"""SELECT COUNT(*) AS rows, true AS optimal FROM seq
  WHERE step = 1 AND year <= {TRAIN_CUTOFF} - {VALIDATION_YEARS}""", sql.sequences("feat", SEQUENCE_FEATURES)))
def season_model_optimality(spark, sf_dir):
    """The chosen season model is the optimum of its loss over all training rows."""
    rows = staged(season_model.model_input(season_model.padded_sequences(_champ(spark, sf_dir), TRAIN_CUTOFF, VALIDATION_YEARS)), "model-input")
    model, strength = season_model.fit_best(rows)
    gradient = season_model.loss_gradient(model, rows.filter("split = 'train'"), strength)
    return gradient.select("rows", (F.col("norm") < 1e-5).alias("optimal"))


@query()
def feature_importance(spark, sf_dir):
    model, _ = _race_model(spark, sf_dir)
    return race_model.feature_importance(spark, model)


@query(sql.full("""SELECT CASE WHEN CAST('0x' || substr(md5(concat_ws('|', '42', year, round, driver_name, constructor_name)), 1, 7) AS INT) % 100 < 80
  THEN 'train' ELSE 'test' END AS part, COUNT(*) AS rows FROM feat GROUP BY ALL"""))
def fallback_split(spark, sf_dir):
    """The 80/20 split taken when no test season exists."""
    rows = race_model.model_rows(features.race_features(_season_rows(spark, sf_dir)))
    train, test = race_model.temporal_split(rows, 9999)
    parts = train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))
    return parts.groupBy("part").agg(F.count("*").alias("rows"))


@query()
def season_outcome_scores(spark, sf_dir):
    return season_model.scored_seasons(_champ(spark, sf_dir), TRAIN_CUTOFF, VALIDATION_YEARS)


# Landing completeness, with user-days of the event table as sessions and event types as endpoints.

_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
_EVENTS = """ev AS (
  SELECT DISTINCT CAST(year(ts) AS INT) AS year, user_id || '-' || strftime(ts, '%Y%m%d') AS session_key,
         event_type AS endpoint FROM events)"""


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.year("ts").alias("year"),
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("session_key"),
        F.col("event_type").alias("endpoint"),
    )


@query(f"""WITH {_EVENTS}
SELECT s.year, s.session_key, e.endpoint
FROM (SELECT DISTINCT year, session_key FROM ev) s
CROSS JOIN (VALUES {", ".join(f"('{e}')" for e in _EVENT_TYPES)}) AS e(endpoint)
ANTI JOIN ev ON ev.year = s.year AND ev.session_key = s.session_key AND ev.endpoint = e.endpoint""")
def landing_missing(spark, sf_dir):
    found = _landed(spark, sf_dir)
    return to_fetch(found.select("year", "session_key"), found, _EVENT_TYPES)


@query(f"""WITH {_EVENTS}
SELECT year, session_key FROM ev GROUP BY year, session_key HAVING COUNT(*) = {len(_EVENT_TYPES)}""")
def landing_complete(spark, sf_dir):
    found = _landed(spark, sf_dir)
    return complete_sessions(found.select("year", "session_key"), found, _EVENT_TYPES)


_LANDED = """SELECT event_id, CAST(year(ts) AS INT) AS year, CASE WHEN event_id % 10 = 0 THEN 'quali_' ELSE '' END || strftime(ts, '%Y%m') AS session_key,
  event_type AS endpoint, CAST(json_extract(props, '$.k') AS INT) AS k, value FROM events"""


def _landing(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A landing zone of all events (months as sessions, event types as endpoints, a tenth as qualifying) and its store.

    A second refresh must find nothing new.
    """
    root, store = (f"{scratch_dir(spark)}/{n}-{uuid.uuid4().hex[:8]}" for n in ("landing", "landed"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    prefix = F.when(F.col("event_id") % 10 == 0, "quali_").otherwise("")
    records = events.select(
        F.year("ts").alias("year"), F.concat(prefix, F.date_format("ts", "yyyyMM")).alias("session_key"), F.col("event_type").alias("endpoint"),
        "event_id", F.from_json("props", "k INT")["k"].alias("k"), "value")
    write_landing(records, root, ["year", "session_key", "endpoint"], ["event_id"])
    for endpoint in _EVENT_TYPES:
        for kind in (RACE, QUALIFYING):
            refresh(spark, root, store, endpoint, "event_id LONG, k INT, value DOUBLE", kind)
    if again := refresh(spark, root, store, _EVENT_TYPES[-1], "event_id LONG, k INT, value DOUBLE"):
        raise RuntimeError(f"{again} files were read twice")
    return root, store


@query(_LANDED)
def landing_records(spark, sf_dir):
    """All events written as landing files, taken by refreshes, read back by kind of session."""
    _, store = staged_landing(spark, sf_dir)
    parts = [taken_records(spark, store, e, kind) for e in _EVENT_TYPES for kind in (RACE, QUALIFYING)]
    return reduce(DataFrame.unionByName, parts).select("event_id", "year", "session_key", "endpoint", "k", "value")


@query(f"""SELECT * FROM ({_LANDED}) WHERE endpoint = 'view' AND session_key LIKE 'quali%'""")
def landing_qualifying(spark, sf_dir):
    """One endpoint of qualifying sessions, read straight from the landing files."""
    root, _ = staged_landing(spark, sf_dir)
    return read_landing(spark, root, "view", "event_id LONG, k INT, value DOUBLE", QUALIFYING)


@query(f"""SELECT year, session_key, endpoint, CASE WHEN session_key LIKE 'quali%' THEN 'qualifying' ELSE 'race' END AS kind,
  count(*) AS files FROM (SELECT DISTINCT year, session_key, endpoint FROM ({_LANDED})) GROUP BY ALL""")
def landing_manifest(spark, sf_dir):
    """The manifest has each landed file once."""
    _, store = staged_landing(spark, sf_dir)
    return manifest(spark, store).groupBy("year", "session_key", "endpoint", "kind").agg(F.count("*").alias("files"))


_STAGED_LANDINGS: dict[tuple[str, str], tuple[str, str]] = {}


def staged_landing(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STAGED_LANDINGS:
        _STAGED_LANDINGS[key] = _landing(spark, sf_dir)
    return _STAGED_LANDINGS[key]


@query(f"""SELECT event_id, CAST(year(ts) AS INT) AS year, user_id || '-' || strftime(ts, '%Y%m%d') AS session_key,
  event_type AS endpoint, CAST(json_extract(props, '$.k') AS INT) AS k FROM events""")
def landing_path_keys(spark, sf_dir):
    """Keys taken from a landing path, fields from the JSON record."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.date_format("ts", "yyyyMMdd")
    folder = F.concat(F.lit("/landing/"), F.year("ts"), F.lit("/"), "user_id", F.lit("-"), day)
    path = F.concat(folder, F.lit("/"), "event_type", F.lit(".json"))
    return events.select("event_id", *landing_keys(path)[:3], F.from_json("props", "k INT")["k"].alias("k"))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def inputs_missing(spark, sf_dir):
    """Expected inputs without a match among those found: documents that have no label."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").select("doc_id")
    return missing_inputs(read("documents"), read("labels"))


# Sinks: what is written is what is read.

@query(sql.full(f"SELECT {sql.columns(CHAMP_FEATURE_SET, _DOUBLES)} FROM feat"))
def features_by_season(spark, sf_dir):
    """The feature set by season, of which one season is written wrong first and then again by itself."""
    path, rows = _scratch(spark, "features"), _season_rows(spark, sf_dir)
    wrong = rows.withColumn("points", F.when(F.col("year") == TRAIN_CUTOFF, -1.0).otherwise(F.col("points")))
    write_features(wrong, CHAMP_FEATURE_SET, path, partition_by=features.BY)
    rewrite_features(rows.filter(F.col("year") == TRAIN_CUTOFF), CHAMP_FEATURE_SET, path, features.BY)
    return rounded(read_features(spark, path, CHAMP_FEATURE_SET))


@query(ORACLE["constructor_dominance"])
def published_summary(spark, sf_dir):
    """A summary published, and published again out of itself."""
    path = _scratch(spark, "summary")
    write_parquet(features.constructor_dominance(clean_rows(spark, sf_dir)), path)
    write_parquet(published(spark, path), path)
    return rounded(published(spark, path))


@query(sql.full(f"SELECT year, round, driver_name, constructor_name, CAST(is_winner AS DOUBLE) AS is_winner FROM feat WHERE year > {TRAIN_CUTOFF}"))
def published_predictions(spark, sf_dir):
    """Race predictions through their parquet table and the ordered CSV report."""
    path = _scratch(spark, "predictions")
    write_parquet(_race_scores(spark, sf_dir), f"{path}/table")
    export_csv(reports.ordered_race_predictions(published(spark, f"{path}/table")), f"{path}/report")
    rows = published(spark, f"{path}/report", published(spark, f"{path}/table").schema)
    return rows.select("year", "round", "driver_name", "constructor_name", "is_winner")


@query(ORACLE["driver_statistics"])
def reexported_csv(spark, sf_dir):
    """A CSV report sorted into another place, and there in its own."""
    path, table = _scratch(spark, "report"), features.driver_statistics(clean_rows(spark, sf_dir))
    export_csv(table, f"{path}/a")
    for source, target in (("a", "b"), ("b", "b")):
        reexport_csv(spark, f"{path}/{source}", table.schema, "driver_name", f"{path}/{target}")
    return rounded(published(spark, f"{path}/b", table.schema))


@query(ORACLE["master_join"])
def master_join_from_csv(spark, sf_dir):
    """The joined rows out of CSV files, through the reader of raw tables."""
    root = _scratch(spark, "raw")
    for name, df in star_tables(spark, sf_dir).items():
        df.write.option("header", True).csv(f"{root}/{name}.csv")
    loaded = {t: read_csv(spark, f"{root}/{t}.csv", t) for t in ("results", "races", "drivers", "constructors", "circuits", "status", "qualifying")}
    results = star_tables(spark, sf_dir)["results"]
    grid = F.coalesce(F.col("grid").cast("string"), F.lit("\\N")).alias("grid")
    rows = race_rows.joined_results(loaded).select(_MASTER)
    return rows.select(*[grid if c == "grid" else F.col(c).cast(results.schema[c].dataType) if c in results.columns else c for c in _MASTER])


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
