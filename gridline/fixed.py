"""Names, orders, defaults and cut-offs that results depend on."""

# Columns cast to double after sentinel removal, and the values that replace nulls.
NULL_SENTINEL = "\\N"
NUMERIC_COLUMNS = ["positionOrder", "grid", "points", "laps", "fastestLapSpeed", "quali_position"]
NULL_DEFAULTS = {"points": 0.0, "grid": 20.0, "quali_position": 20.0, "fastestLapSpeed": 0.0}
FINISHED_STATUS = "Finished"

# Raw tables and files.
RAW_SUBDIRS = ["ergast"]
REQUIRED_RAW_FILES = [
    "races.csv", "results.csv", "drivers.csv", "constructors.csv", "qualifying.csv",
    "pit_stops.csv", "lap_times.csv", "driver_standings.csv", "constructor_standings.csv",
    "circuits.csv", "status.csv",
]
LANDING_ENDPOINTS = [
    "laps", "stints", "pit", "intervals", "weather", "race_control", "position", "drivers",
]

# Feature-set column orders.
CHAMP_FEATURE_SET = [
    "driver_id", "driverId", "driver_name", "constructor_name", "year", "round", "circuit_name",
    "final_position", "points", "cumulative_points", "cumulative_wins", "gap_to_leader",
    "races_remaining", "rolling_avg_finish", "rolling_dnfs", "rolling_points_last_3",
    "rolling_wins_last_5", "momentum_score", "consistency_score", "podium_rate", "win_rate",
    "reliability_score", "avg_finish_last_3", "positions_gained", "dnfs_last_5",
    "constructor_avg_points", "constructor_cumulative_points", "constructor_rolling_points",
    "constructor_momentum", "avg_finish_at_circuit", "career_races", "is_champion",
    "won_championship",
]
RACE_FEATURE_SET = [
    "driverId", "driver_name", "constructor_name", "year", "round", "circuit_name", "grid",
    "quali_position", "final_position", "points", "positions_gained", "avg_finish_last_3",
    "rolling_avg_finish", "constructor_avg_points", "avg_finish_at_circuit", "dnfs_last_5",
    "is_winner",
]

# Race-winner model.
RACE_MODEL_FEATURES = [
    "grid", "quali_position", "rolling_avg_finish", "avg_finish_last_3",
    "constructor_avg_points", "avg_finish_at_circuit", "dnfs_last_5", "positions_gained",
]
RACE_TARGET = "is_winner"
FOREST = {"numTrees": 200, "maxDepth": 8, "minInstancesPerNode": 5, "subsamplingRate": 0.8, "seed": 42}

# Season-outcome model.
SEQUENCE_FEATURES = [
    "final_position", "points", "cumulative_wins", "races_remaining", "rolling_avg_finish",
    "rolling_dnfs", "rolling_points_last_3", "rolling_wins_last_5", "momentum_score",
    "consistency_score", "podium_rate", "win_rate", "reliability_score",
    "constructor_cumulative_points", "constructor_rolling_points", "constructor_momentum",
    "career_races",
]
SEASON_TARGET = "won_championship"
SEQUENCE_STEPS = 5
SEQUENCE_MIN_ROWS = 3
CHAMPION_WEIGHT = 25.0
STD_EPSILON = 1e-8

# Temporal split: train up to the cut-off year; validation is its last five years.
TRAIN_CUTOFF = 2018
VALIDATION_YEARS = 5
RANDOM_SEED = 42

# Chart selections.
MOMENTUM_NAMES = ["Verstappen", "Hamilton", "Alonso"]
COMPARED_CONSTRUCTORS = ["Ferrari", "Mercedes", "Red Bull", "McLaren"]
CURVE_DRIVERS = 6
DNF_CIRCUITS = 12
