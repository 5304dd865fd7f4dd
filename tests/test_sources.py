"""CSV and JSON readers, input checks and sinks, on small files."""

import json
import logging
import re

import pytest
from pyspark.sql import functions as F

from gridline.fixed import LANDING_ENDPOINTS, REQUIRED_RAW_FILES
from gridline.functions.columns import keep_existing, require_columns
from gridline.plans import features, reports
from gridline.sources import landing, sinks, tables
from gridline.sources.schemas import TABLES

CSV = {
    "races": "raceId,year,round,circuitId,name,date,time\n1,2009,1,1,Opening,2009-03-29,06:00\n2,2009,2,1,Second,2009-04-05,\\N\n",
    "results": (
        "resultId,raceId,driverId,constructorId,number,grid,position,positionOrder,points,laps,fastestLapSpeed,statusId\n"
        "1,1,1,1,22,1,1,1,10,58,218.3,1\n2,1,2,1,\\N,\\N,2,2,8,58,\\N,2\n3,2,1,1,22,2,\\N,2,0,3,\\N,2\n"
        "3,2,1,1,22,2,\\N,2,0,3,\\N,2\n4,2,2,1,23,1,1,1,10,58,210.0,1\n"
    ),
    "drivers": "driverId,driverRef,forename,surname\n1,a,Ann,One\n2,b,Bo,Two\n",
    "constructors": "constructorId,constructorRef,name\n1,t,Team\n",
    "qualifying": "qualifyId,raceId,driverId,constructorId,position\n1,1,1,1,2\n2,1,2,1,1\n",
    "circuits": "circuitId,circuitRef,name\n1,c,Ring\n",
    "status": "statusId,status\n1,Finished\n2,Collision\n",
}


@pytest.fixture
def raw(tmp_path):
    for name, text in CSV.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return tmp_path


def test_csv_is_read_by_name_with_declared_types(spark, raw):
    got = tables.load_raw(spark, str(raw))
    assert set(got) == set(TABLES)
    results = got["results"]
    assert dict(results.dtypes)["grid"] == "int" and "number" in results.columns
    row = results.filter("resultId = 2").first()
    assert row.grid is None and row.fastestLapSpeed is None and row.points == 8.0
    assert str(got["races"].filter("raceId = 1").first().date) == "2009-03-29"


def test_optional_table_may_be_absent(spark, raw, caplog):
    with caplog.at_level(logging.WARNING):
        got = tables.load_raw(spark, str(raw))
    assert got["pit_stops"].count() == 0 and "pit_stops.csv not found" in caplog.text


def test_mandatory_table_must_exist(spark, raw):
    (raw / "status.csv").rename(raw / "other.csv")
    with pytest.raises(FileNotFoundError, match="status.csv"):
        tables.load_raw(spark, str(raw))


def test_direct_file_wins_over_sub_folder(spark, raw):
    sub = raw / "ergast"
    sub.mkdir()
    (raw / "status.csv").rename(sub / "status.csv")
    (sub / "circuits.csv").write_text("circuitId,name\n1,Wrong\n")
    got = tables.load_raw(spark, str(raw))
    assert got["status"].count() == 2 and got["circuits"].first().name == "Ring"


def test_required_inputs(spark, raw):
    with pytest.raises(FileNotFoundError) as e:
        tables.require_inputs(spark, str(raw))
    for f in ("pit_stops.csv", "lap_times.csv", "driver_standings.csv", "constructor_standings.csv"):
        assert f in str(e.value)
    assert "races.csv" not in str(e.value)
    for f in REQUIRED_RAW_FILES:
        if not (raw / f).exists():
            (raw / f).write_text("a\n1\n")
    tables.require_inputs(spark, str(raw))


def test_job_from_csv_to_feature_sets(spark, raw, tmp_path):
    out = tmp_path / "out"
    profile = features.run(tables.load_raw(spark, str(raw)), str(out), files=2).first()
    champ = tables.read_features(spark, f"{out}/champ_features.parquet", features.CHAMP_FEATURE_SET)
    assert champ.columns == features.CHAMP_FEATURE_SET and champ.count() == 4
    race = spark.read.parquet(f"{out}/race_features.parquet")
    assert sorted(race.columns) == sorted(features.RACE_FEATURE_SET) and race.columns[-1] == "year"
    assert {r.driver_name: r.wins for r in sinks.published(spark, f"{out}/driver_statistics.parquet").collect()} == {"Ann One": 1, "Bo Two": 1}
    assert sinks.published(spark, f"{out}/circuit_statistics.parquet").first().avg_dnf_rate == 0.5
    assert profile["points_mean"] == 7.0
    champions = {(r.year, r.driver_name) for r in champ.filter("won_championship = 1").collect()}
    assert champions == {(2009, "Bo Two")}


def test_column_checks(spark):
    df = spark.range(1).withColumn("a", F.lit(1))
    assert keep_existing(df, ["a", "zzz", "id"]).columns == ["a", "id"]
    with pytest.raises(ValueError, match="zzz"):
        require_columns(df, ["a", "zzz"])


def test_read_features_prunes(spark, tmp_path):
    spark.range(5).selectExpr("id", "id AS a", "id AS b").write.parquet(str(tmp_path / "f"))
    df = tables.read_features(spark, str(tmp_path / "f"), ["b", "nope"], required=["a"])
    assert df.columns == ["b"]
    assert "ReadSchema: struct<b:bigint>" in df._jdf.queryExecution().toString()


def _land(root, year, session, endpoint, records):
    folder = root / str(year) / str(session)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{endpoint}.json").write_text(json.dumps(records, indent=1))


def test_landing(spark, tmp_path):
    for endpoint in LANDING_ENDPOINTS:
        _land(tmp_path, 2023, 77, endpoint, [{"session_key": 77, "n": 1}, {"session_key": 77, "n": 2}] if endpoint == "laps" else [])
    _land(tmp_path, 2024, 88, "laps", [{"session_key": 88, "n": 3}])
    _land(tmp_path, 2024, "quali_99", "laps", [])
    laps = landing.read_landing(spark, str(tmp_path), "laps", "n int")
    assert sorted(tuple(r) for r in laps.collect()) == [(2023, "77", "laps", 1), (2023, "77", "laps", 2), (2024, "88", "laps", 3)]

    found = landing.landed_files(spark, str(tmp_path))
    assert found.filter("endpoint = 'pit'").first().length == 2
    sessions = spark.createDataFrame([(2023, "77"), (2024, "88"), (2025, "1")], "year int, session_key string")
    missing = landing.to_fetch(sessions, found).groupBy("session_key").count().collect()
    assert {r.session_key: r["count"] for r in missing} == {"88": 7, "1": 8}
    assert [r.session_key for r in landing.complete_sessions(sessions, found).collect()] == ["77"]
    quali = spark.createDataFrame([(2024, "quali_99"), (2024, "quali_5")], "year int, session_key string")
    assert [r.session_key for r in landing.to_fetch(quali, found, ["laps"]).collect()] == ["quali_5"]


def test_landing_refresh(spark, tmp_path):
    root, store = str(tmp_path / "landing"), str(tmp_path / "store")
    for session, n in (("77", 2), ("78", 0), ("quali_79", 1)):
        _land(tmp_path / "landing", 2023, session, "laps", [{"n": i} for i in range(n)])
    _land(tmp_path / "landing", 2023, "77", "pit", [{"n": 9}])
    take = lambda kind=landing.RACE: landing.refresh(spark, root, store, "laps", "n int", kind, batch_files=1)
    got = lambda kind=landing.RACE: sorted(tuple(r) for r in landing.taken_records(spark, store, "laps", kind).collect())
    assert (take(), take()) == (2, 0)
    assert got() == [(2023, "77", "laps", 0), (2023, "77", "laps", 1)]
    assert (take(landing.QUALIFYING), take(landing.QUALIFYING)) == (1, 0) and got(landing.QUALIFYING) == [(2023, "quali_79", "laps", 0)]
    # A file written again replaces its records, another one is added, and records without manifest rows do not count.
    _land(tmp_path / "landing", 2023, "77", "laps", [{"n": 5}, {"n": 6}, {"n": 7}])
    _land(tmp_path / "landing", 2024, "80", "laps", [{"n": 8}])
    spark.createDataFrame([("x", 2023, "77", "laps", "race", 99)], "path string, year int, session_key string, endpoint string, kind string, n int").write.parquet(
        f"{store}/race/laps/batch=cutoff")
    assert (take(), take()) == (2, 0)
    assert got() == [(2023, "77", "laps", 5), (2023, "77", "laps", 6), (2023, "77", "laps", 7), (2024, "80", "laps", 8)]
    assert landing.manifest(spark, store).count() == 4


def test_csv_export_and_reexport(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "year int, name string")
    kind, x, y = "year int, name string", str(tmp_path / "x"), str(tmp_path / "y")
    sinks.export_csv(df, x, single_file=True)
    for target in (y, x):  # a table may be sorted in its own place
        sinks.reexport_csv(spark, x, kind, "year", target)
        parts = list((tmp_path / target / sinks.published_folder(spark, target).rsplit("/", 1)[1]).glob("part-*.csv"))
        assert len(parts) == 1 and parts[0].read_text() == "year,name\n1,a\n2,b\n3,c\n"


def test_a_lost_writer_leaves_the_published_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.published(spark, path)
    sinks.publish(spark.range(3), path)
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.publish(broken, path)
    assert sinks.published(spark, path).count() == 3
    sinks.publish(sinks.published(spark, path).union(spark.range(1)), path)
    assert sinks.published(spark, path).count() == 4


def test_one_season_is_rewritten_without_the_others(spark, tmp_path):
    path, columns = str(tmp_path / "f"), ["year", "a"]
    sinks.write_features(spark.createDataFrame([(2000, 1), (2001, 2), (2001, 3), (None, 4)], "year int, a int"), columns, path, partition_by=("year",))
    before = {p.name for p in (tmp_path / "f" / "year=2000").iterdir()}
    sinks.rewrite_features(spark.createDataFrame([(2001, 9)], "year int, a int"), columns, path, ("year",))
    assert {p.name for p in (tmp_path / "f" / "year=2000").iterdir()} == before
    rows = tables.read_features(spark, path, columns).collect()
    assert sorted(rows, key=str) == sorted([(2000, 1), (2001, 9), (None, 4)], key=str)


def test_later_jobs_skip_seasons(spark, tmp_path):
    df = spark.range(40).selectExpr("cast(2000 + id % 4 as int) year", "cast(id as int) round", "'Hamilton' driver_name", "1.0 rolling_avg_finish")
    sinks.write_features(df, df.columns, str(tmp_path / "f"), partition_by=("year",))
    rows = spark.read.parquet(str(tmp_path / "f"))
    text = reports.driver_momentum(rows)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(year#\d+\), \(year#\d+ = (Scalar)?[Ss]ubquery", text), text
    text = rows.filter(F.col("year") <= 2001)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in text and "PushedFilters: []" in text


def test_features_can_be_partitioned_by_year(spark, tmp_path):
    df = spark.createDataFrame([(2000, 1), (2001, 2)], "year int, a int")
    sinks.write_features(df, ["year", "a"], str(tmp_path / "p"), partition_by=("year",))
    plan = spark.read.parquet(str(tmp_path / "p")).filter("year = 2001")
    assert plan.first().a == 2 and "PartitionFilters: [isnotnull(year" in plan._jdf.queryExecution().toString()


def test_reused_releases(spark):
    df = spark.range(3)
    with sinks.reused(df) as kept:
        assert kept.count() == 3 and kept.storageLevel.useMemory
    assert not df.storageLevel.useMemory


def test_exact_paths_among_many_folders(spark, tmp_path):
    for d in [*(f"other{i}" for i in range(30)), "old/" + tables.RAW_SUBDIRS[0], tmp_path.name]:
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "races.csv").write_text("raceId\n1\n")
    assert tables._found(spark, str(tmp_path)) == set()
    (tmp_path / tables.RAW_SUBDIRS[0]).mkdir(exist_ok=True)
    (tmp_path / tables.RAW_SUBDIRS[0] / "races.csv").write_text("raceId\n1\n")
    (tmp_path / "results.csv").write_text("raceId\n1\n")
    assert tables._found(spark, str(tmp_path)) == {f"{tables.RAW_SUBDIRS[0]}/races.csv", "results.csv"}


def test_unreadable_values_are_counted(spark, raw):
    assert tables.unreadable_values(spark, str(raw)) == {}
    (raw / "results.csv").write_text("resultId,raceId,driverId,positionOrder,grid,points\n1,1,1,R,3.5,x\n2,1,2,2,\\N,y\n3,1,3,3,4,7.5\n")
    (raw / "races.csv").write_text("raceId,year,date\n1,2009,soon\n2,,2009-01-01\n")
    assert tables.unreadable_values(spark, str(raw)) == {"results.positionOrder": 1, "results.grid": 1, "results.points": 2, "races.date": 1}


def test_whole_numbers_written_with_a_point(spark, tmp_path):
    (tmp_path / "results.csv").write_text("raceId,driverId,positionOrder,grid,points\n1.0,7.0,1.0,3.5,2.5\n")
    row = tables.read_csv(spark, str(tmp_path / "results.csv"), "results").first()
    assert (row.raceId, row.driverId, row.positionOrder, row.grid, row.points) == (1, 7, 1, None, 2.5)
    (tmp_path / "bad.csv").write_text("raceId,driverId\nx,7\n")
    with pytest.raises(Exception, match="raceId is not a whole number"):
        tables.read_csv(spark, str(tmp_path / "bad.csv"), "results").collect()
