"""The command-line jobs, in their order, from CSV files written out of the season star."""

import json

import pytest

from gridline.__main__ import main
from gridline.plans.season_star import star_tables
from gridline.session import scratch_dir
from gridline.sources.scratch import staged
from gridline.sources.sinks import published_folder


@pytest.fixture(scope="module")
def raw(spark, sf_dir, tmp_path_factory):
    """CSV tables with seasons moved to 2013-2019, so that the fixed cut-off year splits them."""
    root = tmp_path_factory.mktemp("raw")
    for name, df in star_tables(spark, sf_dir).items():
        if name == "races":
            df = df.selectExpr("raceId", "year + 18 AS year", "round", "circuitId", "name", "add_months(date, 216) AS date")
        df.toPandas().to_csv(root / f"{name}.csv", index=False, na_rep="\\N")
    return root


def test_jobs_in_order(spark, raw, tmp_path, capsys):
    out = str(tmp_path / "out")
    results = {}
    for job in ("features", "season-model", "race-model", "charts", "tables"):
        main([job, "--raw", str(raw), "--out", out])
        results[job] = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert results["features"]["year_mean"] > 2013 and results["features"]["wet_race_mean"] == 0
    assert 0.5 < results["race-model"]["auc"] <= 1
    race = results["race-model"]
    assert race["rows"] == race["train_rows"] + race["test_rows"] and race["tp"] + race["fp"] + race["fn"] + race["tn"] == race["test_rows"]
    season = results["season-model"]
    assert season["seasons"] == season["champion_seasons"] == 7 and season["sequences"] > season["champions"] > 0
    assert len(season["highest_scores"]) == 5 and season["highest_scores"][0][2] == season["max_prob"]
    assert 0 <= results["season-model"]["top3"] <= results["season-model"]["top5"] <= 1
    read = lambda name: spark.read.option("header", True).csv(published_folder(spark, f"{out}/reports/{name}.csv"))
    assert read("top_dnf_circuits").count() == 12
    assert read("title_probability_curves").select("driver_name").distinct().count() == 6
    assert [r.year for r in read("championship_predictions").collect()] == [r.year for r in read("season_pick_bars").collect()] == ["2019"]


def test_features_need_raw(tmp_path):
    with pytest.raises(SystemExit):
        main(["features", "--out", str(tmp_path)])


def test_intermediate_tables_go_to_the_named_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    table = staged(spark.range(3), "probe")
    assert scratch_dir(spark) in table.inputFiles()[0].replace("file://", "")
    if base:
        assert scratch_dir(spark).startswith(base.rstrip("/"))
    assert table.count() == 3


def test_features_name_missing_inputs(spark, raw, tmp_path):
    for name in ("races", "results"):
        (tmp_path / f"{name}.csv").write_text((raw / f"{name}.csv").read_text())
    with pytest.raises(FileNotFoundError, match="circuits.csv.*status.csv"):
        main(["features", "--raw", str(tmp_path), "--out", str(tmp_path / "out")])
    with pytest.raises(FileNotFoundError, match="lap_times.csv"):
        main(["inputs", "--raw", str(tmp_path), "--out", str(tmp_path / "out")])


def test_landing_job(tmp_path, capsys):
    folder = tmp_path / "raw" / "2024" / "7"
    folder.mkdir(parents=True)
    (folder / "laps.json").write_text('[{"lap": 1}, {"lap": 2}]')
    for taken in (1, 0):
        main(["landing", "--raw", str(tmp_path / "raw"), "--out", str(tmp_path), "--endpoint", "laps", "--schema", "lap INT"])
        assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"files": taken, "records": 2}
