"""Null, tie and edge rules on hand-made tables."""

import datetime

import pytest

from gridline.operators import scoring
from gridline.operators.sequences import Scaler, build_sequences, padded, sequence_rows
from gridline.plans import features, form
from gridline.plans.race_rows import joined_results, race_rows
from gridline.plans.reports import title_probability_curves
from gridline.sources.scratch import staged


def tables(spark, results, races=None, qualifying=(), status=((1, "Finished"), (2, "+1 Lap"), (3, "Engine"))):
    rounds = sorted({r[0] for r in results})
    races = races or [(r, 2000 + r // 100, r % 100, r % 100) for r in rounds]
    day = lambda y, m: datetime.date(y, min(m, 12), 1)
    drivers = sorted({r[1] for r in results})
    teams = sorted({r[2] for r in results})
    return {
        "results": spark.createDataFrame(
            [tuple(r) for r in results],
            "raceId int, driverId bigint, constructorId int, statusId int, positionOrder string, grid string, points double, laps int",
        ),
        "races": spark.createDataFrame(
            [(i, y, n, c, f"Race {n}", day(y, n)) for i, y, n, c in races],
            "raceId int, year int, round int, circuitId int, name string, date date",
        ),
        "drivers": spark.createDataFrame([(d, "Dee", f"{d:03d}") for d in drivers], "driverId bigint, forename string, surname string"),
        "constructors": spark.createDataFrame([(t, f"Team {t}") for t in teams], "constructorId int, name string"),
        "circuits": spark.createDataFrame([(c, f"Circuit {c}") for c in sorted({r[3] for r in races})], "circuitId int, name string"),
        "status": spark.createDataFrame(list(status), "statusId int, status string"),
        "qualifying": spark.createDataFrame(list(qualifying), "raceId int, driverId bigint, position int"),
    }


def rows_of(spark, *args, **kwargs):
    return staged(race_rows(tables(spark, *args, **kwargs)))


def season_of(spark, *args, **kwargs):
    return features.season_rows(rows_of(spark, *args, **kwargs))


def test_first_race(spark):
    row = season_of(spark, [(1, 1, 1, 1, "4", "2", 5.0, 50)]).first()
    assert row.career_races == 0
    assert row.avg_finish_at_circuit is None and row.wins_at_circuit is None
    assert row.finish_position_stddev is None and row.consistency_score is None
    assert row.races_remaining == 0 and row.gap_to_leader == 0 and row.is_champion == 1


def test_null_sentinel_and_defaults(spark):
    row = rows_of(spark, [(1, 1, 1, 1, "\\N", "\\N", None, 50)]).first()
    assert row.grid == 20.0 and row.points == 0.0 and row.quali_position == 20.0
    assert row.final_position is None and row.positions_gained is None
    assert (row.is_winner, row.is_podium) == (0, 0)


def test_grid_zero_is_kept(spark):
    assert rows_of(spark, [(1, 1, 1, 1, "1", "0", 9.0, 1)]).first().grid == 0.0


def test_unreadable_number_becomes_null(spark):
    assert rows_of(spark, [(1, 1, 1, 1, "first", "1", 9.0, 1)]).first().final_position is None


def test_status_flags(spark):
    got = {r.driverId: r.is_dnf for r in rows_of(
        spark, [(1, 1, 1, 1, "1", "1", 9.0, 1), (1, 2, 1, 2, "2", "2", 6.0, 1), (1, 3, 1, 99, "3", "3", 4.0, 1)]
    ).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_tied_champions(spark):
    season = season_of(spark, [(1, 1, 1, 1, "1", "1", 8.0, 1), (1, 2, 2, 1, "2", "2", 8.0, 1), (1, 3, 2, 1, "3", "3", 1.0, 1)])
    got = {r.driverId: (r.season_rank, r.is_champion) for r in form.with_season_ranks(season).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 0)}


def test_team_mates_are_ordered_by_driver(spark):
    results = [(n, d, 7, 1, str(d), str(d), float(10 * n + d), 1) for n in range(1, 7) for d in (1, 2)]
    got = {(r["round"], r.driverId): r.constructor_rolling_points for r in form.team_form(rows_of(spark, results)).collect()}
    points = [10 * n + d for n in range(1, 7) for d in (1, 2)]
    want = {(n, d): sum(w) / len(w) for i, (n, d) in enumerate((n, d) for n in range(1, 7) for d in (1, 2))
            for w in [points[max(0, i - 4): i + 1]]}
    assert got == pytest.approx(want)


def test_absent_leader(spark):
    results = [(1, 1, 1, 1, "1", "1", 25.0, 1), (1, 2, 2, 1, "2", "2", 18.0, 1), (2, 2, 2, 1, "1", "1", 2.0, 1)]
    got = {(r["round"], r.driverId): r.gap_to_leader for r in season_of(spark, results).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 7.0, (2, 2): 0.0}


def test_duplicates(spark):
    one = (1, 1, 1, 1, "1", "1", 9.0, 1)
    twice = tables(spark, [one, one], qualifying=[(1, 1, 3), (1, 1, 5)])
    assert joined_results(twice).count() == 4
    rows = race_rows(twice).collect()
    assert sorted(r.quali_position for r in rows) == [3.0, 5.0]


def test_missing_dimension_keeps_the_result(spark):
    t = tables(spark, [(1, 1, 1, 1, "1", "1", 9.0, 1)])
    t["races"] = t["races"].filter("raceId = -1")
    row = race_rows(t).first()
    assert row.year is None and row.circuit_name is None and row.driver_name == "Dee 001"


def test_results_without_a_race_form_their_own_season(spark):
    t = tables(spark, [(1, 1, 1, 1, "1", "1", 9.0, 1), (1, 2, 1, 1, "2", "2", 6.0, 1)])
    t["races"] = t["races"].filter("raceId = -1")
    got = {r.driverId: (r.is_champion, r.gap_to_leader, r.races_remaining)
           for r in features.season_rows(staged(race_rows(t))).collect()}
    assert got == {1: (1, 0.0, None), 2: (0, 3.0, None)}


def test_short_seasons(spark):
    lengths = {1: 2, 2: 3, 3: 4, 4: 6}
    results = [(n, d, d, 1, str(d), str(d), float(n), 1) for d, k in lengths.items() for n in range(1, k + 1)]
    champ = features.champ_features(season_of(spark, results))
    got = {r.driver_id: r for r in padded(build_sequences(sequence_rows(champ))).collect()}
    assert sorted(got) == ["2", "3", "4"]
    points = {d: [step[1] for step in r.sequence] for d, r in got.items()}
    assert points == {"2": [1.0, 2.0, 3.0, 0.0, 0.0], "3": [1.0, 2.0, 3.0, 4.0, 0.0], "4": [1.0, 2.0, 3.0, 4.0, 5.0]}
    assert got["4"].driver_name == "Dee 004"
    assert all(len(step) == 17 for r in got.values() for step in r.sequence)


def test_sequence_columns_are_coerced(spark):
    champ = spark.createDataFrame(
        [("1", "A", 2000, n, "x" if n == 1 else "4", float("nan"), None) for n in (1, 2, 3)],
        "driver_id string, driver_name string, year int, round int, final_position string, points double, won_championship int",
    )
    row = build_sequences(sequence_rows(champ)).first()
    assert row.sequence == [[0.0, 0.0], [4.0, 0.0], [4.0, 0.0]] and row.label == 0


def test_scaler_counts_padding(spark):
    rows = padded(spark.createDataFrame([([[2.0], [4.0], [6.0]],)], "sequence array<array<double>>"), ["f"])
    scaler = Scaler.fit(rows, 1)
    assert scaler.mean[0] == pytest.approx(12 / 5)
    assert scaler.std[0] == pytest.approx((56 / 5 - (12 / 5) ** 2) ** 0.5 + 1e-8)


def scored(spark, rows):
    return spark.createDataFrame(rows, "driver_id string, driver_name string, year int, label int, prob double")


def test_picks_ties_and_missing_champion(spark):
    picks = scoring.champion_picks(scored(spark, [
        ("9", "Nine", 2001, 1, 0.5), ("10", "Ten", 2001, 0, 0.5), ("3", "Three", 2001, 0, 0.1),
        ("1", "One", 2002, 0, 0.12345), ("2", "Two", 2003, 1, 0.9),
    ])).collect()
    assert [tuple(r) for r in picks] == [
        (2001, "Ten", "Nine", 0.5, 0), (2002, "One", "?", 0.123, 0), (2003, "Two", "Two", 0.9, 1),
    ]


def test_top_k_skips_seasons_without_champion(spark):
    rows = [("1", "A", 2001, 0, 0.9), ("2", "B", 2001, 1, 0.8), ("3", "C", 2002, 0, 0.7), ("4", "D", 2003, 1, 0.1), ("5", "E", 2003, 0, 0.2)]
    assert scoring.top_k_accuracy(scored(spark, rows), 1).first().accuracy == 0.0
    assert scoring.top_k_accuracy(scored(spark, rows), 2).first().accuracy == 1.0
    assert scoring.top_k_accuracy(scored(spark, [r for r in rows if r[2] == 2002]), 3).first().accuracy == 0.0


def test_auc_by_pairs(spark):
    rows = [(str(i), "x", 2000, i % 3 == 0, float(i * 7 % 5)) for i in range(30)]
    rows = [(a, b, c, int(d), e) for a, b, c, d, e in rows]
    pos, neg = [r[4] for r in rows if r[3]], [r[4] for r in rows if not r[3]]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert scoring.exact_auc(scored(spark, rows)).first().auc == pytest.approx(want)
    assert scoring.exact_auc(scored(spark, [r for r in rows if r[3]])).first().auc is None


def test_classification_metrics_match_library(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    df = spark.createDataFrame([(float(i % 4 == 0), float(i % 3 == 0)) for i in range(40)], "label double, prediction double")
    ours = scoring.classification_metrics(df).first()
    for name, value in (("accuracy", ours.accuracy), ("f1", ours.f1)):
        assert MulticlassClassificationEvaluator(metricName=name).evaluate(df) == pytest.approx(value)


def test_zero_point_round(spark):
    champ = features.champ_features(season_of(spark, [(1, 1, 1, 1, "1", "1", 0.0, 1), (1, 2, 1, 1, "2", "2", 0.0, 1)]))
    assert [r.championship_probability for r in title_probability_curves(champ).collect()] == [0.0, 0.0]


def test_a_driver_without_a_score_is_no_pick(spark):
    from gridline.operators.scoring import champion_picks

    rows = [("a", "A", 2000, 0, None), ("b", "B", 2000, 1, 0.9), ("c", "C", 2001, 1, None)]
    picks = champion_picks(spark.createDataFrame(rows, "driver_id string, driver_name string, year int, label int, prob double")).collect()
    assert [(p.predicted, p.actual, p.prob, p.correct) for p in picks] == [("B", "B", 0.9, 1), (None, "C", None, 0)]
