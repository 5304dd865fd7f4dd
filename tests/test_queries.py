"""Every registered query against its SQL, or for rows where it has none."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as contract
from compare import difference, duck
from gridline import catalog

QUERIES = contract.queries()
ORACLE = contract.oracle_sql()


def test_season_queries_do_without_the_corpus_modules():
    """A library of the corpus operators that is not there takes only their queries away."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as c; print(*c.queries())"
    root = os.path.dirname(os.path.abspath(contract.__file__))
    names = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert set(names) == set(catalog.QUERIES) and len(names) > 60


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_oracle_keys_are_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLE[name]) is None


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and rows[0].__fields__ == ["round", "driver_name", "championship_probability"]


def test_cumulative_invariants(spark, sf_dir):
    champ = QUERIES["champ_features"](spark, sf_dir)
    champ.createOrReplaceTempView("champ_invariants")
    row = spark.sql("""
        WITH ends AS (SELECT driverId, year, MAX(cumulative_points) c, SUM(points) p FROM champ_invariants GROUP BY 1, 2),
             gaps AS (SELECT year, round, MIN(gap_to_leader) g FROM champ_invariants GROUP BY 1, 2),
             rest AS (SELECT year, MIN(races_remaining) r FROM champ_invariants GROUP BY 1),
             titles AS (SELECT year, COUNT(DISTINCT driverId) n FROM champ_invariants WHERE is_champion = 1 GROUP BY 1)
        SELECT (SELECT COUNT(*) FROM ends WHERE c <> p) + (SELECT COUNT(*) FROM gaps WHERE g <> 0)
             + (SELECT COUNT(*) FROM rest WHERE r <> 0) AS bad,
               (SELECT COUNT(*) FROM titles) AS seasons, (SELECT COUNT(DISTINCT year) FROM champ_invariants) AS years
    """).first()
    assert row.bad == 0 and row.seasons == row.years


def test_wins_agree(spark, sf_dir):
    by_team = QUERIES["constructor_dominance"](spark, sf_dir).groupBy().sum("total_wins").first()[0]
    by_driver = QUERIES["driver_statistics"](spark, sf_dir).groupBy().sum("wins").first()[0]
    assert by_team == by_driver > 0
