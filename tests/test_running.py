"""Groups cut into blocks give what plain windows give, for any cut."""

import collections
import fractions
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

import gridline.operators.groups as groups_module
import gridline.operators.places as places_module
import gridline.operators.running as running_module
from gridline.operators.groups import OrderedGroups, all_ordered_groups, ordered_groups
from gridline.operators.running import Running, add_all, add_running, before, last, peak, row_number, so_far, whole
from gridline.session import GROUP_ROWS_KEY
from gridline.sources.scratch import staged

FEATURES = {
    "rn": row_number(), "n_before": before("count"), "n_x": before("count", "x"),
    "sum3": last(3, "sum", "x"), "avg5": last(5, "avg", "y"), "min4": last(4, "min", "x"), "max2": last(2, "max", "y"),
    "sd5": last(5, "stddev", "x"), "cum": so_far("sum", "y"), "cum_min": so_far("min", "x"),
    "avg_before": before("avg", "x"), "sum_before": before("sum", "x"),
    "sd_far": so_far("stddev", "y"), "sd_before": before("stddev", "x"), "top": peak("y"), "top_x": peak("x"),
    "all_avg": whole("avg", "x"), "all_sum": whole("sum", "y"), "all_max": whole("max", "x"), "all_sd": whole("stddev", "x"),
}


def _rows(seed, n=600):
    """A third of the rows in one group, half of the rest in the null group, positions tied and missing."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = 1 if rnd.random() < 1 / 3 else (None if rnd.random() < 0.5 else rnd.randrange(2, 40))
        x = None if rnd.random() < 0.2 else rnd.randrange(-9, 30)
        o = None if rnd.random() < 0.05 else rnd.randrange(12)
        rows.append((k, o, i, x, float(rnd.randrange(100)) / 4))
    return rows


@pytest.fixture
def small_groups(spark):
    def use(rows):
        spark.conf.set(GROUP_ROWS_KEY, str(rows))
    yield use
    spark.conf.unset(GROUP_ROWS_KEY)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("seed,limit", [(1, 7), (2, 1), (3, 50), (4, 199)])
def test_blocks_equal_plain_windows(spark, small_groups, seed, limit):
    df = staged(spark.createDataFrame(_rows(seed), "k int, o int, id int, x int, y double"))
    small_groups(limit)
    groups = ordered_groups(df, ["k"], ["o", "id"])
    assert groups.cut
    plain = OrderedGroups(groups.keys, groups.order)
    got = {r["id"]: r for r in add_running(df, groups, FEATURES).collect()}
    want = {r["id"]: r for r in add_running(df, plain, FEATURES).collect()}
    assert got.keys() == want.keys()
    for i, row in want.items():
        for c in FEATURES:
            assert _same(got[i][c], row[c]), (i, c, got[i][c], row[c])
    assert add_running(df, groups, FEATURES).columns == add_running(df, plain, FEATURES).columns


def test_hot_group_is_spread(spark, small_groups):
    df = staged(spark.createDataFrame(_rows(5, 3000), "k int, o int, id int, x int, y double"))
    small_groups(100)
    groups = ordered_groups(df, ["k"], ["o", "id"])
    blocks = groups.with_block(df).filter("k = 1").groupBy("_block").count().collect()
    assert len(blocks) >= 8
    assert max(r["count"] for r in blocks) <= 200


def test_one_position_holding_everything_is_split_by_the_next_order_column(spark, small_groups):
    df = staged(spark.range(2000).select(F.lit(1).alias("k"), F.lit(3).alias("o"), F.col("id")))
    small_groups(100)
    groups = ordered_groups(df, ["k"], ["o", "id"])
    out = add_running(df, groups, {"rn": row_number()})
    assert out.filter("rn <> id + 1").count() == 0
    assert groups.with_block(df).select("_block").distinct().count() >= 15


def test_no_statistics_below_the_limit(spark):
    df = spark.range(10).withColumn("k", F.lit(1))
    assert ordered_groups(df, ["k"], ["id"], rows_at_most=10).cuts is None
    assert ordered_groups(df, ["k"], ["id"]).cuts is None


def test_more_blocks_than_may_be_broadcast(spark, small_groups, monkeypatch):
    """Beyond the bound on cut points rows are cut by their exact places."""
    df = staged(spark.createDataFrame(_rows(8), "k int, o int, id int, x int, y double"))
    small_groups(25)
    monkeypatch.setattr(groups_module, "MAX_BLOCKS", 10)
    groups = ordered_groups(df, ["k"], ["o", "id"])
    assert groups.block_rows == 25 and groups.cuts is None
    sizes = groups.with_block(df).groupBy("k", "_block").count().collect()
    assert max(r["count"] for r in sizes) == 25
    plain = OrderedGroups(groups.keys, groups.order)
    got = {r["id"]: r for r in add_running(df, groups, FEATURES).collect()}
    for i, row in {r["id"]: r for r in add_running(df, plain, FEATURES).collect()}.items():
        for c in FEATURES:
            assert _same(got[i][c], row[c]), (i, c, got[i][c], row[c])


def test_splits_share_one_written_table(spark, small_groups, monkeypatch):
    """Three splits cut at once: one shuffle of the rows each, one table, two scans of it."""
    written = []
    monkeypatch.setattr(running_module, "staged", lambda df, name: (written.append((name, df)), staged(df, name))[1])
    df = staged(spark.createDataFrame(_rows(9), "k int, o int, id int, x int, y double").withColumn("g", F.col("id") % 3))
    small_groups(20)
    keys = [(["k"], ["o", "id"]), (["k", "g"], ["id"]), (["g"], ["id"])]
    groups = all_ordered_groups(df, keys)
    assert all(g.cut for g in groups)
    wanted = [{f"{n}_{j}": f for n, f in FEATURES.items()} for j in range(3)]
    out = add_all(df, list(zip(groups, wanted)))
    assert [n for n, _ in written] == ["block-windows", "block-ends"]
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", re.sub(r"#\d+L?", "", written[0][1]._jdf.queryExecution().executedPlan().toString()))
    assert shuffles == ["g, _r2_block", "k, g, _r1_block", "k, _r0_block"]
    text = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet [^\n]*block-windows", text)) == 1
    plain = add_all(df, [(OrderedGroups(g.keys, g.order), w) for g, w in zip(groups, wanted)])
    assert out.columns == plain.columns
    got = {r["id"]: r for r in out.collect()}
    for row in plain.collect():
        for c in plain.columns:
            assert _same(got[row["id"]][c], row[c]), c


def test_splits_by_place_are_numbered_before_any_window(spark, small_groups, monkeypatch):
    """More blocks than may be broadcast, three splits: null keys and values, tied and repeated rows."""
    written = []
    monkeypatch.setattr(places_module, "staged", lambda df, name: (written.append((name, df)), staged(df, name))[1])
    monkeypatch.setattr(groups_module, "MAX_BLOCKS", 10)
    once = spark.createDataFrame(_rows(10), "k int, o int, id int, x int, y double").withColumns({"g": F.col("id") % 3, "text": F.concat(F.lit("t"), "id")})
    df = staged(once.union(once.where("id % 4 = 0")))
    small_groups(5)
    groups = all_ordered_groups(df, [(["k"], ["o", "id"]), (["k", "g"], ["id"]), (["g"], ["o", "id"])])
    assert all(g.block_rows == 5 for g in groups)
    wanted = [{f"{n}_{j}": f for n, f in FEATURES.items()} for j in range(3)]
    wanted[1]["y"] = so_far("sum", "x")  # a name of the rows themselves
    out = add_all(df, list(zip(groups, wanted)))
    assert [n for n, _ in written] == ["in-order"] * 3
    assert all("Window" not in d._jdf.queryExecution().executedPlan().toString().replace("Window [sum(_n", "") for _, d in written)
    plain = add_all(df, [(OrderedGroups(g.keys, g.order), w) for g, w in zip(groups, [wanted[0], {n: f for n, f in wanted[1].items() if n != "y"}, wanted[2]])])
    replaced = add_running(df, OrderedGroups(groups[1].keys, groups[1].order), {"y": wanted[1]["y"]}).select("k", "id", "y")
    tidy = lambda r: tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)
    assert [(f.name, f.dataType) for f in out.schema if f.name != "y"] == [(f.name, f.dataType) for f in plain.schema if f.name != "y"]
    assert collections.Counter(map(tidy, out.drop("y").collect())) == collections.Counter(map(tidy, plain.drop("y").collect()))
    assert collections.Counter(out.select("k", "id", "y").collect()) == collections.Counter(replaced.collect())


@pytest.mark.parametrize("blocks", [8_000, 10])
def test_no_frame_is_added_up_anew_for_each_block(spark, small_groups, monkeypatch, blocks):
    """What later blocks hold is not summed from every block to the end of its group."""
    monkeypatch.setattr(groups_module, "MAX_BLOCKS", blocks)
    df = staged(spark.createDataFrame(_rows(11), "k int, o int, id int, x int, y double"))
    small_groups(7)
    groups = ordered_groups(df, ["k"], ["o", "id"])
    assert groups.cut and (groups.block_rows > 0) == (blocks == 10)
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        text = add_running(df, groups, FEATURES)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    frames = set(re.findall(r"specifiedwindowframe\(RowFrame, ([^,]*), unboundedfollowing", text))
    assert "unboundedpreceding$(), -1" in text and frames <= {"unboundedpreceding$()"}


def test_spread_of_drifting_values(spark, small_groups):
    """One group whose values drift from 0 to 1e12: block moments lose nothing."""
    rnd = random.Random(3)
    values = [1e12 * (i / 399) ** 8 + rnd.random() for i in range(400)]
    df = staged(spark.createDataFrame(list(enumerate(values)), "i int, x double").withColumn("g", F.lit(1)))
    wanted = {"far": so_far("stddev", "x"), "near": last(5, "stddev", "x"), "all": whole("stddev", "x")}
    small_groups(20)
    groups = ordered_groups(df, ["g"], ["i"])
    assert groups.cut
    for r in add_running(df, groups, wanted).collect():
        for name, part in (("far", values[:r.i + 1]), ("near", values[max(0, r.i - 4):r.i + 1]), ("all", values)):
            exact = statistics.stdev([fractions.Fraction(v) for v in part]) if len(part) > 1 else None
            assert exact is None and r[name] is None or math.isclose(r[name], exact, rel_tol=1e-12), (r.i, name)


def test_spread_of_large_values_in_blocks(spark):
    """Values near 1e9: deviations of cut groups equal those of whole ones."""
    from gridline.catalog import small_groups
    from gridline.operators.groups import ordered_groups

    df = spark.createDataFrame([(g, i, 1e9 * (g + 1) + i % 7) for g in range(2) for i in range(200)], "g int, i int, x double")
    wanted = {"s": Running("stddev", "x", end=0), "t": Running("stddev", "x", start=-4, end=0)}
    plain = add_running(df, ordered_groups(df, ["g"], ["i"]), wanted)
    with small_groups(spark, 20):
        groups = ordered_groups(df, ["g"], ["i"])
        assert groups.cuts is not None
        cut = add_running(df, groups, wanted)
    for a, b in zip(plain.orderBy("g", "i").collect(), cut.orderBy("g", "i").collect()):
        for c in ("s", "t"):
            assert (a[c] is None) == (b[c] is None) and (a[c] is None or abs(a[c] - b[c]) < 1e-6)
