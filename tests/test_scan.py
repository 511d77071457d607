"""Scans in segments against windows over whole keys: ties, nulls, several keys and one long line."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitmart.operators import calendar, groups, market, scan

START = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def lines(spark):
    r = random.Random(4)
    rows = [(k, START + dt.timedelta(days=i * step), r.choice([None, 0.0, -0.0, -2.5, *(float(r.randint(-40, 40)) for _ in range(3))]), r.choice("AAB")) for k, n, step in (("one", 700, 1), ("two", 3, 200), ("three", 90, 11)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, d date, v double, s string").repartition(5)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_running(lines):
    w = Window.partitionBy("k").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    got = scan.running(lines, "k", "d", sums={"total": F.col("v")}, peaks={"peak": F.col("v")}, lasts={"last": F.col("v")}, counts="n", products={"p": F.when(F.col("v") > 0, 2.0)}, width=13)
    want = lines.withColumns({"total": F.sum("v").over(w), "n": F.row_number().over(w).cast("long"), "p": F.product(F.when(F.col("v") > 0, 2.0)).over(w), "peak": F.max("v").over(w), "last": F.last("v", ignorenulls=True).over(w)})
    same(got.select(want.columns), want)


def test_rows_of_one_line_shuffle_once_and_stand_in_many_tasks(spark, lines):
    one = lines.where("k = 'one'")
    got = scan.running(one, "k", "d", counts="n", width=13)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "SinglePartition" not in plan
    parts = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 700


@pytest.mark.parametrize("n", [1, 2, 3])
def test_runs_and_confirmation(lines, n):
    rows = lines.withColumn("s", F.when(F.dayofmonth("d") == 7, "UNKNOWN").otherwise(F.col("s")))
    want = market.confirmed(rows, "k", "d", "s", n)
    same(market.confirmed(rows, "k", "d", "s", n, width=5).select(want.columns), want)


def test_windows_in_pieces(lines):
    w = Window.partitionBy("k").orderBy("d")

    def operator(rows, key):
        at = Window.partitionBy(key).orderBy("d")
        return rows.select(key, "d", F.sum("v").over(at.rowsBetween(-6, 0)).alias("a"), F.lead("v", 4).over(at).alias("b"))

    want = lines.select("k", "d", F.sum("v").over(w.rowsBetween(-6, 0)).alias("a"), F.lead("v", 4).over(w).alias("b"))
    for size in (3, 8, 1000):
        same(scan.in_pieces(lines, "k", "d", 6, operator, ahead=4, size=size), want)


def test_asof(spark, lines):
    right = lines.where("s = 'A' and v is not null").select("k", "d", "v")
    right = right.unionByName(right.where("dayofmonth(d) = 3").withColumn("v", F.col("v") - 1))  # ties: the greater counts
    left = lines.select("k", "d", "s").unionByName(spark.createDataFrame([("one", START - dt.timedelta(days=1), "x"), ("none", START, "x")], "k string, d date, s string"))
    for strict in (False, True):
        on = (F.col("l.k") == F.col("r.k")) & ((F.col("r.d") < F.col("l.d")) if strict else (F.col("r.d") <= F.col("l.d")))
        want = left.alias("l").join(right.alias("r"), on, "left").groupBy("l.k", "l.d", "l.s").agg(F.max(F.struct("r.d", "r.v"))["v"].alias("v"))
        same(scan.asof(left, right, ["k"], "d", ["v"], strict, 9), want)


def test_calendar_days_around(spark):
    days = spark.createDataFrame([(START + dt.timedelta(days=i),) for i in range(0, 300, 3)], "trade_date date")
    asked = spark.createDataFrame([(START + dt.timedelta(days=i),) for i in range(-2, 310)] + [(None,)], "day date")
    got = {r["day"]: (r["latest"], r["previous"]) for r in calendar.around(asked, days, "day").collect()}
    known = [r["trade_date"] for r in days.collect()]
    assert len(got) == 313 and got[None] == (None, None)
    for day, found in got.items():
        if day is not None:
            assert found == (max((t for t in known if t <= day), default=None), max((t for t in known if t < day), default=None))


def test_ranks_and_percentiles(spark, lines):
    rows = lines.unionByName(spark.createDataFrame([(None, START, float(v), "A") for v in (1, 1, 2, 1e300, -1e-300)], lines.schema))
    rows = rows.unionByName(rows.where("k = 'one' and v = 0").withColumn("s", F.lit("C")))  # a value that very many share
    w = Window.partitionBy("k", F.col("v").isNotNull())
    known = F.col("v").isNotNull()
    want = rows.select("k", "d", "v", "s", F.when(known, F.rank().over(w.orderBy("v")) - 1).cast("long").alias("below"), F.when(known, F.count("*").over(w)).alias("known"))
    same(scan.ranks(rows, ["k"], "v").select(want.columns), want)
    want = rows.where(known).groupBy("k").agg(F.count("*").alias("n"), F.percentile("v", F.lit(0.1)).alias("a"), F.median("v").alias("b"), F.percentile("v", F.lit(0.97)).alias("c"), F.max("v").alias("e"))
    got = scan.percentiles(rows, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.97, "e": 1.0})
    for x, y in zip(sorted(map(tuple, got.collect()), key=str), sorted(map(tuple, want.collect()), key=str), strict=True):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:])
    assert scan.percentiles(rows.limit(0), ["k"], "v", {"a": 0.5}).count() == 0


def test_leading_bits_never_decrease(spark):
    values = sorted({s * x for e in range(-60, 60, 7) for x in (2.0**e, 2.0**e * (1 - 2**-53), 2.0**e * (1 + 2**-52), 1.1**e, 0.0) for s in (1, -1)} | {float("inf"), float("-inf"), 5e-324})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["b"] for r in df.orderBy("i").select(scan.leading_bits(F.col("v")).alias("b")).collect()]
    assert got == sorted(got)


def test_counts_in_prefixes(spark):
    r = random.Random(8)
    points = [(k, r.choice([1.0, 2.0, 2.0, 5.0, -3.0]), t) for k, n in (("a", 130), ("b", 1)) for t in range(n)]
    asked = [(k, v, u) for k in "abc" for v in (1.0, 2.0, 3.0, None) for u in (0, 1, 2, 63, 64, 100, 130)]
    got = scan.prefix_counts(spark.createDataFrame(points, "k string, v double, _t long"), spark.createDataFrame(asked, "k string, v double, u long"), "k", "v", "u").collect()
    assert len(got) == len(asked)
    for k, v, u, below, equal in got:
        own = [x for key, x, t in points if key == k and t < u]
        assert (below, equal) == ((None, None) if v is None else (sum(x < v for x in own), sum(x == v for x in own)))


def test_percentile_of_a_growing_history(spark, lines):
    got = market.valuation_percentile(lines, "k", "d", "v", 100, 5)
    w = Window.partitionBy("k").orderBy(F.unix_date("d"))
    rows = lines.where("v is not null").withColumn("_all", F.collect_list("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_ten", F.collect_list("v").over(w.rangeBetween(-100, 0)))
    rank = lambda a: F.when(F.size(a) >= 5, (F.size(F.filter(a, lambda x: x < F.col("v"))) + F.size(F.filter(a, lambda x: x == F.col("v"))) / 2) / F.size(a))
    want = rows.select("k", "d", F.col("v") + 0.0, rank("_all"), rank("_ten"), F.size("_all"), F.size("_ten"))
    same(got.withColumn("v", F.col("v") + 0.0), want)


def test_a_large_peer_group_is_dealt_by_value(spark):
    rows = spark.range(3000).select(F.lit("g").alias("g"), F.col("id").alias("k"), *((F.pmod(F.xxhash64("id", F.lit(c)), F.lit(500))).cast("double").alias(c) for c in groups.DIRECTIONS))
    w = Window.partitionBy("g")
    want = rows.select("k", "g", F.lit(3000).cast("long").alias("n"), *(F.percent_rank().over(w.orderBy(F.asc(c) if high else F.desc(c))).alias(c) for c, high in groups.DIRECTIONS.items()))
    same(groups.peer_marts(rows, "g", "k"), want)
