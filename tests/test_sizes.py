"""Cases that only larger tables have: codes listed twice, tied tags, panels dealt again and again, output that must not meet in few tasks."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitmart import panels
from pitmart.operators import adjust, groups
from pitmart.sources import frames


def test_rows_listed_under_one_code_stay_without_an_order_and_the_last_counts_with_one(spark):
    listed = spark.createDataFrame([("000001", "first", "", 1), ("000001", "", "last", 2), ("000002", "two", "", 3), ("H00003", "none", "", 4)], "code string, full_name string, short_name string, place int").repartition(3)
    symbols = spark.createDataFrame([("sh000001", "s", 1), ("sz000001", "t", 2), ("sz000009", "nine", 3), ("sz000008", "", 4)], "symbol string, name string, place int")
    got = lambda df: sorted(tuple(r) for r in frames.index_catalog(df, symbols).collect())
    rest = [("000002", "two", None, "catalog"), ("000009", "nine", "sz000009", "symbols")]
    assert got(listed.drop("place")) == [("000001", "first", "sh000001", "catalog"), ("000001", "last", "sh000001", "catalog"), *rest]
    assert got(listed) == [("000001", "last", "sh000001", "catalog"), *rest]


def test_tags_of_one_name_and_confidence_rank_alike_in_any_order(spark):
    d = dt.date
    rows = [("f", "T0", "style", 0.5, d(1998, 1, 1), None), ("f", "T0", "style", 0.5, d(1997, 1, 1), None), ("f", "T0", "industry", 0.5, None, None), ("f", "T1", "style", None, None, None), ("f", "T9", "style", 0.9, None, None)]
    want = [("T9", "style", None), ("T0", "industry", None), ("T0", "style", d(1997, 1, 1)), ("T0", "style", d(1998, 1, 1)), ("T1", "style", None)]
    for given in (rows, rows[::-1]):
        tags = spark.createDataFrame(given, "fund string, tag string, tag_type string, confidence double, valid_from date, valid_to date").coalesce(1)
        assert [(r["tag"], r["tag_type"], r["valid_from"]) for r in groups.tags_asof(tags, "fund", "1998-06-01").orderBy(F.col("rank")).collect()] == want


def shuffled(spark, name):
    """The different exchanges by key in the plan of a query on large tables, which no join broadcasts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return {re.sub(r"#\d+L?|\[plan_id=\d+\]", "", line.split("Exchange ")[1]) for line in plan.splitlines() if "Exchange hash" in line}


@pytest.mark.parametrize("name", ["shares", "fund_days", "fund_actions", "adjusted", "holdings", "quotes"])
def test_panels_by_fund_are_those_of_their_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    got, want = panels.by_fund(spark, sf, held=True)[name], panels.panel(spark, sf, name)
    if name == "quotes":
        got = got.withColumn("security_id", F.concat(F.lit("S"), F.col("security_id").cast("string")))
    got = got.select(want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_adjusting_in_segments_deals_lines_by_fund_once(spark):
    found = shuffled(spark, "E4_adjusted_in_segments")
    assert len(found) == 3 and sum("REPARTITION_BY_COL" in x for x in found) == 1, found  # lines by fund, days by fund and segment, carries of segments


def test_factors_of_no_day_do_not_count_and_kept_columns_stay(spark):
    d = dt.date
    held = spark.createDataFrame([("s", d(2026, 1, i), 10.0, 5.0, 100.0, i) for i in (1, 2, 5, 6)], "security_id string, trade_date date, close double, nav double, shares double, i int")
    factors = spark.createDataFrame([("s", d(2026, 1, i), c, "SPLIT", m) for i, m in ((2, 2.0), (3, 7.0), (6, 3.0), (6, 0.5), (9, 9.0)) for c in adjust.CHANNELS], "security_id string, trade_date date, channel string, action_type string, m double")
    for width in (None, 2):
        rows = adjust.adjusted(held, factors, width=width, keep=["i"]).orderBy("i").collect()
        assert [(r["i"], r["price_factor"], r["adjusted_close"], r["adjusted_shares"]) for r in rows] == [(1, 1.0, 10.0, 100.0), (2, 2.0, 20.0, 50.0), (5, 2.0, 20.0, 50.0), (6, 3.0, 30.0, 100 / 3.0)]


def test_the_whole_record_deals_lines_by_fund_once(spark):
    found = shuffled(spark, "K12_whole_record")
    by_fund = sorted(x for x in found if "security_id" in x or "etf_id" in x or "trade_date" in x and "r_name" not in x)
    assert len(by_fund) == 2 and "REPARTITION_BY_COL" in by_fund[1], found  # suppliers' indexes, which are a row a fund, and lines


def test_a_report_is_the_same_from_dealt_holdings(spark):
    d = dt.date
    rows = [(f, i, d(2026, 3 * q, 1), d(2026, 3 * q + 1, 1), 1.0 * i) for f in ("a", "b") for q in (1, 2, 3) for i in range(3)]
    h = spark.createDataFrame(rows, "fund string, stock_id int, report_date date, disclosed date, weight_pct double")
    one, two = (sorted(map(tuple, groups.latest_report(h, "fund", "2026-07-15", dealt=x).collect())) for x in (False, True))
    assert one == two and {r[2] for r in one} == {d(2026, 6, 1)} and len(one) == 6


def test_an_index_of_very_many_funds_meets_them_in_many_tasks(spark):
    day = dt.date(1998, 1, 1)
    none = spark.createDataFrame([], "fund long, stock_id long, report_date date, disclosed date, weight_pct double")
    mapping = spark.range(3000).select(F.col("id").alias("fund"), F.lit("i").alias("index_id"))
    old = spark.range(5).select(F.lit("i").alias("index_id"), F.col("id").alias("stock_id"), F.lit(day - dt.timedelta(9)).alias("effective_date"), F.lit(1.0).alias("weight_pct"))
    late = spark.range(5).select(F.lit("i").alias("index_id"), F.col("id").alias("stock_id"), F.lit(day + dt.timedelta(9)).alias("effective_date"), F.lit(1.0).alias("weight_pct"))
    now = spark.range(400).select(F.lit("i").alias("index_id"), F.col("id").alias("stock_id"), F.lit(day).alias("effective_date"), F.col("id").cast("double").alias("weight_pct"))
    out = groups.holdings_or_constituents(none, now.unionByName(old).unionByName(late), mapping, "fund", "1998-01-05")
    by_task = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
    assert sum(by_task) == 3000 * 400 and len(by_task) >= 4 and by_task[-1] < 3000 * 400 / 2
    assert out.select("fund", "stock_id").distinct().count() == 3000 * 400 and {tuple(r) for r in out.where("fund = 7 and stock_id = 3").collect()} == {(7, 3, 3.0, day, "constituents")}
