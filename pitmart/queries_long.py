"""Queries over one long line, by inventory ID: what windows by key give elsewhere, with the rows of a key in many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart import storage
from pitmart.operators import adjust, flow, market, pulse, scan
from pitmart.panels import by_fund, panel, panel_sql
from pitmart.queries import SQL, add
from pitmart.queries_pulse import confirmed_sql

#: Days of a line that one task scans here, and rows of a piece: small, so that the given tables have many of them.
DAYS, ROWS = 64, 256

_LINE = "SELECT 'all' AS line, CAST(l_shipdate AS DATE) AS day, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, count(*) AS n FROM lineitem GROUP BY 2"


def _line(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.groupBy(F.lit("all").alias("line"), F.col("l_shipdate").cast("date").alias("day")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))


@add("G8_cumulative_in_segments", f"WITH x AS ({_LINE}) SELECT line, day, CASE WHEN day(day) % 5 <> 0 THEN sum(CASE WHEN day(day) % 5 <> 0 THEN CAST(n AS DOUBLE) END) OVER (ORDER BY day) END AS total FROM x", "total")
def _g8(spark: SparkSession, d: str) -> DataFrame:
    rows = _line(spark, d).withColumn("v", F.when(F.dayofmonth("day") % 5 != 0, F.col("n").cast("double")))
    return flow.cumulative(rows, "line", "day", "v", DAYS)


_STATE = "CASE WHEN n % 13 = 0 THEN 'UNKNOWN' WHEN cents // 1000000 % 3 = 0 THEN 'WEAK' WHEN cents // 1000000 % 3 = 1 THEN 'NEUTRAL' ELSE 'STRONG' END"


@add("M5_confirmed_in_segments", f"WITH x AS ({_LINE}), w AS (SELECT line, day AS trade_date, {_STATE} AS s_raw FROM x), {confirmed_sql('w', 'line', ['s'], 'c')} SELECT line, trade_date AS day, s_raw AS state, s_state AS confirmed FROM c_s")
def _m5(spark: SparkSession, d: str) -> DataFrame:
    rows = _line(spark, d).withColumn("state", F.expr(_STATE.replace("//", "div")))
    return market.confirmed(rows.select("line", "day", "state"), "line", "day", "state", width=DAYS)


@add("E4_adjusted_in_segments", SQL["E4_adjusted_series"])
def _e4(spark: SparkSession, d: str) -> DataFrame:
    funds = by_fund(spark, d)
    factors, _ = adjust.multipliers(funds["fund_actions"], funds["fund_days"])
    return adjust.adjusted(funds["fund_days"], factors, width=DAYS).withColumn("adjusted_close", F.col("adjusted_close") / 70000)


@add("L6_index_position_in_pieces", f"WITH x AS (SELECT line, day, CAST(cents AS DOUBLE) / n AS close FROM ({_LINE})), y AS (SELECT *, list(close) OVER w AS a, max(close) OVER w AS peak FROM x WINDOW w AS (ORDER BY day ROWS 249 PRECEDING)) SELECT line, day, CASE WHEN len(a) >= 60 THEN (len([v FOR v IN a IF v < close]) + len([v FOR v IN a IF v = close]) / 2) / len(a) END AS position, close / peak - 1 AS from_peak FROM y", "position from_peak")
def _l6(spark: SparkSession, d: str) -> DataFrame:
    rows = _line(spark, d).withColumn("close", F.col("cents").cast("double") / F.col("n"))
    return market.index_position(rows, "line", "day", "close", size=ROWS)


@add("M11_pulse_in_segments", SQL["M11_pulse_replay"])
@storage.tidy
def _m11(spark: SparkSession, d: str) -> DataFrame:
    panels = (storage.materialize(panel(spark, d, f"m_{x}")) for x in ("turnover", "margin", "basket", "index"))
    return pulse.replay(*panels, "market_id", "trade_date", 250, cut=(DAYS, ROWS))


@add("F4_drawdown_in_segments", f"WITH x AS ({_LINE}) SELECT line, day, CAST(cents AS DOUBLE) / max(CAST(cents AS DOUBLE)) OVER (ORDER BY day) - 1 AS drawdown, row_number() OVER (ORDER BY day) AS place FROM x", "drawdown")
def _f4(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.running(_line(spark, d), "line", "day", peaks={"peak": F.col("cents")}, counts="place", width=DAYS)
    return rows.select("line", "day", (F.col("cents").cast("double") / F.col("peak") - 1).alias("drawdown"), "place")


_SHIPPED = "SELECT CAST(l_suppkey AS BIGINT) AS k, CAST(l_shipdate AS DATE) AS day, max(l_orderkey) AS shipped FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2"
_RECEIVED = "SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS k, CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER) AS day FROM lineitem"


@add("S17_asof_join", f"WITH s AS ({_SHIPPED}), r AS ({_RECEIVED}) SELECT r.k, r.day, s.shipped FROM r ASOF LEFT JOIN s ON r.k = s.k AND r.day >= s.day")
def _asof(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").cast("long").alias("k"), F.col("l_shipdate").cast("date").alias("day"), F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber").cast("int")).alias("received"), "l_orderkey", "l_quantity")
    shipped = rows.where("l_quantity > 25").groupBy("k", "day").agg(F.max("l_orderkey").alias("shipped"))
    return scan.asof(rows.select("k", F.col("received").alias("day")).distinct(), shipped, ["k"], "day", ["shipped"], width=DAYS)


@add("I6_rank_in_one_group", "SELECT o_orderkey, known, CAST(below AS DOUBLE) / (known - 1) AS rank_pct FROM (SELECT o_orderkey, count(*) OVER () AS known, rank() OVER (ORDER BY round(o_totalprice / 100)) - 1 AS below FROM orders)", "rank_pct")
def _i6(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.lit("all").alias("line"), F.round(F.col("o_totalprice") / 100).alias("v"))
    return scan.ranks(rows, ["line"], "v").select("o_orderkey", "known", (F.col("below") / (F.col("known") - 1)).alias("rank_pct"))


@add("N7_percentiles_of_all", "SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice::DOUBLE, 0.1) AS p10, quantile_cont(l_extendedprice::DOUBLE, 0.5) AS median, quantile_cont(l_extendedprice::DOUBLE, 0.9) AS p90 FROM lineitem GROUP BY 1", "p10 median p90")
def _n7(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    return scan.percentiles(rows, ["l_returnflag"], "v", {"p10": 0.1, "median": 0.5, "p90": 0.9})
