"""Queries by inventory ID, each with the SQL that DuckDB answers alike.  Doubles are rounded to 6 places at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.operators import flow, metrics
from pitmart.operators import series as s
from pitmart.panels import panel, panel_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def add(name: str, sql: str, doubles: str = "", ready: bool = False) -> Callable[[Query], Query]:
    """Registers a query; doubles: the columns of its SQL that are rounded.  ready: the query rounds its own."""

    def put(f: Query) -> Query:
        QUERIES[name] = f if ready else lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if doubles:
            sql_ = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in doubles.split())}) FROM ({sql})"
        else:
            sql_ = sql
        SQL[name] = sql_
        return f

    return put


# F: returns, risk, liquidity
_STEPS = panel_sql("quotes") + """, t AS (SELECT *, %s FROM quotes WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)),
p AS (SELECT *, close / lag(close) OVER w - 1 AS step, ln(close / lag(close) OVER w) AS lg FROM t WHERE close IS NOT NULL WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)),
m AS (SELECT security_id, trade_date, %s, turnover_5, turnover_20, turnover_60 FROM p WINDOW w AS (PARTITION BY security_id ORDER BY trade_date))""" % (
    ", ".join(f"CASE WHEN count(turnover_amount) OVER (w ROWS {n - 1} PRECEDING) = {n} THEN avg(turnover_amount) OVER (w ROWS {n - 1} PRECEDING) END AS turnover_{n}" for n in metrics.TURNOVERS),
    ", ".join(
        [f"CASE WHEN count(close) OVER (w ROWS {n} PRECEDING) = {n + 1} AND max(abs(step)) OVER (w ROWS {n - 1} PRECEDING) <= {s.JUMP} AND lag(close, {n}) OVER w <> 0 THEN close / lag(close, {n}) OVER w - 1 END AS return_{n}d" for n in metrics.RETURNS]
        + [f"CASE WHEN count(lg) OVER (w ROWS {n - 1} PRECEDING) = {n} AND max(abs(step)) OVER (w ROWS {n - 1} PRECEDING) <= {s.JUMP} THEN stddev_samp(lg) OVER (w ROWS {n - 1} PRECEDING) * sqrt({s.YEAR}) END AS volatility_{n}d" for n in metrics.VOLATILITIES]
        + [f"CASE WHEN count(close) OVER (w ROWS {n - 1} PRECEDING) = {n} AND max(abs(step)) OVER (w ROWS {n - 2} PRECEDING) <= {s.JUMP} THEN list(close) OVER (w ROWS {n - 1} PRECEDING) END AS prices_{n}" for n in metrics.DRAWDOWNS]
        + [f"CASE WHEN coalesce(max(abs(step)) OVER (w ROWS UNBOUNDED PRECEDING), 0) <= {s.JUMP} THEN close / max(close) OVER (w ROWS UNBOUNDED PRECEDING) - 1 END AS current_drawdown"]
    ),
)
_FALL = "list_min([list_min({a}[i:]) / {a}[i] - 1 FOR i IN range(1, len({a}) + 1)])"


def _metric(name: str, columns: list[str], turnover: bool = False) -> None:
    shown = ", ".join(f"turnover_{c[13:-1]} AS {c}" if turnover else f"CASE WHEN prices_{c[13:-1]} IS NOT NULL THEN {_FALL.format(a=f'prices_{c[13:-1]}')} END AS {c}" if c.startswith("max_draw") else c for c in columns)

    @add(name, f"{_STEPS} SELECT security_id, trade_date, {shown} FROM m", " ".join(columns))
    def _(spark: SparkSession, d: str) -> DataFrame:
        return metrics.daily_metrics(panel(spark, d, "quotes")).select("security_id", "trade_date", *columns)


_metric("F1_returns", [f"return_{n}d" for n in metrics.RETURNS])
_metric("F2_volatility", [f"volatility_{n}d" for n in metrics.VOLATILITIES])
_metric("F3_max_drawdown", ["max_drawdown_60d"])
_metric("F4_current_drawdown", ["current_drawdown"])
_metric("F5_avg_turnover", [f"avg_turnover_{n}d" for n in metrics.TURNOVERS], turnover=True)

_F9 = [*(f"return_{n}d" for n in metrics.RETURNS), *(f"volatility_{n}d" for n in metrics.VOLATILITIES), "current_drawdown"]


@add("F9_daily_metrics", f"{_STEPS} SELECT security_id, trade_date, {', '.join(_F9)}, turnover_20 AS avg_turnover_20d FROM m", " ".join(_F9) + " avg_turnover_20d")
def _f9(spark: SparkSession, d: str) -> DataFrame:
    return metrics.daily_metrics(panel(spark, d, "quotes")).select("security_id", "trade_date", *_F9, "avg_turnover_20d")


@add("F8_latest_metrics", f"{_STEPS} SELECT security_id, trade_date, {', '.join(_F9)} FROM m QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY trade_date DESC) = 1", " ".join(_F9))
def _f8(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latest(metrics.daily_metrics(panel(spark, d, "quotes")), "security_id", "trade_date").select("security_id", "trade_date", *_F9)


@add("F6_spread", "SELECT p_partkey, width, width / ((ask + bid) / 2) AS relative FROM (SELECT p_partkey, CASE WHEN bid > 0 AND ask > 0 AND ask >= bid THEN ask - bid END AS width, bid, ask FROM (SELECT p_partkey, p_retailprice - 900 AS bid, p_retailprice - 900 + (p_size - 5) / 10.0::DOUBLE AS ask FROM part))", "width relative")
def _f6(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_retailprice") - 900).alias("bid"), (F.col("p_retailprice") - 900 + (F.col("p_size") - 5) / F.lit(10.0)).alias("ask"))
    width, relative = metrics.spread("bid", "ask")
    return part.select("p_partkey", width.alias("width"), relative.alias("relative"))


_PREMIUM = "CASE WHEN close IS NOT NULL THEN turnover_amount / n_orders / close - 1 END"


@add("F7_premium_stats", f"{panel_sql('quotes')}, p AS (SELECT security_id, trade_date, {_PREMIUM} AS premium FROM quotes) SELECT security_id, trade_date, avg(premium) OVER w AS mean, stddev_samp(premium) OVER w AS deviation, avg(abs(premium)) OVER w AS mean_abs, count(premium) OVER w AS n FROM p WHERE premium IS NOT NULL WINDOW w AS (PARTITION BY security_id ORDER BY trade_date ROWS 19 PRECEDING)", "mean deviation mean_abs")
def _f7(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d, "quotes").withColumn("premium", F.expr(_PREMIUM))
    return metrics.premium_stats(rows, "security_id", "trade_date", "premium")


@add("E7_jumps", f"{panel_sql('quotes_jumpy')}, p AS (SELECT *, abs(close / lag(close) OVER w - 1) AS step FROM quotes_jumpy WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)) SELECT security_id, trade_date, coalesce(max(step) OVER (w ROWS UNBOUNDED PRECEDING) > 0.2, FALSE) AS ever, coalesce(max(step) OVER (w ROWS 4 PRECEDING) > 0.2, FALSE) AS lately FROM p WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)")
def _e7(spark: SparkSession, d: str) -> DataFrame:
    w = s.over()
    rows = s.with_step(panel(spark, d, "quotes_jumpy"), "close", w)
    return rows.select("security_id", "trade_date", s.jumps(F.col("close"), w).alias("ever"), s.jumps(F.col("close"), w, 5).alias("lately"))


# G: flows
_FLOWS = ", ".join(
    f"CASE WHEN count(shares) OVER (w ROWS {n} PRECEDING) = {n + 1} THEN shares - lag(shares, {n}) OVER w END AS share_change_{n}d, "
    f"CASE WHEN count(shares) OVER (w ROWS {n} PRECEDING) = {n + 1} AND lag(shares, {n}) OVER w <> 0 THEN (shares - lag(shares, {n}) OVER w) / lag(shares, {n}) OVER w END AS share_change_pct_{n}d, "
    f"CASE WHEN count(money) OVER (w ROWS {n - 1} PRECEDING) = {n} THEN sum(money) OVER (w ROWS {n - 1} PRECEDING) END AS net_subscription_{n}d"
    for n in flow.WINDOWS
)
_G = f"{panel_sql('shares')}, x AS (SELECT *, (shares - lag(shares) OVER w) * nav AS money FROM shares WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)), g AS (SELECT security_id, trade_date, {_FLOWS} FROM x WINDOW w AS (PARTITION BY security_id ORDER BY trade_date))"


def _flow(name: str, columns: list[str], last: bool = False) -> None:
    tail = " QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY trade_date DESC) = 1" if last else ""

    @add(name, f"{_G} SELECT security_id, trade_date, {', '.join(columns)} FROM g{tail}", " ".join(columns))
    def _(spark: SparkSession, d: str) -> DataFrame:
        rows = flow.daily_flows(panel(spark, d, "shares"))
        return (metrics.latest(rows, "security_id", "trade_date") if last else rows).select("security_id", "trade_date", *columns)


_flow("G1_share_change", [f"share_change{p}_{n}d" for p in ("", "_pct") for n in flow.WINDOWS])
_flow("G2_net_subscription", [f"net_subscription_{n}d" for n in flow.WINDOWS])
_flow("G7_latest_flow", [f"{c}_{n}d" for c in ("share_change", "share_change_pct", "net_subscription") for n in flow.WINDOWS], last=True)
_flow("G9_flow_replay", [f"{c}_{n}d" for c in ("share_change", "share_change_pct", "net_subscription") for n in flow.WINDOWS])


@add("G3_streaks", f"{panel_sql('shares')}, x AS (SELECT security_id, trade_date, sign(shares - lag(shares) OVER (PARTITION BY security_id ORDER BY trade_date)) AS sg FROM shares), y AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY trade_date) - row_number() OVER (PARTITION BY security_id, sg ORDER BY trade_date) AS island FROM x WHERE sg IS NOT NULL), z AS (SELECT *, row_number() OVER (PARTITION BY security_id, sg, island ORDER BY trade_date) AS run FROM y) SELECT security_id, trade_date, CASE WHEN sg > 0 THEN run ELSE 0 END AS inflow_days, CASE WHEN sg < 0 THEN run ELSE 0 END AS outflow_days FROM z")
def _g3(spark: SparkSession, d: str) -> DataFrame:
    return flow.streaks(panel(spark, d, "shares"))


_NAVLESS = "SELECT security_id, trade_date, shares, CASE WHEN day(trade_date) % 3 = 0 THEN NULL ELSE nav END AS nav FROM {0}"


@add("G4_nav_coalesce", f"{panel_sql('shares')} SELECT security_id, trade_date, shares, CASE WHEN day(trade_date) % 3 <> 0 OR day(trade_date) % 6 <> 0 THEN nav END AS nav, CASE WHEN day(trade_date) % 3 <> 0 THEN 'share_row' WHEN day(trade_date) % 6 <> 0 THEN 'nav_table' END AS nav_source FROM shares", "shares nav")
def _g4(spark: SparkSession, d: str) -> DataFrame:
    shares = panel(spark, d, "shares")
    less = shares.withColumn("nav", F.when(F.dayofmonth("trade_date") % 3 != 0, F.col("nav")))
    return flow.nav_coalesce(less, shares.where(F.dayofmonth("trade_date") % 6 != 0), "security_id", "trade_date")


@add("G5_mechanical_split", f"{panel_sql('shares')}, x AS (SELECT *, lag(shares) OVER (PARTITION BY security_id ORDER BY trade_date) AS prev, CASE WHEN day(trade_date) = 15 THEN 2.0 ELSE 1.0 END::DOUBLE AS k FROM shares) SELECT security_id, trade_date, prev * (k - 1) AS mechanical, shares - prev * k AS economic, CASE WHEN k <> 1 AND prev IS NOT NULL THEN 'adjusted' ELSE 'clean' END AS quality FROM x", "mechanical economic")
def _g5(spark: SparkSession, d: str) -> DataFrame:
    shares = panel(spark, d, "shares")
    factors = shares.where(F.dayofmonth("trade_date") == 15).select("security_id", "trade_date", F.lit(2.0).alias("k"))
    return flow.mechanical_split(shares, factors, "security_id", "trade_date")


@add("G8_cumulative_flow", f"{panel_sql('shares')}, x AS (SELECT security_id, trade_date, CASE WHEN day(trade_date) % 5 <> 0 THEN shares - lag(shares) OVER (PARTITION BY security_id ORDER BY trade_date) END AS v FROM shares) SELECT security_id, trade_date, CASE WHEN v IS NOT NULL THEN sum(v) OVER (PARTITION BY security_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) END AS total FROM x", "total")
def _g8(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d, "shares").withColumn("v", F.when(F.dayofmonth("trade_date") % 5 != 0, F.col("shares") - F.lag("shares").over(s.over())))
    return flow.cumulative(rows, "security_id", "trade_date", "v")


@add("G10_basket_flow", f"{panel_sql('shares')}, x AS (SELECT security_id, trade_date, CASE WHEN day(trade_date) % 5 <> 0 THEN shares - lag(shares) OVER (PARTITION BY security_id ORDER BY trade_date) END AS v FROM shares), mb AS (SELECT s_suppkey AS security_id, r_name AS basket FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), sz AS (SELECT basket, count(DISTINCT security_id) AS members FROM mb GROUP BY 1) SELECT basket, trade_date, sum(v) AS flow, count(v) AS contributors, any_value(members) AS members FROM x JOIN mb USING (security_id) JOIN sz USING (basket) GROUP BY 1, 2", "flow")
def _g10(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d, "shares").withColumn("v", F.when(F.dayofmonth("trade_date") % 5 != 0, F.col("shares") - F.lag("shares").over(s.over())))
    supplier, nation, region = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("supplier", "nation", "region"))
    members = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").cast("long").alias("security_id"), F.col("r_name").alias("basket"))
    return flow.basket_flow(rows, members, "security_id", "trade_date", "v")
