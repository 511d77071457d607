"""Queries of the audit, of further market layers and of peer marts by inventory ID."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.operators import adjust, audit, groups, market, metrics
from pitmart.operators import series as s
from pitmart.panels import panel, panel_sql
from pitmart.queries import add
from pitmart.queries_more import _M2, _m2, _m5_sql
from pitmart.queries_norm import _E4, _actions


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@add("C2_share_validator", f"{panel_sql('shares')} SELECT security_id, trade_date, 'shares_not_positive' AS rule FROM (SELECT *, shares - 1000200 AS x FROM shares) WHERE x <= 0")
def _c2(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d, "shares").withColumn("shares", F.col("shares") - 1_000_200)
    return rows.where("shares <= 0").select("security_id", "trade_date", F.lit("shares_not_positive").alias("rule"))


@add("M12_pending", f"{_M2}, {_m5_sql('v', 'exchange', 'trade_date')} SELECT exchange, trade_date, confirmed AS from_state, state AS to_state FROM confirmed WHERE state <> confirmed")
def _m12(spark: SparkSession, d: str) -> DataFrame:
    rows = market.confirmed(_m2(spark, d).select("exchange", "trade_date", "state"), "exchange", "trade_date", "state")
    return rows.where("state <> confirmed").select("exchange", "trade_date", F.col("confirmed").alias("from_state"), F.col("state").alias("to_state"))


@add("N2_entries", f"{_M2}, p AS (SELECT exchange, trade_date, state, lag(state) OVER (PARTITION BY exchange ORDER BY trade_date) AS prev FROM v) SELECT exchange, trade_date, state FROM p WHERE prev IS NULL OR prev <> state")
def _n2(spark: SparkSession, d: str) -> DataFrame:
    rows = _m2(spark, d).withColumn("_prev", F.lag("state").over(s.over("exchange")))
    return rows.where(F.col("_prev").isNull() | (F.col("_prev") != F.col("state"))).select("exchange", "trade_date", "state")


@add("N8_yearly_switches", f"{_M2}, p AS (SELECT *, year(trade_date) AS year, lag(state) OVER (PARTITION BY exchange, year(trade_date) ORDER BY trade_date) AS prev FROM v) SELECT exchange, year, count(*) AS days, count(*) FILTER (WHERE prev <> state) AS switches, avg(CASE WHEN state = 'UNKNOWN' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS unknown FROM p GROUP BY 1, 2", "unknown")
def _n8(spark: SparkSession, d: str) -> DataFrame:
    return market.switches(_m2(spark, d).withColumn("year", F.year("trade_date")), ["exchange", "year"], "exchange", "trade_date", "state")


@add("N4_switches", f"{_M2}, p AS (SELECT *, lag(state) OVER (PARTITION BY exchange ORDER BY trade_date) AS prev FROM v) SELECT exchange, count(*) AS days, count(*) FILTER (WHERE prev <> state) AS switches, avg(CASE WHEN state = 'UNKNOWN' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS unknown FROM p GROUP BY 1", "unknown")
def _n4(spark: SparkSession, d: str) -> DataFrame:
    return market.switches(_m2(spark, d), ["exchange"], "exchange", "trade_date", "state")


@add("I3_group_members", "SELECT s_nationkey, string_agg(s_name, '|' ORDER BY s_name) AS members, count(*) AS n FROM supplier GROUP BY 1")
def _i3(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), "|").alias("members"), F.count("*").alias("n"))


@add("K9_aum_coalesce", f"{panel_sql('fund_master')} SELECT fund_id, coalesce(CASE WHEN fund_id % 4 <> 0 THEN fee * 2 END, CASE WHEN observed <= DATE '1998-01-31' THEN fee END) AS aum FROM fund_master", "aum")
def _k9(spark: SparkSession, d: str) -> DataFrame:
    from pitmart.operators import pit

    return panel(spark, d, "fund_master").select("fund_id", F.coalesce(F.when(F.col("fund_id") % 4 != 0, F.col("fee") * 2), pit.observed(F.col("fee"), F.col("observed"), "1998-01-31")).alias("aum"))


@add("O9_later_than_facts", f"{panel_sql('quotes_wide')} SELECT security_id, max(trade_date) AS derived, max(CASE WHEN n_orders > 1 THEN trade_date END) AS fact FROM quotes_wide GROUP BY 1 HAVING max(CASE WHEN n_orders > 1 THEN trade_date END) IS NULL OR max(trade_date) > max(CASE WHEN n_orders > 1 THEN trade_date END)")
def _o9(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d, "quotes_wide")
    return audit.later_than_facts(rows, rows.where("n_orders > 1"), "security_id", "trade_date")


@add("O12_future_factor", f"{_E4}, pl AS (SELECT security_id, trade_date, CASE WHEN day(trade_date) = 20 THEN price_factor * 1.5 ELSE price_factor END AS factor, price_factor AS expected FROM fc) SELECT security_id, trade_date, factor, expected FROM pl WHERE abs(factor / expected - 1) > 1e-9 AND security_id NOT IN (SELECT security_id FROM fund_actions WHERE action_type = 'DIVIDEND' AND security_id % 2 = 0)", "factor expected")
def _o12(spark: SparkSession, d: str) -> DataFrame:
    days, (factors, _) = _actions(spark, d)
    planted = adjust.adjusted(days, factors).select("security_id", "trade_date", F.when(F.dayofmonth("trade_date") == 20, F.col("price_factor") * 1.5).otherwise(F.col("price_factor")).alias("factor"))
    paying = panel(spark, d, "fund_actions").where("action_type = 'DIVIDEND' and security_id % 2 = 0").select("security_id").distinct()
    return audit.factor_mismatch(planted, factors.where("channel = 'price'"), "security_id", "trade_date").join(paying, "security_id", "left_anti")


@add("J1_latest_top_holdings", f"{panel_sql('holdings')}, h AS (SELECT * FROM holdings QUALIFY report_date = max(report_date) OVER (PARTITION BY etf_id)), t AS (SELECT *, row_number() OVER (PARTITION BY etf_id ORDER BY weight_pct DESC NULLS LAST, stock_id) AS rank FROM h QUALIFY rank <= 10) SELECT *, CASE WHEN count(*) OVER g = count(disclosed) OVER g THEN 'exact' ELSE 'limited' END AS confidence FROM t WINDOW g AS (PARTITION BY etf_id)", "weight_pct")
def _j1(spark: SparkSession, d: str) -> DataFrame:
    return groups.latest_top(panel(spark, d, "holdings"), "etf_id")


@add("L4_mid_rank", f"{panel_sql('turnover')}, x AS (SELECT exchange, trade_date, turnover_amount AS v, list(turnover_amount) OVER (PARTITION BY exchange ORDER BY trade_date ROWS 119 PRECEDING) AS a FROM turnover) SELECT exchange, trade_date, CASE WHEN len(a) >= 30 THEN (len([y FOR y IN a IF y < v]) + len([y FOR y IN a IF y = v]) / 2) / len(a) END AS position FROM x", "position")
def _l4(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d, "turnover").select("exchange", "trade_date", s.mid_rank("turnover_amount", s.over("exchange"), 120, 30).alias("position"))


@add("B25_same_day_nav", f"{panel_sql('shares')} SELECT security_id, trade_date, shares, CASE WHEN day(trade_date) % 2 = 0 OR day(trade_date) % 7 <> 0 THEN nav END AS nav, CASE WHEN day(trade_date) % 2 = 0 THEN 'share_row' WHEN day(trade_date) % 7 <> 0 THEN 'nav_table' END AS nav_source FROM shares", "shares nav")
def _b25(spark: SparkSession, d: str) -> DataFrame:
    from pitmart.operators import flow

    shares = panel(spark, d, "shares")
    less = shares.withColumn("nav", F.when(F.dayofmonth("trade_date") % 2 == 0, F.col("nav")))
    return flow.nav_coalesce(less, shares.where(F.dayofmonth("trade_date") % 7 != 0), "security_id", "trade_date")


@add("M14_state_asof", f"{_M2} SELECT * FROM v WHERE trade_date <= DATE '1999-06-30' QUALIFY row_number() OVER (PARTITION BY exchange ORDER BY trade_date DESC) = 1", "ratio")
def _m14(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latest(_m2(spark, d), "exchange", "trade_date", "1999-06-30")


@add("N9_aligned_states", f"{_M2}, ix AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date FROM lineitem WHERE day(l_shipdate) <> 13), al AS (SELECT v.*, CASE WHEN year(trade_date) < 1998 THEN 'pulse_v1' ELSE 'pulse_v2' END AS version FROM v WHERE trade_date IN (SELECT trade_date FROM ix)) SELECT exchange, count(*) AS days, min(trade_date) AS since, max(trade_date) AS until, count(DISTINCT year(trade_date)) AS years, count(DISTINCT version) > 1 AS mixed_versions FROM al GROUP BY 1")
def _n9(spark: SparkSession, d: str) -> DataFrame:
    days = _table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("trade_date")).where(F.dayofmonth("trade_date") != 13).distinct()
    states = _m2(spark, d).withColumn("version", F.when(F.year("trade_date") < 1998, "pulse_v1").otherwise("pulse_v2"))
    return market.alignment(states, days, "exchange", "trade_date", "version")
