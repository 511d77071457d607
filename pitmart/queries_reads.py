"""Queries of screening, search, work lists, market ratios and the audit report by inventory ID."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.operators import audit, groups, market, pit
from pitmart.operators import series as s
from pitmart.panels import panel, panel_sql
from pitmart.queries import add
from pitmart.queries_more import _LAST, _TAGGED, ASOF

_DAY = f"DATE '{ASOF}'"
_FUND = "CAST(substr(security_id, 2) AS BIGINT)"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# K: four blocks of a fund
_BLOCKS = f"""{panel_sql('quotes', 'shares', 'fund_tag', 'fund_master')}, ids AS (SELECT CAST(s_suppkey AS BIGINT) AS fund_id, CAST(s_suppkey * 7 % 101 AS BIGINT) AS place FROM supplier UNION ALL SELECT 0 - CAST(s_suppkey AS BIGINT), s_suppkey FROM supplier WHERE s_suppkey % 9 = 0),
q AS (SELECT {_FUND} AS fund_id, trade_date AS quote_date, turnover_amount, close FROM quotes WHERE trade_date <= {_DAY} AND n_orders > 1 {_LAST.format(k='security_id', d='trade_date')}),
m AS (SELECT {_FUND} AS fund_id, trade_date AS metric_date, ret AS return_20d, CASE WHEN day(trade_date) % 4 = 0 THEN 'metric_v1' ELSE 'metric_v2' END AS metric_version FROM (SELECT *, close / lag(close, 20) OVER (PARTITION BY security_id ORDER BY trade_date) - 1 AS ret FROM quotes) WHERE trade_date <= {_DAY} AND day(trade_date) % 3 <> 0 {_LAST.format(k='security_id', d='trade_date')}),
f AS (SELECT security_id AS fund_id, trade_date AS flow_date, ch AS share_change_20d FROM (SELECT *, shares - lag(shares, 20) OVER (PARTITION BY security_id ORDER BY trade_date) AS ch FROM shares) WHERE trade_date <= {_DAY} AND day(trade_date) > 9 {_LAST.format(k='security_id', d='trade_date')}),
a AS (SELECT security_id AS fund_id, trade_date AS share_date, shares * nav AS aum FROM shares WHERE trade_date <= {_DAY} AND day(trade_date) < 8 {_LAST.format(k='security_id', d='trade_date')}),
j AS (SELECT * FROM ids LEFT JOIN q USING (fund_id) LEFT JOIN m USING (fund_id) LEFT JOIN f USING (fund_id) LEFT JOIN a USING (fund_id))"""
_WHY = "CASE WHEN {n}_date IS NULL THEN 'missing' WHEN datediff('day', {n}_date, {day}) > 25 THEN 'stale' {more}END AS r_{n}"
_VALUES = {"quote": ["turnover_amount", "close"], "metric": ["return_20d"], "flow": ["share_change_20d"], "share": ["aum"]}
_SAFE = f"""{_BLOCKS}, w AS (SELECT *, {', '.join(_WHY.format(n=n, day=_DAY, more="WHEN metric_version <> 'metric_v2' THEN 'calculation_version_mismatch' " if n == 'metric' else '') for n in _VALUES)} FROM j),
safe AS (SELECT fund_id, place, {', '.join(f'{n}_date, datediff({chr(39)}day{chr(39)}, {n}_date, {_DAY}) AS {n}_staleness_days' for n in _VALUES)}, {', '.join(f'CASE WHEN r_{n} IS NULL THEN {c} END AS {c}' for n, cs in _VALUES.items() for c in cs)}, concat_ws(',', {', '.join(f"'{n}:' || r_{n}" for n in _VALUES)}) AS stale_blocks, CASE WHEN {' AND '.join(f'r_{n} IS NULL' for n in _VALUES)} THEN 'PASS' ELSE 'PARTIAL' END AS data_quality FROM w)"""


def _compared(spark: SparkSession, d: str) -> DataFrame:
    supplier = _table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("fund_id"))
    ids = supplier.select("fund_id", (F.col("fund_id") * 7 % 101).alias("place")).unionByName(supplier.where("fund_id % 9 = 0").select((-F.col("fund_id")).alias("fund_id"), F.col("fund_id").alias("place")))
    quotes, shares = panel(spark, d, "quotes").withColumn("fund_id", F.expr(_FUND)), panel(spark, d, "shares").withColumnRenamed("security_id", "fund_id")
    w = s.over("fund_id")
    dom = F.dayofmonth("trade_date")
    last = lambda df, name, *columns: pit.asof_rows(df, "fund_id", "trade_date", ASOF).select("fund_id", F.col("trade_date").alias(f"{name}_date"), *columns)
    metric = quotes.withColumn("return_20d", F.col("close") / F.lag("close", 20).over(w) - 1).where(dom % 3 != 0).withColumn("metric_version", F.when(dom % 4 == 0, "metric_v1").otherwise("metric_v2"))
    flows = shares.withColumn("share_change_20d", F.col("shares") - F.lag("shares", 20).over(w)).where(dom > 9)
    blocks = [last(quotes.where("n_orders > 1"), "quote", "turnover_amount", "close"), last(metric, "metric", "return_20d", "metric_version"), last(flows, "flow", "share_change_20d"), last(shares.where(dom < 8), "share", (F.col("shares") * F.col("nav")).alias("aum"))]
    return pit.compare(ids, "fund_id", blocks)


def _safe(spark: SparkSession, d: str) -> DataFrame:
    blocks = {n: (f"{n}_date", cs) for n, cs in _VALUES.items()}
    return pit.with_staleness(_compared(spark, d), blocks, ASOF, 25, versions={"metric": ("metric_version", "metric_v2")}).drop("metric_version")


@add("K7_compare_blocks", f"{_BLOCKS} SELECT * FROM j ORDER BY place", "turnover_amount close return_20d share_change_20d aum")
def _k7(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).orderBy("place")


@add("K6_block_policy", f"{_SAFE} SELECT * FROM safe", "turnover_amount close return_20d share_change_20d aum")
def _k6(spark: SparkSession, d: str) -> DataFrame:
    return _safe(spark, d)


@add("K8_screen", f"{_SAFE} SELECT safe.* FROM safe WHERE fund_id IN (SELECT fund_id FROM fund_master WHERE name ILIKE '%supplier%') AND fund_id IN (SELECT fund_id FROM fund_tag WHERE tag_type = 'industry' AND {_TAGGED}) AND turnover_amount > 1000 AND aum IS NOT NULL ORDER BY turnover_amount DESC NULLS LAST, aum DESC NULLS LAST, fund_id LIMIT 25", "turnover_amount close return_20d share_change_20d aum")
def _k8(spark: SparkSession, d: str) -> DataFrame:
    named = panel(spark, d, "fund_master").where(F.col("name").ilike("%supplier%")).select("fund_id")
    tagged = groups.tags_asof(panel(spark, d, "fund_tag"), "fund_id", ASOF).where("tag_type = 'industry'").select("fund_id")
    # text and tags first, numbers after the policy, which may have nulled them
    rows = _safe(spark, d).join(named, "fund_id", "left_semi").join(tagged, "fund_id", "left_semi").where("turnover_amount > 1000 and aum is not null")
    return pit.top(rows, 25, F.desc_nulls_last("turnover_amount"), F.desc_nulls_last("aum"), F.asc("fund_id"))


@add("K13_quote_search", f"{panel_sql('quotes', 'fund_master')}, l AS (SELECT security_id, trade_date, turnover_amount, CASE WHEN n_orders > 1 THEN 'quoted ' || security_id END AS name FROM quotes {_LAST.format(k='security_id', d='trade_date')}), n AS (SELECT security_id, trade_date, turnover_amount, coalesce(l.name, m.name) AS name FROM l LEFT JOIN fund_master m ON 'S' || CAST(m.fund_id AS VARCHAR) = l.security_id) SELECT * FROM n WHERE security_id ILIKE '%supplier%' OR name ILIKE '%supplier%' ORDER BY turnover_amount DESC NULLS LAST, security_id LIMIT 20", "turnover_amount")
def _k13(spark: SparkSession, d: str) -> DataFrame:
    latest = pit.asof_rows(panel(spark, d, "quotes"), "security_id", "trade_date", "9999-12-31").select("security_id", "trade_date", "turnover_amount", F.when(F.col("n_orders") > 1, F.concat(F.lit("quoted "), "security_id")).alias("name"))
    names = panel(spark, d, "fund_master").select(F.concat(F.lit("S"), "fund_id").alias("security_id"), "name")
    return pit.search(latest, names, "security_id", "supplier", 20)


_AUM = f"{panel_sql('shares', 'fund_master', 'fund_index')}, l AS (SELECT security_id AS fund_id, shares * nav AS aum FROM shares WHERE security_id % 8 <> 0 {_LAST.format(k='security_id', d='trade_date')}), d AS (SELECT security_id AS fund_id, count(*) AS n FROM shares WHERE day(trade_date) % 3 <> 0 GROUP BY 1), x AS (SELECT m.*, coalesce(n, 0) AS n, m.fund_id IN (SELECT fund_id FROM fund_index WHERE valid_to IS NULL) AS mapped FROM fund_master m LEFT JOIN d USING (fund_id))"
_LISTS = {"short_nav_history": "n < 355", "missing_profile": "observed IS NULL OR fee < 0", "no_index": "NOT mapped"}


@add("K16_work_lists", f"{_AUM} " + " UNION ALL ".join(f"(SELECT '{n}' AS list, fund_id, aum FROM x LEFT JOIN l USING (fund_id) WHERE {c} ORDER BY aum DESC NULLS LAST, fund_id LIMIT 15)" for n, c in _LISTS.items()), "aum")
def _k16(spark: SparkSession, d: str) -> DataFrame:
    shares = panel(spark, d, "shares").withColumnRenamed("security_id", "fund_id")
    aum = pit.asof_rows(shares.where("fund_id % 8 <> 0"), "fund_id", "trade_date", "9999-12-31").select("fund_id", (F.col("shares") * F.col("nav")).alias("aum"))
    depth = shares.where(F.dayofmonth("trade_date") % 3 != 0).groupBy("fund_id").agg(F.count("*").alias("n"))
    mapped = panel(spark, d, "fund_index").where("valid_to is null").select("fund_id").distinct().withColumn("mapped", F.lit(True))
    rows = panel(spark, d, "fund_master").join(depth, "fund_id", "left").join(mapped, "fund_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("mapped", F.coalesce("mapped", F.lit(False)))
    out = None
    for name, needed in _LISTS.items():
        one = pit.work_list(rows, aum, "fund_id", F.expr(needed), 15).select(F.lit(name).alias("list"), "fund_id", "aum")
        out = one if out is None else out.unionByName(one)
    return out


@add("K17_tracked_indexes", f"{panel_sql('fund_index', 'm_index')}, c AS (SELECT DISTINCT 'N' || CAST(n_nationkey AS VARCHAR) AS index_id, lower(n_name) AS market_symbol FROM nation WHERE n_nationkey % 4 <> 0) SELECT index_id, market_symbol, index_id IN (SELECT 'N' || CAST(market_id AS VARCHAR) FROM m_index WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '1998-01-20') AS has_quotes FROM (SELECT DISTINCT index_id FROM fund_index) LEFT JOIN c USING (index_id)")
def _k17(spark: SparkSession, d: str) -> DataFrame:
    catalog = _table(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.concat(F.lit("N"), "n_nationkey").alias("index_id"), F.lower("n_name").alias("market_symbol"))
    quoted = panel(spark, d, "m_index").where(F.col("trade_date").between("1998-01-01", "1998-01-20")).select(F.concat(F.lit("N"), "market_id").alias("index_id")).distinct().withColumn("has_quotes", F.lit(True))
    return panel(spark, d, "fund_index").select("index_id").distinct().join(catalog, "index_id", "left").join(quoted, "index_id", "left").withColumn("has_quotes", F.coalesce("has_quotes", F.lit(False)))


# L: market
@add("L1_last_days", f"{panel_sql('turnover')} SELECT trade_date, sum(turnover_amount) AS amount, max(rate) AS rate, count(DISTINCT exchange) AS exchanges FROM turnover GROUP BY 1 ORDER BY trade_date DESC LIMIT 250", "amount rate")
def _l1(spark: SparkSession, d: str) -> DataFrame:
    return market.last_days(market.totals(panel(spark, d, "turnover")), "trade_date", 250)


_ACTIVITY = "SELECT CAST(l_shipdate AS DATE) AS trade_date, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS rising, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS falling, CASE WHEN day(l_shipdate) % 5 <> 0 THEN CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) END AS flat, CAST(sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS BIGINT) AS limit_up FROM {0}lineitem{1} GROUP BY CAST(l_shipdate AS DATE), day(l_shipdate)"
_SIDES = "t AS (SELECT trade_date, exchange, turnover_amount AS amount, CASE WHEN day(trade_date) <> 13 THEN rate * 1009 ELSE 0 END AS cap FROM turnover), m AS (SELECT trade_date, exchange, turnover_amount * 3 AS balance FROM turnover WHERE day(trade_date) % 7 <> 2 OR exchange = 'A')"


@add("L2_norm_ratios", f"{panel_sql('turnover')}, {_SIDES}, ac AS ({_ACTIVITY.format('', '')}), tt AS (SELECT trade_date, sum(amount) AS amount, sum(cap) AS cap, count(DISTINCT exchange) AS nt FROM t GROUP BY 1), mm AS (SELECT trade_date, sum(balance) AS balance, count(DISTINCT exchange) AS nm FROM m GROUP BY 1) SELECT trade_date, CASE WHEN nt = 2 AND nm = 2 AND cap > 0 THEN balance / cap END AS margin_balance_ratio, CASE WHEN cap > 0 THEN amount / cap END AS turnover_ratio, CASE WHEN rising + falling > 0 THEN rising / (rising + falling) END AS advance_ratio, CASE WHEN rising + falling + coalesce(flat, 0) > 0 THEN limit_up / (rising + falling + coalesce(flat, 0)) END AS limit_up_ratio, cap FROM tt LEFT JOIN mm USING (trade_date) LEFT JOIN ac USING (trade_date)", "margin_balance_ratio turnover_ratio advance_ratio limit_up_ratio cap")
def _l2(spark: SparkSession, d: str) -> DataFrame:
    t = panel(spark, d, "turnover")
    dom = F.dayofmonth("trade_date")
    sides = t.select("trade_date", "exchange", F.col("turnover_amount").alias("amount"), F.when(dom != 13, F.col("rate") * 1009).otherwise(0).alias("cap"))
    margin = t.where((dom % 7 != 2) | (F.col("exchange") == "A")).select("trade_date", "exchange", (F.col("turnover_amount") * 3).alias("balance"))
    return market.norm_ratios(sides, margin, spark.sql(_ACTIVITY.format("{", "}"), lineitem=_table(spark, d, "lineitem")), "trade_date")


@add("L6_long_position", f"{panel_sql('m_index')}, x AS (SELECT market_id, trade_date, close, list(close) OVER (PARTITION BY market_id ORDER BY trade_date ROWS 749 PRECEDING) AS a FROM m_index WHERE close IS NOT NULL) SELECT market_id, trade_date, CASE WHEN len(a) >= 60 THEN (len([y FOR y IN a IF y < close]) + len([y FOR y IN a IF y = close]) / 2) / len(a) END AS position_3y FROM x", "position_3y")
def _l6(spark: SparkSession, d: str) -> DataFrame:
    return market.index_position(panel(spark, d, "m_index"), "market_id", "trade_date", "close", 750).select("market_id", "trade_date", F.col("position").alias("position_3y"))


# O: audit of six facts, and the report
_FACTS = {
    "shares": ("fund_days", "shares", "CASE WHEN day(trade_date) = 2 AND security_id % 5 = 0 THEN 0 ELSE shares END"),
    "nav": ("fund_days", "nav", "CASE WHEN day(trade_date) = 3 AND security_id % 5 = 1 THEN 0 ELSE nav END"),
    "unit_nav": ("adjusted", "adjusted_nav", "CASE WHEN day(trade_date) = 4 THEN 0 - adjusted_nav ELSE adjusted_nav END"),
    "iopv": ("quotes", "close", "CASE WHEN day(trade_date) = 5 THEN 0 ELSE close END"),
    "turnover_amount": ("m_turnover", "amount", "CASE WHEN day(trade_date) = 6 THEN 0 ELSE amount END"),
    "margin_balance": ("m_margin", "balance", "CASE WHEN day(trade_date) = 7 THEN 0 ELSE balance END"),
}


@add("O5_zero_for_unknown", f"{panel_sql('fund_days', 'adjusted', 'm_turnover', 'm_margin')} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {x} <= 0) AS n FROM {t}" for n, (t, _, x) in _FACTS.items()))
def _o5(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for n, (t, _, x) in _FACTS.items():
        one = audit.counted(panel(spark, d, t), {n: F.expr(x) <= 0})
        out = one if out is None else out.unionByName(one)
    return out


@add("O6_missing_metadata", f"{panel_sql('fund_days', 'adjusted', 'm_turnover', 'm_margin')} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE day(trade_date) = {k + 2} OR {c} IS NULL) AS n FROM {t}" for k, (n, (t, c, _)) in enumerate(_FACTS.items())))
def _o6(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for k, (n, (t, c, _)) in enumerate(_FACTS.items()):
        rows = panel(spark, d, t).select(F.when(F.dayofmonth("trade_date") != k + 2, "vendor").alias("source"), F.col(c).alias("fetched_at"))
        one = audit.counted(rows, {n: (F.coalesce("source", F.lit("")) == "") | F.col("fetched_at").isNull()})
        out = one if out is None else out.unionByName(one)
    return out


@add("O14_audit_report", f"{panel_sql('turnover')}, x AS (SELECT 'single_exchange' AS rule, 'WARN' AS severity, 'turnover' AS dataset, CAST(trade_date AS VARCHAR) AS key FROM turnover GROUP BY trade_date HAVING count(DISTINCT exchange) < 2 UNION ALL SELECT 'orphan_order', 'ERROR', 'orders', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT l_suppkey FROM lineitem)), y AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY key) AS rn FROM x) SELECT rule, severity, dataset, count(*) AS n, string_agg(key, ',' ORDER BY key) FILTER (WHERE rn <= 3) AS samples, 'FAIL' AS status FROM y GROUP BY 1, 2, 3")
def _o14(spark: SparkSession, d: str) -> DataFrame:
    days = market.totals(panel(spark, d, "turnover"))
    found = audit.broken(days, "single_exchange", "WARN", "turnover", F.col("exchanges") < 2, F.col("trade_date"))
    known = _table(spark, d, "lineitem").select(F.col("l_suppkey").alias("o_custkey")).distinct()
    orphans = _table(spark, d, "orders").join(known, "o_custkey", "left_anti")
    return audit.report(found.unionByName(audit.broken(orphans, "orphan_order", "ERROR", "orders", F.lit(True), F.col("o_orderkey"))), strict=True)
