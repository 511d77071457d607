"""Queries of vendor frames and sinks by inventory ID, on raw frames that the given tables are written out as."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.operators import checks
from pitmart.panels import panel, panel_sql
from pitmart.queries import add
from pitmart.sources import frames, sinks


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _raw(spark: SparkSession, d: str, text: str, *names: str) -> DataFrame:
    return spark.sql(text, **{n: panel(spark, d, n[2:]) if n.startswith("p_") else _table(spark, d, n) for n in names})


def _duck(text: str) -> str:
    return text.replace("{p_", "{").replace("{", "").replace("}", "")


_CODE = "CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE lpad(CAST(o_orderkey % 700000 AS VARCHAR(9)), 6, '5') END"
_ID = "CASE WHEN o_orderkey % 13 <> 0 THEN lpad(CAST(o_orderkey % 700000 AS VARCHAR(9)), 6, '5') || '.SH' END"
_WHEN = "CASE WHEN o_orderkey % 11 = 0 THEN 'no date' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END"
_AT = "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END"
_SIZE = "CASE WHEN o_orderkey % 7 = 0 THEN '--' ELSE CAST(o_custkey AS VARCHAR(9)) END"
_NUM = "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) END"

_B4 = f"SELECT {_CODE} AS code, {_WHEN} AS stat_date, {_SIZE} AS volume, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE ' n ' END AS name FROM {{orders}}"
_B4X = f"SELECT {_ID} AS security_id, {_AT} AS trade_date, {_NUM} * 10000 AS shares, CASE WHEN o_orderkey % 5 <> 0 THEN 'n' END AS fund_name, CAST(NULL AS DOUBLE) AS nav FROM orders"


@add("B4_unit_shares", f"SELECT * FROM ({_B4X}) WHERE security_id IS NOT NULL AND trade_date IS NOT NULL AND shares IS NOT NULL", "shares")
def _b4(spark: SparkSession, d: str) -> DataFrame:
    return frames.unit_shares(_raw(spark, d, _B4, "orders"), "1998-01-01")[0]


@add("B4_share_issues", f"SELECT rule, count(*) AS n FROM (SELECT CASE WHEN security_id IS NULL THEN 'share_code_unresolved' WHEN trade_date IS NULL THEN 'share_stat_date_invalid' WHEN shares IS NULL THEN 'share_volume_unresolved' WHEN trade_date < DATE '1998-01-01' THEN 'share_stat_date_behind_request' END AS rule FROM ({_B4X})) WHERE rule IS NOT NULL GROUP BY 1")
def _b4_issues(spark: SparkSession, d: str) -> DataFrame:
    _, issues, late = frames.unit_shares(_raw(spark, d, _B4, "orders"), "1998-01-01")
    return issues.select("rule").unionByName(late.select("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@add("B5_snapshot_shares", f"SELECT {_ID} AS security_id, DATE '1998-01-05' AS trade_date, {_NUM} AS shares, 'n' AS fund_name, CASE WHEN o_orderkey % 3 <> 0 THEN 1.5::DOUBLE END AS nav, CASE WHEN o_orderkey % 3 <> 0 THEN 'szse' END AS nav_source, TRUE AS date_derived FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0", "shares nav")
def _b5(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw(spark, d, f"SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE {_CODE} || '.SH' END AS code, {_SIZE} AS volume, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '1.5' END AS nav, ' n' AS name FROM {{orders}}", "orders")
    return frames.snapshot_shares(raw, "1998-01-05")[0]


@add("B6_spot_quotes", f"SELECT security_id, trade_date, close, iopv, amount, CASE WHEN iopv > 0 THEN (close - iopv) / iopv END AS premium FROM (SELECT {_ID} AS security_id, {_AT} AS trade_date, {_NUM} AS close, CASE WHEN o_orderkey % 5 = 0 THEN 0.0::DOUBLE WHEN o_orderkey % 5 <> 1 THEN CAST(o_custkey + 3 AS DOUBLE) END AS iopv, o_totalprice::DOUBLE AS amount FROM orders) WHERE security_id IS NOT NULL AND trade_date IS NOT NULL AND close IS NOT NULL", "close iopv amount premium")
def _b6(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw(spark, d, f"SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE {_CODE} || '.SH' END AS code, {_WHEN} AS quote_date, {_SIZE} AS close, CASE WHEN o_orderkey % 5 = 0 THEN '0' WHEN o_orderkey % 5 = 1 THEN '-' ELSE CAST(o_custkey + 3 AS VARCHAR(9)) END AS iopv, CAST(o_totalprice AS VARCHAR(30)) AS amount FROM {{orders}}", "orders")
    return frames.spot_quotes(raw)[0]


_B7 = "SELECT security_id, trade_date, close FROM {p_quotes} WHERE "


@add("B7_history_with_fallback", f"{panel_sql('quotes')}, a AS ({_duck(_B7)} security_id LIKE '%1'), b AS ({_duck(_B7)} day(trade_date) % 2 = 0) SELECT *, 'primary' AS source FROM a UNION ALL SELECT *, 'secondary' FROM b WHERE security_id NOT IN (SELECT security_id FROM a)", "close")
def _b7(spark: SparkSession, d: str) -> DataFrame:
    return frames.history_with_fallback(*(_raw(spark, d, _B7 + where, "p_quotes") for where in ("security_id LIKE '%1'", "day(trade_date) % 2 = 0")))


_B9 = f"SELECT CAST(o_orderdate AS DATE) AS trade_date, CASE WHEN o_orderkey % 4 = 0 THEN ' all ' ELSE 'part' END AS category, {_SIZE} AS amount, CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE '2.5' END AS rate FROM {{orders}}"


@add("B9_category_row", f"SELECT CAST(o_orderdate AS DATE) AS trade_date, {_NUM} AS turnover_amount, CASE WHEN o_orderkey % 8 <> 0 THEN 2.5::DOUBLE END AS rate FROM orders WHERE o_orderkey % 4 = 0", "turnover_amount rate")
def _b9(spark: SparkSession, d: str) -> DataFrame:
    return frames.category_row(_raw(spark, d, _B9, "orders"), "all")


_B10 = f"SELECT {_WHEN} AS trade_date, 'A' AS exchange, CASE WHEN o_orderkey % 9 = 0 THEN '0' ELSE {_SIZE} END AS balance, '1' AS financing FROM {{orders}}"
_B10X = f"SELECT {_AT} AS trade_date, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE {_NUM} END AS margin_balance FROM orders"


@add("B10_margin_balances", f"SELECT trade_date, 'A' AS exchange, margin_balance, 1.0::DOUBLE AS financing_balance FROM ({_B10X}) WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND margin_balance > 0", "margin_balance financing_balance")
def _b10(spark: SparkSession, d: str) -> DataFrame:
    return frames.margin_balances(_raw(spark, d, _B10, "orders"), "1997-01-01", "1998-12-31")[0]


@add("B10_margin_issues", f"SELECT CASE WHEN trade_date IS NULL THEN 'margin_date_invalid' WHEN margin_balance IS NULL THEN 'margin_balance_null' ELSE 'margin_balance_zero_substituted' END AS rule, count(*) AS n FROM ({_B10X}) WHERE trade_date IS NULL OR (trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND coalesce(margin_balance, 0) <= 0) GROUP BY 1")
def _b10_issues(spark: SparkSession, d: str) -> DataFrame:
    return frames.margin_balances(_raw(spark, d, _B10, "orders"), "1997-01-01", "1998-12-31")[1].groupBy("rule").agg(F.count("*").alias("n"))


_B11 = f"SELECT CAST(o_custkey % 50 AS VARCHAR(9)) AS index_id, {_WHEN} AS trade_date, {_SIZE} AS pe_ttm, CASE WHEN o_orderkey % 5 <> 0 THEN '12.5' END AS pe_static, '1' AS pb FROM {{orders}}"


@add("B11_valuations", f"SELECT CAST(o_custkey % 50 AS VARCHAR(9)) AS index_id, {_AT} AS trade_date, {_NUM} AS pe_ttm, CASE WHEN o_orderkey % 5 <> 0 THEN 12.5::DOUBLE END AS pe_static, 1.0::DOUBLE AS pb FROM orders WHERE o_orderkey % 11 <> 0 AND (o_orderkey % 7 <> 0 OR o_orderkey % 5 <> 0)", "pe_ttm pe_static pb")
def _b11(spark: SparkSession, d: str) -> DataFrame:
    return frames.valuations(_raw(spark, d, _B11, "orders"), ["pe_ttm", "pe_static", "pb"], ["pe_ttm", "pe_static"])[0]


@add("B12_new_funds", f"SELECT CAST(o_orderkey AS VARCHAR) AS fund_code, CASE WHEN o_orderkey % 4 <> 0 THEN 'f' END AS fund_name, {_NUM} AS raised_shares, {_AT} AS established_date FROM orders WHERE o_orderkey % 6 <> 0", "raised_shares")
def _b12(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw(spark, d, f"SELECT CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE ' ' || CAST(o_orderkey AS VARCHAR(19)) END AS code, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'f ' END AS name, {_SIZE} AS raised, {_WHEN} AS established FROM {{orders}}", "orders")
    return frames.new_funds(raw)[0]


_B13 = "SELECT CAST(l_suppkey AS BIGINT) AS etf_id, CASE WHEN l_orderkey % 17 = 0 THEN 'quarter' ELSE CAST(year(l_shipdate) AS VARCHAR(9)) || '年' || CAST(quarter(l_shipdate) AS VARCHAR(9)) || '季度股票投资明细' END AS quarter, CASE WHEN l_partkey % 19 = 0 THEN '' WHEN l_partkey % 23 = 0 THEN 'bad' ELSE lpad(CAST(l_partkey AS VARCHAR(9)), 6, '0') || '.0' END AS code, CASE WHEN l_linenumber % 5 = 0 THEN '--' ELSE CAST(l_orderkey * 10 + l_linenumber AS VARCHAR(19)) END AS weight FROM {lineitem}"


@add("B13_holdings", "WITH r AS (SELECT CAST(l_suppkey AS BIGINT) AS etf_id, CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS report_date, l_partkey, CASE WHEN l_partkey % 19 = 0 THEN '' WHEN l_partkey % 23 = 0 THEN 'bad' ELSE lpad(CAST(l_partkey AS VARCHAR), 6, '0') END AS code, CASE WHEN l_linenumber % 5 <> 0 THEN CAST(l_orderkey * 10 + l_linenumber AS DOUBLE) END AS weight_pct FROM lineitem WHERE l_orderkey % 17 <> 0), t AS (SELECT * FROM r QUALIFY report_date = max(report_date) OVER (PARTITION BY etf_id)), u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY etf_id ORDER BY weight_pct DESC NULLS LAST, code) <= 10) SELECT etf_id, report_date, weight_pct, code || '.SZ' AS stock_id FROM u WHERE code NOT IN ('', 'bad')", "weight_pct")
def _b13(spark: SparkSession, d: str) -> DataFrame:
    return frames.holdings(_raw(spark, d, _B13, "lineitem"), "etf_id")[0]


_LISTED = "SELECT CASE WHEN p_partkey % 9 = 0 THEN 'H' ELSE '' END || lpad(CAST(p_partkey AS VARCHAR(9)), 6, '0') AS code, CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_name END AS full_name, p_type AS short_name FROM {part} WHERE p_partkey % 3 <> 0"
_SYMBOLS = "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'SH' ELSE 'sz' END || lpad(CAST(p_partkey - p_partkey % 2 AS VARCHAR(9)), 6, '0') AS symbol, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_brand END AS name, p_partkey AS place FROM {part}"


@add("B14_index_catalog", f"WITH l AS (SELECT code AS index_id, coalesce(nullif(trim(full_name), ''), short_name) AS index_name FROM ({_duck(_LISTED)}) WHERE regexp_matches(code, '^[0-9]+$')), s AS (SELECT substr(lower(symbol), 3) AS index_id, lower(symbol) AS market_symbol, nullif(name, '') AS symbol_name FROM ({_duck(_SYMBOLS)}) QUALIFY row_number() OVER (PARTITION BY substr(symbol, 3) ORDER BY place) = 1) SELECT index_id, coalesce(index_name, symbol_name) AS index_name, market_symbol, CASE WHEN l.index_id IS NOT NULL THEN 'catalog' ELSE 'symbols' END AS source FROM l FULL JOIN s USING (index_id) WHERE l.index_id IS NOT NULL OR symbol_name IS NOT NULL")
def _b14(spark: SparkSession, d: str) -> DataFrame:
    return frames.index_catalog(_raw(spark, d, _LISTED, "part"), _raw(spark, d, _SYMBOLS, "part"))


_B15 = "SELECT CASE WHEN o_custkey % 15 = 0 THEN 'H' ELSE '' END || lpad(CAST(o_custkey % 400 AS VARCHAR(9)), 6, '0') AS index_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS trade_date, CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE CAST(o_orderkey AS VARCHAR(19)) END AS close FROM {orders} WHERE "


@add("B15_index_quotes", f"WITH a AS (SELECT *, 0 AS place, 'first' AS source FROM ({_duck(_B15)} o_custkey % 3 = 0) UNION ALL SELECT *, 1, 'second' FROM ({_duck(_B15)} o_custkey % 2 = 0)), g AS (SELECT index_id, CAST(trade_date AS DATE) AS trade_date, CAST(close AS DOUBLE) AS close, source, place FROM a WHERE trade_date BETWEEN '1997-01-01' AND '1997-12-31' AND close <> '-' AND index_id NOT LIKE 'H%') SELECT index_id, trade_date, close, source FROM g QUALIFY place = min(place) OVER (PARTITION BY index_id)", "close")
def _b15(spark: SparkSession, d: str) -> DataFrame:
    return frames.index_quotes([("first", _raw(spark, d, _B15 + "o_custkey % 3 = 0", "orders")), ("second", _raw(spark, d, _B15 + "o_custkey % 2 = 0", "orders"))], "1997-01-01", "1997-12-31")[0]


_B16 = f"SELECT lpad(CAST(o_custkey AS VARCHAR(9)), 6, '0') AS code, CASE o_orderkey % 3 WHEN 0 THEN '{frames.STANDARDS[0]}' WHEN 1 THEN '{frames.STANDARDS[1]}' ELSE 'other' END AS standard, {_WHEN} AS changed, CASE WHEN o_orderkey % 5 <> 0 THEN 'a' || CAST(o_orderkey AS VARCHAR(19)) END AS level3, CASE WHEN o_orderkey % 10 <> 0 THEN 'b' || CAST(o_orderkey AS VARCHAR(19)) END AS level2, CASE WHEN o_orderkey % 20 <> 0 THEN 'c' || CAST(o_orderkey AS VARCHAR(19)) END AS level1 FROM {{orders}}"
_PICKED = f"SELECT * FROM (SELECT *, CASE standard WHEN '{frames.STANDARDS[0]}' THEN 0 WHEN '{frames.STANDARDS[1]}' THEN 1 END AS o FROM ({_duck(_B16)})) WHERE o IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code ORDER BY o, try_cast(changed AS DATE) DESC NULLS LAST, level3 NULLS LAST, level2 NULLS LAST, level1 NULLS LAST) = 1"


@add("B16_industries", f"SELECT code || '.SZ' AS stock_id, coalesce(level3, level2, level1) AS industry_name, standard AS classification_standard FROM ({_PICKED}) WHERE coalesce(level3, level2, level1) IS NOT NULL")
def _b16(spark: SparkSession, d: str) -> DataFrame:
    return frames.industries(_raw(spark, d, _B16, "orders"))[0]


_HEAD = {k: "<tr>" + "".join(f"<th>{c}</th>" for c in h) + "</tr>" for k, h in (("s", frames.SPLIT_HEADER), ("d", frames.DIVIDEND_HEADER))}
_B17 = f"""SELECT o_orderkey, '<p>x</p><table class="a">{_HEAD['s']}<tr><td>1998</td><td>' || {_WHEN} || '</td><td>' || CASE o_orderkey % 4 WHEN 0 THEN '份额分拆' WHEN 1 THEN '基金折算' ELSE '?' END || '</td><td><b>1:' || CAST(o_custkey % 7 AS VARCHAR(9)) || '.50</b></td></tr></table><TABLE>{_HEAD['d']}' || CASE WHEN o_orderkey % 3 = 0 THEN '<tr><td>暂无分红信息!</td></tr>' ELSE '<tr><td>1998</td><td>-</td><td>1998年3月' || CAST(1 + o_custkey % 28 AS VARCHAR(9)) || '日</td><td>每10份派现金' || CAST(o_custkey AS VARCHAR(9)) || '.25' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '元' END || '</td><td>-</td></tr>' END || '</TABLE>' AS html FROM {{orders}}"""


@add("B17_corporate_actions", f"SELECT o_orderkey, {_AT} AS action_date, CASE o_orderkey % 4 WHEN 0 THEN 'SPLIT' WHEN 1 THEN 'SHARE_CONVERSION' ELSE 'OTHER' END AS action_type, o_custkey % 7 + 0.5::DOUBLE AS share_factor, 1 / (o_custkey % 7 + 0.5::DOUBLE) AS nav_factor, CAST(NULL AS DOUBLE) AS cash FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, make_date(1998, 3, CAST(1 + o_custkey % 28 AS INT)), 'DIVIDEND', NULL, NULL, (o_custkey + 0.25::DOUBLE) / 10 FROM orders WHERE o_orderkey % 3 <> 0", "share_factor nav_factor cash")
def _b17(spark: SparkSession, d: str) -> DataFrame:
    return frames.corporate_actions(_raw(spark, d, _B17, "orders"), "o_orderkey", "html")[0]


_B18 = "SELECT c_custkey, '<table><tr><th>管理费率</th><td>' || CASE WHEN c_custkey % 5 = 0 THEN '--' ELSE CAST(c_custkey AS VARCHAR(9)) || '.5%（每年）' END || '</td><th>基金经理</th><td><a href=\"/\">' || c_name || '</a></td></tr><tr><th>管理费率</th><td>9%</td></tr></table>' AS html FROM {customer}"


@add("B18_profile", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS VARCHAR) || '.5' END AS fee, c_name AS manager, CAST(NULL AS VARCHAR) AS custodian FROM customer")
def _b18(spark: SparkSession, d: str) -> DataFrame:
    return frames.profile(_raw(spark, d, _B18, "customer"), "c_custkey", "html", {"管理费率": "fee", "基金经理": "manager", "基金托管人": "custodian"})


_B19 = "SELECT c_custkey, 'intro | no\n| id | name |\n|---|:---|\n| ' || CAST(c_custkey AS VARCHAR(9)) || ' | ' || c_name || ' |\n| too | many | cells |\n| ' || CAST(c_nationkey AS VARCHAR(9)) || ' | second |\n\n| id | v |\n| - | - |\n| q | ' || c_mktsegment || ' |\ntail' AS text FROM {customer}"


@add("B19_pipe_tables", "SELECT c_custkey, 3 AS line, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(NULL AS VARCHAR) AS v FROM customer UNION ALL SELECT c_custkey, 5, CAST(c_nationkey AS VARCHAR), 'second', NULL FROM customer UNION ALL SELECT c_custkey, 9, 'q', NULL, c_mktsegment FROM customer")
def _b19(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.pipe_tables(_raw(spark, d, _B19, "customer"), "c_custkey", "text")
    return rows.select("c_custkey", "line", *(F.element_at("cells", c).alias(c) for c in ("id", "name", "v")))


_OWN = "SELECT security_id, trade_date, shares FROM {p_shares} WHERE security_id % 4 <> 0"
_OTHER = "SELECT security_id, trade_date, shares * 2 AS shares, CASE WHEN security_id % 2 = 0 THEN '货币型' ELSE '股票型' END AS fund_type FROM {p_shares} WHERE day(trade_date) < 10"


@add("B26_money_market_supplement", f"{panel_sql('shares')}, a AS ({_duck(_OWN)}), b AS ({_duck(_OTHER)}) SELECT * FROM a UNION ALL SELECT security_id, trade_date, shares FROM b WHERE fund_type = '货币型' AND (security_id, trade_date) NOT IN (SELECT security_id, trade_date FROM a)", "shares")
def _b26(spark: SparkSession, d: str) -> DataFrame:
    master = panel(spark, d, "fund_master").select(F.col("fund_id").alias("security_id"))
    return frames.money_market_supplement(_raw(spark, d, _OWN, "p_shares"), master, _raw(spark, d, _OTHER, "p_shares"))[0]


@add("C3_trading_day_issues", f"{panel_sql('calendar')}, b AS (SELECT min(trade_date) AS lo, max(trade_date) AS hi FROM calendar) SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, 'not_a_trading_day' AS rule FROM lineitem, b WHERE CAST(l_shipdate AS DATE) BETWEEN lo AND hi AND CAST(l_shipdate AS DATE) NOT IN (SELECT trade_date FROM calendar)")
def _c3(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"))
    return frames.trading_day_issues(rows, panel(spark, d, "calendar"), "day")[1]


# A: sinks
@add("A8_run_status", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'FAILED' WHEN o_orderkey % 5 = 0 THEN 'SKIPPED' WHEN o_custkey % 5 < o_orderkey % 5 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM orders")
def _a8(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _table(spark, d, "orders").select("o_orderkey", sinks.status(k % 5, F.col("o_custkey") % 5, k % 9 == 0).alias("status"))


@add("A10_issue_rows", f"SELECT dataset, security_id, trade_date, severity, rule, details FROM (SELECT 'margin' AS dataset, 'A' AS security_id, trade_date, 'WARN' AS severity, CASE WHEN trade_date IS NULL THEN 'margin_date_invalid' WHEN margin_balance IS NULL THEN 'margin_balance_null' ELSE 'margin_balance_zero_substituted' END AS rule, CASE WHEN margin_balance = 0 THEN '0.0' WHEN margin_balance IS NOT NULL THEN CAST(margin_balance AS VARCHAR) END AS details FROM ({_B10X}) WHERE trade_date IS NULL OR (trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND coalesce(margin_balance, 0) <= 0))")
def _a10(spark: SparkSession, d: str) -> DataFrame:
    issues = frames.margin_balances(_raw(spark, d, _B10, "orders"), "1997-01-01", "1998-12-31")[1]
    return sinks.issue_rows(issues, "margin", F.col("exchange"), F.col("trade_date"), F.col("margin_balance")).drop("issue_id")


_NEW_MAP = "SELECT fund_id, index_id, 'Name ' || index_id AS index_name, coalesce(valid_from, DATE '1990-01-01') AS valid_from FROM {p_fund_index} WHERE fund_id % 3 <> 0"
_MASTER = "SELECT fund_id, master_index AS tracking_index_id, CAST(NULL AS VARCHAR(20)) AS tracking_index_name FROM {p_fund_master}"


@add("A11_master_of_map", f"{panel_sql('fund_index', 'fund_master')}, n AS ({_duck(_NEW_MAP)}), l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY fund_id ORDER BY valid_from DESC, index_id DESC) = 1) SELECT m.fund_id, coalesce(l.index_id, m.tracking_index_id) AS tracking_index_id, l.index_name AS tracking_index_name FROM ({_duck(_MASTER)}) m LEFT JOIN l USING (fund_id)")
def _a11(spark: SparkSession, d: str) -> DataFrame:
    new = _raw(spark, d, _NEW_MAP, "p_fund_index")
    return sinks.map_and_master(_raw(spark, d, _MASTER, "p_fund_master"), new.limit(0), new, "fund_id")[1]


@add("A3_frame_contract", "SELECT 'missing_column:fee' AS rule, 'ERROR' AS severity UNION ALL SELECT 'empty_frame', 'WARN' WHERE (SELECT count(*) FROM customer WHERE c_acctbal > 10000000) = 0 UNION ALL SELECT 'empty_frame', 'ERROR' WHERE (SELECT count(*) FROM customer) = 0")
def _a3(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "customer")
    return checks.contract(rows, ["c_custkey", "fee"]).unionByName(checks.contract(rows.where("c_acctbal > 10000000"), ["c_custkey"], allow_empty=True))
