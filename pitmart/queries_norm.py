"""Queries of normalisation, adjustment and run health by inventory ID."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.operators import adjust, normalize
from pitmart.panels import panel, panel_sql
from pitmart.queries import add
from pitmart.streaming import steps


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_CODE = "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN ' ' || lpad(CAST(o_custkey AS VARCHAR(9)), 6, '0') || '.sz' WHEN o_orderkey % 8 = 1 THEN CAST(o_orderkey AS VARCHAR(9)) || '.HK' WHEN o_orderkey % 8 = 2 THEN CAST(o_orderkey % 100000 AS VARCHAR(9)) ELSE CAST(o_orderkey * 7919 % 1000000 AS VARCHAR(9)) END AS raw FROM {0}orders{1}"


@add(
    "B1_security_id",
    f"""WITH t AS (SELECT o_orderkey, raw, upper(trim(raw)) AS t FROM ({_CODE.format('', '')})), p AS (SELECT *, split_part(t, '.', 1) AS c, split_part(t, '.', 2) AS x FROM t)
SELECT o_orderkey, raw, CASE WHEN x = 'HK' AND length(c) <= 5 THEN lpad(c, 5, '0') || '.HK' WHEN x IN ('SH', 'SZ', 'BJ') AND length(c) <= 6 THEN lpad(c, 6, '0') || '.' || x
WHEN x <> '' THEN NULL WHEN length(t) = 5 THEN t || '.HK' WHEN length(t) <> 6 THEN NULL WHEN t LIKE '92%' THEN t || '.BJ' WHEN t LIKE '90%' THEN t || '.SH' WHEN t[1] IN ('4', '8') THEN t || '.BJ' WHEN t[1] IN ('0', '1', '2', '3') THEN t || '.SZ' WHEN t[1] IN ('5', '6') THEN t || '.SH' END AS security_id FROM p""",
)
def _b1(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_CODE.format("{", "}"), orders=_table(spark, d, "orders")).withColumn("security_id", normalize.security_id(F.col("raw")))


_WIDE = "SELECT c_custkey, CAST(c_acctbal AS VARCHAR(20)) AS \"2026-01-01-nav\", CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS VARCHAR(9)) END AS \"2026-01-02-nav\" FROM {0}customer{1}"
_LONG = f"SELECT c_custkey, DATE '2026-01-01' AS nav_date, try_cast(\"2026-01-01-nav\" AS DOUBLE) AS unit_nav, \"2026-01-01-nav\" AS raw FROM ({_WIDE.format('', '')}) UNION ALL SELECT c_custkey, DATE '2026-01-02', try_cast(\"2026-01-02-nav\" AS DOUBLE), \"2026-01-02-nav\" FROM ({_WIDE.format('', '')})"


def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return normalize.wide_to_long(spark.sql(_WIDE.format("{", "}").replace('"', "`"), customer=_table(spark, d, "customer")), "c_custkey")


@add("B2_nav_wide_to_long", f"SELECT c_custkey, nav_date, unit_nav FROM ({_LONG}) WHERE unit_nav > 0", "unit_nav")
def _b2(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d)[0]


@add("B3_nav_refused", f"SELECT c_custkey, nav_date, unit_nav, CASE WHEN unit_nav IS NULL THEN 'nav_not_a_number' ELSE 'nav_not_positive' END AS rule FROM ({_LONG}) WHERE raw IS NOT NULL AND (unit_nav IS NULL OR unit_nav <= 0)", "unit_nav")
def _b3(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d)[1]


@add("B8_key_value_pivot", "SELECT user_id, max(CASE WHEN event_type = 'click' THEN v * 100 END) AS clicks, max(CASE WHEN event_type = 'error' THEN v * 1.0 END) AS errors FROM (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2) GROUP BY 1", "clicks errors")
def _b8(spark: SparkSession, d: str) -> DataFrame:
    items = _table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("v"))
    return normalize.key_value_pivot(items, "user_id", "event_type", "v", {"click": ("clicks", 100.0), "error": ("errors", 1.0)})


@add("B20_outer_union", "SELECT k AS c_custkey, coalesce(a.nm, b.nm) AS nm, bal FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS nm, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0) a FULL OUTER JOIN (SELECT c_custkey AS k, c_mktsegment AS nm FROM customer WHERE c_custkey % 2 = 0) b USING (k)", "bal")
def _b20(spark: SparkSession, d: str) -> DataFrame:
    customer = _table(spark, d, "customer")
    a = customer.where("c_custkey % 3 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("nm"), F.col("c_acctbal").alias("bal"))
    return normalize.outer_union(a, customer.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_mktsegment").alias("nm")), "c_custkey")


@add("B21_premium", "SELECT o_orderkey, CASE WHEN i > 0 THEN (o_totalprice - i) / i END AS premium FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 90 AS DOUBLE) * CAST(0.97 AS DOUBLE) END AS i FROM orders)", "premium")
def _b21(spark: SparkSession, d: str) -> DataFrame:
    i = F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_custkey") % 90).cast("double") * 0.97)
    return _table(spark, d, "orders").select("o_orderkey", normalize.premium(F.col("o_totalprice"), i).alias("premium"))


@add("B22_index_name", "SELECT p_partkey, upper(regexp_replace(replace(p_name || ' (' || p_type || ')，价格指数', '价格指数', ''), '[\\s,，、;；/·（）()\\[\\]【】]+', '', 'g')) AS name FROM part")
def _b22(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", normalize.index_name(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")，价格指数"))).alias("name"))


@add("B23_unique_containment", "WITH c AS (SELECT n_name AS nm, n_nationkey AS index_id FROM nation WHERE length(n_name) >= 4), t AS (SELECT s_suppkey, s_name || ' tracks ' || n_name || CASE WHEN s_suppkey % 5 = 0 THEN ' AND NATION_1' ELSE ' index' END AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT s_suppkey, any_value(index_id) AS index_id FROM t JOIN c ON contains(text, nm) GROUP BY 1 HAVING count(DISTINCT index_id) = 1")
def _b23(spark: SparkSession, d: str) -> DataFrame:
    nation = _table(spark, d, "nation")
    text = F.concat("s_name", F.lit(" tracks "), "n_name", F.when(F.col("s_suppkey") % 5 == 0, " AND NATION_1").otherwise(" index"))
    texts = _table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", text.alias("text"))
    return normalize.unique_containment(texts, nation.select(F.col("n_nationkey").alias("index_id"), "n_name"), "s_suppkey", "text", "n_name")


@add("B24_estimated_aum", f"{panel_sql('shares')} SELECT security_id, trade_date, shares * v / 1000000 AS aum, v IS NOT NULL AS is_estimated FROM (SELECT *, CASE WHEN day(trade_date) % 3 <> 0 THEN nav END AS v FROM shares)", "aum")
def _b24(spark: SparkSession, d: str) -> DataFrame:
    aum, known = normalize.estimated_aum(F.col("shares"), F.when(F.dayofmonth("trade_date") % 3 != 0, F.col("nav")))
    return panel(spark, d, "shares").select("security_id", "trade_date", (aum / 1_000_000).alias("aum"), known.alias("is_estimated"))


_LATER = "(SELECT min(trade_date) FROM fund_days q WHERE q.security_id = a.security_id AND trade_date > action_date AND close IS NOT NULL)"
_SINCE = "(SELECT min(trade_date) FROM fund_days q WHERE q.security_id = a.security_id AND trade_date >= action_date AND (nav IS NOT NULL OR shares IS NOT NULL))"
_BEFORE = "(SELECT max_by(close, trade_date) FROM fund_days q WHERE q.security_id = a.security_id AND trade_date < action_date AND close IS NOT NULL)"
_E = f"""{panel_sql('fund_actions')}, f AS (SELECT a.*, {_LATER} AS effective_price, {_SINCE} AS effective_fund, {_BEFORE} AS p FROM fund_actions a),
r AS (SELECT *, CASE WHEN action_type <> 'DIVIDEND' AND NOT coalesce(k > 0, FALSE) THEN 'bad_ratio' WHEN action_type = 'DIVIDEND' AND (p IS NULL OR NOT coalesce(d > 0, FALSE)) THEN 'no_previous_close_or_amount' WHEN action_type = 'DIVIDEND' AND d >= p THEN 'dividend_not_under_price' END AS reason FROM f),
g AS (SELECT *, CASE action_type WHEN 'DIVIDEND' THEN p / (p - d) ELSE k END AS paid FROM r WHERE reason IS NULL),
m AS (SELECT security_id, effective_price AS trade_date, 'price' AS channel, action_type, paid AS m FROM g WHERE effective_price IS NOT NULL UNION ALL SELECT security_id, effective_fund, 'nav', action_type, paid FROM g WHERE effective_fund IS NOT NULL UNION ALL SELECT security_id, effective_fund, 'shares', action_type, CASE action_type WHEN 'DIVIDEND' THEN 1 ELSE k END FROM g WHERE effective_fund IS NOT NULL)"""


def _actions(spark: SparkSession, d: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    days = panel(spark, d, "fund_days")
    return days, adjust.multipliers(panel(spark, d, "fund_actions"), days)


@add("E1_effective_dates", f"{_E} SELECT * FROM f", "p k d")
def _e1(spark: SparkSession, d: str) -> DataFrame:
    return adjust.effective_dates(panel(spark, d, "fund_actions"), panel(spark, d, "fund_days"))


@add("E2_action_multipliers", f"{_E} SELECT * FROM m", "m")
def _e2(spark: SparkSession, d: str) -> DataFrame:
    return _actions(spark, d)[1][0]


@add("E3_refused_actions", f"{_E} SELECT DISTINCT security_id, action_date, action_type, reason FROM r WHERE reason IS NOT NULL")
def _e3(spark: SparkSession, d: str) -> DataFrame:
    return _actions(spark, d)[1][1]


_PRODUCT = "product(coalesce({c}, 1)) OVER (PARTITION BY security_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS {c}_factor"
_E4 = f"{_E}, dl AS (SELECT security_id, trade_date, {', '.join(f'product(m) FILTER (WHERE channel = {c!r}) AS {c}' for c in adjust.CHANNELS)} FROM m GROUP BY 1, 2), fc AS (SELECT security_id, trade_date, fund_days.close, fund_days.nav AS own_nav, fund_days.shares AS own_shares, {', '.join(_PRODUCT.format(c=c).replace(f'coalesce({c}', f'coalesce(dl.{c}') for c in adjust.CHANNELS)} FROM fund_days LEFT JOIN dl USING (security_id, trade_date))"


@add("E4_adjusted_series", f"{_E4} SELECT security_id, trade_date, price_factor, nav_factor, shares_factor, nav_factor AS factor, close * price_factor / 70000 AS adjusted_close, own_nav * nav_factor AS adjusted_nav, own_shares / shares_factor AS adjusted_shares FROM fc", "price_factor nav_factor shares_factor factor adjusted_close adjusted_nav adjusted_shares")
def _e4(spark: SparkSession, d: str) -> DataFrame:
    days, (factors, _) = _actions(spark, d)
    return adjust.adjusted(days, factors).withColumn("adjusted_close", F.col("adjusted_close") / 70000)


@add("A9_source_health", "WITH l AS (SELECT event_type, max(CASE WHEN NOT f THEN ts END) AS last_success, max(CASE WHEN f THEN ts END) AS last_failure FROM (SELECT event_type, ts, user_id % 3 = 0 AS f FROM events) GROUP BY 1) SELECT event_type, last_success, last_failure, (SELECT count(*) FROM events e WHERE e.event_type = l.event_type AND e.user_id % 3 = 0 AND (l.last_success IS NULL OR e.ts > l.last_success)) AS failures_in_a_row FROM l")
def _a9(spark: SparkSession, d: str) -> DataFrame:
    return steps.health_rollup(_table(spark, d, "events").select("event_type", "ts", (F.col("user_id") % 3 == 0).alias("failed")), "event_type", "ts", "failed")
