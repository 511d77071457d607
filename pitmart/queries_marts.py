"""Queries of tracking, flows on adjusted series, peers, holdings, baskets, audit rules and records by inventory ID."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.operators import audit, calendar, flow, groups, market, metrics, pit, records
from pitmart.operators import series as s
from pitmart.panels import by_fund, panel, panel_sql
from pitmart.queries import add, rounded
from pitmart.queries_more import ASOF

_DAY = f"DATE '{ASOF}'"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# H: against an index
_NAMES = "CASE p % 4 WHEN 0 THEN 'X全收益' WHEN 1 THEN 'X净收益' WHEN 2 THEN 'X价格' ELSE 'X' END"
_BASIS = "CASE WHEN contains(n, '全收益') THEN 'total_return_index' WHEN contains(n, '净收益') THEN 'net_total_return_index' WHEN contains(n, '价格') THEN 'price_index' ELSE 'unknown' END"


@add("H1_return_basis", f"SELECT p_partkey, {_BASIS} AS basis FROM (SELECT p_partkey, p_type || {_NAMES.replace('p % 4', 'p_partkey % 4')} AS n FROM part)")
def _h1(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_type", F.expr(_NAMES.replace("p % 4", "p_partkey % 4")))
    return _table(spark, d, "part").select("p_partkey", metrics.return_basis(name).alias("basis"))


_FUNDS = f"funds AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR(9)) AS security_id, r_name AS index_id, {_BASIS.replace('(n,', f'({_NAMES},').replace('p %', 's_suppkey %')} AS basis FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_OWN = ", ".join(f"coalesce(max(abs(rn)) OVER (w ROWS {n - 1} PRECEDING) > 0.2, FALSE) AS j{n}" for n in (20, 60))
_TRACK = f"""{panel_sql('quotes', 'index_quotes')}, {_FUNDS},
o AS (SELECT *, {_OWN} FROM (SELECT *, close / lag(close) OVER w - 1 AS rn FROM quotes JOIN funds USING (security_id) WHERE close > 0 WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)) WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)),
i AS (SELECT index_id, trade_date, close AS ic, close / lag(close) OVER (PARTITION BY index_id ORDER BY trade_date) - 1 AS ri FROM index_quotes WHERE close > 0),
b AS (SELECT *, rn - ri AS gap, close / lag(close) OVER (PARTITION BY security_id ORDER BY trade_date) - 1 AS st FROM o JOIN i USING (index_id, trade_date))"""


def _track_sql(n: int) -> str:
    long, short, since = f"(w ROWS {n} PRECEDING)", f"(w ROWS {n - 1} PRECEDING)", "(w ROWS UNBOUNDED PRECEDING)"
    full = f"count(*) OVER {long} = {n + 1}"
    reason = f"CASE WHEN basis = 'unknown' THEN '{metrics.UNKNOWN_BASIS}' WHEN basis = 'total_return_index' THEN '{metrics.TOTAL_BASIS}' WHEN NOT {full} THEN '{metrics.SHORT}' WHEN max(abs(st)) OVER {short} > 0.2 THEN '{metrics.JUMPED}' END"
    return f"CASE WHEN {full} THEN close / first(close) OVER {long} - 1 END AS nav_return_{n}, CASE WHEN {full} THEN ic / first(ic) OVER {long} - 1 END AS index_return_{n}, CASE WHEN {reason} IS NULL THEN close / first(close) OVER {since} - ic / first(ic) OVER {since} END AS difference_{n}, {reason} AS reason_{n}, CASE WHEN count(gap) OVER {short} >= {min(40, n)} AND NOT j{n} THEN stddev_samp(gap) OVER {short} * sqrt(242) END AS error_{n}"


_TW = "WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)"


def _funds(spark: SparkSession, d: str) -> DataFrame:
    supplier, nation, region = (_table(spark, d, t) for t in ("supplier", "nation", "region"))
    at = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return at.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("security_id"), F.col("r_name").alias("index_id"), metrics.return_basis(F.expr(_NAMES.replace("p %", "s_suppkey %"))).alias("basis"))


def _tracked(spark: SparkSession, d: str, windows: tuple[int, ...]) -> DataFrame:
    index = panel(spark, d, "index_quotes").withColumnRenamed("close", "ic")
    return metrics.tracking(panel(spark, d, "quotes").join(_funds(spark, d), "security_id"), index, "security_id", "trade_date", "close", "ic", windows, ("index_id",), "basis")


@add("H4_tracking_stats", f"{_TRACK} SELECT security_id, trade_date, {_track_sql(20)}, {_track_sql(60)} FROM b {_TW}", " ".join(f"{c}_{n}" for n in (20, 60) for c in ("nav_return", "index_return", "difference", "error")))
def _h4(spark: SparkSession, d: str) -> DataFrame:
    return _tracked(spark, d, (20, 60))


@add("H2_tracking_difference", f"{_TRACK} SELECT security_id, trade_date, difference_60, reason_60 FROM (SELECT security_id, trade_date, {_track_sql(60)} FROM b {_TW})", "difference_60")
def _h2(spark: SparkSession, d: str) -> DataFrame:
    return _tracked(spark, d, (60,)).select("security_id", "trade_date", "difference_60", "reason_60")


@add("H3_tracking_error", f"{_TRACK} SELECT security_id, trade_date, error_20 FROM (SELECT security_id, trade_date, {_track_sql(20)} FROM b {_TW})", "error_20")
def _h3(spark: SparkSession, d: str) -> DataFrame:
    return _tracked(spark, d, (20,)).select("security_id", "trade_date", "error_20")


_NAVS = "SELECT security_id, trade_date, CASE WHEN k % 4 = 0 AND day(trade_date) <> 3 THEN close * 2 END AS adjusted, CASE WHEN k % 4 IN (0, 1) THEN close * 3 END AS source_adjusted, CASE WHEN day(trade_date) % 9 <> 0 THEN close * CASE WHEN k % 4 = 2 AND trade_date >= DATE '1998-01-01' THEN 2 ELSE 1 END END AS unit, k % 10 = 7 AS cross_border FROM (SELECT *, CAST(substr(security_id, 2) AS BIGINT) AS k FROM {0}quotes{1})"


@add("H5_tracking_input", f"""{panel_sql('quotes')}, n AS ({_NAVS.format('', '')}), j AS (SELECT security_id, coalesce(max(abs(st)) > 0.2, FALSE) AS jumps FROM (SELECT security_id, unit / lag(unit) OVER (PARTITION BY security_id ORDER BY trade_date) - 1 AS st FROM n WHERE unit IS NOT NULL) GROUP BY 1),
h AS (SELECT n.*, coalesce(jumps, FALSE) AS jumps, count(adjusted) OVER p > 0 AS ha, count(source_adjusted) OVER p > 0 AS hs FROM n LEFT JOIN j USING (security_id) WINDOW p AS (PARTITION BY security_id)),
r AS (SELECT *, CASE WHEN cross_border THEN 'cross_border_alignment_not_supported' WHEN NOT ha AND NOT hs AND jumps THEN '{metrics.JUMPED}' END AS reason FROM h)
SELECT security_id, trade_date, CASE WHEN reason IS NULL THEN CASE WHEN ha THEN adjusted WHEN hs THEN source_adjusted ELSE unit END END AS nav, CASE WHEN reason IS NULL THEN CASE WHEN ha THEN 'adjusted' WHEN hs THEN 'source_adjusted' ELSE 'unit' END END AS origin, reason FROM r""", "nav")
def _h5(spark: SparkSession, d: str) -> DataFrame:
    navs = spark.sql(_NAVS.format("{", "}"), quotes=panel(spark, d, "quotes"))
    return metrics.tracking_input(navs, "security_id", "trade_date", "adjusted", "source_adjusted", "unit", "cross_border")


# G: flows on adjusted series
_V2 = f"""{panel_sql('adjusted')}, x AS (SELECT *, adjusted_shares - lag(adjusted_shares) OVER w AS delta, (adjusted_shares - lag(adjusted_shares) OVER w) * adjusted_nav AS money, coalesce(factor, 1.0) AS u FROM adjusted WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)),
sg AS (SELECT security_id, trade_date, sign(delta) AS sg FROM x WHERE delta IS NOT NULL), si AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY trade_date) - row_number() OVER (PARTITION BY security_id, sg ORDER BY trade_date) AS island FROM sg), sr AS (SELECT *, row_number() OVER (PARTITION BY security_id, sg, island ORDER BY trade_date) AS run FROM si),
f AS (SELECT security_id, trade_date, {", ".join(f"CASE WHEN count(delta) OVER (w ROWS {n - 1} PRECEDING) = {n} THEN sum(delta) OVER (w ROWS {n - 1} PRECEDING) * u END AS share_change_{n}d, CASE WHEN lag(adjusted_shares, {n}) OVER w * u <> 0 AND count(delta) OVER (w ROWS {n - 1} PRECEDING) = {n} THEN sum(delta) OVER (w ROWS {n - 1} PRECEDING) * u / (lag(adjusted_shares, {n}) OVER w * u) END AS share_change_pct_{n}d, CASE WHEN count(money) OVER (w ROWS {n - 1} PRECEDING) = {n} THEN sum(money) OVER (w ROWS {n - 1} PRECEDING) END AS net_subscription_{n}d" for n in flow.WINDOWS)},
  CASE WHEN min(factor) OVER (w ROWS UNBOUNDED PRECEDING) <> max(factor) OVER (w ROWS UNBOUNDED PRECEDING) THEN 'adjusted' ELSE 'clean' END AS quality FROM x WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)),
v2 AS (SELECT f.*, CASE WHEN sg > 0 THEN run ELSE 0 END AS inflow_days, CASE WHEN sg < 0 THEN run ELSE 0 END AS outflow_days FROM f LEFT JOIN sr USING (security_id, trade_date))"""
_V2D = " ".join(f"{c}_{n}d" for n in flow.WINDOWS for c in ("share_change", "share_change_pct", "net_subscription"))


@add("G6_flow_v2_replay", f"{_V2} SELECT * FROM v2", _V2D)
def _g6(spark: SparkSession, d: str) -> DataFrame:
    return flow.adjusted_flows(panel(spark, d, "adjusted"))


@add("G9_flow_v2_trading_days", f"{_V2}, c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS trade_date FROM orders) SELECT * FROM v2 WHERE trade_date IN (SELECT trade_date FROM c)", _V2D)
def _g9(spark: SparkSession, d: str) -> DataFrame:
    days = panel(spark, d, "calendar")
    return flow.adjusted_flows(panel(spark, d, "adjusted")).join(days, "trade_date", "left_semi")


@add("G7_latest_flow_v2", f"{_V2} SELECT v2.* FROM v2 JOIN (SELECT security_id, max(trade_date) AS trade_date FROM v2 GROUP BY 1) l USING (security_id, trade_date) WHERE (security_id, trade_date) IN (SELECT security_id, trade_date FROM adjusted WHERE adjusted_shares IS NOT NULL)", _V2D)
def _g7(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d, "adjusted")
    facts = rows.where("adjusted_shares is not null").select("security_id", "trade_date")
    return metrics.latest(flow.adjusted_flows(rows), "security_id", "trade_date").join(facts, ["security_id", "trade_date"], "left_semi")


@add("E6_share_factor", f"{panel_sql('actions')} SELECT security_id, action_date, product(k) AS k FROM actions WHERE action_type <> 'DIVIDEND' GROUP BY 1, 2", "k")
def _e6(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d, "actions").where("action_type <> 'DIVIDEND'").groupBy("security_id", "action_date").agg(F.product("k").alias("k"))


@add("E5_distinct_issues", f"{panel_sql('actions')} SELECT DISTINCT 'bad_ratio' AS rule, concat_ws(' ', action_type, CAST(k AS VARCHAR)) AS details FROM actions WHERE k IS NULL OR k <= 0 OR k > 2")
def _e5(spark: SparkSession, d: str) -> DataFrame:
    bad = panel(spark, d, "actions").where("k is null or k <= 0 or k > 2")
    return bad.select(F.lit("bad_ratio").alias("rule"), F.concat_ws(" ", "action_type", F.col("k").cast("string")).alias("details")).dropDuplicates(["rule", "details"])


# I: peers
_GROUP = "CASE WHEN index_id <> '' THEN 'index:' || index_id WHEN index_name <> '' THEN 'benchmark:' || index_name WHEN tag <> '' THEN 'tag:' || tag END"
_KIND = "CASE WHEN index_id <> '' THEN 'tracking_index' WHEN index_name <> '' THEN 'benchmark_name' WHEN tag <> '' THEN 'tag' END"
_I4 = f"""{panel_sql('fund_master', 'fund_map', 'fund_tag', 'shares', 'quotes')}, qd AS (SELECT CAST(substr(security_id, 2) AS BIGINT) AS fund_id, max(trade_date) AS quote_date FROM quotes WHERE trade_date <= {_DAY} GROUP BY 1),
sh AS (SELECT security_id AS fund_id, trade_date, shares * nav AS aum, shares - lag(shares, 20) OVER (PARTITION BY security_id ORDER BY trade_date) AS flow FROM shares), sl AS (SELECT * FROM sh WHERE trade_date <= {_DAY} QUALIFY row_number() OVER (PARTITION BY fund_id ORDER BY trade_date DESC) = 1),
tg AS (SELECT fund_id, min(tag) AS tag FROM fund_tag WHERE tag_type = 'industry' AND (valid_from IS NULL OR valid_from <= {_DAY}) AND (valid_to IS NULL OR valid_to > {_DAY}) GROUP BY 1),
mp AS (SELECT fund_id, index_id, index_name FROM fund_map WHERE (valid_from IS NULL OR valid_from <= {_DAY}) AND (valid_to IS NULL OR valid_to > {_DAY}) QUALIFY row_number() OVER (PARTITION BY fund_id ORDER BY valid_from DESC NULLS LAST, index_id) = 1),
cand AS (SELECT fund_id, CASE WHEN observed <= {_DAY} THEN fee END AS fee, quote_date, aum, flow, tag, index_id, index_name FROM fund_master JOIN qd USING (fund_id) LEFT JOIN sl USING (fund_id) LEFT JOIN tg USING (fund_id) LEFT JOIN mp USING (fund_id))"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    shares = panel(spark, d, "shares").withColumnRenamed("security_id", "fund_id")
    flows = shares.withColumn("share_change_20d", F.col("shares") - F.lag("shares", 20).over(s.over("fund_id")))
    quotes = panel(spark, d, "quotes").select(F.expr("CAST(substr(security_id, 2) AS BIGINT)").alias("fund_id"), "trade_date")
    return records.candidates(panel(spark, d, "fund_master"), quotes, shares.withColumn("aum", F.col("shares") * F.col("nav")), flows, panel(spark, d, "fund_tag"), panel(spark, d, "fund_map"), "fund_id", ASOF)


@add("I4_candidates", f"{_I4} SELECT * FROM cand", "fee aum flow")
def _i4(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d)


_CATALOG = "SELECT DISTINCT 'Name ' || CAST(n_nationkey AS VARCHAR(9)) AS index_name, 'N' || CAST(n_nationkey AS VARCHAR(9)) AS index_id FROM {0}nation{1} WHERE n_nationkey % 2 = 0"
_I2 = f"{_I4}, cat AS ({_CATALOG.format('', '')}), named AS (SELECT cand.* REPLACE (coalesce(CASE WHEN cand.index_id <> '' THEN cand.index_id END, cat.index_id) AS index_id) FROM cand LEFT JOIN cat ON cand.index_name = cat.index_name)"


def _named(spark: SparkSession, d: str) -> DataFrame:
    catalog = spark.sql(_CATALOG.format("{", "}"), nation=_table(spark, d, "nation"))
    return groups.with_index_of_name(_candidates(spark, d), catalog, "index_id", "index_name")


@add("I2_index_of_name", f"{_I2} SELECT fund_id, index_id, index_name FROM named")
def _i2(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("fund_id", "index_id", "index_name")


_I1 = f"{_I2}, pg AS (SELECT *, {_GROUP} AS peer_group, {_KIND} AS kind, CASE WHEN index_id <> '' THEN index_id WHEN index_name <> '' THEN index_name WHEN tag <> '' THEN tag END AS label FROM named)"


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    g = groups.peer_group(F.col("index_id"), F.col("index_name"), F.col("tag"))
    return _named(spark, d).withColumn("g", g).select("*", F.col("g.id").alias("peer_group"), F.col("g.kind").alias("kind"), F.col("g.label").alias("label")).drop("g")


@add("I1_peer_groups", f"{_I1} SELECT fund_id, peer_group, kind, label, count(*) OVER (PARTITION BY peer_group) AS members FROM pg WHERE peer_group IS NOT NULL")
def _i1(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _grouped(spark, d).where("peer_group is not null")
    return rows.select("fund_id", "peer_group", "kind", "label", F.count("*").over(Window.partitionBy("peer_group")).alias("members"))


_I5 = f"""pr AS (SELECT security_id, trade_date, CASE WHEN close IS NOT NULL THEN turnover_amount / n_orders / close - 1 END AS premium FROM quotes WHERE trade_date <= {_DAY}),
t20 AS (SELECT security_id, CASE WHEN n = 20 THEN a END AS turnover FROM (SELECT security_id, trade_date, count(turnover_amount) OVER l AS n, avg(turnover_amount) OVER l AS a FROM quotes WHERE trade_date <= {_DAY} WINDOW l AS (PARTITION BY security_id ORDER BY trade_date ROWS 19 PRECEDING)) QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY trade_date DESC) = 1),
p20 AS (SELECT security_id, stddev_samp(premium) OVER (PARTITION BY security_id ORDER BY trade_date ROWS 19 PRECEDING) AS premium_stability FROM pr WHERE premium IS NOT NULL QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY trade_date DESC) = 1),
e60 AS (SELECT security_id, error_60 AS tracking_error FROM (SELECT security_id, trade_date, {_track_sql(60)} FROM b WHERE basis = 'price_index' AND trade_date <= {_DAY} {_TW}) QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY trade_date DESC) = 1),
facts AS (SELECT security_id, turnover, premium_stability, tracking_error FROM t20 FULL JOIN p20 USING (security_id) FULL JOIN e60 USING (security_id))"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    quotes = panel(spark, d, "quotes").join(_funds(spark, d), "security_id").withColumn("premium", F.when(F.col("close").isNotNull(), F.col("turnover_amount") / F.col("n_orders") / F.col("close") - 1))
    return records.security_facts(quotes, panel(spark, d, "index_quotes").withColumnRenamed("close", "ic"), "security_id", ASOF)


@add("I5_security_facts", f"{_TRACK}, {_I5} SELECT * FROM facts", "turnover premium_stability tracking_error")
def _i5(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d)


def _rank_sql(c: str) -> str:
    order = "ASC" if groups.DIRECTIONS[c] else "DESC"
    return f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER (PARTITION BY peer_group) >= 3 THEN (rank() OVER (PARTITION BY peer_group, {c} IS NULL ORDER BY {c} {order}) - 1) / (count({c}) OVER (PARTITION BY peer_group) - 1) END AS {c}_rank_pct"


_I7 = f"{_TRACK}, {_I1.replace(panel_sql('fund_master', 'fund_map', 'fund_tag', 'shares', 'quotes'), panel_sql('fund_master', 'fund_map', 'fund_tag', 'shares').removeprefix('WITH '))}, {_I5}, fx AS (SELECT pg.fund_id, peer_group, aum, flow, fee, turnover, premium_stability, tracking_error FROM pg LEFT JOIN facts ON 'S' || CAST(pg.fund_id AS VARCHAR(9)) = facts.security_id WHERE peer_group IS NOT NULL), pm AS (SELECT fund_id, peer_group, count(*) OVER (PARTITION BY peer_group) AS peer_count, {', '.join(map(_rank_sql, groups.DIRECTIONS))} FROM fx), mart AS (SELECT * FROM pm WHERE peer_count >= 3)"


def _marts(spark: SparkSession, d: str) -> DataFrame:
    facts = _facts(spark, d).withColumn("fund_id", F.expr("CAST(substr(security_id, 2) AS BIGINT)")).drop("security_id")
    rows = _grouped(spark, d).where("peer_group is not null").join(facts, "fund_id", "left")
    return groups.peer_marts(rows, "peer_group", "fund_id")


@add("I7_peer_mart", f"{_I7} SELECT * FROM mart", " ".join(f"{c}_rank_pct" for c in groups.DIRECTIONS))
def _i7(spark: SparkSession, d: str) -> DataFrame:
    return _marts(spark, d)


_SNAPS = "SELECT fund_id, index_id AS peer_group, fund_id % 7 + 1 AS peer_count, coalesce(valid_from, DATE '1997-01-01') AS asof_date FROM {0}fund_index{1} WHERE fund_id % 3 <> 0"
_CURRENT = "SELECT fund_id, name AS peer_group, CAST(9 AS BIGINT) AS peer_count FROM {0}fund_master{1} WHERE fund_id % 5 <> 0"


def _i8_rows(spark: SparkSession, d: str) -> DataFrame:
    snaps = spark.sql(_SNAPS.format("{", "}"), fund_index=panel(spark, d, "fund_index"))
    current = spark.sql(_CURRENT.format("{", "}"), fund_master=panel(spark, d, "fund_master"))
    return records.peer_group_asof(panel(spark, d, "fund_master").select("fund_id"), snaps, current, "fund_id", "1997-06-30", fall_back=True)


_I8 = f"{panel_sql('fund_index', 'fund_master')}, sn AS (SELECT * FROM ({_SNAPS.format('', '')}) WHERE asof_date <= DATE '1997-06-30' QUALIFY row_number() OVER (PARTITION BY fund_id ORDER BY asof_date DESC) = 1), cu AS ({_CURRENT.format('', '')}), i8 AS (SELECT m.fund_id, CASE WHEN sn.fund_id IS NOT NULL THEN sn.peer_group ELSE cu.peer_group END AS peer_group, CASE WHEN sn.fund_id IS NOT NULL THEN sn.peer_count ELSE cu.peer_count END AS peer_count, CASE WHEN sn.fund_id IS NOT NULL THEN 'asof_snapshot' WHEN cu.fund_id IS NOT NULL THEN 'current_fallback' ELSE 'missing' END AS peer_group_pit, sn.asof_date FROM fund_master m LEFT JOIN sn USING (fund_id) LEFT JOIN cu ON m.fund_id = cu.fund_id)"


@add("I8_group_snapshot", f"{_I8} SELECT * FROM i8")
def _i8(spark: SparkSession, d: str) -> DataFrame:
    return _i8_rows(spark, d)


@add("I9_tracking_quality", f"{_I7}, {_I8.removeprefix(panel_sql('fund_index', 'fund_master') + ', ')} SELECT i8.fund_id, i8.peer_group, i8.peer_count, tracking_error_rank_pct FROM i8 LEFT JOIN mart USING (fund_id)", "tracking_error_rank_pct")
def _i9(spark: SparkSession, d: str) -> DataFrame:
    return records.tracking_quality(_i8_rows(spark, d), _marts(spark, d), "fund_id")


# J: holdings
_H = f"rd AS (SELECT etf_id, max(report_date) AS report_date FROM holdings WHERE report_date <= {_DAY} AND (disclosed IS NULL OR disclosed <= {_DAY}) GROUP BY 1), h AS (SELECT holdings.* FROM holdings JOIN rd USING (etf_id, report_date))"


@add("J4_concentration", f"{panel_sql('holdings')}, {_H}, r AS (SELECT *, row_number() OVER (PARTITION BY etf_id ORDER BY weight_pct DESC NULLS LAST, stock_id) AS rn FROM (SELECT etf_id, stock_id, CASE WHEN etf_id % 7 = 3 THEN NULL WHEN etf_id % 5 = 1 THEN weight_pct / 100 WHEN etf_id % 11 = 2 THEN weight_pct * 1.2 ELSE weight_pct END AS weight_pct FROM h)), c AS (SELECT etf_id, max(weight_pct) AS mx, min(weight_pct) AS mn, sum(weight_pct) AS al, sum(weight_pct) FILTER (WHERE rn <= 10) AS tp, CASE WHEN max(weight_pct) > 1.05 THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END AS sc FROM r GROUP BY 1), q AS (SELECT *, CASE WHEN mx IS NULL THEN 'holding_weights_unavailable' WHEN mn < 0 OR al > CASE WHEN sc = 100 THEN 105 ELSE 1.05 END THEN 'holding_weight_conflict' END AS reason FROM c) SELECT etf_id, CASE WHEN reason IS NULL THEN tp / sc END AS concentration, reason FROM q", "concentration")
def _j4(spark: SparkSession, d: str) -> DataFrame:
    k, w = F.col("etf_id"), F.col("weight_pct")
    rows = groups.latest_report(panel(spark, d, "holdings"), "etf_id", ASOF)
    return groups.concentration(rows.withColumn("weight_pct", F.when(k % 7 == 3, None).when(k % 5 == 1, w / 100).when(k % 11 == 2, w * 1.2).otherwise(w)), "etf_id")


_PAIRS = "SELECT CAST(s_suppkey AS BIGINT) AS a, CAST(s_suppkey + k AS BIGINT) AS b FROM {0}supplier{1} CROSS JOIN (SELECT unnest([1, 2, 3, 7]) AS k)"
_J5 = f"{panel_sql('holdings')}, {_H}, pr AS ({_PAIRS.format('', '')}), w AS (SELECT etf_id AS fund, stock_id, coalesce(max(CASE WHEN stock_id % 9 <> 0 THEN weight_pct END), 0) AS weight FROM h GROUP BY 1, 2), hd AS (SELECT *, row_number() OVER (PARTITION BY fund ORDER BY weight DESC, stock_id) <= 10 AS top FROM w), sz AS (SELECT fund, count(*) AS n FROM hd GROUP BY 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    return _table(spark, d, "supplier").select(k.alias("a"), F.explode(F.array(*(k + n for n in (1, 2, 3, 7)))).alias("b"))


@add("J5_overlap", f"{_J5}, o AS (SELECT a, b, count(*) AS common, sum(least(x.weight, y.weight)) AS weighted, count(*) FILTER (WHERE x.top AND y.top) AS top, string_agg(CAST(x.stock_id AS VARCHAR), ',' ORDER BY x.stock_id) AS stocks FROM pr JOIN hd x ON x.fund = a JOIN hd y ON y.fund = b AND x.stock_id = y.stock_id GROUP BY 1, 2) SELECT pr.a, pr.b, CASE WHEN x.n IS NOT NULL AND y.n IS NOT NULL THEN coalesce(common, 0) / least(x.n, y.n) END AS overlap, CASE WHEN x.n IS NOT NULL AND y.n IS NOT NULL THEN coalesce(weighted, 0) END AS weighted, CASE WHEN x.n IS NOT NULL AND y.n IS NOT NULL THEN coalesce(top, 0) / 10 END AS top10, coalesce(stocks, '') AS stocks FROM pr LEFT JOIN o USING (a, b) LEFT JOIN sz x ON x.fund = pr.a LEFT JOIN sz y ON y.fund = pr.b", "overlap weighted top10")
def _j5(spark: SparkSession, d: str) -> DataFrame:
    rows = groups.latest_report(panel(spark, d, "holdings"), "etf_id", ASOF).withColumn("weight_pct", F.when(F.col("stock_id") % 9 != 0, F.col("weight_pct")))
    return groups.overlap(rows, _pairs(spark, d), "etf_id")


@add("J6_industry_overlap", f"{panel_sql('holdings', 'industry')}, {_H}, pr AS ({_PAIRS.format('', '')}), w AS (SELECT etf_id AS fund, coalesce(industry_name, 'unclassified') AS industry, sum(weight_pct) AS weight FROM h LEFT JOIN industry USING (stock_id) GROUP BY 1, 2), o AS (SELECT a, b, sum(least(x.weight, y.weight)) AS common FROM pr JOIN w x ON x.fund = a JOIN w y ON y.fund = b AND x.industry = y.industry GROUP BY 1, 2) SELECT pr.a, pr.b, CASE WHEN pr.a IN (SELECT fund FROM w) AND pr.b IN (SELECT fund FROM w) THEN coalesce(common, 0) END AS industry_overlap FROM pr LEFT JOIN o USING (a, b)", "industry_overlap")
def _j6(spark: SparkSession, d: str) -> DataFrame:
    weights = groups.industry_weights(groups.latest_report(panel(spark, d, "holdings"), "etf_id", ASOF), panel(spark, d, "industry"), "etf_id")
    return groups.industry_overlap(weights, _pairs(spark, d), "etf_id")


@add("J3_holdings_fallback", f"{panel_sql('holdings', 'constituents', 'fund_index')}, rd AS (SELECT etf_id, max(report_date) AS report_date FROM holdings WHERE etf_id % 4 <> 0 AND report_date <= {_DAY} AND (disclosed IS NULL OR disclosed <= {_DAY}) GROUP BY 1), h AS (SELECT holdings.* FROM holdings JOIN rd USING (etf_id, report_date)), mp AS (SELECT fund_id AS etf_id, index_id FROM fund_index WHERE (valid_from IS NULL OR valid_from <= {_DAY}) AND (valid_to IS NULL OR valid_to > {_DAY}) QUALIFY row_number() OVER (PARTITION BY fund_id ORDER BY valid_from DESC NULLS LAST, index_id) = 1), c AS (SELECT * FROM constituents WHERE effective_date <= {_DAY} QUALIFY effective_date = max(effective_date) OVER (PARTITION BY index_id)) SELECT etf_id, stock_id, weight_pct, report_date AS dated, 'disclosure' AS origin FROM h UNION ALL SELECT etf_id, stock_id, weight_pct, effective_date, 'constituents' FROM mp JOIN c USING (index_id) WHERE etf_id NOT IN (SELECT etf_id FROM h)", "weight_pct", ready=True)
def _j3(spark: SparkSession, d: str) -> DataFrame:
    mapping = pit.valid_rows(panel(spark, d, "fund_index"), "fund_id", ASOF, tie="index_id").select(F.col("fund_id").alias("etf_id"), "index_id")
    holdings = by_fund(spark, d, held=True)["holdings"].where("etf_id % 4 <> 0")
    out = groups.holdings_or_constituents(holdings, rounded(panel(spark, d, "constituents")), mapping, "etf_id", ASOF, dealt=True)
    # a constituent is rounded once, not for each of its funds
    return out.withColumn("weight_pct", F.when(F.col("origin") == "constituents", F.col("weight_pct")).otherwise(F.round("weight_pct", 6) + F.lit(0.0)))


# L: market layer
_VALUES = "SELECT p AS index_id, trade_date, CASE WHEN day(trade_date) % 9 <> 4 THEN CAST(cents AS DOUBLE) / CAST(n AS DOUBLE) END AS pe FROM (SELECT l_suppkey % 40 AS p, last_day(CAST(l_shipdate AS DATE)) AS trade_date, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, count(*) AS n FROM {0}lineitem{1} GROUP BY 1, 2)"


@add("L7_valuation_percentile", f"WITH x AS ({_VALUES.format('', '')}), y AS (SELECT *, list(pe) OVER (PARTITION BY index_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS a, list(pe) OVER (PARTITION BY index_id ORDER BY trade_date RANGE BETWEEN INTERVAL 800 DAY PRECEDING AND CURRENT ROW) AS t FROM x WHERE pe IS NOT NULL) SELECT index_id, trade_date, pe, {', '.join(f'CASE WHEN len({a}) >= 24 THEN (len([v FOR v IN {a} IF v < pe]) + len([v FOR v IN {a} IF v = pe]) / 2) / len({a}) END AS percentile_{n}' for a, n in (('a', 'all'), ('t', '10y')))}, len(a) AS n_all, len(t) AS n_10y FROM y", "pe percentile_all percentile_10y")
def _l7(spark: SparkSession, d: str) -> DataFrame:
    return market.valuation_percentile(spark.sql(_VALUES.format("{", "}"), lineitem=_table(spark, d, "lineitem")), "index_id", "trade_date", "pe", years=800, least=24)


_INDEXES = "SELECT 'N' || CAST(n_nationkey AS VARCHAR(9)) AS index_id, 'R' || CAST(n_regionkey AS VARCHAR(9)) AS basket FROM {0}nation{1} WHERE n_nationkey % 3 <> 1"
_L10 = f"{panel_sql('fund_index', 'shares')}, ix AS ({_INDEXES.format('', '')}), mb AS (SELECT DISTINCT fund_id, basket FROM fund_index JOIN ix USING (index_id) WHERE (valid_from IS NULL OR valid_from <= {_DAY}) AND (valid_to IS NULL OR valid_to > {_DAY}))"


def _members(spark: SparkSession, d: str) -> DataFrame:
    return market.basket_members(panel(spark, d, "fund_index"), spark.sql(_INDEXES.format("{", "}"), nation=_table(spark, d, "nation")), "fund_id", ASOF)


@add("L10_basket_sizes", f"{_L10}, pm AS (SELECT CAST(s_suppkey AS BIGINT) AS fund_id, CASE WHEN s_suppkey % 6 <> 0 THEN CAST(s_acctbal AS DOUBLE) / 1000 END AS premium FROM supplier) SELECT basket, count(DISTINCT fund_id) AS members, median(premium) AS premium_median, count(premium) AS premiums FROM mb LEFT JOIN pm USING (fund_id) GROUP BY 1", "premium_median")
def _l10(spark: SparkSession, d: str) -> DataFrame:
    premium = _table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("fund_id"), F.when(F.col("s_suppkey") % 6 != 0, F.col("s_acctbal").cast("double") / 1000).alias("premium"))
    return market.basket_sizes(_members(spark, d), premium, "fund_id")


_DATED = "QUALIFY row_number() OVER (PARTITION BY fund_id ORDER BY trade_date DESC) = 1"


@add("L11_basket_detail", f"{_L10.replace(panel_sql('fund_index', 'shares'), panel_sql('fund_index', 'shares', 'quotes'))}, a AS (SELECT security_id AS fund_id, trade_date AS share_date, shares * nav AS aum FROM (SELECT *, security_id AS fund_id FROM shares) {_DATED}), c AS (SELECT fund_id, trade_date AS quote_date, turnover_amount FROM (SELECT *, CAST(substr(security_id, 2) AS BIGINT) AS fund_id FROM quotes WHERE n_orders > 1) {_DATED}) SELECT mb.*, share_date, aum, quote_date, turnover_amount, row_number() OVER (PARTITION BY basket ORDER BY aum DESC NULLS LAST, fund_id) AS place FROM mb LEFT JOIN a USING (fund_id) LEFT JOIN c USING (fund_id)", "aum turnover_amount")
def _l11(spark: SparkSession, d: str) -> DataFrame:
    shares = panel(spark, d, "shares").select(F.col("security_id").alias("fund_id"), "trade_date", (F.col("shares") * F.col("nav")).alias("aum"))
    quotes = panel(spark, d, "quotes").where("n_orders > 1").select(F.expr("CAST(substr(security_id, 2) AS BIGINT)").alias("fund_id"), "trade_date", "turnover_amount")
    return market.basket_detail(_members(spark, d), {"share": shares, "quote": quotes}, "fund_id", "trade_date")


_NET = "SELECT security_id AS fund_id, trade_date, CASE WHEN day(trade_date) % 5 <> 0 THEN shares - lag(shares, 5) OVER w END AS net_5d, shares - lag(shares, 20) OVER w AS net_20d FROM {0}shares{1} WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)"


@add("L12_basket_sums", f"{_L10}, f AS ({_NET.format('', '')}) SELECT basket, trade_date, sum(net_5d) AS net_5d, sum(net_20d) AS net_20d, count(net_5d) AS net_5d_known, count(net_20d) AS net_20d_known FROM mb JOIN f USING (fund_id) GROUP BY 1, 2", "net_5d net_20d")
def _l12(spark: SparkSession, d: str) -> DataFrame:
    return market.basket_sums(spark.sql(_NET.format("{", "}"), shares=panel(spark, d, "shares")), _members(spark, d), "fund_id", "trade_date", ["net_5d", "net_20d"])


@add("L13_latest_positions", f"{panel_sql('m_index')} SELECT market_id, trade_date, close FROM m_index WHERE trade_date <= {_DAY} AND close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY trade_date DESC) = 1", "close")
def _l13(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latest(panel(spark, d, "m_index").where("close is not null"), "market_id", "trade_date", ASOF)


# D: calendar
@add("D4_closed_days", f"{panel_sql('calendar')}, u AS (SELECT DISTINCT date_trunc('hour', ts) - INTERVAL 9500 DAY AS asked FROM events), k AS (SELECT asked, max(CASE WHEN trade_date <= CAST(asked AS DATE) THEN trade_date END) AS l, max(CASE WHEN trade_date < CAST(asked AS DATE) THEN trade_date END) AS p FROM u, calendar GROUP BY 1) SELECT CAST(asked AS TIMESTAMP) AS asked, CASE WHEN l = CAST(asked AS DATE) AND hour(asked) < 17 THEN p ELSE l END AS closed_day FROM k")
def _d4(spark: SparkSession, d: str) -> DataFrame:
    times = _table(spark, d, "events").select((F.date_trunc("hour", "ts") - F.expr("INTERVAL 9500 DAYS")).cast("timestamp_ntz").alias("asked"))
    return calendar.closed_days(times, panel(spark, d, "calendar"), "asked")


# O: audit
_ROWS = "SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'flow_v9' WHEN 3 THEN 'flow_v1' ELSE 'flow_v2' END AS version, CASE WHEN o_custkey % 8 = 0 THEN NULL ELSE o_custkey % 8 > 1 END AS is_estimated FROM {0}orders{1}"
_VIOLATION = "SELECT '{rule}' AS rule, 'ERROR' AS severity, '{set}' AS dataset, {key} AS key"


@add("O3_estimates_without_flag", f"WITH x AS ({_ROWS.format('', '')}) {_VIOLATION.format(rule='estimate_without_flag_or_version', set='flow_daily', key='CAST(o_orderkey AS VARCHAR)')} FROM x WHERE coalesce(version, '') = '' OR NOT coalesce(is_estimated, FALSE)")
def _o3(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_ROWS.format("{", "}"), orders=_table(spark, d, "orders"))
    return audit.without_version(rows, "estimate_without_flag_or_version", "flow_daily", "version", F.col("o_orderkey"), "is_estimated")


@add("O4_unregistered_versions", f"WITH x AS ({_ROWS.format('', '')}) SELECT DISTINCT 'unregistered_version' AS rule, 'ERROR' AS severity, 'flow_daily' AS dataset, version AS key FROM x WHERE version NOT IN ({', '.join(f'{v!r}' for v in records.REGISTERED)})")
def _o4(spark: SparkSession, d: str) -> DataFrame:
    return audit.unregistered(spark.sql(_ROWS.format("{", "}"), orders=_table(spark, d, "orders")), "flow_daily", "version", list(records.REGISTERED))


@add("O11_adjusted_versions", f"WITH x AS ({_ROWS.format('', '')}) {_VIOLATION.format(rule='adjusted_without_version', set='adjusted_daily', key='CAST(o_orderkey AS VARCHAR)')} FROM x WHERE coalesce(version, '') = '' UNION ALL SELECT DISTINCT 'unregistered_version', 'ERROR', 'adjusted_daily', version FROM x WHERE version NOT IN ({', '.join(f'{v!r}' for v in records.REGISTERED)})")
def _o11(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_ROWS.format("{", "}"), orders=_table(spark, d, "orders"))
    return audit.without_version(rows, "adjusted_without_version", "adjusted_daily", "version", F.col("o_orderkey")).unionByName(audit.unregistered(rows, "adjusted_daily", "version", list(records.REGISTERED)))


@add("O7_holdings_without_date", f"{panel_sql('holdings')} {_VIOLATION.format(rule='without_report_date', set='holding_disclosure', key='CAST(stock_id AS VARCHAR)')} FROM (SELECT stock_id, CASE WHEN (stock_id + etf_id) % 50 <> 0 THEN report_date END AS report_date FROM holdings) WHERE report_date IS NULL")
def _o7(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d, "holdings").withColumn("report_date", F.when((F.col("stock_id") + F.col("etf_id")) % 50 != 0, F.col("report_date")))
    return audit.without_date(rows, "holding_disclosure", "report_date", F.col("stock_id"))


_VFLOW = "SELECT security_id, trade_date, share_change, unnest(CASE WHEN security_id % 3 = 0 THEN ['flow_v1', 'flow_v2'] ELSE ['flow_v1'] END) AS version FROM (SELECT security_id, trade_date, shares - lag(shares) OVER (PARTITION BY security_id ORDER BY trade_date) AS share_change FROM shares)"


@add("O10_flows_across_splits", f"{panel_sql('shares', 'actions')}, f AS ({_VFLOW}) SELECT f.security_id, f.trade_date, f.version, a.action_date FROM f JOIN actions a ON a.security_id = f.security_id AND a.action_date <= f.trade_date AND a.action_date > f.trade_date - INTERVAL 60 DAY AND share_factor <> 1 WHERE f.version <> 'flow_v2' AND share_change IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f v WHERE v.security_id = f.security_id AND v.trade_date = f.trade_date AND v.version = 'flow_v2')")
def _o10(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d, "shares").withColumn("share_change", F.col("shares") - F.lag("shares").over(s.over()))
    versions = F.when(F.col("security_id") % 3 == 0, F.array(F.lit("flow_v1"), F.lit("flow_v2"))).otherwise(F.array(F.lit("flow_v1")))
    flows = rows.select("security_id", "trade_date", "share_change", F.explode(versions).alias("version"))
    return audit.flows_across_splits(flows, panel(spark, d, "actions"), "security_id", "trade_date")


_FACTOR = "SELECT security_id, trade_date, CASE WHEN trade_date >= DATE '1998-06-20' AND security_id % 2 = 0 THEN 2.0 ELSE 1.0 END AS share_factor FROM {0}shares{1}"


@add("O13_dividend_moved_shares", f"{panel_sql('shares', 'actions')}, f AS ({_FACTOR.format('', '')}), g AS (SELECT *, lag(share_factor) OVER (PARTITION BY security_id ORDER BY trade_date) AS before FROM f), a AS (SELECT security_id, action_date FROM actions GROUP BY 1, 2 HAVING bool_and(action_type = 'DIVIDEND')) SELECT g.security_id, g.trade_date, CAST(before AS DOUBLE) AS before, CAST(share_factor AS DOUBLE) AS share_factor FROM g JOIN a ON a.security_id = g.security_id AND a.action_date = g.trade_date WHERE share_factor <> before", "before share_factor")
def _o13(spark: SparkSession, d: str) -> DataFrame:
    factors = spark.sql(_FACTOR.format("{", "}"), shares=panel(spark, d, "shares")).withColumn("share_factor", F.col("share_factor").cast("double"))
    return audit.dividend_moved_shares(factors, panel(spark, d, "actions"), "security_id", "trade_date")


# K: records
@add("K3_production_rows", f"WITH x AS ({_ROWS.format('', '')}) SELECT o_orderkey FROM x WHERE version = 'flow_v2'")
def _k3(spark: SparkSession, d: str) -> DataFrame:
    return records.production_rows(spark.sql(_ROWS.format("{", "}"), orders=_table(spark, d, "orders")), "flow").select("o_orderkey")


_K12 = f"""{panel_sql('quotes', 'shares', 'fund_master', 'fund_map')}, q AS (SELECT CAST(substr(security_id, 2) AS BIGINT) AS fund_id, trade_date AS quote_date, turnover_amount, ret AS return_20d FROM (SELECT *, close / lag(close, 20) OVER (PARTITION BY security_id ORDER BY trade_date) - 1 AS ret FROM quotes) WHERE trade_date <= {_DAY} QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY trade_date DESC) = 1),
sh AS (SELECT security_id AS fund_id, trade_date AS share_date, shares * nav AS estimated_aum, ch AS share_change_20d FROM (SELECT *, shares - lag(shares, 20) OVER (PARTITION BY security_id ORDER BY trade_date) AS ch FROM shares) WHERE trade_date <= {_DAY} QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY trade_date DESC) = 1),
m AS (SELECT fund_id, observed AS profile_date, CASE WHEN observed <= {_DAY} THEN fee END AS reported_aum FROM fund_master),
ix AS (SELECT fund_id, valid_from AS index_date, nullif(index_id, '') AS tracking_index FROM fund_map WHERE (valid_from IS NULL OR valid_from <= {_DAY}) AND (valid_to IS NULL OR valid_to > {_DAY}) QUALIFY row_number() OVER (PARTITION BY fund_id ORDER BY valid_from DESC NULLS LAST, index_id) = 1),
j AS (SELECT * FROM q LEFT JOIN sh USING (fund_id) LEFT JOIN m USING (fund_id) LEFT JOIN ix USING (fund_id)),
r AS (SELECT *, [v FOR v IN [CASE WHEN return_20d IS NULL THEN 'return_20d=metric_unavailable' END, CASE WHEN share_change_20d IS NULL THEN 'share_change_20d=flow_unavailable' END, CASE WHEN reported_aum IS NULL THEN 'reported_aum=reported_aum_unavailable' END, CASE WHEN tracking_index IS NULL THEN 'tracking_index=tracking_index_unavailable' END] IF v IS NOT NULL] AS rs FROM j)"""


@add("K12_core_record", f"{_K12} SELECT fund_id, quote_date, turnover_amount, return_20d, share_date, estimated_aum, share_change_20d, reported_aum, tracking_index, array_to_string(rs, ',') AS reasons, concat_ws(',', 'quote=' || CAST(quote_date AS VARCHAR), 'share=' || CAST(share_date AS VARCHAR), 'profile=' || CAST(profile_date AS VARCHAR), 'index=' || CAST(index_date AS VARCHAR)) AS dates, CASE WHEN len(rs) = 0 THEN 'PASS' ELSE 'WARN' END AS status FROM r", "turnover_amount return_20d estimated_aum share_change_20d reported_aum")
def _k12(spark: SparkSession, d: str) -> DataFrame:
    quotes = panel(spark, d, "quotes").withColumn("return_20d", F.col("close") / F.lag("close", 20).over(s.over()) - 1).withColumn("fund_id", F.expr("CAST(substr(security_id, 2) AS BIGINT)"))
    quotes = pit.asof_rows(quotes, "fund_id", "trade_date", ASOF).select("fund_id", F.col("trade_date").alias("quote_date"), "turnover_amount", "return_20d")
    shares = panel(spark, d, "shares").withColumnRenamed("security_id", "fund_id")
    shares = shares.withColumn("share_change_20d", F.col("shares") - F.lag("shares", 20).over(s.over("fund_id")))
    blocks = {
        "share": pit.asof_rows(shares, "fund_id", "trade_date", ASOF).select("fund_id", F.col("trade_date").alias("share_date"), (F.col("shares") * F.col("nav")).alias("estimated_aum"), "share_change_20d"),
        "profile": panel(spark, d, "fund_master").select("fund_id", F.col("observed").alias("profile_date"), pit.observed(F.col("fee"), F.col("observed"), ASOF).alias("reported_aum")),
        "index": pit.valid_rows(panel(spark, d, "fund_map"), "fund_id", ASOF, tie="index_id").select("fund_id", F.col("valid_from").alias("index_date"), F.nullif("index_id", F.lit("")).alias("tracking_index")),
    }
    why = {"return_20d": "metric_unavailable", "share_change_20d": "flow_unavailable", "reported_aum": "reported_aum_unavailable", "tracking_index": "tracking_index_unavailable"}
    out = records.core_record(quotes, blocks, "fund_id", {c: F.lit(r) for c, r in why.items()})
    told = lambda m: F.array_join(F.array_compact(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return out.select("fund_id", "quote_date", "turnover_amount", "return_20d", "share_date", "estimated_aum", "share_change_20d", "reported_aum", "tracking_index", told("reasons").alias("reasons"), told("dates").alias("dates"), "status")
