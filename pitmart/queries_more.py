"""Further queries by inventory ID: point-in-time reads, calendar, checks, merges, market, states, peers, holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.operators import calendar, checks, groups, market, merge, pit, pulse
from pitmart.operators import series as s
from pitmart.panels import panel, panel_sql
from pitmart.queries import add
from pitmart.queries_pulse import volume_sql

ASOF = "1999-06-30"
_LAST = "QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY {d} DESC) = 1"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# K: point-in-time reads
@add("K1_asof_rows", f"{panel_sql('quotes_wide')} SELECT * FROM quotes_wide WHERE trade_date <= DATE '{ASOF}' {_LAST.format(k='security_id', d='trade_date')}", "turnover_amount close")
def _k1(spark: SparkSession, d: str) -> DataFrame:
    return pit.asof_rows(panel(spark, d, "quotes_wide"), "security_id", "trade_date", ASOF)


_VALID = f"(valid_from IS NULL OR valid_from <= DATE '{ASOF}') AND (valid_to IS NULL OR valid_to > DATE '{ASOF}') QUALIFY row_number() OVER (PARTITION BY fund_id ORDER BY valid_from DESC NULLS LAST, index_id) = 1"


@add("K2_valid_rows", f"{panel_sql('fund_index')} SELECT * FROM fund_index WHERE {_VALID}")
def _k2(spark: SparkSession, d: str) -> DataFrame:
    return pit.valid_rows(panel(spark, d, "fund_index"), "fund_id", ASOF, tie="index_id")


@add("K4_observed_fee", f"{panel_sql('fund_master')} SELECT fund_id, CASE WHEN observed <= DATE '1998-01-31' THEN fee END AS fee FROM fund_master", "fee")
def _k4(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d, "fund_master").select("fund_id", pit.observed(F.col("fee"), F.col("observed"), "1998-01-31").alias("fee"))


@add("K5_mapping_label", f"{panel_sql('fund_master', 'fund_index')}, v AS (SELECT * FROM fund_index WHERE {_VALID}) SELECT fund_id, CASE WHEN fund_id IN (SELECT fund_id FROM v) THEN 'mapped_asof' ELSE 'missing_asof' END AS label FROM fund_master")
def _k5(spark: SparkSession, d: str) -> DataFrame:
    mapped = pit.valid_rows(panel(spark, d, "fund_index"), "fund_id", ASOF, tie="index_id").select("fund_id", "index_id")
    return panel(spark, d, "fund_master").join(mapped, "fund_id", "left").select("fund_id", pit.mapping_label(F.col("index_id"), F.col("master_index")).alias("label"))


_BLOCKS = f"q AS (SELECT security_id, trade_date AS quote_date, close, turnover_amount FROM quotes_wide WHERE trade_date <= DATE '{ASOF}' {_LAST.format(k='security_id', d='trade_date')}), o AS (SELECT security_id, trade_date AS old_date, close AS old_close FROM quotes_wide WHERE trade_date <= DATE '1999-03-31' AND n_orders > 1 {_LAST.format(k='security_id', d='trade_date')})"
_STALE = "CASE WHEN {d} IS NULL THEN 'missing' WHEN datediff('day', {d}, DATE '" + ASOF + "') > {n} THEN 'stale' END"


def _blocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    wide = panel(spark, d, "quotes_wide")
    q = pit.asof_rows(wide, "security_id", "trade_date", ASOF).select("security_id", F.col("trade_date").alias("quote_date"), "close", "turnover_amount")
    o = pit.asof_rows(wide.where("n_orders > 1"), "security_id", "trade_date", "1999-03-31").select("security_id", F.col("trade_date").alias("old_date"), F.col("close").alias("old_close"))
    ids = wide.select("security_id").distinct().unionByName(spark.range(1).select(F.lit("NO-SUCH").alias("security_id")))
    return ids, q, o


_K7 = f"{panel_sql('quotes_wide')}, {_BLOCKS}, i AS (SELECT DISTINCT security_id FROM quotes_wide UNION ALL SELECT 'NO-SUCH'), j AS (SELECT * FROM i LEFT JOIN q USING (security_id) LEFT JOIN o USING (security_id))"
_K6 = f"{_K7}, r AS (SELECT *, {_STALE.format(d='quote_date', n=30)} AS rq, {_STALE.format(d='old_date', n=120)} AS ro FROM j), k AS (SELECT security_id, quote_date, CASE WHEN rq IS NULL THEN close END AS close, CASE WHEN rq IS NULL THEN turnover_amount END AS turnover_amount, old_date, CASE WHEN ro IS NULL THEN old_close END AS old_close, datediff('day', quote_date, DATE '{ASOF}') AS quote_staleness_days, datediff('day', old_date, DATE '{ASOF}') AS old_staleness_days, concat_ws(',', 'quote:' || rq, 'old:' || ro) AS stale_blocks, CASE WHEN rq IS NULL AND ro IS NULL THEN 'PASS' ELSE 'PARTIAL' END AS data_quality FROM r)"


@add("K7_compare", f"{_K7} SELECT * FROM j", "close turnover_amount old_close")
def _k7(spark: SparkSession, d: str) -> DataFrame:
    ids, q, o = _blocks(spark, d)
    return pit.compare(ids, "security_id", [q, o])


def _stale(spark: SparkSession, d: str) -> DataFrame:
    return pit.with_staleness(_k7(spark, d), {"quote": ("quote_date", ["close", "turnover_amount"]), "old": ("old_date", ["old_close"])}, ASOF, 30).drop("x")


@add("K6_staleness", f"{_K6.replace('> 120', '> 30')} SELECT * FROM k", "close turnover_amount old_close")
def _k6(spark: SparkSession, d: str) -> DataFrame:
    return _stale(spark, d)


_TAGGED = f"(valid_from IS NULL OR valid_from <= DATE '{ASOF}') AND (valid_to IS NULL OR valid_to > DATE '{ASOF}')"


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d, "fund_tag")


@add("K10_tags_joined", f"{panel_sql('fund_tag')} SELECT fund_id, string_agg(tag, '|' ORDER BY tag) AS tags FROM (SELECT DISTINCT fund_id, tag FROM fund_tag WHERE {_TAGGED}) GROUP BY 1")
def _k10(spark: SparkSession, d: str) -> DataFrame:
    return groups.tags_asof(_tags(spark, d), "fund_id", ASOF).groupBy("fund_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"))


@add("J8_tags_asof", f"{panel_sql('fund_tag')} SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY confidence DESC NULLS LAST, tag) AS rank FROM fund_tag WHERE {_TAGGED}", "confidence")
def _j8(spark: SparkSession, d: str) -> DataFrame:
    return groups.tags_asof(_tags(spark, d), "fund_id", ASOF)


_FACTS = f"{panel_sql('fund_tag', 'shares', 'quotes')}, f AS (SELECT security_id AS fund_id, shares * nav AS aum, trade_date AS share_date FROM shares WHERE trade_date <= DATE '{ASOF}' {_LAST.format(k='security_id', d='trade_date')}), g AS (SELECT CAST(substr(security_id, 2) AS BIGINT) AS fund_id, ret, trade_date AS quote_date FROM (SELECT *, close / lag(close, 20) OVER (PARTITION BY security_id ORDER BY trade_date) - 1 AS ret FROM quotes) WHERE trade_date <= DATE '{ASOF}' {_LAST.format(k='security_id', d='trade_date')}), w AS (SELECT security_id AS fund_id, pct FROM (SELECT *, (shares - lag(shares, 20) OVER (PARTITION BY security_id ORDER BY trade_date)) / lag(shares, 20) OVER (PARTITION BY security_id ORDER BY trade_date) AS pct FROM shares) WHERE trade_date <= DATE '{ASOF}' {_LAST.format(k='security_id', d='trade_date')})"


@add("K11_themes", f"{_FACTS} SELECT tag, tag_type, count(DISTINCT fund_id) AS funds, sum(aum) AS aum, avg(ret) AS mean_return, avg(pct) AS mean_flow_pct, max(confidence) AS coverage, max(share_date) AS share_date, max(quote_date) AS quote_date FROM (SELECT fund_id, tag, tag_type, max(confidence) AS confidence FROM fund_tag WHERE {_TAGGED} GROUP BY ALL) LEFT JOIN f USING (fund_id) LEFT JOIN g USING (fund_id) LEFT JOIN w USING (fund_id) GROUP BY 1, 2 HAVING count(DISTINCT fund_id) >= 2 ORDER BY aum DESC NULLS LAST, tag LIMIT 30", "aum mean_return mean_flow_pct coverage")
def _k11(spark: SparkSession, d: str) -> DataFrame:
    shares = panel(spark, d, "shares").withColumnRenamed("security_id", "fund_id")
    sw = s.over("fund_id")
    shares = shares.withColumn("pct", (F.col("shares") - F.lag("shares", 20).over(sw)) / F.lag("shares", 20).over(sw))
    shares = pit.asof_rows(shares, "fund_id", "trade_date", ASOF).select("fund_id", (F.col("shares") * F.col("nav")).alias("aum"), "pct", F.col("trade_date").alias("share_date"))
    quotes = panel(spark, d, "quotes").withColumn("fund_id", F.expr("CAST(substr(security_id, 2) AS BIGINT)")).withColumn("ret", F.col("close") / F.lag("close", 20).over(s.over("security_id")) - 1)
    quotes = pit.asof_rows(quotes, "fund_id", "trade_date", ASOF).select("fund_id", "ret", F.col("trade_date").alias("quote_date"))
    return pit.themes(groups.tags_asof(_tags(spark, d), "fund_id", ASOF), shares.join(quotes, "fund_id", "full_outer"), "fund_id", 2, 30)


@add("K14_dashboard", f"{panel_sql('quotes_wide')}, {_BLOCKS} SELECT max(quote_date) AS latest, count(*) AS funds, count(*) FILTER (WHERE quote_date < (SELECT max(quote_date) FROM q)) AS stale, sum(CASE WHEN quote_date = (SELECT max(quote_date) FROM q) THEN turnover_amount END) AS turnover FROM q", "turnover")
def _k14(spark: SparkSession, d: str) -> DataFrame:
    q = _blocks(spark, d)[1]
    days = q.groupBy("quote_date").agg(F.count("*").alias("n"), F.sum("turnover_amount").alias("t"))
    return days.agg(F.max("quote_date").alias("latest"), F.sum("n").alias("funds"), (F.sum("n") - F.max_by("n", "quote_date")).alias("stale"), F.max_by("t", "quote_date").alias("turnover"))


@add("K15_top_turnover", f"{panel_sql('quotes_wide')}, {_BLOCKS} SELECT security_id, turnover_amount FROM q ORDER BY turnover_amount DESC, security_id LIMIT 10", "turnover_amount")
def _k15(spark: SparkSession, d: str) -> DataFrame:
    return pit.top(_blocks(spark, d)[1].select("security_id", "turnover_amount"), 10, F.desc("turnover_amount"), F.asc("security_id"))


# D: calendar
_SHIP = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem"


def _ship(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()


@add("D1_trading_day_guard", f"{panel_sql('calendar')}, s AS ({_SHIP}), b AS (SELECT min(trade_date) AS lo, max(trade_date) AS hi FROM calendar) SELECT day, day BETWEEN lo AND hi AS covered, day BETWEEN lo AND hi AND day NOT IN (SELECT trade_date FROM calendar) AS rejected FROM s, b")
def _d1(spark: SparkSession, d: str) -> DataFrame:
    return calendar.guard(_ship(spark, d), panel(spark, d, "calendar"), "day")


@add("D2_trading_days_around", f"{panel_sql('calendar')}, s AS ({_SHIP}) SELECT day, max(CASE WHEN trade_date <= day THEN trade_date END) AS latest, max(CASE WHEN trade_date < day THEN trade_date END) AS previous FROM s, calendar GROUP BY 1")
def _d2(spark: SparkSession, d: str) -> DataFrame:
    return calendar.around(_ship(spark, d), panel(spark, d, "calendar"), "day")


@add("D3_days_back", f"{panel_sql('calendar')} SELECT trade_date, row_number() OVER (ORDER BY trade_date DESC) - 1 AS back FROM calendar WHERE trade_date <= DATE '{ASOF}' ORDER BY trade_date DESC LIMIT 30")
def _d3(spark: SparkSession, d: str) -> DataFrame:
    return calendar.days_back(panel(spark, d, "calendar"), ASOF, 30)


@add("D5_freshness", f"{panel_sql('calendar')}, f AS (SELECT 'orders' AS dataset, max(CAST(o_orderdate AS DATE)) AS last_date FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' UNION ALL SELECT 'lineitem', max(CAST(l_shipdate AS DATE)) FROM lineitem) SELECT dataset, last_date, CASE WHEN last_date <= DATE '{ASOF}' THEN (SELECT count(*) FROM calendar WHERE trade_date > last_date AND trade_date <= DATE '{ASOF}') END AS lag FROM f")
def _d5(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, "orders").where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp"))
    return calendar.freshness({"orders": (orders, "o_orderdate"), "lineitem": (_table(spark, d, "lineitem"), "l_shipdate")}, panel(spark, d, "calendar"), ASOF)


# C: checks
_QUOTE = "SELECT o_orderkey, o_totalprice AS open, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice + o_orderkey % 7 END AS close, o_totalprice + o_orderkey % 6 AS high, o_totalprice + (o_orderkey % 9 - 7) AS low, o_custkey % 100 - 1 AS volume, o_totalprice - 2000 AS amount FROM {0}orders{1}"


def _quote(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_QUOTE.format("{", "}"), orders=_table(spark, d, "orders"))


_RULES = [("high_below_open_close", "high < greatest(open, close)"), ("low_above_open_close", "low > least(open, close)"), ("negative_volume", "volume < 0"), ("negative_amount", "amount < 0")]


@add("C1_quote_validator", f"SELECT o_orderkey, rule FROM ({' UNION ALL '.join(f'SELECT o_orderkey, {n!r} AS rule FROM ({_QUOTE.format('', '')}) WHERE {c}' for n, c in _RULES)})")
def _c1(spark: SparkSession, d: str) -> DataFrame:
    return checks.quarantine(_quote(spark, d).withColumn("issues", checks.quote_issues()))[1].select("o_orderkey", "rule")


@add("C6_quarantine", f"SELECT o_orderkey, open FROM ({_QUOTE.format('', '')}) WHERE NOT ({' OR '.join(f'coalesce({c}, FALSE)' for _, c in _RULES)})", "open")
def _c6(spark: SparkSession, d: str) -> DataFrame:
    return checks.quarantine(_quote(spark, d).withColumn("issues", checks.quote_issues()))[0].select("o_orderkey", "open")


_PAIR = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS a, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 50 = 0 THEN o_totalprice * 1.002 ELSE o_totalprice * 1.0005 END AS b FROM {0}orders{1}"


@add("C4_reconcile", f"SELECT o_orderkey, CASE WHEN a IS NULL AND b IS NULL THEN 'FAILED' WHEN a IS NULL OR b IS NULL THEN 'PASS' WHEN abs(b - a) / abs(a) <= 0.001 THEN 'VERIFIED' ELSE 'CONFLICT' END AS status, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR abs(b - a) / abs(a) <= 0.001 THEN a END AS agreed FROM ({_PAIR.format('', '')})", "agreed")
def _c4(spark: SparkSession, d: str) -> DataFrame:
    status, value = checks.reconcile(F.array("a", "b"))
    return spark.sql(_PAIR.format("{", "}"), orders=_table(spark, d, "orders")).select("o_orderkey", status.alias("status"), value.alias("agreed"))


@add("C5_conflict_gate", f"SELECT o_orderkey, b AS close, coalesce(abs(b - a) <= 0.001 * abs(a), TRUE) AS accepted FROM ({_PAIR.format('', '')})", "close")
def _c5(spark: SparkSession, d: str) -> DataFrame:
    pair = spark.sql(_PAIR.format("{", "}"), orders=_table(spark, d, "orders"))
    return checks.conflict_gate(pair.select("o_orderkey", F.col("b").alias("close")), pair.select("o_orderkey", F.col("a").alias("close")), ["o_orderkey"], "close")


# A: merges
_OLD = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM {0}customer{1} WHERE c_custkey % 3 <> 0"
_NEW = "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name || '*' END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal + 1 END AS c_acctbal, 'NEW' AS c_mktsegment FROM {0}customer{1} WHERE c_custkey % 2 = 0"


@add("A4_merge_keyed", f"SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal, coalesce(o.c_mktsegment, n.c_mktsegment) AS c_mktsegment FROM ({_OLD.format('', '')}) o FULL OUTER JOIN ({_NEW.format('', '')}) n ON o.c_custkey = n.c_custkey", "c_acctbal")
def _a4(spark: SparkSession, d: str) -> DataFrame:
    customer = _table(spark, d, "customer")
    old, new = (spark.sql(x.format("{", "}"), customer=customer) for x in (_OLD, _NEW))
    return merge.merge_keyed(old, new, ["c_custkey"], overwrite=["c_acctbal"], keep=["c_mktsegment"])


@add("A5_enrich", f"SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, coalesce(o.c_acctbal, n.c_acctbal) AS c_acctbal, coalesce(o.c_mktsegment, n.c_mktsegment) AS c_mktsegment FROM ({_OLD.format('', '')}) o FULL OUTER JOIN ({_NEW.format('', '')}) n ON o.c_custkey = n.c_custkey", "c_acctbal")
def _a5(spark: SparkSession, d: str) -> DataFrame:
    customer = _table(spark, d, "customer")
    old, new = (spark.sql(x.format("{", "}"), customer=customer) for x in (_OLD, _NEW))
    return merge.merge_keyed(old, new, ["c_custkey"], keep=["c_name", "c_acctbal", "c_mktsegment"])


@add("A7_without_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def _a7(spark: SparkSession, d: str) -> DataFrame:
    facts = _table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return merge.without_orphans(_table(spark, d, "orders").select("o_orderkey", "o_custkey"), facts, ["o_custkey"])


@add("O2_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def _o2(spark: SparkSession, d: str) -> DataFrame:
    facts = _table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return merge.orphans(_table(spark, d, "orders").select("o_orderkey", "o_custkey"), facts, ["o_custkey"])


@add("O15_repeated_keys", "SELECT l_orderkey, l_linenumber % 3 AS line, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _o15(spark: SparkSession, d: str) -> DataFrame:
    return merge.repeated_keys(_table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("line")), ["l_orderkey", "line"])


@add("O1_non_trading_days", f"{panel_sql('calendar')}, s AS ({_SHIP}) SELECT day FROM s WHERE day NOT IN (SELECT trade_date FROM calendar) AND day BETWEEN (SELECT min(trade_date) FROM calendar) AND (SELECT max(trade_date) FROM calendar)")
def _o1(spark: SparkSession, d: str) -> DataFrame:
    return _d1(spark, d).where("rejected").select("day")


@add("O8_single_exchange_days", f"{panel_sql('turnover')} SELECT trade_date, count(DISTINCT exchange) AS exchanges FROM turnover GROUP BY 1 HAVING count(DISTINCT exchange) < 2")
def _o8(spark: SparkSession, d: str) -> DataFrame:
    return market.totals(panel(spark, d, "turnover")).where("exchanges < 2").select("trade_date", "exchanges")


# L: market
@add("L1_market_totals", f"{panel_sql('turnover')} SELECT trade_date, sum(turnover_amount) AS amount, max(rate) AS rate, count(DISTINCT exchange) AS exchanges FROM turnover GROUP BY 1", "amount rate")
def _l1(spark: SparkSession, d: str) -> DataFrame:
    return market.totals(panel(spark, d, "turnover"))


@add("L3_change_pct", f"{panel_sql('turnover')} SELECT exchange, trade_date, (turnover_amount / lag(turnover_amount, 5) OVER w - 1) * 100 AS change_pct FROM turnover WINDOW w AS (PARTITION BY exchange ORDER BY trade_date)", "change_pct")
def _l3(spark: SparkSession, d: str) -> DataFrame:
    return market.change_pct(panel(spark, d, "turnover"), "exchange", "trade_date", "turnover_amount", 5)


@add("L6_index_position", f"{panel_sql('index_quotes')}, x AS (SELECT *, list(close) OVER w AS a, max(close) OVER w AS peak FROM index_quotes WINDOW w AS (PARTITION BY index_id ORDER BY trade_date ROWS 249 PRECEDING)) SELECT index_id, trade_date, CASE WHEN len(a) >= 60 THEN (len([v FOR v IN a IF v < close]) + len([v FOR v IN a IF v = close]) / 2) / len(a) END AS position, close / peak - 1 AS from_peak FROM x", "position from_peak")
def _l6(spark: SparkSession, d: str) -> DataFrame:
    return market.index_position(panel(spark, d, "index_quotes"), "index_id", "trade_date", "close")


@add("L5_strict_mean", f"{panel_sql('turnover')} SELECT exchange, trade_date, CASE WHEN count(v) OVER w = 20 THEN avg(v) OVER w END AS mean FROM (SELECT exchange, trade_date, CASE WHEN day(trade_date) <> 9 THEN turnover_amount END AS v FROM turnover) WINDOW w AS (PARTITION BY exchange ORDER BY trade_date ROWS 19 PRECEDING)", "mean")
def _l5(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d, "turnover").withColumn("v", F.when(F.dayofmonth("trade_date") != 9, F.col("turnover_amount")))
    return rows.select("exchange", "trade_date", s.strict(F.avg, F.col("v"), s.over("exchange"), 20).alias("mean"))


_L8 = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, sum(v) AS total, count(*) FILTER (WHERE v IS NULL) AS missing FROM (SELECT o_orderdate, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS v FROM orders) GROUP BY 1"


def _months(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "orders").withColumn("v", F.when(F.col("o_orderkey") % 6 != 0, F.round(F.col("o_totalprice") * 100).cast("long")))
    return market.monthly(rows, "o_orderdate", "v")


@add("L8_monthly_totals", _L8.replace("sum(v) AS total", "CAST(sum(v) AS BIGINT) AS total"))
def _l8(spark: SparkSession, d: str) -> DataFrame:
    return _months(spark, d)


@add("L9_recent_months", f"WITH m AS ({_L8}), x AS (SELECT month, CASE WHEN count(*) OVER a = 3 THEN sum(total) OVER a END AS recent, CASE WHEN count(*) OVER b = 3 THEN sum(total) OVER b END AS previous FROM m WINDOW a AS (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), b AS (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING)) SELECT month, CAST(recent AS BIGINT) AS recent, CAST(previous AS BIGINT) AS previous, CASE WHEN previous > 0 THEN (CAST(recent AS DOUBLE) / CAST(previous AS DOUBLE) - 1) * 100 END AS change_pct FROM x", "change_pct")
def _l9(spark: SparkSession, d: str) -> DataFrame:
    return market.recent_against_previous(_months(spark, d), "total")


# M: states
_M2 = f"{panel_sql('m_turnover')}, t AS (SELECT market_id AS exchange, trade_date, amount FROM m_turnover), {volume_sql('t', 'exchange', 'amount', 'vol')}, v AS (SELECT exchange, trade_date, ratio, state FROM vol)"


def _m2(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d, "m_turnover").withColumnRenamed("market_id", "exchange")
    return pulse.volume_layer(rows, "exchange", "trade_date", "amount").select("exchange", "trade_date", "ratio", "state")


@add("M3_basket_layer", "SELECT o_orderkey, CASE WHEN size = 0 OR (five IS NULL AND twenty IS NULL) THEN 'UNKNOWN' WHEN p > 0 THEN 'STRONG' WHEN p < 0 THEN 'WEAK' ELSE 'NEUTRAL' END AS state FROM (SELECT *, CASE WHEN five > 0 THEN 1 WHEN five IS NOT NULL THEN -1 ELSE 0 END + CASE WHEN twenty > 0 THEN 1 WHEN twenty IS NOT NULL THEN -1 ELSE 0 END AS p FROM (SELECT o_orderkey, o_custkey % 5 AS size, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 - 1 END AS five, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 7 - 3 END AS twenty FROM orders))")
def _m3(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _table(spark, d, "orders").select("o_orderkey", market.basket_layer(F.col("o_custkey") % 5, F.when(k % 4 != 0, k % 3 - 1), F.when(k % 6 != 0, k % 7 - 3)).alias("state"))


def _m5_sql(source: str, key: str, day: str) -> str:
    w = f"(PARTITION BY {key} ORDER BY {day})"
    return f"""p AS (SELECT *, lag(state) OVER {w} AS prev FROM {source}),
i AS (SELECT *, sum(CASE WHEN state IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY {day} ROWS UNBOUNDED PRECEDING) AS island FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY {key}, island ORDER BY {day}) AS run FROM i),
a AS (SELECT *, CASE WHEN prev IS NULL OR state = 'UNKNOWN' OR prev = 'UNKNOWN' OR run >= 2 THEN state END AS anchor FROM r),
confirmed AS (SELECT {key}, {day}, state, last_value(anchor IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY {day} ROWS UNBOUNDED PRECEDING) AS confirmed FROM a)"""


@add("M5_confirmed", f"{_M2}, {_m5_sql('v', 'exchange', 'trade_date')} SELECT * FROM confirmed")
def _m5(spark: SparkSession, d: str) -> DataFrame:
    return market.confirmed(_m2(spark, d).select("exchange", "trade_date", "state"), "exchange", "trade_date", "state")


_RUNS = f"{_M2}, {_m5_sql('v', 'exchange', 'trade_date')}, runs AS (SELECT exchange, state, count(*) AS days, min(trade_date) AS since FROM r GROUP BY exchange, island, state)"


@add("N1_state_runs", f"{_RUNS} SELECT * FROM runs")
def _n1(spark: SparkSession, d: str) -> DataFrame:
    return market.state_runs(_m2(spark, d), "exchange", "trade_date", "state")


@add("N3_state_summary", f"{_RUNS}, q AS (SELECT exchange, state, CAST(sum(days) AS BIGINT) AS days, count(*) AS runs, avg(days) AS mean_run, median(days) AS median_run FROM runs GROUP BY 1, 2) SELECT *, days / sum(days) OVER (PARTITION BY exchange) AS share FROM q", "mean_run median_run share")
def _n3(spark: SparkSession, d: str) -> DataFrame:
    return market.state_summary(_m2(spark, d), "exchange", "trade_date", "state")


def _n5_sql(n: int, source: str = "index_quotes", key: str = "index_id", name: str = "n5") -> str:
    fall = "list_min([list_min(q[i:]) / q[i] - 1 FOR i IN range(1, len(q) + 1)])"
    return f"{name} AS (SELECT {key}, trade_date, a[len(a)] / close - 1 AS forward_return, CASE WHEN a IS NOT NULL THEN {fall} END AS forward_drawdown, list_min(a) / close - 1 AS adverse FROM (SELECT *, list_concat([close], a) AS q FROM (SELECT {key}, trade_date, close, CASE WHEN fits AND close > 0 AND len(b) > 0 THEN b END AS a FROM (SELECT *, [v FOR v IN list(close) OVER (PARTITION BY {key} ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) IF v IS NOT NULL] AS b, lead(trade_date, {n}) OVER (PARTITION BY {key} ORDER BY trade_date) IS NOT NULL AS fits FROM {source}))))"


def _gapped(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d, "m_index")


@add("N5_forward_outcomes", f"{panel_sql('m_index')}, {', '.join(_n5_sql(n, 'm_index', 'market_id', f'n{n}') for n in (5, 20, 60))} {' UNION ALL '.join(f'SELECT *, {n} AS days FROM n{n}' for n in (5, 20, 60))}", "forward_return forward_drawdown adverse")
def _n5(spark: SparkSession, d: str) -> DataFrame:
    parts = [market.forward_outcomes(_gapped(spark, d), "market_id", "trade_date", "close", n).withColumn("days", F.lit(n)) for n in (5, 20, 60)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@add("N6_adverse_excursion", f"{panel_sql('m_index')}, {_n5_sql(20, 'm_index', 'market_id')} SELECT market_id, trade_date, adverse FROM n5", "adverse")
def _n6(spark: SparkSession, d: str) -> DataFrame:
    return market.forward_outcomes(_gapped(spark, d), "market_id", "trade_date", "close", 20).select("market_id", "trade_date", "adverse")


_S = f"{panel_sql('m_turnover', 'm_index')}, {volume_sql('m_turnover', 'market_id', 'amount', 'vol')}, st AS (SELECT market_id, trade_date, state, year(trade_date) AS year, lag(state) OVER (PARTITION BY market_id ORDER BY trade_date) IS DISTINCT FROM state AS enters, close FROM vol LEFT JOIN m_index USING (market_id, trade_date)), {', '.join(_n5_sql(n, 'st', 'market_id', f'o{n}') for n in (5, 20, 60))}, o AS ({' UNION ALL '.join(f'SELECT *, {n} AS win FROM o{n}' for n in (5, 20, 60))}), sm AS (SELECT st.market_id, st.year, st.state, win, forward_return AS r, forward_drawdown AS dd, unnest(CASE WHEN enters THEN ['daily', 'transition'] ELSE ['daily'] END) AS sample FROM st JOIN o USING (market_id, trade_date) WHERE state <> 'UNKNOWN' AND forward_return IS NOT NULL)"
_STATS = "count(*) AS n, avg(r) AS mean, median(r) AS median, quantile_cont(r, 0.1) AS p10, quantile_cont(r, 0.9) AS p90, avg(dd) AS drawdown_mean, min(dd) AS drawdown_worst"


def _outcomes(spark: SparkSession, d: str, by: tuple[str, ...] = ()) -> DataFrame:
    states = pulse.volume_layer(panel(spark, d, "m_turnover"), "market_id", "trade_date", "amount").select("market_id", "trade_date", "state").withColumn("year", F.year("trade_date"))
    return market.state_outcomes(states, _gapped(spark, d), "market_id", "trade_date", "state", "close", by=by)


@add("N7_outcome_stats", f'{_S} SELECT market_id, state, win AS "window", sample, {_STATS} FROM sm GROUP BY ALL', "mean median p10 p90 drawdown_mean drawdown_worst")
def _n7(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d)


@add("N8_yearly_outcomes", f'{_S} SELECT market_id, year, state, win AS "window", sample, {_STATS} FROM sm GROUP BY ALL', "mean median p10 p90 drawdown_mean drawdown_worst")
def _n8_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d, ("year",))


# I: peers, J: holdings
@add("I6_peer_percentile", "SELECT s_suppkey, s_nationkey, CAST(n AS BIGINT) AS peer_count, CASE WHEN n >= 3 THEN (rk - 1) / (n - 1) END AS rank_pct FROM (SELECT s_suppkey, s_nationkey, count(*) OVER (PARTITION BY s_nationkey) AS n, rank() OVER (PARTITION BY s_nationkey ORDER BY v) AS rk FROM (SELECT *, floor(s_acctbal / 100) AS v FROM supplier WHERE s_suppkey % 9 <> 0))", "rank_pct")
def _i6(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "supplier").withColumn("v", F.when(F.col("s_suppkey") % 9 != 0, F.floor(F.col("s_acctbal") / 100)))
    return groups.peer_percentile(rows, "s_nationkey", "v").select("s_suppkey", "s_nationkey", "peer_count", "rank_pct")


_SEEN = f"(disclosed IS NULL OR disclosed <= DATE '{ASOF}')"
_J1 = f"{panel_sql('holdings', 'industry')}, rd AS (SELECT etf_id, max(report_date) AS report_date FROM holdings WHERE report_date <= DATE '{ASOF}' AND {_SEEN} GROUP BY 1), h AS (SELECT holdings.* FROM holdings JOIN rd USING (etf_id, report_date))"


@add("J2_latest_top_holdings", f"{_J1}, o AS (SELECT h.*, row_number() OVER (PARTITION BY etf_id ORDER BY weight_pct DESC, stock_id) AS rank FROM h), t AS (SELECT * FROM o WHERE rank <= 10), cf AS (SELECT etf_id, CASE WHEN count(*) = count(disclosed) THEN 'exact' ELSE 'limited' END AS confidence FROM t GROUP BY 1) SELECT CAST(s_suppkey + 0 AS BIGINT) AS etf_id, stock_id, report_date, disclosed, weight_pct, rank, coalesce(confidence, 'missing') AS confidence FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT -1) LEFT JOIN t ON t.etf_id = s_suppkey LEFT JOIN cf ON cf.etf_id = s_suppkey", "weight_pct")
def _j2(spark: SparkSession, d: str) -> DataFrame:
    funds = _table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("etf_id"))
    nobody = funds.limit(1).select(F.lit(-1).cast("long").alias("etf_id"))
    return groups.latest_top(panel(spark, d, "holdings"), "etf_id", ASOF, funds=funds.unionByName(nobody)).select("etf_id", "stock_id", "report_date", "disclosed", "weight_pct", "rank", "confidence")


_J6 = f"{_J1}, w AS (SELECT etf_id, coalesce(industry_name, 'unclassified') AS industry, sum(weight_pct) AS weight FROM h LEFT JOIN industry USING (stock_id) GROUP BY 1, 2)"


@add("J6_industry_weights", f"{_J6} SELECT * FROM w", "weight")
def _j6(spark: SparkSession, d: str) -> DataFrame:
    return groups.industry_weights(groups.latest_report(panel(spark, d, "holdings"), "etf_id", ASOF), panel(spark, d, "industry"), "etf_id")


# weights of some holdings are negative, industries are the last words of the part types
_J7 = f"""{_J1}, p AS (SELECT etf_id, split_part(industry_name, ' ', 3) AS tag, CASE WHEN stock_id % 13 = 0 THEN -weight_pct ELSE weight_pct END AS weight FROM h LEFT JOIN industry USING (stock_id)),
tot AS (SELECT etf_id, sum(weight) AS total, coalesce(sum(CASE WHEN tag <> '' THEN weight END), 0) AS classified, count(DISTINCT nullif(tag, '')) AS n FROM p WHERE weight > 0 GROUP BY 1),
sh AS (SELECT etf_id, tag, sum(weight) / any_value(total) AS share FROM p JOIN tot USING (etf_id) WHERE weight > 0 AND tag <> '' GROUP BY 1, 2),
fs AS (SELECT etf_id, max(share) AS share FROM sh GROUP BY 1), f1 AS (SELECT etf_id, min(tag) AS tag, any_value(share) AS share FROM sh JOIN fs USING (etf_id, share) GROUP BY 1),
rs AS (SELECT sh.* FROM sh ANTI JOIN f1 USING (etf_id, tag)), f2 AS (SELECT etf_id, min(tag) AS tag, any_value(share) AS share FROM rs JOIN (SELECT etf_id, max(share) AS share FROM rs GROUP BY 1) USING (etf_id, share) GROUP BY 1),
al AS (SELECT etf_id, tag, 'industry' AS tag_type, round(share, 4) AS confidence FROM f1 WHERE share >= 0.30 UNION ALL SELECT etf_id, tag, 'industry', round(share, 4) FROM f2 WHERE share >= 0.18
UNION ALL SELECT etf_id, '{groups.BROAD_TAG}', 'style', 0.85 FROM f1 JOIN tot USING (etf_id) WHERE share < 0.30 AND n >= 3 AND classified / total >= 0.80)
SELECT etf_id, tag, tag_type, CAST(confidence AS DOUBLE) AS confidence, round(classified / total, 4) AS coverage, DATE '{ASOF}' AS valid_from FROM al JOIN tot USING (etf_id)"""


@add("J7_industry_tags", _J7, "confidence coverage")
def _j7(spark: SparkSession, d: str) -> DataFrame:
    held = groups.latest_report(panel(spark, d, "holdings"), "etf_id", ASOF).withColumn("weight_pct", F.when(F.col("stock_id") % 13 == 0, -F.col("weight_pct")).otherwise(F.col("weight_pct")))
    return groups.industry_tags(held, panel(spark, d, "industry").withColumn("industry_name", F.split_part("industry_name", F.lit(" "), F.lit(3))), "etf_id", ASOF)
