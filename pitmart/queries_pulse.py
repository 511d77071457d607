"""Queries of the three-layer market state by inventory ID; markets are nations, so that all series have a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.operators import market, pulse
from pitmart.operators import series as s
from pitmart.panels import panel, panel_sql
from pitmart.queries import add

_RANK = "CASE WHEN len(a) >= 60 THEN (len([y FOR y IN a IF y < {v}]) + len([y FOR y IN a IF y = {v}]) / 2) / len(a) END"
_STATE = "CASE WHEN NOT known THEN 'UNKNOWN' WHEN points > 0 THEN 'STRONG' WHEN points < 0 THEN 'WEAK' ELSE 'NEUTRAL' END"


def _asof(left: str, right: str, columns: str, key: str) -> str:
    return f"SELECT l.*, {', '.join(f'r.{c}' for c in columns.split())} FROM {left} l ASOF LEFT JOIN {right} r ON l.{key} = r.{key} AND l.trade_date >= r.trade_date"


def liquidity_sql(source: str, key: str, value: str, name: str) -> str:
    w = f"(PARTITION BY {key} ORDER BY trade_date)"
    return f"""{name}_k AS (SELECT {key}, trade_date, n, CASE WHEN base <> 0 THEN (v / base - 1) * 100 END AS change, {_RANK.format(v='v')} AS position FROM (SELECT {key}, trade_date, {value} AS v, lag({value}, 5) OVER {w} AS base, row_number() OVER {w} AS n, list({value}) OVER (PARTITION BY {key} ORDER BY trade_date ROWS 249 PRECEDING) AS a FROM {source} WHERE {value} IS NOT NULL)),
{name}_j AS ({_asof(f'(SELECT {key}, trade_date FROM {source})', f'{name}_k', 'n change position', key)}),
{name}_p AS (SELECT {key}, trade_date, CASE WHEN n >= 6 THEN change END AS change, CASE WHEN n >= 6 THEN position END AS position, coalesce(n >= 6, FALSE) AND (change IS NOT NULL OR position IS NOT NULL) AS known, CASE WHEN change > 0.5 THEN 1 WHEN change < -0.5 THEN -1 ELSE 0 END + CASE WHEN position >= 0.6 THEN 1 WHEN position <= 0.4 THEN -1 ELSE 0 END AS points FROM {name}_j),
{name} AS (SELECT {key}, trade_date, change, position, CASE WHEN known THEN points ELSE 0 END AS score, {_STATE} AS state FROM {name}_p)"""


def volume_sql(source: str, key: str, value: str, name: str) -> str:
    return f"""{name}_k AS (SELECT {key}, trade_date, CASE WHEN count({value}) OVER b = 5 THEN avg({value}) OVER b END AS m5 FROM {source} WHERE {value} IS NOT NULL WINDOW b AS (PARTITION BY {key} ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
{name}_a AS (SELECT t.{key}, t.trade_date, CASE WHEN m5 <> 0 THEN t.{value} / m5 END AS ratio, count(t.{value}) OVER (PARTITION BY t.{key} ORDER BY t.trade_date ROWS UNBOUNDED PRECEDING) AS n, CASE WHEN count(t.{value}) OVER l = 20 THEN avg(t.{value}) OVER l END AS mean_20 FROM {source} t LEFT JOIN {name}_k k ON t.{key} = k.{key} AND t.trade_date = k.trade_date WINDOW l AS (PARTITION BY t.{key} ORDER BY t.trade_date ROWS 19 PRECEDING)),
{name}_r AS (SELECT {key}, trade_date, {_RANK.format(v='mean_20')} AS position FROM (SELECT *, list(mean_20) OVER (PARTITION BY {key} ORDER BY trade_date ROWS 249 PRECEDING) AS a FROM {name}_a WHERE mean_20 IS NOT NULL)),
{name}_j AS ({_asof(f'{name}_a', f'{name}_r', 'position', key)}),
{name}_p AS (SELECT {key}, trade_date, {', '.join(f'CASE WHEN n >= 6 THEN {c} END AS {c}' for c in ('ratio', 'mean_20', 'position'))}, n >= 6 AND (ratio IS NOT NULL OR position IS NOT NULL) AS known, CASE WHEN ratio >= 1.1 THEN 1 WHEN ratio <= 0.9 THEN -1 ELSE 0 END + CASE WHEN position >= 0.6 THEN 1 WHEN position <= 0.4 THEN -1 ELSE 0 END AS points FROM {name}_j),
{name} AS (SELECT {key}, trade_date, ratio, mean_20, position, CASE WHEN known THEN points ELSE 0 END AS score, {_STATE} AS state FROM {name}_p)"""


def confirmed_sql(source: str, key: str, columns: list[str], name: str) -> str:
    """source with <column>_state for each of its columns <column>_raw, confirmed over two days."""
    steps, last = [], source
    for c in columns:
        w = f"(PARTITION BY {key} ORDER BY trade_date)"
        raw = f"{c}_raw"
        steps.append(f"{name}_{c}a AS (SELECT *, lag({raw}) OVER {w} AS prev, lag({raw}) OVER {w} IS NOT DISTINCT FROM {raw} AS same FROM {last})")
        steps.append(f"{name}_{c}b AS (SELECT *, CASE WHEN prev IS NULL OR {raw} = 'UNKNOWN' OR prev = 'UNKNOWN' OR same THEN {raw} END AS anchor FROM {name}_{c}a)")
        steps.append(f"{name}_{c} AS (SELECT * EXCLUDE (prev, same, anchor), last_value(anchor IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS {c}_state FROM {name}_{c}b)")
        last = f"{name}_{c}"
    return ", ".join(steps)


def overall_sql(*states: str) -> str:
    known, strong = (" + ".join(f"CASE WHEN {x} {test} THEN 1 ELSE 0 END" for x in states) for test in ("<> 'UNKNOWN'", "= 'STRONG'"))
    o = pulse.OVERALL
    return f"CASE WHEN {known} < 2 THEN '{o['unknown']}' WHEN {strong} >= 2 THEN '{o['strong']}' WHEN {strong} = 1 THEN '{o['mixed']}' ELSE '{o['weak']}' END"


def quadrant_sql(position: str, ratio: str) -> str:
    zone = f"CASE WHEN {position} >= 0.65 THEN 'high' WHEN {position} <= 0.35 THEN 'low' ELSE 'mid' END"
    pace = f"CASE WHEN {ratio} >= 1.1 THEN 'expand' WHEN {ratio} <= 0.9 THEN 'shrink' ELSE 'flat' END"
    cases = " ".join(f"WHEN '{z}-{p}' THEN '{pulse.QUADRANTS.get((z, p), zt + pt + pulse.UNCLEAR)}'" for z, zt in pulse.ZONES.items() for p, pt in pulse.PACES.items())
    return f"CASE WHEN {position} IS NOT NULL AND {ratio} IS NOT NULL THEN CASE {zone} || '-' || {pace} {cases} END END"


_LIQ = f"{panel_sql('m_margin')}, {liquidity_sql('m_margin', 'market_id', 'balance', 'liq')}"
_VOL = f"{panel_sql('m_turnover')}, {volume_sql('m_turnover', 'market_id', 'amount', 'vol')}"


@add("M1_liquidity_layer", f"{_LIQ} SELECT * FROM liq", "change position")
def _m1(spark: SparkSession, d: str) -> DataFrame:
    return pulse.liquidity_layer(panel(spark, d, "m_margin"), "market_id", "trade_date", "balance")


@add("M2_volume_layer", f"{_VOL} SELECT * FROM vol", "ratio mean_20 position")
def _m2(spark: SparkSession, d: str) -> DataFrame:
    return pulse.volume_layer(panel(spark, d, "m_turnover"), "market_id", "trade_date", "amount")


_POINTS = "CASE WHEN net_5d > 0 THEN 1 WHEN net_5d IS NOT NULL THEN -1 ELSE 0 END + CASE WHEN net_20d > 0 THEN 1 WHEN net_20d IS NOT NULL THEN -1 ELSE 0 END"
_BASKET = f"CASE WHEN coalesce(basket_size, 0) = 0 OR (net_5d IS NULL AND net_20d IS NULL) THEN 'UNKNOWN' WHEN {_POINTS} > 0 THEN 'STRONG' WHEN {_POINTS} < 0 THEN 'WEAK' ELSE 'NEUTRAL' END"
_PLACE = f"place AS (SELECT market_id, trade_date, {_RANK.format(v='close')} AS index_position FROM (SELECT *, list(close) OVER (PARTITION BY market_id ORDER BY trade_date ROWS 249 PRECEDING) AS a FROM m_index WHERE close IS NOT NULL))"
_RAW = f"""{panel_sql('m_turnover', 'm_margin', 'm_index', 'm_basket')}, {liquidity_sql('m_margin', 'market_id', 'balance', 'liq')}, {volume_sql('m_turnover', 'market_id', 'amount', 'vol')}, {_PLACE},
lq AS (SELECT market_id, trade_date, change AS margin_change, position AS margin_position, score AS liquidity_score, state AS lraw FROM liq),
v1 AS ({_asof('(SELECT market_id, trade_date, ratio AS volume_ratio, position AS volume_position, score AS volume_score, state AS volume_raw FROM vol)', 'lq', 'margin_change margin_position liquidity_score lraw', 'market_id')}),
v2 AS ({_asof('v1', 'place', 'index_position', 'market_id')}),
raw AS (SELECT v2.* EXCLUDE (lraw), coalesce(lraw, 'UNKNOWN') AS liquidity_raw, basket_size, net_5d, net_20d, {_BASKET} AS etf_raw FROM v2 LEFT JOIN m_basket USING (market_id, trade_date))"""
_PULSE = f"{_RAW}, {confirmed_sql('raw', 'market_id', ['liquidity', 'volume', 'etf'], 'c')}, pulse AS (SELECT *, {overall_sql('liquidity_state', 'volume_state', 'etf_state')} AS overall_state, {quadrant_sql('index_position', 'volume_ratio')} AS quadrant FROM c_etf)"
_DOUBLES = "volume_ratio volume_position margin_change margin_position index_position net_5d net_20d"


def _replay(spark: SparkSession, d: str, last: int | None = None) -> DataFrame:
    return pulse.replay(*(panel(spark, d, f"m_{x}") for x in ("turnover", "margin", "basket", "index")), "market_id", "trade_date", last)


@add("M11_pulse_replay", f"{_PULSE} SELECT * FROM pulse QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY trade_date DESC) <= 250", _DOUBLES)
def _m11(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d, 250)


@add("M10_pulse_row", f"{_PULSE} SELECT * FROM pulse QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY trade_date DESC) = 1", _DOUBLES)
def _m10(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d, 1)


@add("M4_overall", f"{_PULSE} SELECT market_id, trade_date, liquidity_state, volume_state, etf_state, overall_state FROM pulse")
def _m4(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d).select("market_id", "trade_date", "liquidity_state", "volume_state", "etf_state", "overall_state")


@add("M7_quadrant_label", f"{_PULSE} SELECT market_id, trade_date, quadrant FROM pulse WHERE quadrant IS NOT NULL")
def _m7(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d).select("market_id", "trade_date", "quadrant").where("quadrant is not null")


@add("M8_quadrants", f"{panel_sql('m_turnover', 'm_index')}, {volume_sql('m_turnover', 'market_id', 'amount', 'vol')}, {_PLACE} SELECT market_id, trade_date, index_position AS position, ratio, amount, {quadrant_sql('index_position', 'ratio')} AS quadrant FROM place JOIN (SELECT market_id, trade_date, ratio FROM vol) USING (market_id, trade_date) JOIN m_turnover USING (market_id, trade_date) WHERE index_position IS NOT NULL AND ratio IS NOT NULL", "position ratio amount")
def _m8(spark: SparkSession, d: str) -> DataFrame:
    turnover = panel(spark, d, "m_turnover")
    place = panel(spark, d, "m_index").where("close is not null").select("market_id", "trade_date", s.mid_rank("close", s.over("market_id"), pulse.WINDOW, pulse.LEAST).alias("position"))
    pace = pulse.volume_layer(turnover, "market_id", "trade_date", "amount").select("market_id", "trade_date", "ratio")
    both = place.join(pace, ["market_id", "trade_date"]).join(turnover, ["market_id", "trade_date"]).where("position is not null and ratio is not null")
    return both.withColumn("quadrant", pulse.quadrant(F.col("position"), F.col("ratio")))


_PREV = ", ".join(f"lag({x}_state) OVER w AS p_{x}" for x in pulse.LAYERS)
_CHANGED = "[y FOR y IN [" + ", ".join(f"CASE WHEN p_{x} <> {x}_state THEN '{x}:' || p_{x} || ':' || {x}_state END" for x in pulse.LAYERS) + "] IF y IS NOT NULL]"
_TOLD = "CASE split_part(changed[1], ':', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pulse.SIGNIFICANCE.items()) + " END"


@add("M9_transitions", f"""{_PULSE}, t AS (SELECT *, row_number() OVER w AS rn, lag(overall_state) OVER w AS from_overall, {_PREV} FROM pulse WINDOW w AS (PARTITION BY market_id ORDER BY trade_date)), u AS (SELECT *, {_CHANGED} AS changed FROM t WHERE rn > 1),
x AS (SELECT *, len([y FOR y IN changed IF contains(y, 'UNKNOWN')]) > 0 AS un FROM u WHERE len(changed) > 0 OR from_overall <> overall_state)
SELECT market_id, trade_date, from_overall <> overall_state AS overall_changed, from_overall, overall_state AS to_overall, array_to_string(changed, ',') AS changed_layers, CASE WHEN len(changed) = 1 THEN split_part(changed[1], ':', 1) END AS leading_layer, CASE WHEN un THEN 'coverage' ELSE 'market' END AS kind, CASE WHEN un THEN '{pulse.COVERAGE_EVENT}' WHEN len(changed) = 1 THEN {_TOLD} ELSE '{pulse.JOINT_EVENT}' END AS significance FROM x""")
def _m9(spark: SparkSession, d: str) -> DataFrame:
    return pulse.transitions(_replay(spark, d), "market_id", "trade_date")


@add("M6_single_step", f"{_PULSE}, b AS (SELECT market_id, trade_date, volume_raw, lag(volume_state) OVER w AS before, lag(volume_raw) OVER w AS raw_before FROM pulse WINDOW w AS (PARTITION BY market_id ORDER BY trade_date)) SELECT market_id, trade_date, CASE WHEN before IS NULL OR volume_raw = 'UNKNOWN' OR before = 'UNKNOWN' OR volume_raw = before OR volume_raw = raw_before THEN volume_raw ELSE before END AS state FROM b")
def _m6(spark: SparkSession, d: str) -> DataFrame:
    w = s.over("market_id")
    rows = _replay(spark, d).select("market_id", "trade_date", "volume_raw", F.lag("volume_state").over(w).alias("before"), F.lag("volume_raw").over(w).alias("raw_before"))
    return rows.select("market_id", "trade_date", pulse.step(F.col("before"), F.col("raw_before"), F.col("volume_raw")).alias("state"))


_NORM = "SELECT market_id, trade_date, {v} / cap AS value FROM {t} JOIN (SELECT market_id, trade_date, CASE WHEN day(trade_date) <> 17 THEN CAST(sum(cents) OVER (PARTITION BY market_id ORDER BY trade_date ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS DOUBLE) END AS cap FROM m_days) c USING (market_id, trade_date)"


@add("M13_normalised_pulse", f"""{panel_sql('m_turnover', 'm_margin', 'm_basket')}, nm AS ({_NORM.format(v='balance', t='m_margin')}), nt AS ({_NORM.format(v='amount', t='m_turnover')}), {liquidity_sql('nm', 'market_id', 'value', 'liq')}, {volume_sql('nt', 'market_id', 'value', 'vol')},
z AS (SELECT market_id, trade_date, coalesce(liq.state, 'UNKNOWN') AS liquidity_state, coalesce(vol.state, 'UNKNOWN') AS volume_state, CASE WHEN b.market_id IS NULL THEN 'UNKNOWN' ELSE {_BASKET} END AS etf_state FROM m_turnover LEFT JOIN liq USING (market_id, trade_date) LEFT JOIN vol USING (market_id, trade_date) LEFT JOIN m_basket b USING (market_id, trade_date))
SELECT *, {overall_sql('liquidity_state', 'volume_state', 'etf_state')} AS overall_state FROM z""")
def _m13(spark: SparkSession, d: str) -> DataFrame:
    days = panel(spark, d, "m_days")
    cap = F.when(F.dayofmonth("trade_date") != 17, F.sum("cents").over(s.last_rows(s.over("market_id"), 40)).cast("double"))
    caps = days.select("market_id", "trade_date", cap.alias("cap"))
    norm = lambda t, v: panel(spark, d, t).join(caps, ["market_id", "trade_date"]).select("market_id", "trade_date", (F.col(v) / F.col("cap")).alias("value"))
    etf = panel(spark, d, "m_basket").select("market_id", "trade_date", market.basket_layer(F.col("basket_size"), F.col("net_5d"), F.col("net_20d")).alias("etf_state"))
    return pulse.normalised(panel(spark, d, "m_turnover"), norm("m_margin", "balance"), norm("m_turnover", "amount"), etf, "market_id", "trade_date")
