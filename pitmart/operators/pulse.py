"""Three-layer market state for every day at once [M1-M4, M7, M9-M13], on series of a market and a date.

A layer is judged on what is known up to a day: a day without a value keeps the change and the percentile of the last
known one.  Missing is never 0; a window that is not full gives null.

For few long lines, `cut` (days of a segment, rows of a piece) spreads the rows of a line over many tasks: windows of rows
work on pieces that carry the rows they reach, and what is carried forward goes from segment to segment.  Steps are then
written to the shared folder in between; call replay() under storage.tidy to have them deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitmart.operators import market, scan
from pitmart.operators import series as s
from pitmart.storage import materialize

Cut = tuple[int, int] | None

# fixed values
CHANGE = 0.5
RATIO_STRONG, RATIO_WEAK = 1.1, 0.9
HIGH, LOW = 0.6, 0.4
WINDOW, LEAST = 250, 60
QUADRANT_HIGH, QUADRANT_LOW = 0.65, 0.35
OVERALL = {"unknown": "数据不足", "strong": "偏多", "mixed": "中性观望", "weak": "防守"}
QUADRANTS = {
    ("low", "expand"): "低位放量：吸筹/启动，重点跟踪",
    ("low", "shrink"): "低位缩量：阴跌寻底或筑底，等待方向",
    ("high", "expand"): "高位放量：出货/赶顶，高度警惕",
    ("high", "shrink"): "高位缩量：惜售延续或量价背离，谨慎",
}
ZONES = {"low": "低位", "mid": "中位", "high": "高位"}
PACES = {"expand": "放量", "shrink": "缩量", "flat": "平量"}
UNCLEAR = "：信号不明确"
SIGNIFICANCE = {"liquidity": "资金先行信号", "volume": "量能确认/背离", "etf": "大钱动作"}
COVERAGE_EVENT, JOINT_EVENT = "数据开始覆盖/中断", "多层共振转向"
LAYERS = ("liquidity", "volume", "etf")


def on_known(df: DataFrame, key: str, date: str, value: str, make, back: int, cut: tuple[int, int]) -> DataFrame:  # noqa: ANN001
    """(key, date, the columns make(window)) of the rows with a known value, in pieces; windows reach `back` of them back."""
    columns = lambda rows, k: rows.select(k, date, *(c.alias(n) for n, c in make(Window.partitionBy(k).orderBy(date)).items()))
    return scan.in_pieces(df.where(F.col(value).isNotNull()).select(key, date, value), key, date, back, columns, size=cut[1], width=cut[0])


def carried(df: DataFrame, key: str, date: str, value: str, make, cut: Cut = None) -> DataFrame:  # noqa: ANN001
    """df with the columns make(window over the known rows alone) of the last known row up to each row.  Windows reach less
    than WINDOW rows back."""
    known = F.col(value).isNotNull()
    if cut is not None:
        own = materialize(on_known(df, key, date, value, make, WINDOW, cut))
        return scan.asof(df, own, [key], date, [c for c in own.columns if c not in (key, date)], width=cut[0])
    found = make(Window.partitionBy(key, known).orderBy(date))
    rows = df.withColumn("_own", F.when(known, F.struct(*(c.alias(n) for n, c in found.items()))))
    rows = rows.withColumn("_last", F.last("_own", ignorenulls=True).over(s.so_far(s.over(key, date))))
    return rows.select(*df.columns, *(F.col("_last")[n].alias(n) for n in found))


def asof_join(left: DataFrame, right: DataFrame, key: str, date: str) -> DataFrame:
    """left with the columns of the last row of right dated the same day or before, by one union and one window."""
    values = [c for c in right.columns if c not in (key, date)]
    one = right.select(key, date, F.struct(*values).alias("_right"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"))
    two = left.select(key, date, F.lit(None).cast(one.schema["_right"].dataType).alias("_right"), F.struct(*left.columns).alias("_left"))
    w = Window.partitionBy(key).orderBy(date, F.col("_left").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = one.unionByName(two).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_left is not null")
    return rows.select("_left.*", *(F.col("_right")[c].alias(c) for c in values))


def _points(value: Column, high: float, low: float) -> Column:
    return F.when(value >= high, 1).when(value <= low, -1).otherwise(0)


def _state(known: Column, score: Column) -> Column:
    return F.when(~known, "UNKNOWN").when(score > 0, "STRONG").when(score < 0, "WEAK").otherwise("NEUTRAL")


def liquidity_layer(df: DataFrame, key: str, date: str, value: str, cut: Cut = None) -> DataFrame:
    """[M1] A point for the change over five known observations beyond CHANGE percent and one for the percentile; under
    six observations, or with neither, UNKNOWN."""
    def make(w):  # noqa: ANN001, ANN202
        base = F.lag(value, 5).over(w)
        return {"change": F.when(base != 0, (F.col(value) / base - 1) * 100), "position": s.mid_rank(value, w, WINDOW, LEAST), "_n": F.row_number().over(w)}

    rows = carried(df, key, date, value, make, cut)  # of a piece's rows _n counts those it reaches, which are more than six
    known = (F.coalesce("_n", F.lit(0)) >= 6) & (F.col("change").isNotNull() | F.col("position").isNotNull())
    score = F.when(F.col("change") > CHANGE, 1).when(F.col("change") < -CHANGE, -1).otherwise(0) + _points(F.col("position"), HIGH, LOW)
    enough = F.coalesce("_n", F.lit(0)) >= 6
    return rows.select(key, date, F.when(enough, F.col("change")).alias("change"), F.when(enough, F.col("position")).alias("position"), F.when(known, score).otherwise(0).alias("score"), _state(known, score).alias("state"))


def volume_layer(df: DataFrame, key: str, date: str, value: str, cut: Cut = None) -> DataFrame:
    """[M2] A point for today against the mean of the five known days before it, and one for the percentile of the strict
    mean of 20 rows; under six observations, or with neither, UNKNOWN, with the facts."""
    w = s.over(key, date)
    before = Window.partitionBy(key, F.col(value).isNotNull()).orderBy(date).rowsBetween(-5, -1)
    mean = F.when(F.count(value).over(before) == 5, F.avg(value).over(before))
    if cut is None:
        rows = df.withColumn("ratio", F.when(F.col(value).isNotNull() & (mean != 0), F.col(value) / mean)).withColumn("mean_20", s.strict(F.avg, F.col(value), w, 20)).withColumn("_n", F.count(value).over(s.so_far(w)))
    else:
        def pace(known):  # noqa: ANN001, ANN202
            five = known.rowsBetween(-5, -1)
            base = F.when(F.count(value).over(five) == 5, F.avg(value).over(five))
            return {"ratio": F.when(base != 0, F.col(value) / base)}

        means = materialize(scan.in_pieces(df, key, date, 19, lambda rows, k: rows.withColumn("mean_20", s.strict(F.avg, F.col(value), s.over(k, date), 20)), size=cut[1], width=cut[0]))
        rows = scan.running(means, key, date, sums={"_n": F.col(value).isNotNull().cast("int")}, width=cut[0])
        rows = materialize(rows.join(materialize(on_known(df, key, date, value, pace, 5, cut)), [key, date], "left"))
    rows = carried(rows, key, date, "mean_20", lambda known: {"position": s.mid_rank("mean_20", known, WINDOW, LEAST)}, cut)
    known = (F.col("_n") >= 6) & (F.col("ratio").isNotNull() | F.col("position").isNotNull())
    score = _points(F.col("ratio"), RATIO_STRONG, RATIO_WEAK) + _points(F.col("position"), HIGH, LOW)
    enough = F.col("_n") >= 6
    return rows.select(key, date, *(F.when(enough, F.col(c)).alias(c) for c in ("ratio", "mean_20", "position")), F.when(known, score).otherwise(0).alias("score"), _state(known, score).alias("state"))


def overall(*states: Column) -> Column:
    """[M4] Label from how many layers are known and strong."""
    label = market.overall(*states)
    return F.coalesce(*(F.when(label == k, v) for k, v in OVERALL.items()))


def quadrant(position: Column, ratio: Column) -> Column:
    """[M7] Label of place and pace."""
    zone = F.when(position >= QUADRANT_HIGH, "high").when(position <= QUADRANT_LOW, "low").otherwise("mid")
    pace = F.when(ratio >= RATIO_STRONG, "expand").when(ratio <= RATIO_WEAK, "shrink").otherwise("flat")
    named = F.coalesce(*(F.when((zone == z) & (pace == p), QUADRANTS.get((z, p), f"{zt}{pt}{UNCLEAR}")) for z, zt in ZONES.items() for p, pt in PACES.items()))
    return F.when(position.isNotNull() & ratio.isNotNull(), named)


def replay(turnover: DataFrame, margin: DataFrame, basket: DataFrame, index: DataFrame, key: str, date: str, last: int | None = None, confirm: int = 2, cut: Cut = None) -> DataFrame:
    """[M10, M11] A row for each day of turnover (key, date, amount): raw and confirmed states of margin (balance),
    turnover and basket (basket_size, net_5d, net_20d; by exact day), the overall label from the confirmed ones, and the
    quadrant from the index (close).  All days take part; the last `last` of each key are returned."""
    volume = volume_layer(turnover, key, date, "amount", cut).select(key, date, F.col("ratio").alias("volume_ratio"), F.col("position").alias("volume_position"), F.col("score").alias("volume_score"), F.col("state").alias("volume_raw"))
    liquidity = liquidity_layer(margin, key, date, "balance", cut).select(key, date, F.col("change").alias("margin_change"), F.col("position").alias("margin_position"), F.col("score").alias("liquidity_score"), F.col("state").alias("liquidity_raw"))
    if cut is None:
        place = index.where("close is not null").select(key, date, s.mid_rank("close", s.over(key, date), WINDOW, LEAST).alias("index_position"))
        rows = asof_join(asof_join(volume, liquidity, key, date), place, key, date)
    else:
        place = on_known(index, key, date, "close", lambda known: {"index_position": s.mid_rank("close", known, WINDOW, LEAST)}, WINDOW, cut)
        rows = scan.asof(materialize(volume), materialize(liquidity), [key], date, [c for c in liquidity.columns if c not in (key, date)], width=cut[0])
        rows = materialize(scan.asof(materialize(rows), materialize(place), [key], date, ["index_position"], width=cut[0]))
    rows = rows.join(basket, [key, date], "left")
    rows = rows.withColumn("liquidity_raw", F.coalesce("liquidity_raw", F.lit("UNKNOWN"))).withColumn("etf_raw", market.basket_layer(F.coalesce("basket_size", F.lit(0)), F.col("net_5d"), F.col("net_20d")))
    for layer in LAYERS:
        rows = market.confirmed(rows, key, date, f"{layer}_raw", confirm, cut and cut[0]).withColumnRenamed("confirmed", f"{layer}_state")
        rows = rows if cut is None else materialize(rows)
    rows = rows.withColumn("overall_state", overall(*(F.col(f"{x}_state") for x in LAYERS))).withColumn("quadrant", quadrant(F.col("index_position"), F.col("volume_ratio")))
    if last is not None:
        rows = rows.withColumn("_back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date)))).where(F.col("_back") <= last).drop("_back")
    return rows


def transitions(rows: DataFrame, key: str, date: str) -> DataFrame:
    """[M9] Days on which a layer or the overall state changes: changed layers in order, the leading one if it is alone,
    coverage where UNKNOWN takes part, and what it means."""
    w = s.over(key, date)
    now = {x: F.coalesce(f"{x}_state", F.lit("UNKNOWN")) for x in LAYERS}
    out = rows.withColumns({f"_{x}": F.lag(c).over(w) for x, c in now.items()}).withColumn("from_overall", F.lag("overall_state").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    changed = F.array_compact(F.array(*(F.when(F.col(f"_{x}") != c, F.struct(F.lit(x).alias("layer"), F.col(f"_{x}").alias("from"), c.alias("to"))) for x, c in now.items())))
    out = out.where(~F.col("_first")).withColumn("changed", changed).withColumn("overall_changed", ~F.col("from_overall").eqNullSafe(F.col("overall_state")))
    out = out.where((F.size("changed") > 0) | F.col("overall_changed"))
    unknown = F.exists("changed", lambda x: (x["from"] == "UNKNOWN") | (x["to"] == "UNKNOWN"))
    leading = F.when(F.size("changed") == 1, F.col("changed")[0]["layer"])
    meaning = F.when(unknown, COVERAGE_EVENT).otherwise(F.coalesce(*(F.when(leading == k, v) for k, v in SIGNIFICANCE.items()), F.lit(JOINT_EVENT)))
    listed = F.array_join(F.transform("changed", lambda x: F.concat_ws(":", x["layer"], x["from"], x["to"])), ",")
    return out.select(key, date, "overall_changed", "from_overall", F.col("overall_state").alias("to_overall"), listed.alias("changed_layers"), leading.alias("leading_layer"), F.when(unknown, "coverage").otherwise("market").alias("kind"), meaning.alias("significance"))


def normalised(rows: DataFrame, margin_ratio: DataFrame, turnover_ratio: DataFrame, etf: DataFrame, key: str, date: str) -> DataFrame:
    """[M13] The experimental variant: liquidity and volume on series divided by market value (key, date, value), with no
    fallback to absolute levels; the basket layer (etf_state) as it is; overall from the raw states."""
    one = liquidity_layer(margin_ratio, key, date, "value").select(key, date, F.col("state").alias("liquidity_state"))
    two = volume_layer(turnover_ratio, key, date, "value").select(key, date, F.col("state").alias("volume_state"))
    out = rows.select(key, date).join(one, [key, date], "left").join(two, [key, date], "left").join(etf, [key, date], "left")
    states = [F.coalesce(f"{x}_state", F.lit("UNKNOWN")).alias(f"{x}_state") for x in LAYERS]
    return out.select(key, date, *states).withColumn("overall_state", overall(*(F.col(f"{x}_state") for x in LAYERS)))


def step(previous: Column, raw_before: Column, raw: Column) -> Column:
    """[M6] One day's confirmed state from the row before, for a confirmation of at most two days."""
    at_once = previous.isNull() | (raw == "UNKNOWN") | (previous == "UNKNOWN") | (raw == previous)
    return F.when(at_once | (raw == raw_before), raw).otherwise(previous)
