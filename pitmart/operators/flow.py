"""Share flows [G1-G10]: every date at once, in windows of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitmart.operators import scan
from pitmart.operators import series as s

WINDOWS = (1, 5, 20, 60)
STREAKS = ("inflow_days", "outflow_days")


def daily_flows(shares: DataFrame, key: str = "security_id", date: str = "trade_date", count: str = "shares", nav: str = "nav") -> DataFrame:
    """[G1-G3, G9] Share changes, estimated subscriptions and streaks on every date, in one shuffle by key."""
    w = s.over(key, date)
    rows = shares.withColumn("_delta", F.col(count) - F.lag(count).over(w)).withColumn("_money", F.col("_delta") * F.col(nav))
    found = {}
    for n in WINDOWS:
        known = F.count(count).over(w.rowsBetween(-n, 0)) == n + 1
        start = F.lag(count, n).over(w)
        found[f"share_change_{n}d"] = F.when(known, F.col(count) - start)
        found[f"share_change_pct_{n}d"] = F.when(known & (start != 0), (F.col(count) - start) / start)
        found[f"net_subscription_{n}d"] = F.when(F.count("_money").over(s.last_rows(w, n)) == n, F.sum("_money").over(s.last_rows(w, n)))
    return rows.withColumns(found).select(key, date, *found)


def adjusted_flows(adjusted: DataFrame, key: str = "security_id", date: str = "trade_date", shares: str = "adjusted_shares", nav: str = "adjusted_nav", factor: str = "factor") -> DataFrame:
    """[G6, G9] Flows on back-adjusted series for every date: share changes in units of the row's own factor, their percent
    of the base in the same units, money flows, streaks, and whether more than one factor was seen so far."""
    w = s.over(key, date)
    rows = adjusted.withColumn("_delta", F.col(shares) - F.lag(shares).over(w)).withColumn("_money", F.col("_delta") * F.col(nav)).withColumn("_factor", F.coalesce(factor, F.lit(1.0)))
    found = {}
    for n in WINDOWS:
        frame = s.last_rows(w, n)
        change = F.when(F.count("_delta").over(frame) == n, F.sum("_delta").over(frame) * F.col("_factor"))
        base = F.lag(shares, n).over(w) * F.col("_factor")
        found[f"share_change_{n}d"] = change
        found[f"share_change_pct_{n}d"] = F.when(base != 0, change / base)
        found[f"net_subscription_{n}d"] = F.when(F.count("_money").over(frame) == n, F.sum("_money").over(frame))
    seen = s.so_far(w)
    quality = F.when(F.coalesce(F.min(factor).over(seen) != F.max(factor).over(seen), F.lit(False)), "adjusted").otherwise("clean")
    return _streaked(rows.withColumns(found).withColumn("quality", quality), key, date).select(key, date, *found, "quality", *STREAKS)


def streaks(shares: DataFrame, key: str = "security_id", date: str = "trade_date", count: str = "shares") -> DataFrame:
    """[G3] Consecutive days of inflow and of outflow that end at the row; rows without a difference are passed over."""
    w = s.over(key, date)
    rows = shares.withColumn("_delta", F.col(count) - F.lag(count).over(w))
    return _streaked(rows, key, date).where("_delta is not null").select(key, date, *STREAKS)


def _streaked(rows: DataFrame, key: str, date: str) -> DataFrame:
    """rows with the consecutive days of a positive and of a negative _delta, 0 for a row without one, in the same shuffle."""
    w = s.over(key, date)
    flag = F.signum("_delta")
    turned = flag.isNotNull() & ~F.coalesce(flag == F.last(flag, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("_island", F.sum(F.when(turned, 1).otherwise(0)).over(s.so_far(w)))
    run = F.count("_delta").over(s.so_far(Window.partitionBy(key, "_island").orderBy(date))).cast("int")
    days = lambda sign: F.coalesce(F.when(sign, run), F.lit(0))
    return rows.withColumns({"inflow_days": days(F.col("_delta") > 0), "outflow_days": days(F.col("_delta") < 0)})


def cumulative(df: DataFrame, key: str, date: str, value: str, width: int | None = None) -> DataFrame:
    """[G8] Running total; a null day is null and the total is carried over it.  width: days of a line that one task scans,
    for few long lines; without it a line is one task."""
    if width is not None:
        return scan.running(df, key, date, sums={"_total": F.col(value)}, width=width).select(key, date, F.when(F.col(value).isNotNull(), F.col("_total")).alias("total"))
    return df.select(key, date, F.when(F.col(value).isNotNull(), F.sum(value).over(s.so_far(s.over(key, date)))).alias("total"))


def nav_coalesce(shares: DataFrame, navs: DataFrame, key: str, date: str) -> DataFrame:
    """[G4, B25] The share row's NAV, else the same day's from the NAV table, with its origin."""
    other = navs.select(key, date, F.col("nav").alias("_nav"))
    return shares.join(other, [key, date], "left").select(key, date, "shares", F.coalesce("nav", "_nav").alias("nav"), F.when(F.col("nav").isNotNull(), "share_row").when(F.col("_nav").isNotNull(), "nav_table").alias("nav_source"))


def mechanical_split(shares: DataFrame, factors: DataFrame, key: str, date: str) -> DataFrame:
    """[G5, E6] Of a day's share change the part that a share factor k explains, previous * (k - 1), and the rest; without
    shares that day or before both parts are null and the day is clean."""
    w = s.over(key, date)
    k = factors.groupBy(key, date).agg(F.product("k").alias("k"))
    rows = shares.withColumn("_prev", F.lag("shares").over(w)).join(k, [key, date], "left").withColumn("k", F.coalesce("k", F.lit(1.0)))
    known = F.col("_prev").isNotNull() & F.col("shares").isNotNull()
    part = lambda c, name: F.when(known, c).alias(name)
    return rows.select(key, date, part(F.col("_prev") * (F.col("k") - 1), "mechanical"), part(F.col("shares") - F.col("_prev") * F.col("k"), "economic"), F.when(known & (F.col("k") != 1), "adjusted").otherwise("clean").alias("quality"))


def basket_flow(flows: DataFrame, members: DataFrame, key: str, date: str, flow: str) -> DataFrame:
    """[G10, L12] Flow of a basket by day with contributors and members; a day without a contributor is null."""
    sizes = members.groupBy("basket").agg(F.countDistinct(key).alias("members"))
    joined = flows.join(members.select(key, "basket").distinct(), key)
    days = joined.groupBy("basket", date).agg(F.sum(flow).alias("flow"), F.count(flow).alias("contributors"))
    return days.join(sizes, "basket").select("basket", date, "flow", "contributors", "members")
