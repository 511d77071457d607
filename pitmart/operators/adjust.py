"""Corporate actions and back-adjustment [E1-E6]: three independent factors of price, NAV and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitmart.operators import scan
from pitmart.operators import series as s

CHANNELS = ("price", "nav", "shares")


def effective_dates(actions: DataFrame, days: DataFrame, key: str = "security_id", date: str = "trade_date") -> DataFrame:
    """[E1] actions with effective_price, the first day with a close strictly after; effective_fund, the first day with a
    NAV or shares on or after; and p, the last close strictly before.  Actions and days (close, nav, shares) are one
    ordered table, so a long history is passed once and never joined."""
    given = [c for c in actions.columns if c != key]
    one = actions.select(key, F.col("action_date").alias("_at"), F.lit(True).alias("_is"), *given, *(F.lit(None).cast("double").alias(f"_{c}") for c in ("close", "nav", "shares")))
    two = days.select(key, F.col(date).alias("_at"), F.lit(False).alias("_is"), *(F.lit(None).cast(actions.schema[c].dataType).alias(c) for c in given), *(F.col(c).cast("double").alias(f"_{c}") for c in ("close", "nav", "shares")))
    back = Window.partitionBy(key)
    before = (Window.unboundedPreceding, -1)
    later = back.orderBy(F.desc("_at"), F.desc("_is")).rowsBetween(*before)
    since = back.orderBy(F.desc("_at"), F.asc("_is")).rowsBetween(*before)
    earlier = back.orderBy(F.asc("_at"), F.desc("_is")).rowsBetween(*before)
    rows = one.unionByName(two)
    out = rows.withColumns({
        "effective_price": F.last(F.when(F.col("_close").isNotNull(), F.col("_at")), ignorenulls=True).over(later),
        "effective_fund": F.last(F.when(F.col("_nav").isNotNull() | F.col("_shares").isNotNull(), F.col("_at")), ignorenulls=True).over(since),
        "p": F.last("_close", ignorenulls=True).over(earlier),
    })
    return out.where("_is").select(key, *given, "effective_price", "effective_fund", "p")


def multipliers(actions: DataFrame, days: DataFrame, key: str = "security_id", date: str = "trade_date") -> tuple[DataFrame, DataFrame]:
    """[E2, E3, E5] (key, date, channel, action_type, m), and refused actions, each rule and action once.  Whatever
    is no dividend, of type OTHER too, multiplies all channels by its ratio k; a dividend d price and NAV by P / (P - d), shares by 1.  Refused: no close
    before, d null, 0, negative or not under P, and a ratio null, 0 or negative."""
    found = effective_dates(actions, days, key, date)
    split = F.coalesce(F.col("action_type") != "DIVIDEND", F.lit(True))
    reason = (
        F.when(split & ~F.coalesce(F.col("k") > 0, F.lit(False)), "bad_ratio")
        .when(~split & (F.col("p").isNull() | ~F.coalesce(F.col("d") > 0, F.lit(False))), "no_previous_close_or_amount")
        .when(~split & (F.col("d") >= F.col("p")), "dividend_not_under_price")
    )
    found = found.withColumn("reason", reason)
    paid = F.when(split, F.col("k")).otherwise(F.col("p") / (F.col("p") - F.col("d")))
    by_channel = F.array(*(F.struct(F.lit(c).alias("channel"), F.col("effective_price" if c == "price" else "effective_fund").alias("at"), (F.when(split, F.col("k")).otherwise(1.0) if c == "shares" else paid).alias("m")) for c in CHANNELS))
    good = found.where("reason is null").select(key, "action_type", F.explode(by_channel).alias("x")).where("x.at is not null")
    return good.select(key, F.col("x.at").alias(date), F.col("x.channel").alias("channel"), "action_type", F.col("x.m").alias("m")), found.where("reason is not null").select(key, "action_date", "action_type", "reason").dropDuplicates()


def adjusted(days: DataFrame, factors: DataFrame, key: str = "security_id", date: str = "trade_date", width: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """[E4] Close times the running product of price factors up to its date, NAV times that of NAV factors, shares by that
    of share factors; the legacy factor is the NAV's.  Factors are multiplied in order of their days, so that ratios
    which doubles hold exactly have exact products.  Days and factors are one ordered table, a day's factors before the
    day, so that no join deals the days again; factors of no day are none.  keep: further columns of days.
    width: days of a line that one task scans, for few long lines."""
    names = [f"_{c}" for c in CHANNELS]
    daily = factors.where(F.col(key).isNotNull()).groupBy(key, date).agg(*(F.product(F.when(F.col("channel") == c, F.col("m"))).alias(f"_{c}") for c in CHANNELS))
    rows = days.withColumns({n: F.lit(None).cast("double") for n in names} | {"_day": F.lit(True)}).unionByName(daily.withColumn("_day", F.lit(False)), allowMissingColumns=True)
    if width is not None:
        rows = scan.segmented(rows, date, width)
    w = Window.partitionBy(key, *([scan.SEGMENT] if width is not None else [])).orderBy(date, "_day")
    told = ~F.lag("_day").over(w) & (F.lag(date).over(w) == F.col(date))
    rows = rows.withColumns({n: F.coalesce(F.when(told, F.lag(n).over(w)), F.lit(1.0)) for n in names}).where("_day").drop("_day")
    if width is not None:
        rows = scan.running(rows, key, date, products={f"{c}_factor": F.col(f"_{c}") for c in CHANNELS}, width=width)
    else:
        rows = rows.withColumns({f"{c}_factor": F.product(f"_{c}").over(s.so_far(s.over(key, date))) for c in CHANNELS})
    return rows.select(
        key, date, *(f"{c}_factor" for c in CHANNELS), F.col("nav_factor").alias("factor"),
        (F.col("close") * F.col("price_factor")).alias("adjusted_close"), (F.col("nav") * F.col("nav_factor")).alias("adjusted_nav"), (F.col("shares") / F.col("shares_factor")).alias("adjusted_shares"), *keep,
    )
