"""Trading calendar [D1-D5].  A calendar is thousands of dates at most, one series by nature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitmart.operators import scan


def guard(df: DataFrame, calendar: DataFrame, date: str) -> DataFrame:
    """[C3, D1] covered: inside the calendar's bounds; rejected: covered, but no trading day."""
    bounds = calendar.agg(F.min("trade_date").alias("_lo"), F.max("trade_date").alias("_hi"))
    known = calendar.select(F.col("trade_date").alias("_day")).distinct()
    out = df.join(F.broadcast(bounds)).join(F.broadcast(known), F.col(date) == F.col("_day"), "left")
    covered = F.col(date).between(F.col("_lo"), F.col("_hi"))
    return out.withColumn("covered", covered).withColumn("rejected", covered & F.col("_day").isNull()).drop("_lo", "_hi", "_day")


def around(days: DataFrame, calendar: DataFrame, date: str) -> DataFrame:
    """[D2] Of each day the latest trading day (<=) and the previous one (<), by carrying the last known forward in
    segments of the calendar; nothing for a null day."""
    one = F.lit("calendar").alias("_line")
    asked = days.select(one, F.col(date).alias("_day")).where(F.col(date).isNotNull()).distinct()
    known = calendar.select(one, F.col("trade_date").alias("_day"), F.col("trade_date").alias("latest"), F.col("trade_date").alias("previous"))
    found = scan.asof(asked, known, ["_line"], "_day", ["latest"])
    found = scan.asof(found, known, ["_line"], "_day", ["previous"], strict=True)
    return days.select(date).distinct().join(found.drop("_line"), F.col(date) == F.col("_day"), "left").select(date, "latest", "previous")


def days_back(calendar: DataFrame, asof: str, n: int) -> DataFrame:
    """[D3] The last n trading days up to asof with their distance."""
    days = calendar.where(F.col("trade_date") <= F.lit(asof).cast("date")).select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(n)
    return days.withColumn("back", F.row_number().over(Window.orderBy(F.desc("trade_date"))) - 1)


def freshness(datasets: dict[str, tuple[DataFrame, str]], calendar: DataFrame, asof: str) -> DataFrame:
    """[D5] Last date of each dataset and its lag in trading days; null when it is after asof."""
    out = None
    for name, (df, date) in datasets.items():
        one = df.agg(F.max(F.col(date).cast("date")).alias("last_date")).select(F.lit(name).alias("dataset"), "last_date")
        out = one if out is None else out.unionByName(one)
    day = F.lit(asof).cast("date")
    late = out.join(calendar.select("trade_date").distinct(), (F.col("trade_date") > F.col("last_date")) & (F.col("trade_date") <= day), "left")
    return late.groupBy("dataset", "last_date").agg(F.count("trade_date").alias("n")).select("dataset", "last_date", F.when(F.col("last_date") <= day, F.col("n")).alias("lag"))


def closed_days(times: DataFrame, calendar: DataFrame, at: str, ready_hour: int = 17) -> DataFrame:
    """[D4] The latest trading day whose data are out at a time: today's from ready_hour on, else the one before."""
    stamped = times.select(at).distinct().withColumn("_today", F.col(at).cast("date"))
    known = around(stamped, calendar, "_today")
    rows = stamped.join(known, "_today")
    early = (F.col("latest") == F.col("_today")) & (F.hour(at) < ready_hour)
    return rows.select(at, F.when(early, F.col("previous")).otherwise(F.col("latest")).alias("closed_day"))
