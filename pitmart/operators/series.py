"""Window kit for series keyed by an id and ordered by a date; windows count observations.  Inventory IDs in brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

JUMP = 0.20
YEAR = 242


def over(key: str = "security_id", date: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(date)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def strict(agg, value: Column, w: WindowSpec, n: int) -> Column:  # noqa: ANN001
    """Aggregate of the last n rows, null unless all n are known."""
    return F.when(F.count(value).over(last_rows(w, n)) == n, agg(value).over(last_rows(w, n)))


def step(value: Column, w: WindowSpec) -> Column:
    return value / F.lag(value).over(w) - 1


def jumps(value: Column, w: WindowSpec, n: int | None = None, most: float = JUMP) -> Column:
    """[E7] Whether any one-step change over the whole series so far, or the last n steps, is beyond `most`."""
    frame = so_far(w) if n is None else last_rows(w, n)
    return F.coalesce(F.max(F.abs(F.col("_step"))).over(frame) > most, F.lit(False))


def with_step(df: DataFrame, value: str, w: WindowSpec) -> DataFrame:
    return df.withColumn("_step", step(F.col(value), w))


def simple_return(value: str, w: WindowSpec, n: int) -> Column:
    """Over n steps: n + 1 known rows, no jump, start not zero."""
    start = F.lag(value, n).over(w)
    known = F.count(value).over(w.rowsBetween(-n, 0)) == n + 1
    return F.when(known & ~jumps(F.col(value), w, n) & (start != 0), F.col(value) / start - 1)


def volatility(value: str, w: WindowSpec, n: int) -> Column:
    """Annualised sample deviation of the last n log returns, on known rows."""
    logs = F.col("_log")
    frame = last_rows(w, n)
    return F.when((F.count(logs).over(frame) == n) & ~jumps(F.col(value), w, n), F.stddev_samp(logs).over(frame) * F.sqrt(F.lit(float(YEAR))))


def fold_drawdown(prices: Column) -> Column:
    """Largest fall from a running peak of an array, 0 or less."""
    start = F.struct(F.lit(float("-inf")).alias("p"), F.lit(0.0).alias("m"))
    return F.aggregate(prices, start, lambda s, y: F.struct(F.greatest(s["p"], y).alias("p"), F.least(s["m"], y / F.greatest(s["p"], y) - 1).alias("m")), lambda s: s["m"])


def max_drawdown(value: str, w: WindowSpec, n: int) -> Column:
    """Over the last n known prices; frames are at most n long."""
    frame = last_rows(w, n)
    return F.when((F.count(value).over(frame) == n) & ~jumps(F.col(value), w, n - 1), fold_drawdown(F.collect_list(value).over(frame)))


def current_drawdown(value: str, w: WindowSpec) -> Column:
    """Against the peak of all known history; null after any jump."""
    return F.when(~jumps(F.col(value), w), F.col(value) / F.max(value).over(so_far(w)) - 1)


def run_length(flag: Column, df: DataFrame, key: str, date: str) -> DataFrame:
    """Adds _run: rows since `flag` last changed, by gaps and islands."""
    w = over(key, date)
    df = df.withColumn("_flag", flag)
    df = df.withColumn("_island", F.sum(F.when(F.col("_flag").eqNullSafe(F.lag("_flag").over(w)), 0).otherwise(1)).over(so_far(w)))
    return df.withColumn("_run", F.row_number().over(Window.partitionBy(key, "_island").orderBy(date)))


def mid_rank(value: str, w: WindowSpec, n: int, least: int) -> Column:
    """[L4] (below + equal / 2) / count of the value among the last n known ones, itself included."""
    values = F.collect_list(value).over(last_rows(w, n))
    now = F.col(value)
    below, equal = F.size(F.filter(values, lambda x: x < now)), F.size(F.filter(values, lambda x: x == now))
    return F.when(F.size(values) >= least, (below + equal / 2) / F.size(values))
