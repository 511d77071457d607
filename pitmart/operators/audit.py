"""Invariant audit [O1-O15]: each rule gives rows (rule, severity, dataset, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitmart.operators import series as s


def broken(df: DataFrame, rule: str, severity: str, dataset: str, condition: Column, key: Column) -> DataFrame:
    """[O3-O6, O11] Rows for which the condition holds."""
    return df.where(condition).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(dataset).alias("dataset"), key.cast("string").alias("key"))


def counted(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """[O5, O6] Broken rows of several rules in one pass over a table."""
    counts = df.agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))
    return counts.unpivot([], list(conditions), "rule", "n")


def later_than_facts(derived: DataFrame, facts: DataFrame, key: str, date: str) -> DataFrame:
    """[O9] Keys whose last derived row is after their last fact."""
    a = derived.groupBy(key).agg(F.max(date).alias("derived"))
    b = facts.groupBy(key).agg(F.max(date).alias("fact"))
    return a.join(b, key, "left").where(F.col("fact").isNull() | (F.col("derived") > F.col("fact")))


def _of_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


def non_trading_days(tables: dict[str, tuple[DataFrame, str]], calendar: DataFrame) -> DataFrame:
    """[O1] Days of each table (frame, date column) that lie inside the calendar's coverage but are none of its days."""
    days = _of_all([df.select(F.lit(name).alias("dataset"), F.col(date).cast("date").alias("_at")).distinct() for name, (df, date) in tables.items()])
    known = calendar.select(F.col("trade_date").alias("_day")).distinct()
    bounds = calendar.agg(F.min("trade_date").alias("_lo"), F.max("trade_date").alias("_hi"))  # one row
    inside = days.join(F.broadcast(bounds), F.col("_at").between(F.col("_lo"), F.col("_hi")))
    off = inside.join(known, F.col("_at") == F.col("_day"), "left_anti")
    return off.select(F.lit("non_trading_day").alias("rule"), F.lit("ERROR").alias("severity"), "dataset", F.col("_at").cast("string").alias("key"))


def orphan_rows(pairs: dict[str, tuple[DataFrame, DataFrame]], keys: list[str]) -> DataFrame:
    """[O2] Of each mart (derived, facts) the rows whose key has no fact."""
    mark = lambda df, name: df.select(F.lit(name).alias("dataset"), *keys)
    derived, facts = (_of_all([mark(pair[i], name) for name, pair in pairs.items()]) for i in (0, 1))
    gone = derived.join(facts.distinct(), ["dataset", *keys], "left_anti")
    return gone.select(F.lit("orphan_mart_row").alias("rule"), F.lit("ERROR").alias("severity"), "dataset", F.concat_ws(" ", *keys).alias("key"))


def ahead_of_facts(pairs: dict[str, tuple[DataFrame, DataFrame]], key: str, date: str) -> DataFrame:
    """[O9] Of each mart (derived, facts) the rows dated after the last fact of their key; keys without facts are orphans."""
    mark = lambda df, name: df.select(F.lit(name).alias("dataset"), key, date)
    derived, facts = (_of_all([mark(pair[i], name) for name, pair in pairs.items()]) for i in (0, 1))
    last = facts.groupBy("dataset", key).agg(F.max(date).alias("_last"))
    late = derived.join(last, ["dataset", key]).where(F.col(date) > F.col("_last"))
    return late.select(F.lit("later_than_facts").alias("rule"), F.lit("ERROR").alias("severity"), "dataset", F.concat_ws(" ", key, date, "_last").alias("key"))


def factor_mismatch(factors: DataFrame, multipliers: DataFrame, key: str, date: str, most: float = 1e-9) -> DataFrame:
    """[O12] Factors that differ from the product of the multipliers up to their date, so that a later action cannot
    have been used."""
    days = factors.join(multipliers.groupBy(key, date).agg(F.sum(F.ln("m")).alias("_ln")), [key, date], "left")
    expected = F.exp(F.sum(F.coalesce("_ln", F.lit(0.0))).over(s.so_far(s.over(key, date))))
    return days.withColumn("expected", expected).where(F.abs(F.col("factor") / F.col("expected") - 1) > most).select(key, date, "factor", "expected")


def report(violations: DataFrame, samples: int = 3, strict: bool = False) -> DataFrame:
    """[O14] Counts by rule with the first keys as samples, and whether it fails the audit: errors do, warnings where it is
    strict."""
    w = Window.partitionBy("rule", "severity", "dataset").orderBy("key")
    ranked = violations.withColumn("_rn", F.row_number().over(w))
    found = ranked.groupBy("rule", "severity", "dataset").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_rn") <= samples, F.col("key")))), ",").alias("samples"))
    return found.withColumn("status", F.when((F.col("severity") == "ERROR") | F.lit(strict), "FAIL").otherwise("WARN"))


def unregistered(df: DataFrame, dataset: str, version: str, registered: list[str]) -> DataFrame:
    """[O4, O11] Versions in use that are not registered."""
    return df.select(version).distinct().where(F.col(version).isNotNull() & ~F.col(version).isin(registered)).select(F.lit("unregistered_version").alias("rule"), F.lit("ERROR").alias("severity"), F.lit(dataset).alias("dataset"), F.col(version).alias("key"))


def without_version(df: DataFrame, rule: str, dataset: str, version: str, key: Column, flag: str | None = None) -> DataFrame:
    """[O3, O11] Rows without a version, or without the flag that marks an estimate."""
    missing = F.coalesce(version, F.lit("")) == ""
    if flag is not None:
        missing = missing | ~F.coalesce(flag, F.lit(False))
    return broken(df, rule, "ERROR", dataset, missing, key)


def without_date(df: DataFrame, dataset: str, date: str, key: Column) -> DataFrame:
    """[O7] Rows without their report date; a frame without the column has one violation."""
    if date not in df.columns:
        return df.sparkSession.createDataFrame([("without_report_date", "ERROR", dataset, f"no column {date}")], "rule string, severity string, dataset string, key string")
    return broken(df, "without_report_date", "ERROR", dataset, F.col(date).isNull(), key)


def flows_across_splits(flows: DataFrame, actions: DataFrame, key: str, date: str, days: int = 60, good: str = "flow_v2") -> DataFrame:
    """[O10] Flow rows of other versions with a share factor in the `days` before them and no row of the good version on
    their day.  Actions are few for a key; the range is a filter on the equi-join."""
    old = flows.where(F.col("version") != good).join(flows.where(F.col("version") == good).select(key, date), [key, date], "left_anti")
    splits = actions.where("share_factor is not null and share_factor <> 1").select(key, "action_date")
    near = (F.col("action_date") <= F.col(date)) & (F.col("action_date") > F.date_sub(F.col(date), days))
    return old.where("share_change is not null").join(splits, key).where(near).select(key, date, "version", "action_date")


def dividend_moved_shares(factors: DataFrame, actions: DataFrame, key: str, date: str) -> DataFrame:
    """[O13] Dividend days without any other action on which the share factor differs from the day before."""
    w = s.over(key, date)
    days = factors.withColumn("before", F.lag("share_factor").over(w))
    only = actions.groupBy(key, F.col("action_date").alias(date)).agg(F.bool_and(F.col("action_type") == "DIVIDEND").alias("_only")).where("_only")
    return days.join(only, [key, date]).where("share_factor <> before").select(key, date, "before", "share_factor")
