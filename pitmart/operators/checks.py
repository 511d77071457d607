"""Contracts, validation, reconciliation and quarantine [A3, C1-C6]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def contract(df: DataFrame | None, required: list[str], allow_empty: bool = False, spark: SparkSession | None = None) -> DataFrame:
    """[A3] Issues of a frame: none at all (then `spark` is needed), missing columns, emptiness, which reads one row."""
    session = spark if df is None else df.sparkSession
    shape = "rule string, severity string"
    if df is None:
        return session.createDataFrame([("missing_frame", "ERROR")], shape)
    issues = session.createDataFrame([(f"missing_column:{c}", "ERROR") for c in required if c not in df.columns], shape)
    empty = df.limit(1).groupBy().agg(F.count("*").alias("n")).where("n = 0").select(F.lit("empty_frame").alias("rule"), F.lit("WARN" if allow_empty else "ERROR").alias("severity"))
    return issues.unionByName(empty)


def quote_issues() -> Column:
    """[C1] Broken rules of a quote; a null field passes."""
    rules = {"high_below_open_close": F.col("high") < F.greatest("open", "close"), "low_above_open_close": F.col("low") > F.least("open", "close"), "negative_volume": F.col("volume") < 0, "negative_amount": F.col("amount") < 0}
    return F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))


def quarantine(df: DataFrame, issues: str = "issues") -> tuple[DataFrame, DataFrame]:
    """[C6] (rows without issues, one row for each issue of the others)."""
    return df.where(F.size(issues) == 0).drop(issues), df.where(F.size(issues) > 0).withColumn("rule", F.explode(issues)).drop(issues)


def reconcile(values: Column, ratio: float = 0.001) -> tuple[Column, Column]:
    """[C4] Of one value per source, in order: (status, value agreed on)."""
    known = F.filter(values, lambda v: v.isNotNull())
    base = F.element_at(known, 1)
    near = F.forall(known, lambda v: F.when(base == 0, v == 0).otherwise(F.abs(v - base) / F.abs(F.when(base != 0, base).otherwise(1.0)) <= ratio))
    n = F.size(known)
    status = F.when(n == 0, "FAILED").when(n == 1, "PASS").when(near, "VERIFIED").otherwise("CONFLICT")
    return status, F.when((n > 0) & ((n == 1) | near), F.try_element_at(known, F.lit(1)))


def conflict_gate(new: DataFrame, stored: DataFrame, keys: list[str], value: str, ratio: float = 0.001) -> DataFrame:
    """[C5] new with accepted: false where another source's value disagrees with the stored one."""
    old = stored.select(*keys, F.col(value).alias("_old"))
    agrees = F.when(F.col("_old") == 0, F.col(value) == 0).otherwise(F.abs(F.col(value) - F.col("_old")) <= ratio * F.abs(F.col("_old")))
    return new.join(old, keys, "left").withColumn("accepted", F.coalesce(agrees, F.lit(True))).drop("_old")
