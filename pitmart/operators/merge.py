"""Keyed merges of fact tables [A4-A7, B20]: a known value is never erased by a null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_keyed(old: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str] = (), keep: list[str] = (), order: str | None = None) -> DataFrame:
    """[A4] Of each column the new value over the old one; `overwrite` takes the new value even if null, `keep` the old
    one while it is known [A5].  New rows of one key count as the last by `order`."""
    if order is not None:
        new = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in values), F.lit(True).alias("_in_old"))
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in values), F.lit(True).alias("_in_new"))
    both = o.join(n, keys, "full_outer")

    def pick(c: str):  # noqa: ANN202
        if c in overwrite:
            return F.when(F.col("_in_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))
        return F.coalesce(f"_o_{c}", f"_n_{c}") if c in keep else F.coalesce(f"_n_{c}", f"_o_{c}")

    return both.select(*keys, *(pick(c).alias(c) for c in values))


def without_orphans(derived: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """[A7] Derived rows that still have a fact on their key."""
    return derived.join(facts.select(*keys).distinct(), keys, "left_semi")


def orphans(derived: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """[O2]"""
    return derived.join(facts.select(*keys).distinct(), keys, "left_anti")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """[O15] Keys with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
