"""Point-in-time reads [K1-K17]: every block is bounded by an as-of date and brings its own date along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_rows(df: DataFrame, key: str | list[str], date: str, asof: str, version: tuple[str, str] | None = None) -> DataFrame:
    """[K1] Latest row of each key dated asof or before, of one exact version where given."""
    keys = [key] if isinstance(key, str) else key
    df = df.where(F.col(date) <= F.lit(asof).cast("date"))
    if version is not None:
        df = df.where(F.col(version[0]) == version[1])
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(date)))).where("_rn = 1").drop("_rn")


def valid_rows(df: DataFrame, key: str, asof: str, start: str = "valid_from", end: str = "valid_to", tie: str | None = None) -> DataFrame:
    """[K2] The row whose half-open interval holds asof; a null bound is open, the latest start wins, nulls last."""
    day = F.lit(asof).cast("date")
    df = df.where((F.col(start).isNull() | (F.col(start) <= day)) & (F.col(end).isNull() | (F.col(end) > day)))
    order = [F.desc_nulls_last(start), *([F.asc(tie)] if tie else [])]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def observed(value: Column, at: Column, asof: str) -> Column:
    """[K4] A profile field is visible once it was observed; one never observed is hidden."""
    return F.when(at <= F.lit(asof).cast("date"), value)


def mapping_label(mapped: Column, master: Column, historical: bool = True) -> Column:
    """[K5] Where an index mapping comes from.  As of a day the master, which knows the present alone, is never asked: what
    was not mapped by then is missing."""
    label = F.when(mapped.isNotNull(), "mapped_asof")
    return label.otherwise("missing_asof") if historical else label.when(master.isNotNull(), "master_latest")


def with_staleness(df: DataFrame, blocks: dict[str, tuple[str, list[str]]], asof: str, most_days: int, anchor: str | None = None, versions: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """[K6] blocks: name -> (its date column, its value columns).  A block that is missing, dated after asof, older than
    most_days, not of the anchor's day where one is asked for, or not of its version (versions: name -> column and
    expected value), has its values nulled and its reason listed."""
    day = F.lit(asof).cast("date")
    reasons = {}
    for name, (date, _) in blocks.items():
        r = F.when(F.col(date).isNull(), "missing").when(F.col(date) > day, "future_data")
        if anchor is not None:
            r = r.when(~F.col(date).eqNullSafe(F.col(anchor)), "not_same_trade_date")
        r = r.when(F.datediff(day, F.col(date)) > most_days, "stale")
        if versions and name in versions:
            column, expected = versions[name]
            r = r.when(~F.col(column).eqNullSafe(F.lit(expected)), "calculation_version_mismatch")
        reasons[name] = r
    out = df.withColumns({f"_{n}": r for n, r in reasons.items()})
    out = out.withColumns({c: F.when(F.col(f"_{n}").isNull(), F.col(c)) for n, (_, values) in blocks.items() for c in values})
    out = out.withColumns({f"{n}_staleness_days": F.datediff(day, F.col(date)) for n, (date, _) in blocks.items()})
    listed = F.array_compact(F.array(*(F.when(F.col(f"_{n}").isNotNull(), F.concat(F.lit(f"{n}:"), F.col(f"_{n}"))) for n in blocks)))
    out = out.withColumn("stale_blocks", F.array_join(listed, ","))
    return out.withColumn("data_quality", F.when(F.col("stale_blocks") == "", "PASS").otherwise("PARTIAL")).drop(*(f"_{n}" for n in blocks))


def compare(ids: DataFrame, key: str, blocks: list[DataFrame], order: str | None = None) -> DataFrame:
    """[K7] Asked-for ids, known or not, with each as-of block; in the order in which they were asked for (a column)."""
    out = ids
    for b in blocks:
        out = out.join(b, key, "left")
    return out if order is None else out.orderBy(order)


def search(latest: DataFrame, names: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """[K13] Latest quotes whose id or name holds the text, in any case; the name is the quote's, else the master's; the
    largest turnover first."""
    pattern = f"%{text}%"
    out = latest.join(names.select(key, F.col("name").alias("_master")), key, "left").withColumn("name", F.coalesce("name", "_master")).drop("_master")
    return top(out.where(F.col(key).ilike(pattern) | F.col("name").ilike(pattern)), n, F.desc_nulls_last("turnover_amount"), F.asc(key))


def work_list(df: DataFrame, aum: DataFrame, key: str, needed: Column, n: int) -> DataFrame:
    """[K16] Keys for which something is needed, the largest aum first."""
    return top(df.where(needed).select(key).distinct().join(aum, key, "left"), n, F.desc_nulls_last("aum"), F.asc(key))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """[K8, K15] Best rows; the order needs a full tie-break."""
    return df.orderBy(*order).limit(n)


def themes(tags: DataFrame, facts: DataFrame, key: str, least: int, n: int) -> DataFrame:
    """[K11] Per tag and type the distinct funds, their total aum, mean return and flow, greatest coverage and last dates;
    at least `least` funds, the n largest by aum."""
    joined = tags.groupBy(key, "tag", "tag_type").agg(F.max("confidence").alias("coverage")).join(facts, key, "left")
    found = joined.groupBy("tag", "tag_type").agg(
        F.countDistinct(key).alias("funds"), F.sum("aum").alias("aum"), F.avg("ret").alias("mean_return"), F.avg("pct").alias("mean_flow_pct"),
        F.max("coverage").alias("coverage"), F.max("share_date").alias("share_date"), F.max("quote_date").alias("quote_date"),
    )
    return top(found.where(F.col("funds") >= least), n, F.desc_nulls_last("aum"), F.asc("tag"))
