"""Versions and records put together from many blocks [I4, I5, I8, I9, K3, K12]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitmart.operators import metrics, pit
from pitmart.operators import series as s

# fixed values
VERSIONS = {"metric": "metric_v2", "flow": "flow_v2", "adjust": "adjust_v1", "peer": "peer_v1", "market_norm": "market_norm_v1"}
REGISTERED = ("metric_v1", "flow_v1", "pulse_v2", "tag_v1", "adjust_v1", "flow_v2", "metric_v2", "benchmark_v1", "peer_v1", "market_norm_v1", "pulse_v3_experimental")


def version_for(block: str) -> str:
    """[K3] The version that research reads of a block; an unknown block is an error."""
    if block not in VERSIONS:
        raise KeyError(f"no version for {block}; known: {sorted(VERSIONS)}")
    return VERSIONS[block]


def production_rows(df: DataFrame, block: str, column: str = "version") -> DataFrame:
    """[K3] The rows of a block's version."""
    return df.where(F.col(column) == version_for(block))


def candidates(master: DataFrame, quotes: DataFrame, shares: DataFrame, flows: DataFrame, tags: DataFrame, mapping: DataFrame, fund: str, asof: str) -> DataFrame:
    """[I4] Funds with a quote as of a day: its date, last estimated aum, last 20-day share change, the least industry tag
    and the index mapping valid then, and the fee if it was observed."""
    day = F.lit(asof).cast("date")
    quoted = quotes.where(F.col("trade_date") <= day).groupBy(fund).agg(F.max("trade_date").alias("quote_date"))
    aum = pit.asof_rows(shares, fund, "trade_date", asof).select(fund, "aum")
    flow = pit.asof_rows(flows, fund, "trade_date", asof).select(fund, F.col("share_change_20d").alias("flow"))
    valid = tags.where("tag_type = 'industry'").where((F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)))
    tag = valid.groupBy(fund).agg(F.min("tag").alias("tag"))
    mapped = pit.valid_rows(mapping, fund, asof, tie="index_id").select(fund, "index_id", "index_name")
    out = master.select(fund, pit.observed(F.col("fee"), F.col("observed"), asof).alias("fee")).join(quoted, fund)
    for block in (aum, flow, tag, mapped):
        out = out.join(block, fund, "left")
    return out


def security_facts(quotes: DataFrame, index: DataFrame, fund: str, asof: str) -> DataFrame:
    """[I5] Per security as of a day: mean turnover of its last 20 rows, deviation of its last 20 known premiums, and
    60-day tracking error on its last row, for price indexes alone (columns index_id and basis of quotes)."""
    day = F.lit(asof).cast("date")
    rows = quotes.where(F.col("trade_date") <= day)
    w = s.over(fund)
    turnover = metrics.latest(rows.withColumn("turnover", s.strict(F.avg, F.col("turnover_amount"), w, 20)), fund, "trade_date").select(fund, "turnover")
    premium = metrics.latest(metrics.premium_stats(rows, fund, "trade_date", "premium"), fund, "trade_date").select(fund, F.col("deviation").alias("premium_stability"))
    priced = rows.where("basis = 'price_index'")
    error = metrics.latest(metrics.tracking(priced, index.where(F.col("trade_date") <= day), fund, "trade_date", "close", "ic", (60,), ("index_id",)), fund, "trade_date").select(fund, F.col("error_60").alias("tracking_error"))
    return turnover.join(premium, fund, "full_outer").join(error, fund, "full_outer")


def peer_group_asof(asked: DataFrame, snapshots: DataFrame, current: DataFrame, fund: str, asof: str | None, fall_back: bool = False) -> DataFrame:
    """[I8] The group of each asked-for fund from the last daily snapshot up to asof; the current group where there is
    none and no day is asked for, or falling back is allowed; with where it is from."""
    last = snapshots if asof is None else snapshots.where(F.col("asof_date") <= F.lit(asof).cast("date"))
    last = metrics.latest(last, fund, "asof_date").select(fund, F.col("peer_group").alias("_snapshot"), "peer_count", "asof_date")
    out = asked.join(last, fund, "left").join(current.select(fund, F.col("peer_group").alias("_current"), F.col("peer_count").alias("_count")), fund, "left")
    usable = asof is None or fall_back
    other = F.col("_current").isNotNull() & F.lit(usable)
    label = F.when(F.col("_snapshot").isNotNull(), "asof_snapshot").when(other, "current" if asof is None else "current_fallback").otherwise("missing")
    pick = lambda a, b: F.when(F.col("_snapshot").isNotNull(), F.col(a)).when(other, F.col(b))
    return out.select(fund, pick("_snapshot", "_current").alias("peer_group"), pick("peer_count", "_count").alias("peer_count"), label.alias("peer_group_pit"), "asof_date")


def tracking_quality(groups: DataFrame, marts: DataFrame, fund: str) -> DataFrame:
    """[I9] The tracking part of a peer comparison."""
    return groups.select(fund, "peer_group", "peer_count").join(marts.select(fund, "tracking_error_rank_pct"), fund, "left")


def core_record(quotes: DataFrame, blocks: dict[str, DataFrame], fund: str, reasons: dict[str, Column], derived: dict[str, Column] | None = None) -> DataFrame:
    """[K12] One record for each quoted fund: the columns of its quote and of each block (fund, <block>_date, ...), fields
    derived from several blocks, a map from a field that is unknown to why, which may depend on all fields, a map of the
    blocks' dates, and PASS where nothing is unknown."""
    out = quotes
    for b in blocks.values():
        out = out.join(b, fund, "left")
    out = out.withColumns(derived or {})
    found = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("key"), why.alias("value"))) for c, why in reasons.items())))
    dates = F.map_from_arrays(F.array(*(F.lit(n) for n in ("quote", *blocks))), F.array(*(F.col(f"{n}_date") for n in ("quote", *blocks))))
    out = out.withColumn("reasons", F.map_from_entries(found)).withColumn("dates", dates)
    return out.withColumn("status", F.when(F.size("reasons") == 0, "PASS").otherwise("WARN"))
