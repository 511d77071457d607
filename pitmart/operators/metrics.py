"""Returns, risk, liquidity [F1-F9], benchmark [H2-H4] over daily panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitmart.operators import series as s

RETURNS, VOLATILITIES, DRAWDOWNS, TURNOVERS = (1, 5, 20, 60), (20, 60), (60, 250), (5, 20, 60)


def daily_metrics(quotes: DataFrame, key: str = "security_id", date: str = "trade_date", price: str = "close", turnover: str = "turnover_amount") -> DataFrame:
    """All metrics on every date.  One shuffle by key; price metrics count known prices, turnover metrics rows."""
    w = s.over(key, date)
    amounts = {f"avg_turnover_{n}d": s.strict(F.avg, F.col(turnover), w, n) for n in TURNOVERS}
    rows = quotes.withColumns(amounts).where(F.col(price).isNotNull())
    rows = s.with_step(rows, price, w).withColumn("_log", F.ln(F.col(price) / F.lag(price).over(w)))
    found = {f"return_{n}d": s.simple_return(price, w, n) for n in RETURNS}
    found |= {f"volatility_{n}d": s.volatility(price, w, n) for n in VOLATILITIES}
    found |= {f"max_drawdown_{n}d": s.max_drawdown(price, w, n) for n in DRAWDOWNS}
    found["current_drawdown"] = s.current_drawdown(price, w)
    return rows.withColumns(found).select(key, date, *found, *amounts)


def latest(df: DataFrame, key: str, date: str, asof: str | None = None) -> DataFrame:
    """[K1, F8] Last row of each key up to asof."""
    if asof is not None:
        df = df.where(F.col(date) <= F.lit(asof).cast("date"))
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date)))).where("_rn = 1").drop("_rn")


def spread(bid: str, ask: str) -> tuple:
    """Absolute and relative spread; null for missing, non-positive or crossed quotes."""
    valid = (F.col(bid) > 0) & (F.col(ask) > 0) & (F.col(ask) >= F.col(bid))
    width = F.when(valid, F.col(ask) - F.col(bid))
    return width, width / ((F.col(ask) + F.col(bid)) / 2)


def premium_stats(df: DataFrame, key: str, date: str, premium: str, n: int = 20) -> DataFrame:
    """Of the last n known premiums: mean, sample deviation, mean absolute value, count."""
    w = s.last_rows(s.over(key, date), n)
    rows = df.where(F.col(premium).isNotNull())
    return rows.select(key, date, F.avg(premium).over(w).alias("mean"), F.stddev_samp(premium).over(w).alias("deviation"), F.avg(F.abs(premium)).over(w).alias("mean_abs"), F.count(premium).over(w).alias("n"))


# fixed values: keyword in an index name -> basis, in this order
BASES = {"全收益": "total_return_index", "净收益": "net_total_return_index", "价格": "price_index"}
UNKNOWN_BASIS, TOTAL_BASIS, SHORT, JUMPED = "benchmark_return_basis_unknown", "total_return_basis_not_supported_yet", "insufficient_aligned_history", "nav_not_adjusted_for_corporate_actions"


def return_basis(name: Column) -> Column:
    """[H1] Which return an index name speaks of."""
    found = [F.when(name.contains(word), basis) for word, basis in BASES.items()]
    return F.coalesce(*found, F.lit("unknown"))


def tracking(nav: DataFrame, index: DataFrame, key: str, date: str, nav_value: str, index_value: str, windows: tuple[int, ...] = (20, 60, 250), by: tuple[str, ...] = (), basis: str | None = None, told: bool = False) -> DataFrame:
    """[H2-H4] NAV against its index (joined on date and `by`) on every common day, per window: returns of both ends,
    the difference of the two returns since the first common day, and the annualised deviation of the gaps of daily returns, each taken on its own series.  Only
    positive values count.  The difference has a reason where it is refused: the basis (a column of nav) unknown or of
    total return, no window + 1 common rows, a jump of the NAV inside the window.  told: the index is small, as few lines
    are, and told to every task, so that a long nav stays where it is."""
    w = s.over(key, date)
    own = nav.where(F.col(nav_value) > 0)
    own = own.withColumn("_rn", F.col(nav_value) / F.lag(nav_value).over(w) - 1).withColumn("_step", F.col("_rn"))
    jumped = {n: F.coalesce(F.max(F.abs("_step")).over(s.last_rows(w, n)) > s.JUMP, F.lit(False)) for n in windows}
    own = own.withColumns({f"_own_{n}": j for n, j in jumped.items()})
    market = index.where(F.col(index_value) > 0)
    iw = Window.partitionBy(*(by or (F.lit(0),))).orderBy(date)
    market = market.select(date, *by, index_value, (F.col(index_value) / F.lag(index_value).over(iw) - 1).alias("_ri"))
    both = own.join(F.broadcast(market) if told else market, [date, *by]).withColumn("_gap", F.col("_rn") - F.col("_ri")).withColumn("_step", s.step(F.col(nav_value), w))
    out, since = {}, s.so_far(w)
    for n in windows:
        frame, longer = s.last_rows(w, n), s.last_rows(w, n + 1)
        full = F.count(nav_value).over(longer) == n + 1
        ends = {c: F.when(full, F.col(c) / F.first(c).over(longer) - 1) for c in (nav_value, index_value)}
        # the first n steps lie between n + 1 common rows
        jump = F.coalesce(F.max(F.abs("_step")).over(frame) > s.JUMP, F.lit(False))
        reason = F.when(~full, SHORT).when(jump, JUMPED)
        if basis is not None:
            reason = F.when(F.col(basis) == "unknown", UNKNOWN_BASIS).when(F.col(basis) == "total_return_index", TOTAL_BASIS).otherwise(reason)
        out[f"nav_return_{n}"], out[f"index_return_{n}"] = ends[nav_value], ends[index_value]
        out[f"difference_{n}"] = F.when(reason.isNull(), F.col(nav_value) / F.first(nav_value).over(since) - F.col(index_value) / F.first(index_value).over(since))
        out[f"reason_{n}"] = reason
        out[f"error_{n}"] = F.when((F.count("_gap").over(frame) >= min(40, n)) & ~F.col(f"_own_{n}"), F.stddev_samp("_gap").over(frame) * F.sqrt(F.lit(float(s.YEAR))))
    return both.withColumns(out).select(key, date, *out)


def tracking_input(rows: DataFrame, key: str, date: str, adjusted: str, source_adjusted: str, unit: str, cross_border: str) -> DataFrame:
    """[H5] One NAV series for each key: the own adjusted one where it has any row, else the source's, else the unit NAV if
    that never jumps; none, with a reason, for funds across borders.  (key, date, nav, origin, reason)."""
    everything = Window.partitionBy(key)
    known = rows.where(F.col(unit).isNotNull())
    jumps = known.withColumn("_step", s.step(F.col(unit), s.over(key, date))).groupBy(key).agg(F.coalesce(F.max(F.abs("_step")) > s.JUMP, F.lit(False)).alias("_jumps"))
    has = {c: F.count(c).over(everything) > 0 for c in (adjusted, source_adjusted)}
    out = rows.withColumns({f"_has_{c}": h for c, h in has.items()}).join(jumps, key, "left")
    reason = F.when(F.col(cross_border), "cross_border_alignment_not_supported").when(~F.col(f"_has_{adjusted}") & ~F.col(f"_has_{source_adjusted}") & F.coalesce("_jumps", F.lit(False)), JUMPED)
    origin = F.when(F.col(f"_has_{adjusted}"), "adjusted").when(F.col(f"_has_{source_adjusted}"), "source_adjusted").otherwise("unit")
    value = F.when(F.col("origin") == "adjusted", F.col(adjusted)).when(F.col("origin") == "source_adjusted", F.col(source_adjusted)).otherwise(F.col(unit))
    out = out.withColumn("reason", reason).withColumn("origin", F.when(reason.isNull(), origin))
    return out.select(key, date, F.when(F.col("reason").isNull(), value).alias("nav"), "origin", "reason")
