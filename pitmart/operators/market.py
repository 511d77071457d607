"""Market layer and states [L1-L9, M1-M9] and their validation [N1-N7]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitmart.operators import scan
from pitmart.operators import series as s


def totals(turnover: DataFrame) -> DataFrame:
    """[L1] Both exchanges summed by day, with how many reported."""
    return turnover.groupBy("trade_date").agg(F.sum("turnover_amount").alias("amount"), F.max("rate").alias("rate"), F.countDistinct("exchange").alias("exchanges"))


def change_pct(df: DataFrame, key: str, date: str, value: str, n: int) -> DataFrame:
    """[L3] Change over the last n known observations, in percent."""
    start = F.lag(value, n).over(s.over(key, date))
    return df.where(F.col(value).isNotNull()).select(key, date, F.when(start != 0, (F.col(value) / start - 1) * 100).alias("change_pct"))


def index_position(index: DataFrame, key: str, date: str, close: str, n: int = 250, least: int = 60, size: int | None = None) -> DataFrame:
    """[L4, L6] Mid-rank percentile of the close among the last n, and its fall from their peak.  size: rows of a line that
    one task has, for few long lines."""
    known = index.where(F.col(close).isNotNull())
    if size is not None:
        return scan.in_pieces(known, key, date, n - 1, lambda rows, key: index_position(rows, key, date, close, n, least), size=size)
    w = s.over(key, date)
    return known.select(key, date, s.mid_rank(close, w, n, least).alias("position"), (F.col(close) / F.max(close).over(s.last_rows(w, n)) - 1).alias("from_peak"))


def monthly(df: DataFrame, date: str, value: str) -> DataFrame:
    """[L8] Totals of each month and how many values are missing."""
    return df.groupBy(F.trunc(date, "month").alias("month")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.count_if(F.col(value).isNull()).alias("missing"))


def recent_against_previous(months: DataFrame, value: str, n: int = 3) -> DataFrame:
    """[L9] Of each month the n complete months before it against the n before those."""
    w = Window.partitionBy(F.lit(0)).orderBy("month")
    near, far = w.rowsBetween(-n, -1), w.rowsBetween(-2 * n, -n - 1)
    recent = F.when(F.count("*").over(near) == n, F.sum(value).over(near))
    previous = F.when(F.count("*").over(far) == n, F.sum(value).over(far))
    return months.select("month", recent.alias("recent"), previous.alias("previous"), F.when(previous > 0, (recent / previous - 1) * 100).alias("change_pct"))


def basket_layer(size: Column, five: Column, twenty: Column) -> Column:
    """[M3] Each known flow scores +1 if positive, else -1, zero too."""
    points = F.coalesce(F.when(five > 0, 1).when(five.isNotNull(), -1), F.lit(0)) + F.coalesce(F.when(twenty > 0, 1).when(twenty.isNotNull(), -1), F.lit(0))
    return F.when((size == 0) | (five.isNull() & twenty.isNull()), "UNKNOWN").when(points > 0, "STRONG").when(points < 0, "WEAK").otherwise("NEUTRAL")


def overall(*states: Column) -> Column:
    """[M4] From how many layers are known and strong."""
    known = sum((F.when(x != "UNKNOWN", 1).otherwise(0) for x in states), F.lit(0))
    strong = sum((F.when(x == "STRONG", 1).otherwise(0) for x in states), F.lit(0))
    return F.when(known < 2, "unknown").when(strong >= 2, "strong").when(strong == 1, "mixed").otherwise("weak")


def confirmed(df: DataFrame, key: str, date: str, state: str, n: int = 2, width: int | None = None) -> DataFrame:
    """[M5] A state holds once it was seen n days running; UNKNOWN holds, and ends, at once; the first day is taken as
    it is.  width: days of a line that one task scans, for few long lines; runs go on across its ends."""
    if width is not None:
        rows = scan.neighbours(scan.run_lengths(df, key, date, F.col(state), "_run", width), [key], date, {"_prev": F.col(state)}, width)
        at_once = F.col("_prev").isNull() | (F.col(state) == "UNKNOWN") | (F.col("_prev") == "UNKNOWN") | (F.col("_run") >= n)
        return scan.running(rows, key, date, lasts={"confirmed": F.when(at_once, F.col(state))}, width=width).drop("_run", "_prev")
    rows = s.run_length(F.col(state), df, key, date)
    w = s.over(key, date)
    prev = F.lag(state).over(w)
    anchor = F.when(prev.isNull() | (F.col(state) == "UNKNOWN") | (prev == "UNKNOWN") | (F.col("_run") >= n), F.col(state))
    return rows.withColumn("_anchor", anchor).withColumn("confirmed", F.last("_anchor", ignorenulls=True).over(s.so_far(w))).drop("_anchor", "_flag", "_island", "_run")


def state_runs(df: DataFrame, key: str, date: str, state: str) -> DataFrame:
    """[N1] Length of each run of a state."""
    rows = s.run_length(F.col(state), df, key, date)
    return rows.groupBy(key, "_island", state).agg(F.count("*").alias("days"), F.min(date).alias("since")).drop("_island")


def state_summary(df: DataFrame, key: str, date: str, state: str) -> DataFrame:
    """[N3, N4] Days, share, and mean and median run length of each state."""
    runs = state_runs(df, key, date, state)
    found = runs.groupBy(key, state).agg(F.sum("days").alias("days"), F.count("*").alias("runs"), F.avg("days").alias("mean_run"), F.median("days").alias("median_run"))
    return found.withColumn("share", F.col("days") / F.sum("days").over(Window.partitionBy(key)))


def forward_outcomes(df: DataFrame, key: str, date: str, close: str, n: int) -> DataFrame:
    """[N5, N6] Return, true drawdown (start included) and worst loss over the n rows ahead; the window must fit and hold
    a known close, the start must be positive; unknown closes ahead are passed over."""
    w = s.over(key, date)
    ahead = F.collect_list(close).over(w.rowsBetween(1, n))
    fits = F.lead(date, n).over(w).isNotNull() & (F.col(close) > 0) & (F.size(ahead) > 0)
    rows = df.withColumn("_ahead", F.when(fits, ahead))
    path = F.concat(F.array(F.col(close)), F.col("_ahead"))
    return rows.select(key, date, (F.element_at("_ahead", -1) / F.col(close) - 1).alias("forward_return"), F.when(F.col("_ahead").isNotNull(), s.fold_drawdown(path)).alias("forward_drawdown"), (F.array_min("_ahead") / F.col(close) - 1).alias("adverse"))


def state_outcomes(states: DataFrame, closes: DataFrame, key: str, date: str, state: str, close: str, windows: tuple[int, ...] = (5, 20, 60), by: tuple[str, ...] = ()) -> DataFrame:
    """[N7, N8] Per state, window and sample (every day, or the days on which a state begins): count, mean, median, linear
    deciles of the forward return (exact, picked from counted values), mean and worst forward drawdown.  Rows are the days of states; `by`: further slices,
    which forward windows may cross.  UNKNOWN has no outcome."""
    rows = states.join(closes.select(key, date, close), [key, date], "left").withColumn("_enters", ~F.coalesce(F.col(state) == F.lag(state).over(s.over(key, date)), F.lit(False)))
    out = None
    for n in windows:
        found = rows.select(key, date, state, "_enters", *by).join(forward_outcomes(rows, key, date, close, n), [key, date]).withColumn("window", F.lit(n))
        out = found if out is None else out.unionByName(found)
    out = out.where((F.col(state) != "UNKNOWN") & F.col("forward_return").isNotNull())
    sampled = out.withColumn("sample", F.explode(F.when(F.col("_enters"), F.array(F.lit("daily"), F.lit("transition"))).otherwise(F.array(F.lit("daily")))))
    r = "forward_return"
    group = [key, *by, state, "window", "sample"]
    means = sampled.groupBy(*group).agg(F.avg(r).alias("mean"), F.avg("forward_drawdown").alias("drawdown_mean"), F.min("forward_drawdown").alias("drawdown_worst"))
    places = scan.percentiles(sampled, group, r, {"median": 0.5, "p10": 0.1, "p90": 0.9}).withColumnsRenamed({c: f"_{c}" for c in group})
    same = F.lit(True)
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return means.join(places, same).select(*group, "n", "mean", "median", "p10", "p90", "drawdown_mean", "drawdown_worst")


def switches(df: DataFrame, by: list[str], key: str, date: str, state: str) -> DataFrame:
    """[N4, N8] Per slice the days, the switches inside it and the share of UNKNOWN."""
    w = Window.partitionBy(*by).orderBy(date)
    marked = df.withColumn("_switch", F.coalesce(F.col(state) != F.lag(state).over(w), F.lit(False)))
    return marked.groupBy(*by).agg(F.count("*").alias("days"), F.count_if("_switch").alias("switches"), F.avg((F.col(state) == "UNKNOWN").cast("double")).alias("unknown"))


def valuation_percentile(df: DataFrame, key: str, date: str, value: str, years: int = 3653, least: int = 36) -> DataFrame:
    """[L7] Mid-rank percentile of each known value among all up to it, and among those of the last `years` calendar days,
    with how many they are; under `least` null.  Dates are distinct in a key.  A row asks two prefixes of its line, all up
    to it and all before the last `years` days, whose difference is its window."""
    known = df.where(F.col(value).isNotNull()).select(key, date, value)
    numbered = scan.running(known, key, date, counts="_n")
    early = numbered.select(key, F.date_sub(date, years).alias(date), F.col(date).alias("_day"), value, "_n")
    early = scan.asof(early, numbered.select(key, date, F.col("_n").alias("_gone")), [key], date, ["_gone"], strict=True)
    asked = early.select(key, F.col("_day").alias(date), value, "_n", F.coalesce("_gone", F.lit(0)).alias("_gone"))
    asked = asked.select("*", F.explode(F.array(F.struct(F.lit("all").alias("which"), F.col("_n").alias("until")), F.struct(F.lit("gone").alias("which"), F.col("_gone").alias("until")))).alias("_q")).select(key, date, value, "_n", "_gone", "_q.*")
    counted = scan.prefix_counts(numbered.select(key, value, (F.col("_n") - 1).alias("_t")), asked, key, value, "until")
    half = F.col("below") + F.col("equal") / 2
    rows = counted.groupBy(key, date).agg(F.any_value(value).alias(value), F.any_value("_n").alias("n_all"), F.any_value("_gone").alias("_gone"), F.sum(F.when(F.col("which") == "all", half)).alias("_all"), F.sum(F.when(F.col("which") == "gone", half)).alias("_early"))
    ten = F.col("n_all") - F.col("_gone")
    rank = lambda part, n: F.when(n >= least, part / n)
    return rows.select(key, date, value, rank(F.col("_all"), F.col("n_all")).alias("percentile_all"), rank(F.col("_all") - F.col("_early"), ten).alias("percentile_10y"), F.col("n_all").cast("int").alias("n_all"), ten.cast("int").alias("n_10y"))


def basket_members(mapping: DataFrame, indexes: DataFrame, fund: str, asof: str) -> DataFrame:
    """[L10] Funds mapped to one of the indexes (index_id, basket: its main id, aliases too) at a day."""
    day = F.lit(asof).cast("date")
    valid = mapping.where((F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)))
    return valid.join(indexes, "index_id").select(fund, "basket").distinct()


def basket_sizes(members: DataFrame, premiums: DataFrame, fund: str) -> DataFrame:
    """[L10] Members of each basket, and the median of their known premiums (fund, premium)."""
    return members.join(premiums, fund, "left").groupBy("basket").agg(F.countDistinct(fund).alias("members"), F.median("premium").alias("premium_median"), F.count("premium").alias("premiums"))


def basket_detail(members: DataFrame, blocks: dict[str, DataFrame], fund: str, date: str) -> DataFrame:
    """[L11] A row for each member with the last row of each block and its date, the largest `aum` first."""
    out = members
    for name, block in blocks.items():
        last = block.withColumn("_rn", F.row_number().over(Window.partitionBy(fund).orderBy(F.desc(date)))).where("_rn = 1").drop("_rn")
        out = out.join(last.withColumnRenamed(date, f"{name}_date"), fund, "left")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("basket").orderBy(F.desc_nulls_last("aum"), fund)))


def basket_sums(flows: DataFrame, members: DataFrame, fund: str, date: str, values: list[str]) -> DataFrame:
    """[L12] Sums of the members' flows by basket and day, with how many are known."""
    joined = flows.join(members, fund)
    return joined.groupBy("basket", date).agg(*(F.sum(v).alias(v) for v in values), *(F.count(v).alias(f"{v}_known") for v in values))


def alignment(states: DataFrame, days: DataFrame, key: str, date: str, version: str) -> DataFrame:
    """[N9] Of each key's states on the days of an index: how many, since, until, in how many years, and whether they mix
    versions."""
    return states.join(days.select(date).distinct(), date, "left_semi").groupBy(key).agg(F.count("*").alias("days"), F.min(date).alias("since"), F.max(date).alias("until"), F.countDistinct(F.year(date)).alias("years"), (F.countDistinct(version) > 1).alias("mixed_versions"))


def last_days(df: DataFrame, date: str, n: int) -> DataFrame:
    """[L1] The last n days of a market series."""
    return df.orderBy(F.desc(date)).limit(n)


def norm_ratios(turnover: DataFrame, margin: DataFrame, activity: DataFrame, date: str) -> DataFrame:
    """[L2] By day of turnover (exchange, amount, cap): margin by market value if both exchanges report on both sides,
    turnover by market value, risers by risers and fallers, limit-ups by all; null without a positive divisor."""
    t = turnover.groupBy(date).agg(F.sum("amount").alias("_amount"), F.sum("cap").alias("cap"), F.countDistinct("exchange").alias("_nt"))
    m = margin.groupBy(date).agg(F.sum("balance").alias("_balance"), F.countDistinct("exchange").alias("_nm"))
    out = t.join(m, date, "left").join(activity, date, "left")
    both = F.col("rising") + F.col("falling")
    every = both + F.coalesce("flat", F.lit(0))
    return out.select(
        date,
        F.when((F.col("_nt") == 2) & (F.col("_nm") == 2) & (F.col("cap") > 0), F.col("_balance") / F.col("cap")).alias("margin_balance_ratio"),
        F.when(F.col("cap") > 0, F.col("_amount") / F.col("cap")).alias("turnover_ratio"),
        F.when(both > 0, F.col("rising") / both).alias("advance_ratio"),
        F.when(every > 0, F.col("limit_up") / every).alias("limit_up_ratio"),
        "cap",
    )
