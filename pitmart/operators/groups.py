"""Peers, holdings and tags [I1-I7, J1-J7]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitmart.operators import scan


def peer_group(index_id: Column, index_name: Column, tag: Column) -> Column:
    """[I1] (id, kind, label): the index, else its name, else the tag; an empty one counts as none.  Null without any."""
    out = None
    for prefix, kind, value in (("index", "tracking_index", index_id), ("benchmark", "benchmark_name", index_name), ("tag", "tag", tag)):
        one = F.struct(F.concat(F.lit(f"{prefix}:"), value).alias("id"), F.lit(kind).alias("kind"), value.alias("label"))
        out = F.when(value != "", one) if out is None else out.when(value != "", one)
    return out


def with_index_of_name(df: DataFrame, catalog: DataFrame, index_id: str, index_name: str) -> DataFrame:
    """[I2] The index id from the catalog (index_id, index_name) where only a name is known; of one name the last id."""
    known = catalog.where("index_name <> ''").groupBy("index_name").agg(F.max("index_id").alias("_id"))
    named = df.join(known.withColumnRenamed("index_name", "_name"), F.col(index_name) == F.col("_name"), "left")
    return named.withColumn(index_id, F.coalesce(F.when(F.col(index_id) != "", F.col(index_id)), F.col("_id"))).drop("_id", "_name")


#: [I7] metric -> whether the highest is best.  Fixed values.
DIRECTIONS = {"aum": True, "turnover": True, "flow": True, "tracking_error": False, "fee": False, "premium_stability": False}


def peer_marts(facts: DataFrame, group: str, key: str, least: int = 3) -> DataFrame:
    """[I7] The percentile of each metric in its group; groups of fewer than `least` members have no row, a metric known
    of fewer none; 1 is best in every metric.  All metrics are ranked at once, from counted values, so that no group is
    one task; keys are distinct in a group."""
    sizes = facts.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("peer_count")).where(F.col("peer_count") >= least)
    metrics = F.array(*(F.struct(F.lit(c).alias("metric"), (F.col(c) if high else -F.col(c)).cast("double").alias("good")) for c, high in DIRECTIONS.items()))
    told = facts.select(group, key, F.explode(metrics).alias("_m")).select(group, key, "_m.*").where("good is not null")
    ranked = scan.ranks(told, [group, "metric"], "good").where(F.col("known") >= least)
    share = F.when(F.col("known") > 1, F.col("below") / (F.col("known") - 1)).otherwise(0.0)
    wide = ranked.groupBy(F.col(group).alias("_g"), F.col(key).alias("_key")).agg(*(F.max(F.when(F.col("metric") == c, share)).alias(f"{c}_rank_pct") for c in DIRECTIONS))
    rows = facts.select(group, key).join(sizes, F.col(group).eqNullSafe(F.col("_group")))
    rows = rows.join(wide, F.col(group).eqNullSafe(F.col("_g")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return rows.select(key, group, "peer_count", *(f"{c}_rank_pct" for c in DIRECTIONS))


def peer_percentile(df: DataFrame, group: str, value: str, best_high: bool = True, least: int = 3) -> DataFrame:
    """[I6] worse / (n - 1) among the known values of a group, ties equal; groups of fewer than `least` have none.  Ranks come
    from counted values: no group is one task."""
    known = df.where(F.col(value).isNotNull()).withColumn("_good", (F.col(value) if best_high else -F.col(value)).cast("double"))
    ranked = scan.ranks(known, [group], "_good").withColumnRenamed("known", "peer_count")
    share = F.when(F.col("peer_count") > 1, F.col("below") / (F.col("peer_count") - 1)).otherwise(0.0)
    return ranked.withColumn("rank_pct", F.when(F.col("peer_count") >= least, share)).drop("_good", "below", "equal")


def latest_report(holdings: DataFrame, fund: str, asof: str | None = None, dealt: bool = False) -> DataFrame:
    """[J2] All holdings of each fund's latest report.  As of a day a report counts from the first of its holdings that is
    dated and, where known, disclosed by it, and then counts whole.  dealt: holdings stand by fund; a join by fund alone
    leaves them there."""
    seen = holdings
    if asof is not None:
        day = F.lit(asof).cast("date")
        seen = seen.where((F.col("report_date") <= day) & (F.col("disclosed").isNull() | (F.col("disclosed") <= day)))
    last = seen.groupBy(F.col(fund).alias("_fund")).agg(F.max("report_date").alias("_last"))
    same = (F.col("report_date") >= F.col("_last")) & (F.col("report_date") <= F.col("_last")) if dealt else F.col("report_date") == F.col("_last")
    return holdings.join(last, (F.col(fund) == F.col("_fund")) & same).drop("_fund", "_last")


def latest_top(holdings: DataFrame, fund: str, asof: str | None = None, n: int = 10, funds: DataFrame | None = None) -> DataFrame:
    """[J1, J2] The latest report's top holdings.  A fund's confidence is exact if all of them have a day of disclosure,
    else limited; `funds` without any report have one row, whose confidence is missing."""
    w = Window.partitionBy(fund)
    h = latest_report(holdings, fund, asof).withColumn("rank", F.row_number().over(w.orderBy(F.desc_nulls_last("weight_pct"), "stock_id"))).where(F.col("rank") <= n)
    h = h.withColumn("confidence", F.when(F.bool_and(F.col("disclosed").isNotNull()).over(w), "exact").otherwise("limited"))
    if funds is None:
        return h
    return funds.select(fund).distinct().join(h, fund, "left").withColumn("confidence", F.coalesce("confidence", F.lit("missing")))


def concentration(holdings: DataFrame, fund: str) -> DataFrame:
    """[J4] The ten largest known weights' total as a fraction: weights are percent when any of all holdings is over 1.05;
    a negative one or a total of all over 105 percent is refused with a reason, and so are funds without weights."""
    w = Window.partitionBy(fund).orderBy(F.desc_nulls_last("weight_pct"), "stock_id")
    t = holdings.withColumn("_rank", F.row_number().over(w)).groupBy(fund).agg(F.max("weight_pct").alias("_max"), F.min("weight_pct").alias("_min"), F.sum("weight_pct").alias("_all"), F.sum(F.when(F.col("_rank") <= 10, F.col("weight_pct"))).alias("_top"))
    scale = F.when(F.col("_max") > 1.05, 100.0).otherwise(1.0)
    reason = F.when(F.col("_max").isNull(), "holding_weights_unavailable").when((F.col("_min") < 0) | (F.col("_all") > F.when(scale == 100.0, 105.0).otherwise(1.05)), "holding_weight_conflict")
    return t.select(fund, F.when(reason.isNull(), F.col("_top") / scale).alias("concentration"), reason.alias("reason"))


def exposure(holdings: DataFrame, fund: str, n: int = 10) -> DataFrame:
    """[J4, K12] One row for each fund of its holdings (fund, stock_id, weight_pct, dated, origin): the n largest as a list,
    concentration or the reason why there is none, and where and when the holdings are from."""
    w = Window.partitionBy(fund).orderBy(F.desc_nulls_last("weight_pct"), "stock_id")
    ranked = holdings.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    listed = ranked.groupBy(fund).agg(F.array_sort(F.collect_list(F.struct(F.col("_rank").alias("rank"), "stock_id", "weight_pct"))).alias("top"), F.max("dated").alias("holdings_date"), F.min("origin").alias("holdings_type"))
    return listed.join(concentration(holdings, fund).withColumnRenamed("reason", "concentration_reason"), fund)


def overlap(holdings: DataFrame, pairs: DataFrame, fund: str) -> DataFrame:
    """[J5] For each asked-for pair (a, b) of funds: common holdings by the smaller side, sum of lesser weights (an unknown
    weight is 0), common ones among both top tens by 10, and the common stocks in order; no overlap is 0, and all is
    null where a side has no holdings.  The stocks of the pairs' funds alone are joined."""
    w = Window.partitionBy("fund").orderBy(F.desc("weight"), "stock_id")
    held = holdings.groupBy(F.col(fund).alias("fund"), "stock_id").agg(F.coalesce(F.max("weight_pct"), F.lit(0.0)).alias("weight"))
    held = held.withColumn("top", F.row_number().over(w) <= 10).withColumn("n", F.count("*").over(Window.partitionBy("fund")))
    one = pairs.select("a", "b").distinct().join(held.select(F.col("fund").alias("a"), "stock_id", F.col("weight").alias("wa"), F.col("top").alias("ta")), "a")
    both = one.join(held.select(F.col("fund").alias("b"), "stock_id", F.col("weight").alias("wb"), F.col("top").alias("tb")), ["b", "stock_id"])
    both = both.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(F.least("wa", "wb")).alias("weighted"), F.count_if(F.col("ta") & F.col("tb")).alias("top"), F.sort_array(F.collect_list("stock_id")).alias("stocks"))
    sizes = held.groupBy("fund").agg(F.count("*").alias("n"))
    out = pairs.select("a", "b").distinct().join(both, ["a", "b"], "left").join(sizes.select(F.col("fund").alias("a"), F.col("n").alias("na")), "a", "left").join(sizes.select(F.col("fund").alias("b"), F.col("n").alias("nb")), "b", "left")
    known = F.col("na").isNotNull() & F.col("nb").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("a", "b", F.when(known, zero("common") / F.least("na", "nb")).alias("overlap"), F.when(known, F.coalesce("weighted", F.lit(0.0))).alias("weighted"), F.when(known, zero("top") / 10).alias("top10"), F.coalesce(F.array_join("stocks", ","), F.lit("")).alias("stocks"))


def industry_overlap(weights: DataFrame, pairs: DataFrame, fund: str) -> DataFrame:
    """[J6] Sum of the lesser industry weights of each pair (a, b); 0 without a common industry, null where a side has
    none."""
    w = weights.select(F.col(fund).alias("fund"), "industry", "weight")
    one = pairs.select("a", "b").distinct().join(w.select(F.col("fund").alias("a"), "industry", F.col("weight").alias("wa")), "a")
    both = one.join(w.select(F.col("fund").alias("b"), "industry", F.col("weight").alias("wb")), ["b", "industry"]).groupBy("a", "b").agg(F.sum(F.least("wa", "wb")).alias("common"))
    there = w.select("fund").distinct()
    out = pairs.select("a", "b").distinct().join(both, ["a", "b"], "left").join(there.withColumn("_a", F.lit(1)).withColumnRenamed("fund", "a"), "a", "left").join(there.withColumn("_b", F.lit(1)).withColumnRenamed("fund", "b"), "b", "left")
    return out.select("a", "b", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.coalesce("common", F.lit(0.0))).alias("industry_overlap"))


#: Pieces that the constituents of an index are dealt in.
PIECES = 64


def holdings_or_constituents(holdings: DataFrame, constituents: DataFrame, mapping: DataFrame, fund: str, asof: str, dealt: bool = False) -> DataFrame:
    """[J3] A fund's latest report as of a day, else the latest constituents (index_id, effective_date, stock_id,
    weight_pct) of its index (mapping: fund, index_id), with where they come from.  Each fund has a row for each constituent,
    so the result is far larger than what it is made of: an index meets its funds in pieces, in as many tasks as Spark has
    partitions, which their small input must not merge.  dealt: as of latest_report."""
    day = F.lit(asof).cast("date")
    own = latest_report(holdings, fund, asof, dealt).select(fund, "stock_id", "weight_pct", F.col("report_date").alias("dated"), F.lit("disclosure").alias("origin"))
    tasks = int(constituents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = constituents.where(F.col("effective_date") <= day)
    last = known.groupBy("index_id").agg(F.max("effective_date").alias("effective_date"))
    keys = ["index_id", "effective_date", "_piece"]
    asking = mapping.join(own.select(fund).distinct(), fund, "left_anti").join(last, "index_id").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    pieces = known.withColumn("_piece", F.pmod(F.xxhash64("stock_id"), F.lit(PIECES)).cast("int"))
    rest = asking.repartition(tasks, *keys).join(pieces.repartition(tasks, *keys), keys).select(fund, "stock_id", "weight_pct", F.col("effective_date").alias("dated"), F.lit("constituents").alias("origin"))
    return own.unionByName(rest)


def tags_asof(tags: DataFrame, fund: str, asof: str) -> DataFrame:
    """[J8, K10] A fund's tags valid at a day, the surest first; of equally sure ones of one name by type, then the oldest."""
    day = F.lit(asof).cast("date")
    valid = tags.where((F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)))
    return valid.withColumn("rank", F.row_number().over(Window.partitionBy(fund).orderBy(F.desc_nulls_last("confidence"), "tag", "tag_type", F.asc_nulls_first("valid_from"))))


def industry_weights(holdings: DataFrame, industry: DataFrame, fund: str) -> DataFrame:
    """[J6] Weight by industry; unmapped stocks are one bucket."""
    joined = holdings.join(industry, "stock_id", "left").withColumn("industry", F.coalesce("industry_name", F.lit("unclassified")))
    return joined.groupBy(fund, "industry").agg(F.sum("weight_pct").alias("weight"))


#: [J7] Fixed values: shares from which the first and second industry are tags, classified share and number of industries
#: from which a fund without a first one is broad, and that tag with its confidence.
PRIMARY, SECONDARY, COVERED, BROAD, BROAD_TAG, BROAD_CONFIDENCE = 0.30, 0.18, 0.80, 3, "核心宽基/均衡", 0.85


def industry_tags(holdings: DataFrame, industry: DataFrame, fund: str, asof: str) -> DataFrame:
    """[J7] (fund, tag, tag_type, confidence, coverage, valid_from).  Of the holdings with a positive weight alone: the
    largest industry and the second are tags from their shares of all weight on; a fund whose largest is none, which
    is classified enough and stands in several industries, is broad.  An empty industry is none."""
    held = holdings.where("weight_pct > 0").join(industry.where("industry_name <> ''"), "stock_id", "left")
    by_industry = held.groupBy(fund, "industry_name").agg(F.sum("weight_pct").alias("weight"))
    w = Window.partitionBy(fund)
    shares = by_industry.withColumn("share", F.col("weight") / F.sum("weight").over(w)).where("industry_name is not null")
    ranked = shares.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("share"), "industry_name"))).withColumn("coverage", F.sum("share").over(w)).withColumn("_n", F.count("*").over(w))
    least = F.when(F.col("_rank") == 1, PRIMARY).when(F.col("_rank") == 2, SECONDARY)
    broad = (F.col("_rank") == 1) & (F.col("share") < PRIMARY) & (F.col("coverage") >= COVERED) & (F.col("_n") >= BROAD)
    tag = F.when(F.col("share") >= least, F.struct(F.col("industry_name").alias("tag"), F.lit("industry").alias("tag_type"), F.round("share", 4).alias("confidence")))
    tag = tag.when(broad, F.struct(F.lit(BROAD_TAG).alias("tag"), F.lit("style").alias("tag_type"), F.lit(BROAD_CONFIDENCE).alias("confidence")))
    return ranked.withColumn("_tag", tag).where("_tag is not null").select(fund, "_tag.*", F.round("coverage", 4).alias("coverage"), F.lit(asof).cast("date").alias("valid_from"))
