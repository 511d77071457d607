"""Every registered query against its SQL in DuckDB on the smallest tables, and hand-made cases."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from pitmart import queries, queries_audit, queries_long, queries_marts, queries_more, queries_norm, queries_pulse, queries_reads, queries_record, queries_sources, queries_streams  # noqa: F401
from pitmart.operators import adjust, checks, flow, groups, market, merge, metrics, pit, pulse, records
from pitmart.sources import frames, sinks, store

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(sorted(names)).collect()), key=repr)
    assert got == want


def days(spark, values, name="close", key="s"):
    start = dt.date(2026, 8, 7)
    return spark.createDataFrame([(key, start + dt.timedelta(i), v) for i, v in enumerate(values)], f"security_id string, trade_date date, {name} double")


def test_golden_metrics(spark):
    closes = [100.0 + i for i in range(25)]
    df = days(spark, closes).withColumn("turnover_amount", 1_000_000.0 + 1000 * (F.col("close") - 100))
    row = metrics.latest(metrics.daily_metrics(df), "security_id", "trade_date").first()
    assert row["return_1d"] == pytest.approx(1 / 123)
    assert row["return_20d"] == pytest.approx(124 / 104 - 1)
    assert row["volatility_20d"] == pytest.approx(0.00712169492437755)
    assert row["avg_turnover_20d"] == 1_014_500
    assert row["return_60d"] is None and row["max_drawdown_60d"] is None


def test_jump_and_null_give_no_return(spark):
    df = days(spark, [1.0, 1.5, 1.5, 1.5, None, 1.6]).withColumn("turnover_amount", F.lit(1.0))
    rows = {r["trade_date"].day: r for r in metrics.daily_metrics(df).collect()}
    assert rows[8]["return_1d"] is None and rows[9]["return_1d"] == 0.0
    assert rows[12]["return_1d"] == pytest.approx(1.6 / 1.5 - 1)


def test_golden_flow(spark):
    df = days(spark, [1000.0 + 10 * i for i in range(25)], "shares").withColumn("nav", F.lit(1.5))
    row = metrics.latest(flow.daily_flows(df), "security_id", "trade_date").first()
    assert (row["share_change_20d"], row["net_subscription_1d"], row["net_subscription_20d"]) == (200, 15, 300)
    assert row["share_change_pct_20d"] == pytest.approx(200 / 1040)
    assert metrics.latest(flow.streaks(df), "security_id", "trade_date").first()["inflow_days"] == 24


def test_values_at_a_date_do_not_depend_on_later_rows(spark):
    df = days(spark, [10 + math.sin(i) for i in range(90)]).withColumn("turnover_amount", F.col("close"))
    cut = dt.date(2026, 10, 10)
    whole = metrics.daily_metrics(df).where(F.col("trade_date") <= F.lit(cut)).orderBy("trade_date").collect()
    assert metrics.daily_metrics(df.where(F.col("trade_date") <= F.lit(cut))).orderBy("trade_date").collect() == whole


def test_merge_keeps_known_values(spark):
    old = spark.createDataFrame([(1, "a", 1.0, "x"), (2, "b", 2.0, None)], "k int, v string, w double, p string")
    new = spark.createDataFrame([(1, None, None, "y"), (2, "c", 3.0, "z"), (3, None, 4.0, None)], "k int, v string, w double, p string")
    once = merge.merge_keyed(old, new, ["k"], overwrite=["w"], keep=["p"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", None, "x"), (2, "c", 3.0, "z"), (3, None, 4.0, None)]
    assert sorted(map(tuple, merge.merge_keyed(once, new, ["k"], overwrite=["w"], keep=["p"]).collect())) == sorted(map(tuple, once.collect()))


def test_old_value_between_two_dates(spark):
    df = spark.createDataFrame([("f", dt.date(2026, 1, 1), 1.0), ("f", dt.date(2026, 3, 1), 2.0)], "k string, d date, v double")
    assert pit.asof_rows(df, "k", "d", "2026-02-01").first()["v"] == 1.0


def test_reconcile(spark):
    df = spark.createDataFrame([([None, None],), ([None, 2.0],), ([2.0, 2.001],), ([2.0, 3.0],), ([0.0, 0.0],), ([0.0, 1.0],)], "v array<double>")
    status, value = checks.reconcile(F.col("v"))
    assert [tuple(r) for r in df.select(status, value).collect()] == [("FAILED", None), ("PASS", 2.0), ("VERIFIED", 2.0), ("CONFLICT", None), ("VERIFIED", 0.0), ("CONFLICT", None)]


def test_contract(spark):
    empty = spark.createDataFrame([], "a int")
    assert {r["rule"] for r in checks.contract(empty, ["a", "b"]).collect()} == {"missing_column:b", "empty_frame"}
    assert checks.contract(spark.range(1).toDF("a"), ["a"]).count() == 0


def test_confirmation_takes_two_days(spark):
    states = ["WEAK", "STRONG", "WEAK", "STRONG", "STRONG", "UNKNOWN", "WEAK", "NEUTRAL", "NEUTRAL"]
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(states)], "k string, d int, s string")
    got = [r["confirmed"] for r in market.confirmed(df, "k", "d", "s").orderBy("d").collect()]
    assert got == ["WEAK", "WEAK", "WEAK", "WEAK", "STRONG", "UNKNOWN", "WEAK", "WEAK", "NEUTRAL"]


def test_peer_percentile_needs_three(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("b", 1.0), ("b", 2.0)], "g string, v double")
    got = sorted((r["g"], r["v"], r["rank_pct"]) for r in groups.peer_percentile(df, "g", "v").collect())
    assert got == [("a", 1.0, 0.0), ("a", 2.0, 0.5), ("a", 2.0, 0.5), ("b", 1.0, None), ("b", 2.0, None)]


def test_volume_layer_scores_ratio_and_percentile_and_keeps_days_without_turnover(spark):
    rows = {r["trade_date"]: r for r in pulse.volume_layer(days(spark, [5e11] * 8 + [None, 6e11], "amount"), "security_id", "trade_date", "amount").collect()}
    states = [rows[d]["state"] for d in sorted(rows)]
    assert states == ["UNKNOWN"] * 5 + ["NEUTRAL"] * 3 + ["UNKNOWN", "STRONG"]
    rising = days(spark, [100.0 + i for i in range(90)], "amount")
    last = pulse.volume_layer(rising, "security_id", "trade_date", "amount").orderBy(F.desc("trade_date")).first()
    # the ratio is flat, the mean of 20 rows is the highest of 71
    assert last["ratio"] == pytest.approx(189 / 186) and last["position"] == pytest.approx(70.5 / 71) and (last["score"], last["state"]) == (1, "STRONG")


def test_pulse_replay_of_a_rising_margin(spark):
    day = [dt.date(2026, 8, 3) + dt.timedelta(i) for i in range(12)]
    turnover = spark.createDataFrame([("cn", d, 1e12) for d in day], "market string, trade_date date, amount double")
    margin = spark.createDataFrame([("cn", d, 1.9 * (1e12 + 1.5e10 * i)) for i, d in enumerate(day)], "market string, trade_date date, balance double")
    basket = spark.createDataFrame([], "market string, trade_date date, basket_size int, net_5d double, net_20d double")
    index = spark.createDataFrame([("cn", d, 4000.0) for d in day], "market string, trade_date date, close double")
    last = pulse.replay(turnover, margin, basket, index, "market", "trade_date", last=1).first()
    assert (last["liquidity_state"], last["volume_state"], last["etf_state"], last["overall_state"]) == ("STRONG", "NEUTRAL", "UNKNOWN", "中性观望")


def test_transitions_name_the_leading_layer_and_coverage(spark):
    rows = spark.createDataFrame([("m", k, *x) for k, x in enumerate([("WEAK", "WEAK", "UNKNOWN", "防守"), ("STRONG", "WEAK", "UNKNOWN", "中性观望"), ("STRONG", "WEAK", "WEAK", "中性观望"), ("WEAK", "STRONG", "WEAK", "中性观望"), ("WEAK", "STRONG", "WEAK", "中性观望")])], "m string, day int, liquidity_state string, volume_state string, etf_state string, overall_state string")
    got = [(r["day"], r["leading_layer"], r["kind"], r["significance"], r["overall_changed"]) for r in pulse.transitions(rows, "m", "day").orderBy("day").collect()]
    assert got == [(1, "liquidity", "market", "资金先行信号", True), (2, "etf", "coverage", "数据开始覆盖/中断", False), (3, None, "market", "多层共振转向", False)]


def test_concentration_checks_all_holdings_and_is_a_fraction(spark):
    rows = [("pct", k, 6.0) for k in range(12)] + [("frac", k, 0.06) for k in range(12)] + [("over", k, 9.0) for k in range(12)] + [("neg", 0, 50.0), ("neg", 1, -1.0), ("none", 0, None)]
    got = {r["fund"]: (r["concentration"], r["reason"]) for r in groups.concentration(spark.createDataFrame(rows, "fund string, stock_id int, weight_pct double"), "fund").collect()}
    assert got["pct"] == (pytest.approx(0.6), None) and got["frac"] == (pytest.approx(0.6), None)
    assert got["over"] == got["neg"] == (None, "holding_weight_conflict") and got["none"] == (None, "holding_weights_unavailable")


def test_overlap_counts_unknown_weights_as_zero_and_keeps_pairs_without_overlap(spark):
    held = spark.createDataFrame([("a", 1, 0.4), ("a", 2, None), ("b", 1, 0.3), ("b", 2, 0.5), ("b", 3, 0.1), ("c", 9, 1.0)], "fund string, stock_id int, weight_pct double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "z")], "a string, b string")
    got = {r["b"]: tuple(r)[2:] for r in groups.overlap(held, pairs, "fund").collect()}
    assert got["b"] == (1.0, pytest.approx(0.3), 0.2, "1,2") and got["c"] == (0.0, 0.0, 0.0, "") and got["z"] == (None, None, None, "")
    weights = spark.createDataFrame([("a", "x", 0.6), ("a", "y", 0.4), ("b", "x", 0.2), ("c", "q", 1.0)], "fund string, industry string, weight double")
    assert {r["b"]: r["industry_overlap"] for r in groups.industry_overlap(weights, pairs, "fund").collect()} == {"b": 0.2, "c": 0.0, "z": None}


def test_outcomes_need_a_known_close_ahead_and_skip_unknown(spark):
    closes = days(spark, [10.0, None, None, None, 8.0, 12.0, 9.0])
    got = [r["forward_return"] for r in market.forward_outcomes(closes, "security_id", "trade_date", "close", 3).orderBy("trade_date").collect()]
    assert got[0] is None and got[3] is None  # unknown closes ahead give no sample, nor does an unknown start
    states = spark.createDataFrame([("s", dt.date(2026, 8, 7) + dt.timedelta(i), x) for i, x in enumerate(["UP", "UP", "UNKNOWN", "UP", "DOWN", "DOWN"])], "security_id string, trade_date date, state string")
    prices = days(spark, [10.0, 11.0, 12.0, 13.0, 12.0, 14.0])
    found = {(r["state"], r["sample"]): (r["n"], round(r["mean"], 6)) for r in market.state_outcomes(states, prices, "security_id", "trade_date", "state", "close", (1,)).collect()}
    assert found == {("UP", "daily"): (3, round((0.1 + 1 / 11 - 1 / 13) / 3, 6)), ("UP", "transition"): (2, round((0.1 - 1 / 13) / 2, 6)), ("DOWN", "daily"): (1, round(1 / 6, 6)), ("DOWN", "transition"): (1, round(1 / 6, 6))}


def test_return_basis_by_fixed_keywords(spark):
    names = ["沪深300全收益", "沪深300净收益", "沪深300价格", "沪深300", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(metrics.return_basis(F.col("name"))).collect()] == ["total_return_index", "net_total_return_index", "price_index", "unknown", "unknown"]


def test_tracking_refuses_with_a_reason(spark):
    index = days(spark, [100.0 + i for i in range(30)], "ic", "x").select("trade_date", "ic")
    for nav, basis, reason in (([1.0 + 0.01 * i for i in range(30)], "price_index", None), ([1.0] * 30, "unknown", metrics.UNKNOWN_BASIS), ([1.0] * 30, "total_return_index", metrics.TOTAL_BASIS), ([1.0] * 20 + [2.0] * 10, "price_index", metrics.JUMPED), ([1.0] * 10, "price_index", metrics.SHORT)):
        df = days(spark, nav, "nav").withColumn("basis", F.lit(basis))
        last = metrics.tracking(df, index, "security_id", "trade_date", "nav", "ic", (20,), (), "basis").orderBy(F.desc("trade_date")).first()
        assert last["reason_20"] == reason and (last["difference_20"] is None) == (reason is not None)


def test_flows_on_adjusted_shares_ignore_a_split(spark):
    df = days(spark, [100.0] * 5 + [101.0] * 20, "adjusted_shares").withColumn("adjusted_nav", F.lit(2.0)).withColumn("factor", F.when(F.col("trade_date") < dt.date(2026, 8, 20), 1.0).otherwise(2.0))
    last = flow.adjusted_flows(df).orderBy(F.desc("trade_date")).first()
    assert (last["share_change_20d"], last["net_subscription_20d"], last["share_change_pct_20d"], last["quality"]) == (2.0, 2.0, 0.01, "adjusted")


def test_peer_group_passes_over_empty_ids(spark):
    df = spark.createDataFrame([("i", "n", "t"), ("", "n", "t"), (None, "", "t"), (None, None, None)], "i string, n string, t string")
    got = [r[0] and tuple(r[0]) for r in df.select(groups.peer_group(F.col("i"), F.col("n"), F.col("t"))).collect()]
    assert got == [("index:i", "tracking_index", "i"), ("benchmark:n", "benchmark_name", "n"), ("tag:t", "tag", "t"), None]


def test_version_of_an_unknown_block_is_an_error():
    assert records.version_for("flow") == "flow_v2"
    with pytest.raises(KeyError):
        records.version_for("no such block")


def test_raw_snapshots_and_marts_are_idempotent_by_partition(spark, tmp_path):
    raw, mart = str(tmp_path / "raw"), str(tmp_path / "mart")
    df = days(spark, [1.0, 2.0, 3.0])
    for date, rows in (("2026-08-07", df), ("2026-08-08", df.limit(1)), ("2026-08-07", df.limit(2))):
        sinks.write_raw(rows, raw, "vendor", "quotes", date)
    assert {str(r["date"]): r["count"] for r in spark.read.parquet(raw).groupBy("date").count().collect()} == {"2026-08-07": 2, "2026-08-08": 1}
    sinks.write_mart(df, mart, "metric_v1")
    for _ in range(2):
        sinks.write_mart(df.limit(2), mart, "metric_v2")
    assert {r["calculation_version"]: r["count"] for r in spark.read.parquet(mart).groupBy("calculation_version").count().collect()} == {"metric_v1": 3, "metric_v2": 2}


def test_a_history_scan_reads_the_months_it_needs(spark, tmp_path):
    start = dt.date(2026, 1, 1)
    df = spark.createDataFrame([(f"s{k}", start + dt.timedelta(days=i), float(i)) for k in range(5) for i in range(200)], "security_id string, trade_date date, close double")
    store.write_history(df, str(tmp_path / "h"))
    got = store.read_history(spark, str(tmp_path / "h"), ["s1", "s3"], "2026-03-10")
    assert [tuple(r) for r in got.collect()] == [(k, start + dt.timedelta(days=i), float(i)) for k in ("s1", "s3") for i in range(69)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "In(security_id" in plan and "LessThanOrEqual(trade_date" in plan
    read = {r["m"] for r in got.select(F.regexp_extract(F.col("_metadata.file_path"), "month=([0-9-]+)", 1).alias("m")).distinct().collect()}
    assert read == {"2026-01", "2026-02", "2026-03"}


def test_run_log_counts_in_the_write_job_and_records_failure(spark, tmp_path):
    log = str(tmp_path / "log")
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(10).repartition(3)
    fetched = spark.createDataFrame(rows.rdd.map(lambda r: (seen.add(1), (r[0],))[1]), "id long")
    sinks.recorded(fetched, F.col("id") % 3 != 0, lambda good: good.write.parquet(str(tmp_path / "a")), log, "r1", "quotes", "vendor")
    assert seen.value == 10  # one pass
    sinks.recorded(rows, F.lit(True), lambda good: good.write.parquet(str(tmp_path / "b")), log, "r2", "quotes", "vendor")
    sinks.recorded(rows.limit(0), F.lit(True), lambda good: good.write.parquet(str(tmp_path / "c")), log, "r3", "quotes", "vendor")
    sinks.recorded(rows, F.lit(True), lambda good: good.limit(4).write.parquet(str(tmp_path / "d")), log, "r4", "quotes", "vendor", stands=lambda: 4)

    def full(good):
        good.write.parquet(str(tmp_path / "e"))
        raise OSError("no such disk")

    with pytest.raises(OSError, match="no such"):
        sinks.recorded(rows, F.lit(True), full, log, "r5", "quotes", "vendor")
    with pytest.raises(OSError, match="nothing"):
        sinks.recorded(rows, F.lit(True), lambda good: (_ for _ in ()).throw(OSError("nothing")), log, "r6", "quotes", "vendor")
    got = {r["run_id"]: (r["fetched"], r["written"], r["rejected"], r["status"]) for r in spark.read.parquet(log).collect()}
    assert got == {"r1": (10, 6, 4, "PARTIAL"), "r2": (10, 10, 0, "SUCCESS"), "r3": (0, 0, 0, "SKIPPED"), "r4": (10, 4, 0, "PARTIAL"), "r5": (10, 0, 0, "FAILED"), "r6": (0, 0, 0, "FAILED")}
    issues = sinks.issue_rows(spark.createDataFrame([("a", "bad", "x"), ("a", "bad", "x")], "s string, rule string, d string"), "quotes", F.col("s"), F.lit(None), F.col("d"))
    sinks.append_issues(issues, str(tmp_path / "issues"))
    assert spark.read.parquet(str(tmp_path / "issues")).select("issue_id").distinct().count() == 1


def test_corporate_action_pages_with_placeholders_and_bad_rows(spark):
    head = "".join(f"<th>{c}</th>" for c in frames.SPLIT_HEADER)
    html = f"<table><tr>{head}</tr><tr><td>暂无拆分信息!</td></tr><tr><td>2026</td><td>2026年7月3日</td><td>份额合并</td><td>2:1</td></tr><tr><td>2026</td><td>x</td><td>?</td><td>1:2</td></tr><tr><td>2026</td><td>2026-07-04</td><td>?</td><td>none</td></tr></table><table></table>"
    facts, issues = frames.corporate_actions(spark.createDataFrame([("f", html), ("g", None), ("h", "<p>no table")], "id string, html string"), "id", "html")
    assert [(r["id"], str(r["action_date"]), r["action_type"], r["share_factor"], r["nav_factor"]) for r in facts.collect()] == [("f", "2026-07-03", "REVERSE_SPLIT", 0.5, 2.0)]
    assert sorted(r["rule"] for r in issues.collect()) == ["corporate_action_date_invalid", "corporate_action_ratio_invalid"]


def test_new_master_rows_for_unknown_money_market_funds(spark):
    own = days(spark, [1.0], "shares", "a")
    other = days(spark, [5.0, 6.0], "shares", "m").withColumn("fund_type", F.lit("货币")).unionByName(days(spark, [7.0], "shares", "s").withColumn("fund_type", F.lit("股票")))
    shares, inserts = frames.money_market_supplement(own, own.select("security_id"), other)
    assert sorted((r["security_id"], r["shares"]) for r in shares.collect()) == [("a", 1.0), ("m", 5.0), ("m", 6.0)] and [r["security_id"] for r in inserts.collect()] == ["m"]


def test_of_a_days_change_unknown_parts_are_null_and_clean(spark):
    df = days(spark, [100.0, 200.0, None, 210.0], "shares")
    k = spark.createDataFrame([("s", dt.date(2026, 8, 8), 2.0), ("s", dt.date(2026, 8, 10), 2.0)], "security_id string, trade_date date, k double")
    got = [tuple(r)[2:] for r in flow.mechanical_split(df, k, "security_id", "trade_date").orderBy("trade_date").collect()]
    assert got == [(None, None, "clean"), (100.0, 0.0, "adjusted"), (None, None, "clean"), (None, None, "clean")]


def test_second_industry_alone_is_tagged_beside_the_first_and_negative_holdings_do_not_count(spark):
    held = [("x", "1", 30.0), ("x", "2", 25.0), ("x", "3", 20.0), ("x", "4", 25.0), ("y", "1", 50.0), ("y", "5", -30.0), ("y", "2", 50.0)]
    held += [("z", str(i), 20.0) for i in range(1, 5)] + [("z", "none", 20.0), ("w", "none", 5.0), ("v", "1", None)]
    holdings = spark.createDataFrame(held, "fund string, stock_id string, weight_pct double")
    industry = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C"), ("4", "D"), ("5", "A"), ("none", "")], "stock_id string, industry_name string")
    got = {(r["fund"], r["tag"], r["tag_type"]): (r["confidence"], r["coverage"]) for r in groups.industry_tags(holdings, industry, "fund", "2026-01-31").collect()}
    assert got == {("x", "A", "industry"): (0.3, 1.0), ("x", "B", "industry"): (0.25, 1.0), ("y", "A", "industry"): (0.5, 1.0), ("y", "B", "industry"): (0.5, 1.0), ("z", "B", "industry"): (0.2, 0.8), ("z", groups.BROAD_TAG, "style"): (0.85, 0.8)}


def test_a_report_counts_whole_and_its_fund_has_one_confidence(spark):
    d = dt.date
    rows = [("a", 1, d(2026, 3, 31), d(2026, 4, 20), 9.0), ("a", 2, d(2026, 3, 31), d(2026, 9, 1), 8.0), ("a", 3, d(2026, 3, 31), None, 7.0), ("a", 1, d(2025, 12, 31), d(2026, 1, 20), 9.0)]
    rows += [("b", 1, d(2026, 3, 31), d(2026, 4, 20), 9.0), ("b", 2, d(2026, 3, 31), d(2026, 4, 20), None), ("c", 1, d(2026, 3, 31), d(2026, 9, 1), 9.0)]
    h = spark.createDataFrame(rows, "fund string, stock_id int, report_date date, disclosed date, weight_pct double")
    funds = spark.createDataFrame([("a",), ("b",), ("c",)], "fund string")
    got = {(r["fund"], r["stock_id"]): (r["report_date"], r["rank"], r["confidence"]) for r in groups.latest_top(h, "fund", "2026-05-01", funds=funds).collect()}
    q = d(2026, 3, 31)
    assert got == {("a", 1): (q, 1, "limited"), ("a", 2): (q, 2, "limited"), ("a", 3): (q, 3, "limited"), ("b", 1): (q, 1, "exact"), ("b", 2): (q, 2, "exact"), ("c", None): (None, None, "missing")}


def test_as_of_a_day_what_is_not_mapped_is_missing_whatever_the_master_holds(spark):
    df = spark.createDataFrame([("i", "m"), (None, "m"), (None, None)], "mapped string, master string")
    past, now = pit.mapping_label(F.col("mapped"), F.col("master")), pit.mapping_label(F.col("mapped"), F.col("master"), False)
    assert [tuple(r) for r in df.select(past, now).collect()] == [("mapped_asof", "mapped_asof"), ("missing_asof", "master_latest"), ("missing_asof", None)]


def test_other_actions_multiply_by_their_ratio_and_a_chain_of_splits_is_exact(spark):
    start = dt.date(2026, 1, 1)
    held = spark.createDataFrame([("s", start + dt.timedelta(i), 10.0, 5.0, 1000.0) for i in range(60)], "security_id string, trade_date date, close double, nav double, shares double")
    rows = [("s", start + dt.timedelta(3), "OTHER", 2.0, None), ("s", start + dt.timedelta(4), "OTHER", None, 0.1), ("s", start + dt.timedelta(5), "DIVIDEND", 2.0, None)]
    actions = spark.createDataFrame(rows, "security_id string, action_date date, action_type string, k double, d double")
    factors, refused = adjust.multipliers(actions, held)
    assert sorted((r["channel"], r["m"]) for r in factors.collect()) == [("nav", 2.0), ("price", 2.0), ("shares", 2.0)]
    assert sorted((r["action_type"], r["reason"]) for r in refused.collect()) == [("DIVIDEND", "no_previous_close_or_amount"), ("OTHER", "bad_ratio")]
    chain = spark.createDataFrame([("s", start + dt.timedelta(i), "SPLIT", 2.0 if i % 2 else 0.75, None) for i in range(50)], actions.schema)
    last = adjust.adjusted(held, adjust.multipliers(chain, held)[0]).orderBy(F.desc("trade_date")).first()
    assert last["shares_factor"] == 2.0**25 * 0.75**25 and last["nav_factor"] == last["shares_factor"]
