"""Queries of the streaming steps by inventory ID: each runs its stream over the given tables until all is taken in, and
reads what it has written to the shared folder."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pitmart import storage
from pitmart.panels import panel, panel_sql
from pitmart.queries import SQL, add
from pitmart.queries_pulse import confirmed_sql
from pitmart.sources import sinks, store
from pitmart.streaming import steps

def shared_folder(spark: SparkSession) -> str:
    return storage.new_folder(spark, "streams")


def _taken_in(df: DataFrame, at: str, order: str, start: Callable[[DataFrame], StreamingQuery], n: int = 3) -> None:
    """df's rows in n deliveries in order of a column: each is written and taken in, as one microbatch, by a query that
    goes on from the checkpoint of the one before."""
    place = F.col(order).cast("double") if dict(df.dtypes)[order] != "date" else F.unix_date(order).cast("double")
    cuts = df.select(place.alias("x")).approxQuantile("x", [k / n for k in range(1, n)], 0.01)
    for k in range(n):
        part = df if k == 0 else df.where(place > cuts[k - 1])
        (part if k == n - 1 else part.where(place <= cuts[k])).write.mode("append").parquet(f"{at}/in")
        start(df.sparkSession.readStream.schema(df.schema).parquet(f"{at}/in")).awaitTermination()


@add("P1_incremental_ingest", "SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS last_order, max_by(o_totalprice, o_orderkey) AS price FROM orders WHERE o_totalprice > 2000 GROUP BY 1", "price")
def _p1(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark)
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("timestamp").alias("at"))
    rows = rows.unionByName(rows.where("last_order % 10 = 0"))  # some come twice
    table = store.FactStore(spark, f"{at}/table", ["o_custkey"], rows.drop("at").schema, 16)
    _taken_in(rows, at, "at", lambda stream: steps.ingest(stream, table, "last_order", f"{at}/checkpoint", "price > 2000", newest=True, at="at", late="30 days"))
    return table.read()


@add("P2_stepwise_confirmation", f"{panel_sql('states')}, w AS (SELECT series_id, day AS trade_date, state AS s_raw FROM states), {confirmed_sql('w', 'series_id', ['s'], 'c')} SELECT series_id, trade_date AS day, s_raw AS state, s_state AS confirmed, FALSE AS late FROM c_s")
def _p2(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark)

    def start(stream: DataFrame) -> StreamingQuery:
        out = steps.confirm_steps(stream, "series_id", "day", "state")
        return out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()

    _taken_in(panel(spark, d, "states"), at, "day", start)
    return spark.read.parquet(f"{at}/out")


@add("P3_source_health_stream", SQL["A9_source_health"])
def _p3(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark)
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 3 == 0).alias("failed"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{at}/out")

    def start(stream: DataFrame) -> StreamingQuery:
        return steps.source_health(stream, "event_type", "ts", "failed").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()

    with steps.rocksdb(spark):
        _taken_in(rows, at, "ts", start)
    last = spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.max_by(F.struct("last_success", "last_failure", "failures_in_a_row"), "batch").alias("x")).select("event_type", "x.*")
    return last.select("event_type", F.col("last_success").cast("timestamp_ntz").alias("last_success"), F.col("last_failure").cast("timestamp_ntz").alias("last_failure"), "failures_in_a_row")


# A: sinks that write and are read again
@add("A2_history_scan", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderdate <= DATE '1995-03-15'")
def _a2(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark)
    store.write_history(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"), at, "o_orderpriority", "o_orderdate")
    return store.read_history(spark, at, ["1-URGENT", "5-LOW"], "1995-03-15", "o_orderpriority", "o_orderdate").select("o_orderkey", "o_custkey", "o_orderdate")


@add("A8_run_log", "SELECT 'r' || CAST(m AS VARCHAR) AS run_id, 'orders' AS dataset, count(*) AS fetched, CASE WHEN m % 4 = 3 THEN 0 ELSE count(*) FILTER (WHERE ok) END AS written, CASE WHEN m % 4 = 3 THEN 0 ELSE count(*) FILTER (WHERE NOT ok) END AS rejected, CASE WHEN m % 4 = 3 THEN 'FAILED' WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM (SELECT month(o_orderdate) % 4 AS m, month(o_orderdate) % 4 = 1 OR o_orderkey % 7 <> 0 AS ok FROM orders) GROUP BY m")
def _a8(spark: SparkSession, d: str) -> DataFrame:
    at, rows = shared_folder(spark), spark.read.parquet(f"{d}/orders.parquet")

    def write(good: DataFrame, n: int) -> None:
        good.select("o_orderkey").write.parquet(f"{at}/rows-{n}")
        if n == 3:
            raise OSError("the disk is full")

    for n in range(4):
        month = rows.where(F.month("o_orderdate") % 4 == n)
        with contextlib.suppress(OSError):
            sinks.recorded(month, (F.month("o_orderdate") % 4 == 1) | (F.col("o_orderkey") % 7 != 0), lambda good, n=n: write(good, n), f"{at}/log", f"r{n}", "orders", "vendor")
    return spark.read.schema(sinks.RUN).parquet(f"{at}/log").select("run_id", "dataset", "fetched", "written", "rejected", "status")


@add("A1_raw_snapshots", "SELECT c_custkey, c_name, 'vendor' AS source, 'customers' AS dataset, DATE '2026-08-07' AS date FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, 'vendor', 'customers', DATE '2026-08-08' FROM customer WHERE c_custkey % 5 = 0")
def _a1(spark: SparkSession, d: str) -> DataFrame:
    at, rows = shared_folder(spark), spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")
    for date, n in (("2026-08-07", 3), ("2026-08-08", 5), ("2026-08-07", 2)):  # the first is delivered again
        sinks.write_raw(rows.where(F.col("c_custkey") % n == 0), at, "vendor", "customers", date)
    return spark.read.parquet(at)


@add("A6_versioned_mart", f"{panel_sql('shares')} SELECT security_id, trade_date, shares * CASE WHEN v = 'flow_v2' THEN 2 ELSE 1 END AS shares, v AS calculation_version FROM shares, (SELECT unnest(['flow_v1', 'flow_v2']) AS v)", "shares")
def _a6(spark: SparkSession, d: str) -> DataFrame:
    at, rows = shared_folder(spark), panel(spark, d, "shares").select("security_id", "trade_date", "shares")
    sinks.write_mart(rows, at, "flow_v1")
    for times in (3, 2):  # the second run of one version replaces the first
        sinks.write_mart(rows.withColumn("shares", F.col("shares") * times), at, "flow_v2")
    return spark.read.parquet(at).select("security_id", "trade_date", "shares", "calculation_version")
