"""Sinks and logs beside the data [A1, A2, A6, A8, A10, A11]: Parquet by partition, append-only logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pitmart.operators.merge import merge_keyed

RUN = "run_id string, dataset string, source string, started_at timestamp, ended_at timestamp, fetched long, written long, rejected long, status string, message string"
ISSUE = "issue_id string, dataset string, security_id string, trade_date date, severity string, rule string, details string"


def write_raw(df: DataFrame, path: str, source: str, dataset: str, date: str) -> None:
    """[A1] A snapshot under source=/dataset=/date=; the same key is overwritten, others stay."""
    rows = df.withColumn("source", F.lit(source)).withColumn("dataset", F.lit(dataset)).withColumn("date", F.lit(date))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "dataset", "date").parquet(path)


def write_mart(df: DataFrame, path: str, version: str, date: str = "trade_date", at: Column | None = None) -> None:
    """[A6] Derived rows of one version, by version and month; a month that is written again is replaced, so a repeated
    run gives the same table; other versions and months stay."""
    rows = df.withColumn("calculated_at", at if at is not None else F.current_timestamp()).withColumn("calculation_version", F.lit(version)).withColumn("month", F.date_format(date, "yyyy-MM"))
    rows.repartition("calculation_version", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("calculation_version", "month").parquet(path)


def status(fetched: Column, written: Column, failed: Column) -> Column:
    """[A8] FAILED, SKIPPED without anything fetched, PARTIAL if less was written than fetched, SUCCESS."""
    return F.when(failed, "FAILED").when(fetched == 0, "SKIPPED").when(written < fetched, "PARTIAL").otherwise("SUCCESS")


def recorded(fetched: DataFrame, valid: Column, write: Callable[[DataFrame], None], log: str, run_id: str, dataset: str, source: str, stands: Callable[[], int] | None = None) -> str:
    """[A8] Hands the valid rows of a fetched frame to write and appends one row to the run log, whether that succeeds or
    not; an error is raised again.  The rows are counted by the write job itself, in its one pass over them; of a job that
    failed they are what it had counted, 0 if nothing, and none counts as written.  stands: how many rows a sink that
    drops or merges rows has written, where that are not all it was handed."""
    import datetime as dt

    spark, seen = fetched.sparkSession, Observation()
    good = fetched.withColumn("_valid", F.coalesce(valid, F.lit(False))).observe(seen, F.count("*").alias("fetched"), F.count_if("_valid").alias("valid")).where("_valid").drop("_valid")
    began, counts, message = dt.datetime.now(dt.UTC), (0, 0, 0), None
    try:
        write(good)
        n, ok = (seen.get[c] for c in ("fetched", "valid"))
        counts = (n, ok if stands is None else stands(), n - ok)
    except Exception as error:
        message = f"{type(error).__name__}: {error}"[:500]
        n = _counted(seen)
        counts = (n, 0, 0)
        raise
    finally:
        row = spark.createDataFrame([(run_id, dataset, source, began, dt.datetime.now(dt.UTC), *counts, "", message)], RUN)
        row.withColumn("status", status(F.col("fetched"), F.col("written"), F.col("message").isNotNull())).write.mode("append").parquet(log)
    return run_id


def _counted(seen: Observation, seconds: float = 5) -> int:
    """What a job that failed had counted; one that never began never tells, so it is waited for in vain but briefly."""
    import threading

    told: list[int] = []
    waiting = threading.Thread(target=lambda: told.append(int(seen.get.get("fetched", 0))), daemon=True)
    waiting.start()
    waiting.join(seconds)
    return told[0] if told else 0


def issue_rows(issues: DataFrame, dataset: str, security: Column, date: Column, details: Column, severity: str = "WARN") -> DataFrame:
    """[A10] Refused rows (with their rule) in the shape of the issue table; the id is a digest of what it tells."""
    named = [F.lit(dataset).alias("dataset"), security.cast("string").alias("security_id"), date.cast("date").alias("trade_date"), F.lit(severity).alias("severity"), F.col("rule"), details.cast("string").alias("details")]
    rows = issues.select(*named)
    return rows.select(F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), 256).alias("issue_id"), *rows.columns)


def append_issues(issues: DataFrame, path: str) -> None:
    """[A10]"""
    issues.write.mode("append").partitionBy("dataset").parquet(path)


def map_and_master(master: DataFrame, mapping: DataFrame, new: DataFrame, fund: str) -> tuple[DataFrame, DataFrame]:
    """[A11] New mapping rows (fund, index_id, index_name, valid_from) merged by fund, index and start, and the master with
    the index of each fund's latest new row."""
    merged = merge_keyed(mapping, new, [fund, "index_id", "valid_from"])
    last = new.groupBy(fund).agg(F.max_by(F.struct("index_id", "index_name"), F.struct("valid_from", "index_id")).alias("_new"))
    out = master.join(last, fund, "left")
    for c, own in (("index_id", "tracking_index_id"), ("index_name", "tracking_index_name")):
        out = out.withColumn(own, F.coalesce(F.col("_new")[c], F.col(own)))
    return merged, out.drop("_new")
