"""Streams against their batch forms."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pitmart.operators import market
from pitmart.sources import store
from pitmart.streaming import steps


def files(df, path, n):
    """df dealt to n files in order of the day, read as a stream of one file a batch."""
    for k, part in enumerate(n):
        df.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")


def stream(spark, df, path, parts):
    files(df, path, parts)
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_stepwise_confirmation_equals_batch(spark, tmp_path):
    r = random.Random(1)
    start = dt.date(2026, 1, 1)
    rows = [(k, start + dt.timedelta(i), r.choice(["STRONG", "WEAK", "NEUTRAL", "UNKNOWN"]), i // 10) for k in "ab" for i in range(30)]
    df = spark.createDataFrame(rows, "k string, d date, s string, part int")
    out = steps.confirm_steps(stream(spark, df, str(tmp_path / "in"), range(3)), "k", "d", "s")
    q = out.writeStream.format("memory").queryName("confirmed_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((x["k"], x["d"], x["confirmed"]) for x in spark.table("confirmed_rows").collect())
    want = sorted((x["k"], x["d"], x["confirmed"]) for x in market.confirmed(df.drop("part"), "k", "d", "s").collect())
    assert got == want


def health_rows(spark, df, tmp_path, parts, **options):
    """(batch, source, last_success, last_failure, failures, idle) as they come, and the highest number of state rows."""
    found = []
    with steps.rocksdb(spark):
        out = steps.source_health(stream(spark, df, str(tmp_path / "in"), parts), "k", "at", "failed", **options)
        q = out.writeStream.outputMode("update").foreachBatch(lambda b, n: found.extend((n, *r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
    return found


def test_source_health_equals_rollup_after_each_batch(spark, tmp_path):
    r = random.Random(2)
    start = dt.datetime(2026, 1, 1)
    rows = [("ab"[i % 5 == 0], start + dt.timedelta(minutes=i + r.randint(-4, 4)), r.random() < 0.8, i // 40) for i in range(120)]
    rows += [("c", start + dt.timedelta(minutes=i), True, i // 40) for i in range(0, 120, 3)] + [("d", start, False, 0), (None, start, True, 0)]
    df = spark.createDataFrame(rows, "k string, at timestamp, failed boolean, part int").repartition(5)
    found = health_rows(spark, df, tmp_path, range(3), late="20 minutes")
    for n in range(3):
        so_far = df.where(F.col("part") <= n).select(F.coalesce("k", F.lit("")).alias("k"), "at", "failed")  # a source without a name is one
        want = {x["k"]: tuple(x)[1:] for x in steps.health_rollup(so_far, "k", "at", "failed").collect()}
        now = {k: rest[:3] for b, k, *rest in found if b == n}
        assert now and {k: tuple(v) for k, v in now.items()} == {k: want[k] for k in now}
        assert set(now) == {(k or "") for k, _, _, part in rows if part == n}


def test_an_idle_source_is_told_once(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rows = [("quiet", start, True, 0), ("busy", start, False, 0), ("busy", start + dt.timedelta(hours=3), True, 1), ("busy", start + dt.timedelta(hours=4), True, 2), ("busy", start + dt.timedelta(hours=5), True, 3)]
    df = spark.createDataFrame(rows, "k string, at timestamp, failed boolean, part int")
    found = health_rows(spark, df, tmp_path, range(4), late="1 minute", idle_ms=3_600_000 * 2)
    told = [(k, n) for _, k, _, _, n, idle in found if idle]
    assert told.count(("quiet", 1)) == 1 and not any(k == "quiet" for k, _ in told[1:])


def taken(spark, df, tmp_path, table, parts, name="", **options):
    q = steps.ingest(stream(spark, df, str(tmp_path / f"in{name}"), parts), table, "seq", str(tmp_path / f"c{name}"), valid="v is null or v <> 'bad'", **options)
    q.awaitTermination(240)
    return q


def content(table):
    return sorted(map(tuple, table.read().select("k", "v").collect()))


def test_ingest_is_idempotent_and_leaves_untouched_buckets(spark, tmp_path):
    rows = [(k, "a", 1, 0) for k in range(40)] + [(1, None, 2, 1), (2, "c", 2, 1), (3, "bad", 2, 1), (1, "old", 0, 2)]
    df = spark.createDataFrame(rows, "k int, v string, seq int, part int")
    table = store.FactStore(spark, str(tmp_path / "table"), ["k"], "k int, v string, seq int", 8)
    taken(spark, df, tmp_path, table, [0])
    first = table.manifest()
    files = sorted(p for p in (tmp_path / "table").rglob("*.parquet"))
    times = {p: p.stat().st_mtime_ns for p in files}
    assert len(first) == 8 and content(table) == [(k, "a") for k in range(40)]
    taken(spark, df, tmp_path, table, [1], "two")
    second = table.manifest()
    touched = {r[0] for r in spark.createDataFrame([(1,), (2,)], "k int").select(table.bucket()).collect()}
    assert {b for b in second if second[b] != first[b] and second[b][0] != first[b][0]} == touched
    assert {p: p.stat().st_mtime_ns for p in files} == times
    want = [(0, "a"), (1, "a"), (2, "c"), *((k, "a") for k in range(3, 40))]
    assert content(table) == want
    taken(spark, df, tmp_path, table, [2], "three", newest=True)  # older than what is there
    assert content(table) == want
    version = table.versions()[-1]
    assert table.merge(df.where("part = 1 and v <> 'bad'").drop("part"), "seq", batch="again") and table.merge(df.where("part = 0").drop("part"), "seq", batch="again") == []
    assert content(table) == want and table.versions()[-1] == version + 1
    assert sorted(r["k"] for r in table.read(keys=spark.createDataFrame([(1,), (77,)], "k int")).collect()) == [1]
    assert sorted(map(tuple, table.read(0).select("k", "v").collect())) == [(k, "a") for k in range(40)]
    table.vacuum(1)
    assert content(table) == want and table.versions() == [version + 1]


def test_repeats_within_the_watermark_are_dropped_and_the_state_is_bounded(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rows = [(i % 50, f"v{i}", i, start + dt.timedelta(days=i // 20), i // 200) for i in range(1000)]
    rows += [(k, "changed", seq, at, part) for k, _, seq, at, part in rows[::7]]
    rows += [(7, "late", 2_000, start, 4)]  # older than the watermark
    df = spark.createDataFrame(rows, "k int, v string, seq int, at timestamp, part int")
    table = store.FactStore(spark, str(tmp_path / "table"), ["k"], "k int, v string, seq int", 4)
    q = taken(spark, df, tmp_path, table, range(5), newest=True, at="at", late="3 days")
    states = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert sum(s["customMetrics"].get("numDroppedDuplicateRows", 0) for s in states) >= len(rows[:1000:7]) - 1
    assert max(s["numRowsTotal"] for s in states) < 600 and sum(s["numRowsDroppedByWatermark"] for s in states) == 1
    assert sorted(r["seq"] for r in table.read().collect()) == list(range(950, 1000))
