"""A fact table in hash buckets with a manifest for each version [P1, A2]: a merge rewrites the buckets that it touches.

Below the table's folder, data/<version>/bucket=<b>/ holds Parquet files and manifest/<version>/ one JSON row for each bucket
with the version whose files it has now.  A version exists once its manifest has been renamed into place, so readers see
whole versions only; versions are named by their number, and the batch that made one is kept with it, so that a batch
which is delivered again after a crash is not merged twice.  Writers of one number conflict and the later one fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitmart.operators.merge import merge_keyed

BUCKETS = 64
_MANIFEST = "bucket int, held int, batch string"


def newest_of_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by `order`, of equal ones the greatest by content; a key with very many rows meets as
    partial maxima."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest)))
    return rows.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*").select(*rows.columns)


class FactStore:
    """Facts by `keys` below `path`, in as many buckets as the table was made with (at most `buckets` rows a manifest)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType | str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def _at(self, *names: str):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self._at("manifest")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict[int, tuple[int, str | None]]:
        """Bucket -> (the version that holds its files, the batch that made this version)."""
        found = self.versions()
        if not found:
            return {}
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest/{found[-1] if version is None else version}").collect()
        return {r["bucket"]: (r["held"], r["batch"]) for r in rows}

    def _folders(self, manifest: dict[int, tuple[int, str | None]], buckets: list[int] | None = None) -> list[str]:
        return [f"{self.path}/data/{held}/bucket={b}" for b, (held, _) in sorted(manifest.items()) if b >= 0 and (buckets is None or b in buckets)]

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The table as of a version; keys: a frame of few keys, whose buckets alone are read."""
        wanted = None if keys is None else [r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()]
        folders = self._folders(self.manifest(version), wanted)
        df = self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)
        return df if keys is None else df.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def merge(self, rows: DataFrame, order: str, batch: str | None = None, newest: bool = True, **policy: list[str]) -> list[int]:
        """Merges rows by key (merge_keyed's policy) and gives the buckets it wrote.  Rows of one key count as the last by
        `order`; newest: rows older than what is there change nothing.  A batch that is the last one merged is skipped."""
        now = self.manifest()
        if batch is not None and now and next(iter(now.values()))[1] == batch:
            return []
        good = newest_of_key(rows.select(*self.schema.names), self.keys, order).withColumn("_bucket", self.bucket())
        touched = sorted(r["_bucket"] for r in good.select("_bucket").distinct().collect())  # self.buckets at most
        if not touched and now:
            return []
        version = (self.versions() or [-1])[-1] + 1
        folders = self._folders(now, touched)
        if folders:
            old = self.spark.read.schema(self.schema).parquet(*folders)
            if newest:
                held = old.select(*(F.col(k).alias(f"_{k}") for k in self.keys), F.col(order).alias("_held"))
                same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
                good = good.join(held, same, "left").where(F.col("_held").isNull() | (F.col(order) >= F.col("_held"))).select(*good.columns)
            good = merge_keyed(old, good.drop("_bucket"), self.keys, **policy).withColumn("_bucket", self.bucket())
        out = good.withColumnRenamed("_bucket", "bucket").repartition(len(touched) or 1, "bucket")
        out.select(*self.schema.names, "bucket").sortWithinPartitions("bucket", *self.keys).write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/{version}")
        self._commit(version, {b: held for b, (held, _) in now.items() if b >= 0} | dict.fromkeys(touched, version), batch)
        return touched

    def _commit(self, version: int, held: dict[int, int], batch: str | None) -> None:
        draft, to = f"_draft-{uuid.uuid4().hex}", str(version)
        rows = [(b, v, batch) for b, v in sorted(held.items())] or [(-1, version, batch)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(f"{self.path}/manifest/{draft}")
        source, fs = self._at("manifest", draft)
        target, _ = self._at("manifest", to)
        if fs.exists(target) or not fs.rename(source, target):
            raise RuntimeError(f"version {version} of {self.path} was written meanwhile")

    def vacuum(self, keep: int = 2) -> list[int]:
        """Deletes the manifests of all but the last `keep` versions, and the data that no kept one holds."""
        found = self.versions()
        kept, gone = found[-keep:], found[:-keep]
        held = {(b, v) for n in kept for b, (v, _) in self.manifest(n).items()}
        for b, v in {(b, v) for n in gone for b, (v, _) in self.manifest(n).items()} - held:
            at, fs = self._at("data", str(v), f"bucket={b}")
            fs.delete(at, True)
        for n in gone:
            at, fs = self._at("manifest", str(n))
            fs.delete(at, True)
        return gone


def write_history(df: DataFrame, path: str, key: str = "security_id", date: str = "trade_date", month: str = "month") -> None:
    """[A2] Facts by month and, in it, sorted by key: a scan up to a day reads its months, and of their files the row
    groups of the keys."""
    by = df.withColumn(month, F.date_format(date, "yyyy-MM"))
    by.repartitionByRange(month, key, date).sortWithinPartitions(month, key, date).write.mode("overwrite").partitionBy(month).parquet(path)


def read_history(spark: SparkSession, path: str, ids: list[str], asof: str, key: str = "security_id", date: str = "trade_date", month: str = "month") -> DataFrame:
    """[A2] The facts of some keys up to a day, oldest first, from what write_history wrote; the month prunes folders."""
    rows = spark.read.parquet(path)
    rows = rows.where((F.col(month).cast("string") <= F.date_format(F.lit(asof).cast("date"), "yyyy-MM")) & F.col(key).isin(ids) & (F.col(date) <= F.lit(asof).cast("date")))
    return rows.drop(month).orderBy(key, date)
