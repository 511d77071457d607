"""Tables in the folder that driver and executors share: written, read back, and deleted once nothing needs them."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Tables made in the scope that is open in this thread; each thread of a driver has its own.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this process where it is unset and Spark runs in one JVM."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="pitmart-")
    return _OWN[app]


def new_folder(spark: SparkSession, kind: str = "pitmart") -> str:
    """The name of a folder below the shared one that nobody else has."""
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark)
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialised frame that nothing reads any more."""
    spark = df.sparkSession
    base = shared_dir(spark).split("://", 1)[-1].split(":", 1)[-1]
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if base in root and "/pitmart/" in root:
            delete(spark, root)


def tidy(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """make, whose result is materialised and whose own materialised frames are deleted once it stands, or once it failed."""

    @functools.wraps(make)
    def made(*args, **kwargs) -> DataFrame:  # noqa: ANN002, ANN003
        outer = _MADE.set(own := [])
        spark = SparkSession.active()
        try:
            out = make(*args, **kwargs)
            path = new_folder(spark)
            out.write.parquet(path)
        finally:
            _MADE.reset(outer)
            for used in own:
                delete(spark, used)
        if (around := _MADE.get()) is not None:
            around.append(path)
        return spark.read.schema(out.schema).parquet(path)

    return made
