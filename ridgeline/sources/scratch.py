"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder serves a local session alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="ridgeline-"))
        folder = _own[0]
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


class Growing:
    """A written table that rows are added to; reading it is one scan, however often it grew."""

    def __init__(self, df: DataFrame, name: str):
        self._first = materialize(df, name)

    def add(self, df: DataFrame) -> Growing:
        df.write.mode("append").parquet(self._first._scratch)
        return self

    def read(self) -> DataFrame:
        return self._first.sparkSession.read.schema(self._first.schema).parquet(self._first._scratch)


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing will read again."""
    delete(df.sparkSession, df._scratch)


def delete(spark: SparkSession, path: str) -> None:
    """Delete what lies under path in the shared folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written[:] = [x for x in _written if x != (spark, path)]


def release(spark: SparkSession) -> None:
    """Delete what this session has materialized; results that still read it must be stored before."""
    for path in [p for owner, p in _written if owner is spark]:
        delete(spark, path)


@atexit.register
def _at_exit() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            release(spark)
        except Exception:  # the session is gone already
            return
