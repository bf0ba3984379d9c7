"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_held: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode one of our own where that is unset, on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='folioflow-')}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that no lost executor makes its lineage run again.

    The table goes when it is discarded, or at the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _held[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out = out.select(*keys) if keys else out
    out._folioflow_path = path
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over two partitions for each core, by ``keys``. Tables of few bytes are read, and merged after a shuffle, as one
    partition; that is one task, however long their rows take to work on."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def discard(*tables: DataFrame) -> None:
    """Deletes ``written`` tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_folioflow_path", None)
        if path in _held:
            _delete(path)


def held() -> set[str]:
    """The ``written`` tables that are there."""
    return set(_held)


def discard_since(before: set[str], *keep: DataFrame) -> None:
    """Deletes the ``written`` tables made since ``before`` (what ``held`` gave then) but for those in ``keep``."""
    kept = {getattr(df, "_folioflow_path", None) for df in keep}
    for path in set(_held) - before - kept:
        _delete(path)


def _delete(path: str) -> None:
    jvm = _held.pop(path)._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_held):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the engine may be gone by now
            return
