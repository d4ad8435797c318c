"""Tables in the folder that driver and executors share: lineage ends there and survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: What each application has written, in order.
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or by setCheckpointDir; a local one only in local mode (tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("no shared folder: set spark.checkpoint.dir to one that driver and executors can reach")
    return f"file://{_own_dir()}"


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="tidewell-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/tidewell-{app}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(app, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> int:
    """How many tables this application has stored so far."""
    return len(_MADE.get(spark.sparkContext.applicationId, []))


def drop(spark: SparkSession, since: int = 0, upto: int | None = None) -> None:
    """Delete the tables that were stored from number `since` on (to `upto`); nothing that still reads them may be used afterwards."""
    made = _MADE.get(spark.sparkContext.applicationId, [])
    upto = len(made) if upto is None else upto
    for k in range(since, upto):
        if made[k]:
            path = spark._jvm.org.apache.hadoop.fs.Path(made[k])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            made[k] = ""


@atexit.register
def _at_exit() -> None:
    """A session that still stands when Python ends takes its tables with it."""
    context = SparkContext._active_spark_context
    spark = SparkSession.getActiveSession() if context is not None and context._jsc is not None else None
    if spark is not None:
        try:
            drop(spark)
        except Exception:  # noqa: BLE001  the gateway may be gone already
            pass
