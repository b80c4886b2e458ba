"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the session's checkpoint folder; where neither is set, local sessions get a temporary one, others an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='veilframe-checkpoint-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new place in the shared folder; it stays until clean() is called, as results are lazy."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, kind: str, **options: str | int | bool) -> DataFrame:
    """The DataFrame written to the shared folder as Parquet (options: of that writer) and read again: lineage ends, columns can be pruned."""
    path = fresh_path(df.sparkSession, kind)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this driver process has written so far, and says how many there were. Results that still read them must be stored before."""
    removed = 0
    while _made:
        place = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        removed += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
    return removed
