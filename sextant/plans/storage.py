"""Intermediate tables in storage that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a temporary folder, but only if all runs on one machine: else nobody else could read it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master.startswith("local") and not master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df under the shared folder and reads it back; the table goes when the session ends, or by discard."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _file(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that `written` made, when nothing that is still to run reads it."""
    if path := getattr(df, "_written_at", None):
        at, fs = _file(df.sparkSession, path)
        fs.delete(at, True)


_KEPT: dict[tuple, str] = {}


def kept(inputs: DataFrame, name: str, build) -> DataFrame:
    """build(), stored once for the files of `inputs` as they are now, and read from there as long as the session lasts.

    Files count as the same if their paths, lengths and times of change are.
    """
    spark = inputs.sparkSession
    said = []
    for path in sorted(inputs.inputFiles()):
        at, fs = _file(spark, path)
        status = fs.getFileStatus(at)
        said.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    key = (spark.sparkContext.applicationId, shared(spark), name, hashlib.sha256("\n".join(said).encode()).hexdigest())
    if key in _KEPT:
        at, fs = _file(spark, _KEPT[key])
        if not fs.exists(at):  # somebody has cleared the folder
            del _KEPT[key]
    if key not in _KEPT:
        _KEPT[key] = written(build(), name)._written_at
    return spark.read.parquet(_KEPT[key])


#: Inputs up to this many bytes may come in fewer row groups than there are cores.
SMALL = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt to all cores, for work that costs more than moving it; larger ones, which have many row groups, are left as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df
