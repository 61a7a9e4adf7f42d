"""Cutting lineage: tables written into the cluster's shared folder and read back.

Every process stages under one folder of its own in the shared folder;
``drop_staged`` (also called when the process ends) removes that folder alone,
so jobs that share the folder never delete each other's tables.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = f"quarry-{uuid.uuid4().hex}"
_LOCAL_DEFAULT: list[str] = []
_USED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode, where it may be unset, else one folder for this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_DEFAULT:
        _LOCAL_DEFAULT.append("file://" + tempfile.mkdtemp(prefix="quarry-shared-"))
    return _LOCAL_DEFAULT[0]


def staging_dir(spark: SparkSession) -> str:
    """This process's own folder in the shared folder."""
    path = f"{shared_dir(spark)}/{_RUN}"
    if path not in _USED:
        _USED[path] = spark
        atexit.register(_at_exit, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a reader of it."""
    path = f"{staging_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every table that this process staged; frames that still read one fail afterwards."""
    for path in [p for p in _USED if p.startswith(shared_dir(spark) + "/")]:
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
        del _USED[path]


def _at_exit(path: str) -> None:
    spark = _USED.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the gateway may be gone already
            root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
