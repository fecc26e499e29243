"""Stage boundaries: results that several later steps read are written once."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a single-process session (``local[...]``) uses a folder of its own that is
    deleted when the process ends; any other master raises, since executors would each write to
    their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="signalops-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder: two applications never see or delete each other's tables."""
    return f"{shared_folder(spark)}/signalops/{re.sub(r'[^A-Za-z0-9_-]', '_', spark.sparkContext.applicationId)}"


def cut(df: DataFrame) -> DataFrame:
    """Write the frame as a table in the shared folder and read it back.

    Used where a computed frame feeds more than one later step: it is computed once, both
    uses see the same floats, a lost executor costs a re-read, and the planner knows its size.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete every table that ``cut`` wrote for this application; call when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
