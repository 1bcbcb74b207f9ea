"""Cutting lineage with tables in the shared folder, so that a lost executor costs no recomputation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local applications that name none, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Where it is unset, a local session (as in tests) gets a temporary folder, deleted when Python
    ends; on a cluster that is an error, as executors would each write to a disk of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return "file://" + _local[app]


def written(df: DataFrame, what: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder; ``instead_of``, written before and needed for df only, is deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written_at"] = path
    if instead_of is not None:
        discard(instead_of)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing will read again."""
    for df in tables:
        if at := df.__dict__.pop("_written_at", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
