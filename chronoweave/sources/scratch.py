"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost
executor therefore never takes an intermediate result with it.  A folder of
our own is made only when the setting is absent and Spark runs in one local
process (tests, notebooks).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from chronoweave.errors import StorageError

_LOCAL: dict[str, str] = {}
_KNOWN: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """Root of this application's scratch tables (a Hadoop path)."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    app = context.applicationId
    if not base:
        if not context.master.startswith(("local[", "local-cluster")) and context.master != "local":
            raise StorageError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _LOCAL:
            folder = tempfile.mkdtemp(prefix="chronoweave-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _LOCAL[app] = f"file://{folder}"
        base = _LOCAL[app]
    root = f"{base.rstrip('/')}/chronoweave-{app}"
    if app not in _KNOWN:
        _KNOWN.add(app)
        # Gone with the application; until then lost executors can read everything back.
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared root; two calls never share one."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(frame: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``frame`` once to the shared folder and return the table read back."""
    spark = frame.sparkSession
    target = path or scratch_path(spark, label)
    frame.write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.schema(frame.schema).parquet(target)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; silently does nothing if it is gone."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
