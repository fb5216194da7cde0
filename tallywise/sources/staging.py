"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
#: Spark's own setting (4.1): a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Where that is unset, a folder in the warehouse, which a cluster shares too; a temporary one only if all runs on one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        local = spark.sparkContext.master.split("[")[0] == "local"
        _FOLDERS[app] = tempfile.mkdtemp(prefix="tallywise-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tallywise-{app}"
    return _FOLDERS[app]


def staged(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage in a way that survives lost executors, and gives the planner true sizes.  The shuffle files of the
    write go with it; otherwise a long chain of steps would keep all of them on the executors' disks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
