"""The cluster's shared folder, and tables kept there between jobs."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and everything runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="mediacat-catalogue-"))
    return _LOCAL[0]


_KEPT: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _delete_all() -> None:
    """At the end of the driver's process: what nobody has dropped before.  Without a session there is nothing to delete by."""
    while _KEPT:
        with contextlib.suppress(Exception):
            _delete(*_KEPT.pop())


def kept(df: DataFrame, cluster_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, so that its lineage ends there.  With ``cluster_by`` the rows
    come in ranges of that column, sorted, and a filter on it reads few of them.  What is not dropped goes when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    out = df.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by) if cluster_by else df
    if not _KEPT:
        atexit.register(_delete_all)
    _KEPT.append((spark, path))
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(*tables: DataFrame) -> None:
    """Deletes tables that ``kept`` has written and nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)
