"""Makes this package importable on Spark's Python workers, and names the folder that all of them share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: dict[str, bool] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """In a local session the package's folder goes on the workers' path; on a cluster they get the package as an archive."""
    sc = spark.sparkContext
    if is_local(spark):
        env, root = sc.environment, os.path.dirname(PACKAGE)
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    elif not _SHIPPED.get(sc.applicationId):
        path = os.path.join(tempfile.mkdtemp(prefix="package-"), "package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, files in os.walk(PACKAGE):
                for f in sorted(files):
                    if f.endswith(".py"):
                        whole = os.path.join(folder, f)
                        archive.write(whole, os.path.relpath(whole, os.path.dirname(PACKAGE)))
        sc.addPyFile(path)  # Spark's own file server hands it out
        _SHIPPED[sc.applicationId] = True


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is named, one of our own, in local sessions only."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def kept(df: DataFrame) -> DataFrame:
    """df computed once, written to the shared folder and read from there: whatever is derived from it sees the same rows in
    the same partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is no more than one task reads at once: a small table, of which a file's only row group
    would else be one task's work. Any other stays as it is read. For what takes long per row."""
    spark = df.sparkSession
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= most else df
