"""Intermediate tables in the folder that all executors share.

Iterative and order-dependent operators cut their lineage by writing a Parquet table and
reading it back: it is computed once, survives the loss of executors, and its file sizes
let Spark decide for itself whether a later join may broadcast it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the warehouse folder if that is unset.

    By default the warehouse is a folder of the machine at hand. On a cluster other machines would
    write elsewhere and the driver would read an empty table, so that is refused.
    """
    folder = spark.conf.get(FOLDER_SETTING, None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        if scheme_of(spark, folder) == "file" and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"set {FOLDER_SETTING} to a folder that all executors reach; {folder} is local to each machine")
    return folder.rstrip("/")


def scheme_of(spark: SparkSession, folder: str) -> str:
    """The file system of a folder, that of the session's default if its name has none."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return (folder if ":/" in folder else default).split(":")[0]


def run_folder(spark: SparkSession) -> str:
    """Where the intermediate tables of this application lie."""
    return f"{shared_folder(spark)}/tesserae/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application; call it when no result is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def read_stored(like: DataFrame, *paths: str) -> DataFrame:
    """Scan of tables written from frames with the schema of ``like``."""
    return like.sparkSession.read.schema(like.schema).parquet(*paths)


def store(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once and return it as a scan of the written table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return read_stored(df, path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions a scan that Spark cuts into few pieces.

    A file with one row group is read by one task, which would then do all the work up to the
    next shuffle. Scans in many pieces are returned unchanged, without a shuffle; the rows are
    the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > 4 * cores else df.repartition(cores, *keys)
