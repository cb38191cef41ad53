"""Tables in the folder that driver and executors share: they cut lineages and outlive executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; without that it is an error there, as a folder of the
    driver's machine would not reach the executors. Only a local master (one machine, as in tests) gets a
    temporary folder, set for this session and removed at exit.
    """
    path = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT} to a folder that the driver and the executors of {master} share")
        path = f"file://{tempfile.mkdtemp(prefix='lanternfish-')}"
        spark.conf.set(CHECKPOINT, path)
        spark.sparkContext.setCheckpointDir(path)
        atexit.register(shutil.rmtree, path.removeprefix("file://"), True)
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, which holds all that it writes there."""
    return f"{shared_dir(spark)}/lanternfish-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    own = own_dir(spark)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(own)
    # the JVM deletes the folder when it ends, wherever the folder is
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder: to be called once results that
    still read such tables have been stored elsewhere."""
    delete_path(spark, own_dir(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: lineage ends at files that
    outlive any executor, and what follows does not compute ``df`` twice."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what :func:`written` wrote; only for tables that no later result reads."""
    delete_path(df.sparkSession, df._shared_path)
