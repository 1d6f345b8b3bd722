"""Cutting the lineage of iterative computations through the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder (tests); on a
    cluster that is an error, since executors would write to disks of their own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="latticework-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read back: each round of a loop is planned afresh, is
    computed once, and survives lost executors. The tables stay until `clear`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/latticework-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove the tables that `cut` left, once no result that was made from them is needed any more."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "latticework-step-*")) or []:
        fs.delete(entry.getPath(), True)
