"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a temporary one serves a single local process (tests); a
    cluster has to name one, since executors can't see the driver's own folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Bytes of input files behind one task of a shuffle whose rows are sorted or joined there.
SHARE = 8 << 20


def shares(df: DataFrame, share: int = SHARE) -> int:
    """Number of tasks over which to deal out df, so that the part of one does not grow with the files that df is read from."""
    spark = df.sparkSession
    jvm, conf, size = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return max(spark.sparkContext.defaultParallelism, -(-size // share))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows that each make much work: dealt out by key where there are fewer files than cores. Splits of a file are no
    measure, as one row group is read by one task. A table of many files is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(shares(df), key)


def apart(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: both sides are shuffled and sorted. Spark takes the bytes of stored
    files for the size of their rows, and would send tables of many times that size through the driver to every task."""
    return df.hint("merge")


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: write it as Parquet into the shared folder and read it again.

    The files survive lost executors and go when the application ends.
    """
    spark = df.sparkSession
    path = own_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
