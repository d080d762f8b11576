"""Session, tables and shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("leafmill")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local session, whose executors are on this machine, takes a temporary one; a cluster is refused.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        got = kept.get() if kept.isDefined() else None
    if not got:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        got = f"file://{tempfile.gettempdir()}/leafmill-{os.getpid()}"
    return got


def _cuts(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cuts-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again from there: ends its lineage, survives lost executors.

    What an application wrote goes with ``sweep``.
    """
    spark = df.sparkSession
    path = f"{_cuts(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Removes what ``cut`` has written for this application; frames read from there cannot be used any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_cuts(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 0, as a long. Rows of equal order are numbered in any order.

    Rows are partitioned by range and numbered within; the counts of the partitions before, a row each, are added.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # a row a partition
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_own") - 1).select(*df.columns, name)
