"""Files as they arrive, and the newest state of a growing log, by Structured Streaming.

A micro-batch is written below a path made from its number, so one that is run again after a failure overwrites its own rows
and nothing is skipped or repeated; what was read is kept in the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators.ledger import norm_status
from leafmill.session import shared_dir

# Fixed value: the schema of the binary file source.
FILE = "path string, modificationTime timestamp, length long, content binary"


def _checkpoint(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/streams/{name}"


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf", per_batch: int = 1000) -> DataFrame:
    """The stream of a folder's files that match, at most ``per_batch`` a micro-batch."""
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)


def each_batch(stream: DataFrame, name: str, process: Callable[[DataFrame], DataFrame], target: str, once: bool = True) -> StreamingQuery:
    """Runs ``process`` on every micro-batch of rows not yet seen and writes its result below ``target``/batch=N.

    once: ends when what is there at the start is done; else it goes on.
    """

    def run(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.queryName(name).option("checkpointLocation", _checkpoint(stream.sparkSession, name)).foreachBatch(run)
    return (writer.trigger(availableNow=True) if once else writer).start()


def status_counts(log: DataFrame, late: str = "7 days", window: str = "1 day") -> DataFrame:
    """Of a stream of page_status rows: rows by window of updated_at and status, repeated rows once, rows later than ``late`` left out."""
    rows = log.select("run_id", "pdf_path", "page_num", norm_status("status").alias("status"), F.col("updated_at").cast("timestamp").alias("updated_at"))
    once = rows.withWatermark("updated_at", late).dropDuplicatesWithinWatermark(["run_id", "pdf_path", "page_num", "status", "updated_at"])
    return once.groupBy(F.window("updated_at", window).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "status", "n")
