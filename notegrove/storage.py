"""Stage tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session on this machine alone does without that setting."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "/tmp/notegrove-checkpoints"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, so a lost executor costs a reread and no
    recomputation. released() deletes the table, or the end of the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table._stage_path = path
    return table


def released(*tables: DataFrame) -> None:
    """Delete tables that settled() made, and let Spark delete what the stages behind them have shuffled: it does so once
    the driver's JVM finds nothing that refers to it."""
    for table in tables:
        where = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table._stage_path)
        where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


#: Rows and bytes of one Arrow batch: long texts must not add up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds for the Python stages planned afterwards in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Bytes of a table's files that one task takes on; sorted or hashed in memory they are several times as many.
PART_BYTES = 16 << 20


def parts_of(table: DataFrame) -> int:
    """In how many parts a table read from files is best dealt out: those of the session, or more for a large one. Spark tells
    what it knows no size of by a size that no table has."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 0 if size > 1 << 50 else size
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
