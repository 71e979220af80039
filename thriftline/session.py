"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Python steps receive frames of bounded size, however long the texts are.
FRAME_BYTES = 64 << 20

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Folder names are names: project 007 is not the number 7.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(FRAME_BYTES),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library is written for."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """This session's part of the folder named by ``spark.checkpoint.dir``, as a full URI.

    Only a session whose tasks run inside the driver may fall back to a temporary folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="thriftline-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten there."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def slots(spark: SparkSession) -> int:
    """Tasks to deal rows out to before a Python step."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by a hash of ``keys``, for input that lies in too few pieces for heavy work.

    The caller decides; operators work on the pieces they are given.  Their number is fixed: Spark
    would join pieces again by their bytes, and rows that only name the work (numbers, byte ranges) have hardly any.
    """
    return df.repartition(slots(df.sparkSession), *keys)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: hand a table from one stage to the next through the shared folder.

    For tables that several later steps read; each reads its own columns only, and
    losing executors does not bring the stages before back.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
