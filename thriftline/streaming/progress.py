"""Outcomes while attempts are still arriving.

The stream keeps the attempts of each function side by side (a handful of
numbers per function) and writes those that changed after every micro-batch.  A batch
always goes to its own folder, so a repeated batch replaces itself; readers take
the newest row of each function and decide it against the baselines known by then, so
an attempt that lands before its baseline counts as soon as the baseline is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thriftline import fixed_values as fixed
from thriftline.operators import outcome
from thriftline.session import written


def publish_attempts(
    attempts: DataFrame,
    keys: list[str],
    path: str,
    checkpoint: str,
    max_attempts: int = fixed.MAX_ATTEMPTS,
    mode: str = outcome.STRICT,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the job on the streaming table ``attempts``.

    ``trigger`` is that of a streaming writer; by default the job ends when what has landed is done.
    No micro-batch reads another table.  For very many functions run it with the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    side_by_side = outcome.spread_attempts(attempts, keys, max_attempts, mode)

    def publish(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        side_by_side.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest published row of each function."""
    published = spark.read.parquet(path).withColumn("batch", F.col("batch").cast("bigint"))
    last = published.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return published.join(last, [*keys, "batch"]).drop("batch")


def merged(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest rows as one table of their own, for readers that come often."""
    return written(newest(spark, path, keys), "attempts")


def current_outcomes(attempts: DataFrame, baselines: DataFrame, keys: list[str], max_attempts: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """The outcome of every function in ``baselines`` from published ``attempts``, as the batch rule gives it."""
    return outcome.decide(outcome.gate_baselines(baselines).join(attempts, keys, "left"), max_attempts)


def unmatched(attempts: DataFrame, baselines: DataFrame, keys: list[str]) -> DataFrame:
    """Published attempts of functions without a baseline so far."""
    return attempts.join(baselines.select(*keys), keys, "left_anti")
