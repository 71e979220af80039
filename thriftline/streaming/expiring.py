"""Outcomes while attempts arrive, for as long as they arrive.

The attempts of a function are held side by side, a few numbers, by an aggregate over the function and the stretch of ``ttl`` in
which its rows landed.  Every row brings the time it landed; once the watermark over landing times has passed the end of a
stretch, which is ``ttl`` past the newest row in it at the latest, Spark drops what is held for it.  So the state store holds the functions
of the last while and nothing else, however long the query runs, and no row costs a call into Python.

Nothing is lost with the state.  What is published of a function are facts that merge in any order and any number
of times: whether all deliveries of attempt ``k`` passed, its least emission, the last number.  In every stretch a
function begins anew, and readers merge what was published before and after.  :func:`fold` merges
batches into one table per function, so readers see that table and the few batches since.

Landing times are stamped where rows land, so a row's stretch has not ended unless its stamp lies
``delay`` behind; Spark leaves such rows out and counts them in ``numRowsDroppedByWatermark``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thriftline import fixed_values as fixed
from thriftline.operators import outcome

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def publish_expiring(
    attempts: DataFrame,
    keys: list[str],
    path: str,
    checkpoint: str,
    landed: str = "landed_at",
    ttl_ms: int = 24 * 3_600_000,
    delay: str = "10 minutes",
    max_attempts: int = fixed.MAX_ATTEMPTS,
    mode: str = outcome.STRICT,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Publish the attempts of the streaming table ``attempts`` batch by batch below ``path``; state ends ``ttl_ms`` after them.

    ``attempts(keys, attempt, test_passed, emissions_kg, landed)``.  State is kept by the RocksDB state store, which is set for this query.
    """
    facts = outcome.attempt_facts(max_attempts, mode)
    spark = attempts.sparkSession
    # Rows whose number does not count stay in: they move the watermark on.
    stretch = F.window(landed, f"{ttl_ms} milliseconds")
    held = attempts.withWatermark(landed, delay).groupBy(*keys, stretch.alias("_stretch")).agg(*facts)
    changed = held.where(F.col("last_attempt").isNotNull()).drop("_stretch")

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, _ROCKS_DB)
    try:
        return (
            changed.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(publish)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(_STATE_STORE)
        else:
            spark.conf.set(_STATE_STORE, before)


def _merges(max_attempts: int) -> list[Column]:
    columns = []
    for k in range(1, max_attempts + 1):
        columns += [F.bool_and(f"passed_{k}").alias(f"passed_{k}"), F.min(f"kg_{k}").alias(f"kg_{k}")]
    return [*columns, F.max("last_attempt").alias("last_attempt")]


def merge(published: DataFrame, keys: list[str], max_attempts: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """One row for each function from whatever was published of it; rows that come twice change nothing."""
    return published.groupBy(*keys).agg(*_merges(max_attempts))


def _batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("bigint"))


def fold(
    spark: SparkSession, path: str, table: str, keys: list[str], earlier: tuple[str, int] | None = None, max_attempts: int = fixed.MAX_ATTEMPTS
) -> tuple[str, int] | None:
    """Merge the batches since ``earlier`` and that table into a new one below ``table``.

    Gives the folder and the last batch in it, to be passed on the next time; a table is never changed, so readers of an
    older one are not disturbed.  Batches that are in a table may be deleted by whoever owns ``path``.
    """
    last = _batches(spark, path).agg(F.max("batch")).first()[0]
    if last is None or (earlier is not None and last <= earlier[1]):
        return earlier
    folder = f"{table}/upto={last}"
    seen = current(spark, path, keys, earlier, max_attempts, last)
    seen.write.mode("overwrite").parquet(folder)
    return folder, last


def current(
    spark: SparkSession,
    path: str,
    keys: list[str],
    folded: tuple[str, int] | None = None,
    max_attempts: int = fixed.MAX_ATTEMPTS,
    upto: int | None = None,
) -> DataFrame:
    """The attempts of every function, published by now: the folded table and the batches since."""
    batches = _batches(spark, path)
    if upto is not None:
        batches = batches.where(F.col("batch") <= upto)
    if folded is None:
        return merge(batches.drop("batch"), keys, max_attempts)
    folder, last = folded
    since = batches.where(F.col("batch") > last).drop("batch")
    return merge(spark.read.schema(since.schema).parquet(folder).unionByName(since), keys, max_attempts)
