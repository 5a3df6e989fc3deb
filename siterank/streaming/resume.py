"""Resumable runs: only new input is processed, failures are kept apart, commits are repeatable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siterank.operators.tables import pending
from siterank.plans.knowledge import as_facts
from siterank.sources.keyed_store import KeyedStore

FRESH_DAYS = 30
FACT_COLUMNS = "key string, topic string, value string, source string, well_id string, ordinal long"


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows); a failing row never stops the run."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def capture(df: DataFrame, checks: dict[str, object], error: str = "error") -> DataFrame:
    """``error`` names the first check that fails, or is null."""
    out = None
    for name, bad in checks.items():
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return df.withColumn(error, out if out is not None else F.lit(None).cast("string"))


def process_available(spark: SparkSession, source: str, schema: str, transform, output: str, failures: str,
                      checkpoint: str, files_per_batch: int = 100, fmt: str = "json") -> None:
    """Run ``transform`` over the files not seen yet and stop.

    The checkpoint remembers finished files.  Each batch writes its own folder by overwrite, so
    a batch that is repeated after a failure leaves no duplicates.  ``transform`` returns rows
    with an ``error`` column.
    """
    stream = (
        spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("columnNameOfCorruptRecord", "_corrupt").load(source)
    )

    def commit(batch: DataFrame, batch_id: int) -> None:
        done = transform(batch).persist()
        good, bad = split_errors(done)
        good.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        bad.write.mode("overwrite").json(f"{failures}/batch={batch_id}")
        done.unpersist()

    query = (
        stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def fact_store(spark: SparkSession, path: str, buckets: int = 256) -> KeyedStore:
    """The store of facts in a folder, made if there is none."""
    return KeyedStore(spark, path).create(FACT_COLUMNS, ["key"], buckets)


def append_facts(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, files_per_batch: int = 100,
                 fmt: str = "json") -> None:
    """Micro-batches of facts into the store, each content key once; a batch that is repeated changes nothing.

    The store knows this stream by its checkpoint folder: a new folder starts a new stream over the same store.
    """
    facts = fact_store(spark, store)

    def commit(batch: DataFrame, batch_id: int) -> None:
        facts.append(as_facts(batch), "ordinal", checkpoint, batch_id)

    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)
    stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fresh(cache: DataFrame, days: int = FRESH_DAYS, accepted: tuple[str, ...] = ("complete", "partial"),
          at: str = "investigated_utc", now=None) -> DataFrame:
    """Cached rows that may still be used."""
    now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return cache.where(F.col("status").isin(*accepted) & (F.col(at) > now - F.expr(f"interval {days} days")))


def pending_maps(manifest: DataFrame, outputs: DataFrame, limit: int | None = None, order: str = "ordinal") -> DataFrame:
    """Manifest rows without a valid output, in order, at most ``limit`` for this run."""
    todo = pending(manifest, outputs.where("valid"), ["scan_id"])
    return todo.orderBy(order).limit(limit) if limit is not None else todo
