"""Work on items that is done once: keyed state remembers attempts and the last status of every item, in slots of many items.

An item comes in as often as a manifest names it.  It is worked on if nothing is known of it, if its last attempt failed, or
if what is known is older than ``days``.  State, offsets and outcomes of a micro-batch belong together: a run that is killed
repeats its last batch and writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siterank.streaming.resume import FRESH_DAYS

ACCEPTED = ("complete", "partial")
FAILED = "error"
#: Items are dealt over so many keys of the state by hash, which stays as it is for the life of a checkpoint.
SLOT, SLOTS = "slot__", 4096
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # state that expires by the clock asks for batches without data, which never end
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Attempts(StatefulProcessor):
    """One attempt for each item of a slot that needs one; nothing for an item that is fresh.

    The state of a slot is a list of (item, attempts, status), read once and added to once for all items of the slot: a call to
    the state store costs far more than an item.  Every entry expires by itself; the last one of an item counts.
    """

    def __init__(self, work: Callable[[Row], dict], item: T.StructField, order: str, columns: list[str], names: list[str], ttl_ms: int, accepted: tuple[str, ...]):
        self.work, self.item, self.order, self.columns, self.names, self.ttl_ms, self.accepted = work, item, order, columns, names, ttl_ms, accepted

    def init(self, handle: StatefulProcessorHandle) -> None:
        entry = T.StructType().add("item", self.item.dataType).add("attempts", T.IntegerType()).add("status", T.StringType())
        self.seen = handle.getListState("seen", entry, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        name, order, first = self.item.name, self.order, {}
        for r in rows:
            at = (r[order] is None, r[order])
            held = first.get(r[name])
            if held is None or at < held[0]:
                first[r[name]] = (at, r)
        known = {item: (attempts, status) for item, attempts, status in self.seen.get() if item in first}
        now, given = timerValues.getCurrentProcessingTimeInMs(), Row(*self.columns)
        done, entries = [], []
        for item, (_, r) in first.items():
            attempts, status = known.get(item, (0, None))
            if status in self.accepted:
                continue
            status, error, found = self.attempt(given(*[r[c] for c in self.columns])) if item is not None else (FAILED, "item without id", {})
            if item is not None:
                entries.append((item, attempts + 1, status))
            done.append(Row(**{name: item, "attempts": attempts + 1, "status": status, "error": error, "at_ms": now}, **{n: found.get(n) for n in self.names}))
        if entries:
            self.seen.appendList(entries)
        yield from done

    def attempt(self, item: Row) -> tuple[str, str | None, dict]:
        try:
            found = self.work(item)
        except Exception as e:  # whatever an item's work raises is its outcome, and the run goes on
            return FAILED, f"{type(e).__name__}: {e}", {}
        return found.get("status", ACCEPTED[0]), None, found

    def close(self) -> None:
        pass


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def attempted(items: DataFrame, work: Callable[[Row], dict], result: str, key: str, order: str, ttl_ms: int,
              accepted: tuple[str, ...] = ACCEPTED) -> DataFrame:
    """Stream of outcomes: key, attempts, status, error, at_ms and the columns of ``result``."""
    found = T.StructType.fromDDL(result)
    out = T.StructType([
        T.StructField(key, items.schema[key].dataType), *T.StructType.fromDDL("attempts int, status string, error string, at_ms long"), *found,
    ])
    processor = Attempts(work, items.schema[key], order, items.columns, found.names, ttl_ms, accepted)
    slots = items.withColumn(SLOT, F.pmod(F.xxhash64(key), F.lit(SLOTS).cast("long")))
    return slots.groupBy(SLOT).transformWithState(processor, out, "Append", "ProcessingTime")


def process_items(spark: SparkSession, manifests: str, schema: str, work: Callable[[Row], dict], result: str, output: str,
                  checkpoint: str, key: str, order: str, days: float = FRESH_DAYS, files_per_batch: int = 100,
                  accepted: tuple[str, ...] = ACCEPTED, fmt: str = "parquet") -> None:
    """Work through the manifests not read yet and stop.

    ``work`` takes a row and returns the columns of ``result``, and a ``status`` if it isn't "complete"; what it raises becomes
    the item's ``error``.  Of rows of one item in a batch the one of the least ``order`` counts (null last).  Rows without an
    id are failures.  A status that isn't accepted is tried again when a manifest names the item again, an accepted one after
    ``days``; the state of an item goes by itself then.
    """
    with _settings(spark, _STORE):
        items = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(manifests)
        outcomes = attempted(items, work, result, key, order, int(days * 86_400_000), accepted)

        def commit(batch: DataFrame, batch_id: int) -> None:
            failed = ~F.coalesce(F.col("status").isin(*accepted), F.lit(False))
            batch.withColumn("failed", failed).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
                "failed").parquet(f"{output}/batch={batch_id}")

        outcomes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def outcomes(spark: SparkSession, output: str, key: str) -> DataFrame:
    """The last outcome of every item; rows without an id stay one by one."""
    rows = spark.read.parquet(output).withColumn("failed", F.col("failed").cast("boolean"))
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "batch").alias("r"))
    return last.select(key, "r.*").unionByName(rows.where(F.col(key).isNull()))
