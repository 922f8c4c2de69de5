"""Incremental ingestion: files stream in, each is processed once, and models follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumage import files, scratch
from plumage.operators import models
from plumage.sources import stores


#: Batches from this number on are repairs.
REPAIRS = 1 << 30
#: The state store that keeps keys on the executors' disks rather than in memory.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def new_rows(rows: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")


def mark_processed(rows: DataFrame, path: str, key: str, batch: int, detections: DataFrame | None = None) -> None:
    """(key, n) of a batch: keys that have been processed, whether or not they gave any output, and how many detections each gave
    (0 where detections aren't given)."""
    keys = rows.select(key).distinct()
    if detections is None:
        marks = keys.withColumn("n", F.lit(0).cast("long"))
    else:
        marks = keys.join(detections.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    marks.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def _store(rows: DataFrame, detections: stores.Detections, processed: str, process: Callable[[DataFrame], DataFrame], key: str, number: int) -> None:
    """Process rows, replace the batch's folder by the result, mark its keys."""
    detections.write(process(rows), number)
    held = detections.read()
    held = held.where(F.col("batch") == number) if held is not None and key in held.columns else None
    mark_processed(rows, processed, key, number, held)


def ingest(
    stream: DataFrame, out: str, processed: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], key: str = "image_path",
    available_now: bool = True, known: DataFrame | None = None, time: str | None = None, delay: str = "7 days",
) -> StreamingQuery:
    """Each key of the stream is processed once. The keys seen are state of the stream, kept by key on the executors, so a
    micro-batch looks up its own keys only and never reads those of earlier ones. With `time` (a column), keys are forgotten
    `delay` after their time. known: keys of another ingestion, which every micro-batch is joined with.

    A batch that is run again after a failure replaces what it wrote and marked. Rows without a key count as one key."""
    spark = stream.sparkSession
    detections = stores.Detections(spark, out)
    fresh = new_rows(stream, known, key)
    fresh = fresh.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if time else fresh.dropDuplicates([key])

    def batch(rows: DataFrame, number: int) -> None:
        _store(scratch.written(rows), detections, processed, process, key, number)

    writer = fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:  # a query takes the setting as it is when it starts
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def recover(spark: SparkSession, out: str, processed: str, key: str = "image_path", deep: bool = False) -> DataFrame:
    """(key, batch), written: the keys whose batch was damaged. Their marks go first and the batches' folders then, so that a
    failure in between leaves nothing marked that is not there; run again, it goes on."""
    detections, index = stores.Detections(spark, out), stores.read_or_none(spark, processed)
    bad = scratch.written(detections.damaged(index, key, deep))
    if index is None:
        lost = scratch.written(bad.select(F.lit(None).cast("string").alias(key), "batch").limit(0))
    else:
        lost = scratch.written(index.join(bad, "batch", "left_semi").select(key, "batch"))
    for number in sorted(r.batch for r in bad.collect()):  # numbers of damaged batches
        files.remove(spark, f"{processed}/batch={number}")
        detections.drop(number)
    return lost


def reprocess(rows: DataFrame, lost: DataFrame, out: str, processed: str, process: Callable[[DataFrame], DataFrame], key: str = "image_path") -> int:
    """Process the rows of lost keys again as a batch beyond all others, whose number it gives; a stream's own batches stay below
    REPAIRS. Keys that have a mark by now, as after a failure of the caller, are left out."""
    spark = rows.sparkSession
    done = stores.read_or_none(spark, processed)
    number = REPAIRS if done is None else max(REPAIRS, (done.agg(F.max("batch")).first()[0] or 0) + 1)
    again = new_rows(rows.join(lost.select(key).distinct(), key, "left_semi"), done, key).dropDuplicates([key])
    _store(scratch.written(again), stores.Detections(spark, out), processed, process, key, number)
    return number


def forget(known: dict[int, dict], batches: list[int]) -> dict[int, dict]:
    """moments_by_batch() without those of damaged batches; the moments of the rest add up as before."""
    return {b: m for b, m in known.items() if b not in set(batches)}


def moments_by_batch(detections: DataFrame, vec: str, d: int, known: dict[int, dict]) -> dict[int, dict]:
    """Moments of each batch not yet among `known`: components of any set of batches follow by adding them up."""
    for b in sorted(r.batch for r in detections.select("batch").distinct().collect()):  # batch numbers
        if b not in known:
            known[b] = models.moments(detections.where(F.col("batch") == b), vec, d)
    return known


def windowed_counts(stream: DataFrame, time: str, by: str, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Rows per window and group of a stream with late rows up to `delay`."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"))


def read_files(spark: SparkSession, folder: str, schema: str, per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
