"""Event-time roll-up on a stream: per person and day, with a watermark.

Day windows (calendar months are irregular; roll days up to months in
batch).  Sums and counts add up, so each micro-batch writes its own partial
sums per (person, day) into one folder per batch id (overwriting it, so a
replayed batch is idempotent), and reading adds the partials.  No row
depends on how the input was cut into files or micro-batches: a row older
than the watermark (the latest event time of all earlier batches, less the
allowed lateness) is late, is *counted* as late, and still counts.

:func:`daily_rollup_stream` is the same aggregation with Spark's own
watermark, for sinks that want one final row per closed day and accept that
later rows are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TASK_ROWS = 1 << 19      # rows a task sums, about 250 MB of groups where all differ


def _tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: a fixed number's memory grows with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def _measures(measure: str | dict[str, str]) -> dict[str, str]:
    return {"total": measure} if isinstance(measure, str) else dict(measure)


def daily_rollup_stream(stream: DataFrame, key: str, ts: str, measure: str | dict[str, str],
                        lateness: str = "2 days") -> DataFrame:
    """Rows ``n`` and sums per (key, day window); ``measure`` is one column
    (summed as ``total``) or ``{output name: column}``."""
    # Watermarks need an instant type; the session time zone is UTC, so the
    # cast from timestamp_ntz/date keeps wall-clock days unchanged.
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    sums = [F.sum(c).alias(n) for n, c in _measures(measure).items()]
    return (stream.withWatermark(ts, lateness)
            .groupBy(key, F.window(ts, "1 day"))
            .agg(F.count(F.lit(1)).alias("n"), *sums))


def run_rollup(stream: DataFrame, out: str, checkpoint: str, key: str, ts: str,
               measure: str | dict[str, str], lateness: str = "2 days") -> None:
    """Processes the available input; partial sums go to ``out/part`` and each
    batch's latest event time to ``out/clock``, one folder per batch id."""
    names = _measures(measure)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clock = f"{out}/clock/batch_id={batch_id}"
        before = None
        if batch_id > 0:
            # Raises when an earlier batch's clock is missing.
            before = spark.read.schema("latest timestamp").parquet(
                f"{out}/clock/batch_id={batch_id - 1}").select(F.unix_micros("latest")).first()[0]
        at = F.col(ts).cast("timestamp")
        late = (at < F.timestamp_micros(F.lit(before)) - F.expr(f"INTERVAL {lateness}")) if before is not None else F.lit(False)
        found = batch.agg(F.unix_micros(F.max(at)).alias("latest"), F.count(F.lit(1)).alias("rows")).first()
        # The session is the stream's own copy.
        usual = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", _tasks(spark, found["rows"]))
        try:
            (batch.groupBy(key, F.col(ts).cast("date").alias("day"))
             .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(late, 1)).alias("n_late"),
                  *[F.sum(c).alias(n) for n, c in names.items()])
             .write.mode("overwrite").parquet(f"{out}/part/batch_id={batch_id}"))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", usual)
        latest = max((t for t in (found["latest"], before) if t is not None), default=None)
        spark.range(0, 1, 1, 1).select(F.timestamp_micros(F.lit(latest).cast("long")).alias("latest")) \
            .write.mode("overwrite").parquet(clock)

    q = (stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_rollup(spark: SparkSession, out: str, key: str) -> DataFrame:
    """(key, day, n, n_late, sums) over all batches, dealt by key: a roll-up
    of a key's days needs no further exchange."""
    rows = spark.read.parquet(f"{out}/part").drop("batch_id")
    rows = rows.repartition(_tasks(spark, rows.count()), key)
    sums = [c for c in rows.columns if c not in (key, "day")]
    return rows.groupBy(key, "day").agg(*[F.sum(c).alias(c) for c in sums])


def monthly_from_daily(daily: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """Batch roll-up of the stream's (key, day) rows to calendar months."""
    return (daily.groupBy(key, F.trunc("day", "MM").alias("month"))
            .agg(F.sum("n").cast("long").alias("n"), *[F.sum(c).alias(c) for c in sums]))
