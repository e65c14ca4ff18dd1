"""Change points on a stream whose rows arrive out of order.

The detector in :mod:`panelkit.streaming.switches` cannot revise what it has
emitted, so a row behind a person's last one is only counted.  Here rows wait
until nothing earlier can arrive any more: with an allowed lateness of n days,
a row is final once a row n days later has been seen (of any person).  Final
rows are put in order and compared with their predecessors as in the batch job,
so the output over the whole feed equals ``lag`` as long as rows are at most n
days late; rows later than that are flagged, and change nothing.

State is two tables per micro-batch, the waiting rows and every person's last
final row, written to batch-id folders like the output, so a replayed batch
ends the same.  All steps are DataFrame operations: a person with very many
waiting rows is split into time chunks by
:func:`panelkit.operators.windows.lag_value`.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.operators.windows import lag_value
from panelkit.streaming.switches import KEEP_VERSIONS, _forget, _state_path


class OrderedChangePoints:
    """Change points of ``value`` per ``key`` in the order of (``time``,
    ``tie``), for rows up to ``lateness`` days late.

    ``run`` processes what a stream has available; ``finish`` ends the feed
    and lets the waiting rows through.  NULL values and NULL times are left
    out, as in the batch job.  Output: the input columns, ``prev`` and
    ``late``.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, key: str, time: str, tie: str, value: str,
                 prev: str, lateness: int, out: str, state: str, chunk="auto"):
        if not isinstance(schema[time].dataType, T.DateType):
            raise TypeError(f"{time} must be a date")
        self.spark, self.schema, self.out, self.state = spark, schema, out, state
        self.key, self.time, self.tie, self.value, self.prev = key, time, tie, value, prev
        self.lateness, self.chunk = lateness, chunk
        self.last_schema = T.StructType([T.StructField(n, schema[c].dataType)
                                         for n, c in (("_key", key), ("_t", time), ("_tie", tie), ("_v", value))])

    def _read(self, name: str, batch_id: int, schema) -> DataFrame:
        """State of a batch; before the first one it is empty.  A missing
        folder raises, as going on without it would lose rows silently."""
        if batch_id < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(_state_path(f"{self.state}/{name}", batch_id))

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(_state_path(f"{self.state}/{name}", batch_id))

    def process(self, batch: DataFrame, batch_id: int, finish: bool = False) -> None:
        t = F.col(self.time)
        limits = T._parse_datatype_string("closed date")
        before = self._read("closed", batch_id - 1, limits).first()
        before = before[0] if before else None
        rows = batch.select(*self.schema.names).where(F.col(self.value).isNotNull() & t.isNotNull())
        waiting = self._read("waiting", batch_id - 1, self.schema)
        newest = rows.unionByName(waiting).agg(F.max(t)).first()[0]
        closed = dt.date.max if finish else newest and newest - dt.timedelta(days=self.lateness)
        if before and (closed is None or closed < before):
            closed = before                              # it never moves back
        # Up to `before` the order has been given out already.
        behind = t <= F.lit(before) if before else F.lit(False)
        ready = rows.where(~behind).unionByName(waiting).where(t <= F.lit(closed) if closed else F.lit(False))
        last = self._read("last", batch_id - 1, self.last_schema)
        lagged = lag_value(ready, self.key, [self.time, self.tie], self.value, self.prev, self.chunk)
        lagged = lagged.join(last, F.col(self.key).eqNullSafe(F.col("_key")), "left") \
            .withColumn(self.prev, F.coalesce(self.prev, "_v"))
        cols = [*self.schema.names, self.prev, "late"]
        switches = lagged.where(F.col(self.prev).isNotNull() & (F.col(self.value) != F.col(self.prev))) \
            .withColumn("late", F.lit(False)).select(*cols)
        late = rows.where(behind).withColumn(self.prev, F.lit(None).cast(self.schema[self.value].dataType)) \
            .withColumn("late", F.lit(True)).select(*cols)
        switches.unionByName(late).write.mode("overwrite").parquet(_state_path(self.out, batch_id))
        ends = ready.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(
            F.struct(t.alias("_t"), F.col(self.tie).alias("_tie"), F.col(self.value).alias("_v")),
            F.struct(self.time, self.tie)).alias("_s")).select("_key", "_s.*")
        held = last.alias("l").join(ends.select(F.col("_key").alias("_e")), F.col("_key").eqNullSafe(F.col("_e")), "left_anti")
        self._write(ends.unionByName(held), "last", batch_id)
        self._write(rows.where(~behind).unionByName(waiting).where(t > F.lit(closed) if closed else F.lit(True)),
                    "waiting", batch_id)
        self._write(self.spark.createDataFrame([(closed,)], limits).coalesce(1), "closed", batch_id)
        if batch_id > KEEP_VERSIONS:
            for name in ("last", "waiting", "closed"):
                _forget(self.spark, _state_path(f"{self.state}/{name}", batch_id - KEEP_VERSIONS - 1))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Process the available input; goes on from the checkpoint."""
        q = (stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()

    def finish(self, batch_id: int) -> None:
        """End the feed after the given batch: waiting rows become final.
        Finishing again rewrites the same folders."""
        self.process(self.spark.createDataFrame([], self.schema), batch_id + 1, finish=True)

    def last_batch(self) -> int:
        """The newest batch whose state is complete."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.state}/closed")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(p)]
        return max(int(f.getName().partition("=")[2]) for f in found
                   if fs.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))
