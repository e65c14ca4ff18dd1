"""Stateful change detector on a stream: keep ``person -> last (time,
tie-break, value)`` and emit a row whenever the value changes.

``lag`` is not available on streams, so the state is kept explicitly with
``applyInPandasWithState``.  Its groups are ``BUCKETS`` hash buckets of people: a
group costs some milliseconds of Spark and Python whatever it holds, which one
group per person multiplies by millions.  Per micro-batch each person's new
rows are sorted by (time, tie-break) and compared with their predecessor, the
first one with the stored last value.  Contract:

* rows at or before the stored last (time, tie-break) are late: they do
  not change state or emit switches (an ordered-stream operator cannot
  revise what it emitted) and are output once flagged ``late`` for counting;
* NULL values neither emit nor update the state (filter them in the source
  view, as the batch job does);
* a bucket's memory is bounded by the micro-batch size
  (``maxFilesPerTrigger``), the state is the key and three values per person; a
  micro-batch rewrites the state of the buckets it has rows of.

Fed in time order (one batch or many), the output equals the batch
``lag`` change points.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Groups of people.  Fixed, as a checkpoint's state lies by bucket; a billion
# people are 120,000 in a bucket.
BUCKETS = 1 << 13

STATE_SCHEMA = T.StructType([
    T.StructField("last_time", T.DateType()),
    T.StructField("last_tb", T.LongType()),
    T.StructField("last_value", T.StringType()),
])


def _missing(x) -> bool:
    return x is None or x != x  # None or NaN


def _compare(at: list[int], t: list, tb: list, v: list, last: tuple | None, switches: list, late: list) -> tuple | None:
    """One person's new rows, at places ``at`` of the lists, against the
    stored (time, tie-break, value).  Switches are added as (place, previous
    value), late rows as places; returns the new last row's values."""
    live, prev = [], None
    if last is not None:
        seen, prev = last[:2], last[2]
    for i in at:
        if _missing(v[i]):
            continue
        if last is not None and (t[i], tb[i]) <= seen:
            late.append(i)
        else:
            live.append(i)
    live.sort(key=lambda i: (t[i], tb[i]))
    for i in live:
        if prev is not None and v[i] != prev:
            switches.append((i, prev))
        prev = v[i]
    if not live:
        return last
    return t[live[-1]], int(tb[live[-1]]), prev


def _columns(pdfs: Iterator[pd.DataFrame], *names: str) -> tuple:
    chunks = list(pdfs)
    pdf = chunks[0] if len(chunks) == 1 else pd.concat(chunks, ignore_index=True)
    return pdf, *[pdf[c].tolist() for c in names]


def _emitted(pdf: pd.DataFrame, switches: list, late: list, prev_col: str, out_cols: list[str]) -> Iterator[pd.DataFrame]:
    if late:
        # counted, not applied: emitted once with late = True
        yield pdf.iloc[late].assign(**{prev_col: None, "late": True})[out_cols]
    if switches:
        at, prev = zip(*switches)
        yield pdf.iloc[list(at)].assign(**{prev_col: prev, "late": False})[out_cols]


def _detector(key_col: str, time_col: str, tb_col: str, value_col: str, prev_col: str,
              out_cols: list[str]):
    """The step of a group that is one person; the state is the last row's
    (time, tie-break, value)."""
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf, t, tb, v = _columns(pdfs, time_col, tb_col, value_col)
        switches, late = [], []
        old = tuple(state.get) if state.exists else None
        last = _compare(range(len(v)), t, tb, v, old, switches, late)
        if last != old:
            state.update(last)
        yield from _emitted(pdf, switches, late, prev_col, out_cols)
    return fn


def _bucket_detector(key_col: str, time_col: str, tb_col: str, value_col: str, prev_col: str,
                     out_cols: list[str]):
    """The step of a group that is a bucket of people; the state is four
    lists: keys, and the fields of STATE_SCHEMA.  Pandas frames are built only
    for the rows that are emitted."""
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf, who, t, tb, v = _columns(pdfs, key_col, time_col, tb_col, value_col)
        people: dict = {}
        for i, p in enumerate(who):
            people.setdefault(None if _missing(p) else p, []).append(i)
        last = {}
        if state.exists:
            keys, *fields = state.get
            last = dict(zip(keys, zip(*fields)))
        switches, late = [], []
        for p, at in people.items():
            found = _compare(at, t, tb, v, last.get(p), switches, late)
            if found is not None:
                last[p] = found
        if last:
            state.update((list(last), *map(list, zip(*last.values()))))
        yield from _emitted(pdf, switches, late, prev_col, out_cols)
    return fn


def stream_change_points(stream: DataFrame, key: str, time_col: str, tb_col: str,
                         value_col: str, prev_col: str) -> DataFrame:
    """Streaming change points of ``value_col`` per ``key``; output has the
    input columns plus ``prev_col`` and ``late``.  Late rows (at or before
    the person's last processed row) are emitted once with ``late = True``
    so they can be counted; switches have ``late = False``."""
    out_fields = list(stream.schema.fields) + [T.StructField(prev_col, T.StringType()),
                                               T.StructField("late", T.BooleanType())]
    out_schema = T.StructType(out_fields)
    fn = _bucket_detector(key, time_col, tb_col, value_col, prev_col, [f.name for f in out_fields])
    lists = [T.StructField("keys", T.ArrayType(stream.schema[key].dataType))] \
        + [T.StructField(f.name, T.ArrayType(f.dataType)) for f in STATE_SCHEMA]
    return stream.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS))).groupBy("_bucket") \
        .applyInPandasWithState(fn, out_schema, T.StructType(lists), "append", GroupStateTimeout.NoTimeout)


# --------------------------------------------------- state kept as a table

KEEP_VERSIONS = 3        # state versions kept behind the newest


def _state_path(root: str, batch_id: int) -> str:
    return f"{root}/batch_id={batch_id}"


def _forget(spark, path: str) -> None:
    """Delete one old state version, if it is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def run_change_points_tables(stream: DataFrame, key: str, time_col: str, tb_col: str,
                             value_col: str, prev_col: str, out: str, state_root: str,
                             checkpoint: str, chunk="auto") -> None:
    """The same contract as :func:`stream_change_points`, evaluated with
    DataFrame operations only (no per-person Python): the form to prefer.

    The state is a table (person, last time, last tie-break, last value)
    with one version per micro-batch.  Each ``foreachBatch`` call joins the
    batch with the previous version, orders each person's new rows with
    :func:`panelkit.operators.windows.lag_value` (a person with very many new
    rows is split into time chunks), takes the stored value as the first
    row's predecessor, writes the switches (and the late rows, flagged) to
    ``out/batch_id=<id>`` and the new state to ``state_root/batch_id=<id>``.
    Both writes overwrite their batch folder, so a replayed batch is
    idempotent.  A missing previous version raises: going on with empty state
    would lose switches silently.  Versions more than ``KEEP_VERSIONS`` behind
    are deleted.  Runs until the available input is processed.
    """
    from pyspark.sql import functions as F

    from panelkit.operators.windows import lag_value

    schema = T.StructType([T.StructField(key, stream.schema[key].dataType),
                           T.StructField("_lt", stream.schema[time_col].dataType),
                           T.StructField("_ltb", stream.schema[tb_col].dataType),
                           T.StructField("_lv", stream.schema[value_col].dataType)])

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id > 0:
            old = spark.read.schema(schema).parquet(_state_path(state_root, batch_id - 1))
        else:
            old = spark.createDataFrame([], schema)
        rows = batch.where(F.col(value_col).isNotNull()).join(old, key, "left")
        is_late = F.col("_lt").isNotNull() & (
            (F.col(time_col) < F.col("_lt"))
            | ((F.col(time_col) == F.col("_lt")) & (F.col(tb_col) <= F.col("_ltb"))))
        rows = rows.withColumn("late", F.coalesce(is_late, F.lit(False)))
        live = lag_value(rows.where(~F.col("late")), key, [time_col, tb_col], value_col, prev_col, chunk)
        live = live.withColumn(prev_col, F.coalesce(prev_col, "_lv"))
        switches = live.where(F.col(prev_col).isNotNull() & (F.col(value_col) != F.col(prev_col)))
        late = rows.where(F.col("late")).withColumn(prev_col, F.lit(None).cast("string"))
        cols = [*batch.columns, prev_col, "late"]
        (switches.select(*cols).unionByName(late.select(*cols))
         .write.mode("overwrite").parquet(_state_path(out, batch_id)))
        tail = live.groupBy(key).agg(F.max_by(F.struct(F.col(time_col).alias("_lt"),
                                                       F.col(tb_col).alias("_ltb"),
                                                       F.col(value_col).alias("_lv")),
                                              F.struct(time_col, tb_col)).alias("_s"))
        new = tail.select(key, "_s.*").unionByName(old.join(tail.select(key), key, "left_anti"))
        new.write.mode("overwrite").parquet(_state_path(state_root, batch_id))
        if batch_id > KEEP_VERSIONS:
            _forget(spark, _state_path(state_root, batch_id - KEEP_VERSIONS - 1))

    q = (stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
