"""Per-person ordered operators: first/last row, lag/lead, change points,
row index, trailing frames.

Hot persons.  A plain ``Window.partitionBy(person)`` sends every row of a
person to one task, so a person holding a third of all rows would pin a
third of the data on one executor.  The ordered operators here therefore
take an optional ``chunk`` column (a coarse, order-compatible time bucket,
see :func:`time_chunk`).  Rows are windowed per ``(person, chunk)`` and the
value crossing a chunk boundary is taken from a per-chunk summary (one row
per chunk, filtered from the same window output, so the input is shuffled
once), so one person's rows spread over as many tasks as they have chunks.
The result is identical to the unchunked window.  :func:`auto_chunk` picks
the chunk width from measured data, or no chunking when no key is hot.

First/last row per person uses ``min_by``/``max_by`` aggregates instead of
``row_number() == 1``: an aggregate with partial (map-side) aggregation
(sort-based, as its buffer is a struct, so it spills rather than fails), so
a hot person costs one row per map task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _order(order: Sequence, descending: bool = False) -> list[Column]:
    out = []
    for o in order:
        c = F.col(o) if isinstance(o, str) else o
        out.append(c.desc_nulls_last() if descending else c.asc_nulls_last())
    return out


def time_chunk(col, days: int = 366) -> Column:
    """Order-compatible time bucket: whole ``days``-wide blocks since 1970."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")) / days) \
        .cast("long")


# Most rows one task may receive for one key in an ordered window.
MAX_ROWS_PER_KEY_TASK = 5_000_000


def auto_chunk(df: DataFrame, key, time_col: str,
               max_rows: int | None = None) -> Column | None:
    """Chunk column for the ordered operators, chosen from measured data.

    One aggregate job (per-key count and time span, map-side combined, then
    the largest key only) decides whether any key has more than ``max_rows``
    rows; if not, ``None`` (one window per key is bounded).  Otherwise the
    width is narrowed until the largest (key, chunk) cell of *any* key holds
    at most ``max_rows`` rows, or is one day wide.  Whatever is chosen, the
    operators' results are the same.
    """
    max_rows = MAX_ROWS_PER_KEY_TASK if max_rows is None else max_rows
    keys = _cols(key)
    t = F.col(time_col).cast("date")
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(t).alias("_t0"),
                                F.max(t).alias("_t1"))
    top = per.agg(F.max_by(F.struct("_n", F.datediff("_t1", "_t0").alias("_span")), "_n").alias("m")).first()["m"]
    if top is None or top["_n"] <= max_rows:
        return None
    days = max(1, int(max(int(top["_span"] or 0), 1) * max_rows / top["_n"]))
    while days > 1:
        cell = df.where(t.isNotNull()).groupBy(*keys, time_chunk(time_col, days).alias("_c")).count() \
            .agg(F.max("count").alias("n")).first()["n"]
        if not cell or cell <= max_rows:
            break
        days = max(1, min(days // 2, int(days * max_rows / cell)))
    return time_chunk(time_col, days)


Chunk = Column | str | None


def _resolve(df: DataFrame, keys, order: Sequence, chunk: Chunk) -> Column | None:
    """``chunk="auto"``: measure with :func:`auto_chunk` on the first order
    column when it is a date or timestamp (other orderings are not split)."""
    if not isinstance(chunk, str):
        return chunk
    if chunk != "auto":
        raise ValueError(f"chunk must be a Column, None or 'auto', not {chunk!r}")
    first = order[0]
    if not isinstance(first, str):
        return None
    kind = df.schema[first].dataType.typeName()
    if kind not in ("date", "timestamp", "timestamp_ntz"):
        return None
    return auto_chunk(df, keys, first, max_rows=MAX_ROWS_PER_KEY_TASK)


# ---------------------------------------------------------------- first / last

def _extreme_per_key(df: DataFrame, keys, rank: Column, fn) -> DataFrame:
    keys = _cols(keys)
    payload = F.struct(*[F.col(c) for c in df.columns])
    row = fn(payload, rank).alias("_row")
    return df.groupBy(*keys).agg(row).select("_row.*")


def first_per_key(df: DataFrame, keys, order: Sequence[str]) -> DataFrame:
    """Row with the smallest ``order`` per key (``row_number() == 1``), NULLs
    last.  ``order`` must be unique within a key (add a tie-break column)."""
    rank = F.struct(*[c for i, o in enumerate(order)
                      for c in (F.col(o).isNull().alias(f"n{i}"), F.col(o).alias(f"v{i}"))])
    return _extreme_per_key(df, keys, rank, F.min_by)


def last_per_key(df: DataFrame, keys, order: Sequence[str]) -> DataFrame:
    """Row with the largest ``order`` per key (keep-latest dedupe); a row
    with a NULL order is the latest only when there is no other."""
    return _extreme_per_key(df, keys, F.struct(*[F.col(o) for o in order]), F.max_by)


# ------------------------------------------------------------------ lag / lead

def lag_value(df: DataFrame, key, order: Sequence[str], value: str, out: str,
              chunk: Chunk = None) -> DataFrame:
    """``mutate(out = lag(value))`` within ``key`` ordered by ``order``."""
    return _neighbour(df, key, order, value, out, chunk, forward=False)


def lead_value(df: DataFrame, key, order: Sequence[str], value: str, out: str,
               chunk: Chunk = None) -> DataFrame:
    """``mutate(out = lead(value))``."""
    return _neighbour(df, key, order, value, out, chunk, forward=True)


_CELL = "_cell"


def _split(df, keys, order, chunk):
    """Rows with their (key, chunk) cell and the in-cell window; the
    summaries below are filtered from this same window output, so the input
    is shuffled (and computed) once.

    The cell is a struct: unlike plain columns, structs with NULL fields are
    equal to each other, so rows with a NULL key or a NULL time join their
    cell's summary like any other row.
    """
    d = df.withColumn(_CELL, F.struct(*[F.col(k) for k in keys], chunk.alias("_chunk")))
    return d, Window.partitionBy(_CELL).orderBy(*_order(order))


def _across(keys) -> Window:
    """Cells of one key in chunk order; the NULL chunk comes last, as NULL
    times do within a window."""
    return Window.partitionBy(*[F.col(f"{_CELL}.`{k}`") for k in keys]) \
        .orderBy(F.col(f"{_CELL}._chunk").asc_nulls_last())


def _join_back(inner, summ):
    """Attach the per-cell carry to every row of its cell.  ``inner`` is
    already hash-partitioned by the cell, so only the small summary moves
    (or is broadcast when its measured size allows)."""
    return inner.join(summ, _CELL, "left")


def _neighbour(df, key, order, value, out, chunk, forward):
    keys = _cols(key)
    chunk = _resolve(df, keys, order, chunk)
    fn = F.lead if forward else F.lag
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*_order(order))
        return df.withColumn(out, fn(value).over(w))
    d, w_in = _split(df, keys, order, chunk)
    inner = d.select(
        "*", fn(value).over(w_in).alias(out),
        F.lag(F.lit(1)).over(w_in).isNull().alias("_first"),
        F.lead(F.lit(1)).over(w_in).isNull().alias("_last"))
    # Boundary value of every cell: its last row's value (for lag) or its
    # first row's (for lead); the neighbouring chunk's boundary is the value
    # that crosses into this chunk.
    edge_here, edge_cross = ("_first", "_last") if not forward else ("_last", "_first")
    summ = inner.where(F.col(edge_cross)).select(_CELL, F.col(value).alias("_bnd"))
    summ = summ.select(_CELL, fn("_bnd").over(_across(keys)).alias("_carry"))
    res = _join_back(inner, summ)
    return (res.withColumn(out, F.when(F.col(edge_here), F.col("_carry")).otherwise(F.col(out)))
            .drop(_CELL, "_first", "_last", "_carry"))


def change_points(df: DataFrame, key, order: Sequence[str], value: str,
                  prev_name: str, chunk: Chunk = None) -> DataFrame:
    """Rows whose ``value`` differs from the previous row's (both non-NULL):
    ``lag`` + ``filter(!is.na(prev), cur != prev)``.  A change to or from
    NULL is not a change."""
    lagged = lag_value(df, key, order, value, prev_name, chunk)
    return lagged.where(F.col(prev_name).isNotNull() & (F.col(value) != F.col(prev_name)))


def row_index(df: DataFrame, key, order: Sequence[str], out: str,
              chunk: Chunk = None) -> DataFrame:
    """Chronological index ``row_number()`` per key (1-based).

    With ``chunk`` the index is the in-chunk number plus the row count of all
    earlier chunks of the key (each chunk's count is its last row's number).
    """
    keys = _cols(key)
    chunk = _resolve(df, keys, order, chunk)
    if chunk is None:
        return df.withColumn(out, F.row_number().over(
            Window.partitionBy(*keys).orderBy(*_order(order))))
    d, w_in = _split(df, keys, order, chunk)
    inner = d.select("*", F.row_number().over(w_in).alias(out),
                     F.lead(F.lit(1)).over(w_in).isNull().alias("_last"))
    counts = inner.where(F.col("_last")).select(_CELL, F.col(out).alias("_n"))
    before = F.coalesce(F.sum("_n").over(
        _across(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(_CELL, before.alias("_off"))
    return (_join_back(inner, counts)
            .withColumn(out, (F.col(out) + F.col("_off")).cast("int"))
            .drop(_CELL, "_off", "_last"))


def rank_values(df: DataFrame, key, order: Sequence[str], rank_name: str | None = "rank",
                dense_name: str | None = "dense_rank", chunk: Chunk = None) -> DataFrame:
    """``rank()`` / ``dense_rank()`` per key.

    With ``chunk`` the ranks are in-chunk ranks plus, respectively, the row
    count and the distinct-order-value count of all earlier chunks.  The
    chunk must be a function of the ordering value (e.g. a time bucket of
    the first order column), so tied rows never straddle a chunk boundary.
    """
    keys = _cols(key)
    chunk = _resolve(df, keys, order, chunk)
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*_order(order))
        out = df
        if rank_name:
            out = out.withColumn(rank_name, F.rank().over(w))
        if dense_name:
            out = out.withColumn(dense_name, F.dense_rank().over(w))
        return out
    d, w_in = _split(df, keys, order, chunk)
    inner = d.select("*", F.rank().over(w_in).alias("_r"), F.dense_rank().over(w_in).alias("_d"),
                     F.row_number().over(w_in).alias("_i"),
                     F.lead(F.lit(1)).over(w_in).isNull().alias("_last"))
    # a chunk's row count is its last row number; its distinct values, the
    # last dense rank
    summ = inner.where(F.col("_last")).select(_CELL, F.col("_i").alias("_n"), F.col("_d").alias("_nd"))
    prior = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(_CELL, F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_off"),
                       F.coalesce(F.sum("_nd").over(prior), F.lit(0)).alias("_doff"))
    res = _join_back(inner, summ)
    if rank_name:
        res = res.withColumn(rank_name, (F.col("_r") + F.col("_off")).cast("int"))
    if dense_name:
        res = res.withColumn(dense_name, (F.col("_d") + F.col("_doff")).cast("int"))
    return res.drop(_CELL, "_r", "_d", "_i", "_last", "_off", "_doff")


def carry_last_before(df: DataFrame, key, order: Sequence[str], value: str, out: str,
                      chunk: Chunk = None) -> DataFrame:
    """Last non-NULL ``value`` strictly before each row (``last(ignorenulls)``
    over ``ROWS UNBOUNDED PRECEDING .. 1 PRECEDING``), chunk-split like lag."""
    keys = _cols(key)
    chunk = _resolve(df, keys, order, chunk)
    frame = Window.unboundedPreceding, -1
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*_order(order)).rowsBetween(*frame)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    d, w_in = _split(df, keys, order, chunk)
    upto = w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = d.select("*", F.last(value, ignorenulls=True).over(w_in.rowsBetween(*frame)).alias(out),
                     F.last(value, ignorenulls=True).over(upto).alias("_upto"),
                     F.lead(F.lit(1)).over(w_in).isNull().alias("_last"))
    # last non-NULL value of each chunk = the running value at its last row
    summ = inner.where(F.col("_last")).select(_CELL, F.col("_upto").alias("_bnd"))
    carry = F.last("_bnd", ignorenulls=True).over(_across(keys).rowsBetween(*frame))
    summ = summ.select(_CELL, carry.alias("_carry"))
    return (_join_back(inner, summ)
            .withColumn(out, F.coalesce(F.col(out), F.col("_carry")))
            .drop(_CELL, "_carry", "_upto", "_last"))


# -------------------------------------------------------------- framed windows

def rows_frame(key, order: Sequence[str], start: int, end: int) -> Window:
    """``window_frame(start, end)``: negative = PRECEDING, 0 = CURRENT ROW,
    positive = FOLLOWING, counted in rows (gaps in time are not filled)."""
    return Window.partitionBy(*_cols(key)).orderBy(*_order(order)).rowsBetween(start, end)


def framed(df: DataFrame, key, order: Sequence[str], start: int, end: int,
           aggs: dict[str, Column], chunk: Chunk = None,
           block_rows: int = MAX_ROWS_PER_KEY_TASK) -> DataFrame:
    """Add framed aggregates, e.g. ``{"trailing_avg": F.avg("services")}``.

    Without ``chunk`` this is one window per key: right for data collapsed
    to one row per person-period, whose partitions the calendar bounds.
    With ``chunk`` (a time bucket, as for :func:`lag_value`) a long history
    is split exactly: a chunked :func:`row_index` numbers every row, the
    numbers are cut into blocks of ``block_rows``, and the rows within frame
    reach of a block edge are copied into the neighbouring block as halo.
    Each block then evaluates its frames alone and keeps its own rows.
    """
    chunk = _resolve(df, _cols(key), order, chunk)
    if chunk is None:
        w = rows_frame(key, order, start, end)
        for name, agg in aggs.items():
            df = df.withColumn(name, agg.over(w))
        return df
    keys = _cols(key)
    before, after = max(0, -start), max(0, end)
    # A block is at least as long as the frame reaches, so every row's frame
    # lies in its own block and the neighbouring halos.
    block_rows = max(block_rows, before + 1, after + 1)
    pos = row_index(df, keys, order, "_pos", chunk=chunk)
    i0 = F.col("_pos") - 1
    own = F.floor(i0 / block_rows).cast("long")
    off = i0 - own * block_rows
    copies = F.array(
        F.struct(own.alias("b"), F.lit(True).alias("own")),
        # first `after` rows of a block are needed by the previous block
        F.when(off < after, F.struct((own - 1).alias("b"), F.lit(False).alias("own"))),
        # last `before` rows of a block are needed by the next block
        F.when(off >= block_rows - before,
               F.struct((own + 1).alias("b"), F.lit(False).alias("own"))))
    rows = (pos.withColumn("_copy", F.explode(F.filter(copies, lambda c: c.isNotNull())))
            .select("*", F.col("_copy.b").alias("_blk"), F.col("_copy.own").alias("_own"))
            .drop("_copy"))
    w = Window.partitionBy(*keys, "_blk").orderBy("_pos").rowsBetween(start, end)
    out = rows.select("*", *[agg.over(w).alias(name) for name, agg in aggs.items()])
    return out.where(F.col("_own")).drop("_pos", "_blk", "_own")


def shock_flags(monthly: DataFrame, key: str, period: str, measure: str,
                lookback: int = 3, factor: float = 2.0, chunk: Chunk = None,
                block_rows: int = MAX_ROWS_PER_KEY_TASK) -> DataFrame:
    """Periods where ``measure >= factor * mean(previous lookback rows)`` and
    that trailing mean is positive; first rows (empty frame) never flag."""
    f = framed(monthly, key, [period], -lookback, -1, {"trailing_avg": F.avg(measure)},
               chunk=chunk, block_rows=block_rows)
    return f.where(F.col("trailing_avg").isNotNull() & (F.col("trailing_avg") > 0)
                   & (F.col(measure) >= F.lit(factor) * F.col("trailing_avg")))
