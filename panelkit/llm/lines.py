"""Line dedup over overlapping three-line windows.

Lines that hold a word are taken in order; every three consecutive ones form
a window.  A window that occurs anywhere else earlier, by (doc_id, position),
is a repeat, and the lines it covers go.  Overlapping repeats merge.  Windows
travel as two 64-bit hashes; text is shuffled once, to rebuild documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import WS_CHARS, as_row, content_lines, covered, doc_key, from_row, has_word, let, same_row

WINDOW = 3


def line_windows(docs: DataFrame) -> DataFrame:
    """doc_id, key, pos, h1, h2 of every three-line window."""
    keyed = docs.select("doc_id", doc_key(F.col("text")).alias("key"), F.transform(
        content_lines(F.col("text")), lambda x: F.btrim(x, F.lit(WS_CHARS))).alias("ls")) \
        .where(F.size("ls") >= WINDOW)
    wins = let(F.col("ls"), lambda ls: F.transform(
        F.slice(ls, 1, F.size(ls) - (WINDOW - 1)),
        lambda x, i: F.struct(
            i.alias("pos"), F.xxhash64(x, ls[i + 1], ls[i + 2]).alias("h1"),
            F.xxhash64(F.lit(7), x, ls[i + 1], ls[i + 2]).alias("h2"))))
    return keyed.select("doc_id", "key", F.explode(wins).alias("w")).select("doc_id", "key", "w.*")


def repeated_positions(docs: DataFrame) -> DataFrame:
    """doc_id, key, starts: windows whose lines appear earlier."""
    wins = line_windows(docs)
    first = wins.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "key", "pos")).alias("first"), F.count("*").alias("n")) \
        .where("n > 1").select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first")
    later = wins.join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))) \
        .where(~(F.struct("doc_id", "key", "pos").eqNullSafe(F.col("first"))))
    return later.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def line_dedup(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """The columns of ``docs`` with repeated lines taken out of ``text`` (and
    n_chars to match), plus n_lines (lines with a word) and n_removed, which
    replace columns of those names.

    Documents with fewer than three lines have no window; texts of any length
    are taken whole, and an empty table gives no rows.  Null text stays
    null.  Rows with equal doc_id and text are one document and get equal
    results; ties between equal doc_ids are broken by the text's hash.
    A document may end up with no line; it stays, with empty text, unless
    ``drop_emptied``.
    """
    gone = repeated_positions(docs).select(
        F.col("doc_id").alias("r_doc"), F.col("key").alias("r_key"), "starts")
    rows = as_row(docs).join(gone, same_row("r_doc", "r_key"), "left")
    if drop_emptied:
        # Stated on the window starts, so the filter does not rebuild texts.
        held = F.size(content_lines(F.col("row.text")))
        rows = rows.where(F.col("starts").isNull() | (covered(F.col("starts"), WINDOW) < held))

    def rebuilt(ls):
        held = F.array_compact(F.transform(ls, lambda x, i: F.when(has_word(x), i)))
        inside = F.array_distinct(F.flatten(F.transform(
            "starts", lambda p: F.array(p, p + 1, p + 2))))
        gone_at = let(held, lambda h: F.transform(inside, lambda c: F.get(h, c)))
        return let(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone_at),
                   lambda keep: F.struct(
                       F.array_join(F.transform(keep, lambda i: F.get(ls, i)), "\n").alias("text"),
                       (F.size(ls) - F.size(keep)).cast("long").alias("n")))
    out = rows.withColumn("new", F.when(F.col("starts").isNotNull(), let(F.split("row.text", "\n"), rebuilt)))
    text = F.when(F.col("new").isNull(), F.col("row.text")).otherwise(F.col("new.text"))
    return out.withColumn("new_text", text).select(
        *[c for n, c in zip(docs.columns, from_row(docs, F.col("new_text"))) if n not in ("n_lines", "n_removed")],
        F.size(content_lines(F.col("row.text"))).cast("long").alias("n_lines"),
        F.coalesce("new.n", F.lit(0)).cast("long").alias("n_removed"))
