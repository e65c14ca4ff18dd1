"""Shared column expressions for the DataFrame-only operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words: space and \t \n \v \f \r.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, evaluated once per row.

    A lambda that names an outer expression has it evaluated per element;
    binding it as the variable of a one-element transform avoids that.
    """
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null or blank gives []."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")) \
        .otherwise(F.split(trimmed, WS_CLASS + "+"))


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(WS_CHARS)) != ""


def content_lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), has_word)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else.  ``lower`` does that on pure ASCII; other
    texts go through ``translate``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, upper, upper.lower()))


def covered(starts: Column, width) -> Column:
    """Number of positions covered by intervals [s, s + width) with the given
    starts, an array of distinct ascending integers."""
    w = width if isinstance(width, Column) else F.lit(width)
    step = F.aggregate(
        starts, F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            (s + w).cast("long").alias("end"),
            (acc["n"] + w - F.greatest(F.lit(0), acc["end"] - s)).cast("long").alias("n")))
    return step["n"]


def doc_key(text: Column) -> Column:
    """Text fingerprint that, with doc_id, tells rows of equal id apart."""
    return F.xxhash64(text)


def as_row(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as one struct ``row``, plus ``row_key``; other
    columns can then be joined on without name clashes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       doc_key(F.col("text")).alias("row_key"))


def same_row(doc: str, key: str) -> Column:
    """Join condition of an :func:`as_row` table on doc_id and text key."""
    return F.col("row.doc_id").eqNullSafe(F.col(doc)) & (F.col("row_key") == F.col(key))


def from_row(docs: DataFrame, text: Column | None = None) -> list[Column]:
    """The columns of ``docs`` out of ``row``, with a new text and its n_chars."""
    out = []
    for c in docs.columns:
        col = F.col(f"row.`{c}`")
        if text is not None and c == "text":
            col = text
        elif text is not None and c == "n_chars":
            col = F.length(text).cast(docs.schema[c].dataType)
        out.append(col.alias(c))
    return out
