"""Quality rules: document statistics plus cross-document line frequency.

The main path uses DataFrame functions only.  Statistics are computed in one
pass without a shuffle.  Line frequency shuffles one small row per distinct
line of a document (two 64-bit hashes, no text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import (as_row, content_lines, covered, doc_key, from_row, has_word, let, same_row,
                                  split_words)
from panelkit.session import scratch_path

# A host's line is boilerplate when more documents than this carry it.
MAX_DOCS_PER_HOST = 20
# A document is depleted when less than this share of its words remains.
MIN_REMAINING_PERCENT = 30

_POS_BITS = 28
_POS_MASK = (1 << _POS_BITS) - 1


def _packed_windows(words: Column) -> Column:
    """3-word windows as sorted longs: 36 hash bits, then the position."""
    n = F.size(words)
    triples = F.slice(F.arrays_zip(words, F.slice(words, 2, n), F.slice(words, 3, n)), 1, n - 2)
    return F.when(n < 4, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.transform(
        triples, lambda t, i: F.xxhash64(t).bitwiseAND(F.lit(~_POS_MASK)).bitwiseOR(i.cast("long")))))


def _equal_neighbours(packed: Column) -> Column:
    """Positions whose hash bits equal a neighbour's in the sorted array."""
    n = F.size(packed)
    pairs = F.zip_with(F.slice(packed, 1, F.greatest(n - 1, F.lit(0))), F.slice(packed, 2, n),
                       lambda a, b: F.when(F.shiftright(a, _POS_BITS) == F.shiftright(b, _POS_BITS), F.array(
                           a.bitwiseAND(F.lit(_POS_MASK)), b.bitwiseAND(F.lit(_POS_MASK)))))
    return F.array_distinct(F.flatten(F.array_compact(pairs)))


def _repeat_words(words: Column, positions: Column) -> Column:
    """Words covered by windows that occur twice or more, compared as words
    at the candidate ``positions``."""
    def same(x, y):
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    def verified(ws):
        keyed = F.sort_array(F.transform(positions, lambda p: F.struct(
            F.get(ws, p).alias("a"), F.get(ws, p + 1).alias("b"), F.get(ws, p + 2).alias("c"), p.alias("p"))))
        return let(keyed, lambda k: F.transform(k, lambda v, i: F.when(
            same(F.get(k, i - 1), v) | same(F.get(k, i + 1), v), v["p"])))
    return F.when(F.size(positions) == 0, F.lit(0).cast("long")).otherwise(
        covered(F.sort_array(F.array_compact(let(words, verified))), 3))


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, source, key and the base statistics of every row.

    A null text counts as empty: all statistics are 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = content_lines(F.col("text"))
    cols = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), doc_key(F.col("text")).alias("key"),
        split_words(F.col("text")).alias("words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))
    # Each array is a column of its own: lambdas then read it, not rebuild it.
    packed = cols.withColumn("packed", _packed_windows(F.col("words")))
    return packed.withColumn("places", _equal_neighbours(F.col("packed"))).select(
        "doc_id", "source", "key",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines",
        _repeat_words(F.col("words"), F.col("places")).alias("n_repeat_words")) \
        .withColumn("base_failed", (F.col("n_words") < 50)
                    | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normalised(words: Column) -> Column:
    """A line's words joined by one space, lower case, digits as 0."""
    return F.lower(F.regexp_replace(F.array_join(words, " "), "[0-9]", "0"))


def document_lines(docs: DataFrame) -> DataFrame:
    """One row per document row and distinct normalised line, with the
    places (line number, words) where it stands."""
    exploded = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), doc_key(F.col("text")).alias("key"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(has_word(F.col("line")))
    split = exploded.select("doc_id", "source", "key", "pos", split_words(F.col("line")).alias("ws"))
    hashed = split.select("doc_id", "source", "key", "pos", F.size("ws").alias("w"),
                          normalised(F.col("ws")).alias("norm"))
    return hashed.select(
        "source", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(7), "norm").alias("h2"),
        "doc_id", "key", F.struct("pos", "w").alias("place")) \
        .groupBy("source", "h1", "h2", "doc_id", "key").agg(F.collect_set("place").alias("places"))


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """(source, h1, h2, keeper) of lines carried by more than ``max_docs``
    documents of a host.  ``keeper`` is the host's smallest doc_id with the
    line; it alone keeps it, so one member of a group of copies survives."""
    return lines.groupBy("source", "h1", "h2") \
        .agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("keeper")) \
        .where(F.col("n_docs") > max_docs)


def removed_places(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """g_doc, g_key, gone: array of (pos, w), the lines to take out."""
    path = scratch_path(docs.sparkSession, "quality-lines")      # read twice
    document_lines(docs).write.parquet(path)
    lines = docs.sparkSession.read.parquet(path)
    freq = frequent_lines(lines, max_docs).select(
        F.col("source").alias("f_source"), F.col("h1").alias("f_h1"), F.col("h2").alias("f_h2"), "keeper")
    return lines.join(freq, (F.col("h1") == F.col("f_h1")) & (F.col("h2") == F.col("f_h2"))
                      & F.col("source").eqNullSafe(F.col("f_source"))) \
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper"))) \
        .groupBy(F.col("doc_id").alias("g_doc"), F.col("key").alias("g_key")) \
        .agg(F.flatten(F.collect_list("places")).alias("gone"))


def _with_removed(rows: DataFrame, docs: DataFrame, max_docs: int) -> DataFrame:
    """``rows`` (with doc_id, key) plus ``gone``, null where nothing goes."""
    gone = removed_places(docs, max_docs)
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_doc"))
                     & (F.col("key") == F.col("g_key")), "left").drop("g_doc", "g_key")


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST,
                  min_remaining: int = MIN_REMAINING_PERCENT) -> DataFrame:
    """Statistics and verdict for every document row.

    ``kept`` is false when the base rules fail, or when the words left after
    removing frequent lines are under ``min_remaining`` percent.  Null text
    counts as empty (rejected).  Null hosts form one host.  Repeated rows get
    equal results and count as one document.  Texts of any length are judged
    whole.  An empty table gives no rows; other columns are not read.
    """
    out = _with_removed(document_stats(docs), docs, max_docs).withColumn(
        "n_removed_words", F.coalesce(F.aggregate(
            "gone", F.lit(0).cast("long"), lambda a, p: a + p["w"]), F.lit(0).cast("long")))
    depleted = 100 * (F.col("n_words") - F.col("n_removed_words")) < min_remaining * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"),
                      "n_removed_words", "key", "gone")


def apply_rules(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST,
                min_remaining: int = MIN_REMAINING_PERCENT) -> DataFrame:
    """The documents that pass, without their frequent lines, in the
    columns of ``docs``."""
    # Written first (no text in it): a filter on the verdict would otherwise
    # be pushed below the arrays it is made of, which rebuilds them per use.
    path = scratch_path(docs.sparkSession, "quality-verdict")
    quality_rules(docs, max_docs, min_remaining).select("doc_id", "key", "kept", "gone").write.parquet(path)
    verdict = docs.sparkSession.read.parquet(path).where("kept").select(
        F.col("doc_id").alias("v_doc"), F.col("key").alias("v_key"), F.col("gone").alias("v_gone")) \
        .dropDuplicates(["v_doc", "v_key"])
    kept = as_row(docs).join(verdict, same_row("v_doc", "v_key"))

    def stripped(lines):
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1),
                              F.transform("v_gone", lambda p: p["pos"]))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("v_gone").isNull(), F.col("row.text")) \
        .otherwise(let(F.split("row.text", "\n"), stripped))
    return kept.withColumn("new_text", text).select(*from_row(docs, F.col("new_text")))
