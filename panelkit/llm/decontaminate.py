"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``width`` consecutive words (an
item of fewer words is one window).  The words of a window are ordered by
rarity over all documents, and the rarest one is the necessary prefix: a
document holds the window only if it holds that word, at least ``offset``
words from its start and far enough from its end.  Documents are joined on
that word, and each candidate place is verified by 128 hash bits of its words.
DataFrame functions only.  The window side is broadcast when its counted rows allow,
and both sides are shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import as_row, ascii_lower, doc_key, from_row, let, same_row
from panelkit.session import scratch_path

WIDTH = 10
BROADCAST_ROWS = 300_000
# Everything but digits, a-z and non-ASCII separates words (after lowering).
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z-lowered text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), "")


def _window_id(win: Column) -> list[Column]:
    """128 bits that stand for a window (its words joined by a space)."""
    return [F.xxhash64(win).alias("h1"), F.xxhash64(F.lit(7), win).alias("h2")]


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, broadcast when it
    has at most BROADCAST_ROWS rows (about 20 MB); else both sides shuffle."""
    path = scratch_path(df.sparkSession, "windows-" + name)
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    return F.broadcast(out) if out.count() <= BROADCAST_ROWS else out


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, win (words joined by a space), len."""
    ws = items.select("item_id", item_words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(width))
    return ws.select("item_id", n.alias("len"), F.explode(let(F.col("ws"), lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - F.least(F.size(w), F.lit(width)) + 1),
        lambda i: F.array_join(F.slice(w, i, F.least(F.size(w), F.lit(width))), " ")))).alias("win")) \
        .dropDuplicates(["item_id", "win"])


def rarest_words(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """h1, h2, len, word, offset: each distinct window's necessary word."""
    tokens = windows.select(*_window_id(F.col("win")), "win", "len").dropDuplicates(["h1", "h2"]) \
        .select("h1", "h2", "len", F.posexplode(F.split("win", " ")).alias("offset", "word"))
    vocabulary = _stored(tokens.select("word").distinct(), "vocabulary")
    counts = docs.select(F.explode(item_words(F.col("text"))).alias("word")) \
        .join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    ranked = tokens.join(counts, "word")        # a window with an absent word is nowhere
    return ranked.groupBy("h1", "h2", "len").agg(
        F.min(F.struct("n", "word", "offset")).alias("r"), F.count("*").alias("held")) \
        .where(F.col("held") == F.col("len")) \
        .select("h1", "h2", "len", F.col("r.word").alias("word"), F.col("r.offset").alias("offset"))


def window_hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, how: str = "left") -> DataFrame:
    """Every document row: doc_id, key, n_words and hits, an array of (start,
    len, h1, h2) of the verified occurrences (empty when there are none).
    ``how="inner"`` leaves out documents without a candidate place."""
    prefix = _stored(rarest_words(docs, item_windows(items, width)), "prefix")
    keyed = docs.select("doc_id", doc_key(F.col("text")).alias("key"),
                        item_words(F.col("text")).alias("ws"))
    places = keyed.select("doc_id", "key", F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "word"))
    found = places.join(prefix, "word") \
        .withColumn("start", F.col("pos") - F.col("offset")) \
        .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n"))) \
        .groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "len", "h1", "h2")).alias("cand")) \
        .select(F.col("doc_id").alias("c_doc"), F.col("key").alias("c_key"), "cand")
    joined = docs.select("doc_id", "text", doc_key(F.col("text")).alias("key")).join(
        found, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("key") == F.col("c_key")), how) \
        .withColumn("ws", item_words(F.col("text")))

    def verified(ws):
        def same(c):
            win = F.array_join(F.slice(ws, c["start"] + 1, c["len"]), " ")
            h1, h2 = _window_id(win)
            return (h1 == c["h1"]) & (h2 == c["h2"])
        return F.filter("cand", same)
    none = F.array().cast("array<struct<start:int,len:int,h1:bigint,h2:bigint>>")
    return joined.select("doc_id", "key", F.size("ws").cast("long").alias("n_words"),
                         F.when(F.col("cand").isNull(), none).otherwise(let(F.col("ws"), verified)).alias("hits"))


def _covered(hits: Column) -> Column:
    """Words inside any hit; hits may differ in length."""
    ordered = F.sort_array(hits)
    acc = F.aggregate(
        ordered, F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, h: F.struct(
            F.greatest(a["end"], h["start"] + h["len"]).cast("long").alias("end"),
            (a["n"] + F.greatest(F.lit(0), h["start"] + h["len"] - F.greatest(a["end"], h["start"])))
            .cast("long").alias("n")))
    return acc["n"]


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document row: n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty text has no words and no hit; null or empty items give no
    window; items without an id hit but are not listed.  Repeated document
    rows get equal results, repeated items count once.  Texts of any length
    are searched whole.  An empty table of documents gives no rows, one of
    items no hits; other columns are not read.  Windows are compared by 128
    hash bits.
    """
    path = scratch_path(docs.sparkSession, "windows-hits")      # small, and read twice
    window_hits(docs, items, width).select(
        "doc_id", "key", "n_words", _covered(F.col("hits")).alias("n_hit"),
        F.array_distinct(F.transform("hits", lambda h: F.struct(h["h1"].alias("h1"), h["h2"].alias("h2"))))
        .alias("wins")).write.parquet(path)
    hits = docs.sparkSession.read.parquet(path)
    owners = item_windows(items, width).select(
        *_window_id(F.col("win")), F.col("item_id").cast("string").alias("item"))
    listed = hits.select("doc_id", "key", F.explode("wins").alias("w")).select("doc_id", "key", "w.*") \
        .join(owners, ["h1", "h2"]).groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item")).alias("items")) \
        .select(F.col("doc_id").alias("l_doc"), F.col("key").alias("l_key"), "items")
    out = hits.join(listed, F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("key") == F.col("l_key")), "left")
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size(items_col).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items_col, ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"), "key", items_col.alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without any benchmark window, in their own columns."""
    path = scratch_path(docs.sparkSession, "windows-contaminated")
    window_hits(docs, items, width, "inner").select("doc_id", "key", F.size("hits").alias("n")).write.parquet(path)
    bad = docs.sparkSession.read.parquet(path).where("n > 0") \
        .select(F.col("doc_id").alias("b_doc"), F.col("key").alias("b_key")).dropDuplicates()
    return as_row(docs).join(bad, same_row("b_doc", "b_key"), "left_anti").select(*from_row(docs))
