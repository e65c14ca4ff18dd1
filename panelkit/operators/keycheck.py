"""Key integrity of a growing table without rescanning it.

A primary key refuses a batch that repeats a key.  Checking that by grouping the
whole table again costs more with every batch.  Here the stored keys are kept
in ``RANGES`` folders by hash, each with a membership filter: bitmaps of a fixed
number of bits, ``PROBES`` of which every key sets.  A batch is checked in two
steps: the filters leave a few candidates (all true repeats, and a small share of
false ones), and the stored keys are read only in the folders that hold
candidates, to settle them exactly.

Everything is built from Spark's own hash and bitmap functions; filters are
joined by (range, bitmap number), never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGES = 64                # folders of stored keys
PROBES = 4                 # bits that a key sets
BITMAP = 32768             # bits of one of Spark's bitmaps


def range_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("range"), F.col(key)), F.lit(RANGES)).cast("int")


def filter_bits(expected: int, bits_per_key: int = 16) -> int:
    """Bits per range for a table of ``expected`` keys.  With 16 bits a key
    and four probes one absent key in about 400 becomes a candidate; a table
    that outgrows the expectation gets more candidates, not wrong answers."""
    return max(BITMAP, -(-expected * bits_per_key // RANGES // BITMAP) * BITMAP)


def _probes(key: str, bits: int) -> Column:
    """The key's bit numbers within its range."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), F.col(key)), F.lit(bits)) for k in range(PROBES)])


def membership(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(range, bitmap, bits): the filter of some keys; NULL is not a key."""
    bit = F.explode(_probes(key, bits))
    return keys.where(F.col(key).isNotNull()).select(range_of(key).alias("range"), bit.alias("bit")) \
        .groupBy("range", F.bitmap_bucket_number("bit").alias("bitmap")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def merged(*filters: DataFrame) -> DataFrame:
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy("range", "bitmap").agg(F.bitmap_or_agg("bits").alias("bits"))


def _bit(bits: Column, position: Column) -> Column:
    """Bit ``position`` of a bitmap, by its byte."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)) % 2


def candidates(batch: DataFrame, key: str, state: DataFrame, bits: int) -> DataFrame:
    """(key, range): distinct keys of the batch that the filter may hold: all
    whose bits are all set."""
    probes = batch.where(F.col(key).isNotNull()).select(key).distinct() \
        .select(key, range_of(key).alias("range"), F.explode(_probes(key, bits)).alias("_bit")) \
        .select(key, "range", F.bitmap_bucket_number("_bit").alias("bitmap"), F.bitmap_bit_position("_bit").alias("_at"))
    hit = probes.join(state, ["range", "bitmap"]).where(_bit(F.col("bits"), F.col("_at")) == 1)
    # Two probes may fall on one bit, so set probes are counted, not bits.
    return hit.groupBy(key, "range").count().where(F.col("count") == PROBES).drop("count")


class KeyStore:
    """The stored keys of one table, in the shared folder ``root``.

    ``check`` finds the batch's NULL and repeated keys, ``admit`` adds its new
    ones.  State is versioned by batch number: a batch that is admitted again
    after a broken run replaces its own folders and ends the same.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, expected: int):
        self.spark, self.root, self.key, self.bits = spark, root, key, filter_bits(expected)

    def _state(self, batch: int) -> str:
        return f"{self.root}/filter/batch={batch}"

    def _stored(self, ranges: list[int], before: int) -> DataFrame:
        """Stored keys of some ranges, from the batches before this one."""
        return self.spark.read.parquet(f"{self.root}/keys") \
            .where(F.col("range").isin(ranges) & (F.col("batch") < before)).select(self.key)

    def check(self, rows: DataFrame, batch: int) -> DataFrame:
        """(key, problem): ``missing`` for a NULL key, ``twice`` for a key that
        the batch itself repeats, ``stored`` for one that an earlier batch
        holds.  One row per key and problem."""
        k = self.key
        counts = rows.groupBy(k).agg(F.count(F.lit(1)).alias("n"))
        own = counts.where(F.col(k).isNull()).select(k, F.lit("missing").alias("problem")).unionByName(
            counts.where(F.col(k).isNotNull() & (F.col("n") > 1)).select(k, F.lit("twice").alias("problem")))
        if batch == 0:
            return own
        maybe = candidates(rows, k, self.spark.read.parquet(self._state(batch - 1)), self.bits)
        path = f"{self.root}/candidates/batch={batch}"
        maybe.write.mode("overwrite").parquet(path)
        maybe = self.spark.read.parquet(path)
        ranges = [r[0] for r in maybe.select("range").distinct().collect()]      # at most RANGES
        if not ranges:
            return own
        stored = maybe.select(k).join(self._stored(ranges, batch), k, "left_semi")
        return own.unionByName(stored.select(k, F.lit("stored").alias("problem")))

    def admit(self, rows: DataFrame, batch: int) -> None:
        """Add the batch's distinct keys; ones already stored do no harm."""
        keys = rows.where(F.col(self.key).isNotNull()).select(self.key).distinct()
        salt = F.pmod(F.xxhash64(self.key), F.lit(4))
        keys.withColumn("range", range_of(self.key)).withColumn("batch", F.lit(batch)).repartition("range", salt) \
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range", "batch") \
            .parquet(f"{self.root}/keys")
        new = membership(keys, self.key, self.bits)
        if batch:
            new = merged(self.spark.read.parquet(self._state(batch - 1)), new)
        new.write.mode("overwrite").parquet(self._state(batch))
