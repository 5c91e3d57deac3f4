"""Postings: which series have a label's value, as rows and as bitmaps, and their algebra.

A bitmap covers ``BITMAP_BITS`` series; (name, value, bucket) is its key. Bitmaps are built, joined
and counted by Spark's bitmap functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def postings(series: DataFrame) -> DataFrame:
    """(tsid, labels, min_t, max_t) -> name, value, tsid, min_t, max_t: a row for each label of each series."""
    return series.select(F.explode("labels").alias("name", "value"), "tsid", "min_t", "max_t")


def of(posting_rows: DataFrame, name: str, value: str) -> DataFrame:
    """The posting list of one label value."""
    return posting_rows.where((F.col("name") == name) & (F.col("value") == value)).select("tsid")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("tsid").intersect(b.select("tsid"))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("tsid").union(b.select("tsid")).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("tsid").exceptAll(b.select("tsid").distinct()).distinct()


def cardinality(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("tsid").alias("n"))


def intervals(posting_rows: DataFrame) -> DataFrame:
    """name, value, min_t, max_t, n: the times and the number of series of each label value."""
    return posting_rows.groupBy("name", "value").agg(F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t"), F.count("*").alias("n"))


def bitmaps(posting_rows: DataFrame, *keys: str) -> DataFrame:
    """keys, bucket, bits: a bitmap for each key (name and value by default) and range of numbers."""
    keys = keys or ("name", "value")
    return posting_rows.groupBy(*keys, F.bitmap_bucket_number("tsid").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("tsid")).alias("bits"))


def bitmap_counts(maps: DataFrame, *keys: str) -> DataFrame:
    """The number of series of each key."""
    return maps.groupBy(*(keys or ("name", "value"))).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def bitmap_or(maps: DataFrame) -> DataFrame:
    """bucket, bits: the union."""
    return maps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_and(maps: DataFrame, n: int) -> DataFrame:
    """bucket, bits: what all ``n`` inputs have; a bucket that one of them lacks is dropped. Each input has one row a bucket."""
    return maps.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("inputs")).where(F.col("inputs") == n).select("bucket", "bits")


def bitmap_pages(posting_rows: DataFrame) -> DataFrame:
    """(name, value, tsid, min_t, max_t) -> name, value, bucket, bits, min_t, max_t: bitmaps with the times of all their series together."""
    own = posting_rows.groupBy("name", "value", F.bitmap_bucket_number("tsid").alias("bucket"))
    return own.agg(F.bitmap_construct_agg(F.bitmap_bit_position("tsid")).alias("bits"), F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t"))


def bitmap_tsids(maps: DataFrame, *keep: str) -> DataFrame:
    """(bucket, bits) -> tsid, beside the columns ``keep``: the numbers of the bits set. A bitmap is taken apart as 512 words; those with no bit go first."""
    word = lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, 8)), 16, -10).cast("long")
    words = F.filter(F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.struct(i.alias("i"), word(i).alias("w"))), lambda x: x["w"] != 0)
    some = maps.select(*keep, "bucket", F.explode(words).alias("x"))
    # The word's first byte is its highest; bits of a byte count from its low end.
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit(F.col("x.w"), (7 - F.floor(k / 8)).cast("int") * 8 + k % 8) == 1)
    place = F.explode(bits).alias("k")
    return some.select(*keep, "bucket", F.col("x.i").alias("i"), place).select(*keep, ((F.col("bucket") - 1) * 32_768 + F.col("i") * 64 + F.col("k") + 1).cast("long").alias("tsid"))


def layout(posting_rows: DataFrame, page: int = 4096, entry: int = 12) -> DataFrame:
    """name, layout: ``list`` where a name's postings as a sorted list take no more pages than one bitmap page a value, else ``bitmap``."""
    n = posting_rows.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))
    pages = F.ceil(F.col("n") * entry / page) * page
    return n.select("name", F.when(pages <= F.col("n_values") * page, "list").otherwise("bitmap").alias("layout"))
