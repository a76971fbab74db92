"""The leakage index as a table that grows by batches: what is written once is never written again.

``keys/batch=N/bucket=B`` holds the keys (kind, key) that batch N brought and no batch before it had, by a bucket of the key's hash.
``filters/batch=N`` holds their Bloom filter: a key sets three bits in one of ``BLOCKS`` bitmaps, built by aggregation. Filters of several batches are OR-ed.

A probe tests its keys against the filter first, in place; only those that may be held are shuffled to the exact join, which reads only their
buckets. The filter is broadcast and has a fixed size; a store of very many keys fills it up, and then the join alone decides. A batch is written again by the same number with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import let
from ..sources.shared import written
from . import hamming

BUCKETS = 64
#: Bitmaps of 4 KB: a filter of 4 MB at most, good for some three million keys.
BLOCKS, BITS = 1024, 32768
KEYS = "kind string, key string, batch int, bucket int"
FILTERS = "block int, bits binary, batch int"


def _hash(kind: Column, key: Column, salt: int) -> Column:
    return F.xxhash64(kind, key, F.lit(salt))


def bucket(kind: Column, key: Column) -> Column:
    return F.pmod(_hash(kind, key, 0), F.lit(BUCKETS)).cast("int")


def block(kind: Column, key: Column) -> Column:
    return F.pmod(_hash(kind, key, 1), F.lit(BLOCKS)).cast("int")


def positions(kind: Column, key: Column) -> Column:
    """Three bits of a bitmap, of one hash."""
    return let(_hash(kind, key, 2), lambda h: F.array(*(F.shiftrightunsigned(h, 15 * i).bitwiseAND(BITS - 1) for i in range(3))))


def bloom(keys: DataFrame) -> DataFrame:
    """(block, bits) of a table of keys: bits are set where they are, and combined before the shuffle."""
    at = keys.select(block(F.col("kind"), F.col("key")).alias("block"), F.explode(positions(F.col("kind"), F.col("key"))).alias("at"))
    return at.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))


def may_hold(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """``keys`` that the filter (block, bits) doesn't exclude."""
    marked = keys.withColumn("_block", block(F.col("kind"), F.col("key"))).join(F.broadcast(filters.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))), "_block")
    return marked.where(F.forall(positions(F.col("kind"), F.col("key")), lambda p: _bit(F.col("_bits"), p))).drop("_block", "_bits")


def _bit(bits: Column, p: Column) -> Column:
    byte = F.conv(F.hex(bits.substr(F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (p % 8).cast("int")) == 1


def begin(spark: SparkSession, root: str) -> None:
    """An empty store, if there is none."""
    spark.createDataFrame([], "kind string, key string").write.mode("ignore").parquet(f"{root}/keys/batch=-1/bucket=0")
    spark.createDataFrame([], "block int, bits binary").write.mode("ignore").parquet(f"{root}/filters/batch=-1")


def keys(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """(kind, key, batch, bucket) of the store as it was after batch ``upto``, or is."""
    every = spark.read.schema(KEYS).parquet(f"{root}/keys")
    return every if upto is None else every.where(F.col("batch") <= upto)


def filters(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    every = spark.read.schema(FILTERS).parquet(f"{root}/filters")
    every = every if upto is None else every.where(F.col("batch") <= upto)
    return every.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def held(given: DataFrame, root: str, upto: int | None = None) -> DataFrame:
    """The different (kind, key) of ``given`` that the store holds."""
    spark = given.sparkSession
    asked = may_hold(given.select("kind", "key").where("key is not null").distinct(), filters(spark, root, upto)).withColumn("bucket", bucket(F.col("kind"), F.col("key")))
    return asked.join(keys(spark, root, upto), ["bucket", "kind", "key"], "left_semi").select("kind", "key")


def add(index: DataFrame, root: str, batch: int) -> None:
    """AG13: the keys of ``index`` (kind, key) that no batch before ``batch`` has, and their filter, in folders of their own."""
    spark = index.sparkSession
    begin(spark, root)
    given = written(index.select("kind", "key").where("key is not null").distinct(), "leakage")
    new = given.join(held(given, root, batch - 1), ["kind", "key"], "left_anti").withColumn("bucket", bucket(F.col("kind"), F.col("key")))
    to = f"{root}/keys/batch={batch}"
    new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(to)
    added = spark.read.schema("kind string, key string, bucket int").parquet(to)
    bloom(added).write.mode("overwrite").parquet(f"{root}/filters/batch={batch}")


def probe(batch: DataFrame, root: str, upto: int | None = None) -> DataFrame:
    """J2, J3, J4 against the store, with the flags of operators.leakage.probe."""
    kinds = {"url": "url", "html_hash": "html_hash", "phishing_domain": "domain"}
    asked = batch.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in kinds.items()))))
    found = written(held(asked, root, upto), "held")
    given = batch
    for kind, column in kinds.items():
        mine = found.where(F.col("kind") == kind).select(F.col("key").alias("_key"))
        batch = batch.join(mine, F.col(column) == F.col("_key"), "left").withColumn(f"in_{kind}", F.col("_key").isNotNull().cast("int")).drop("_key")
    if "dhash" in batch.columns:  # near ones can't be asked by their own hash
        shots = keys(batch.sparkSession, root, upto).where("kind = 'screenshot_hash'").select(hamming.from_hex(F.col("key")).alias("hb"))
        near = hamming.near_any(given.select(F.col("dhash").alias("ha")), shots).withColumnRenamed("ha", "_shot")
        batch = batch.join(near, F.col("dhash") == F.col("_shot"), "left").withColumn("in_screenshot_hash", F.col("_shot").isNotNull().cast("int")).drop("_shot")
    return batch
