"""Pairs of 64-bit hashes within a Hamming radius, as an equi-join: of radius + ``INTACT`` bands at least INTACT are equal."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 5
#: Bands that a bucket joins: of 7 bands 2 give 21 buckets of some 18 bits for each hash, where 1 of 6 would give buckets of 11 bits.
INTACT = 2


def sign_hash(vector: Column) -> Column:
    """The signs of 64 components as a signed number, the first component in the highest bit."""
    bits = F.transform(F.slice(vector, 1, 64), lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def distance(a: Column, b: Column) -> Column:
    """I2."""
    return F.bit_count(a.bitwiseXOR(b))


def to_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def from_hex(text: Column) -> Column:
    """The signed number of 16 hex digits."""
    return F.conv(text, 16, -10).cast("bigint")


def banded(rows: DataFrame, hash_col: str, radius: int = RADIUS) -> DataFrame:
    """``rows``, once for each choice of ``INTACT`` bands, with its number and the hash's bits in these bands."""
    n, at, masks = radius + INTACT, 0, []
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        masks.append(((1 << width) - 1) << at)
        at += width
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chosen = [signed(sum(c)) for c in combinations(masks, INTACT)]
    return rows.select("*", F.inline(F.array(*(F.struct(F.lit(i).alias("band"), F.col(hash_col).bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(chosen)))))


def near_pairs(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, distance) of all pairs of ``left`` (a, ha) and ``right`` (b, hb) within the radius."""
    pairs = banded(left.select("a", "ha"), "ha", radius).join(banded(right.select("b", "hb"), "hb", radius), ["band", "value"])
    return pairs.select("a", "b", distance(F.col("ha"), F.col("hb")).alias("distance")).where(F.col("distance") <= radius).distinct()


def near_any(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(ha) of the different hashes of ``left`` (ha) that any hash of ``right`` (hb) is near to. Null hashes are near to none."""
    a, b = (x.where(f"{c} is not null").select(c).distinct() for x, c in ((left, "ha"), (right, "hb")))
    pairs = banded(a, "ha", radius).join(banded(b, "hb", radius), ["band", "value"])
    return pairs.where(distance(F.col("ha"), F.col("hb")) <= radius).select("ha").distinct()
