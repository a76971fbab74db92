"""Filter interaction audit: what each filter of a chain removes, in every order, from the counts of 32 masks.

Each document gets a mask of the filters that it fails. Whatever the order, the filters S remove exactly the documents whose mask meets
S, so everything follows from the number of documents of each mask in a part. For one part these counts give the removal
polynomial: the multilinear extension of S -> documents removed, with a coefficient for each set of filters. Its value at a corner is the
number that this set removes, so what survives a prefix of an order is the total less the value at the prefix's corner. The integral of its
partial derivative along the diagonal is a filter's Shapley value: the sum of c_T / |T| over the sets T with the filter, in exact
fractions. Times 120 it is the number of documents that the filter removes, summed over the 120 orders.

Texts are read once, in Arrow batches that give a mask and the text's SHA-256. Copies are found by grouping digests; only those that
occur twice are joined with the documents. Counts are combined before their shuffle, and each part's row of 96 counts becomes its 600 rows in a task of its own.

Defined results: a null text is empty; an empty text has 0 words and fails A alone of A to D. A document with a null id is no copy and makes none; equal ids aren't
smaller than each other. Null and empty ``lang`` are one part. Of several label rows of an id, any that says 1 counts. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few_or_not, materialised, release, short_batches

FILTERS = "ABCDE"
FULL = (1 << len(FILTERS)) - 1
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 100, 80, 10, b"#$%&*|"
CAPITALS = bytes(range(65, 91))


def failures(text: bytes) -> int:
    """The mask of A to D for one text. bytes.split() cuts at the six blanks U+0009 to U+000D and U+0020."""
    words = text.split()
    n = len(words)
    points = len(text) if text.isascii() else len(text.decode())
    capitals = len(text) - len(text.translate(None, CAPITALS))
    fails = (n < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * points, len(text.translate(None, MARKS)) < len(text))
    return sum(1 << i for i, x in enumerate(fails) if x)


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) of every document, all five filters in the mask."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([failures(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], names=schema.names)
        release()

    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    rows = materialised(narrow.mapInArrow(run, schema), "audit-masks")
    copies = few_or_not(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    again = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int")
    return rows.join(copies, "digest", "left").select("id", "part", (F.col("mask") + again * (1 << FILTERS.index("E"))).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, toxic): for each part, arrays of 32 counts by mask."""
    said = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("bigint"))
    cells = masks.join(said, masks["id"] == said["_id"], "left").groupBy("part", "mask").agg(F.count("*").alias("n"), one("good").alias("good"), one("toxic").alias("toxic"))
    at = lambda c: F.array(*(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(F.lit(0).cast("bigint"))) for m in range(FULL + 1))).alias(c)
    return cells.groupBy("part").agg(at("n"), at("good"), at("toxic"))


class Removal:
    """The removal polynomial of one part's mask counts: ``c[T]`` is the coefficient of the product of x_i over T."""

    def __init__(self, counts: list[int]):
        # a document of mask m is removed with 1 - prod_{i in m} (1 - x_i) = - sum over non-empty T in m of (-1)^|T| prod_T x
        self.c = [0] * (FULL + 1)
        for m, n in enumerate(counts):
            t = m
            while t:
                self.c[t] -= n * (-1) ** t.bit_count()
                t = (t - 1) & m

    def corner(self, s: int) -> int:
        """The documents that the filters of the set s remove."""
        return sum(c for t, c in enumerate(self.c) if t & s == t)

    def shapley(self, i: int) -> Fraction:
        """The integral over u from 0 to 1 of the partial derivative by x_i at (u, ..., u)."""
        return sum((Fraction(c, t.bit_count()) for t, c in enumerate(self.c) if t >> i & 1), Fraction(0))


def report(part: str, n: list[int], good: list[int], toxic: list[int]) -> Iterator[tuple]:
    """The 600 rows of one part: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    total, size = sum(n), len(FILTERS)
    removal = Removal(n)
    every, well, ill = ([p.corner(s) for s in range(FULL + 1)] for p in (removal, Removal(good), Removal(toxic)))
    value = [removal.shapley(i) * factorial(size) for i in range(size)]
    assert all(v.denominator == 1 for v in value)
    for order in permutations(range(size)):
        s = 0
        for step, i in enumerate(order, 1):
            was, s = s, s | 1 << i
            gone = every[s] - every[was]
            yield (part, "".join(FILTERS[j] for j in order), step, total - every[s], gone, every[1 << i] - gone, every[FULL] - every[FULL ^ 1 << i], well[s] - well[was], ill[s] - ill[was], int(value[i]))


NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the five filters and step."""
    counts = mask_counts(masked(docs, id_col, text_col, part_col), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                made = list(zip(*report(*row), strict=True))
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(NUMBERS)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, kinds, strict=True)], names=["part", "filter_order", "step", *NUMBERS])

    return counts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{x} bigint" for x in NUMBERS))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)
