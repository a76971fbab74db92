"""Running sums in a global order, of which no task ever holds a whole key.

A range exchange by (keys, order) cuts the rows into partitions of like size, so the rows of one key may lie in many. Each
partition gives a total for each of its keys; the totals before it, of which there are as many as partitions at most,
are what a key's rows in a partition start from. The exchanged rows are written down between the two passes, as a second exchange might cut
elsewhere. Only narrow rows should be given: what else a row has is joined afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

PID = "_pid"


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sum of each column over the rows of equal keys up to this one, itself included.

    Null keys are a key. Rows that are equal in the whole order come in an order that a rerun may change, so the order
    should tell rows apart. Sums are exact for whole numbers and decimals; nulls count as 0.
    """
    made = {f"_x{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())}
    by = [*(F.col(k) for k in keys), *order]
    put = rows.withColumns(made).repartitionByRange(*by).withColumn(PID, F.spark_partition_id())
    put = written(put, "ordered")
    totals = put.groupBy(PID, *keys).agg(*(F.sum(x).alias(x) for x in made))
    before = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(F.col(PID).alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_b{x}") for x in made))
    within = Window.partitionBy(PID, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = put.withColumns({x: F.sum(x).over(within) for x in made})
    same = inside[PID] == start["_p"]
    for i, k in enumerate(keys):
        same &= inside[k].eqNullSafe(start[f"_k{i}"])
    out = inside.join(start, same)
    return out.select(*rows.columns, *((F.col(x) + F.col(f"_b{x}")).alias(name) for name, x in zip(sums, made, strict=True)))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 among those of equal keys."""
    return running(rows, keys, order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("bigint"))
