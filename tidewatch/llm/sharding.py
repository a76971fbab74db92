"""Sharding by global byte-size prefix sums: contiguous shards of nearly equal bytes.

Rows are put in the global order of (id, checksum, size) by a range exchange of these narrow columns alone. Each
partition gives its total; the prefix sums of these few totals (one for each partition) give each partition its
offset, and each row adds the sizes before it in its partition. A row goes to the shard in whose equal share of all
bytes its middle falls, so shards are contiguous in the global order and off their target by half a row at each end.

The ordered rows are checkpointed between the two passes, as a recomputed range exchange might cut elsewhere.

Defined results: a null text has no bytes and counts as size 1; equal ids are ordered by their text's checksum; wholly
equal rows are interchangeable; with fewer rows than shards some shards stay empty; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SHARDS = 16


def _ordered(narrow: DataFrame) -> DataFrame:
    out = narrow.repartitionByRange("id", "crc", "size").sortWithinPartitions("id", "crc", "size")
    return checkpointed(out.withColumn("pid", F.spark_partition_id()))


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS) -> DataFrame:
    """(id, size, crc, shard: int, slot: bigint); slot is the place in the shard, without gaps from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = _ordered(docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc")))
    totals = sorted(rows.groupBy("pid").agg(F.sum("size"), F.count("*")).collect())  # one row for each partition
    before, at = {}, [0, 0]
    for pid, size, n in totals:
        before[pid] = tuple(at)
        at = [at[0] + size, at[1] + n]
    total = at[0]

    def place(batches: Iterator[pa.RecordBatch], cut: list[int] | None = None) -> Iterator[pa.RecordBatch]:
        pid, done, seen = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            if pid is None:
                pid = b.column(3)[0].as_py()
                done, seen = before[pid]
            size = np.asarray(b.column(1))
            ends = done + np.cumsum(size)
            # the middle's share of the total: a shard's number, exact for up to 2 ** 58 bytes of 16 shards
            shard = np.array([min((2 * e - s) * n_shards // (2 * total), n_shards - 1) for e, s in zip(ends.tolist(), size.tolist(), strict=True)], np.int32)
            order = seen + np.arange(len(size))
            done, seen = int(ends[-1]), seen + len(size)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(shard), pa.array(order)], names=["id", "size", "crc", "shard", "ordinal"])

    id_type = dict(rows.dtypes)["id"]
    placed = rows.mapInArrow(place, f"id {id_type}, size bigint, crc bigint, shard int, ordinal bigint")
    first = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("ordinal").alias("first")).collect()}  # one for each shard
    if not first:
        return placed.withColumnRenamed("ordinal", "slot")
    base = F.element_at(F.create_map(*(F.lit(x) for kv in first.items() for x in kv)), F.col("shard"))
    return placed.select("id", "size", "crc", "shard", (F.col("ordinal") - base).alias("slot"))


def query(docs: DataFrame) -> DataFrame:
    out = shards(docs)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
