"""Line deduplication with two Bloom filters: of hashes seen once and of hashes seen twice.

A line's key is the line without blanks at both ends, A-Z lower-cased. Keys that stand in at least ``min_docs`` documents
are repeats.

1. Each text becomes the 16-byte BLAKE2 digests of its lines' keys, written once as a narrow table.
2. Tasks fill two filters of their own: a digest goes to the first, or to the second if the first has it already. A
   digest that two tasks have seen once has all its bits in both their first filters, so merging them keeps
   ``twice = twice | other.twice | (once & other.once)`` and misses no repeat. What is shuffled are blocks of bits, as
   positions where they are sparse.
3. The second filter, of ``SLICE_BITS`` at most, is broadcast. Only digests that it holds, the suspected repeats, are
   shuffled: their documents are counted by the whole digest, which confirms a repeat exactly, and the least
   (id, line) is its first occurrence.
4. Lines of confirmed keys are dropped in a last pass over the texts. Up to ``FEW_KEYS`` keys are broadcast for it;
   more are joined with the suspects and reach the texts by document.

A table of more lines than one filter of ``SLICE_BITS`` is good for is taken in slices of the digests' range, of which one filter
is held at a time; each slice reads the narrow table again.

Defined results: a null or empty text is one empty line; a null text stays null; a key shorter than ``min_chars`` code points is never dropped;
each row is a document, also where ids are null or repeated; an empty table gives no rows. A ``\\r`` before ``\\n`` belongs to its line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialised, release, short_batches

BLANKS = b" \t\n\x0b\x0c\r"
#: Bits of a filter for each line: at two positions a digest, some 1.4 % of the single lines are suspected.
BITS = 16
#: The largest filter: 32 MB.
SLICE_BITS = 1 << 28
#: Bits of a block: what filters are merged by.
BLOCK_BITS = 1 << 16
#: Confirmed keys that are broadcast: some 25 MB in a worker.
FEW_KEYS = 1 << 18
WIDTH = 16


def keys_of(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their digests; an empty digest stands for a key that is too short."""
    lines, out = (text or b"").split(b"\n"), []
    for line in lines:
        key = line.strip(BLANKS).lower()  # of bytes: A-Z only
        long = len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)
        out.append(hashlib.blake2b(key, digest_size=WIDTH).digest() if long else b"")
    return lines, out


def keyed(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, n, keys) of every document: its number of lines, and the digests and line numbers of its different keys."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("at", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, keys, places = [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                lines, digests = keys_of(text, min_chars)
                first: dict[bytes, int] = {}
                for i, d in enumerate(digests):
                    if d:
                        first.setdefault(d, i)
                counts.append(len(lines))
                keys.append(b"".join(first))
                places.append(np.fromiter(first.values(), "<i4", len(first)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(places, pa.binary())], names=["id", "n", "keys", "at"])
        release()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(bits: np.ndarray) -> bytes:
    """A block of a filter: its bytes, or the 16-bit positions of its bits where that is shorter."""
    at = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    return bits.tobytes() if 2 * len(at) >= BLOCK_BITS // 8 else at.astype("<u2").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if len(packed) == BLOCK_BITS // 8:
        return np.frombuffer(packed, np.uint8)
    bits = np.zeros(BLOCK_BITS, np.uint8)
    bits[np.frombuffer(packed, "<u2")] = 1
    return np.packbits(bits, bitorder="little")


def places(digests: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two positions of each digest (n, 2) in a filter of so many bits, a power of two up to 2 ** 32."""
    word = digests[:, 1]
    return word & np.uint64(bits - 1), (word >> np.uint64(32)) & np.uint64(bits - 1)


def holds(filter_: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    one, two = ((filter_[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in at)
    return (one & two).astype(bool)


def put(filter_: np.ndarray, at: tuple[np.ndarray, np.ndarray], mask: np.ndarray) -> None:
    for p in (x[mask] for x in at):
        np.bitwise_or.at(filter_, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))


def digests_in(column: pa.Array, which: int, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) of the slice's digests in a batch, and their places in the joined column."""
    every = np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)
    at = np.flatnonzero(every[:, 0] % np.uint64(slices) == which)
    return every[at], at


def seen_twice(rows: DataFrame, bits: int, which: int = 0, slices: int = 1) -> bytes:
    """The second filter over all tasks' digests of a slice; ``bits`` bounds what reaches the driver."""
    width = BLOCK_BITS // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            digests, _ = digests_in(b.column(0), which, slices)
            if not len(digests):
                continue
            # a document has a digest once, so what a batch has twice is of two documents
            digests = digests[np.lexsort((digests[:, 1], digests[:, 0]))]
            first = np.r_[True, (digests[1:] != digests[:-1]).any(1)]
            n = np.diff(np.r_[np.flatnonzero(first), len(digests)])
            at = places(digests[first], bits)
            put(twice, at, (n > 1) | holds(once, at))
            put(once, at, np.ones(len(n), bool))
        blocks = np.flatnonzero(once.reshape(-1, width).any(1))
        for k in range(0, len(blocks), 256):
            part = blocks[k : k + 256].tolist()
            made = [[pack(f[i * width : (i + 1) * width]) for i in part] for f in (once, twice)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in made)], names=["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([pack(twice)], pa.binary())], names=["block", "twice"])

        at = once = twice = None
        for b in batches:
            for block, o, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if block != at:
                    if at is not None and twice.any():
                        yield done()
                    at, once, twice = block, np.zeros(width, np.uint8), np.zeros(width, np.uint8)
                o = unpack(o)
                twice |= unpack(t) | (once & o)
                once |= o
        if at is not None and twice.any():
            yield done()

    blocks = rows.select("keys").mapInArrow(fill, "block int, once binary, twice binary")
    merged = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.collect():  # as many bytes as the filter has at most
        out[r.block * width : (r.block + 1) * width] = unpack(bytes(r.twice))
    return out.tobytes()


def suspects(rows: DataFrame, filter_, bits: int, which: int = 0, slices: int = 1) -> DataFrame:
    """(id, key, line) of each document's digests that the broadcast filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(filter_.value, np.uint8)
        for b in batches:
            digests, at = digests_in(b.column(1), which, slices)
            at = at[holds(twice, places(digests, bits))]
            doc = np.repeat(np.arange(b.num_rows), [len(x) // WIDTH for x in b.column(1).to_pylist()])[at]
            data = b"".join(b.column(1).to_pylist())
            line = np.frombuffer(b"".join(b.column(2).to_pylist()), "<i4")[at]
            keys = pa.array([data[i * WIDTH : (i + 1) * WIDTH] for i in at.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), keys, pa.array(line, pa.int32())], names=["id", "key", "line"])

    schema = T.StructType([rows.schema["id"], T.StructField("key", T.BinaryType()), T.StructField("line", T.IntegerType())])
    return rows.select("id", "keys", "at").mapInArrow(run, schema)


def suspected(rows: DataFrame, slice_bits: int = SLICE_BITS) -> DataFrame:
    """(id, key, line) of every digest that stands in two documents, and of few others; one filter is held at a time."""
    spark = rows.sparkSession
    lines = rows.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] // WIDTH
    slices = max(1, -(-lines * BITS // slice_bits))
    bits = max(BLOCK_BITS, 1 << (-(-lines * BITS // slices) - 1).bit_length())
    found = None
    for i in range(slices):
        sent = spark.sparkContext.broadcast(seen_twice(rows, bits, i, slices))
        part = materialised(suspects(rows, sent, bits, i, slices), "line-suspects")
        sent.destroy()
        found = part if found is None else found.union(part)
    return found


def dropped(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", slice_bits: int = SLICE_BITS, few_keys: int = FEW_KEYS) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and ``n_lines`` (before) and ``n_dropped``.

    With ``keep_first`` the line of the least (id, line number) stays, null ids first. Names that clash get underscores before them.
    """
    short_batches(docs.sparkSession)
    rows = materialised(keyed(docs, id_col, text_col, min_chars), "line-keys")
    found = suspected(rows, slice_bits)
    of_key = found.groupBy("key")
    if keep_first:
        counted = of_key.agg(F.count("*").alias("n_docs"), F.min(F.struct("id", "line")).alias("first"))
        first = [F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line")]
    else:
        counted = of_key.agg(F.count("*").alias("n_docs"))
        first = [F.lit(None).cast(rows.schema["id"].dataType).alias("first_id"), F.lit(-1).alias("first_line")]
    confirmed = materialised(counted.where(F.col("n_docs") >= min_docs).select("key", *first), "line-repeats")
    names = [free_name(docs, x) for x in ("n_lines", "n_dropped", "_repeats")]
    if confirmed.count() <= few_keys:
        pairs = {bytes(r.key): (r.first_id, r.first_line) for r in confirmed.collect()}
        return _taken_out(docs, docs.sparkSession.sparkContext.broadcast(pairs), min_chars, id_col, text_col, names)
    of_doc = found.join(confirmed, "key").groupBy("id").agg(F.collect_set(F.struct("key", "first_id", "first_line")).alias(names[2]))
    key = free_name(docs, "_id")
    of_doc = of_doc.withColumnRenamed("id", key)
    return _taken_out(docs.join(of_doc, F.col(id_col).eqNullSafe(F.col(key)), "left").select(*docs.columns, names[2]), None, min_chars, id_col, text_col, names)


def _taken_out(docs: DataFrame, sent, min_chars: int, id_col: str, text_col: str, names: list[str]) -> DataFrame:
    """The last pass: the confirmed keys are all broadcast, or each row has those of its document."""
    columns = [c for c in docs.columns if c != names[2]]
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType())])
    at, id_at = columns.index(text_col), columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sent.value if sent else None
        for b in batches:
            own = [every] * b.num_rows if sent else [{r["key"]: (r["first_id"], r["first_line"]) for r in x or ()} for x in b.column(len(columns)).to_pylist()]
            texts, n, gone = [], [], []
            for text, id_, bad in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(id_at).to_pylist(), own, strict=True):
                lines, digests = keys_of(text, min_chars)
                kept = [x for i, (x, d) in enumerate(zip(lines, digests, strict=True)) if d not in bad or bad[d] == (id_, i)]
                texts.append(None if text is None else b"\n".join(kept))
                n.append(len(lines))
                gone.append(len(lines) - len(kept))
            made = [*b.columns[: len(columns)], pa.array(n, pa.int64()), pa.array(gone, pa.int64())]
            made[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(made, names=schema.names)
        release()

    return docs.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    out = dropped(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))

