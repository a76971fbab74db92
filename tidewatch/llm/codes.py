"""Vector code compression: product codes by Lloyd rounds with Hamerly's bounds, in whole numbers.

Components become ``floor(4096 * x)`` and vectors are cut into ``PARTS`` consecutive parts, each with a codebook of
``ENTRIES``. Every part of every vector persists its entry and two bounds, rounded to the safe side: ``upper``, at least
the distance to its entry, and ``lower``, at most the distance to any other entry. When entries move, ``upper`` grows by its entry's
way and ``lower`` shrinks by the longest way of the others. While ``upper`` is strictly below ``lower``, or below half the way
to its entry's nearest neighbour, no other entry is as near and nothing is computed. Otherwise ``upper`` is tightened
to the true distance, and only if that fails too all entries are scanned with exact squares, ties going to the lower index. A tie
never passes the strict test, so the result is that of the full scan.

Each pass is one narrow map over the table: it writes the new state and, as one more row of each task, the sums that its changed parts
move from one entry to another. The grouped sum of these rows, a few thousand numbers, is all that reaches the driver.

Defined results: vectors that are null, empty or hold null or non-finite components are dropped; so are those whose length is not
that of the kept vector of least id (a multiple of ``PARTS``) and those with a component of 4096 or more in
magnitude, whose squares exact 64-bit sums can't hold. Equal ids are ordered by their components, null ids last. Fewer vectors than ``ENTRIES`` give
codebooks of as many entries; no vectors give no rows. Null labels count as one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few_or_not, materialised, removed, short_batches

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Whole components stay below this in magnitude.
WIDEST = 1 << 24
FAR = np.int64(1) << 62


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, q: array<int>) of the vectors that can be coded."""
    small = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < WIDEST // SCALE)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % PARTS == 0) & F.forall(v, small))
    return rows.select("id", "label", F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("q"))


def root(squares: np.ndarray, up: bool = False) -> np.ndarray:
    """Whole square roots, rounded down or up, exact below 2 ** 62."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    r += (r + 1) * (r + 1) <= squares
    return r + (r * r < squares) if up else r


class Moves:
    """What the last update of the codebooks does to the bounds."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        way = root(((new - old) ** 2).sum(2), up=True)  # (PARTS, entries)
        order = np.sort(way, 1)
        self.own = way
        # the longest way of any other entry
        self.others = np.where(way == order[:, -1:], order[:, -2:-1] if way.shape[1] > 1 else 0, order[:, -1:])
        apart = ((new[:, :, None] - new[:, None]) ** 2).sum(3)
        apart[:, np.arange(new.shape[1]), np.arange(new.shape[1])] = FAR
        self.nearest = root(apart.min(2))


def assign(q: np.ndarray, books: np.ndarray, state: tuple | None, moves: Moves | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper, lower) of each part of q (n, PARTS, width), and how many parts were scanned in full."""
    n, part = len(q), np.arange(PARTS)
    if state is None:
        a, up, low = np.zeros((n, PARTS), np.int64), np.full((n, PARTS), FAR), np.full((n, PARTS), -1)
    else:
        a = state[0].astype(np.int64)
        up, low = state[1] + moves.own[part, a], state[2] - moves.others[part, a]
        near = moves.nearest[part, a]
        row, col = np.nonzero(~((up < low) | (2 * up < near)))
        up[row, col] = root(((q[row, col] - books[col, a[row, col]]) ** 2).sum(1), up=True)
    todo = np.ones((n, PARTS), bool) if state is None else ~((up < low) | (2 * up < near))
    for p in part:
        at = np.flatnonzero(todo[:, p])
        if not len(at):
            continue
        squares = ((q[at, p][:, None] - books[p][None]) ** 2).sum(2)
        best = squares.argmin(1)  # the first of equals
        a[at, p], up[at, p] = best, root(squares[np.arange(len(at)), best], up=True)
        squares[np.arange(len(at)), best] = FAR
        low[at, p] = root(squares.min(1))
    return a, up, low, int(todo.sum())


def _pass(rows: DataFrame, books: np.ndarray, moves: Moves | None) -> DataFrame:
    """One assignment of all parts: (id, label, q, code, upper, lower) and rows that hold only ``sums``."""
    entries, width = books.shape[1:]
    schema = T.StructType([rows.schema["id"], rows.schema["label"], rows.schema["q"], *(T.StructField(k, T.BinaryType()) for k in ("code", "upper", "lower")), T.StructField("sums", T.ArrayType(T.LongType()))])
    short_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, scanned, last = np.zeros((PARTS, entries, width + 1), np.int64), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            last = b
            q = np.asarray(b.column(2).flatten()).astype(np.int64).reshape(-1, PARTS, width)
            state = None
            if moves is not None:
                state = tuple(np.frombuffer(b"".join(b.column(i).to_pylist()), t).reshape(-1, PARTS) for i, t in ((3, np.uint8), (4, "<i8"), (5, "<i8")))
            a, up, low, n = assign(q, books, state, moves)
            scanned += n
            changed = np.ones(a.shape, bool) if state is None else a != state[0]
            for p in range(PARTS):
                at = np.flatnonzero(changed[:, p])
                if len(at):
                    x = np.c_[q[at, p], np.ones(len(at), np.int64)]
                    np.add.at(sums[p], a[at, p], x)
                    if state is not None:
                        np.subtract.at(sums[p], state[0][at, p], x)
            made = [pa.array([x.tobytes() for x in v], pa.binary()) for v in (a.astype(np.uint8), up.astype("<i8"), low.astype("<i8"))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made, pa.nulls(b.num_rows, pa.list_(pa.int64()))], names=schema.names)
        if last is not None:
            empty = [pa.nulls(1, x.type) for x in last.columns[:3]] + [pa.nulls(1, pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([*empty, pa.array([[*sums.ravel().tolist(), scanned]], pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def encode(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray, list[int]]:
    """(id, label, code: binary, error), the codebooks (PARTS, entries, width), and the parts that each pass scanned in full."""
    spark = vectors.sparkSession
    base = materialised(quantised(vectors, id_col, vec_col, label_col), "codes-base")
    order = (F.col("id").asc_nulls_last(), "q")
    first = base.select("id", "q").orderBy(*order).first()
    width = len(first.q) // PARTS if first else 1
    rows = base.where(F.size("q") == width * PARTS)
    seeds = [r.q for r in rows.select("id", "q").orderBy(*order).limit(entries).collect()]
    books = np.array(seeds, np.int64).reshape(-1, PARTS, width).transpose(1, 0, 2)
    sums, moves, scanned, old = np.zeros((*books.shape[:2], width + 1), np.int64), None, [], None
    for _ in range(rounds + 1 if seeds else 0):
        state = materialised(_pass(rows, books, moves), "codes-state")
        flat = state.where("sums is not null").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
        got = dict(flat.collect())  # one number for each entry and position
        scanned.append(got.pop(sums.size))
        rows = state.where("sums is null")
        if old is not None:
            removed(old)
        old = state
        if len(scanned) > rounds:
            break
        sums += np.array([got[i] for i in range(sums.size)], np.int64).reshape(sums.shape)
        n = sums[:, :, -1:]
        new = np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), books)
        moves, books = Moves(books, new), new
    return _with_error(rows, books) if seeds else rows.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("bigint").alias("error")), books, scanned


def _with_error(rows: DataFrame, books: np.ndarray) -> DataFrame:
    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = np.asarray(b.column(2).flatten()).astype(np.int64).reshape(-1, PARTS, books.shape[2])
            a = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, PARTS)
            error = ((q - books[np.arange(PARTS), a]) ** 2).sum((1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(error, pa.int64())], names=schema.names)

    return rows.select("id", "label", "q", "code").mapInArrow(run, schema)


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_text(code: Column) -> Column:
    return F.lower(F.hex(code))


def query(vectors: DataFrame) -> DataFrame:
    coded, books, _ = encode(vectors.select("vec_id", "embedding", "label"))
    coded = materialised(coded, "codes")
    of_label = few_or_not(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    out = coded.join(of_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias("vec_id"), code_text(F.col("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
