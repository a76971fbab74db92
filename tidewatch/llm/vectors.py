"""Embedding near-duplicates by an inverted multi-index.

Independent codebooks for the two halves of the vectors form a product grid of cells. Each vector lives in its nearest
cell and visits other cells in the order of the sum of its halves' distances (a multi-sequence traversal) until the target
recall; what it meets there is verified by the full cosine in double precision. The number of visits is calibrated so that
``RECALL`` of the partners are met from either side, separately for partners planted at the threshold itself, the hardest
ones, in each of several directions (any, one for all, single axes, principal axes, towards other vectors), and for real pairs near the threshold, found
by comparing all of a bounded sample; the greatest number is taken.

Only vectors of equal, non-null label and equal length are compared; the grid is of the commonest length, and vectors of
each other length are compared all with all, in blocks. Codebooks are fitted on at most ``SAMPLE`` vectors chosen by hash
and are all that is broadcast. Equal vectors of a label are one class with a weight: copies are never expanded. A cell
of more than ``BLOCK`` classes is dealt to several tasks by a hash, each of which gets the cell's visitors. A cell gives
each vector's count of links and a star of links for each group, never its pairs.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and those of null label link
with nothing and are kept; ties in the traversal go to the first cell; rows that are wholly equal count once; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialised

THRESHOLD, RECALL = 0.93, 0.99
#: Vectors of the fitting sample; classes of a cell in one task; classes aimed at in a cell; codewords of a half at most.
SAMPLE, BLOCK, CELL, CODEWORDS = 20_000, 2_048, 32, 1_024
#: Vectors of the sample whose partners are planted, and that are compared for real pairs.
PLANTED, COMPARED = 500, 4_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmin(distances(x, centres), axis=1)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None], 0)


class Grid:
    """Two codebooks, and how many cells a vector visits."""

    def __init__(self, sample: np.ndarray, per_label: float, threshold: float, recall: float):
        self.half = sample.shape[1] // 2
        k = int(np.clip(round(np.sqrt(per_label / CELL)), 1, CODEWORDS))
        # visits are calibrated on vectors that the codebooks haven't seen: theirs lie nearer to their codewords
        unseen = min(COMPARED, len(sample) // 2)
        fitted = sample[unseen:]
        self.books = [kmeans(fitted[:, : self.half], k), kmeans(fitted[:, self.half :], k, seed=6)]
        self.visits = 1
        few = sample[: min(PLANTED, unseen) or 1]
        pairs = [(few, y) for y in self.planted(few, threshold)] + list(self.real(sample[:unseen], threshold))
        self.visits = max(self.calibrate(x, y, recall) for x, y in pairs)

    def cells(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The nearest cells of each vector, in the order of the traversal; the first is its home."""
        d = [distances(part, book) for part, book in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True)]
        n = min(visits or self.visits, len(self.books[0]) * len(self.books[1]))
        order = [np.argsort(a, axis=1, kind="stable") for a in d]
        d = [np.take_along_axis(a, o, axis=1) for a, o in zip(d, order, strict=True)]
        # of the n best sums of two sorted sequences, the pair at ranks (i, j) has (i + 1)(j + 1) <= n
        ranks = np.array([(i, j) for i in range(min(n, d[0].shape[1])) for j in range(min(n // (i + 1), d[1].shape[1]))])
        sums = d[0][:, ranks[:, 0]] + d[1][:, ranks[:, 1]]
        best = np.argsort(sums, axis=1, kind="stable")[:, :n]
        i, j = (np.take_along_axis(o, ranks[best, k], axis=1) for k, o in enumerate(order))
        return i * len(self.books[1]) + j

    @staticmethod
    def planted(x: np.ndarray, threshold: float, seed: int = 9) -> Iterator[np.ndarray]:
        """Partners of the rows at the threshold, by the direction in which they lie."""
        rng = np.random.default_rng(seed)
        n, d = x.shape
        principal = np.linalg.svd(x - x.mean(0), full_matrices=False)[2]
        signs = rng.choice([-1.0, 1.0], (n, 1))
        for noise in (
            rng.normal(size=x.shape),
            np.tile(rng.normal(size=d), (n, 1)),
            signs * np.eye(d)[rng.integers(0, d, n)],
            signs * principal[rng.integers(0, min(4, len(principal)), n)],
            x[rng.permutation(n)],
        ):
            noise = noise - (noise * x).sum(1)[:, None] * x
            size = np.linalg.norm(noise, axis=1)[:, None]
            noise = np.where(size > 1e-9, noise / np.maximum(size, 1e-9), 0.0)
            y = threshold * x + np.sqrt(1 - threshold**2) * noise
            yield y / np.linalg.norm(y, axis=1)[:, None]

    @staticmethod
    def real(x: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of a sample that are no more alike than halfway from the threshold to 1, one partner a row, if there are any."""
        near = x @ x.T
        near[near > (1 + threshold) / 2] = 0.0
        np.fill_diagonal(near, 0.0)
        best = near.argmax(1)
        rows = np.flatnonzero(near[np.arange(len(x)), best] >= threshold)[:PLANTED]
        if len(rows) >= 20:
            yield x[rows], x[best[rows]]

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> int:
        """Visits at which so many of the pairs are met by one side or the other."""
        every, n = len(self.books[0]) * len(self.books[1]), 1
        homes = self.cells(x, 1), self.cells(y, 1)
        while n < every:
            a, b = self.cells(x, n), self.cells(y, n)
            if ((a == homes[1]).any(1) | (b == homes[0]).any(1)).mean() >= recall:
                return n
            n = min(n + max(1, n // 4), every)
        return every


def prepared(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, key, vector): unit vectors as bytes of doubles and a digest of them; both null if nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for b in batches:
            keys, vectors = [], []
            for v, label in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True):
                ok = bool(v) and label is not None and None not in v
                x = np.array(v if ok else [0.0], float)
                big = np.abs(x).max()
                ok = ok and np.isfinite(big) and big > 0
                if ok:
                    x = x / big
                    x = x / np.linalg.norm(x) + 0.0
                keys.append(blake2b(x.tobytes(), digest_size=16).hexdigest() if ok else None)
                vectors.append(x.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.string()), pa.array(vectors, pa.binary())], names=["id", "label", "key", "vector"])

    narrow = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return narrow.mapInArrow(run, "id bigint, label bigint, key string, vector binary").dropDuplicates(["id", "label", "key"])


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row for each vector."""
    spark = rows.sparkSession
    rows = materialised(prepared(rows, id_col, vector_col, label_col), "vectors")
    classes = rows.where("key is not null").groupBy("label", "key").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = materialised(classes, "vector-classes")
    n = classes.count()
    result = lambda x: x.select(F.col("id").alias(id_col), F.col("n_links").cast("bigint").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    if not n:
        return result(rows.withColumn("n_links", F.lit(0)).withColumn("component_id", F.col("id")))
    share = min(1.0, SAMPLE / n)
    few = classes.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1_000_000)) <= int(share * 1_000_000)).select("vector").collect()
    few = few or classes.select("vector").limit(1).collect()
    size = int(np.bincount([len(r.vector) for r in few]).argmax())
    sample = np.stack([np.frombuffer(r.vector) for r in few if len(r.vector) == size])
    if sample.shape[1] == 1:
        sample = np.concatenate([sample, np.zeros_like(sample)], axis=1)
    # the vectors of a label, on average over the vectors: a large label isn't crowded because there are small ones
    per_label = classes.groupBy("label").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") ** 2) / F.sum("n")).first()[0]
    grid = spark.sparkContext.broadcast(Grid(sample, per_label, threshold, recall))

    def unit(vectors: list[bytes]) -> np.ndarray:
        x = np.stack([np.frombuffer(v) for v in vectors])
        return x if x.shape[1] > 1 else np.concatenate([x, np.zeros_like(x)], axis=1)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grid.value.cells(unit(part.column(1).to_pylist()), 1)[:, 0])], names=["label", "cell"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                cells = grid.value.cells(unit(part.column(3).to_pylist()))
                k = cells.shape[1]
                take = pa.array(np.repeat(np.arange(part.num_rows), k))
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns), pa.array(cells.reshape(-1)), pa.array(np.tile(np.arange(k) == 0, part.num_rows))], names=[*part.schema.names, "cell", "home"])

    shape = "label bigint, rep bigint, weight bigint, vector binary, cell bigint, home boolean"
    usual = F.octet_length("vector") == size
    own_length = -F.octet_length("vector").cast("bigint")  # one cell for each other length
    of_grid = classes.where(usual).select("label", "rep", "weight", "vector")
    others = classes.where(~usual).select("label", "rep", "weight", "vector", own_length.alias("cell"), F.lit(True).alias("home"))
    wide = of_grid.mapInArrow(visit, shape).unionByName(others)
    homes = of_grid.select("label", "vector").mapInArrow(at_home, "label bigint, cell bigint").unionByName(others.select("label", "cell"))
    crowded = homes.groupBy("label", "cell").count().where(F.col("count") > BLOCK).select("label", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    # a resident of one block of its cell; a visitor, its own home included, of every block
    dealt = wide.join(crowded, ["label", "cell"], "left").withColumn("x", F.explode(F.concat(F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(i.cast("int").alias("block"), F.lit(1).alias("role"))), F.when(F.col("home"), F.array(F.struct(mine.alias("block"), F.lit(0).alias("role")))).otherwise(F.array().cast("array<struct<block:int,role:int>>")))))
    dealt = dealt.select("label", "cell", "x.block", "x.role", "rep", "weight", "vector").repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", "role", "rep")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, residents, held = None, None, []

        def out(kind, a, v):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(v, np.int64))], names=["kind", "a", "v"])

        def begin():
            reps, weights = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            x = np.concatenate([h[2] for h in held])
            seen = grid.value.cells(x) if group[1] >= 0 else np.full((len(x), 1), group[1])
            return {"reps": reps, "w": weights, "x": x, "seen": seen, "root": np.arange(len(reps))}

        def meet(r, cell, reps, weights, x):
            homes = grid.value.cells(x, 1)[:, 0] if cell >= 0 else np.full(len(x), cell)
            for at in range(0, len(reps), 256):
                part = slice(at, at + 256)
                near = x[part] @ r["x"].T >= threshold
                near &= reps[part, None] != r["reps"][None, :]
                rows_ = np.flatnonzero(near.any(1))
                if not len(rows_):
                    continue
                near = near[rows_]
                ids, home = reps[part][rows_], homes[part][rows_]
                yield out(0, ids, near.astype(np.int64) @ r["w"])
                # a resident that doesn't visit the visitor's home won't meet it there: it counts the link here
                back = near & ~np.stack([(r["seen"] == h).any(1) for h in home])
                if (to := back.any(0)).any():
                    yield out(0, r["reps"][to], weights[part][rows_] @ back[:, to].astype(np.int64))
                a, b = [], []
                root = r["root"]
                for i, own in enumerate(ids.tolist()):
                    at_ = np.flatnonzero(near[i])
                    tops = np.unique(root[at_])
                    low = tops[0]
                    if len(tops) > 1:
                        root[np.isin(root, tops[1:])] = low
                        a += r["reps"][tops[1:]].tolist()
                        b += [r["reps"][low]] * (len(tops) - 1)
                    if own != r["reps"][low]:
                        a.append(own)
                        b.append(int(r["reps"][low]))
                if a:
                    yield out(1, a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)], axis=1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)]
            reps, weights, vectors = np.asarray(batch.column(4)), np.asarray(batch.column(5)), batch.column(6).to_pylist()
            for a, z in zip(cuts, cuts[1:], strict=False):
                *now, role = keys[a].tolist()
                if now != group:
                    group, residents, held = now, None, []
                if role == 0:
                    held.append((reps[a:z], weights[a:z], unit(vectors[a:z])))
                elif held:
                    residents = residents or begin()
                    yield from meet(residents, group[1], reps[a:z], weights[a:z], unit(vectors[a:z]))

    met = materialised(dealt.mapInArrow(verify, "kind int, a bigint, v bigint"), "met")
    counts = met.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("v").alias("met"))
    parts = connected_components(met.where("kind = 1").select("a", F.col("v").alias("b"))).withColumnRenamed("node", "rep")
    named = classes.select("label", "key", "rep", "weight").join(counts, "rep", "left").join(parts, "rep", "left")
    named = named.select("label", "key", (F.coalesce("met", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where("key is not null").join(named, ["label", "key"]).select("id", "n_links", "component_id")
    alone = rows.where("key is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return result(linked.unionByName(alone))


def query(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)
