"""What the training-data operators share: the shared folder, column appending in Arrow batches, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own and a cluster a folder of the warehouse.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if sc.master.startswith("local[") or sc.master == "local":
            base = getattr(sc, "_tidewatch_shared", None)
            if not base:
                base = sc._tidewatch_shared = tempfile.mkdtemp(prefix="tidewatch-")
                atexit.register(shutil.rmtree, base, ignore_errors=True)
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage is cut in the shared folder, so a lost executor costs no more than the tasks it ran."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint and prunable by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """The files of a table that ``materialised`` wrote and nothing reads any more go."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers that may be broadcast: some 30 MB.
BROADCAST_ROWS = 1_000_000


def few_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast only if it is counted and found to have at most so many narrow rows."""
    df = materialised(df, "few")
    return F.broadcast(df) if df.count() <= rows else df


def short_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts are long: Arrow batches of the session take at most so many rows, which bounds what a worker holds at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def release() -> None:
    """What a worker has freed goes back to the system: an idle worker is kept for the next task, and so is what it holds."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def append(df: DataFrame, text_col: str, fields: list[tuple[str, str]], start: Callable[[], Callable]) -> DataFrame:
    """``df`` with further columns that a Python function makes of each whole text, in Arrow batches.

    ``start()`` runs once a task and returns a function from a list of texts (or None) to one list for each field.
    The fields' names must not clash with columns of ``df``.
    """
    if clash := {c.lower() for c in df.columns} & {n.lower() for n, _ in fields}:
        raise ValueError(f"columns of these names exist already: {sorted(clash)}")
    short_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(k), True) for n, k in fields)])
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[k] for _, k in fields]
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for b in batches:
            made = make(b.column(at).to_pylist())
            columns = [*b.columns, *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, *(n for n, _ in fields)])
        make = made = columns = None
        release()

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint); component is the smallest node reachable.

    Alternating large-star and small-star steps: every step is a grouped minimum, combined before the shuffle, and an
    equi-join whose hot nodes the adaptive planner can split, so a star of any size is never gathered in one task.
    An empty ``edges`` gives an empty result.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        if large:
            return both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        near = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return near.union(low.where("a <> m").select("a", F.col("m").alias("b"))).distinct()

    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = state(e)
    while was[0]:
        e = checkpointed(star(star(e, True), False))
        now = state(e)
        if now == was:
            break
        was = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
