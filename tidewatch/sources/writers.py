"""Sinks: CSV and JSON files, sample directories, tables that are appended to and upserted."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def swapped(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> None:
    """SNK4: ``write(df, folder)`` into a new folder beside ``path``, which takes its place once it is whole.

    The old one is moved away, not deleted first: if the second rename fails it is moved back. ``df`` may read ``path``.
    """
    spark = df.sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    system = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    folder, _, name = path.rstrip("/").rpartition("/")
    new, old = (at(f"{folder}/.{name}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    try:
        write(df, new.toString())
        had = system.exists(at(path))
        if had and not system.rename(at(path), old):
            raise OSError(f"can't move {path} away")
        if not system.rename(new, at(path)):
            if had:
                system.rename(old, at(path))
            raise OSError(f"can't put {path} in place")
        system.delete(old, True)
    finally:
        system.delete(new, True)


def csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list | None = None, single: bool = False) -> None:
    """SNK1, SNK3, SNK4, SNK8: the chosen columns with a header; readers see the old files or the new ones."""
    out = df.select(*(columns or df.columns))
    out = out.orderBy(*order) if order else out
    swapped(out, path, lambda d, p: (d.coalesce(1) if single else d).write.options(header=True, escape='"', quote='"').csv(p))


def json_summary(df: DataFrame, path: str) -> None:
    """SNK12: one JSON object a row."""
    swapped(df.select(F.to_json(F.struct(*df.columns)).alias("value")), path, lambda d, p: d.coalesce(1).write.text(p))


def upsert(df: DataFrame, path: str, by: list[str], order: list | None = None) -> None:
    """SNK7, SNK2: rows of ``df`` replace the table's rows of the same ``by``, a folder each; other folders aren't touched.

    The rows are written down first, so ``df`` may read the table itself. A folder is swapped when its files are whole: readers see its
    old rows or its new ones, and a rerun replaces what it wrote before. ``by`` should have few values, such as a model or a day.
    """
    staged = written(df, "upsert")
    put = staged.repartition(*by)
    put = put.sortWithinPartitions(*by, *order) if order else put
    put.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    dropped(staged)


def append_seen(df: DataFrame, path: str, as_of: str, batch: str = "") -> None:
    """SNK2: (url, label, source) with the day they were added; a rerun of the same day and batch replaces its rows."""
    upsert(df.select("url", "label", "source", F.lit(as_of).alias("added_date"), F.lit(batch or "-").alias("batch")), path, ["added_date", "batch"])


def results(df: DataFrame, path: str) -> None:
    """SNK7: evaluation rows by ``model``; those of a model that is evaluated again are replaced."""
    upsert(df, path, ["model"])


def samples(df: DataFrame, root: str, replace: bool = True) -> None:
    """SNK5: a directory for each sample (sample_id, url, html, screenshot, label, ...), all of them or none; see ``sample_sink``."""
    from .sample_sink import SampleDirectory

    df.sparkSession.dataSource.register(SampleDirectory)
    df.write.format("sample_directory").mode("overwrite" if replace else "append").save(root)


def batch_summary(spark, root: str, requested: dict[str, int], accepted: dict[str, int], rejected: int, **more) -> None:
    """SNK6: dataset_summary.json of a collected batch, which SRC9 asks for: its role, and whether it's complete."""
    import json

    from .sample_sink import opened

    told = {"dataset_role": "external_test_only", "prohibited_uses": ["training", "validation", "model_selection", "threshold_tuning"], "requested": requested, "accepted": accepted, "rejected": rejected, "complete": all(accepted.get(k, 0) >= n for k, n in requested.items()), **more}
    system, base = opened(root)
    system.create_dir(base, recursive=True)
    part = f"{base}/dataset_summary.json.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(json.dumps(told, indent=2, ensure_ascii=False).encode())
    system.move(part, f"{base}/dataset_summary.json")
