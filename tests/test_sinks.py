"""Sinks that publish whole or not at all, and the gates of what reads them."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import readers, writers

SAMPLE = "sample_id string, url string, html string, screenshot binary, label int, source string, bad int"
ROWS = [("L00001_legitimate", "https://l.test/", "<a>\r\nx", b"x", 0, "feed", 1), ("P00001_phishing", "https://p.test/", "<b>", b"y", 1, "feed", 1)]


def tree(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.startswith(".") and f != "_SUCCESS")


def test_samples_appear_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "batch")
    batch = spark.createDataFrame(ROWS, SAMPLE).repartition(2)
    failing = spark.createDataFrame([*ROWS, ("P00002_phishing", "u", "h", b"z", 1, "feed", 0)], SAMPLE).repartition(3).withColumn("bad", F.when(F.col("bad") == 0, F.raise_error(F.lit("task fails")).cast("int")).otherwise(F.col("bad")))
    with pytest.raises(Exception, match="task fails"):
        writers.samples(failing, root)
    assert tree(root) == []
    for _ in range(2):
        writers.samples(batch, root)
    files = [f"{i}/{x}" for i, s in (("L00001_legitimate", "L00001"), ("P00001_phishing", "P00001")) for x in (f"Label/{s}.txt", f"RAW-HTML/{s}.html", f"SCREEN-SHOT/{s}.png", f"URL/{s}.txt", "metadata.json")]
    assert tree(root) == sorted(files) and os.listdir(f"{root}/_staging") == []
    assert open(f"{root}/L00001_legitimate/RAW-HTML/L00001.html", newline="").read() == "<a>\nx"
    assert json.load(open(f"{root}/P00001_phishing/metadata.json"))["source"] == "feed"
    more = spark.createDataFrame([("P00009_phishing", "u", "h", b"z", 1, "feed", 1), (*ROWS[0][:2], "other", *ROWS[0][3:])], SAMPLE)
    with pytest.raises(Exception, match="there already"):
        writers.samples(more, root, replace=False)
    assert tree(root) == sorted(files)
    with pytest.raises(Exception, match="same name"):
        writers.samples(batch.union(batch), root)
    with pytest.raises(Exception, match="missing columns: html"):
        writers.samples(batch.drop("html"), root)


def test_a_batch_is_read_only_through_its_gates(spark, tmp_path):
    root = str(tmp_path / "batch")
    batch = spark.createDataFrame(ROWS, SAMPLE)
    writers.samples(batch, root)
    writers.csv(batch.select("sample_id", "label", "source"), f"{root}/collection_results.csv", single=True)

    def fails(match):
        with pytest.raises(Exception, match=match):
            readers.external_batch(spark, root).collect()

    writers.batch_summary(spark, root, {"legitimate": 1, "phishing": 2}, {"legitimate": 1, "phishing": 1}, 0)
    fails("complete")
    writers.batch_summary(spark, root, {"legitimate": 1, "phishing": 1}, {"legitimate": 1, "phishing": 1}, 0, dataset_role="training")
    fails("external_test_only")
    writers.batch_summary(spark, root, {"legitimate": 1, "phishing": 1}, {"legitimate": 1, "phishing": 1}, 3, source="feed")
    got = [tuple(r) for r in readers.external_batch(spark, root).select("sample_id", "url", "html", "label", "source", "domain").collect()]
    assert got == [("L00001_legitimate", "https://l.test/", "<a>\nx", 0, "feed", ""), ("P00001_phishing", "https://p.test/", "<b>", 1, "feed", "")]
    writers.csv(spark.createDataFrame([("L00001_legitimate", 1)], "sample_id string, label int"), f"{root}/collection_results.csv", single=True)
    fails("labels disagree")
    writers.csv(batch.where("label = 0").select("sample_id", "label"), f"{root}/collection_results.csv", single=True)
    fails("balanced")
    writers.csv(batch.select("sample_id", "label"), f"{root}/collection_results.csv", single=True)
    os.remove(f"{root}/P00001_phishing/metadata.json")
    fails("files are missing of P00001")


def test_a_rerun_replaces_its_own_folder(spark, tmp_path):
    path = str(tmp_path / "results")
    row = lambda m, f1: spark.createDataFrame([(m, f1)], "model string, f1 double")
    writers.results(row("a", 0.1).union(row("b", 0.2)), path)
    before = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in tree(path) if f.startswith("model=a")}
    writers.results(row("b", 0.9), path)
    assert {(r.model, r.f1) for r in spark.read.parquet(path).collect()} == {("a", 0.1), ("b", 0.9)}
    assert {f: os.stat(f"{path}/{f}").st_mtime_ns for f in tree(path) if f.startswith("model=a")} == before
    # from the table itself
    writers.results(spark.read.parquet(path).where("model = 'a'").select("model", (F.col("f1") * 2).alias("f1")), path)
    assert {(r.model, r.f1) for r in spark.read.parquet(path).collect()} == {("a", 0.2), ("b", 0.9)}


def test_files_are_replaced_once_they_are_whole(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, x string")
    writers.csv(df, path)
    with pytest.raises(Exception, match="no more"):
        writers.csv(df.withColumn("x", F.when(F.col("i") == 2, F.raise_error(F.lit("no more"))).otherwise(F.col("x"))), path)
    read = lambda: sorted(tuple(r) for r in spark.read.options(header=True).csv(path).collect())
    assert read() == [("1", "a"), ("2", "b")]
    writers.csv(spark.read.options(header=True).csv(path).where("i = 2"), path)
    assert read() == [("2", "b")] and os.listdir(tmp_path) == ["out.csv"]


def test_missing_predictions_and_internal_metrics(spark, tmp_path):
    none = str(tmp_path / "none.csv")
    assert readers.predictions(spark, none, optional=True).count() == 0
    with pytest.raises(Exception, match="none.csv"):
        readers.predictions(spark, none).collect()
    (tmp_path / "head.csv").write_text("sample_id,model,true_label,phishing_probability,threshold\n")
    empty = readers.predictions(spark, str(tmp_path / "head.csv"), optional=True)
    assert empty.count() == 0 and empty.columns == readers.predictions(spark, none, optional=True).columns
    (tmp_path / "a.csv").write_text("model,f1,roc_auc\nm,0.5,0.7\nn,x,\n")
    (tmp_path / "b.csv").write_text("model,f1\nm,0.6\n")
    got = {r.model: (r.internal_f1, r.internal_roc_auc) for r in readers.internal_metrics(spark, [str(tmp_path / "a.csv"), none, str(tmp_path / "b.csv")]).collect()}
    assert got == {"m": (0.6, None), "n": (None, None)}
    assert readers.internal_metrics(spark, [none]).count() == 0
