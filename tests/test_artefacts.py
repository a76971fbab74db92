"""Models that are trained, saved, loaded and dispatched."""

from __future__ import annotations

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import artefacts, metrics
from tidewatch.operators.artefacts import Artefact, Manifest
from tidewatch.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    made = []
    for i in range(240):
        y = int(rng.random() < 0.4)
        made.append((i, y, y * 1.5 + rng.gauss(0, 1), rng.gauss(0, 3), 7.0))
    return spark.createDataFrame(made, "page_id bigint, label int, a double, b double, c double").cache()


def newton(x, y, ridge):
    """Logistic regression by Newton steps: mean log loss and half the ridge times the squares of the scaled weights; the intercept is free."""
    spread = x.std(0, ddof=1)
    z = np.c_[np.ones(len(x)), (x - x.mean(0)) / np.where(spread > 0, spread, 1)]
    w, penalty = np.zeros(z.shape[1]), np.r_[0, np.full(x.shape[1], ridge)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z / len(x) + np.diag(penalty + 1e-12), z.T @ (p - y) / len(x) + penalty * w)
    return 1 / (1 + np.exp(-z @ w))


def test_chosen_by_validation_f1_and_as_newton_fits(spark, rows):
    features = ["a", "b", "c"]
    got = artefacts.trained(rows, features, grid={"regParam": [100.0, 1e-3]})
    tried = {t["params"]["regParam"]: t["f1"] for t in got.manifest.validation["tried"]}
    assert got.manifest.params == {"regParam": 1e-3} and tried[1e-3] > tried[100.0] and got.manifest.validation["f1"] == tried[1e-3]
    data = rows.withColumn("k", artefacts.fold(F.col("page_id"))).orderBy("page_id").collect()
    x, y, k = np.array([[r.a, r.b, r.c] for r in data]), np.array([r.label for r in data]), np.array([r.k for r in data])
    assert sorted(set(k)) == [0, 1, 2]
    p = {r.page_id: r.p for r in artefacts.score(got, rows).collect()}
    assert np.abs(np.array([p[r.page_id] for r in data]) - newton(x, y, 1e-3)).max() < 2e-3
    assert 0 < got.manifest.threshold < 1


def test_fits_run_together_and_say_what_they_say_one_by_one(spark, rows, monkeypatch):
    import threading

    met, plain = threading.Barrier(2), artefacts._pipeline
    grid = {"maxDepth": [2, 4]}

    class Waiting:
        def __init__(self, *given):
            self.given = given

        def fit(self, data):
            met.wait(60)
            return plain(*self.given).fit(data)

    said = []
    for fits in (1, 4):
        monkeypatch.setattr(artefacts, "FITS", fits)
        made = artefacts.trained(rows, ["a", "b"], "forest", grid=grid, folds=2)
        said.append((made.manifest, {r.page_id: r.p for r in artefacts.score(made, rows).collect()}))
    assert said[0] == said[1]
    seen = []
    monkeypatch.setattr(artefacts, "_pipeline", lambda *given: seen.append(given) or (Waiting if len(seen) <= 4 else plain)(*given))
    assert artefacts.trained(rows, ["a", "b"], "forest", grid=grid, folds=2).manifest == said[0][0]


@pytest.mark.parametrize("kind", artefacts.KINDS)
def test_saved_and_loaded_models_say_the_same(spark, rows, tmp_path, kind):
    path = str(tmp_path / kind)
    made = artefacts.trained(rows, ["a", "b"], kind, grid={}, folds=2)
    said = lambda a: {r.page_id: (r.p, r.predicted) for r in artefacts.score(a, rows).collect()}
    for _ in range(2):
        artefacts.save(made, path)
    again = artefacts.load(spark, path)
    assert said(again) == said(made) and again.manifest == made.manifest and len(os.listdir(path)) == len({f for f in os.listdir(path) if "manifest" in f}) + 1
    got = artefacts.score(again, rows.withColumn("a", F.when(F.col("page_id") > 0, F.col("a"))).withColumn("p_own", F.lit(1)))
    assert got.columns == [*rows.columns, "p_own", "p", "predicted"]
    null = got.where("page_id = 0").first()
    assert null.p is None and null.predicted is None and null.a is None
    with pytest.raises(ValueError, match="missing features: b"):
        artefacts.score(again, rows.drop("b"))


def test_what_is_no_artefact_raises(spark, rows, tmp_path):
    path = str(tmp_path / "m")
    assert artefacts.load(spark, path, required=False) is None
    with pytest.raises(FileNotFoundError):
        artefacts.load(spark, path)
    with pytest.raises(ValueError, match="unsupported kind"):
        artefacts.trained(rows, ["a"], "oracle")
    made = artefacts.trained(rows, ["a"], grid={})
    artefacts.save(Artefact(made.model, Manifest("logistic", ["a"], version=99)), path)
    with pytest.raises(ValueError, match="version of an artefact: 99"):
        artefacts.load(spark, path)
    artefacts.save(Artefact(made.model, Manifest("oracle", ["a"])), path)
    with pytest.raises(ValueError, match="unsupported kind of model: oracle"):
        artefacts.load(spark, path)
    manifest = f"{path}/manifest.json"
    assert json.load(open(manifest))["kind"] == "oracle"
    os.remove(manifest)  # a save that died before its last step
    assert artefacts.load(spark, path, required=False) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_logistic_scores_of_the_tables_are_newtons(spark):
    from tidewatch.functions import html, url
    from tidewatch.plans import url_queries

    names = [*url.URL_FEATURES, *html.HTML_FEATURES]
    f = url_queries.featured(spark, SF).select("page_id", "label", *names).orderBy("page_id").collect()
    x, y = np.array([[float(r[n]) for n in names] for r in f]), np.array([r.label for r in f])
    p = newton(x, y, 1e-3)
    got = {r.page_id: r.predicted for r in registry.queries()["logistic_scores"](spark, SF).collect()}
    sure = [i for i in range(len(f)) if abs(p[i] - 0.5) > 0.03]
    assert len(sure) > 0.8 * len(f) and all(got[f[i].page_id] == int(p[i] > 0.5) for i in sure)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_every_page_is_scored_by_every_artefact(spark):
    got = registry.queries()["artefact_scores"](spark, SF).cache()
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert got.groupBy("model").count().where(F.col("count") != pages).count() == 0 and got.select("model").distinct().count() == 2
    assert got.where("p is null or p < 0 or p > 1").count() == 0
    f1 = {r.model: r.f1 for r in metrics.with_rates(metrics.confusion(got, ["model"], F.col("threshold"))).collect()}
    assert min(f1.values()) > 0.45
