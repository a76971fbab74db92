"""Trained models as artefacts: fitted and chosen by cross-validation, saved with a manifest, loaded and dispatched by it.

An artefact is a folder with a Spark ML pipeline and ``manifest.json``, which is written last: its features, decision threshold, kind, version and what it
scored. A folder without a manifest isn't an artefact, so a save that died is never loaded.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import calibration, metrics

VERSION = 1
FOLDS = 3
#: Fits that run at the same time. Each is a chain of short jobs that wait for one another, so a few fill the cores; each holds its own rows meanwhile.
FITS = 4
_IO = {"labelCol": "_y", "featuresCol": "_x", "predictionCol": "_class"}
#: What an artefact's kind stands for: the estimator over scaled features, and the parameters that cross-validation tries.
KINDS: dict[str, tuple[Callable, dict[str, list]]] = {
    "logistic": (lambda **kw: LogisticRegression(**_IO, maxIter=50, **kw), {"regParam": [1e-3, 1e-1]}),
    "forest": (lambda **kw: RandomForestClassifier(**_IO, seed=42, numTrees=20, **kw), {"maxDepth": [4, 8]}),
    "boosted": (lambda **kw: GBTClassifier(**_IO, seed=42, maxIter=10, **kw), {"maxDepth": [3, 5]}),
}


@dataclass
class Manifest:
    kind: str
    features: list[str]
    threshold: float = 0.5
    version: int = VERSION
    params: dict = field(default_factory=dict)
    validation: dict = field(default_factory=dict)


@dataclass
class Artefact:
    model: PipelineModel
    manifest: Manifest


def _pipeline(kind: str, features: list[str], params: dict) -> Pipeline:
    if kind not in KINDS:
        raise ValueError(f"unsupported kind of model: {kind}")
    classifier = KINDS[kind][0](**params).setProbabilityCol("_probability").setRawPredictionCol("_raw_class")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), StandardScaler(inputCol="_features", outputCol="_x", withMean=True), classifier])


def _scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    hidden = ("_features", "_x", "_raw_class", "_probability", "_class")
    return model.transform(rows).withColumn("p", vector_to_array("_probability")[1]).drop(*hidden)


def fold(key: Column, folds: int = FOLDS, seed: int = 42) -> Column:
    """The same fold of a key in every run."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def trained(rows: DataFrame, features: list[str], kind: str = "logistic", label: str = "label", key: str = "page_id", grid: dict[str, list] | None = None, folds: int = FOLDS, seed: int = 42) -> Artefact:
    """ML8, ML10: the parameters of the best mean validation F1 (ties: the first), the threshold that is best on all validation rows, and a model of all rows.

    Fits and scores are distributed, ``FITS`` at a time; folds are cut by the key's hash, so copies of a key stay together. What reaches the driver is a
    row of counts for each set of parameters and fold. Rows with a null label or feature aren't learned from.
    """
    grid = KINDS[kind][1] if kind in KINDS and grid is None else grid or {}
    sets = [dict(zip(grid, v, strict=True)) for v in product(*grid.values())]
    data = rows.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_y"), *(F.col(f).cast("double").alias(f) for f in features)).dropna().withColumn("_fold", fold(F.col("_key"), folds, seed)).persist()
    try:
        data.count()  # kept before fits that run together ask for it

        def fitted(params: dict, k: int) -> PipelineModel:
            return _pipeline(kind, features, params).fit(data.where(F.col("_fold") != k))

        def judged(params: dict, models: list[PipelineModel]) -> tuple[float, dict, DataFrame]:
            parts = [_scored(m, data.where(F.col("_fold") == k)).select("_fold", F.col("_y").cast("int").alias("true_label"), "p") for k, m in enumerate(models)]
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            f1 = [r.f1 for r in metrics.with_rates(metrics.confusion(every, ["_fold"])).select("f1").collect()]
            return sum(f1) / max(len(f1), 1), params, every

        with ThreadPoolExecutor(FITS) as pool:
            run = lambda f, *given: pool.submit(inheritable_thread_target(rows.sparkSession)(f), *given)
            fits = [[run(fitted, params, k) for k in range(folds)] for params in sets]
            validated = [x.result() for x in [run(judged, params, [m.result() for m in models]) for params, models in zip(sets, fits, strict=True)]]
        best = max(range(len(sets)), key=lambda i: (validated[i][0], -i))
        f1, params, every = validated[best]
        chosen = calibration.calibrate(every.withColumn("model", F.lit(kind)), ["model"]).select("threshold").first()
        model = _pipeline(kind, features, params).fit(data)
        tried = [{"params": p, "f1": round(x, 9)} for x, p, _ in validated]
        return Artefact(model, Manifest(kind, list(features), float(chosen.threshold) if chosen else 0.5, VERSION, params, {"f1": round(f1, 9), "tried": tried, "folds": folds, "seed": seed}))
    finally:
        data.unpersist()


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def save(artefact: Artefact, path: str) -> None:
    """SRC22: a new model folder, then the manifest that names it, put in place by a rename; an artefact that is there stays whole until then."""
    spark = SparkSession.active()
    name = f"model-{uuid.uuid4().hex}"
    artefact.model.write().save(f"{path}/{name}")
    at, system = _path(spark, f"{path}/manifest.json")
    new = _path(spark, f"{path}/.manifest.{uuid.uuid4().hex}")[0]
    out = system.create(new)
    out.write(bytearray(json.dumps(asdict(artefact.manifest) | {"model": name}, indent=2).encode()))
    out.close()
    before = json.loads(spark.read.text(at.toString(), wholetext=True).first()[0])["model"] if system.exists(at) else None
    if before:
        system.delete(at, False)
    if not system.rename(new, at):
        raise OSError(f"can't put {path}/manifest.json in place")
    if before:
        system.delete(_path(spark, f"{path}/{before}")[0], True)


def load(spark: SparkSession, path: str, required: bool = True) -> Artefact | None:
    """The artefact of a folder; another version or an unknown kind raises. A missing one raises, or is None if it isn't ``required``."""
    at, system = _path(spark, f"{path}/manifest.json")
    if not system.exists(at):
        if required:
            raise FileNotFoundError(f"no artefact in {path}")
        return None
    told = json.loads(spark.read.text(at.toString(), wholetext=True).first()[0])
    if told.get("version") != VERSION:
        raise ValueError(f"unsupported version of an artefact: {told.get('version')}")
    if told.get("kind") not in KINDS:
        raise ValueError(f"unsupported kind of model: {told.get('kind')}")
    name = told.pop("model")
    return Artefact(PipelineModel.load(f"{path}/{name}"), Manifest(**told))


def score(artefact: Artefact, rows: DataFrame) -> DataFrame:
    """``rows`` with ``p`` and ``predicted``, by the artefact's own threshold. Missing features raise by name; a null feature gives a null score."""
    if missing := sorted(set(artefact.manifest.features) - set(rows.columns)):
        raise ValueError(f"missing features: {', '.join(missing)}")
    names = artefact.manifest.features
    marked = rows.withColumn("_whole", F.struct(*(F.col(f).cast("double").alias(f) for f in names)))
    usable = F.forall(F.array(*(F.col("_whole")[f] for f in names)), lambda x: x.isNotNull())
    filled = marked.select(*(F.col(c) for c in rows.columns if c not in names), F.struct(*names).alias("_given"), usable.alias("_usable"), *(F.coalesce(F.col("_whole")[f], F.lit(0.0)).alias(f) for f in names))
    out = _scored(artefact.model, filled).withColumn("p", F.when(F.col("_usable"), F.col("p")))
    given = [F.col(c) if c not in names else F.col("_given")[c].alias(c) for c in rows.columns]
    return out.select(*given, "p", F.when(F.col("p").isNotNull(), (F.col("p") >= artefact.manifest.threshold).cast("int")).alias("predicted"))


def score_all(artefacts: dict[str, Artefact], rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, true_label, model, p, threshold) of every row by every artefact: one pass over ``rows`` for each."""
    out = None
    for name, a in artefacts.items():
        one = score(a, rows).select(key, F.col(label).alias("true_label"), F.lit(name).alias("model"), "p", F.lit(a.manifest.threshold).alias("threshold"))
        out = one if out is None else out.unionByName(one)
    return out
