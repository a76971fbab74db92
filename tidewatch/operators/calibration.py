"""Threshold calibration in one pass: scores fall into buckets of the grid, and sums from above give every threshold's cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import rates


def grid(step: float = 0.01) -> list[float]:
    """Thresholds from 0.01, rounded to 6 places, that end with 0.99 even where it came before."""
    if not 0 < step <= 0.5:
        raise ValueError("the step must be over 0 and at most 0.5")
    out, t = [], 0.01
    while t < 1.0:
        out.append(round(t, 6))
        t += step
    return out if out[-1] == 0.99 else [*out, 0.99]


def curve(rows: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Cells and rates at every threshold of every group.

    A score's bucket is the last threshold that it reaches, found by exact comparisons; there are as many rows as
    groups times thresholds, however many predictions.
    """
    points = sorted(set(thresholds))
    bucket = F.size(F.filter(F.array(*(F.lit(t) for t in points)), lambda t: t <= F.col("p")))
    hist = rows.groupBy(*keys, bucket.alias("bucket")).agg(F.count_if(F.col("true_label") == 1).alias("pos"), F.count_if(F.col("true_label") == 0).alias("neg"))
    every = hist.select(*keys).distinct().select(*keys, F.posexplode(F.array(F.lit(0.0), *(F.lit(t) for t in points))).alias("bucket", "threshold"))
    full = every.join(hist, [*keys, "bucket"], "left").na.fill(0, ["pos", "neg"])
    w = Window.partitionBy(*keys)
    above = w.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    cells = full.select(*keys, "bucket", "threshold", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(w).alias("_p"), F.sum("neg").over(w).alias("_n")).where("bucket > 0")
    return cells.select(*keys, "threshold", (F.col("_n") - F.col("fp")).alias("tn"), "fp", (F.col("_p") - F.col("tp")).alias("fn"), "tp").withColumns(rates())


OBJECTIVES = {"f1": F.col, "accuracy": F.col, "balanced_accuracy": lambda _: (F.col("recall") + F.col("specificity")) / F.lit(2.0)}


def calibrate(rows: DataFrame, keys: list[str], objective: str = "f1", step: float = 0.01, min_recall: float = 0.0, max_fpr: float | None = None) -> DataFrame:
    """TK5: the best threshold of each group; where none meets the constraints, the best of all, flagged."""
    points = curve(rows, keys, grid(step)).withColumn("objective", OBJECTIVES[objective](objective))
    ok = F.col("recall") >= min_recall
    if max_fpr is not None:
        ok = ok & (F.col("false_positive_rate") <= max_fpr)
    order = F.struct(ok.cast("int"), F.col("objective"), F.col("recall"), -F.col("false_positive_rate"), F.col("threshold"))
    columns = ["threshold", "objective", "accuracy", "precision", "recall", "specificity", "f1", "false_positive_rate", "false_negative_rate", "tn", "fp", "fn", "tp"]
    best = points.groupBy(*keys).agg(F.max_by(F.struct(*columns, ok.cast("int").alias("constraints_satisfied")), order).alias("b"))
    return best.select(*keys, "b.*")
