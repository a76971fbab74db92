"""Confusion metrics, ROC, reports and comparisons over predictions (model, true_label, p, threshold)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def predicted(threshold: Column | float = 0.5) -> Column:
    """PF8: inclusive."""
    return F.when(F.col("p") >= threshold, 1).otherwise(0)


def confusion(rows: DataFrame, keys: list[str], threshold: Column | float = 0.5) -> DataFrame:
    """tn, fp, fn, tp of each group: one pass, combined before the shuffle."""
    y, h = F.col("true_label"), predicted(threshold)
    cells = {"tn": (y == 0) & (h == 0), "fp": (y == 0) & (h == 1), "fn": (y == 1) & (h == 0), "tp": (y == 1) & (h == 1)}
    return rows.groupBy(*keys).agg(*(F.count_if(c).alias(k) for k, c in cells.items()))


def rates() -> dict[str, Column]:
    """AG1 from the four cells."""
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "accuracy": ratio(tp + tn, tn + fp + fn + tp), "precision": precision, "recall": recall, "specificity": ratio(tn, tn + fp),
        "f1": ratio(2 * precision * recall, precision + recall), "false_positive_rate": ratio(fp, fp + tn), "false_negative_rate": ratio(fn, fn + tp),
    }


def with_rates(cells: DataFrame) -> DataFrame:
    return cells.withColumns(rates())


def roc_auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mid-rank AUC; null where only one class is there. Equal scores are combined before they're ranked."""
    at = rows.groupBy(*keys, "p").agg(F.count_if(F.col("true_label") == 1).alias("pos"), F.count("*").alias("n"))
    below = F.col("upto") - F.col("n")
    ranked = running(at, keys, [F.col("p")], {"upto": F.col("n")}).withColumn("mid", below + (F.col("n") + 1) / F.lit(2.0))
    out = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("mid")).alias("ranks"), F.sum("pos").alias("np"), F.sum(F.col("n") - F.col("pos")).alias("nn"))
    return out.select(*keys, F.try_divide(F.col("ranks") - F.col("np") * (F.col("np") + 1) / F.lit(2.0), (F.col("np") * F.col("nn")).cast("double")).alias("roc_auc"))


def roc_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(threshold, fpr, tpr), one point for each different score."""
    at = rows.groupBy(*keys, F.col("p").alias("threshold")).agg(F.count_if(F.col("true_label") == 1).alias("pos"), F.count_if(F.col("true_label") == 0).alias("neg"))
    up = running(at, keys, [F.desc("threshold")], {"fp": F.col("neg"), "tp": F.col("pos")})
    every = at.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.sum("neg").alias("n0"), F.sum("pos").alias("n1"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return up.join(every, same).select(*keys, "threshold", ratio(F.col("fp"), F.col("n0")).alias("fpr"), ratio(F.col("tp"), F.col("n1")).alias("tpr"))


def classification_report(cells: DataFrame, keys: list[str], names: tuple[str, str] = ("legitimate", "phishing"), accuracy: bool = False) -> DataFrame:
    """AG3: rows by class, macro and weighted averages, and accuracy if asked for."""
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))

    def f1(p, r):
        return ratio(2 * p * r, p + r)

    p0, r0, p1, r1 = ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(tp, tp + fp), ratio(tp, tp + fn)
    n0, n1 = tn + fp, fn + tp
    n = n0 + n1
    mean = lambda a, b: (a + b) / F.lit(2.0)
    weighted = lambda a, b: ratio(a * n0 + b * n1, n)
    row = lambda k, p, r, f, s: F.struct(F.lit(k).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"), s.cast("bigint").alias("support"))
    rows = [row(names[0], p0, r0, f1(p0, r0), n0), row(names[1], p1, r1, f1(p1, r1), n1), row("macro avg", mean(p0, p1), mean(r0, r1), mean(f1(p0, r0), f1(p1, r1)), n), row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f1(p0, r0), f1(p1, r1)), n)]
    if accuracy:
        rows.append(row("accuracy", ratio(tn + tp, n), ratio(tn + tp, n), ratio(tn + tp, n), n))
    return cells.select(*keys, F.inline(F.array(*rows)))


def from_matrix(rows: DataFrame, keys: list[str], text: str = "confusion_matrix") -> DataFrame:
    """AG4: the four cells from a matrix written as text."""
    m = F.from_json(text, "array<array<bigint>>")
    return rows.select(*keys, *(m[i][j].alias(k) for k, i, j in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))))


def upsert(old: DataFrame, new: DataFrame, key: str = "model", ord_col: str = "ord") -> DataFrame:
    """SNK7: rows of ``new`` replace those of their key and go to the end."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    top = old.agg(F.coalesce(F.max(ord_col), F.lit(0)).alias("_top"))
    later = new.crossJoin(F.broadcast(top)).withColumn(ord_col, F.col("_top") + F.col(ord_col)).drop("_top")
    return kept.unionByName(later)


def early_stopping(epochs: DataFrame, patience: int = 3, training: str | None = None) -> DataFrame:
    """(epoch, val_f1) with the best so far, epochs since it, and whether training ends there.

    ``training`` names the column that tells logs apart; without it all rows are the epochs of one training.
    """
    key = [training] if training else []
    w = Window.partitionBy(*(key or [F.lit(1)])).orderBy("epoch")
    best = F.coalesce(F.max("val_f1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1.0))
    better = epochs.withColumn("improved", (F.col("val_f1") > best).cast("int"))
    marked = better.withColumn("island", F.sum("improved").over(w))
    waited = F.row_number().over(Window.partitionBy(*key, "island").orderBy("epoch")) - F.when(F.col("island") > 0, 1).otherwise(0)
    out = marked.withColumn("waited", waited).withColumn("_stops", (F.col("waited") >= patience).cast("int"))
    before = F.coalesce(F.sum("_stops").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn("_before", before).where("_before = 0").select(*key, "epoch", "val_f1", "improved", "waited", F.col("_stops").alias("stops"))
