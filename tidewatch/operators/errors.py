"""Error analysis of predictions (sample_id, model, source, domain, true_label, p, threshold, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import ratio

NEAR = 0.1


def four_places(p: Column) -> Column:
    """A probability with 4 places, rounded by its exact binary value, halves to even.

    The product's rounding error, found exactly by splitting the factor, decides where the product looks like a half.
    """
    x = p * 10000.0
    high = p * 134217729.0 - (p * 134217729.0 - p)
    lost = (high * 10000.0 - x) + (p - high) * 10000.0
    k = F.floor(x)
    rest = x - k
    up = (rest > 0.5) | ((rest == 0.5) & ((lost > 0) | ((lost == 0) & (k % 2 == 1))))
    n = k + up.cast("bigint")
    return F.concat(F.floor(n / 10000).cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0"))


def judged(rows: DataFrame) -> DataFrame:
    """With ``correct`` and ``near`` (the threshold)."""
    hit = (F.col("p") >= F.col("threshold")).cast("int")
    return rows.withColumn("correct", (hit == F.col("true_label")).cast("int")).withColumn("near", (F.abs(F.col("p") - F.col("threshold")) <= NEAR).cast("int"))


def top_values(rows: DataFrame, keys: list[str], value: str, k: int = 8, ord_col: str = "ord") -> DataFrame:
    """TK2: each group's most frequent values, ties by first appearance, joined: (keys, top).

    Counts are made before the window, so a group's window holds its different values, not its rows.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(ord_col).alias("first"))
    ranked = counts.withColumn("rk", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first"))).where(F.col("rk") <= k)
    return ranked.groupBy(*keys).agg(joined("rk", value).alias("top"))


def joined(order: str, value: str, sep: str = "; ") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), sep)


def model_errors(rows: DataFrame, k: int = 8) -> DataFrame:
    """AG5."""
    r = judged(rows)
    wrong = F.col("correct") == 0
    out = r.groupBy("model").agg(F.count("*").alias("samples"), F.count_if(wrong).alias("wrong"), F.count_if(wrong & (F.col("true_label") == 0)).alias("false_positives"), F.count_if(wrong & (F.col("true_label") == 1)).alias("false_negatives"), F.count_if(wrong & (F.col("near") == 1)).alias("near_threshold_wrong"))
    for label, name in ((0, "false_positive_domains"), (1, "false_negative_domains")):
        top = top_values(r.where(wrong & (F.col("true_label") == label)), ["model"], "domain", k).withColumnRenamed("top", name)
        out = out.join(top, "model", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def hard_samples(rows: DataFrame) -> DataFrame:
    """AG6: samples that some model gets wrong, with those models in order."""
    r = judged(rows)
    wrong = F.col("correct") == 0
    said = F.concat(F.col("model"), F.lit("="), four_places(F.col("p")))
    of = lambda v, name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(wrong, F.struct("ord", v.alias("v"))))), lambda x: x["v"]), "; ").alias(name)
    out = r.groupBy("sample_id").agg(F.first("true_label").alias("true_label"), F.count_if(wrong).alias("wrong_models"), F.count("*").alias("total_models"), F.first("source").alias("source"), of(F.col("model"), "wrong_model_names"), of(said, "wrong_probabilities"))
    return out.where("wrong_models > 0")


def by_source(rows: DataFrame, k: int = 8) -> DataFrame:
    """AG7."""
    r = judged(rows)
    keys = ["model", "source", "true_label"]
    out = r.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_if(F.col("correct") == 0).alias("wrong"))
    top = top_values(r.where("correct = 0"), keys, "domain", k).withColumnRenamed("top", "top_wrong_domains")
    return out.withColumn("error_rate", ratio(F.col("wrong"), F.col("samples"))).join(top, keys, "left").withColumn("top_wrong_domains", F.coalesce("top_wrong_domains", F.lit("")))
