"""Audit queues, and what an audit adds to a training index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import NEAR, four_places

SHORT_HTML = 1000


def queue(samples: DataFrame, predictions: DataFrame, focus: str | None = None, limit: int = 0) -> DataFrame:
    """Samples (sample_id, label, original_url, final_url, domain, html_length) by priority.

    Predictions (sample_id, model, p, threshold, correct, ord) are summed by sample before they are joined.
    """
    chosen = predictions.where(F.col("model") == focus) if focus else predictions
    said = F.struct("ord", F.concat(F.col("model"), F.lit("="), four_places(F.col("p"))).alias("v"))
    per = chosen.groupBy("sample_id").agg(F.bool_or(F.col("correct") == 0).alias("wrong"), F.bool_or(F.abs(F.col("p") - F.col("threshold")) <= NEAR).alias("near"), F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["v"]), "; ").alias("model_probabilities"))
    r = samples.join(per, "sample_id", "left").withColumn("wrong", F.coalesce("wrong", F.lit(False))).withColumn("near", F.coalesce("near", F.lit(False)))
    tests = {
        "redirect": F.col("original_url") != F.col("final_url"),
        "short_html": F.col("html_length") < SHORT_HTML,
        "false_positive": F.col("wrong") & (F.col("label") == 0),
        "false_negative": F.col("wrong") & (F.col("label") == 1),
        "near_threshold": F.col("near"),
    }
    r = r.withColumn("f", F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items()))))
    has = lambda n: F.array_contains("f", n)
    priority = F.when(has("false_negative"), 1).when(has("false_positive"), 2).when(has("near_threshold"), 3).when(F.size("f") > 0, 4).otherwise(5)
    base = F.substring_index("sample_id", "_", 1)
    out = r.select(priority.alias("priority"), "sample_id", F.col("label").alias("current_label"), F.when(F.size("f") > 0, "review").otherwise("spot_check").alias("suggested_action"), F.array_join("f", ";").alias("flags"), "domain", "final_url", "html_length", F.concat(F.col("sample_id"), F.lit("/SCREEN-SHOT/"), base, F.lit(".png")).alias("screenshot_path"), F.coalesce("model_probabilities", F.lit("")).alias("model_probabilities"))
    return out.orderBy("priority", "sample_id").limit(limit) if limit > 0 else out


def approved(audit: DataFrame, ord_col: str = "ord") -> DataFrame:
    """SRC14: approved and corrected rows, the last of each sample."""
    ok = audit.where(F.lower(F.trim("audit_status")).isin("approved", "corrected"))
    return ok.groupBy("sample_id").agg(F.max_by("audited_label", ord_col).alias("audited_label"))


def audited_index(base: DataFrame, samples: DataFrame, audit: DataFrame, dataset: str) -> DataFrame:
    """J6, J7, PF15: ``base`` and the approved samples that it hasn't, in its columns. Another label than 0 or 1 raises."""
    label = F.trim(F.coalesce(F.nullif(F.col("audited_label"), F.lit("")), F.col("label").cast("string")))
    checked = F.when(label.isin("0", "1"), label.cast("int")).otherwise(F.raise_error(F.concat(F.lit("invalid audited_label for "), F.col("sample_id"), F.lit(": "), label)).cast("int"))
    base_id = F.substring_index("sample_id", "_", 1)
    path = lambda kind, end: F.concat(F.lit(f"{dataset}/"), F.col("sample_id"), F.lit(f"/{kind}/"), base_id, F.lit(end))
    new = samples.join(approved(audit), "sample_id").select(F.concat(F.lit(f"audited_{dataset}_"), F.col("sample_id")).alias("rec_id"), F.lit("trainval").alias("split"), F.col("final_url").alias("url"), path("RAW-HTML", ".html").alias("html_file"), path("SCREEN-SHOT", ".png").alias("screenshot_file"), checked.alias("label"), F.lit("audited_external").alias("target_brand"), F.lit("audited_external").alias("source"))
    return base.unionByName(new.join(base.select("rec_id"), "rec_id", "left_anti").select(*base.columns))
