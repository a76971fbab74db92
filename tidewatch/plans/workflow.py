"""The three jobs, from tables to tables: collect a batch, evaluate it, take what was audited into the training index."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, score, text, url
from ..operators import admission, audit, calibration, dedup, errors, leakage, metrics

LENGTHS = (3, 2048)


def batch_name(name: str | None, day: str) -> str:
    """PF18: ``week_YYYY_MM_DD`` with an optional ending; made of the day (YYYY-MM-DD) where none is given."""
    name = name or "week_" + day.replace("-", "_")
    if not re.fullmatch(r"week_[0-9]{4}_[0-9]{2}_[0-9]{2}(_[A-Za-z0-9_]+)?", name):
        raise ValueError(f"not a batch name: {name}")
    return name


def paths(root: str, name: str) -> dict[str, str]:
    """The places of a batch's tables."""
    return {k: f"{root}/{name}/{k}" for k in ("candidates", "accepted", "rejected", "predictions", "comparison", "audit_queue", "index")}


def collect(candidates: DataFrame, captures: DataFrame, known: DataFrame, quotas: dict[int, int], exclude_domains: bool = True, state: dict[str, DataFrame] | None = None, max_candidates: int = 0) -> dict[str, DataFrame]:
    """Candidates (ord, url, label) and their captures (url, final_url, html, status, content_type, dhash): accepted and rejected rows.

    What needs no order is tested by joins with the leakage index before the ordered admission: a row that training
    data already hold is rejected whatever comes before it. Captures may have ``shot_error``, the screenshot's fault.
    With ``state``, what readers.resume() found, a stopped collection goes on: attempted keys are not tried again, quotas
    and numbers continue, and samples accepted before claim their keys.
    """
    c = candidates.withColumn("n", url.normalise(F.col("url"))).where("n.error is null").select("ord", "label", F.col("n.url").alias("url"))
    used = candidates.where("false").select("label", F.lit(0).cast("bigint").alias("number"))
    if state:
        c = c.join(state["attempted"].select("url", "label"), ["url", "label"], "left_anti")
        before = {r["label"]: r["n"] for r in state["counts"].where(F.col("label").isin(*quotas)).collect()}  # a row for each label of the quotas
        quotas = {y: n - before.get(y, 0) for y, n in quotas.items()}
        known = known.unionByName(leakage.claimed(state["accepted"])).distinct()
        numbered = F.when(F.substring("sample_id", 1, 1) == "L", 0).otherwise(1)
        number = F.regexp_extract("sample_id", "^[LP]([0-9]+)_", 1)
        used = state["accepted"].where(number != "").select(numbered.alias("label"), number.cast("bigint").alias("number"))
    rows = c.join(captures.withColumnRenamed("url", "captured"), F.col("url") == F.col("captured"), "left").drop("captured")
    flagged = rows.withColumn("html_hash", html.fingerprint(F.col("html"))).withColumn("domain", url.hostname(F.col("url")))
    flagged = leakage.probe(flagged, known)
    barred = lambda flag: (F.col(flag) == 1) & (F.col("label") == 1) & F.lit(exclude_domains)
    leak = F.when(F.col("in_url") == 1, "duplicate_original_url").when(barred("in_phishing_domain"), "phishing_training_domain").when(F.col("html").isNull(), "crawl_error")
    shot_error = (F.col("shot_error") if "shot_error" in captures.columns else F.lit(None)).cast("string").alias("shot_error")
    flagged = flagged.withColumn("leak", leak)
    ready = admission.prepared(flagged).join(flagged.select("ord", "leak", "in_html_hash", "in_screenshot_hash", shot_error), "ord").withColumn("early", F.coalesce("leak", "early")).drop("leak")
    for kind, key, flag in (("url", F.col("final_url"), "in_final_url"), ("phishing_domain", url.hostname(F.col("final_url")), "in_final_domain")):
        keys = known.where(F.col("kind") == kind).select(F.col("key").alias("_key"))
        ready = ready.join(keys, key == F.col("_key"), "left").withColumn(flag, F.col("_key").isNotNull().cast("int")).drop("_key")
    ready = ready.withColumn("last", F.when(barred("in_final_domain"), "phishing_training_domain_after_redirect")).drop("in_final_domain")
    flags = [f for f in flagged.columns if f.startswith("in_")]
    out = admission.admit(ready, quotas, max_candidates=max_candidates).join(flagged.drop("label", "leak", "shot_error", *flags), "ord")
    accepted = out.where("outcome = 'accepted'").drop("outcome")
    return {"accepted": dedup.sample_ids(accepted, used), "rejected": out.where("outcome <> 'accepted'").select("ord", "label", "url", F.col("outcome").alias("reason"))}


def evaluate(samples: DataFrame, scorers: dict[str, Callable[[], Column]], thresholds: dict[str, float] | None = None, focus: str | None = None) -> dict[str, DataFrame]:
    """Samples (sample_id, label, original_url, final_url, domain, source, html_length, ...) scored by each scorer's column.

    One projection makes all scores, and one unpivot the fact table (sample, model); all reports are aggregates of it.
    """
    given = thresholds or {}
    made = samples.withColumns({f"_p_{m}": f().cast("double") for m, f in scorers.items()})
    entry = lambda k, m: F.struct(F.lit(k).alias("ord"), F.lit(m).alias("model"), F.col(f"_p_{m}").alias("p"), F.lit(float(given.get(m, 0.5))).alias("threshold"))
    facts = made.select("sample_id", F.col("label").alias("true_label"), "source", "domain", F.inline(F.array(*(entry(k, m) for k, m in enumerate(scorers)))))
    judged = errors.judged(facts)
    comparison = metrics.with_rates(metrics.confusion(facts, ["model", "threshold"], F.col("threshold"))).join(metrics.roc_auc(facts, ["model"]), "model")
    return {"predictions": judged, "comparison": comparison, "report": metrics.classification_report(metrics.confusion(facts, ["model"], F.col("threshold")), ["model"]), "thresholds": calibration.calibrate(facts, ["model"]), "audit_queue": audit.queue(samples, judged, focus)}


def retrain(base: DataFrame, samples: DataFrame, audits: DataFrame, dataset: str) -> DataFrame:
    """The base index and the audited samples; without any approved one it raises."""
    n = audit.approved(audits).count()
    if not n:
        raise ValueError("no approved or corrected samples")
    return audit.audited_index(base, samples, audits, dataset)


def predict(pages: DataFrame, deep: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """ML11: ``pages`` (url, html) with what the service answers: label, risk level, probability, whether a page was there.

    URLs shorter or longer than ``LENGTHS`` give no row. Without a deep model's column the rules' score decides.
    """
    rows = pages.where(F.length(F.trim("url")).between(*LENGTHS))
    rows = rows.withColumns({"_u": url.features(F.col("url")), "_h": html.features(F.col("html"), F.col("url"))})
    rules = score.heuristic({k: F.col(f"{s}.{k}") for s, names in (("_u", url.URL_FEATURES), ("_h", html.HTML_FEATURES)) for k in names})
    p = rules if deep is None else F.coalesce(deep, rules)
    has_deep = F.lit(False) if deep is None else deep.isNotNull()
    rows = rows.withColumn("_score", p)
    return rows.select(*pages.columns, url.with_scheme(F.col("url")).alias("full_url"), score.decision(F.col("_score"), F.lit(threshold), ~has_deep).alias("decision"), score.risk_level(F.col("_score"), has_deep).alias("risk_level"), F.round("_score", 4).alias("phishing_probability"), F.when(has_deep, "deep").otherwise("rules").alias("model_source"), F.col("_h.html_available").alias("html_available"))


def normalised_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with the tokens that text models read."""
    return pages.withColumn("tokens", html.html_text()(text.trimmed(F.col(column), 2000)))
