"""Queries over the synthetic scorers' predictions: metrics, calibration, errors, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists
from ..operators import audit, calibration, errors, metrics, scoring
from .views import WITH_PAGES, WITH_PREDICTIONS, pages_x, predictions_x, table

MODEL_ROWS = [(f"scorer_{i + 1}", lists.MODELS[i][1], i + 1) for i in range(6)]


def facts(s: SparkSession, d: str) -> DataFrame:
    """The central fact table (sample, model): predictions with threshold, domain and order."""
    p = predictions_x(s, d)
    m = F.substring("model", 8, 1).cast("int")
    return p.select(F.concat(F.when(F.col("true_label") == 0, "L").otherwise("P"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("_x")).alias("sample_id"), "model", "source", F.concat(F.lit("d"), (F.col("doc_id") % 37).cast("string"), F.lit(".test")).alias("domain"), "true_label", "p", F.when(m == 3, F.lit(0.4)).otherwise(F.lit(0.5)).alias("threshold"), (F.col("doc_id") * 10 + m).alias("ord"))


def predictions_fact(s, d):
    f = errors.judged(facts(s, d))
    return f.select("sample_id", "model", "true_label", metrics.predicted(F.col("threshold")).alias("predicted_label"), "correct", F.round("p", 9).alias("p"), "threshold")


def confusion_metrics(s, d):
    out = metrics.with_rates(metrics.confusion(predictions_x(s, d), ["model"]))
    return out.select("model", "tn", "fp", "fn", "tp", *(F.round(x, 9).alias(x) for x in metrics.rates()))


def roc_auc(s, d):
    return metrics.roc_auc(predictions_x(s, d), ["model"]).select("model", F.round("roc_auc", 9).alias("roc_auc"))


def roc_points(s, d):
    return metrics.roc_points(predictions_x(s, d), ["model"]).select("model", F.round("threshold", 9).alias("threshold"), F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


def classification_report(s, d):
    out = metrics.classification_report(metrics.confusion(predictions_x(s, d), ["model"]), ["model"], accuracy=True)
    return out.select("model", "label", *(F.round(x, 9).alias(x) for x in ("precision", "recall", "f1_score")), "support")


def metrics_from_cm(s, d):
    cm = metrics.confusion(predictions_x(s, d), ["model"]).select("model", F.format_string("[[%d, %d], [%d, %d]]", "tn", "fp", "fn", "tp").alias("confusion_matrix"))
    return metrics.with_rates(metrics.from_matrix(cm, ["model"])).select("model", "tn", "fp", "fn", "tp", F.round("f1", 9).alias("f1"), F.round("accuracy", 9).alias("accuracy"))


def _comparison(s, d):
    registry = F.broadcast(s.createDataFrame(MODEL_ROWS, "model string, input string, ord int"))
    overrides = s.createDataFrame([("scorer_3", 0.4)], "model string, threshold double")
    chosen = registry.join(F.broadcast(overrides.withColumnRenamed("threshold", "t")), "model", "left").select("model", "input", "ord", F.coalesce("t", F.lit(0.5)).alias("threshold"), F.when(F.col("t").isNull(), "default").otherwise("override").alias("threshold_source"))
    p = predictions_x(s, d).join(F.broadcast(chosen), "model")
    out = metrics.with_rates(metrics.confusion(p, ["model", "input", "ord", "threshold", "threshold_source"], F.col("threshold")))
    out = out.join(metrics.roc_auc(predictions_x(s, d), ["model"]), "model")
    internal = s.createDataFrame([("scorer_1", 0.8216), ("scorer_2", 0.7584)], "model string, internal_f1 double")
    return out.join(F.broadcast(internal), "model", "left").withColumn("delta_f1", F.col("f1") - F.col("internal_f1"))


def model_comparison(s, d):
    return _comparison(s, d).select("model", "input", "threshold", "threshold_source", *(F.round(x, 9).alias(x) for x in ("accuracy", "precision", "recall", "f1", "roc_auc", "internal_f1", "delta_f1")))


def best_model(s, d):
    return _comparison(s, d).agg(F.max_by("model", F.struct("f1", -F.col("ord"))).alias("best_model"), F.round(F.max("f1"), 9).alias("f1"))


def model_inputs(s, d):
    """Every page by every chosen model, with what the model reads and whether the page has it."""
    chosen = scoring.selected(["tri_branch_cnn", "url_cnn"])
    models = s.createDataFrame([(m, i, k) for k, (m, i) in enumerate(lists.MODELS) if m in chosen], "model string, input string, ord int")
    shots = table(s, d, "embeddings").select(F.col("vec_id").alias("page_id"), F.lit(True).alias("shot"))
    pages = pages_x(s, d).select("page_id", F.length("url") > 0, F.length("html") > 0).toDF("page_id", "has_url", "has_html").join(shots, "page_id", "left")
    has = {"url": F.col("has_url"), "html": F.col("has_html"), "screenshot": F.coalesce("shot", F.lit(False))}
    lacks = F.concat_ws("+", *(F.when(F.contains(F.col("input"), F.lit(k)) & ~c, F.lit(k)) for k, c in has.items()))
    return pages.crossJoin(F.broadcast(models)).select("page_id", "model", "input", "ord", lacks.alias("lacks"))


def misclassified(s, d):
    return errors.judged(facts(s, d)).where("correct = 0").select("sample_id", "model", "true_label")


def threshold_grid(s, d):
    """How many predictions of all models reach each threshold of the grid."""
    return calibration.curve(predictions_x(s, d), ["model"], calibration.grid(0.01)).groupBy("threshold").agg(F.sum(F.col("tp") + F.col("fp")).alias("n_positive"))


def threshold_curve(s, d):
    return calibration.curve(predictions_x(s, d), ["model"], calibration.grid(0.01)).select("model", "threshold", "tn", "fp", "fn", "tp", F.round("f1", 9).alias("f1"))


def _calibrated(s, d, **kw):
    out = calibration.calibrate(predictions_x(s, d), ["model"], **kw)
    return out.select("model", "threshold", *(F.round(x, 9).alias(x) for x in ("objective", "accuracy", "precision", "recall", "specificity", "f1")), "tn", "fp", "fn", "tp", "constraints_satisfied")


CALIBRATIONS = {
    "calibrate_f1": {}, "calibrate_accuracy": {"objective": "accuracy"}, "calibrate_balanced": {"objective": "balanced_accuracy"},
    "calibrate_constrained": {"min_recall": 0.5, "max_fpr": 0.4}, "calibrate_infeasible": {"min_recall": 1.0, "max_fpr": 0.0},
}


def model_errors(s, d):
    return errors.model_errors(facts(s, d))


def hard_samples(s, d):
    return errors.hard_samples(facts(s, d))


def hardest_samples(s, d):
    return errors.hard_samples(facts(s, d)).orderBy(F.desc("wrong_models"), "sample_id").limit(10).select("sample_id", "wrong_models")


def source_domain_errors(s, d):
    return errors.by_source(facts(s, d)).withColumn("error_rate", F.round("error_rate", 9))


def prediction_totals(s, d):
    return facts(s, d).agg(F.count_distinct("model").alias("models"), F.count_distinct("sample_id").alias("samples"), F.count("*").alias("predictions"))


def samples(s, d):
    """Collected samples for the audit: one for each labelled document."""
    x = table(s, d, "documents").select("doc_id", "n_chars").join(table(s, d, "labels"), "doc_id")
    label = 1 - F.col("quality")
    return x.select(F.concat(F.when(label == 0, "L").otherwise("P"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("_x")).alias("sample_id"), label.alias("label"), F.concat(F.lit("https://a.test/"), F.col("doc_id").cast("string")).alias("original_url"), F.concat(F.lit("https://a.test/"), (F.col("doc_id") - F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).cast("string")).alias("final_url"), F.lit("a.test").alias("domain"), F.col("n_chars").alias("html_length"), "doc_id")


def audit_queue(s, d):
    return audit.queue(samples(s, d).drop("doc_id"), errors.judged(facts(s, d)), focus="scorer_6")


def audit_queue_all_models(s, d):
    return audit.queue(samples(s, d).drop("doc_id"), errors.judged(facts(s, d))).select("sample_id", "priority", "flags", "model_probabilities")


def audit_priorities(s, d):
    return audit.queue(samples(s, d).drop("doc_id"), errors.judged(facts(s, d)), focus="scorer_6").groupBy("priority").agg(F.count("*").alias("n"))


def audits(s, d):
    """Two rounds of an audit; the second one overrules the first for every third sample."""
    x = samples(s, d)
    status = lambda k: F.element_at(F.array(*map(F.lit, ("approved", "corrected", "rejected", "uncertain", ""))), ((F.col("doc_id") + k) % 5 + 1).cast("int"))
    one = x.select("sample_id", status(0).alias("audit_status"), F.lit("").alias("audited_label"), F.col("doc_id").alias("ord"))
    two = x.where("doc_id % 3 = 0").select("sample_id", status(1).alias("audit_status"), (F.lit(1) - F.col("label")).cast("string").alias("audited_label"), (F.col("doc_id") + 10_000_000).alias("ord"))
    return one.unionByName(two)


def audited_index(s, d):
    columns = "rec_id string, split string, url string, html_file string, screenshot_file string, label int, target_brand string, source string"
    base = s.createDataFrame([("base1", "trainval", "https://base.test/", "base.html", "base.png", 0, "", "directory")], columns)
    return audit.audited_index(base, samples(s, d), audits(s, d), "batch")


def upsert_results(s, d):
    old = s.createDataFrame([(f"scorer_{i}", 0.5, i) for i in (1, 2, 3)] + [("other", 0.25, 4)], "model string, f1 double, ord int")
    new = confusion_metrics(s, d).where("model in ('scorer_2', 'scorer_6')").select("model", "f1", F.when(F.col("model") == "scorer_2", 1).otherwise(2).alias("ord"))
    return metrics.upsert(old, new)


def early_stopping(s, d):
    """Each customer's orders are the epochs of one training."""
    log = table(s, d, "orders").select(F.col("o_custkey").alias("training"), F.col("o_orderkey").alias("epoch"), (F.col("o_orderkey") * 7919 % 997 / F.lit(1000.0)).alias("val_f1"))
    return metrics.early_stopping(log, 3, "training")


# ---- SQL
P = f"WITH {WITH_PREDICTIONS}"
CELLS = "count_if(true_label = 0 AND p < {t}) AS tn, count_if(true_label = 0 AND p >= {t}) AS fp, count_if(true_label = 1 AND p < {t}) AS fn, count_if(true_label = 1 AND p >= {t}) AS tp"
R = lambda a, b: f"coalesce(({a}) / nullif(CAST(({b}) AS DOUBLE), 0), 0e0)"
PREC, REC, SPEC = R("tp", "tp + fp"), R("tp", "tp + fn"), R("tn", "tn + fp")
F1 = R(f"2 * {PREC} * {REC}", f"{PREC} + {REC}")
RATES = {"accuracy": R("tp + tn", "tp + tn + fp + fn"), "precision": PREC, "recall": REC, "specificity": SPEC, "f1": F1, "false_positive_rate": R("fp", "fp + tn"), "false_negative_rate": R("fn", "fn + tp")}
rounded = lambda *names: ", ".join(f"round({RATES[n]}, 9) AS {n}" for n in names)
FACTS = f"""{P}, facts AS (SELECT concat(CASE WHEN true_label = 0 THEN 'L' ELSE 'P' END, lpad(CAST(doc_id AS STRING), 8, '0'), '_x') AS sample_id, model, source,
  concat('d', CAST(doc_id % 37 AS STRING), '.test') AS domain, true_label, p, CASE WHEN model = 'scorer_3' THEN 4e-1 ELSE 5e-1 END AS threshold, doc_id * 10 + CAST(model[8] AS INT) AS ord FROM predictions_x),
judged AS (SELECT *, CASE WHEN p >= threshold THEN 1 ELSE 0 END AS predicted_label, CAST((CASE WHEN p >= threshold THEN 1 ELSE 0 END) = true_label AS INT) AS correct, CAST(abs(p - threshold) <= 1e-1 AS INT) AS near FROM facts)"""
AUC = "auc AS (SELECT model, (sum(CASE WHEN true_label = 1 THEN mid ELSE 0 END) - np * (np + 1) / 2e0) / (np * nn) AS roc_auc FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2e0 AS mid, count_if(true_label = 1) OVER (PARTITION BY model) AS np, count_if(true_label = 0) OVER (PARTITION BY model) AS nn FROM predictions_x) GROUP BY model, np, nn)"
GRID = "grid AS (SELECT round(i / 1e2, 6) AS threshold FROM range(1, 100) t(i))"
CURVE = f"{P}, {GRID}, cells AS (SELECT model, threshold, {CELLS.format(t='threshold')} FROM predictions_x, grid GROUP BY model, threshold)"


def calibrated_sql(objective: str = "f1", min_recall: float = 0.0, max_fpr: float | None = None) -> str:
    goal = f"({REC} + {SPEC}) / 2e0" if objective == "balanced_accuracy" else RATES[objective]
    ok = f"{REC} >= {min_recall!r}::DOUBLE" + (f" AND {RATES['false_positive_rate']} <= {max_fpr!r}::DOUBLE" if max_fpr is not None else "")
    return f"""{CURVE}, scored AS (SELECT *, {goal} AS goal, CAST({ok} AS INT) AS ok FROM cells),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY model ORDER BY ok DESC, goal DESC, {REC} DESC, {RATES['false_positive_rate']}, threshold DESC) = 1)
SELECT model, threshold, round(goal, 9) AS objective, {rounded('accuracy', 'precision', 'recall', 'specificity', 'f1')}, tn, fp, fn, tp, ok AS constraints_satisfied FROM best"""


def top_sql(where: str, keys: str, name: str) -> str:
    return f"""(SELECT {keys}, string_agg(domain, '; ' ORDER BY rk) AS {name} FROM (SELECT {keys}, domain, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, min(ord)) AS rk FROM judged WHERE {where} GROUP BY {keys}, domain) WHERE rk <= 8 GROUP BY {keys})"""


def queue_sql(focus: str | None) -> str:
    where = f"WHERE model = '{focus}'" if focus else ""
    return f"""{FACTS}, samples AS (SELECT concat(CASE WHEN quality = 1 THEN 'L' ELSE 'P' END, lpad(CAST(doc_id AS STRING), 8, '0'), '_x') AS sample_id, 1 - quality AS label, concat('https://a.test/', CAST(doc_id AS STRING)) AS original_url,
  concat('https://a.test/', CAST(doc_id - CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS STRING)) AS final_url, n_chars AS html_length FROM documents JOIN labels USING (doc_id)),
per AS (SELECT sample_id, bool_or(correct = 0) AS wrong, bool_or(near = 1) AS near, string_agg(concat(model, '=', printf('%.4f', p)), '; ' ORDER BY ord) AS said FROM judged {where} GROUP BY sample_id),
flagged AS (SELECT s.*, said, list_filter([CASE WHEN original_url <> final_url THEN 'redirect' END, CASE WHEN html_length < 1000 THEN 'short_html' END, CASE WHEN wrong AND label = 0 THEN 'false_positive' END,
  CASE WHEN wrong AND label = 1 THEN 'false_negative' END, CASE WHEN near THEN 'near_threshold' END], lambda x: x IS NOT NULL) AS f FROM samples s LEFT JOIN per USING (sample_id)),
queue AS (SELECT CASE WHEN list_contains(f, 'false_negative') THEN 1 WHEN list_contains(f, 'false_positive') THEN 2 WHEN list_contains(f, 'near_threshold') THEN 3 WHEN len(f) > 0 THEN 4 ELSE 5 END AS priority, sample_id, label AS current_label,
  CASE WHEN len(f) > 0 THEN 'review' ELSE 'spot_check' END AS suggested_action, array_to_string(f, ';') AS flags, 'a.test' AS domain, final_url, html_length,
  concat(sample_id, '/SCREEN-SHOT/', split_part(sample_id, '_', 1), '.png') AS screenshot_path, coalesce(said, '') AS model_probabilities FROM flagged)"""


MODELS_SQL = "registry AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{i}', {k})" for m, i, k in MODEL_ROWS) + ") t(model, input, ord))"
COMPARISON = f"""{P}, {MODELS_SQL}, {AUC}, chosen AS (SELECT *, CASE WHEN model = 'scorer_3' THEN 4e-1 ELSE 5e-1 END AS threshold, CASE WHEN model = 'scorer_3' THEN 'override' ELSE 'default' END AS threshold_source FROM registry),
cells AS (SELECT model, input, ord, threshold, threshold_source, {CELLS.format(t='threshold')} FROM predictions_x JOIN chosen USING (model) GROUP BY ALL),
internal AS (SELECT * FROM (VALUES ('scorer_1', 8216e-4), ('scorer_2', 7584e-4)) t(model, internal_f1)), compared AS (SELECT * FROM cells JOIN auc USING (model) LEFT JOIN internal USING (model))"""
REPORT_ROW = lambda k, p, r, f, n: f"SELECT model, '{k}' AS label, round({p}, 9) AS precision, round({r}, 9) AS recall, round({f}, 9) AS f1_score, CAST({n} AS BIGINT) AS support FROM c"
REPORT = f"""{P}, cells AS (SELECT model, {CELLS.format(t='5e-1')} FROM predictions_x GROUP BY model),
b AS (SELECT *, {R('tn', 'tn + fn')} AS p0, {R('tn', 'tn + fp')} AS r0, {PREC} AS p1, {REC} AS r1, tn + fp AS n0, fn + tp AS n1 FROM cells), c AS (SELECT *, {R('2 * p0 * r0', 'p0 + r0')} AS f0, {R('2 * p1 * r1', 'p1 + r1')} AS f1 FROM b) """ + " UNION ALL ".join([
    REPORT_ROW("legitimate", "p0", "r0", "f0", "n0"), REPORT_ROW("phishing", "p1", "r1", "f1", "n1"), REPORT_ROW("macro avg", "(p0 + p1) / 2e0", "(r0 + r1) / 2e0", "(f0 + f1) / 2e0", "n0 + n1"),
    REPORT_ROW("weighted avg", *(f"({x}0 * n0 + {x}1 * n1) / CAST(n0 + n1 AS DOUBLE)" for x in "prf"), "n0 + n1"), REPORT_ROW("accuracy", *["(tn + tp) / CAST(n0 + n1 AS DOUBLE)"] * 3, "n0 + n1"),
])

SQL = {
    "predictions_fact": f"{FACTS} SELECT sample_id, model, true_label, predicted_label, correct, round(p, 9) AS p, threshold FROM judged",
    "confusion_metrics": f"{P}, cells AS (SELECT model, {CELLS.format(t='5e-1')} FROM predictions_x GROUP BY model) SELECT model, tn, fp, fn, tp, {rounded(*RATES)} FROM cells",
    "roc_auc": f"{P}, {AUC} SELECT model, round(roc_auc, 9) AS roc_auc FROM auc",
    "roc_points": f"{P}, t AS (SELECT DISTINCT model, p AS t FROM predictions_x) SELECT t.model, round(t, 9) AS threshold, round(count_if(x.true_label = 0 AND x.p >= t) / CAST(count_if(x.true_label = 0) AS DOUBLE), 9) AS fpr, round(count_if(x.true_label = 1 AND x.p >= t) / CAST(count_if(x.true_label = 1) AS DOUBLE), 9) AS tpr FROM t JOIN predictions_x x ON x.model = t.model GROUP BY t.model, t",
    "classification_report": REPORT,
    "metrics_from_cm": f"{P}, cells AS (SELECT model, {CELLS.format(t='5e-1')} FROM predictions_x GROUP BY model) SELECT model, tn, fp, fn, tp, {rounded('f1', 'accuracy')} FROM cells",
    "model_comparison": f"{COMPARISON} SELECT model, input, threshold, threshold_source, {rounded('accuracy', 'precision', 'recall', 'f1')}, round(roc_auc, 9) AS roc_auc, round(internal_f1, 9) AS internal_f1, round({F1} - internal_f1, 9) AS delta_f1 FROM compared",
    "best_model": f"{COMPARISON} SELECT model AS best_model, round({F1}, 9) AS f1 FROM compared ORDER BY {F1} DESC, ord LIMIT 1",
    "model_inputs": f"""WITH {WITH_PAGES} SELECT page_id, model, input, ord, concat_ws('+', CASE WHEN url = '' THEN 'url' END, CASE WHEN ord = 5 AND html = '' THEN 'html' END, CASE WHEN ord = 5 AND vec_id IS NULL THEN 'screenshot' END) AS lacks
FROM pages_x LEFT JOIN embeddings ON vec_id = page_id CROSS JOIN (VALUES ('url_cnn', 'url', 0), ('tri_branch_cnn', 'url+html+screenshot', 5)) t(model, input, ord)""",
    "misclassified": f"{FACTS} SELECT sample_id, model, true_label FROM judged WHERE correct = 0",
    "threshold_grid": f"{P}, {GRID} SELECT threshold, count_if(p >= threshold) AS n_positive FROM predictions_x, grid GROUP BY threshold",
    "threshold_curve": f"{CURVE} SELECT model, threshold, tn, fp, fn, tp, {rounded('f1')} FROM cells",
    **{k: calibrated_sql(**v) for k, v in CALIBRATIONS.items()},
    "model_errors": f"""{FACTS}, m AS (SELECT model, count(*) AS samples, count_if(correct = 0) AS wrong, count_if(correct = 0 AND true_label = 0) AS false_positives, count_if(correct = 0 AND true_label = 1) AS false_negatives, count_if(correct = 0 AND near = 1) AS near_threshold_wrong FROM judged GROUP BY model)
SELECT m.*, coalesce(false_positive_domains, '') AS false_positive_domains, coalesce(false_negative_domains, '') AS false_negative_domains FROM m LEFT JOIN {top_sql('correct = 0 AND true_label = 0', 'model', 'false_positive_domains')} a USING (model) LEFT JOIN {top_sql('correct = 0 AND true_label = 1', 'model', 'false_negative_domains')} b USING (model)""",
    "hard_samples": f"""{FACTS} SELECT sample_id, any_value(true_label) AS true_label, count_if(correct = 0) AS wrong_models, count(*) AS total_models, any_value(source) AS source, string_agg(model, '; ' ORDER BY ord) FILTER (correct = 0) AS wrong_model_names,
string_agg(concat(model, '=', printf('%.4f', p)), '; ' ORDER BY ord) FILTER (correct = 0) AS wrong_probabilities FROM judged GROUP BY sample_id HAVING count_if(correct = 0) > 0""",
    "hardest_samples": f"{FACTS} SELECT sample_id, count_if(correct = 0) AS wrong_models FROM judged GROUP BY sample_id HAVING count_if(correct = 0) > 0 ORDER BY 2 DESC, 1 LIMIT 10",
    "source_domain_errors": f"""{FACTS}, g AS (SELECT model, source, true_label, count(*) AS samples, count_if(correct = 0) AS wrong FROM judged GROUP BY ALL)
SELECT g.*, round(wrong / CAST(samples AS DOUBLE), 9) AS error_rate, coalesce(top_wrong_domains, '') AS top_wrong_domains FROM g LEFT JOIN {top_sql('correct = 0', 'model, source, true_label', 'top_wrong_domains')} t USING (model, source, true_label)""",
    "prediction_totals": f"{FACTS} SELECT count(DISTINCT model) AS models, count(DISTINCT sample_id) AS samples, count(*) AS predictions FROM facts",
    "audit_queue": f"{queue_sql('scorer_6')} SELECT * FROM queue",
    "audit_queue_all_models": f"{queue_sql(None)} SELECT sample_id, priority, flags, model_probabilities FROM queue",
    "audit_priorities": f"{queue_sql('scorer_6')} SELECT priority, count(*) AS n FROM queue GROUP BY priority",
    "audited_index": """WITH x AS (SELECT doc_id, concat(CASE WHEN quality = 1 THEN 'L' ELSE 'P' END, lpad(CAST(doc_id AS STRING), 8, '0')) AS base, 1 - quality AS label FROM documents JOIN labels USING (doc_id)),
a AS (SELECT doc_id, ['approved', 'corrected', 'rejected', 'uncertain', ''][CAST(doc_id % 5 + 1 AS INT)] AS status, '' AS audited, doc_id AS ord FROM x UNION ALL
  SELECT doc_id, ['approved', 'corrected', 'rejected', 'uncertain', ''][CAST((doc_id + 1) % 5 + 1 AS INT)], CAST(1 - label AS STRING), doc_id + 10000000 FROM x WHERE doc_id % 3 = 0),
b AS (SELECT doc_id, arg_max(audited, ord) AS audited FROM a WHERE status IN ('approved', 'corrected') GROUP BY doc_id)
SELECT concat('audited_batch_', base, '_x') AS rec_id, 'trainval' AS split, concat('https://a.test/', CAST(doc_id - CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS STRING)) AS url, concat('batch/', base, '_x/RAW-HTML/', base, '.html') AS html_file,
  concat('batch/', base, '_x/SCREEN-SHOT/', base, '.png') AS screenshot_file, CAST(coalesce(nullif(audited, ''), CAST(label AS STRING)) AS INT) AS label, 'audited_external' AS target_brand, 'audited_external' AS source FROM x JOIN b USING (doc_id)
UNION ALL SELECT 'base1', 'trainval', 'https://base.test/', 'base.html', 'base.png', 0, '', 'directory'""",
    "upsert_results": f"""{P}, cells AS (SELECT model, {CELLS.format(t='5e-1')} FROM predictions_x GROUP BY model)
SELECT model, round({F1}, 9) AS f1, CASE WHEN model = 'scorer_2' THEN 5 ELSE 6 END AS ord FROM cells WHERE model IN ('scorer_2', 'scorer_6') UNION ALL SELECT * FROM (VALUES ('scorer_1', 5e-1, 1), ('scorer_3', 5e-1, 3), ('other', 25e-2, 4)) t(model, f1, ord)""",
    "early_stopping": """WITH RECURSIVE log AS (SELECT o_custkey AS training, o_orderkey AS epoch, (o_orderkey * 7919 % 997) / 1e3 AS val_f1, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
run AS (SELECT training, epoch, val_f1, k, 1 AS improved, val_f1 AS best, 0 AS waited FROM log WHERE k = 1 UNION ALL
  SELECT l.training, l.epoch, l.val_f1, l.k, CAST(l.val_f1 > r.best AS INT), greatest(l.val_f1, r.best), CASE WHEN l.val_f1 > r.best THEN 0 ELSE r.waited + 1 END FROM run r JOIN log l ON l.training = r.training AND l.k = r.k + 1 WHERE r.waited < 3)
SELECT training, epoch, val_f1, improved, waited, CAST(waited >= 3 AS INT) AS stops FROM run""",
}

_FUNCTIONS = (predictions_fact, confusion_metrics, roc_auc, roc_points, classification_report, metrics_from_cm, model_comparison, best_model, model_inputs, misclassified, threshold_grid, threshold_curve, model_errors, hard_samples, hardest_samples, source_domain_errors, prediction_totals, audit_queue, audit_queue_all_models, audit_priorities, audited_index, upsert_results, early_stopping)
QUERIES = {f.__name__: f for f in _FUNCTIONS} | {k: (lambda s, d, kw=kw: _calibrated(s, d, **kw)) for k, kw in CALIBRATIONS.items()}
