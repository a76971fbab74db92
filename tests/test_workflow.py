"""The three jobs end to end on hand-made tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import leakage
from tidewatch.plans import workflow
from tidewatch.sources import readers


def test_names_and_paths():
    assert workflow.batch_name(None, "2026-06-24") == "week_2026_06_24" == workflow.batch_name("week_2026_06_24", "")
    assert workflow.paths("/d", "week_2026_06_24_x")["accepted"] == "/d/week_2026_06_24_x/accepted"
    with pytest.raises(ValueError):
        workflow.batch_name("june", "")


def test_collect_evaluate_retrain(spark):
    known = leakage.index(spark.createDataFrame([("https://bad.test/old", "<p>known</p>" * 20, 1, "trainval")], "url string, html string, label int, split string"))
    page = lambda i: f"<p>{i}</p>" * 30
    urls = ["legit.test", "https://bad.test/old", "https://bad.test/new", "https://phish.test/login", "https://copy.test", "https://gone.test", "https://twin.test/", "https://legit.test/"]
    labels = [0, 0, 1, 1, 0, 0, 1, 0]
    candidates = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(zip(urls, labels, strict=True))], "ord bigint, url string, label int")
    norm = ["https://legit.test/", "https://bad.test/old", "https://bad.test/new", "https://phish.test/login", "https://copy.test/", "https://gone.test/", "https://twin.test/"]
    body = [page(0), page(1), page(2), page(3), "<p>known</p>" * 20, None, page(3)]
    captures = spark.createDataFrame([(u, u, h, 200, "text/html", 0xFF << (8 * i)) for i, (u, h) in enumerate(zip(norm, body, strict=True)) if h], "url string, final_url string, html string, status int, content_type string, dhash bigint")
    out = workflow.collect(candidates, captures, known, {0: 5, 1: 5})
    assert {r.ord: r.reason for r in out["rejected"].collect()} == {1: "duplicate_original_url", 2: "phishing_training_domain", 4: "duplicate_html", 5: "crawl_error", 6: "duplicate_html"}
    accepted = {r.url: r.sample_id for r in out["accepted"].collect()}
    assert accepted == {"https://legit.test/": "L00001_legitimate", "https://phish.test/login": "P00001_phishing"}

    samples = out["accepted"].select("sample_id", "label", F.col("url").alias("original_url"), "final_url", "domain", F.lit("test").alias("source"), F.length("html").alias("html_length"))
    r = workflow.evaluate(samples, {"good": lambda: F.col("label") * 0.9, "bad": lambda: F.lit(0.95)}, {"bad": 0.9})
    assert {x.model: (x.tp, x.fp, x.threshold) for x in r["comparison"].collect()} == {"good": (1, 0, 0.5), "bad": (1, 1, 0.9)}
    assert r["predictions"].count() == 4 and r["report"].count() == 8 and r["thresholds"].count() == 2
    assert {x.sample_id: x.priority for x in r["audit_queue"].collect()} == {"L00001_legitimate": 2, "P00001_phishing": 3}

    base = spark.createDataFrame([("b", "t", "u", "h", "s", 0, "", "x")], "rec_id string, split string, url string, html_file string, screenshot_file string, label int, target_brand string, source string")
    audits = spark.createDataFrame([("P00001_phishing", "approved", "", 1), ("L00001_legitimate", "rejected", "", 2)], "sample_id string, audit_status string, audited_label string, ord int")
    assert {x.rec_id for x in workflow.retrain(base, samples, audits, "week").collect()} == {"b", "audited_week_P00001_phishing"}
    with pytest.raises(ValueError):
        workflow.retrain(base, samples, audits.where("ord = 2"), "week")


def test_collect_resumes_and_knows_screenshots(spark):
    page = lambda i: f"<p>{i}</p>" * 30
    corpus = spark.createDataFrame([("https://bad.test/old", page("known"), 1, "trainval", 0xFF)], "url string, html string, label int, split string, dhash bigint")
    names = ["done", "tried", "shot", "fault", "redirect", "barred", "own", "ownshot", "fresh", "more"]
    at = [f"https://{n}.test/" for n in names]
    final = dict(zip(names, at, strict=True)) | {"redirect": "https://bad.test/old", "barred": "https://bad.test/landing", "own": "https://done.test/end"}
    dhash = {n: 0xFFFF << (4 * i) for i, n in enumerate(names)} | {"shot": 0xFE, "ownshot": (1 << 62) + 1, "fresh": None}
    candidates = spark.createDataFrame([(i, u, int(n == "barred")) for i, (n, u) in enumerate(zip(names, at, strict=True))], "ord bigint, url string, label int")
    rows = [(u, final[n], page(n), 200, "text/html", dhash[n], "blank_screenshot" if n == "fault" else None) for n, u in zip(names, at, strict=True)]
    captures = spark.createDataFrame(rows, "url string, final_url string, html string, status int, content_type string, dhash bigint, shot_error string")
    before = spark.createDataFrame([("L00002_legitimate", 0, "https://done.test/", "https://done.test/end", "h", "4000000000000000")], "sample_id string, label int, normalized_original_url string, normalized_final_url string, html_sha256 string, screenshot_dhash string")
    rejected = spark.createDataFrame([("https://tried.test/", 0)], "normalized_url string, mapped_label int")
    files = spark.createDataFrame([("L00002_legitimate", k) for k in "abcde"], "sample_id string, kind string")
    state = readers.resume(spark, before, rejected, files)
    out = workflow.collect(candidates, captures, leakage.index(corpus), {0: 2, 1: 1}, state=state)
    reasons = {names[r.ord]: r.reason for r in out["rejected"].collect()}
    assert reasons == {"shot": "duplicate_screenshot", "fault": "blank_screenshot", "redirect": "duplicate_final_url", "barred": "phishing_training_domain_after_redirect", "own": "duplicate_final_url", "ownshot": "duplicate_screenshot"}
    assert [(r.url, r.sample_id) for r in out["accepted"].collect()] == [("https://fresh.test/", "L00001_legitimate")]


def test_predict(spark):
    pages = spark.createDataFrame([("https://paypal-login.secure.xyz/verify", "<form><input type='password'></form>"), ("ab", None), ("https://plain.test/", None)], "url string, html string")
    got = {r.url: r for r in workflow.predict(pages).collect()}
    assert set(got) == {"https://paypal-login.secure.xyz/verify", "https://plain.test/"}
    assert got["https://plain.test/"].decision == "inconclusive" and got["https://plain.test/"].risk_level == "suspicious" and got["https://plain.test/"].html_available == 0
    deep = {r.url: r for r in workflow.predict(pages, F.lit(0.8)).collect()}
    assert deep["https://plain.test/"].decision == "phishing" and deep["https://plain.test/"].model_source == "deep"
