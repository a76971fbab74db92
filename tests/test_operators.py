"""Operators and functions on hand-made cases, against plain Python."""

from __future__ import annotations

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import html, image, lists, score, text, url
from tidewatch.operators import admission, audit, calibration, dedup, errors, hamming, leakage, metrics, prefix, scoring
from tidewatch.sources import feed, readers, writers


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


URLS = {
    "Example.COM": ("https://example.com/", None), "https://example.com:443/a/": ("https://example.com/a", None), "http://u@h.test:8080/x?q=1#f": ("http://h.test:8080/x?q=1", None),
    "": (None, "empty_url"), " ": (None, "empty_url"), "ftp://x.test/": (None, "unsupported_scheme"), "https:///p": (None, "missing_hostname"), "http://h:99999/": (None, "invalid_url"),
    "http://a..b/": (None, "invalid_url"), "http://localhost/": (None, "unsafe_hostname"), "http://192.168.0.1/": (None, "unsafe_hostname"), "http://8.8.8.8/x//": ("http://8.8.8.8/x", None),
    "http://h.test./?a=b": ("http://h.test/?a=b", None), "http://h.test:0/": ("http://h.test:0/", None),
}


def test_url_normaliser_native_and_arrow_agree(spark):
    for f in (url.normalise,):
        assert [tuple(x) for x in column(spark, URLS, f)] == list(URLS.values())
    assert [tuple(x) for x in column(spark, ["bücher.example", "http://[::1]/"], url.normalise)] == [("https://xn--bcher-kva.example/", None), (None, "unsafe_hostname")]


def test_feed_normaliser(spark):
    got = [tuple(x) for x in column(spark, ["﻿example.org/p/", "http://localhost/", "http://h.test:0/", None], url.normalise_feed)]
    assert got == [("https://example.org/p", None), ("http://localhost/", None), ("http://h.test/", None), (None, "empty_url")]
    got = [tuple(x) for x in column(spark, ["google.com, 3", "http://a.test/x", "a b.test", ""], url.domain_to_url)]
    assert got == [("https://google.com/", None), ("http://a.test/x", None), (None, "invalid_domain"), (None, "empty_domain")]


def test_entropy_and_flags(spark):
    assert column(spark, ["", "aaaa", "abab", "abcd"], url.entropy) == [0.0, 0.0, 1.0, 2.0]
    f = {k: column(spark, ["https://paypal-login.secure.xyz/verify?next=http://x.test"], lambda c, k=k: url.features(c)[k])[0] for k in ("has_suspicious_tld", "has_redirect_param", "has_embedded_url", "suspicious_word_count", "has_brand_impersonation", "num_subdomains")}
    assert f == {"has_suspicious_tld": 1, "has_redirect_param": 1, "has_embedded_url": 1, "suspicious_word_count": 4, "has_brand_impersonation": 1, "num_subdomains": 1}


def test_risk_bands(spark):
    assert column(spark, [0.39, 0.55, 0.75], lambda c: score.risk_level(c, F.lit(True)), "double") == ["legitimate", "suspicious", "phishing"]
    assert column(spark, [0.07, 0.80], lambda c: score.risk_level(c, F.lit(False)), "double") == ["suspicious", "phishing"]
    assert column(spark, [0.07, 0.80], lambda c: score.decision(c, F.lit(0.5), F.lit(True)), "double") == ["inconclusive", "phishing"]


def test_text_and_html(spark):
    assert column(spark, [" A&amp;B\x01\n c ", None], text.normalise) == ["a&b c", ""] == column(spark, [" A&amp;B\x01\n c ", None], text.normalise_udf())
    assert column(spark, ["Ab", "", None], lambda c: text.char_encode(c, 4, 98)) == [[97, 97, 0, 0], [0] * 4, [0] * 4]
    assert column(spark, ["abc", None], lambda c: text.trimmed(c, 2)) == ["ab", ""] and column(spark, ["abc"], lambda c: text.trimmed(c, 0)) == ["abc"]
    assert column(spark, ["a\r\nb", "a\nb"], html.fingerprint)[0] == column(spark, ["a\nb"], html.fingerprint)[0]
    page = '<form action="https://evil.test/login"><input type="password" placeholder="Your Password"><a href="/x">Go &amp; see</a><script>hidden()</script>'
    tokens = html.visible(page).split()
    assert {"tag_form", "action_domain_evil.test", "attr_type_password", "attr_placeholder_your_password", "go", "&", "see"} <= set(tokens) and "hidden()" not in tokens
    assert column(spark, ["<h1>Installation   Error</h1>", "fine", None], html.error_signature) == ["installation error", None, None]
    assert column(spark, [" Legit", "PHISH", "maybe", None], text.label_of) == [0, 1, None, None]


def png(w, h, pixel):
    rows = b"".join(b"\0" + b"".join(bytes([pixel(x, y)]) * 3 for x in range(w)) for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    shapes = {"a_vertical": (120, 80, lambda x, y: 255 * (x // 10 % 2)), "b_horizontal": (120, 80, lambda x, y: 255 * (y // 10 % 2)), "c_white": (200, 100, lambda x, y: 255), "d_small": (20, 20, lambda x, y: x), "e_dot": (120, 80, lambda x, y: 255 * (x // 10 % 2) if (x, y) != (5, 5) else 255)}
    for name, (w, h, f) in shapes.items():
        (tmp_path / f"{name}.png").write_bytes(png(w, h, f))
    df = spark.read.format("image").load(str(tmp_path))
    rows = df.select(F.regexp_extract("image.origin", r"([a-z_]+)\.png", 1).alias("n"), image.inspected()(F.col("image")).alias("x"), F.size(image.tensors(32)(F.col("image"))).alias("t")).orderBy("n").collect()
    got = {r.n: r.x for r in rows}
    assert got["c_white"].error == "blank_or_monochrome_screenshot" and got["d_small"].error == "screenshot_too_small"
    bits = lambda a, b: (int(got[a].dhash, 16) ^ int(got[b].dhash, 16)).bit_count()
    assert bits("a_vertical", "e_dot") <= 2 and bits("a_vertical", "b_horizontal") > 5
    assert {r.t for r in rows} == {3 * 32 * 32}


def test_hamming_pairs_are_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 8))) for b in base for _ in range(3)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    left = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(base)], "a int, ha bigint")
    right = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(near)], "b int, hb bigint")
    want = {(i, j, (x ^ y).bit_count()) for i, x in enumerate(base) for j, y in enumerate(near) if (x ^ y).bit_count() <= 5}
    assert {tuple(r) for r in hamming.near_pairs(left, right).collect()} == want
    hashes = lambda df, c, to: df.select(F.col(c).alias(to)).union(spark.createDataFrame([(None,)], f"{to} bigint"))
    assert {r.ha for r in hamming.near_any(hashes(left, "ha", "ha"), hashes(right, "hb", "hb")).collect()} == {signed(base[i]) for i, _, _ in want}
    assert column(spark, ["ffffffffffffffff", "0000000000000001"], hamming.from_hex) == [-1, 1]


def test_sample_ids_fill_gaps(spark):
    used = spark.createDataFrame([(0, 2), (0, 3), (0, 7), (1, 1)], "label int, number bigint")
    rows = spark.createDataFrame([(i, i % 3 // 2) for i in range(12)], "ord int, label int")
    got = [(r.label, r.number) for r in dedup.sample_ids(rows, used).orderBy("ord").collect()]
    free = {0: iter([1, 4, 5, 6, *range(8, 30)]), 1: iter(range(2, 30))}
    assert got == [(i % 3 // 2, next(free[i % 3 // 2])) for i in range(12)]
    assert dedup.sample_ids(rows.limit(1), used.where("label > 5")).first().sample_id == "L00001_legitimate"


def naive(y, p, t):
    tp = sum(a and b >= t for a, b in zip(y, p, strict=True))
    fp = sum(not a and b >= t for a, b in zip(y, p, strict=True))
    fn, tn = sum(y) - tp, len(y) - sum(y) - fp
    prec, rec = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return rec, fp / (fp + tn) if fp + tn else 0.0, 2 * prec * rec / (prec + rec) if prec + rec else 0.0


def test_calibration(spark):
    df = spark.createDataFrame([("m", y, p) for y, p in zip((0, 0, 1, 1), (0.10, 0.55, 0.70, 0.95), strict=True)], "model string, true_label int, p double")
    assert calibration.calibrate(df, ["model"]).first().threshold == 0.70
    rng = random.Random(2)
    rows = [(f"m{k}", rng.randint(0, 1), rng.choice([rng.random(), 0.5, 0.29, 0.07])) for k in range(3) for _ in range(60)]
    got = {r.model: r for r in calibration.calibrate(spark.createDataFrame(rows, "model string, true_label int, p double"), ["model"], min_recall=0.7).collect()}
    for m in ("m0", "m1", "m2"):
        y, p = zip(*((r[1], r[2]) for r in rows if r[0] == m), strict=True)
        best = max((((x := naive(y, p, t))[0] >= 0.7, x[2], x[0], -x[1], t) for t in calibration.grid()))
        assert got[m].threshold == best[-1] and got[m].constraints_satisfied == 1
    assert len(calibration.grid(0.01)) == 99 and calibration.grid(0.005)[-1] == 0.99
    with pytest.raises(ValueError):
        calibration.grid(0.6)


# Published confusion matrices with their accuracy, precision, recall, F1, false positive and false negative rates.
PUBLISHED = (
    ("[[1279, 220], [229, 1034]]", 0.8374, 0.8246, 0.8187, 0.8216, 0.1468, 0.1813), ("[[1366, 133], [75, 1188]]", 0.9247, 0.8993, 0.9406, 0.9195, 0.0887, 0.0594),
    ("[[33, 17], [1, 49]]", 0.82, 0.7424, 0.98, 0.8448, 0.34, 0.02), ("[[81, 19], [8, 92]]", 0.865, 0.8288, 0.92, 0.872, 0.19, 0.08), ("[[54, 46], [7, 93]]", 0.735, 0.6691, 0.93, 0.7782, 0.46, 0.07),
)


def test_published_matrices(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(PUBLISHED)], "model int, confusion_matrix string")
    for r in metrics.with_rates(metrics.from_matrix(df, ["model"])).collect():
        assert (r.accuracy, r.precision, r.recall, r.f1, r.false_positive_rate, r.false_negative_rate) == pytest.approx(PUBLISHED[r.model][1:], abs=5.1e-5)


def test_four_places_as_python(spark):
    values = [0.57375, 0.00005, 0.12345, 0.99995, 1.0, 0.0, 0.44625, *(random.Random(i).random() for i in range(200)), *(i / 32000 for i in range(200))]
    assert column(spark, values, errors.four_places, "double") == [f"{v:.4f}" for v in values]


def sequential(rows, quotas, most=0):
    urls, pages, shots, left, tried, out = set(), set(), set(), dict(quotas), set(), []
    for o, y, u, f, h, s, early, late in rows:
        if all(v <= 0 for v in left.values()) or most and len(out) >= most:
            break
        if left.get(y, 0) <= 0 or (u, y) in tried:
            continue
        tried.add((u, y))
        near = s is not None and any((s ^ x).bit_count() <= 5 for x in shots)
        reason = "duplicate_original_url" if u in urls else early or ("duplicate_final_url" if f in urls else None) or late or ("duplicate_html" if h in pages else None) or ("duplicate_screenshot" if near else None)
        out.append((o, y, reason or "accepted"))
        if not reason:
            left[y] -= 1
            urls |= {u, f}
            pages.add(h)
            shots |= {s} - {None}
    return out


CANDIDATE = "ord bigint, label int, url string, final_url string, html_hash string, dhash bigint, early string, late string"
#: Keys shared by many; keys of few, which fill quotas late; chains, in which every second row is accepted.
SHAPES = {
    "crowded": lambda rng, i: (f"u{rng.randint(0, 25)}", f"u{rng.randint(0, 25)}", f"h{rng.randint(0, 30)}", rng.choice([0, 3, 255, 1 << 40, (1 << 50) - 1, 7 << 30, None])),
    "sparse": lambda rng, i: (f"u{rng.randint(0, 300)}", f"u{rng.randint(0, 300)}", f"h{rng.randint(0, 200)}", rng.getrandbits(62) if rng.random() < 0.7 else (1 << rng.randint(0, 40)) - 1),
    "chain": lambda rng, i: (f"c{i}", f"c{i + 1}", f"h{i}", None),
}


@pytest.mark.parametrize(("shape", "quotas", "most"), [("crowded", {0: 5, 1: 4}, 0), ("sparse", {0: 40, 1: 3, 2: 0}, 60), ("chain", {0: 500, 1: 500}, 0)])
def test_admission_is_sequential(spark, monkeypatch, shape, quotas, most):
    rng = random.Random(f"{shape}{quotas}")
    n = 24 if shape == "chain" else 120
    rows = [(i * 3, rng.randint(0, 2), *SHAPES[shape](rng, i), rng.choice([None] * 5 + ["http_status_404"]), rng.choice([None] * 5 + ["html_too_short"])) for i in range(n)]
    if most:
        monkeypatch.setattr(admission, "WINDOW", 16)
    got = sorted(tuple(r) for r in admission.admit(spark.createDataFrame(rows, CANDIDATE).repartition(3), quotas, max_candidates=most).collect())
    assert got == sequential(rows, quotas, most)


def test_admission_of_nothing_and_of_one_crowd(spark):
    none = spark.createDataFrame([], CANDIDATE)
    assert admission.admit(none, {0: 5}).count() == 0
    crowd = [(i, 0, f"u{i}", f"u{i}", "same page", None, None, None) for i in range(3000)]
    got = admission.admit(spark.createDataFrame(crowd, CANDIDATE), {0: 5}).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in got} == {"accepted": 1, "duplicate_html": 2999}
    assert admission.admit(spark.createDataFrame(crowd, CANDIDATE), {0: 0}).count() == 0


def test_running_sums_and_ranks_are_those_of_one_window(spark):
    from pyspark.sql import Window

    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b"] + ["hot"] * 5), rng.randint(-50, 50), i, rng.choice([None, *range(9)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, x int, id int, v int").repartition(5)
    w = Window.partitionBy("k").orderBy(F.desc("x"), "id")
    want = df.select("*", F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.row_number().over(w).cast("bigint").alias("n"))
    got = prefix.running(df, ["k"], [F.desc("x"), F.col("id")], {"s": F.col("v"), "n": F.lit(1)})
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    ranks = {r.id: r["rank"] for r in prefix.ranked(df, [], [F.col("id")]).collect()}
    assert ranks == {i: i + 1 for i in range(2000)}
    assert prefix.ranked(df.where("id < 0"), ["k"], [F.col("id")]).count() == 0
    # no window holds a whole key: partitions of the exchange bound them all
    plan = prefix.ranked(df, ["k"], [F.col("id")])._jdf.queryExecution().optimizedPlan().toString()
    assert all("_pid" in line for line in plan.splitlines() if line.strip(" +-:").startswith("Window"))


def test_audit(spark):
    s = spark.createDataFrame([("L1_x", 0, "a", "b", "d", 500), ("P2_x", 1, "a", "a", "d", 5000)], "sample_id string, label int, original_url string, final_url string, domain string, html_length int")
    p = spark.createDataFrame([("L1_x", "m", 0.97, 0.5, 0, 1)], "sample_id string, model string, p double, threshold double, correct int, ord int")
    got = {r.sample_id: (r.priority, r.flags, r.suggested_action, r.model_probabilities) for r in audit.queue(s, p).collect()}
    assert got == {"L1_x": (2, "redirect;short_html;false_positive", "review", "m=0.9700"), "P2_x": (5, "", "spot_check", "")}
    assert audit.queue(s, p, limit=1).count() == 1
    base = spark.createDataFrame([("base1", "t", "u", "h", "s", 0, "", "x")], "rec_id string, split string, url string, html_file string, screenshot_file string, label int, target_brand string, source string")
    ok = spark.createDataFrame([("P2_x", "rejected", "", 1), ("P2_x", "approved", "", 2), ("L1_x", "approved", "1", 3), ("L1_x", "rejected", "", 4)], "sample_id string, audit_status string, audited_label string, ord int")
    rows = {r.rec_id: r.label for r in audit.audited_index(base, s, ok, "b").collect()}
    assert rows == {"base1": 0, "audited_b_P2_x": 1, "audited_b_L1_x": 1}
    with pytest.raises(Exception, match="invalid audited_label"):
        audit.audited_index(base, s, spark.createDataFrame([("P2_x", "approved", "7", 1)], ok.schema), "b").collect()


def test_leakage_json_round_trip(spark):
    corpus = spark.createDataFrame([("https://a.test/x/", "<p>", 1, "trainval"), ("bad url:", None, 0, "test"), ("b.test", "q", 1, "test")], "url string, html string, label int, split string")
    index = leakage.index(corpus)
    back = leakage.from_json(leakage.as_json(index, leakage.stats(corpus)))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, index.collect()))
    assert [r.key for r in index.where("kind = 'phishing_domain'").collect()] == ["a.test"]
    shots = corpus.withColumn("dhash", F.when(F.col("label") == 1, F.lit(-1).cast("bigint")))
    assert [r.key for r in leakage.index(shots).where("kind = 'screenshot_hash'").collect()] == ["f" * 16]
    assert {r.stat: r.n for r in leakage.stats(shots).collect()} == {"urls": 3, "html": 2, "missing_html": 1, "screenshots": 2, "missing_screenshots": 1}
    batch = spark.createDataFrame([(1, ~31), (2, ~63), (3, None), (4, ~31)], "n int, dhash bigint").selectExpr("*", "'u' AS url", "'h' AS html_hash", "'d' AS domain", "0 AS label")
    assert {r.n: r.in_screenshot_hash for r in leakage.probe(batch, leakage.index(shots)).collect()} == {1: 1, 2: 0, 3: 0, 4: 1}


def test_sources(spark, tmp_path):
    w = lambda n, t: (tmp_path / n).write_text(t) and str(tmp_path / n)
    assert [r.url for r in readers.feed(spark, w("feed.txt", "﻿https://a.test\n# note\n\n https://b.test \n")).orderBy("ord").collect()] == ["https://a.test", "https://b.test"]
    assert [r.url for r in readers.ranked(spark, w("rank.csv", "1,google.com\n2,a b\nplain.test\n3,x.test\n"), 2).collect()] == ["https://google.com/", "https://plain.test/"]
    labelled = readers.labelled(spark, w("mine.csv", 'url,label\n"https://a.test/""q""",1\nb.test,0\nc.test,5\n'))
    assert [(r.url, r.label, r.source) for r in labelled.collect()] == [('https://a.test/"q"', 1, "mine"), ("https://b.test/", 0, "mine")]
    with pytest.raises(ValueError, match="missing columns: label"):
        readers.labelled(spark, w("no.csv", "url\nx\n"))
    assert readers.seen(spark, str(tmp_path / "none.csv")).count() == 0
    assert [r.url for r in readers.seen(spark, w("seen.csv", "url,label\nhttps://s.test/,0\n")).collect()] == ["https://s.test/"]
    assert [r.url for r in readers.seen(spark, w("seen.txt", "https://s.test/\n")).collect()] == ["https://s.test/"]
    c = readers.candidates(spark, w("cand.csv", "url,label\nexample.com,0\nhttps://example.com/,1\nexample.com,legit\nx.test,huh\n,0\n")).orderBy("input_row").collect()
    assert [(r.input_row, r.normalized_url, r.reason) for r in c] == [(2, "https://example.com/", None), (3, "", "conflicting_input_label"), (4, "", "duplicate_input_url"), (5, "", "unmapped_label"), (6, "", "empty_url")]
    assert [(r.input_row, r.label) for r in readers.candidates(spark, w("t.csv", "1,google.com\n"), "tranco").collect()] == [(1, 0)]
    for name, body in (("t1.json", '{"models": {"m": {"threshold": 0.73}}}'), ("t2.json", '{"models": {"m": 0.73}}'), ("t3.json", '{"m": 0.73}'), ("t4.csv", "model,threshold\nm,0.73\n")):
        assert [tuple(r) for r in readers.thresholds(spark, w(name, body)).collect()] == [("m", 0.73)]
    p = readers.predictions(spark, w("p.csv", "sample_id,model,true_label,phishing_probability,threshold\ns,m,1,0.5,0.4\ns,n,1,0.5,0.4\n"), "m")
    assert [(r.sample_id, r.p) for r in p.collect()] == [("s", 0.5)]
    with pytest.raises(ValueError, match="no predictions"):
        readers.predictions(spark, w("e.csv", "sample_id,model,true_label,phishing_probability,threshold\n"))


def test_directories_and_sinks(spark, tmp_path):
    for split, name, parts in (("trainval", "P10001_brand", ("URL/url.txt", "RAW-HTML/index.html", "SCREEN-SHOT/screen_shoot.png", "Label/label.txt")), ("test", "L2_x", ("URL/url.txt", "Label/label.txt")), ("test", "Q3", ("URL/url.txt", "RAW-HTML/index.html", "SCREEN-SHOT/screen_shoot.png", "Label/label.txt"))):
        for part in parts:
            f = tmp_path / "d" / split / name / part
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_text("﻿https://x.test " if "url" in part else "brand")
    rows, counts = readers.sample_directory(spark, str(tmp_path / "d"))
    assert [(r.rec_id, r.split, r.url, r.label, r.target_brand) for r in rows.collect()] == [("P10001_brand", "trainval", "https://x.test", 1, "brand")]
    assert {r.reason: r.n for r in counts.collect()} == {"written": 1, "missing_screenshot": 1, "invalid_sample_name": 1}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "d"))
    assert [r.html for r in readers.with_payloads(rows, files, "trainval", 3).collect()] == ["bra"]
    assert readers.with_payloads(rows, files.where("path not like '%.png'"), "trainval", 3).count() == 0
    batch = spark.createDataFrame([("L00001_legitimate", "https://l.test", "<a>", b"x", 0), ("P00001_phishing", "https://p.test", "<b>", b"y", 1)], "sample_id string, url string, html string, screenshot binary, label int")
    writers.csv(batch.select("url", "label"), str(tmp_path / "csv"), ["label", "url"], ["url"], single=True)
    assert spark.read.options(header=True).csv(str(tmp_path / "csv")).columns == ["label", "url"]
    for day in ("2026-01-01", "2026-01-08"):
        for _ in range(2):
            writers.append_seen(batch.withColumn("source", F.lit("feed")), str(tmp_path / "seen"), day)
    assert spark.read.parquet(str(tmp_path / "seen")).count() == 4
    writers.json_summary(batch.agg(F.count("*").alias("n")), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first()[0] == '{"n":2}'


def test_feed_source_reports_errors(spark):
    feed.register(spark)
    rows = spark.read.format("web_page").option("urls", "http://127.0.0.1:9/").option("retries", "0").option("timeout", "1").load().collect()
    assert len(rows) == 1 and rows[0].error and rows[0].body is None


def test_resume(spark):
    accepted = spark.createDataFrame([("L00001_l", 0, "https://a/"), ("P00004_p", 1, "https://b/")], "sample_id string, label int, normalized_original_url string")
    rejected = spark.createDataFrame([("https://c/", 1), ("", 0)], "normalized_url string, mapped_label int")
    files = spark.createDataFrame([("P00004_p", k) for k in "abcde"] + [("L00001_l", "a")], "sample_id string, kind string")
    r = readers.resume(spark, accepted, rejected, files)
    assert [tuple(x) for x in r["used"].collect()] == [(1, 4)]
    assert sorted(tuple(x) for x in r["attempted"].collect()) == [("https://b/", 1), ("https://c/", 1)]


def test_networks(spark):
    rng = np.random.default_rng(0)
    ids = {"url": rng.integers(0, 128, (3, scoring.URL_CHARS)), "html": rng.integers(0, 256, (3, 400)), "screenshot": rng.normal(size=(3, 3 * 64 * 64)).astype(np.float32)}
    for model, reads in lists.MODELS:
        p = scoring.seeded(model)
        z = scoring.FORWARD[model](p, *(ids[k] for k in reads.split("+")))
        assert z.shape == (3,) and np.isfinite(z).all()
        one = scoring.FORWARD[model](p, *(ids[k][1:2] for k in reads.split("+")))
        assert one[0] == pytest.approx(z[1], rel=1e-3, abs=1e-4)
    x, w = rng.normal(size=(1, 6, 2)), rng.normal(size=(3, 2, 4))
    slow = np.array([[sum(x[0, t + k - 1] @ w[k] for k in range(3) if 0 <= t + k - 1 < 6) for t in range(6)]])
    assert np.allclose(scoring.conv1d(x, w, np.zeros(4)), np.maximum(slow, 0))
    with pytest.raises(ValueError, match="unknown models: x"):
        scoring.selected(["x"])


def test_recurrence_equals_its_formula():
    """Also where rows start with more or less padding, or are nothing else."""
    rng = np.random.default_rng(3)
    emb, (wx, wh, b) = rng.normal(size=(9, 5)).astype(np.float32), (rng.normal(size=s).astype(np.float32) for s in ((5, 12), (3, 12), 12))
    ids = rng.integers(1, 9, (6, 20))
    for row, pad in zip(ids, (0, 7, 20, 1, 7, 19), strict=True):
        row[:pad] = 0
    ids[0, 4:6] = ids[1, 12:] = 0
    h = c = np.zeros((6, 3))
    for t in range(20):
        i, f, g, o = np.split(emb[ids[:, t]] @ wx + b + h @ wh, 4, axis=1)
        c = c / (1 + np.exp(-f)) + np.tanh(g) / (1 + np.exp(-i))
        h = np.tanh(c) / (1 + np.exp(-o))
    assert np.allclose(scoring.lstm(ids, emb, wx, wh, b), h, atol=1e-5)


@pytest.mark.parametrize("characters", [3, 90, 250])
def test_looked_up_sums_equal_a_convolution(characters):
    """By pairs and, with many characters, one by one; rows are longer than a block."""
    rng = np.random.default_rng(characters)
    ids, emb, w = rng.integers(0, characters, (3, 2 * scoring.BLOCK + 7)), rng.normal(size=(256, 4)).astype(np.float32), rng.normal(size=(7, 4, 5)).astype(np.float32)
    first = scoring.Embedded(ids, [len(row) for row in ids], emb, w)
    assert len(first.looked) == (4 if len(np.unique(ids)) < scoring.PAIRED else 7)
    for i, row in enumerate(ids):
        got = np.concatenate([x.copy() for x in first.blocks(i, len(row))])
        assert np.allclose(np.maximum(got, 0), scoring.conv1d(emb[row][None], w, np.zeros(5))[0], atol=1e-4)


def test_images_of_equal_rows_take_few():
    """Images whose rows are all the same have the features that all their rows give; a batch may hold both kinds."""
    rng = np.random.default_rng(5)
    p = scoring.seeded("screenshot_cnn")["image"]
    p = {k: (w, rng.normal(size=b.shape).astype(np.float32)) for k, (w, b) in p.items()}
    x = rng.normal(size=(3, 3, 64, 64)).astype(np.float32)
    x[0], x[2] = x[0, :, :1], 0
    got, nhwc = scoring._image(x.reshape(3, -1), p), x.transpose(0, 2, 3, 1)
    assert np.allclose(got, scoring._images(nhwc, p, False), atol=1e-5) and np.allclose(got[::2], scoring._images(nhwc[::2, [0] * 3], p, True), atol=1e-5)
    for k in range(4):
        (w, b), wide = p[f"conv{k}"], np.pad(nhwc, ((0, 0), (1, 1), (1, 1), (0, 0)))
        h = nhwc.shape[1]
        nhwc = np.maximum(sum(wide[:, i : i + h, j : j + h] @ w[i, j] for i in range(3) for j in range(3)) + b, 0)
        nhwc = nhwc.reshape(3, h // 2, 2, h // 2, 2, -1).max(axis=(2, 4)) if k < 3 else nhwc
    assert np.allclose(got, nhwc.mean(axis=(1, 2)), atol=1e-4)


@pytest.mark.parametrize("used", [0, 1, 37, 150, 200])
def test_padding_left_out_changes_no_maximum(used):
    rng = np.random.default_rng(used)
    ids = rng.integers(1, 128, (3, 203))
    ids[:, used:] = 0
    ids[1, used // 2 :] = 0
    emb = rng.normal(size=(128, 8)).astype(np.float32)  # also with a padding that isn't 0
    w1, w2, b1, b2 = rng.normal(size=(5, 8, 6)), rng.normal(size=(5, 6, 7)), rng.normal(size=6), rng.normal(size=7)
    for pool, f in ((2, scoring._deep), (4, scoring._html)):
        whole = scoring.conv1d(scoring.pool1d(scoring.conv1d(emb[ids], w1, b1), pool), w2, b2).max(axis=1)
        assert np.allclose(f(ids, {"emb": emb, "conv1": (w1, b1), "conv2": (w2, b2)}), whole, atol=1e-4)
    assert np.allclose(scoring._url(ids, {"emb": emb, "conv": (w1, b1)}), scoring.conv1d(emb[ids], w1, b1).max(axis=1), atol=1e-4)
    assert used > 150 or scoring.unpadded(ids, 5, 2).shape[1] < 203


def test_late_events_are_dropped(spark, tmp_path):
    from tidewatch.streaming import streams

    for i, stamps in enumerate((["10:00", "10:05"], ["11:30"], ["11:31"], ["10:01", "11:32"])):
        spark.createDataFrame([(f"2026-01-01 {t}:00", "a") for t in stamps], "t string, event_type string").select(F.col("t").cast("timestamp").alias("ts"), "event_type", F.lit(1.0).alias("value")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        for f in (tmp_path / "in" / str(i)).glob("part-*"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of their times
    stream = streams.events(spark, f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/0").schema)
    streams.run_once(streams.tumbling(stream, "10 minutes", "5 minutes"), f"{tmp_path}/out", f"{tmp_path}/check")
    got = {r.start.strftime("%H:%M"): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["10:00"] == 2
    streams.run_once(streams.first_seen(stream.select("event_type", "ts"), "event_type", "1 hour"), f"{tmp_path}/out2", f"{tmp_path}/check2")
    assert spark.read.parquet(f"{tmp_path}/out2").count() >= 1


def test_hosts_beyond_plain_names(spark):
    from tidewatch.plans import url_queries

    hosts = dict(zip(url_queries.ODD_HOSTS, url_queries.ODD_RESULTS, strict=True))
    want = [(f"http://{r}/p", None) if r not in ("", "!") else (None, "unsafe_hostname" if not r else "invalid_url") for r in hosts.values()]
    assert [tuple(x) for x in column(spark, [f"http://{h}/p" for h in hosts], url.normalise)] == want


def test_page_tokens_by_event():
    page = "<!-- <a href='x'> --><FORM action='https://Evil.example/login?x=1' data-x=1><input type=password name='p w'><script>if (a < b) alert('<b>no')</script>Tom &amp; Ann < 3<br/></form><style>p{}"
    assert html.visible(page).split() == "tag_form attr_action_https_//evil.example/login_x_1 action_domain_evil.example tag_input attr_type_password attr_name_p_w tom & ann < 3 tag_br".split()
    assert html.visible(page, False) == "attr_action_https_//evil.example/login_x_1 action_domain_evil.example attr_type_password attr_name_p_w tom & ann < 3"
    assert html.visible(None) == html.visible("") == "" and html.visible("<p" * 50) == ""
