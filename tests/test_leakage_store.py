"""The leakage index that grows by batches."""

from __future__ import annotations

import os
import random

from tidewatch.operators import leakage, leakage_store

BATCH = "i int, url string, html_hash string, domain string, label int, dhash bigint"


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if not f.startswith((".", "_"))}


def some(spark, rng, n):
    kinds = ("url", "html_hash", "phishing_domain", "screenshot_hash")
    key = lambda k: f"{rng.getrandbits(64):016x}" if k == "screenshot_hash" else f"{k}{rng.randint(0, 5000)}"
    rows = [(k, key(k)) for k in (rng.choice(kinds) for _ in range(n))]
    return spark.createDataFrame([*rows, ("url", None)], "kind string, key string")


def test_batches_add_up_and_rewrite_nothing(spark, tmp_path):
    rng, root = random.Random(3), str(tmp_path / "store")
    batches = [some(spark, rng, n) for n in (700, 500, 1)]
    leakage_store.add(batches[0], root, 0)
    before = files(root)
    leakage_store.add(batches[1], root, 1)
    assert {f: t for f, t in files(root).items() if f in before} == before
    for _ in range(2):  # the same batch again gives the same store
        leakage_store.add(batches[2], root, 2)
    pairs = lambda df: sorted(tuple(r) for r in df.collect())
    every = batches[0].union(batches[1]).union(batches[2]).where("key is not null").distinct()
    assert pairs(leakage_store.keys(spark, root).select("kind", "key")) == pairs(every)
    assert pairs(leakage_store.keys(spark, root, 0).select("kind", "key")) == pairs(batches[0].where("key is not null").distinct())

    shots = [int(r.key, 16) - (1 << 64 if int(r.key, 16) >> 63 else 0) for r in every.where("kind = 'screenshot_hash'").collect()]
    rows = [(i, f"url{rng.randint(0, 9000)}", f"html_hash{rng.randint(0, 9000)}", rng.choice([None, f"phishing_domain{rng.randint(0, 9000)}"]), 1, rng.choice([None, rng.choice(shots) ^ 5, rng.getrandbits(62)])) for i in range(400)]
    batch = spark.createDataFrame(rows, BATCH)
    flags = ("i", "in_url", "in_html_hash", "in_phishing_domain", "in_screenshot_hash")
    want = pairs(leakage.probe(batch, every).select(*flags))
    assert pairs(leakage_store.probe(batch, root).select(*flags)) == want and all(any(r[k] for r in want) for k in range(1, 5))


def test_the_filter_excludes_most_and_misses_none(spark, tmp_path):
    rng, root = random.Random(4), str(tmp_path / "store")
    given = some(spark, rng, 2000)
    leakage_store.add(given, root, 7)
    filters = leakage_store.filters(spark, root)
    have = given.where("key is not null").distinct()
    assert leakage_store.may_hold(have, filters).count() == have.count()
    other = spark.range(20000).selectExpr("'url' as kind", "concat('other', id) as key")
    assert leakage_store.may_hold(other, filters).count() < 200
    assert leakage_store.may_hold(other, leakage_store.filters(spark, root, 6)).count() == 0
