"""What a training corpus holds, as one table (kind, key), and what of a batch is found in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import fingerprint
from ..functions.url import hostname, normalise
from . import hamming

TRAINING = ("train", "trainval", "training")
VERSION = 1


def index(corpus: DataFrame) -> DataFrame:
    """AG13: different keys of a corpus (url, html, label, split): url, html_hash, phishing_domain; screenshot_hash where it has ``dhash``."""
    u = corpus.withColumn("_u", normalise(F.col("url"))["url"])
    urls = u.where("_u is not null").select(F.lit("url").alias("kind"), F.col("_u").alias("key"))
    pages = corpus.where("html is not null").select(F.lit("html_hash").alias("kind"), fingerprint(F.col("html")).alias("key"))
    domains = u.where((F.col("label") == 1) & F.lower(F.trim("split")).isin(*TRAINING) & F.col("_u").isNotNull()).select(F.lit("phishing_domain").alias("kind"), hostname(F.col("_u")).alias("key"))
    every = urls.unionByName(pages).unionByName(domains)
    if "dhash" in corpus.columns:
        every = every.unionByName(corpus.where("dhash is not null").select(F.lit("screenshot_hash").alias("kind"), hamming.to_hex(F.col("dhash")).alias("key")))
    return every.distinct()


def claimed(accepted: DataFrame) -> DataFrame:
    """(kind, key) of what samples accepted before hold: both URLs, the page's hash, the screenshot's (16 hex digits)."""
    kinds = {"normalized_original_url": "url", "normalized_final_url": "url", "html_sha256": "html_hash", "screenshot_dhash": "screenshot_hash"}
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key")) for c, k in kinds.items() if c in accepted.columns))
    return accepted.select(F.inline(keys)).where("coalesce(key, '') <> ''").distinct()


def stats(corpus: DataFrame) -> DataFrame:
    """Counters of rows, not of different keys: (stat, n)."""
    u = corpus.withColumn("_e", normalise(F.col("url"))["error"])
    stat = F.explode(F.array(F.when(F.col("_e").isNull(), "urls").otherwise("url_errors"), F.when(F.col("html").isNull(), "missing_html").otherwise("html"), *([F.when(F.col("dhash").isNull(), "missing_screenshots").otherwise("screenshots")] if "dhash" in corpus.columns else [])))
    return u.select(stat.alias("stat")).groupBy("stat").agg(F.count("*").alias("n"))


def probe(batch: DataFrame, known: DataFrame) -> DataFrame:
    """``batch`` (url, html_hash, domain, label) with a flag for each kind of key, near screenshots too where it has ``dhash``."""
    given = batch
    for kind, key in (("url", "url"), ("html_hash", "html_hash"), ("phishing_domain", "domain")):
        keys = known.where(F.col("kind") == kind).select(F.col("key").alias(f"_{kind}"))
        batch = batch.join(keys, F.col(key) == F.col(f"_{kind}"), "left").withColumn(f"in_{kind}", F.col(f"_{kind}").isNotNull().cast("int")).drop(f"_{kind}")
    if "dhash" in batch.columns:
        shots = known.where("kind = 'screenshot_hash'").select(hamming.from_hex(F.col("key")).alias("hb"))
        near = hamming.near_any(given.select(F.col("dhash").alias("ha")), shots).withColumnRenamed("ha", "_shot")
        batch = batch.join(near, F.col("dhash") == F.col("_shot"), "left").withColumn("in_screenshot_hash", F.col("_shot").isNotNull().cast("int")).drop("_shot")
    return batch


def as_json(known: DataFrame, counters: DataFrame) -> DataFrame:
    """SNK13: one row of JSON: version, sorted keys by kind, stats."""
    keys = known.groupBy("kind").agg(F.array_sort(F.collect_list("key")).alias("v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "v")))).alias("keys"))
    n = counters.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stat", "n")))).alias("stats"))
    return keys.crossJoin(n).select(F.to_json(F.struct(F.lit(VERSION).alias("version"), "keys", "stats")).alias("json"))


def from_json(text: DataFrame) -> DataFrame:
    """SRC16: the index of a cached JSON; another version raises."""
    x = F.from_json("json", "version int, keys map<string,array<string>>")
    checked = F.when(x["version"] == VERSION, x["keys"]).otherwise(F.raise_error(F.lit("unsupported version of the leakage index")).cast("map<string,array<string>>"))
    return text.select(F.explode(checked).alias("kind", "v")).select("kind", F.explode("v").alias("key"))
