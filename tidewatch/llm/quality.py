"""Quality by hierarchical empirical Bayes: a document classifier's evidence, host and path posteriors.

A logistic classifier of the text's form (shares of letters, symbols, bars, capitals, repeated words and lines ...),
fitted on at most about ``SAMPLE`` labelled rows outside the held-out fold, gives each document its evidence. Hosts
then have a beta prior whose mean and strength are fitted to the spread of the hosts' means (method of moments); a host's
posterior is the prior of its paths, fitted in the same way, so that sparse hosts and paths shrink toward the global rate. A
document's posterior odds are its own odds times its path's odds over the global odds, to the power ``SITE``.

Evidence is summed by (host, path) and then by host, combined before the shuffle, so a hot host is one row a task; only
narrow rows are shuffled, never texts.

Defined results: null and empty texts score as texts without words; a null host or path is a site of its own; without
labelled rows of both classes every score is the share of good labels, or 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append, materialised
from .toxicity import FOLDS, logistic

#: Labelled rows of the fit at most (about); weight of the site's evidence; documents below the threshold are not kept.
SAMPLE, SITE, THRESHOLD = 20_000, 0.5, 0.5
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()")
NAMES = [f"f{i}" for i in range(9)]


def form(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    n, words, lines = max(len(data), 1), data.split(), data.splitlines()
    letters = n - len(data.translate(None, _LETTERS)) if data else 0
    symbols = n - len(data.translate(None, _SYMBOLS)) if data else 0
    upper = sum(map(data.count, (bytes([c]) for c in range(65, 91))))
    different = len(set(words)) / max(len(words), 1)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(len(words) - 1, 1)
    return [letters / n, np.log1p(1000 * symbols / n), np.log1p(1000 * data.count(b"|") / n), upper / n, different, pairs, len(set(lines)) / max(len(lines), 1), np.log1p(len(words)), sum(map(len, words)) / max(len(words), 1) / 10]


def evidence(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """(id_col, *keep, p): the classifier's probability that a document is good."""
    narrow = docs.select(id_col, *keep, F.col(text_col).alias("_text"))
    made = append(narrow, "_text", [(x, "double") for x in NAMES], lambda: lambda texts: list(zip(*map(form, texts), strict=True)) if texts else [[] for _ in NAMES]).drop("_text")
    made = materialised(made, "form")
    known = labels.where("quality is not null").groupBy(F.col("doc_id").alias("_label_id")).agg(F.min("quality").cast("int").alias("_y"))
    known = known.where(F.crc32(F.col("_label_id").cast("string")) % FOLDS != 0)
    n = known.count()
    few = known.where(F.pmod(F.xxhash64("_label_id"), F.lit(1_000_000)) < int(min(1.0, SAMPLE / max(n, 1)) * 1_000_000))
    rows = made.join(few, made[id_col] == F.col("_label_id")).select(*NAMES, "_y").collect()
    y = np.array([r["_y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return made.select(id_col, *keep, F.lit(float(y.mean()) if len(y) else 0.5).alias("p"))
    x = np.array([r[:-1] for r in rows], float)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    w = logistic(np.concatenate([np.ones((len(x), 1)), (x - mean) / spread], axis=1), (y > 0).astype(float), ridge=1.0)
    z: Column = F.lit(float(w[0]))
    for name, a, m, s in zip(NAMES, w[1:], mean, spread, strict=True):
        z = z + float(a) * F.least(F.lit(8.0), F.greatest(F.lit(-8.0), (F.col(name) - float(m)) / float(s)))
    return made.select(id_col, *keep, (1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), z))))).alias("p"))


def strength(groups: DataFrame, prior: str) -> float:
    """Pseudo-counts of the beta prior with means ``prior``, by moments of the groups' means (n, s, ss)."""
    m = F.col("s") / F.col("n")
    r = groups.where("n > 1").agg(F.sum("n"), F.sum(F.col("n") * (m - F.col(prior)) ** 2), F.sum(F.col("ss") - F.col("s") * m), F.sum(F.col("n") - 1), F.count("*"), F.sum(F.col("n") * F.col(prior) * (1 - F.col(prior)))).first()
    if not r[4] or not r[3]:
        return 100.0
    within = r[2] / r[3]  # variance of the evidence in a group
    between = max(r[1] / r[0] - within * r[4] / r[0], 1e-9)
    return float(np.clip(r[5] / r[0] / between, 1.0, 1e5))


def posteriors(rows: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, site): posterior means of the paths, and the global mean, from (host, path, p)."""
    paths = materialised(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") ** 2).alias("ss")), "paths")
    hosts = paths.groupBy("host").agg(*(F.sum(x).alias(x) for x in ("n", "s", "ss")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = float(np.clip((total.s or 0) / max(total.n or 0, 1), 1e-3, 1 - 1e-3))
    hosts = hosts.withColumn("prior", F.lit(rate))
    k = strength(hosts, "prior")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + k * rate) / (F.col("n") + k)).alias("prior"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k = strength(paths, "prior")
    return paths.select("host", "path", ((F.col("s") + k * F.col("prior")) / (F.col("n") + k)).alias("site")), rate


def scored(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", site_weight: float = SITE) -> DataFrame:
    """(id_col, host, path, p, site, score): score is the posterior probability that a document is good."""
    rows = evidence(docs.withColumns({"host": host.cast("string"), "path": path.cast("string")}).select(id_col, text_col, "host", "path"), labels, id_col, text_col, ["host", "path"])
    rows = materialised(rows, "evidence")
    sites, rate = posteriors(rows)
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "site")
    odds = lambda p: F.log(p / (1 - p))
    inside = lambda p: F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), p))
    z = odds(inside(F.col("p"))) + site_weight * (odds(inside(F.col("site"))) - float(np.log(rate / (1 - rate))))
    out = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    return out.select(id_col, "host", "path", "p", "site", (1 / (1 + F.exp(-z))).alias("score"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Hosts are the documents' sources, and paths their languages within a source."""
    out = scored(docs.select("doc_id", "text", "source", "lang"), labels, F.col("source"), F.col("lang"))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0).alias("held_out"), F.col("p").alias("evidence"), "site", "score", (F.col("score") >= THRESHOLD).alias("kept"))
