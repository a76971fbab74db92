"""Ordered greedy admission with quotas and mutual exclusion, by rounds of joins.

Taken one by one, a row is rejected if an earlier accepted row holds one of its URLs, its page or a screenshot near to its own; a
row beyond its label's quota is neither tried nor remembered. The same result is found without going row by row:

* Rows that fail a check of their own can never be accepted, so only the others compete. In a round each key tells the
  first undecided row that holds it, or holds a near screenshot; a row that is first at all its keys is accepted, and
  undecided rows that share a key with it are rejected. Other rows wait. A key that very many rows share is decided at once; the rounds are as many as the longest
  chain of rows of which each waits for the one before.
* Quotas are counts over accepted rows in order. Up to the row that fills the first quota nothing was skipped, so this
  much is final; the rest is decided again without that label.
* Rows are taken in windows that grow, so a filled quota ends the work early and what is accepted clears later windows before pairs of near screenshots are made in them.

``ord`` tells rows apart. Null keys hold nothing and equal nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import error_signature, fingerprint
from ..functions.url import normalise
from ..sources.shared import dropped, written
from . import hamming
from .prefix import ranked

MIN_HTML, RADIUS = 100, 5
#: Rows of the first window, and how many times as many the next one has.
WINDOW, GROWTH = 4096, 8


def stateless_reason(final_error: Column, min_html: int = MIN_HTML, before: bool = True) -> Column:
    """PF2: the first failure of what comes before the check of final URLs, or of what comes after it."""
    signature = error_signature(F.col("html"))
    if before:
        return F.coalesce(final_error, F.when(F.col("status") >= 400, F.concat(F.lit("http_status_"), F.col("status").cast("string"))), F.when((F.col("content_type") != "") & ~F.contains(F.lower(F.col("content_type")), F.lit("html")), F.lit("non_html_content_type")))
    return F.coalesce(F.when(F.length("html") < min_html, F.lit("html_too_short")), F.when(signature.isNotNull(), F.concat(F.lit("error_page:"), signature)))


def prepared(rows: DataFrame, min_html: int = MIN_HTML) -> DataFrame:
    """(ord, label, url, final_url, html_hash, dhash, early, late) of captures (ord, label, url, final_url, html, ...)."""
    final = normalise(F.col("final_url"))
    return rows.withColumn("_f", final).select("ord", "label", normalise(F.col("url"))["url"].alias("url"), F.col("_f.url").alias("final_url"), fingerprint(F.col("html")).alias("html_hash"), "dhash", stateless_reason(F.col("_f.error"), min_html).alias("early"), stateless_reason(F.col("_f.error"), min_html, False).alias("late"))


#: What the caller found before the admission: flags (1: held by training data or by samples accepted before) and faults.
FLAGS = ("in_final_url", "in_html_hash", "in_screenshot_hash")
FAULTS = ("early", "late", "shot_error", "last")


#: The order of what came before all rows.
BEFORE = -(1 << 63)


def held(rows: DataFrame) -> DataFrame:
    """(ord, kind, key): what each row holds if it is accepted: u for both URLs, h for its page, s for its screenshot."""
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key")) for k, c in (("u", "url"), ("u", "final_url"), ("h", "html_hash"), ("s", "dhash"))))
    return rows.select("ord", F.inline(F.array_distinct(keys))).where("key is not null")


def _near(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """(a, b) of different screenshots of two key tables that are near to each other, as keys."""
    shots = lambda keys, c, h: keys.where("kind = 's'").select(F.col("key").cast("bigint").alias(h)).distinct().withColumn(c, F.col(h))
    pairs = hamming.near_pairs(shots(left, "a", "ha"), shots(right, "b", "hb"), radius).where("a <> b")
    return pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))


def _holding(keys: DataFrame, claims: DataFrame, near: DataFrame | None) -> DataFrame:
    """(ord) of the rows of ``keys`` that hold a key of ``claims`` (kind, key), or a screenshot near to one. ``near``: pairs (a of claims, b of keys)."""
    if near is not None:
        shots = claims.where("kind = 's'").join(near, F.col("key") == F.col("a"), "inner").select("kind", F.col("b").alias("key"))
        claims = claims.select("kind", "key").unionByName(shots)
    return keys.join(claims.select("kind", "key"), ["kind", "key"], "left_semi").select("ord").distinct()


def first_free(keys: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(ord) of the rows that taking all in order accepts, of ``keys`` (ord, kind, key), without quotas."""
    left, near, taken = written(keys, "undecided"), None, []
    if not left.where("kind = 's'").isEmpty():
        near = written(_near(left, left, radius), "near")
    while not left.isEmpty():
        first = left.groupBy("kind", "key").agg(F.min("ord").alias("first"))
        if near is not None:
            reached = first.where("kind = 's'").join(near, F.col("key") == F.col("a")).select("kind", F.col("b").alias("key"), "first")
            first = first.unionByName(reached).groupBy("kind", "key").agg(F.min("first").alias("first"))
        first = written(first, "first")  # a plain table: the planner can split a key that very many rows hold
        now = written(left.join(first, ["kind", "key"]).groupBy("ord").agg(F.min("first").alias("first")).where("first = ord").select("ord"), "taken")
        claimed = left.join(now, "ord", "left_semi").select("kind", "key")
        rest = written(left.join(_holding(left, claimed, near), "ord", "left_anti"), "undecided")
        dropped(left, first)
        left = rest
        taken.append(now)
    out = taken[0] if taken else keys.select("ord").where("false")
    for x in taken[1:]:
        out = out.unionByName(x)
    return out


def _fill(rows: DataFrame, quotas: dict[int, int], radius: int, claims: DataFrame | None) -> tuple[DataFrame | None, dict[int, int]]:
    """The keys (ord, kind, key) of all accepted rows, and for each label whose quota is filled the ``ord`` that fills it.

    ``rows`` (ord, place, label, able, keys' columns), ``place`` counting from 1 in order. ``claims`` are held before.
    """
    left, filled = dict(quotas), {}
    total = rows.agg(F.max("place")).first()[0] or 0
    at, size = 0, WINDOW
    while at < total and left:
        upto = at + size
        window = rows.where((F.col("place") > at) & (F.col("place") <= upto) & F.col("label").isin(*left) & F.col("able"))
        keys = held(window)
        if claims is not None:
            near = None if claims.where("kind = 's'").isEmpty() else _near(claims, keys, radius)
            keys = keys.join(_holding(keys, claims, near), "ord", "left_anti")
        taken = written(rows.select("ord", "place", "label").join(first_free(keys, radius), "ord", "left_semi"), "accepted")
        counts = dict(taken.groupBy("label").count().collect())  # a row for each label of the quotas
        over = [y for y, n in counts.items() if n >= left[y]]
        cut = None
        if over:
            full = ranked(taken.where(F.col("label").isin(*over)), ["label"], [F.col("ord")], "k")
            want = F.create_map(*(F.lit(x) for y in over for x in (y, left[y])))
            ends = full.where(F.col("k") == want[F.col("label")]).select("place", "ord", "label").collect()  # a row for each full label
            cut = min(ends)
            taken = taken.where(F.col("ord") <= cut.ord)
            counts = dict(taken.groupBy("label").count().collect())
        for y, n in counts.items():
            left[y] -= n
        new = held(rows.join(taken, "ord", "left_semi"))
        claims = written(new if claims is None else claims.unionByName(new), "claims")
        if cut is not None:
            filled[cut.label] = cut.ord
            del left[cut.label]
            at = cut.place
        else:
            at, size = upto, size * GROWTH
    return claims, filled


def admit(rows: DataFrame, quotas: dict[int, int], radius: int = RADIUS, max_candidates: int = 0, claims: DataFrame | None = None, attempted: DataFrame | None = None) -> DataFrame:
    """ST1, W6: (ord, label, outcome) of every row reached: ``accepted`` or the reason of its rejection.

    Rows may have the flags and faults of ``FLAGS`` and ``FAULTS``, each tested at its place in the order of the checks.
    A URL is tried once for each label; rows after the last open quota, or after ``max_candidates`` tried ones, aren't reached.
    What came before all rows: ``claims`` (kind, key), what accepted rows hold (see ``held``), and ``attempted`` (url, label).
    """
    quotas = {y: n for y, n in quotas.items() if n > 0}
    given = {c: F.col(c) if c in rows.columns else F.lit(None) for c in (*FLAGS, *FAULTS)}
    rows = rows.select("ord", F.col("label").cast("int").alias("label"), "url", "final_url", "html_hash", F.col("dhash").cast("bigint").alias("dhash"), *(given[c].cast("int").alias(c) for c in FLAGS), *(given[c].cast("string").alias(c) for c in FAULTS))
    rows = written(rows.where(F.col("url").isNotNull() & F.col("label").isin(*quotas)), "candidates")
    if attempted is not None:
        rows = rows.join(attempted.select("url", "label"), ["url", "label"], "left_anti")
    if claims is not None:
        claims = claims.select(F.lit(BEFORE).alias("ord"), "kind", "key").distinct()
    tried = rows.join(rows.groupBy("url", "label").agg(F.min("ord").alias("ord")).select("ord"), "ord", "left_semi")
    able = F.coalesce(*FAULTS).isNull() & ~F.greatest(*(F.coalesce(F.col(c), F.lit(0)) for c in FLAGS)).eqNullSafe(1)
    tried = written(ranked(tried.withColumn("able", able), [], [F.col("ord")], "place"), "tried")
    claims, filled = _fill(tried, quotas, radius, claims)
    if filled:
        end = F.create_map(*(F.lit(x) for kv in filled.items() for x in kv))[F.col("label")]
        tried = tried.where(F.col("ord") <= F.coalesce(end, F.col("ord")))
    if max_candidates:
        tried = ranked(tried.drop("place"), [], [F.col("ord")], "place").where(F.col("place") <= max_candidates)
    return _outcomes(tried, claims, radius)


def _outcomes(tried: DataFrame, claims: DataFrame | None, radius: int) -> DataFrame:
    """The first check that each row fails, given the keys of all accepted rows."""
    claims = claims if claims is not None else held(tried).where("false")
    for name, kind, column in (("_url", "u", "url"), ("_final", "u", "final_url"), ("_page", "h", "html_hash")):
        holder = claims.where(F.col("kind") == kind).select(F.col("key").alias("_key"), F.col("ord").alias("_by"))
        tried = tried.join(holder, F.col(column) == F.col("_key"), "left").withColumn(name, F.coalesce(F.col("_by") < F.col("ord"), F.lit(False))).drop("_key", "_by")
    shots = claims.where("kind = 's'").select(F.col("key").cast("bigint").alias("hb"), "ord")
    pairs = hamming.near_pairs(tried.select(F.col("dhash").alias("a"), F.col("dhash").alias("ha")).where("a is not null").distinct(), shots.select(F.col("ord").alias("b"), "hb"), radius)
    nearest = pairs.groupBy(F.col("a").alias("_shot")).agg(F.min("b").alias("_by"))
    tried = tried.join(nearest, F.col("dhash") == F.col("_shot"), "left").withColumn("_near", F.coalesce(F.col("_by") < F.col("ord"), F.lit(False)))
    found = lambda flag: F.coalesce(F.col(flag) == 1, F.lit(False))
    reason = F.coalesce(
        F.when(F.col("_url"), F.lit("duplicate_original_url")), F.col("early"), F.when(found("in_final_url") | F.col("_final"), F.lit("duplicate_final_url")), F.col("late"),
        F.when(found("in_html_hash") | F.col("_page"), F.lit("duplicate_html")), F.col("shot_error"), F.when(found("in_screenshot_hash") | F.col("_near"), F.lit("duplicate_screenshot")), F.col("last"), F.lit("accepted"),
    )
    return tried.select("ord", "label", reason.alias("outcome"))
