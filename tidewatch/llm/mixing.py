"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating; ``SHARE`` of all words is dealt by weight, a
source stops at ``LIMIT`` times its words and the excess is dealt again by weight (water filling, solved exactly).

Rates: of all document rates between 0 and ``LIMIT`` that meet each source's target, those with the least relative
entropy to one copy each are min(LIMIT, exp(lambda x)), x being the size over the source's token-weighted mean. The dual
of this convex problem has one variable a source; distributed Newton steps, kept inside a shrinking bracket, solve
it. Documents of one source and size have one rate, so a step is a grouped sum over the histogram of sizes, combined
before the shuffle: its rows are bounded by the different sizes, however many documents a source has.

Copies: the fractions of the rates are summed along each source's sizes and rounded where the sum passes a whole, so
the words taken stay within one document of the target; a few corrections then add or drop the copy that brings the source
nearest to it. Which documents of a size get a copy is decided by a hash of the id, ranked within parts of the source and
size of about ``PART`` documents, so that equal texts of a hot source aren't ranked in one task at any scale. Reruns agree.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source; a source without words
has target 0; an empty table gives no rows; repeated rows are ranked as different documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few_or_not, materialised

WEIGHTS, SHARE, LIMIT = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents of a source and size that are ranked together, about.
PART, STEPS, CORRECTIONS = 20_000, 60, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(src, words, words2) with ``target``; one row for each source."""
    every = Window.partitionBy(F.lit(1))
    ranked = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(every.orderBy("src")) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", limit * F.col("words")).withColumn("ratio", F.col("cap") / F.col("w")).withColumn("all", share * F.sum("words").over(every))
    up = every.orderBy("ratio", "src")
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    from_here = F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (F.col("all") - before) / from_here)
    level = level.withColumn("mu", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(every)["level"])
    return level.withColumn("target", F.least("cap", F.coalesce(F.col("mu") * F.col("w"), F.col("cap")))).select("src", "words", "words2", "target")


def solve(sizes: DataFrame, aims: DataFrame, limit: float = LIMIT, steps: int = STEPS) -> DataFrame:
    """``aims`` with ``lam``, the dual variables; ``sizes`` is the histogram (src, size, n)."""
    x, full = F.col("size") / F.col("mean"), F.col("target") >= limit * F.col("words") * (1 - 1e-12)
    state = aims.withColumn("mean", F.greatest(F.col("words2") / F.greatest("words", F.lit(1)), F.lit(1.0)))
    state = state.withColumn("open", (F.col("words") > 0) & (F.col("target") > 0) & ~full)
    state = state.withColumn("lam", F.when(F.col("open"), F.log(F.col("target") / F.col("words"))).when(full, F.lit(math.inf)).otherwise(F.lit(-math.inf)))
    state = materialised(state.withColumn("lo", F.lit(-1e9)).withColumn("hi", F.lit(1e9)).withColumn("off", F.lit(0.0)), "dual")
    for _ in range(steps):
        rate = F.least(F.lit(limit), F.exp(F.col("lam") * x))
        at = sizes.join(state.where("open"), "src").groupBy("src").agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.when(rate < limit, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"))
        new = state.join(at, "src", "left")
        off = F.col("got") - F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.try_divide(off, F.col("slope"))
        middle = F.when(lo < -1e8, hi - F.greatest(F.abs(hi), F.lit(1.0))).when(hi > 1e8, lo + F.greatest(F.abs(lo), F.lit(1.0))).otherwise((lo + hi) / 2)
        lam = F.when((newton > lo) & (newton < hi), newton).otherwise(middle)
        done = F.abs(off) <= 1e-7 * F.col("target") + 1e-6
        moves = F.col("open") & ~done
        new = new.select("src", "words", "words2", "target", "mean", F.coalesce(moves, F.lit(False)).alias("open"), F.when(moves, lam).otherwise(F.col("lam")).alias("lam"), F.when(F.col("open"), lo).otherwise(F.col("lo")).alias("lo"), F.when(F.col("open"), hi).otherwise(F.col("hi")).alias("hi"), F.when(F.col("open"), off).otherwise(F.col("off")).alias("off"))
        state = materialised(new, "dual")
        if not state.where("open").limit(1).count():
            break
    return state


def copies_by_size(sizes: DataFrame, state: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(src, size, n, base, more): each document of the size gets ``base`` copies, and they share ``more`` further ones."""
    rate = F.when(F.col("lam") == math.inf, F.lit(limit)).when(F.col("lam") == -math.inf, F.lit(0.0)).otherwise(F.least(F.lit(limit), F.exp(F.col("lam") * F.col("size") / F.col("mean"))))
    plan = sizes.join(state.select("src", "target", "lam", "mean"), "src").withColumn("rate", rate).withColumn("base", F.floor("rate"))
    along = Window.partitionBy("src").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    part = F.col("n") * (F.col("rate") - F.col("base"))
    plan = plan.withColumn("up", F.floor(F.sum(part).over(along) + 0.5)).withColumn("more", F.least(F.col("n"), F.greatest(F.lit(0), F.col("up") - F.coalesce(F.lag("up").over(Window.partitionBy("src").orderBy("size")), F.lit(0)))))
    plan = materialised(plan.select("src", "size", "n", "base", F.col("more").cast("bigint").alias("more"), "target"), "copies")
    for _ in range(CORRECTIONS):
        short = plan.groupBy("src").agg((F.first("target") - F.sum((F.col("n") * F.col("base") + F.col("more")) * F.col("size"))).alias("short"))
        add, drop = F.col("more") < F.col("n") * (limit - F.col("base")), F.col("more") > 0
        option = lambda ok, sign: F.when(ok & (F.col("size") > 0) & (F.abs(F.col("short") - sign * F.col("size")) < F.abs("short")), F.struct(F.abs(F.col("short") - sign * F.col("size")).alias("left"), F.col("size").alias("best"), F.lit(sign).alias("sign")))
        best = plan.join(short, "src").groupBy("src").agg(F.least(F.min(option(add, 1)), F.min(option(drop, -1))).alias("x")).where("x is not null").select("src", "x.best", "x.sign")
        plan = materialised(plan.join(best, "src", "left").select("src", "size", "n", "base", F.when(F.col("size") == F.col("best"), F.col("more") + F.col("sign")).otherwise(F.col("more")).cast("bigint").alias("more"), "target"), "copies")
    return plan


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc: struct of all columns of ``docs``, size, source_size, target, copies, taken)."""
    row = F.struct(*docs.columns)
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~"))  # null comes last
    luck = F.xxhash64(F.col(id_col))
    rows = docs.select(row.alias("doc"), key.alias("src"), word_count(F.col(text_col)).alias("size"), luck.alias("luck"))
    narrow = materialised(rows.select("src", "size", "luck"), "sizes-of-documents")
    sizes = materialised(narrow.groupBy("src", "size").agg(F.count("*").alias("n")), "sizes")
    hot = few_or_not(sizes.where(F.col("n") > PART).select("src", "size", F.ceil(F.col("n") / PART).alias("parts")))  # fewer than documents / PART
    salted = lambda df: df.join(hot, ["src", "size"], "left").withColumn("salt", F.pmod("luck", F.coalesce("parts", F.lit(1)))).drop("parts")
    parts = materialised(salted(narrow).groupBy("src", "size", "salt").agg(F.count("*").alias("n")), "parts")
    rows = salted(rows)
    totals = sizes.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum((F.col("n") * F.col("size")).cast("double") * F.col("size")).alias("words2"))
    aims = targets(totals)
    state = solve(sizes, aims)
    plan = copies_by_size(sizes, state).select("src", "size", F.col("n").alias("all"), "base", "more").join(state.select("src", "words", "target"), "src")
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("src", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = parts.withColumn("ahead", ahead).join(plan, ["src", "size"]).select("src", "size", "salt", (F.col("more") % F.col("all") - F.col("ahead")).alias("mine"), (F.col("base") + F.floor(F.col("more") / F.col("all"))).alias("base"), "words", "target")
    rank = F.row_number().over(Window.partitionBy("src", "size", "salt").orderBy("luck", F.col(f"doc.{id_col}")))
    placed = rows.withColumn("rank", rank).join(dealt, ["src", "size", "salt"])
    copies = (F.col("base") + (F.col("rank") <= F.col("mine")).cast("bigint")).cast("bigint")
    return placed.select("doc", "size", F.col("words").cast("bigint").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    return mixed(docs, **kw).where("copies > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def query(docs: DataFrame) -> DataFrame:
    return mixed(docs.select("doc_id", "text", "source")).select("doc.doc_id", "size", "source_size", "target", "taken")
