"""First-wins deduplication, seen sets, ids and deterministic samples. Order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import ranked, running


def against_seen(rows: DataFrame, seen: DataFrame, key: str = "url", ord_col: str = "ord") -> DataFrame:
    """``rows`` with ``outcome``: duplicate_seen, duplicate_batch or accepted (the first of its key)."""
    known = seen.select(F.col(key).alias("_seen")).distinct()
    marked = rows.join(known, F.col(key) == F.col("_seen"), "left")
    first = F.row_number().over(Window.partitionBy(key).orderBy(ord_col)) == 1
    return marked.withColumn("outcome", F.when(F.col("_seen").isNotNull(), "duplicate_seen").when(~first, "duplicate_batch").otherwise("accepted")).drop("_seen")


def conflicting_labels(rows: DataFrame, key: str = "url", label: str = "label", ord_col: str = "ord") -> DataFrame:
    """The first row of a key is accepted; later ones are duplicates, or conflicts if their label is another."""
    w = Window.partitionBy(key).orderBy(ord_col)
    first = F.first(label).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("outcome", F.when(F.row_number().over(w) == 1, "accepted").when(F.col(label) == first, "duplicate_input_url").otherwise("conflicting_input_label"))


def merge_new(old: DataFrame, new: DataFrame, keys: list[str], ord_col: str) -> DataFrame:
    """Rows of ``new`` whose key is neither in ``old`` nor earlier in ``new``, after those of ``old``."""
    fresh = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(ord_col))).where("_rn = 1").drop("_rn")
    return old.unionByName(fresh.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def sample_ids(rows: DataFrame, used: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Each row takes its label's smallest unused positive number, in order. ``used``: (label, number).

    A used number u of rank r among its label's has u - r free numbers below it, so the k-th row's number is k and the used
    numbers with u - r < k: a running sum over rows and used numbers together. Equal ``ord`` of a label take numbers in any order.
    """
    places = ranked(used.where("number > 0").select("label", "number").distinct(), ["label"], [F.col("number")], "_r")
    skips = places.groupBy("label", (2 * (F.col("number") - F.col("_r")) + 1).alias("_at")).agg(F.count("*").alias("_skip"))
    order = ranked(rows.select("label", F.col(ord_col).alias("_ord")), ["label"], [F.col("_ord")], "_k")
    both = order.select("label", "_ord", "_k", (2 * F.col("_k")).alias("_at"), F.lit(0).cast("bigint").alias("_skip")).unionByName(skips, allowMissingColumns=True)
    numbered = running(both, ["label"], [F.col("_at")], {"_skipped": F.col("_skip")}).where("_k is not null")
    numbered = numbered.select(F.col("label").alias("_label"), "_ord", (F.col("_k") + F.col("_skipped")).cast("bigint").alias("number"))
    number = F.col("number")
    digits = F.when(number < 100000, F.lpad(number.cast("string"), 5, "0")).otherwise(number.cast("string"))
    name = F.concat(F.when(F.col("label") == 0, "L").otherwise("P"), digits, F.when(F.col("label") == 0, "_legitimate").otherwise("_phishing"))
    return rows.join(numbered, F.col("label").eqNullSafe(F.col("_label")) & F.col(ord_col).eqNullSafe(F.col("_ord"))).select(*rows.columns, "number", name.alias("sample_id"))


def shuffled(key: Column, seed: int = 42) -> Column:
    """TK7: an order that a seed decides, the same in every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified(rows: DataFrame, label: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """TK9: ``split`` is ``val`` for the first share of each label in the seeded order, else ``train``."""
    placed = ranked(rows.withColumn("_o", shuffled(F.col(key), seed)), [label], [F.col("_o"), F.col(key)], "_rank")
    sizes = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_size"))
    split = F.when(F.col("_rank") <= F.floor(F.col("_size") * share + 0.5), "val").otherwise("train")
    return placed.join(sizes, F.col(label).eqNullSafe(F.col("_label"))).select(*rows.columns, split.alias("split"))


def build_candidates(phishing: DataFrame, legitimate: DataFrame, seen: DataFrame, n_phishing: int, n_legitimate: int, seed: int = 42) -> DataFrame:
    """Shuffle and cap each pool, then drop what was seen and what repeats: (url, label, source, ord, outcome)."""

    def capped(pool: DataFrame, n: int) -> DataFrame:
        return pool.withColumn("_o", shuffled(F.concat_ws("|", "url", F.col("n").cast("string")), seed)).orderBy("_o", "n").limit(n)

    pools = capped(phishing, n_phishing).withColumn("_p", F.lit(0)).unionByName(capped(legitimate, n_legitimate).withColumn("_p", F.lit(1)))
    return against_seen(pools.withColumn("ord", F.struct("_p", "_o", "n")), seen).select("url", "label", "source", "outcome")
