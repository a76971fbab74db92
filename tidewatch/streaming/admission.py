"""Admission of a stream of captures: ordered, with quotas, exactly once over a checkpoint.

Each micro-batch is decided by the rounds of ``operators.admission`` against what the batches before it claimed. The state is three tables with a folder
for each batch: ``outcomes``, ``claims`` (what accepted rows hold) and ``progress`` (one row: counts, whether the quotas are filled). A batch reads only folders of
smaller numbers and replaces its own, and the checkpoint gives a batch that is run again the same rows; so a job that is
killed anywhere goes on with the rows that one run would have given. The order is that of batches, then of ``ord``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission

OUTCOMES = "ord bigint, label int, url string, outcome string"
CLAIMS = "kind string, key string"
PROGRESS = "tried bigint, accepted map<int,bigint>, rejected bigint, complete boolean"


def _before(spark: SparkSession, to: str, name: str, schema: str, batch: int) -> DataFrame:
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{to}/{name}").where(F.col("batch") < batch)


def _put(df: DataFrame, to: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{to}/{name}/batch={batch}")


def _begin(spark: SparkSession, to: str) -> None:
    """Empty first folders, so that every batch can read what is before it."""
    for name, schema in (("outcomes", OUTCOMES), ("claims", CLAIMS), ("progress", PROGRESS)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{to}/{name}/batch=-1")


def decide(batch: DataFrame, number: int, to: str, quotas: dict[int, int], radius: int = admission.RADIUS, max_candidates: int = 0) -> None:
    """One micro-batch of prepared captures (see operators.admission.prepared)."""
    spark = batch.sparkSession
    done = _before(spark, to, "outcomes", OUTCOMES, number)
    counts = {(r.label, r.ok): r["count"] for r in done.groupBy("label", (F.col("outcome") == "accepted").alias("ok")).count().collect()}  # two rows for each label
    left = {y: n - counts.get((y, True), 0) for y, n in quotas.items()}
    tried = sum(counts.values())
    rows = batch.select("ord", "label", "url", "final_url", "html_hash", "dhash", *(c for c in batch.columns if c in (*admission.FLAGS, *admission.FAULTS)))
    room = max_candidates - tried if max_candidates else 0
    if max_candidates and room <= 0 or not any(n > 0 for n in left.values()):
        out, claims = spark.createDataFrame([], OUTCOMES), spark.createDataFrame([], CLAIMS)
    else:
        made = admission.admit(rows, left, radius, room, _before(spark, to, "claims", CLAIMS, number), done.select("url", "label"))
        out = made.join(rows.select("ord", "url"), "ord").select("ord", "label", "url", "outcome")
    _put(out, to, "outcomes", number)
    out = spark.read.schema(OUTCOMES).parquet(f"{to}/outcomes/batch={number}")
    if out.isEmpty():
        claims = spark.createDataFrame([], CLAIMS)
    else:
        claims = admission.held(rows.join(out.where("outcome = 'accepted'").select("ord"), "ord", "left_semi")).select("kind", "key")
    _put(claims, to, "claims", number)
    every = done.select("label", "outcome").unionByName(out.select("label", "outcome"))
    yes = F.col("outcome") == "accepted"
    by_label = every.groupBy("label").agg(F.count("*").alias("n"), F.count_if(yes).alias("ok"))
    full = by_label.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tried"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "ok")))).alias("accepted"), F.coalesce(F.sum(F.col("n") - F.col("ok")), F.lit(0)).alias("rejected"))
    complete = [F.coalesce(F.col("accepted")[y], F.lit(0)) >= n for y, n in quotas.items()]
    _put(full.withColumn("complete", F.forall(F.array(*complete), lambda x: x) if complete else F.lit(True)), to, "progress", number)


def run(stream: DataFrame, to: str, checkpoint: str, quotas: dict[int, int], radius: int = admission.RADIUS, max_candidates: int = 0) -> None:
    """ST1, ST2, SNK6: all captures that are there, then the end; a later run goes on, also after a kill."""
    _begin(stream.sparkSession, to)

    def one(batch: DataFrame, number: int) -> None:
        decide(batch, number, to, quotas, radius, max_candidates)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def outcomes(spark: SparkSession, to: str) -> DataFrame:
    """(ord, label, url, outcome, batch) of every row reached."""
    return spark.read.schema(f"{OUTCOMES}, batch bigint").parquet(f"{to}/outcomes").where("batch >= 0")


def progress(spark: SparkSession, to: str) -> DataFrame:
    """(tried, accepted, rejected, complete, batch): what stood after each batch."""
    return spark.read.schema(f"{PROGRESS}, batch bigint").parquet(f"{to}/progress").where("batch >= 0")
