"""Streams run to their end over the events, with the same result as a batch; relational checks over the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from ..streaming import streams
from .views import table


def scratch(s: SparkSession) -> str:
    """A new folder for sinks and checkpoints in the shared folder."""
    return shared.new_path(s, "stream")


def source(s: SparkSession, d: str) -> DataFrame:
    return streams.events(s, f"{d}/[e]vents.parquet", table(s, d, "events").schema)


def _run(s: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Everything that is there, through a stream, into a table."""
    to = scratch(s)
    if mode == "append":
        streams.run_once(stream, f"{to}/out", f"{to}/checkpoint")
        return s.read.schema(stream.schema).parquet(f"{to}/out")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/out")

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{to}/out")


def _plain_ts(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_tumbling(s, d):
    return _plain_ts(_run(s, streams.tumbling(source(s, d), "1 hour"), "complete"))


def stream_sliding(s, d):
    return _plain_ts(_run(s, streams.sliding(source(s, d), "2 hours", "1 hour").select("start", "n"), "complete"))


def stream_sessions(s, d):
    return _plain_ts(_run(s, streams.sessions(source(s, d), "30 minutes"), "complete"))


def stream_first_seen(s, d):
    return _run(s, streams.first_seen(source(s, d).select("user_id", "event_type"), "event_type").select("event_type"), "append")


def prediction_log(s, d):
    to = scratch(s)
    scored = source(s, d).select("event_id", (F.col("value") > 50).cast("int").alias("label"))
    streams.prediction_log(scored, f"{to}/log", f"{to}/checkpoint")
    return s.read.parquet(f"{to}/log").select("event_id", "label")


def event_props(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def revenue_by_nation(s, d):
    """A relational check: three joins and a sum; Spark picks the strategies by size."""
    o, c, l = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "lineitem")
    n = table(s, d, "nation").select("n_nationkey", "n_name")
    per = l.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("r"))
    out = per.join(o.select("o_orderkey", "o_custkey"), per.l_orderkey == o.o_orderkey).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return out.groupBy("n_name").agg(F.sum("r").cast("double").alias("revenue"), F.count("*").alias("orders"))


SQL = {
    "stream_tumbling": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "WITH b AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS h FROM events), w AS (SELECT h AS start FROM b UNION ALL SELECT h - INTERVAL '1 hour' FROM b) SELECT start, count(*) AS n FROM w GROUP BY 1",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, k""",
    "stream_first_seen": "SELECT DISTINCT event_type FROM events",
    "prediction_log": "SELECT event_id, CAST(value > 50 AS INT) AS label FROM events",
    "event_props": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "revenue_by_nation": "WITH per AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS r FROM lineitem GROUP BY 1) SELECT n_name, CAST(sum(r) AS DOUBLE) AS revenue, count(*) AS orders FROM per JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_sessions, stream_first_seen, prediction_log, event_props, revenue_by_nation)}
