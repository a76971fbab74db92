"""Derived inputs: the same SQL text runs in Spark and in DuckDB, so queries and their oracles start from equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PAGES_X = """
SELECT page_id,
  CASE page_id % 16
    WHEN 1 THEN concat('http://192.168.1.', CAST(page_id % 250 AS STRING), '/login')
    WHEN 2 THEN concat('https://paypal-login.secure-id.xyz/verify/account?id=', CAST(page_id AS STRING))
    WHEN 3 THEN concat('https://bit.ly/', CAST(page_id AS STRING))
    WHEN 4 THEN concat(split_part(split_part(url,'#',1),'?',1), '?next=https://evil.example.top/login')
    WHEN 5 THEN concat('https://trezor-suite-', CAST(page_id AS STRING), '.vercel.app/wallet')
    WHEN 6 THEN concat('https://xn--pypal-4ve.com/', CAST(page_id AS STRING))
    WHEN 7 THEN concat('https://user@bank.example.com:8443/secure%20update/', CAST(page_id AS STRING))
    WHEN 8 THEN concat('https://a1b2c3d4e5f6g7h8i9j0', CAST(page_id AS STRING), '.github.io/')
    WHEN 9 THEN concat('HTTPS://Example.COM:443/Login/', CAST(page_id AS STRING), '/#top')
    WHEN 10 THEN concat('https://www.example.com/dup/', CAST(page_id % 5 AS STRING))
    WHEN 11 THEN concat('example.com/no-scheme/', CAST(page_id AS STRING))
    WHEN 12 THEN concat('ftp://example.com/', CAST(page_id AS STRING))
    WHEN 13 THEN ''
    WHEN 14 THEN concat('http://localhost:8080/', CAST(page_id AS STRING))
    WHEN 15 THEN concat(split_part(split_part(url,'#',1),'?',1), '/')
    ELSE url END AS url,
  CASE page_id % 13
    WHEN 1 THEN concat('<form action="https://evil.example/login"><input name="email"><input type="password" placeholder="Password"></form>', html)
    WHEN 2 THEN concat('<meta http-equiv="refresh" content="0;url=https://x.test/">', html)
    WHEN 3 THEN concat('<script>window.location="https://x.test/"</script>', html)
    WHEN 4 THEN concat('<iframe src="https://x.test/"></iframe><iframe src="/y"></iframe>', html)
    WHEN 5 THEN concat('<a href="https://other.test/reset">Verify wallet</a>', html)
    WHEN 6 THEN concat('<html><h1>Installation Error</h1></html>', CAST(page_id AS STRING), html)
    WHEN 7 THEN concat('<p>', CAST(page_id AS STRING), '</p>')
    WHEN 8 THEN concat('<html><h1>404  Not', chr(10), 'Found</h1></html>', html)
    WHEN 9 THEN concat('<p>a', chr(13), chr(10), 'b</p>', repeat('x', 120))
    WHEN 10 THEN concat('<p>a', chr(10), 'b</p>', repeat('x', 120))
    WHEN 11 THEN ''
    ELSE html END AS html,
  CASE WHEN page_id % 23 = 5 THEN 404 ELSE 200 END AS status,
  CASE WHEN page_id % 29 = 7 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
  CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS label
FROM {pages}"""

PREDICTIONS_X = """
SELECT d.doc_id, concat('scorer_', CAST(m.m AS STRING)) AS model, d.source, 1 - l.quality AS true_label,
  (((d.doc_id * 7919 + m.m * 104729) % 40) / 4e1) * (1e0 - m.m / 2e1) + (1 - l.quality) * (m.m / 2e1) AS p
FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id
CROSS JOIN (SELECT 1 AS m UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) m"""


def pages_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with many shapes of URLs and markup, statuses, content types and labels."""
    return shaped(table(spark, sf_dir, "pages"))


def shaped(pages: DataFrame) -> DataFrame:
    """The same of a table or stream of pages."""
    return pages.sparkSession.sql(PAGES_X, pages=pages)


def predictions_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six synthetic scorers over the labelled documents."""
    return spark.sql(PREDICTIONS_X, labels=table(spark, sf_dir, "labels"), documents=table(spark, sf_dir, "documents").select("doc_id", "source"))


#: For oracles: WITH clauses.
WITH_PAGES = f"pages_x AS ({PAGES_X.format(pages='pages')})"
WITH_PREDICTIONS = f"predictions_x AS ({PREDICTIONS_X.format(labels='labels', documents='documents')})"
