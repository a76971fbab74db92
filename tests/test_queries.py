"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest
from pyspark.sql import functions as F

from tidewatch.plans import registry

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"html_tokens", "html_signals", "neural_scores", "logistic_scores", "artefact_scores"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cur = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(ROWS_ONLY - {"logistic_scores", "neural_scores", "artefact_scores"}))
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_neural_scores_of_pages_without_a_vector(spark, tmp_path):
    spark.read.parquet(f"{SF}/pages.parquet").limit(6).write.parquet(f"{tmp_path}/pages.parquet")
    pages = [r.page_id for r in spark.read.parquet(f"{tmp_path}/pages.parquet").select("page_id").collect()]
    spark.read.parquet(f"{SF}/embeddings.parquet").where(F.col("vec_id").isin(pages[:3])).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["neural_scores"](spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in got) == sorted(pages) and all(0 < x < 1 for r in got for x in r[1:])


def test_neural_scores_join_vectors_and_not_images(spark):
    """An image is 48 KB, so a broadcast or a shuffle of images is what no driver holds."""
    import re

    plan = registry.queries()["neural_scores"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join LeftOuter") :]
    assert "flatten" in plan and "flatten" not in joined and "[0.0,0.0" not in joined
    assert re.search(r"RepartitionByExpression \[page_id#\d+L?\], \d+", joined)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_neural_scores_go_to_python_once(spark):
    """Six networks read three inputs; each input, the image of 48 KB above all, is made and sent for all of them."""
    plan = registry.queries()["neural_scores"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.count("flatten(") == plan.count("of(struct(") == 1


def test_what_has_no_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == ROWS_ONLY


def test_scans_are_pruned_and_filters_pushed(spark):
    from tidewatch.plans.views import table

    df = table(spark, SF, "documents").where("source = 'src1'").select("doc_id", "source")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src1)" in plan and "ReadSchema: struct<doc_id:bigint,source:string>" in plan
    plan = registry.queries()["hamming_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
