"""The pipeline's stages on a small fixture whose clean and unclean documents are known."""

from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline
from tidewatch.llm import queries


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    stems = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    text = lambda: " ".join(rng.choices(stems, k=60))
    bench = text()
    rows, labels = [], []
    for i in range(600):
        t = text()
        if i % 6 == 0:
            t = " vilest ".join(t[j : j + 60] for j in range(0, len(t), 60))
        if i % 50 == 1:
            t = t + " " + bench
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, rows[7][1], "en", "s0", 1) for i in range(5)]
    for name, data, schema in (("documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", [(1, bench)], "item_id bigint, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = {i for i in range(600) if i % 6}
    assert kept["toxicity"] >= clean and len(kept["toxicity"] - clean - set(range(1000, 1005))) <= 2
    assert kept["simhash_dedup"] >= clean and not kept["simhash_dedup"] & set(range(1000, 1005))
    assert kept["decontamination"] & clean == {i for i in clean if i % 50 != 1}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.shard for r in out} == set(range(16)) and len(out) >= 0.9 * len(kept["decontamination"])


def test_every_operator_has_a_query():
    assert sorted(int(x[2:].split("_")[0]) for x in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    cur = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    assert got == sorted(repr([r[names.index(c)] for c in columns]) for r in cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_mixing_has_no_python_in_its_plan(spark):
    plan = queries.queries()["op7_mixing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
