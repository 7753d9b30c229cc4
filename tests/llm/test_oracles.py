"""The corpus queries that SQL can say, against their SQL."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pytest

from segline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = db.execute(queries.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = Counter(str([r[names.index(c)] for c in cols]) for r in cur.fetchall())
    assert Counter(str([r[c] for c in cols]) for r in df.collect()) == want


def test_pipeline_drops_and_packs(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.schema == docs.schema, name
            now = out
            sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    packed = out.collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in now.select("doc_id").collect()}
