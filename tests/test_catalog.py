"""Every registered query against its SQL, and plans that hold at scale."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from segline import catalog
from segline.operators import timeline, window
from segline.plans.projections import rows
from segline.schema import TRACK

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return db


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(str([r[i] for i in order]) for r in rows)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    """And its plan has no cartesian product, no row-at-a-time Python, and Pandas only to read boxes of files."""
    df = catalog.QUERIES[name](spark, SF)
    text = plan(df)
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    assert name == "s5_box_facts" or "Pandas" not in text
    got = bag(df.columns, df.collect())
    assert got
    cur = duck.execute(catalog.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == bag(names, cur.fetchall())


def test_barrier_reads_segments_few_times(spark):
    text = plan(catalog.QUERIES["j2_av_barrier"](spark, SF))
    assert text.count("FileScan") <= 4 and text.count("Exchange hashpartitioning") <= 12 and "SortAggregate" not in text


def test_windows_of_a_track_share_one_exchange(spark):
    s = rows(spark, SF, "seg").select(*TRACK, "seg_no", "start_pts", "end_pts", "timescale").repartition(8, *TRACK)
    chain = timeline.derive_ends(s)
    chain = window.project_live_window(timeline.contiguous_run(chain), 120, 6)
    assert plan(chain).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["t2_derive_ends", "j2_av_barrier", "r2_media_playlists", "w2_expire"])
def test_row_order_and_partitions_change_nothing(spark, tmp_path, name):
    line = spark.read.parquet(f"{SF}/lineitem.parquet").orderBy(F.rand(3)).repartition(13)
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    a, b = (catalog.QUERIES[name](spark, d) for d in (SF, str(tmp_path)))
    assert bag(a.columns, a.collect()) == bag(b.columns, b.collect())
