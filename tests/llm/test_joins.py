"""What joins bring to the driver: Spark sizes an exploded table by the rows it was made of."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from segline.llm import line_dedup, near_dedup
from segline.llm.components import components
from segline.llm.storage import Workspace, shuffled, unless_few
from tests.llm.test_operators import SF


def plans(spark, monkeypatch, run):
    """The plans as first made, before a stage ran, of all that run() writes, and of what it returns."""
    seen, measured = {}, Workspace.measured

    def noted(self, df, name, **marks):
        seen.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return measured(self, df, name, **marks)

    monkeypatch.setattr(Workspace, "measured", noted)
    seen["out"] = [run()._jdf.queryExecution().executedPlan().toString()]
    return seen


@pytest.mark.parametrize("words", [2, 5])
def test_buckets_are_not_broadcast(spark, monkeypatch, words):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = plans(spark, monkeypatch, lambda: near_dedup.near_duplicates(docs, words=words))["buckets"]
    assert len(made) == 1 and "BroadcastHashJoin" not in made[0] and "SortMergeJoin" in made[0]


def test_marks_of_lines_are_not_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = line_dedup.drop_repeated_runs(docs)
    out.collect()
    kinds = re.findall(r"\w*Join", out._jdf.queryExecution().executedPlan().toString())
    assert kinds[0] == "SortMergeJoin"


def test_many_counted_rows_are_not_broadcast(spark):
    big, small = spark.range(100).withColumn("x", F.lit(1)), spark.range(10)
    plan = lambda side: big.join(side, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(unless_few(small, 10, 10)) and "BroadcastHashJoin" not in plan(unless_few(small, 11, 10)) and "BroadcastHashJoin" not in plan(shuffled(small))


def test_components_of_many_edges_broadcast_nothing(spark, monkeypatch):
    monkeypatch.setattr("segline.llm.components.unless_few", lambda df, rows: unless_few(df, rows, 3))
    edges = spark.createDataFrame([(k, k + 1) for k in range(12) if k % 4], "u long, v long")
    got = {}
    made = plans(spark, monkeypatch, lambda: got.setdefault("out", components(edges, Workspace(spark, "t"))))
    assert {r["node"]: r["root"] for r in got["out"].collect()} == {k: k - (k - 1) % 4 for k in range(1, 13)}
    assert "BroadcastHashJoin" not in "".join(made["edges"]) and "SortMergeJoin" in "".join(made["edges"])
